"""Queries for reports, overlays, guarded reads and set comparisons on the code graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators import changes, graph, hierarchy, resolution, text, views
from graphloom.operators.latest import latest_per_key
from graphloom.plans import code
from graphloom.plans.code import _calls, _edges, _files, _map, _nodes
from graphloom.plans.code_sql import _C, _CHANGED, _E, _F, _LINES, _M, _N, _NORMAL, _WORDS
from graphloom.plans.records import _CIRCLES, _TREE
from graphloom.session import materialize, table

#: Rows written before it are the older version of a table, all rows the newer.
SPLIT = "2026-01-01T00:00:00Z"


def _nodes_before(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = table(spark, d, "nodes").where(F.col("updated_at").isNull() | (F.col("updated_at") < SPLIT))
    return latest_per_key(rows, ["id"], ["updated_at"], list(columns))


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines 3 to 7 of every text, and where the next page begins."""
    return text.line_range(table(spark, d, "source_texts"), "sha256", "content", 3, 5)


def read_states(spark: SparkSession, d: str) -> DataFrame:
    """What a guarded read of every current file gives, and how long its text is."""
    got = views.verified_texts(_map(spark, d, "sha256").select("id", "sha256"), table(spark, d, "source_texts"))
    return got.select("id", "state", F.length("content").alias("n_chars"))


def symbol_spans(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each symbol as its file's text has them, against the digest of its body."""
    spans = _nodes(spark, d, "file_id", "start_line", "end_line", "body_sha").join(_files(spark, d, "sha256").select(F.col("id").alias("file_id"), F.col("sha256").alias("key")), "file_id")
    return views.span_texts(spans.select("id", "key", "start_line", "end_line", F.col("body_sha").alias("sha")), table(spark, d, "source_texts").select(F.col("sha256").alias("key"), "content"))


def file_symbols(spark: SparkSession, d: str) -> DataFrame:
    docs = views.file_documents(_nodes(spark, d, "file_id", "start_line"))
    return docs.select("file_id", F.size("symbols").alias("n_symbols"), F.array_join("symbols", " ").alias("symbols"))


def snapshot_sources(spark: SparkSession, d: str) -> DataFrame:
    """The entries of archived maps, read from their documents: how many of each category are included, per revision."""
    entry = "array<struct<id: string, category: string, included: boolean>>"
    docs = table(spark, d, "snapshot_history").select("project_id", "revision", F.from_json(F.get_json_object("document", "$.sources"), entry).alias("s")).distinct()
    rows = docs.select("project_id", "revision", F.inline("s")).distinct()
    return rows.groupBy("project_id", "revision", "category").agg(F.count("*").alias("n"), F.sum(F.coalesce("included", F.lit(False)).cast("long")).alias("n_included"))


def newest_revisions(spark: SparkSession, d: str) -> DataFrame:
    """The three newest archived revisions of each project."""
    w = Window.partitionBy("project_id").orderBy(F.desc("revision"))
    rows = table(spark, d, "snapshot_history").select("project_id", "revision").distinct()
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 3")


def inclusion_rule(spark: SparkSession, d: str) -> DataFrame:
    """Where the rule for including a file (decodable, of a kind that is read, or too large to tell) agrees with the map."""
    kind = F.lower(F.trim("category"))
    rule = F.col("encoding").isNotNull() | F.coalesce(kind.isin("source", "build", "documentation"), F.lit(False)) | F.coalesce(F.col("bytes") > 2 << 20, F.lit(False))
    return _map(spark, d, "encoding", "category", "bytes", "included").groupBy(rule.alias("by_rule"), "included").agg(F.count("*").alias("n"))


def language_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of two languages, however written, whose path matches a glob."""
    name = F.lower(F.trim("language"))
    rows = _files(spark, d, "path", "language").where(name.isin("python", "typescript"))
    return rows.where(paths.normal(F.col("path")).rlike(paths.glob("**/*e*.*"))).select("id", "path")


def symbol_exact(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by id, name or qualified name, with their path."""
    name = "symbol:5b5d7ded32fe1f096ed99db4"
    rows = _nodes(spark, d, "name", "qualified_name", "file_id").where((F.col("id") == name) | (F.col("name") == name) | (F.col("qualified_name") == name) | F.col("name").isin("render", "emit", "scan", "load", "merge") | F.col("qualified_name").startswith("Early"))
    return rows.join(_files(spark, d, "path").select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "name", "path")


def call_targets(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of sessions: how many targets they name, the first five, whether there are more."""
    rows = table(spark, d, "calls").where("target is not null").select("session", "target").distinct()
    w = Window.partitionBy("session").orderBy("target")
    few = rows.withColumn("_k", F.row_number().over(w)).where("_k <= 6").groupBy("session").agg(F.array_sort(F.collect_list("target")).alias("t"))
    n = rows.groupBy("session").agg(F.count("*").alias("n_targets"))
    return few.join(n, "session").select("session", "n_targets", F.array_join(F.slice("t", 1, 5), " ").alias("sample"), (F.size("t") > 5).alias("truncated"))


def evidence_state(spark: SparkSession, d: str) -> DataFrame:
    """Whether what was read of each file still holds: read, its symbols complete, parsed, and of the map's hash."""
    m = _map(spark, d, "sha256", "read_state", "symbols_complete").select("id", F.lower("sha256").alias("now"), "read_state", "symbols_complete")
    f = _files(spark, d, "sha256", "state").select("id", "sha256", "state")
    good = (F.col("read_state") == "read") & F.col("symbols_complete") & (F.col("state") == "parsed") & (F.col("now") == F.col("sha256"))
    return m.join(f, "id").select("id", F.when(F.coalesce(good, F.lit(False)), "current_evidence").otherwise("needs_review").alias("status"))


def ready_files(spark: SparkSession, d: str) -> DataFrame:
    """Files not yet read, all files that theirs call into being read."""
    tasks = _map(spark, d, "read_state").select("id", F.when(F.col("read_state") == "read", "done").otherwise("queued").alias("state"))
    own = _nodes(spark, d, "file_id").select("id", "file_id")
    links = _calls(spark, d).select("src", "dst").distinct().join(own.select(F.col("id").alias("src"), F.col("file_id").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("file_id").alias("b")), "dst")
    return views.ready(tasks, links.where("a <> b").select(F.col("a").alias("id"), F.col("b").alias("needs_id")).distinct()).select("id")


def match_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of a name and their neighbours, the matches first, 150 at most."""
    hits = _nodes(spark, d, "name").where(F.contains(F.lower("name"), F.lit("ledger"))).select("id")
    return views.neighbourhood(_calls(spark, d), materialize(hits)).orderBy(F.desc("is_match"), "id").limit(150)


def any_column(spark: SparkSession, d: str) -> DataFrame:
    """Files any of whose columns contains a word, whatever the case."""
    columns = ["id", "project_id", "path", "sha256", "language", "parser_id", "state", "commit_id", "document"]
    rows = _files(spark, d, *columns)
    return rows.where(F.contains(F.lower(F.concat_ws("\n", *columns)), F.lit("partial"))).select("id")


def first_paths(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 paths that contain a word."""
    rows = _map(spark, d, "path").where(F.contains(F.lower("path"), F.lit("a")))
    return rows.select("id", "path").orderBy("path", "id").limit(200)


def layer_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).where(F.col("kind").isin("contains", "import")).select("edge_id", "kind")


def affected_call_sites(spark: SparkSession, d: str) -> DataFrame:
    """Call sites to be resolved anew: in files with changed symbols, or naming one."""
    own = _nodes(spark, d, "file_id", "name").select("id", "file_id", "name")
    bad = code._changed_symbols(spark, d).join(own, "id")
    bad = materialize(bad.select("file_id", "name"))
    sites = _edges(spark, d).where("kind = 'call' and dst_id like 'name:%'").select(F.col("edge_id").alias("site_id"), F.col("src_id").alias("id"), F.expr("substring(dst_id, 6)").alias("name"))
    sites = sites.join(own.select("id", "file_id"), "id").select("site_id", "file_id", "name")
    return resolution.affected_sites(sites, bad.where("file_id is not null"), bad.where("name is not null")).select("site_id")


def call_set_changes(spark: SparkSession, d: str) -> DataFrame:
    """Callers whose set of called symbols differs between calls recorded before and since a day."""
    rows = table(spark, d, "edges").where("kind = 'call'").select("src_id", "dst_id", "confidence", "recorded_at")
    early = F.col("recorded_at") < F.lit("2025-10-01").cast("timestamp_ntz")
    return views.set_changes(rows.where(early), rows.where(~early), "src_id", ["dst_id", "confidence"])


def rematched_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of the older version found again in the newer one by kind, name and signature, in order of lines."""
    columns = ["file_id", "kind", "qualified_name", "signature", "start_line", "body_sha"]
    pick = lambda df: df.where("file_id is not null").select("id", *columns[:-1], F.col("body_sha").alias("semantic_sha"))
    return changes.rematched(pick(_nodes_before(spark, d, *columns)), pick(_nodes(spark, d, *columns)))


def index_differences(spark: SparkSession, d: str) -> DataFrame:
    """What an index of the older version of the symbols has too much and too little for the newer one."""
    fields = ["name", "qualified_name", "signature"]
    index = text.TextIndex.build(_nodes_before(spark, d, *fields), "id", fields)
    return index.differs(_nodes(spark, d, *fields)).groupBy("difference").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_symbols"))


def stale_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose body in the older version isn't that of the newer."""
    a = _nodes_before(spark, d, "body_sha").select("id", F.col("body_sha").alias("was"))
    return a.join(_nodes(spark, d, "body_sha").select("id", "body_sha"), "id").where(~F.col("was").eqNullSafe(F.col("body_sha"))).select("id")


def overlapping_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of a file that share lines with a changed one."""
    rows = materialize(_nodes(spark, d, "file_id", "start_line", "end_line").where("file_id is not null").select("id", "file_id", "start_line", "end_line"))
    changed = rows.join(materialize(code._changed_symbols(spark, d)), "id", "left_semi")
    return views.overlapping(changed, rows, ["file_id"]).where("a_id <> b_id").select(F.col("a_id").alias("changed_id"), F.col("b_id").alias("id"))


def edge_sources(spark: SparkSession, d: str) -> DataFrame:
    """The texts that calls depend on: by confidence how many calls lead from a known text to a known text."""
    f = _files(spark, d, "sha256").select(F.col("id").alias("file_id"), "sha256")
    n = _nodes(spark, d, "file_id").select("id", "file_id").join(f, "file_id").select("id", "sha256")
    j = _calls(spark, d).join(n.select(F.col("id").alias("src"), F.col("sha256").alias("a")), "src", "left").join(n.select(F.col("id").alias("dst"), F.col("sha256").alias("b")), "dst", "left")
    return j.groupBy("confidence", F.col("a").isNotNull().alias("from_known"), F.col("b").isNotNull().alias("to_known")).agg(F.count("*").alias("n"), F.countDistinct("b").alias("n_texts"))


def containment_violations(spark: SparkSession, d: str) -> DataFrame:
    """Containment edges whose target has neither their source as its parent nor lies in the file that is their source."""
    n = _nodes(spark, d, "parent_id", "file_id").select(F.col("id").alias("dst_id"), "parent_id", "file_id")
    j = _edges(spark, d).where("kind = 'contains'").join(n, "dst_id")
    held = F.coalesce(F.col("parent_id") == F.col("src_id"), F.lit(False)) | (F.col("parent_id").isNull() & F.coalesce(F.col("file_id") == F.col("src_id"), F.lit(False)))
    return j.where(~held).select("edge_id")


def target_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls per target, with what the map says of it, if it knows it."""
    rows = table(spark, d, "calls").where("target is not null").groupBy("target").agg(F.countDistinct("id").alias("n_calls"))
    m = _map(spark, d, "path", "read_state").select(F.col("id").alias("target"), "path", "read_state")
    return rows.join(m, "target", "left")


def structure_states(spark: SparkSession, d: str) -> DataFrame:
    """The map and the parsed files merged: what both, only the map, or only the parser has."""
    j = _map(spark, d, "path").select("id", F.lit(1).alias("a")).join(_files(spark, d, "state").select("id", "state", F.lit(1).alias("b")), "id", "full_outer")
    state = F.when(F.col("a").isNull(), "unlisted").when(F.col("b").isNull(), "located").otherwise(F.coalesce("state", F.lit("unknown")))
    return j.select("id", state.alias("state"))


def touching_edges(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 edges from or to the most called symbol."""
    top = materialize(code._top_called(spark, d))
    e = _edges(spark, d)
    out = e.join(F.broadcast(top.withColumnRenamed("id", "src_id")), "src_id", "left_semi").select("edge_id", "src_id", "dst_id")
    into = e.join(F.broadcast(top.withColumnRenamed("id", "dst_id")), "dst_id", "left_semi").select("edge_id", "src_id", "dst_id")
    return out.unionByName(into).distinct().orderBy("edge_id").limit(100)


def edge_labels(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d, "name", "file_id").select("id", F.col("file_id").alias("owner_id"), "name")
    f = _files(spark, d, "path").select("id", F.col("path").alias("name"))
    return views.labelled(_edges(spark, d).where("kind = 'call'").select("edge_id", F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), n, f)


def stale_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with their freshness: stale where their file's hash is no longer the map's."""
    m = _map(spark, d, "sha256").select("id", F.lower("sha256").alias("now"))
    moved = _files(spark, d, "sha256").select("id", "sha256").join(m, "id", "left").where(~F.col("now").eqNullSafe(F.col("sha256"))).select("id")
    return views.with_freshness(_nodes(spark, d, "file_id").select("id", "file_id"), "file_id", moved).groupBy("file_id", "freshness").agg(F.count("*").alias("n"))


def root_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Symbols without a parent that are one themselves."""
    n = _nodes(spark, d, "parent_id").select("id", "parent_id")
    return n.where("parent_id is null").join(n.select(F.col("parent_id").alias("id")).where("id is not null").distinct(), "id", "left_semi").select("id")


def newest_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The 50 sessions that began last, with the number of all."""
    s = table(spark, d, "calls").where("started is not null and not isnan(started)").groupBy("session").agg(F.max("started").alias("last_start"))
    s = materialize(s)
    return s.crossJoin(F.broadcast(s.agg(F.count("*").alias("n_sessions")))).orderBy(F.desc("last_start"), "session").limit(50)


def reading_status(spark: SparkSession, d: str) -> DataFrame:
    return views.completion(_map(spark, d, "project_id", "included", "read_state", "symbols_complete"), "project_id")


def session_states(spark: SparkSession, d: str) -> DataFrame:
    """Calls by what became of them, and which are still open past an hour after the session's last start."""
    rows = table(spark, d, "calls").groupBy("id").agg(F.max(F.struct("session", "started", "ended", "status")).alias("r")).select("id", "r.*")
    last = rows.groupBy("session").agg(F.max("started").alias("last"))
    open_ = F.col("ended").isNull()
    gone = open_ & (F.col("started") + 3600 < F.col("last"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return rows.join(last, "session").groupBy("status").agg(F.count("*").alias("n_calls"), n(open_ & ~F.coalesce(gone, F.lit(False))).alias("n_live"), n(gone).alias("n_expired"))


def root_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per root symbol: symbols below it, their calls, those that leave it and those that lead to none."""
    tree = hierarchy.resolve_links(hierarchy.current_nodes(table(spark, d, "nodes")), near=["file_id", "start_line"])
    roots = materialize(tree.select("id", F.when(F.col("cycle").isNull(), F.col("root")).alias("root_id")))
    return views.scope_report(roots, _calls(spark, d).select("src", "dst"))


def issue_report(spark: SparkSession, d: str) -> DataFrame:
    return views.issues(code.key_violations(spark, d))


def affected_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that only one of two versions of the symbols has, in its file."""
    pick = lambda df: df.select("file_id", "name")
    return views.symmetric_difference(pick(_nodes_before(spark, d, "file_id", "name")), pick(_nodes(spark, d, "file_id", "name")))


def affected_union(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that a narrow or a wide rule takes: changed ones, and all of files with a changed one."""
    changed = materialize(code._changed_symbols(spark, d))
    n = _nodes(spark, d, "file_id").select("id", "file_id")
    files = n.join(changed, "id", "left_semi").select("file_id").where("file_id is not null").distinct()
    return changed.unionByName(n.join(files, "file_id", "left_semi").select("id")).distinct()


def repaired_lists(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of each file without the changed ones, and which lists lost some."""
    docs = views.file_documents(_nodes(spark, d, "file_id", "start_line"))
    out = views.without_retired(docs, "file_id", "symbols", code._changed_symbols(spark, d))
    return out.select("file_id", F.size("symbols").alias("n_left"), "stale")


def certain_circles(spark: SparkSession, d: str) -> DataFrame:
    """Circles of calls that are resolved within their file or project."""
    sure = _calls(spark, d).where(F.col("confidence").isin("resolved_local", "unique_in_project"))
    return graph.strong_components(sure.select("src", "dst"))


def nearest_types(spark: SparkSession, d: str) -> DataFrame:
    """The nearest class, struct or interface around each symbol."""
    return views.nearest(_nodes(spark, d, "parent_id", "kind").select("id", "parent_id", "kind"), ["class", "struct", "interface"])


def call_types(spark: SparkSession, d: str) -> DataFrame:
    """Calls by how their ends stand to one another."""
    n = _nodes(spark, d, "parent_id", "file_id").select("id", "parent_id", "file_id")
    a = n.select(F.col("id").alias("src"), F.col("parent_id").alias("ap"), F.col("file_id").alias("af"))
    b = n.select(F.col("id").alias("dst"), F.col("parent_id").alias("bp"), F.col("file_id").alias("bf"), F.lit(True).alias("b_known"))
    j = _calls(spark, d).join(a, "src", "left").join(b, "dst", "left")
    kind = F.when(F.col("src") == F.col("dst"), "recursion").when(F.col("b_known").isNull(), "open").when(F.col("bp") == F.col("src"), "to_child").when(F.col("ap") == F.col("dst"), "to_parent").when(F.col("ap") == F.col("bp"), "to_sibling").when(F.col("af") == F.col("bf"), "within_file").otherwise("across_files")
    return j.groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


def owners(spark: SparkSession, d: str) -> DataFrame:
    """Who owns a symbol: its parent, else its least caller, else its file."""
    n = _nodes(spark, d, "parent_id", "file_id").select("id", "parent_id", "file_id")
    known = n.select(F.col("id").alias("parent_id"), F.lit(True).alias("_p"))
    caller = _calls(spark, d).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("_c"))
    j = n.join(known, "parent_id", "left").join(caller, "id", "left")
    return j.select("id", F.coalesce(F.when(F.col("_p"), F.col("parent_id")), "_c", "file_id").alias("owner_id"))


def colour_slots(spark: SparkSession, d: str) -> DataFrame:
    """Numbers for projects: those of the first snapshots are kept, others get the lowest free ones."""
    saved = table(spark, d, "snapshot_history").groupBy(F.col("project_id").alias("id")).agg((F.min("revision") * 3 + F.length(F.max("snapshot_id"))).cast("long").alias("slot"))
    return views.slots(saved, table(spark, d, "sample_map").select(F.col("project_id").alias("id")))


def sync_actions(spark: SparkSession, d: str) -> DataFrame:
    fields = ["file_id", "name", "qualified_name", "parent_id", "signature", "body_sha"]
    known = _files(spark, d, "sha256", "state").select("id", "sha256", "state")
    found = _map(spark, d, "sha256").select("id", F.lower("sha256").alias("sha256"))
    old, new = materialize(_nodes_before(spark, d, *fields)), materialize(_nodes(spark, d, *fields))
    return views.sync_plan(known, found, old, new, _calls(spark, d).select("src", "dst"), fields)


def failure_kinds(spark: SparkSession, d: str) -> DataFrame:
    words = {"storage": ["io", "disk"], "input": ["source", "schema"], "tooling": ["tool", "timeout"]}
    rows = table(spark, d, "calls").select("id", "error_kind").distinct()
    return rows.groupBy(views.failure_kind("error_kind", words).alias("failure")).agg(F.count("*").alias("n"))


def short_ids(spark: SparkSession, d: str) -> DataFrame:
    """Qualified names as identities of at most 40 characters, longer ones by digest."""
    return _nodes(spark, d, "qualified_name").select("id", views.shortened("qualified_name", 40).alias("identity"))


def expired_calls(spark: SparkSession, d: str) -> DataFrame:
    """Symbols' leases swept at a time: those that ended are queued again."""
    from graphloom.sources import store

    n = _nodes(spark, d, "start_line", "degree").select(F.col("id").alias("node_id"), F.when(F.col("degree") > 0, "running").otherwise("queued").alias("state"), (F.col("start_line") * 1.0).alias("expires_at"), F.lit("w").alias("worker"), F.lit("l").alias("lease_id"))
    return store.expired(n, 20.0).groupBy("state").agg(F.count("*").alias("n"), F.count("worker").alias("n_leased"))


QUERIES = {f.__name__: f for f in (first_lines, read_states, symbol_spans, file_symbols, snapshot_sources, newest_revisions, inclusion_rule, language_files, symbol_exact, call_targets, evidence_state, ready_files, match_neighbours, any_column, first_paths, layer_edges, affected_call_sites, call_set_changes, rematched_symbols, index_differences, stale_bodies, overlapping_symbols, edge_sources, containment_violations, target_calls, structure_states, touching_edges, edge_labels, stale_overlay, root_scopes, newest_sessions, reading_status, session_states, root_coverage, issue_report, affected_names, affected_union, repaired_lists, certain_circles, nearest_types, call_types, owners, colour_slots, sync_actions, failure_kinds, short_ids, expired_calls)}

_OLD = f"o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, parent_id DESC NULLS LAST) AS rn FROM nodes WHERE updated_at IS NULL OR updated_at < '{SPLIT}') WHERE rn = 1)"
_CLOSED = """r AS (SELECT src AS a, dst AS b FROM k UNION SELECT r.a, k.dst FROM r JOIN k ON k.src = r.b)"""
_PLAIN = _WORDS.replace("replace(name, '_', ' '), replace(qualified_name, '_', ' '), replace(signature, '_', ' ')", "name, qualified_name, signature")
_INDEX = lambda t: f"(SELECT term, id, count(*) AS tf, any_value(length) AS length FROM (SELECT id, unnest(w) AS term, len(w) AS length FROM (SELECT id, {_PLAIN} AS w FROM {t})) GROUP BY term, id)"

SQL = {
    "first_lines": f"WITH {_LINES}, k AS (SELECT sha256, max(line_no) AS n FROM lines GROUP BY sha256) SELECT sha256, CAST(line_no AS INTEGER) AS line_no, line, CASE WHEN n >= 8 THEN 8 END AS next_start FROM lines JOIN k USING (sha256) WHERE line_no BETWEEN 3 AND 7",
    "read_states": f"WITH {_M}, j AS (SELECT m.id, m.sha256, t.content FROM m LEFT JOIN source_texts t ON t.sha256 = m.sha256), s AS (SELECT id, content, CASE WHEN content IS NULL THEN 'absent' WHEN strlen(content) > 2097152 THEN 'too_large' WHEN sha256(content) <> lower(j.sha256) THEN 'changed' ELSE 'read' END AS state FROM j) SELECT id, state, CAST(CASE WHEN state = 'read' THEN length(content) END AS INTEGER) AS n_chars FROM s",
    "symbol_spans": f"""WITH {_N}, {_F}, l AS (SELECT sha256, regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM source_texts WHERE content IS NOT NULL),
j AS (SELECT n.id, n.body_sha, array_to_string(l[n.start_line:n.end_line], chr(10)) AS body, len(l) < n.end_line AS outside FROM n JOIN f ON f.id = n.file_id JOIN l ON l.sha256 = f.sha256 WHERE n.start_line >= 1 AND n.end_line >= n.start_line)
SELECT id, CAST(length(body) AS INTEGER) AS n_chars, CASE WHEN outside THEN 'outside' WHEN body_sha IS NOT NULL AND sha256(body) <> body_sha THEN 'changed' ELSE 'read' END AS state FROM j""",
    "file_symbols": f"WITH {_N} SELECT file_id, CAST(count(*) AS INTEGER) AS n_symbols, string_agg(id, ' ' ORDER BY start_line NULLS FIRST, id) AS symbols FROM n WHERE file_id IS NOT NULL GROUP BY file_id",
    "snapshot_sources": """WITH s AS (SELECT DISTINCT project_id, revision, unnest(from_json(json_extract(document, '$.sources'), '[{"id":"VARCHAR","category":"VARCHAR","included":"BOOLEAN"}]')) AS s FROM snapshot_history)
SELECT project_id, revision, s.category AS category, count(*) AS n, CAST(sum(CASE WHEN s.included THEN 1 ELSE 0 END) AS BIGINT) AS n_included FROM s GROUP BY ALL""",
    "newest_revisions": "SELECT project_id, revision, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY revision DESC) AS place FROM (SELECT DISTINCT project_id, revision FROM snapshot_history)) WHERE place <= 3",
    "inclusion_rule": f"WITH {_M} SELECT (encoding IS NOT NULL OR coalesce(lower(trim(category)) IN ('source', 'build', 'documentation'), false) OR coalesce(bytes > 2097152, false)) AS by_rule, included, count(*) AS n FROM m GROUP BY ALL",
    "language_files": f"WITH {_F} SELECT id, path FROM f WHERE lower(trim(language)) IN ('python', 'typescript') AND regexp_matches({_NORMAL}, '^(?:.*/)?[^/]*e[^/]*\\.[^/]*$')",
    "symbol_exact": f"WITH {_N}, {_F} SELECT n.id, n.name, f.path FROM n JOIN f ON f.id = n.file_id WHERE n.id = 'symbol:5b5d7ded32fe1f096ed99db4' OR n.name = 'symbol:5b5d7ded32fe1f096ed99db4' OR n.qualified_name = 'symbol:5b5d7ded32fe1f096ed99db4' OR n.name IN ('render', 'emit', 'scan', 'load', 'merge') OR starts_with(n.qualified_name, 'Early')",
    "call_targets": "SELECT session, count(*) AS n_targets, array_to_string(list_sort(list(target))[1:5], ' ') AS sample, count(*) > 5 AS truncated FROM (SELECT DISTINCT session, target FROM calls WHERE target IS NOT NULL) GROUP BY session",
    "evidence_state": f"WITH {_M}, {_F} SELECT m.id, CASE WHEN m.read_state = 'read' AND m.symbols_complete AND f.state = 'parsed' AND lower(m.sha256) = f.sha256 THEN 'current_evidence' ELSE 'needs_review' END AS status FROM m JOIN f ON f.id = m.id",
    "ready_files": f"""WITH {_M}, {_N}, {_E}, {_C}, x AS (SELECT DISTINCT a.file_id AS id, b.file_id AS needs FROM c JOIN n a ON a.id = c.src JOIN n b ON b.id = c.dst WHERE a.file_id <> b.file_id)
SELECT id FROM m WHERE read_state IS DISTINCT FROM 'read' AND NOT EXISTS (SELECT 1 FROM x WHERE x.id = m.id AND x.needs NOT IN (SELECT id FROM m WHERE read_state = 'read'))""",
    "match_neighbours": f"""WITH {_N}, {_E}, {_C}, h AS (SELECT id FROM n WHERE contains(lower(name), 'ledger')),
x AS (SELECT id, true AS k FROM h UNION ALL SELECT dst, false FROM c WHERE src IN (SELECT id FROM h) UNION ALL SELECT src, false FROM c WHERE dst IN (SELECT id FROM h))
SELECT id, bool_or(k) AS is_match FROM x GROUP BY id ORDER BY is_match DESC, id LIMIT 150""",
    "any_column": f"WITH {_F} SELECT id FROM f WHERE contains(lower(concat_ws(chr(10), id, project_id, path, sha256, language, parser_id, state, commit_id, document)), 'partial')",
    "first_paths": f"WITH {_M} SELECT id, path FROM m WHERE contains(lower(path), 'a') ORDER BY path, id LIMIT 200",
    "layer_edges": f"WITH {_E} SELECT edge_id, kind FROM e WHERE kind IN ('contains', 'import')",
    "affected_call_sites": f"""WITH {_N}, {_E}, {_CHANGED}, bad AS (SELECT n.file_id, n.name FROM n JOIN changed USING (id)),
s AS (SELECT e.edge_id, n.file_id, substr(e.dst_id, 6) AS name FROM e JOIN n ON n.id = e.src_id WHERE e.kind = 'call' AND starts_with(e.dst_id, 'name:'))
SELECT edge_id AS site_id FROM s WHERE file_id IN (SELECT file_id FROM bad) OR name IN (SELECT name FROM bad) OR string_split(name, '.')[-1] IN (SELECT name FROM bad)""",
    "call_set_changes": """WITH x AS (SELECT DISTINCT src_id, dst_id, confidence, recorded_at < TIMESTAMP '2025-10-01' AS early FROM edges WHERE kind = 'call'),
y AS (SELECT src_id, dst_id, confidence, bool_or(early) AS e, bool_or(NOT early) AS l FROM x GROUP BY ALL)
SELECT src_id, count(*) FILTER (e AND NOT l) AS n_lost, count(*) FILTER (l AND NOT e) AS n_won FROM y WHERE e <> l GROUP BY src_id""",
    "rematched_symbols": f"""WITH {_N}, {_OLD}, a AS (SELECT *, row_number() OVER (PARTITION BY file_id, kind, qualified_name, signature ORDER BY start_line NULLS FIRST, id) AS k FROM o WHERE file_id IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY file_id, kind, qualified_name, signature ORDER BY start_line NULLS FIRST, id) AS k FROM n WHERE file_id IS NOT NULL),
p AS (SELECT a.id AS old_id, b.id AS new_id FROM a JOIN b ON a.file_id = b.file_id AND a.kind IS NOT DISTINCT FROM b.kind AND a.qualified_name IS NOT DISTINCT FROM b.qualified_name AND a.signature IS NOT DISTINCT FROM b.signature AND a.k = b.k),
ra AS (SELECT file_id, kind, qualified_name, body_sha, min(id) AS id FROM a WHERE body_sha IS NOT NULL AND id NOT IN (SELECT old_id FROM p) GROUP BY ALL HAVING count(*) = 1),
rb AS (SELECT file_id, kind, qualified_name, body_sha, min(id) AS id FROM b WHERE body_sha IS NOT NULL AND id NOT IN (SELECT new_id FROM p) GROUP BY ALL HAVING count(*) = 1)
SELECT * FROM p UNION ALL SELECT ra.id, rb.id FROM ra JOIN rb USING (file_id, kind, qualified_name, body_sha)""",
    "index_differences": f"""WITH {_N}, {_OLD}, a AS {_INDEX('o')}, b AS {_INDEX('n')}, x AS (SELECT 'extra' AS difference, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'missing', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
SELECT difference, count(*) AS n, count(DISTINCT id) AS n_symbols FROM x GROUP BY difference""",
    "stale_bodies": f"WITH {_N}, {_OLD} SELECT n.id FROM o JOIN n USING (id) WHERE o.body_sha IS DISTINCT FROM n.body_sha",
    "overlapping_symbols": f"WITH {_N}, {_CHANGED} SELECT a.id AS changed_id, b.id FROM n a JOIN changed USING (id) JOIN n b ON b.file_id = a.file_id AND b.id <> a.id AND a.start_line <= b.end_line AND b.start_line <= a.end_line AND a.start_line <= a.end_line AND b.start_line <= b.end_line",
    "edge_sources": f"WITH {_N}, {_F}, {_E}, {_C}, x AS (SELECT n.id, f.sha256 FROM n JOIN f ON f.id = n.file_id) SELECT c.confidence, a.sha256 IS NOT NULL AS from_known, b.sha256 IS NOT NULL AS to_known, count(*) AS n, count(DISTINCT b.sha256) AS n_texts FROM c LEFT JOIN x a ON a.id = c.src LEFT JOIN x b ON b.id = c.dst GROUP BY ALL",
    "containment_violations": f"WITH {_N}, {_E} SELECT e.edge_id FROM e JOIN n ON n.id = e.dst_id WHERE e.kind = 'contains' AND NOT (coalesce(n.parent_id = e.src_id, false) OR (n.parent_id IS NULL AND coalesce(n.file_id = e.src_id, false)))",
    "target_calls": f"WITH {_M}, x AS (SELECT target, count(DISTINCT id) AS n_calls FROM calls WHERE target IS NOT NULL GROUP BY target) SELECT x.target, n_calls, path, read_state FROM x LEFT JOIN m ON m.id = x.target",
    "structure_states": f"WITH {_M}, {_F} SELECT coalesce(m.id, f.id) AS id, CASE WHEN m.id IS NULL THEN 'unlisted' WHEN f.id IS NULL THEN 'located' ELSE coalesce(f.state, 'unknown') END AS state FROM m FULL JOIN f ON f.id = m.id",
    "touching_edges": f"WITH {_E}, {_C}, top AS (SELECT dst AS id FROM c WHERE NOT starts_with(dst, 'name:') GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1) SELECT DISTINCT edge_id, src_id, dst_id FROM e WHERE src_id IN (SELECT id FROM top) OR dst_id IN (SELECT id FROM top) ORDER BY edge_id LIMIT 100",
    "edge_labels": f"""WITH {_N}, {_F}, {_E}, x AS (SELECT n.id, concat_ws('.', f.path, n.name) AS l FROM n LEFT JOIN f ON f.id = n.file_id)
SELECT e.edge_id, coalesce(a.l, e.src_id) || ' → ' || coalesce(b.l, e.dst_id) AS label FROM e LEFT JOIN x a ON a.id = e.src_id LEFT JOIN x b ON b.id = e.dst_id WHERE e.kind = 'call'""",
    "stale_overlay": f"WITH {_N}, {_F}, {_M}, g AS (SELECT f.id FROM f LEFT JOIN m ON m.id = f.id WHERE lower(m.sha256) IS DISTINCT FROM f.sha256) SELECT file_id, CASE WHEN file_id IN (SELECT id FROM g) THEN 'stale' ELSE 'current' END AS freshness, count(*) AS n FROM n GROUP BY ALL",
    "root_scopes": f"WITH {_N} SELECT id FROM n WHERE parent_id IS NULL AND id IN (SELECT parent_id FROM n)",
    "newest_sessions": "WITH s AS (SELECT session, max(started) AS last_start FROM calls WHERE started IS NOT NULL AND NOT isnan(started) GROUP BY session) SELECT *, (SELECT count(*) FROM s) AS n_sessions FROM s ORDER BY last_start DESC, session LIMIT 50",
    "reading_status": f"""WITH {_M}, x AS (SELECT project_id, count(*) FILTER (included IS NULL) AS n_undecided, count(*) FILTER (included AND read_state IS DISTINCT FROM 'read') AS n_outstanding,
  count(*) FILTER (included AND NOT coalesce(symbols_complete, false)) AS n_incomplete, count(*) FILTER (NOT included) AS n_excluded FROM m GROUP BY project_id)
SELECT *, CASE WHEN n_undecided > 0 THEN 'inventory_incomplete' WHEN n_outstanding > 0 THEN 'partial' WHEN n_incomplete > 0 THEN 'coverage_with_unresolved_relations' ELSE 'complete' END AS status FROM x""",
    "session_states": """WITH once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY started) AS rn FROM calls) WHERE rn = 1), l AS (SELECT session, max(started) AS last FROM once GROUP BY session)
SELECT status, count(*) AS n_calls, count(*) FILTER (ended IS NULL AND NOT coalesce(started + 3600 < last, false)) AS n_live, count(*) FILTER (ended IS NULL AND started + 3600 < last) AS n_expired FROM once JOIN l USING (session) GROUP BY status""",
    "root_coverage": f"""WITH RECURSIVE {_TREE}, {_E}, {_C}, x AS (SELECT a.root_id, b.root_id AS other FROM c JOIN tree a ON a.id = c.src LEFT JOIN tree b ON b.id = c.dst),
k AS (SELECT root_id, count(*) AS n_links, count(*) FILTER (other <> root_id) AS n_leaving, count(*) FILTER (other IS NULL) AS n_open FROM x GROUP BY root_id)
SELECT t.root_id, count(*) AS n_nodes, coalesce(any_value(n_links), 0) AS n_links, coalesce(any_value(n_leaving), 0) AS n_leaving, coalesce(any_value(n_open), 0) AS n_open FROM tree t LEFT JOIN k USING (root_id) GROUP BY t.root_id""",
    "issue_report": "WITH v AS (%s) SELECT rule, record_id, n FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY record_id) AS k, count(*) OVER (PARTITION BY rule) AS n FROM v) WHERE k <= 40" % code.SQL["key_violations"],
    "affected_names": f"WITH {_N}, {_OLD} SELECT *, 'left' AS side FROM (SELECT file_id, name FROM o EXCEPT SELECT file_id, name FROM n) UNION ALL SELECT *, 'right' FROM (SELECT file_id, name FROM n EXCEPT SELECT file_id, name FROM o)",
    "affected_union": f"WITH {_N}, {_CHANGED} SELECT id FROM changed UNION SELECT id FROM n WHERE file_id IN (SELECT file_id FROM n JOIN changed USING (id))",
    "repaired_lists": f"WITH {_N}, {_CHANGED} SELECT file_id, CAST(count(*) FILTER (id NOT IN (SELECT id FROM changed)) AS INTEGER) AS n_left, bool_or(id IN (SELECT id FROM changed)) AS stale FROM n WHERE file_id IS NOT NULL GROUP BY file_id",
    "certain_circles": f"WITH RECURSIVE {_E}, {_C}, k AS (SELECT DISTINCT src, dst FROM c WHERE confidence IN ('resolved_local', 'unique_in_project')), {_CLOSED} SELECT x.a AS id, min(y.a) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a",
    "nearest_types": f"""WITH RECURSIVE {_N}, w AS (SELECT id, parent_id AS at, 1 AS k FROM n UNION ALL SELECT w.id, n.parent_id, w.k + 1 FROM w JOIN n ON n.id = w.at WHERE n.kind NOT IN ('class', 'struct', 'interface') AND w.k < 2000)
SELECT n.id, max(CASE WHEN p.kind IN ('class', 'struct', 'interface') THEN p.id END) AS ancestor FROM n LEFT JOIN w ON w.id = n.id LEFT JOIN n p ON p.id = w.at GROUP BY n.id""",
    "call_types": f"""WITH {_N}, {_E}, {_C} SELECT CASE WHEN c.src = c.dst THEN 'recursion' WHEN b.id IS NULL THEN 'open' WHEN b.parent_id = c.src THEN 'to_child' WHEN a.parent_id = c.dst THEN 'to_parent' WHEN a.parent_id = b.parent_id THEN 'to_sibling' WHEN a.file_id = b.file_id THEN 'within_file' ELSE 'across_files' END AS type, count(*) AS n
FROM c LEFT JOIN n a ON a.id = c.src LEFT JOIN n b ON b.id = c.dst GROUP BY ALL""",
    "owners": f"WITH {_N}, {_E}, {_C}, k AS (SELECT dst, min(src) AS src FROM c GROUP BY dst) SELECT n.id, coalesce(p.id, k.src, n.file_id) AS owner_id FROM n LEFT JOIN n p ON p.id = n.parent_id LEFT JOIN k ON k.dst = n.id",
    "colour_slots": """WITH saved AS (SELECT project_id AS id, CAST(min(revision) * 3 + length(max(snapshot_id)) AS BIGINT) AS slot FROM snapshot_history WHERE project_id IS NOT NULL GROUP BY project_id),
fresh AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT DISTINCT project_id AS id FROM sample_map WHERE project_id IS NOT NULL) WHERE id NOT IN (SELECT id FROM saved)),
free AS (SELECT s AS slot, row_number() OVER (ORDER BY s) AS k FROM unnest(range(0, 100000)) t(s) WHERE s NOT IN (SELECT slot FROM saved))
SELECT id, slot FROM saved UNION ALL SELECT fresh.id, free.slot FROM fresh JOIN free USING (k)""",
    "sync_actions": f"""WITH {_N}, {_OLD}, {_F}, {_M}, {_E}, {_C},
d AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' ELSE 'modified' END AS change, o.id IS NOT NULL AND n.id IS NOT NULL AND o.body_sha IS DISTINCT FROM n.body_sha AS body FROM o FULL JOIN n ON n.id = o.id
  WHERE o.id IS NULL OR n.id IS NULL OR (o.file_id, o.name, o.qualified_name, o.parent_id, o.signature, o.body_sha) IS DISTINCT FROM (n.file_id, n.name, n.qualified_name, n.parent_id, n.signature, n.body_sha)),
s AS (SELECT id, 'stale' AS status FROM d WHERE body), i AS (SELECT * FROM s UNION ALL SELECT DISTINCT src, 'suspect' FROM c WHERE dst IN (SELECT id FROM s) AND src NOT IN (SELECT id FROM s))
SELECT 'reconcile' AS stage, coalesce(m.id, f.id) AS id, CASE WHEN m.id IS NULL THEN 'drop' WHEN f.state IN ('parsed', 'partial') AND lower(m.sha256) IS NOT DISTINCT FROM f.sha256 THEN 'reuse' ELSE 'parse' END AS action FROM m FULL JOIN f ON f.id = m.id
UNION ALL SELECT 'persist', id, change FROM d UNION ALL SELECT 'invalidate', id, status FROM i UNION ALL SELECT 'enqueue', id, 'queued' FROM i WHERE id IN (SELECT id FROM n)""",
    "failure_kinds": """SELECT CASE WHEN error_kind IS NULL THEN NULL WHEN contains(lower(error_kind), 'io') OR contains(lower(error_kind), 'disk') THEN 'storage' WHEN contains(lower(error_kind), 'source') OR contains(lower(error_kind), 'schema') THEN 'input'
  WHEN contains(lower(error_kind), 'tool') OR contains(lower(error_kind), 'timeout') THEN 'tooling' ELSE 'other' END AS failure, count(*) AS n FROM (SELECT DISTINCT id, error_kind FROM calls) GROUP BY ALL""",
    "short_ids": f"WITH {_N} SELECT id, CASE WHEN length(qualified_name) > 40 THEN 'sha256:' || sha256(qualified_name) ELSE qualified_name END AS identity FROM n",
    "expired_calls": f"WITH {_N}, x AS (SELECT CASE WHEN degree > 0 THEN 'running' ELSE 'queued' END AS state, start_line * 1.0 <= 20 AS gone FROM n) SELECT CASE WHEN state = 'running' AND gone THEN 'queued' ELSE state END AS state, count(*) AS n, count(*) FILTER (NOT (state = 'running' AND gone)) AS n_leased FROM x GROUP BY ALL",
}
