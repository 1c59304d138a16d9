"""Queries on the code graph: symbols, edges, files and their texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators import changes, graph, intervals, ordered, resolution, snapshots, text
from graphloom.operators.latest import latest_per_key
from graphloom.session import materialize, table
from graphloom.sources import store, tree


def _nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest_per_key(table(spark, d, "nodes"), ["id"], ["updated_at"], list(columns))


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest_per_key(table(spark, d, "files"), ["id"], ["updated_at"], list(columns))


def _map(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest_per_key(table(spark, d, "sample_map"), ["id"], ["delivered_at"], list(columns))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_edges(table(spark, d, "edges"))


def _call_rows(spark: SparkSession, d: str) -> DataFrame:
    """Calls as they were delivered, some of them twice."""
    return table(spark, d, "edges").where("kind = 'call'").select("edge_id", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "site_line", "confidence")


def _once(calls: DataFrame) -> DataFrame:
    return graph.distinct_edges(calls, ["edge_id", "src", "dst", "site_line"])


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).where("kind = 'call'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "site_line", "confidence")


def _top_called(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(_calls(spark, d)).where("dst not like 'name:%'").orderBy(F.desc("degree"), "dst").limit(1).select(F.col("dst").alias("id"))


def _top_caller(spark: SparkSession, d: str) -> DataFrame:
    """The symbol that calls most others whose symbols are known."""
    known = _calls(spark, d).where("dst not like 'name:%'").select("src", "dst").distinct()
    return known.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("id"))


def current_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "kind", "qualified_name", "file_id").select("id", "kind", "qualified_name", "file_id", "updated_at")


def degree_topk(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(_calls(spark, d)).orderBy(F.desc("degree"), "dst").limit(50)


def degree_recount(spark: SparkSession, d: str) -> DataFrame:
    counted = graph.in_degree(_calls(spark, d)).withColumnRenamed("dst", "id").withColumnRenamed("degree", "counted")
    both = _nodes(spark, d, "degree").join(counted, "id", "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return both.where(~F.col("degree").eqNullSafe(F.col("counted"))).select("id", "degree", "counted")


def callers_of_top(spark: SparkSession, d: str) -> DataFrame:
    found = graph.bounded_search(_call_rows(spark, d), _top_called(spark, d), 3, forward=False, once=_once)
    return found.edges.select("level", "src", "dst", "site_line", "confidence")


def callers_limited(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 calls on the way to the most called symbol, and whether there were more."""
    found = graph.bounded_search(_call_rows(spark, d).select("src", "dst", "site_line", "edge_id", "confidence"), _top_called(spark, d), 3, forward=False, once=_once_by_line, limit=100)
    return found.edges.select("level", "src", "dst", "site_line", F.lit(found.truncated).alias("truncated"))


def _once_by_line(calls: DataFrame) -> DataFrame:
    return graph.distinct_edges(calls, ["src", "dst", "site_line", "edge_id"])


def callees_from_top(spark: SparkSession, d: str) -> DataFrame:
    reached = graph.bounded_search(_call_rows(spark, d), _top_caller(spark, d), 3, forward=True, once=_once).nodes
    return reached.select("id", F.col("distance").cast("int").alias("distance"))


def edge_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("kind", "confidence").agg(F.count("*").alias("n"))


def call_shape(spark: SparkSession, d: str) -> DataFrame:
    s = graph.shape(_calls(spark, d), table(spark, d, "nodes").select("id"))
    names = ["is_source", "is_sink", "is_fork", "is_join", "is_isolated"]
    return s.agg(F.count("*").alias("n_nodes"), *[F.sum(F.col(n).cast("long")).alias(n.replace("is_", "n_")) for n in names])


def call_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_calls(spark, d).where("dst not like 'name:%'"), table(spark, d, "nodes").select("id"))


def call_circles(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(_call_rows(spark, d))


def containment_left(spark: SparkSession, d: str) -> DataFrame:
    """The links to parents that lie on circles or on ways between them."""
    return graph.peeled(_nodes(spark, d, "parent_id").select(F.col("parent_id").alias("src"), F.col("id").alias("dst")))


def file_rollup(spark: SparkSession, d: str) -> DataFrame:
    groups = _nodes(spark, d, "file_id").select("id", F.col("file_id").alias("group_id")).where("group_id is not null")
    rolled = graph.rolled_up(_edges(spark, d).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind"), groups)
    return rolled.where("to_group not like 'name:%'")


def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d, "path").select(F.col("id").alias("file_id"), paths.top_folder(paths.normal(F.col("path"))).alias("folder"))
    owned = _nodes(spark, d, "file_id").select("id", "file_id").join(files, "file_id").select("id", F.col("folder").alias("group_id"))
    groups = owned.unionByName(files.select(F.col("file_id").alias("id"), F.col("folder").alias("group_id")))
    edges = _edges(spark, d).where("dst_id not like 'name:%'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind")
    return graph.rolled_up(edges, groups, loose=False)


def related_files(spark: SparkSession, d: str) -> DataFrame:
    own = _nodes(spark, d, "file_id").select("id", "file_id").where("file_id is not null")
    pairs = _edges(spark, d).groupBy("src_id", "dst_id", "kind").agg(F.count("*").alias("n"))
    both = pairs.join(own.select(F.col("id").alias("src_id"), F.col("file_id").alias("from_file")), "src_id").join(own.select(F.col("id").alias("dst_id"), F.col("file_id").alias("to_file")), "dst_id")
    out = both.where("from_file <> to_file").groupBy("from_file", "to_file").agg(F.sum("n").alias("n_edges"), F.array_join(F.slice(F.array_sort(F.collect_set("kind")), 1, 4), ",").alias("kinds"))
    return out


def resolve_calls(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders of calls resolved anew against the current symbols."""
    files = _files(spark, d, "project_id").select(F.col("id").alias("file_id"), F.col("project_id").alias("group_id"))
    own = _nodes(spark, d, "file_id", "name", "qualified_name").join(files, "file_id").select("id", "group_id", "file_id", "name", "qualified_name")
    own = materialize(own)
    calls = _edges(spark, d).where("kind = 'call' and dst_id like 'name:%'").select(F.col("edge_id").alias("site_id"), "src_id", F.expr("substring(dst_id, 6)").alias("name"))
    sites = calls.join(own.select(F.col("id").alias("src_id"), "group_id", "file_id", F.col("qualified_name").alias("scope")), "src_id").select("site_id", "group_id", "file_id", "scope", "name")
    return resolution.resolve_names(sites, own)


def enclosing_symbols(spark: SparkSession, d: str) -> DataFrame:
    nodes = materialize(_nodes(spark, d, "file_id", "start_line", "end_line").select("id", "file_id", "start_line", "end_line").where("file_id is not null"))
    points = _edges(spark, d).where("kind = 'call'").select(F.col("edge_id").alias("point_id"), "src_id", "site_line")
    points = points.join(nodes.select(F.col("id").alias("src_id"), "file_id"), "src_id").select("point_id", "file_id", "site_line")
    return intervals.innermost(points, nodes, ["file_id"], "site_line")


def covered_lines(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merged(_nodes(spark, d, "file_id", "start_line", "end_line").where("file_id is not null"), ["file_id"])


def uncovered_lines(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d, "file_id", "start_line", "end_line").where("file_id is not null").select("file_id", "start_line", "end_line", F.lit(1).cast("long").alias("low"))
    high = nodes.groupBy("file_id").agg(F.max("end_line").alias("high"))
    return intervals.gaps(nodes.join(high, "file_id"), ["file_id"], "low", "high")


def symbol_versions(spark: SparkSession, d: str) -> DataFrame:
    out = changes.version_changes(table(spark, d, "nodes"), "id", "updated_at", ["parent_id", "file_id", "name", "qualified_name", "start_line", "end_line", "signature", "body_sha", "degree"])
    return out.select("id", "n_versions", F.array_join("changed_fields", ",").alias("changed_fields"))


def file_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """What the current files differ in from their rows of before 2026."""
    fields = ["path", "sha256", "language", "parser_id", "state", "commit_id"]
    rows = table(spark, d, "files").where("updated_at is null or updated_at < '2026-01-01T00:00:00Z'")
    found = changes.compare(latest_per_key(rows, ["id"], ["updated_at"], fields), _files(spark, d, *fields), ["id"], fields)
    return found.select("id", "change", F.array_join("changed_fields", ",").alias("changed_fields"))


def map_renames(spark: SparkSession, d: str) -> DataFrame:
    """Files that moved between the last archived snapshot of a project and its current map, by content."""
    history = table(spark, d, "snapshot_history")
    last = history.groupBy("project_id").agg(F.max("revision").alias("revision"))
    old = materialize(snapshots.archived_entries(history.select("project_id", "revision", "document").join(last, ["project_id", "revision"])).groupBy("project_id", "path").agg(F.max("sha256").alias("sha256")))
    now = _map(spark, d, "project_id", "path", "sha256").where("path is not null")
    now = now.select("project_id", "path", F.lower("sha256").alias("sha256"))
    now = materialize(now.mapInArrow(snapshots._normal_paths, now.schema))
    keys = ["project_id", "path"]
    gone = old.join(now.select(*keys), keys, "left_anti")
    came = now.join(old.select("project_id").distinct(), "project_id", "left_semi").join(old.select(*keys), keys, "left_anti")
    return changes.exact_renames(gone, came, ["project_id"])


def _changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose body differs between their first and their current row."""
    out = changes.version_changes(table(spark, d, "nodes"), "id", "updated_at", ["body_sha"])
    return out.where(F.array_contains("changed_fields", "body_sha")).select("id")


def invalidation(spark: SparkSession, d: str) -> DataFrame:
    """What symbols with another body make stale and suspect."""
    return changes.invalidated(materialize(_changed_symbols(spark, d)), _calls(spark, d))


def impact(spark: SparkSession, d: str) -> DataFrame:
    """Symbols from which calls lead, within three steps, to symbols with another body."""
    reached = graph.bounded_search(_call_rows(spark, d), _changed_symbols(spark, d), 3, forward=False, once=_once).nodes
    return reached.select("id", F.col("distance").cast("int").alias("distance"))


def work_queue(spark: SparkSession, d: str) -> DataFrame:
    size = (F.col("end_line") - F.col("start_line") + 1) * 40
    rows = _nodes(spark, d, "degree", "start_line", "end_line").select(F.col("id").alias("node_id"), "degree", (F.col("degree") == 0).alias("suspect"), size.alias("n_bytes"))
    return store.queue(rows)


def symbol_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol with its place by file, line and id, and its page of 100."""
    ranked = ordered.with_rank(_nodes(spark, d, "file_id", "start_line").select("file_id", "start_line", "id"), ["file_id", "start_line", "id"])
    return ranked.select("id", "rank", F.floor((F.col("rank") - 1) / 100).cast("long").alias("page"))


def repo_map(spark: SparkSession, d: str) -> DataFrame:
    """Per project the most called symbols whose lines fit into 2,000 bytes."""
    files = _files(spark, d, "project_id", "path").select(F.col("id").alias("file_id"), "project_id", "path")
    rows = _nodes(spark, d, "file_id", "signature", "start_line", "degree").join(files, "file_id")
    line = F.concat(F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("  "), F.coalesce("signature", F.lit("")))
    rows = rows.select("project_id", (-F.col("degree")).alias("neg"), "path", "start_line", "id", (F.octet_length(line) + 1).alias("cost"))
    return ordered.within_budget(rows, ["project_id"], ["neg", "path", "start_line", "id"], "cost", 2000).select("project_id", "id", "cost")


def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    hits = text.search(_words(spark, d), "id", ["name", "qualified_name", "signature"], "scan ledger", 50)
    return hits.select("id", F.round("score", 6).alias("score"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Names with `_` as blanks, so that their parts are words."""
    apart = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" ")).alias(c)
    return _nodes(spark, d, "name", "qualified_name", "signature").select("id", apart("name"), apart("qualified_name"), apart("signature"))


def symbol_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    q = "ledger"
    return _nodes(spark, d, "name", "qualified_name").where(F.lower("name").contains(q) | F.lower("qualified_name").contains(q)).select("id", "name")


def line_grep(spark: SparkSession, d: str) -> DataFrame:
    return text.grep(table(spark, d, "source_texts"), "sha256", "content", "Signal(")


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return text.lines(table(spark, d, "source_texts"), "sha256", "content").groupBy("sha256").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))


def path_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = _map(spark, d, "path").withColumn("path", paths.normal(F.col("path")))
    p = F.col("path")
    return rows.select("id", paths.suffix(p).alias("suffix"), paths.category(p).alias("category"), paths.language(p).alias("language"), F.array_join(paths.roles(p), ",").alias("roles"))


def prefix_files(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d, "path", "state").where(F.col("path").startswith("src/")).select("id", "path", "state")


def file_states(spark: SparkSession, d: str) -> DataFrame:
    count = F.get_json_object("document", "$.diagnostic_count").cast("long")
    return _files(spark, d, "state", "document").groupBy("state").agg(F.count("*").alias("n_files"), F.coalesce(F.sum(count), F.lit(0)).alias("n_diagnostics"))


def read_coverage(spark: SparkSession, d: str) -> DataFrame:
    included = F.coalesce("included", F.lit(False))
    rows = _map(spark, d, "project_id", "included", "read_state", "bytes")
    total = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy("project_id").agg(F.count("*").alias("n_sources"), total(included).alias("n_included"), total(included & F.col("read_state").eqNullSafe("read")).alias("n_read"), F.coalesce(F.sum(F.when(included, F.col("bytes"))), F.lit(0)).alias("included_bytes"))


def same_content(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d, "sha256").where("sha256 is not null").groupBy(F.lower("sha256").alias("sha256")).agg(F.count("*").alias("n_files")).where("n_files > 1")


def map_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each project's map that doesn't depend on the order of rows: 256 parts by the path's hash, each digested
    in order of path, then the parts."""
    rows = _map(spark, d, "project_id", "path", "sha256").select("project_id", F.concat_ws(" ", "path", "sha256").alias("line"), F.substring(F.sha2("path", 256), 1, 2).alias("part"))
    parts = rows.groupBy("project_id", "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("sha"))
    return parts.groupBy("project_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha"))), lambda x: x["sha"]), "\n"), 256).alias("digest"))


def key_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules that current rows break: duplicate paths of a project, hashes that are none, ends before starts, unknown
    confidences."""
    m = _map(spark, d, "project_id", "path", "sha256")
    twice = m.groupBy("project_id", paths.normal(F.col("path")).alias("p")).agg(F.count("*").alias("n"), F.min("id").alias("record_id")).where("n > 1").select(F.lit("path_unique").alias("rule"), "record_id")
    hashes = m.where(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))).select(F.lit("sha256_form").alias("rule"), F.col("id").alias("record_id"))
    spans = _nodes(spark, d, "start_line", "end_line").where("start_line < 1 or end_line < start_line").select(F.lit("line_order").alias("rule"), F.col("id").alias("record_id"))
    known = ["resolved_local", "unique_in_project", "ambiguous", "unresolved"]
    labels = _edges(spark, d).where(~F.coalesce(F.col("confidence").isin(known), F.lit(False))).select(F.lit("confidence_known").alias("rule"), F.col("edge_id").cast("string").alias("record_id"))
    mixed = _edges(spark, d).where("dst_id like 'name:%' and confidence <> 'unresolved'").select(F.lit("placeholder_unresolved").alias("rule"), F.col("edge_id").cast("string").alias("record_id"))
    return twice.unionByName(hashes).unionByName(spans).unionByName(labels).unionByName(mixed)


def name_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of symbols, numbered where a name occurs several times in a file."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id", "name")
    rows = _nodes(spark, d, "file_id", "name").where("file_id is not null and name is not null")
    n = F.row_number().over(w.orderBy("id"))
    label = F.when(F.count("*").over(w) > 1, F.concat(F.col("name"), F.lit(" · "), n.cast("string"))).otherwise(F.col("name"))
    return rows.select("id", label.alias("label"))


def file_top_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The three most called symbols of each file."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy(F.desc("degree"), "id")
    rows = _nodes(spark, d, "file_id", "degree").where("file_id is not null").withColumn("place", F.row_number().over(w)).where("place <= 3")
    return rows.select("file_id", "id", "degree", "place")


def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    wanted = _files(spark, d, "path", "sha256").where("lower(path) like '%.py' or lower(path) like '%.pyi'").select("sha256").distinct()
    return tree.python_symbols(table(spark, d, "source_texts").join(wanted, "sha256", "left_semi")).select("file_key", "id", "kind", "qualified_name", "start_line", "end_line", "state")


def python_sites(spark: SparkSession, d: str) -> DataFrame:
    wanted = _files(spark, d, "path", "sha256").where("lower(path) like '%.py' or lower(path) like '%.pyi'").select("sha256").distinct()
    return tree.python_sites(table(spark, d, "source_texts").join(wanted, "sha256", "left_semi"))


QUERIES = {f.__name__: f for f in (current_symbols, degree_topk, degree_recount, callers_of_top, callers_limited, callees_from_top, edge_histogram, call_shape, call_components, call_circles, containment_left, file_rollup, folder_rollup, related_files, resolve_calls, enclosing_symbols, covered_lines, uncovered_lines, symbol_versions, file_mismatch, map_renames, invalidation, impact, work_queue, symbol_pages, repo_map, symbol_search, symbol_fuzzy, line_grep, line_counts, path_classes, prefix_files, file_states, read_coverage, same_content, map_digest, key_violations, name_labels, file_top_symbols, python_symbols, python_sites)}

from graphloom.plans.code_sql import SQL  # noqa: E402, F401
