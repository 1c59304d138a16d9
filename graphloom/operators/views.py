"""Reports, overlays and guarded reads on record tables: what one reads of a graph rather than what it is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import changes
from graphloom.operators.text import LINE_END
from graphloom.session import hinted, materialize, weight

#: Bytes up to which a guarded read gives a text.
READ_BYTES = 2 << 20

# ---------------------------------------------------------------- columns


def shortened(c: str, most: int = 240) -> Column:
    """An identity for logs: values longer than `most` characters by their digest. Null stays null."""
    return F.when(F.length(c) > most, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(F.col(c))


def bounded_text(c: str, most: int = 360) -> Column:
    """text (the first `most` characters) and truncated."""
    return F.struct(F.substring(c, 1, most).alias("text"), F.coalesce(F.length(c) > most, F.lit(False)).alias("truncated"))


def cursor(*columns: str) -> Column:
    """An opaque place in a list: the columns as JSON in base64 for addresses, without padding."""
    return F.translate(F.base64(F.encode(F.to_json(F.struct(*columns)), "UTF-8")), "+/=", "-_")


def cursor_fields(c: str, ddl: str) -> Column:
    """What cursor() made of columns of these types; null for anything else."""
    return F.from_json(F.expr(f"try_to_binary(translate(rpad({c}, cast(ceil(length({c}) / 4.0) * 4 as int), '='), '-_', '+/'), 'base64')").cast("string"), ddl)


def failure_kind(message: str, words: dict[str, list[str]]) -> Column:
    """The first kind of words one of whose words occurs in a message, whatever the case; `other`, and null for null."""
    out = F.when(F.col(message).isNull(), F.lit(None).cast("string"))
    for kind, some in words.items():
        hit = F.lit(False)
        for w in some:
            hit = hit | F.contains(F.lower(message), F.lit(w.lower()))
        out = out.when(hit, kind)
    return out.otherwise("other")


# ---------------------------------------------------------------- sets


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one of two frames alone, with side (`left`, `right`)."""
    both = a.select("*", F.lit(1).alias("_s")).unionByName(b.select("*", F.lit(2).alias("_s")))
    once = both.groupBy(*a.columns).agg(F.min("_s").alias("_a"), F.max("_s").alias("_b"))
    return once.where("_a = _b").select(*a.columns, F.when(F.col("_a") == 1, "left").otherwise("right").alias("side"))


def set_changes(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The keys whose sets of values (rows of the columns) differ between two frames: key, n_lost and n_won. The sets
    themselves are never gathered."""
    apart = symmetric_difference(before.select(key, *values), after.select(key, *values))
    tell = lambda side: F.sum((F.col("side") == side).cast("long"))
    return apart.groupBy(key).agg(tell("left").alias("n_lost"), tell("right").alias("n_won"))


def neighbourhood(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """matched (id) and all one edge (src, dst) away from them, once each: id, is_match. Two joins by equality, none by `or`."""
    ids = matched.where("id is not null").select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    into = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    rows = ids.withColumn("is_match", F.lit(True)).unionByName(out.unionByName(into).where("id is not null").withColumn("is_match", F.lit(False)))
    return rows.groupBy("id").agg(F.max("is_match").alias("is_match"))


def without_retired(df: DataFrame, key: str, field: str, gone: DataFrame) -> DataFrame:
    """df (key, field: an array of ids) with the ids of gone (id) taken out of the field, and stale: whether any was. Rows
    whose array is null or empty stay as they are. The ids are joined as rows, so gone may be of any size."""
    parts = df.select(key, F.posexplode(field).alias("_k", "id")).join(gone.select("id", F.lit(True).alias("_gone")).distinct(), "id", "left")
    kept = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_gone").isNull(), F.struct("_k", "id")))).alias("_l"), F.max(F.col("_gone").isNotNull()).alias("stale"))
    new = kept.select(key, F.transform("_l", lambda x: x["id"]).alias("_new"), "stale")
    return df.join(new, key, "left").select(key, F.coalesce("_new", field).alias(field), F.coalesce("stale", F.lit(False)).alias("stale"))


def slots(saved: DataFrame, keys: DataFrame) -> DataFrame:
    """A number for every key (id): saved ones (id, slot) are kept, new ones get, in order of id, the lowest numbers from 0
    that no saved one has."""
    from graphloom.operators.ordered import with_rank

    held = saved.where("id is not null").groupBy("id").agg(F.min("slot").alias("slot"))
    new = with_rank(keys.select("id").where("id is not null").distinct().join(held.select("id"), "id", "left_anti"), ["id"], "_k")
    # the k-th free number is k - 1 plus the taken ones below it: of those sorted, the j-th (from 0) has slot - j free ones before
    taken = with_rank(held.select("slot").distinct(), ["slot"], "_j").select((F.col("slot") - F.col("_j") + 1).alias("_free"), "_j")
    steps = taken.groupBy("_free").agg(F.max("_j").alias("_j")).unionByName(keys.sparkSession.createDataFrame([(0, 0)], "_free long, _j long"))
    marks = new.select("id", F.col("_k").alias("_at"), F.lit(None).cast("long").alias("_j")).unionByName(steps.select(F.lit(None).cast("string").alias("id"), (F.col("_free") + 1).alias("_at"), "_j"))
    run = Window.orderBy("_at", F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.select("id", "_at", F.max("_j").over(run).alias("_below")).where("id is not null")
    return held.unionByName(placed.select("id", (F.col("_at") - 1 + F.col("_below")).alias("slot")))


# ---------------------------------------------------------------- joins


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], start: str = "start_line", end: str = "end_line", cell: int = 64) -> DataFrame:
    """Pairs (a_id, b_id) of intervals (keys, id, start, end) of a group that have a number in common, once each. Both sides are
    cut into cells, so the join is by equality; a pair is made in the first cell that both touch. Null bounds match nothing."""

    def cut(df: DataFrame, mark: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))
        return df.where(F.col(start) <= F.col(end)).select(*keys, F.col("id").alias(f"{mark}_id"), F.col(start).alias(f"_{mark}s"), F.col(end).alias(f"_{mark}e"), F.explode(cells).alias("_cell"))

    pairs = cut(a, "a").join(cut(b, "b"), [*keys, "_cell"])
    first = F.col("_cell") == F.floor(F.greatest("_as", "_bs") / cell)
    return pairs.where(first & (F.col("_as") <= F.col("_be")) & (F.col("_bs") <= F.col("_ae"))).select("a_id", "b_id")


def nearest(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """id and ancestor: the nearest ancestor of each node (id, parent_id, kind) that is of one of the kinds; null if there is
    none, also on and below circles without one. Each round doubles the levels that are skipped."""
    parents = nodes.select(F.col("id").alias("to"), F.col("kind").isin(kinds).alias("_hit"))
    step = nodes.where("id is not null").select("id", F.col("parent_id").alias("to")).join(parents, "to", "left")
    hit = F.coalesce("_hit", F.lit(False))
    state = materialize(step.select("id", F.when(hit, F.col("to")).alias("ancestor"), F.when(~hit & F.col("_hit").isNotNull(), F.col("to")).alias("to")), measured=True)
    rows, span = weight(state)[0], 1
    while span <= rows and not state.where("to is not null").isEmpty():
        on = state.select(F.col("id").alias("to"), F.col("ancestor").alias("_a"), F.col("to").alias("_t"))
        state = materialize(state.join(on, "to", "left").select("id", F.coalesce("ancestor", "_a").alias("ancestor"), F.when(F.col("ancestor").isNull() & F.col("_a").isNull(), F.col("_t")).alias("to")))
        span *= 2
    return state.select("id", "ancestor")


def labelled(edges: DataFrame, nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """edges (edge_id, src, dst) with label `owner.name → owner.name`: nodes: id, owner_id, name; owners: id, name. What is not
    known stands by its id."""
    named = nodes.join(owners.select(F.col("id").alias("owner_id"), F.col("name").alias("_o")), "owner_id", "left").select("id", F.concat_ws(".", "_o", "name").alias("_l"))
    a, b = named.select(F.col("id").alias("src"), F.col("_l").alias("_from")), named.select(F.col("id").alias("dst"), F.col("_l").alias("_to"))
    return edges.join(a, "src", "left").join(b, "dst", "left").select("edge_id", F.concat(F.coalesce("_from", "src"), F.lit(" → "), F.coalesce("_to", "dst")).alias("label"))


def with_freshness(rows: DataFrame, key: str, stale: DataFrame) -> DataFrame:
    """rows with freshness: `stale` where the key is among those of stale (id), else `current`. Nothing is written."""
    marks = stale.select(F.col("id").alias(key), F.lit("stale").alias("freshness")).distinct()
    return rows.join(marks, key, "left").withColumn("freshness", F.coalesce("freshness", F.lit("current")))


# ---------------------------------------------------------------- guarded reads


def verified_texts(sources: DataFrame, texts: DataFrame) -> DataFrame:
    """sources (id, sha256) with the text (texts: sha256, content) whose bytes have that hash: id, state, content. state: `read`;
    `absent` without a text, `too_large` beyond READ_BYTES, `changed` if the bytes have another hash. Only `read` has content,
    so a text is never put in another's place."""
    n, same = F.octet_length("content"), F.sha2("content", 256) == F.lower("sha256")
    joined = sources.select("id", "sha256").join(texts.select("sha256", "content"), "sha256", "left")
    state = F.when(F.col("content").isNull(), "absent").when(n > READ_BYTES, "too_large").when(~same, "changed").otherwise("read")
    return joined.select("id", state.alias("state"), F.when(state == "read", F.col("content")).alias("content"))


def span_texts(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """The lines of spans (id, key, start_line, end_line, sha of the lines or null) in texts (key, content): id, n_chars, state
    (`read`, `changed` if sha differs, `outside` if the text ends before). Lines are joined by newlines."""
    cut = F.split("content", LINE_END)
    body = F.array_join(F.slice(cut, F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    rows = spans.where("start_line >= 1 and end_line >= start_line").join(texts, "key").select("id", "sha", body.alias("_b"), (F.size(cut) < F.col("end_line")).alias("_out"))
    state = F.when(F.col("_out"), "outside").when(F.col("sha").isNotNull() & (F.sha2("_b", 256) != F.col("sha")), "changed").otherwise("read")
    return rows.select("id", F.length("_b").alias("n_chars"), state.alias("state"))


def file_documents(nodes: DataFrame) -> DataFrame:
    """Per file_id its symbols (id, start_line) as one array in order of line and id: a document as the parser gave it."""
    return nodes.where("file_id is not null").groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id"))), lambda x: x["id"]).alias("symbols"))


# ---------------------------------------------------------------- reports


def completion(sources: DataFrame, by: str) -> DataFrame:
    """How far the reading of each group has come, from its sources (included, read_state, symbols_complete): the first of
    `inventory_incomplete` (a source neither in- nor excluded), `partial` (an included one unread),
    `coverage_with_unresolved_relations` (one whose symbols aren't complete) that holds, else `complete`; with counts."""
    inside = F.coalesce("included", F.lit(False))
    unread = inside & ~F.col("read_state").eqNullSafe("read")
    open_ = inside & ~F.coalesce("symbols_complete", F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    got = sources.groupBy(by).agg(n(F.col("included").isNull()).alias("n_undecided"), n(unread).alias("n_outstanding"), n(open_).alias("n_incomplete"), n(~inside & F.col("included").isNotNull()).alias("n_excluded"))
    status = F.when(F.col("n_undecided") > 0, "inventory_incomplete").when(F.col("n_outstanding") > 0, "partial").when(F.col("n_incomplete") > 0, "coverage_with_unresolved_relations").otherwise("complete")
    return got.withColumn("status", status)


def issues(violations: DataFrame, most: int = 40) -> DataFrame:
    """violations (rule, record_id): the first `most` of each rule by record_id, with n, the number of all of the rule."""
    w = Window.partitionBy("rule").orderBy("record_id")
    counts = violations.groupBy("rule").agg(F.count("*").alias("n"))
    return violations.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k").join(hinted(materialize(counts, measured=True)), "rule")


def ready(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """The queued tasks (id, state) all of whose needs (id, needs_id) are done; needs that are no tasks are never done."""
    done = tasks.where("state = 'done'").select(F.col("id").alias("needs_id"))
    blocked = needs.where("needs_id is not null").join(done, "needs_id", "left_anti").select("id").distinct()
    return tasks.where("state = 'queued'").join(blocked, "id", "left_anti")


def scope_report(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Per root of a hierarchy what lies below it: roots: id, root_id; links: src, dst. root_id, n_nodes, n_links (from a node
    below it), n_leaving (to a node below another root) and n_open (to what is below none)."""
    below = roots.where("root_id is not null").select("id", "root_id")
    sized = below.groupBy("root_id").agg(F.count("*").alias("n_nodes"))
    pairs = links.groupBy("src", "dst").agg(F.count("*").alias("_n"))  # parallel links are one row in the joins
    both = pairs.join(below.select(F.col("id").alias("src"), "root_id"), "src").join(below.select(F.col("id").alias("dst"), F.col("root_id").alias("_to")), "dst", "left")
    n = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    counted = both.groupBy("root_id").agg(F.sum("_n").alias("n_links"), n(F.col("_to") != F.col("root_id")).alias("n_leaving"), n(F.col("_to").isNull()).alias("n_open"))
    return sized.join(counted, "root_id", "left").select("root_id", "n_nodes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_leaving", "n_open")])


# ---------------------------------------------------------------- sync


def sync_plan(known: DataFrame, found: DataFrame, old: DataFrame, new: DataFrame, calls: DataFrame, fields: list[str]) -> DataFrame:
    """What one round of keeping a code graph up to date does, as rows of stage, id and action.

    `reconcile`: files found (id, sha256) are reused where known (id, sha256, state) has them alike and parsed or partial, else
    parsed; those not found are dropped. `persist`: symbols (id, fields) added, deleted or modified from old to new.
    `invalidate`: of new, symbols with another body_sha are stale, their direct callers (calls: src, dst) suspect.
    `enqueue`: stale and suspect symbols that are still there.
    """
    held = known.select("id", F.col("sha256").alias("_sha"), F.col("state").isin("parsed", "partial").alias("_ok"), F.lit(True).alias("_known"))
    both = found.select("id", "sha256", F.lit(True).alias("_found")).join(held, "id", "full_outer")
    act = F.when(F.col("_found").isNull(), "drop").when(F.col("_ok") & F.col("sha256").eqNullSafe(F.col("_sha")), "reuse").otherwise("parse")
    reconcile = both.select(F.lit("reconcile").alias("stage"), "id", act.alias("action"))
    delta = materialize(changes.compare(old, new, ["id"], sorted({*fields, "body_sha"})))
    persist = delta.select(F.lit("persist").alias("stage"), "id", F.col("change").alias("action"))
    bodies = delta.where(F.col("change") == "modified").where(F.array_contains("changed_fields", "body_sha")).select("id")
    marked = materialize(changes.invalidated(materialize(bodies), calls))
    invalidate = marked.select(F.lit("invalidate").alias("stage"), "id", F.col("status").alias("action"))
    enqueue = marked.join(new.select("id"), "id", "left_semi").select(F.lit("enqueue").alias("stage"), "id", F.lit("queued").alias("action"))
    return reconcile.unionByName(persist).unionByName(invalidate).unionByName(enqueue)
