"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize, small

#: So many of the most frequent missing keys are joined by broadcast when all missing keys are too many for it; every
#: other key then holds less than one row in a thousand, which a shuffled join spreads evenly.
HOT_KEYS = 1000


def missing_keys(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The distinct non-null values of references (one column, ref_id) absent from parents (one column, id), with n, the
    number of referring rows.

    Values are compared exactly. The references are reduced to distinct keys before the shuffle, so a key that many
    rows share is one row in the anti-join. No parents: every key is missing. No references: no rows.
    """
    keys = references.where("ref_id is not null").groupBy("ref_id").agg(F.count("*").alias("n"))
    return keys.join(parents.select(F.col("id").alias("ref_id")), "ref_id", "left_anti")


def join_back(references: DataFrame, missing: DataFrame, on: list[str]) -> DataFrame:
    """The rows of references whose columns `on` are among those of missing (which has n beside them).

    missing is written first and measured. If its rows and bytes allow it, it is broadcast and references isn't shuffled;
    else only its HOT_KEYS most frequent keys are, and the rest is joined by shuffle.
    """
    missing = materialize(missing, measured=True)
    if small(missing):
        return references.join(F.broadcast(missing.select(*on)), on, "left_semi")
    hot = materialize(missing.orderBy(F.desc("n"), *on).limit(HOT_KEYS)).select(*on)
    rest = missing.select(*on).join(F.broadcast(hot), on, "left_anti")
    return references.join(F.broadcast(hot), on, "left_semi").unionByName(
        references.join(F.broadcast(hot), on, "left_anti").join(rest.hint("merge"), on, "left_semi")
    )


def orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of references whose ref_id is non-null and absent from parents.id. See missing_keys and join_back."""
    return join_back(references, missing_keys(references.select("ref_id"), parents), ["ref_id"])


def orphan_counts(found: DataFrame, by: list[str]) -> DataFrame:
    """Rows and distinct missing keys of orphans per table, field and period."""
    return found.groupBy(*by).agg(F.count("*").alias("n_orphans"), F.countDistinct("ref_id").alias("n_missing_keys"))


def code_graph_orphans(nodes: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Orphan references of the code graph: table_name, field_name, record_id, ref_id, happened_at.

    nodes.file_id is taken from each node's current row (latest updated_at, null being the oldest) and must be a
    files.id; edges.src_id must be a nodes.id or files.id; edges.dst_id must be a nodes.id, where a placeholder
    (`name:` at its start) counts as a reference only if confidence isn't `unresolved`. Records count as existing
    whichever of their rows is current. Repeated edges are one. Null references are none.
    """
    from graphloom.operators.latest import latest_per_key

    node_ids, file_ids = nodes.select("id"), files.select("id")
    current = latest_per_key(nodes, ["id"], ["updated_at"], ["file_id"])
    of_nodes = current.select(F.lit("nodes").alias("table_name"), F.lit("file_id").alias("field_name"), F.col("id").alias("record_id"), F.col("file_id").alias("ref_id"), F.to_timestamp("updated_at").cast("timestamp_ntz").alias("happened_at"))
    unresolved = F.col("dst_id").startswith("name:") & F.col("confidence").eqNullSafe("unresolved")
    pairs = edges.select(
        F.col("edge_id"),
        F.col("recorded_at").alias("happened_at"),
        F.inline(F.array(F.struct(F.lit("src_id").alias("field_name"), F.col("src_id").alias("ref_id")), F.struct(F.lit("dst_id").alias("field_name"), F.when(~F.coalesce(unresolved, F.lit(False)), F.col("dst_id")).alias("ref_id")))),
    ).where("ref_id is not null")
    keys = pairs.groupBy("field_name", "ref_id").agg(F.count("*").alias("n"))
    not_nodes = keys.join(node_ids.select(F.col("id").alias("ref_id")), "ref_id", "left_anti")
    as_src = F.when(F.col("field_name") == "src_id", F.col("ref_id"))
    missing = not_nodes.join(file_ids.select(F.col("id").alias("_file")), as_src == F.col("_file"), "left_anti")
    of_edges = join_back(pairs, missing.select("field_name", "ref_id", "n"), ["field_name", "ref_id"])
    of_edges = of_edges.groupBy("edge_id", "field_name", "ref_id").agg(F.min("happened_at").alias("happened_at"))
    of_edges = of_edges.select(F.lit("edges").alias("table_name"), "field_name", F.col("edge_id").cast("string").alias("record_id"), "ref_id", "happened_at")
    return orphans(of_nodes, file_ids).select(*of_edges.columns).unionByName(of_edges)
