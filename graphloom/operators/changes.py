"""Comparing versions of tables: field diffs, renames, classes of change, and what they invalidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differing(fields: list[str], old: str, new: str) -> Column:
    """The sorted names of the fields that differ between two structs, nulls being equal."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")), F.lit(f)) for f in sorted(fields)]))


def compare(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, change (`added`, `deleted`, `modified`) and changed_fields between two versions with unique keys."""
    a = old.select(*keys, F.struct(*fields).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.struct(*fields).alias("_new"), F.lit(True).alias("_in_new"))
    j = a.join(b, keys, "full_outer").withColumn("changed_fields", differing(fields, "_old", "_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(F.size("changed_fields") > 0, "modified")
    kept = F.when(F.col("_in_old") & F.col("_in_new"), F.col("changed_fields")).otherwise(F.array().cast("array<string>"))
    return j.select(*keys, change.alias("change"), kept.alias("changed_fields")).where("change is not null")


def exact_renames(deleted: DataFrame, added: DataFrame, group: list[str]) -> DataFrame:
    """group, from_path, to_path: deleted and added files (group, path, sha256) of the same content, where the content is
    the only such one on either side; copies are not guessed. Null hashes match nothing."""
    def single(df: DataFrame, name: str) -> DataFrame:
        return df.where("sha256 is not null").groupBy(*group, "sha256").agg(F.count("*").alias("n"), F.min("path").alias(name)).where("n = 1").drop("n")

    return single(deleted, "from_path").join(single(added, "to_path"), [*group, "sha256"]).select(*group, "from_path", "to_path")


def version_changes(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """What changed between the first and the current version of records of which several rows exist: key, n_versions,
    changed_fields. The first and the last are the least and the greatest by order (null first), then by fields."""
    named = F.struct(order, *fields)
    both = rows.groupBy(key).agg(F.countDistinct(named).alias("n_versions"), F.min(named).alias("_old"), F.max(named).alias("_new"))
    return both.where("n_versions > 1").select(key, "n_versions", differing(fields, "_old", "_new").alias("changed_fields"))


def invalidated(changed: DataFrame, edges: DataFrame, resolution_changed: DataFrame | None = None) -> DataFrame:
    """id and status: changed nodes (id) are `stale`, those that call them directly (edges src -> dst) or whose calls are
    resolved otherwise `suspect` unless stale. Never more than one hop."""
    ids = changed.where("id is not null").select("id").distinct()
    callers = edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    if resolution_changed is not None:
        callers = callers.unionByName(resolution_changed.select("id"))
    suspects = callers.where("id is not null").distinct().join(ids, "id", "left_anti")
    return ids.withColumn("status", F.lit("stale")).unionByName(suspects.withColumn("status", F.lit("suspect")))


def change_class(old: str = "old", new: str = "new") -> Column:
    """`cosmetic`, `contract` or `implementation` from structs of the digests syntax_sha, contract_sha and semantic_sha."""
    same = lambda f: F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}"))
    return F.when(same("syntax_sha") & same("contract_sha") & same("semantic_sha"), "none").when(same("semantic_sha"), "cosmetic").when(~same("contract_sha"), "contract").otherwise("implementation")


def rematched(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id and new_id of symbols that are the same: first of equal kind, qualified_name and signature, the k-th with the
    k-th in order of start_line and id; of the rest, those of equal kind, qualified_name and semantic_sha where there is one
    on each side. Frames: file_id, id, kind, qualified_name, signature, start_line, semantic_sha."""
    from pyspark.sql import Window

    keys = ["file_id", "kind", "qualified_name", "signature"]
    w = Window.partitionBy(*keys).orderBy("start_line", "id")
    number = lambda df, name: df.withColumn("_k", F.row_number().over(w)).select(*keys, "_k", F.col("id").alias(name))
    a, b = number(old, "old_id").alias("a"), number(new, "new_id").alias("b")
    first = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_k"]]).select("old_id", "new_id")
    rest_old = old.join(first.select(F.col("old_id").alias("id")), "id", "left_anti")
    rest_new = new.join(first.select(F.col("new_id").alias("id")), "id", "left_anti")
    by = ["file_id", "kind", "qualified_name", "semantic_sha"]
    single = lambda df, name: df.where("semantic_sha is not null").groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    return first.unionByName(single(rest_old, "old_id").join(single(rest_new, "new_id"), by).select("old_id", "new_id"))
