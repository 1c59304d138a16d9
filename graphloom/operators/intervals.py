"""Closed integer intervals: union, gaps and enclosing intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, keys: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Disjoint intervals per group that cover the same numbers; neighbours (start = end + 1) are joined. Intervals with a
    null bound or an end before their start are left out. Equal intervals are one before the sort."""
    good = df.where(F.col(start) <= F.col(end)).groupBy(*keys, F.col(start).alias("_s")).agg(F.max(end).alias("_e"))
    w = Window.partitionBy(*keys).orderBy("_s")
    before = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = good.withColumn("_new", (before.isNull() | (F.col("_s") > before + 1)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("_s").alias(start), F.max("_e").alias(end)).drop("_run")


def gaps(df: DataFrame, keys: list[str], low: str, high: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """What the intervals leave uncovered from low to high (columns, alike within a group): gap_start, gap_end."""
    m = merged(df, keys, start, end).join(df.groupBy(*keys).agg(F.min(low).alias("_low"), F.max(high).alias("_high")), keys)
    m = m.where((F.col(end) >= F.col("_low")) & (F.col(start) <= F.col("_high")))
    w = Window.partitionBy(*keys).orderBy(start)
    first = F.lag(end).over(w)
    inner = m.select(*keys, (F.coalesce(first + 1, F.col("_low"))).alias("gap_start"), (F.col(start) - 1).alias("gap_end"))
    tail = m.groupBy(*keys).agg((F.max(end) + 1).alias("gap_start"), F.max("_high").alias("gap_end"))
    return inner.unionByName(tail).where("gap_start <= gap_end")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str = "start_line", end: str = "end_line", cell: int = 64) -> DataFrame:
    """points joined with the spans of their group that contain them, keeping the one that starts last (then ends first,
    then has the least id). spans: keys, id, start, end. points: keys, point_id, at. Points in no span are left out.

    Both sides are cut into cells of `cell` numbers, so the join is an equality on group and cell.
    """
    cells = F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))
    good = spans.where(F.col(start) <= F.col(end)).select(*keys, "id", start, end, F.explode(cells).alias("_cell"))
    placed = points.where(F.col(at).isNotNull()).withColumn("_cell", F.floor(F.col(at) / cell))
    hits = placed.join(good, [*keys, "_cell"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)))
    best = F.min(F.struct((-F.col(start)).alias("s"), F.col(end).alias("e"), F.col("id").alias("id"))).alias("b")
    return hits.groupBy("point_id").agg(best).select("point_id", F.col("b.id").alias("span_id"))
