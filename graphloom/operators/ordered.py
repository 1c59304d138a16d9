"""Operators on rows in an order, for groups of any size: rows are range-partitioned by group and order, so a group larger
than a partition continues in the next, and only one row per partition passes between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from graphloom.session import materialize


def _placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df range-partitioned and sorted by keys and order, written with the partition (_part) and place (_at) of each row.

    Both are taken in the task that sorts, so they hold however the written files are split on reading.
    """
    sorted_ = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return materialize(sorted_.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], suffix: str = "_before") -> DataFrame:
    """df with columns `<column><suffix>` of the row before in the group of keys by order (null at the first).

    Order must be total for the result to be defined: rows alike in keys and order stand in any order. Null keys form
    groups. Groups may be of any size. The task that sorts a range of rows also shifts it; only the first row of each range
    has its predecessor elsewhere, and gets it afterwards from the last rows of the ranges, one per partition.
    """
    held = list(dict.fromkeys([*keys, *columns]))
    shifted = [StructField(f"_shifted_{c}", df.schema[c].dataType) for c in columns]
    schema = StructType([*df.schema.fields, *shifted, StructField("_part", IntegerType()), StructField("_first", BooleanType()), StructField("_last", BooleanType())])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before: pa.Table | None = None
        waiting: pa.Table | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if waiting is not None:
                yield from waiting.to_batches()
            t = pa.Table.from_batches([batch])
            now = {c: t[c].combine_chunks() for c in held}
            head = {c: pa.nulls(1, now[c].type) if before is None else before[c].combine_chunks() for c in held}
            old = {c: pa.concat_arrays([head[c], now[c].slice(0, n - 1)]) for c in held}
            same = pa.array([before is not None] + [True] * (n - 1))
            for k in keys:
                alike = pc.or_(pc.fill_null(pc.equal(old[k], now[k]), False), pc.and_(pc.is_null(old[k]), pc.is_null(now[k])))
                same = pc.and_(same, alike)
            for c in columns:
                t = t.append_column(f"_shifted_{c}", pc.if_else(same, old[c], pa.scalar(None, old[c].type)))
            t = t.append_column("_part", pa.array([part] * n, pa.int32()))
            t = t.append_column("_first", pa.array([before is None] + [False] * (n - 1)))
            before = t.slice(n - 1)
            waiting = t.append_column("_last", pa.array([False] * n))
        if waiting is not None:  # only the last row of all is the range's last
            n = waiting.num_rows
            yield from waiting.set_column(waiting.num_columns - 1, "_last", pa.array([False] * (n - 1) + [True])).to_batches()

    placed = materialize(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(shift, schema))
    # the ranges' last rows, each moved on to the next range that has rows
    ranges = Window.orderBy("_part")
    lasts = placed.where("_last").select("_part", F.struct(*held).alias("_end"))
    carried = lasts.select("_part", F.lag("_end").over(ranges).alias("_end")).where("_end is not null").withColumn("_first", F.lit(True))
    same = F.col("_end").isNotNull()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_end.{k}"))
    joined = placed.join(F.broadcast(carried), ["_part", "_first"], "left")
    return joined.select(*df.columns, *[F.when(same, F.col(f"_end.{c}")).otherwise(F.col(f"_shifted_{c}")).alias(c + suffix) for c in columns])


def with_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with the place of each row over all rows by order, from 1. No row passes through one task: each partition counts
    its rows, and the counts of those before (one number per partition) are added."""
    placed = _placed(df, [], order)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_at") - F.col("_low") + F.col("_start") + 1).cast("long").alias(name))


def page(ranked: DataFrame, offset: int, limit: int, name: str = "rank") -> DataFrame:
    """Rows offset + 1 to offset + limit of a ranked frame, with next_offset (null on the last page)."""
    if offset < 0 or not 1 <= limit <= 500:
        raise ValueError("offset must be at least 0 and limit from 1 to 500")
    rows = ranked.where((F.col(name) > offset) & (F.col(name) <= offset + limit + 1))
    more = rows.where(F.col(name) == offset + limit + 1).agg(F.count("*").alias("_more"))
    kept = rows.where(F.col(name) <= offset + limit)
    return kept.crossJoin(F.broadcast(more)).withColumn("next_offset", F.when(F.col("_more") > 0, F.lit(offset + limit).cast("long"))).drop("_more")


def _fold(keys: list[str], cost: str, budget: int, exact: bool):
    """Streams rows sorted by group and order. exact: keeps what is taken. Otherwise the rows are but some of a group's, and
    what may be taken is kept: with at most m left, a row dearer than m can't be, and after one of cost c there are at
    most m - c left if it was taken, and at most c - 1 if it wasn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, budget
        for batch in batches:
            groups = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            prices = batch.column(cost).to_pylist()
            keep = []
            for i, price in enumerate(prices):
                if groups[i] != at:
                    at, left = groups[i], budget
                if price <= left:
                    keep.append(i)
                    left = left - price if exact else max(left - price, price - 1)
            if keep:
                yield batch.take(pa.array(keep, pa.int64()))

    return run


def within_budget(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """The rows of each group that are taken in order while they fit into budget; one that doesn't fit is skipped and
    later, smaller ones may still be taken. Null costs and those below 1 count as 0 and always fit. Costs are integers.

    Each partition first drops, without a shuffle, the rows that can't be taken whatever the others hold; at most `budget`
    rows of a group are left of it, mostly some budget / cost. Only these pass the shuffle and are folded in order, so neither
    a hot group nor the whole table passes through one task.
    """
    free = df.where(F.coalesce(F.col(cost), F.lit(0)) <= 0)
    dear = df.where((F.col(cost) > 0) & (F.col(cost) <= budget))
    thin = lambda rows, exact: rows.sortWithinPartitions(*keys, *order).mapInArrow(_fold(keys, cost, budget, exact), df.schema)
    few = thin(dear, False)
    last = few.repartition(*keys) if keys else few.coalesce(1)
    return thin(last, True).unionByName(free)
