"""Percentiles of very large numeric columns from mergeable summaries with bounded rank error."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values in a buffer. A summary of n > SIZE values is off by at most log2(n / SIZE) / (2 * SIZE) of n ranks.
SIZE = 4096
#: Values a worker holds before it hands on what it has.
HELD = 3_000_000
#: Summaries of a key are merged in so many parts before the last merge.
PARTS = 16


class Summary:
    """Sorted buffers of SIZE values, at most one of each weight 1, 2, 4 ..., and fewer than SIZE loose values.

    Two buffers of a weight collapse into one of twice the weight by taking every other value of their merged order, so
    buffers form a binary tree. Each collapse into weight w moves any rank by at most w / 2; `error` sums that up.
    The start of the selection alternates, so nothing depends on chance.
    """

    __slots__ = ("size", "n", "error", "loose", "buffers", "turn")

    def __init__(self, size: int = SIZE):
        self.size, self.n, self.error, self.turn = size, 0, 0.0, 0
        self.loose: list[np.ndarray] = []
        self.buffers: dict[int, np.ndarray] = {}

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._take(values)

    def _take(self, values: np.ndarray) -> None:
        self.loose.append(values)
        if sum(map(len, self.loose)) >= self.size:
            joint = np.concatenate(self.loose)
            whole = len(joint) // self.size * self.size
            for start in range(0, whole, self.size):
                self._place(np.sort(joint[start : start + self.size]), 1)
            self.loose = [joint[whole:]]

    def _place(self, buffer: np.ndarray, weight: int) -> None:
        while (other := self.buffers.pop(weight, None)) is not None:
            joint = np.sort(np.concatenate([buffer, other]), kind="stable")
            buffer = joint[self.turn :: 2]
            self.turn ^= 1
            weight *= 2
            self.error += weight / 2
        self.buffers[weight] = buffer

    def merge(self, n: int, error: float, loose: np.ndarray, buffers: dict[int, np.ndarray]) -> None:
        self.n += n
        self.error += error
        for weight in sorted(buffers):
            self._place(buffers[weight], weight)
        self._take(loose)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [(b, w) for w, b in self.buffers.items()] + [(x, 1) for x in self.loose]
        values = np.concatenate([b for b, _ in parts]) if parts else np.zeros(0)
        weights = np.concatenate([np.full(len(b), w, dtype=np.int64) for b, w in parts]) if parts else np.zeros(0, np.int64)
        return values, weights

    def at(self, shares: list[float]) -> list[float]:
        """The value at rank ceil(share * n) of each share."""
        values, weights = self.flat()
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        return [float(values[order[min(int(np.searchsorted(ranks, max(1, math.ceil(q * self.n - 1e-9)))), len(values) - 1)]]) for q in shares]


def _partial(keys: list[str], value: str, size: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, summaries = TaskContext.get().partitionId() % PARTS, 0, {}
        got: list[pa.RecordBatch] = []

        def take() -> None:
            t = pa.Table.from_batches(got)
            codes = [t[k].combine_chunks().dictionary_encode("encode") for k in keys]
            order = np.lexsort([c.indices.to_numpy(zero_copy_only=False) for c in reversed(codes)])
            at = np.stack([c.indices.to_numpy(zero_copy_only=False)[order] for c in codes])
            values = t[value].to_numpy()[order].astype(np.float64)
            ends = np.flatnonzero(np.any(at[:, 1:] != at[:, :-1], axis=0)) + 1
            words = [c.dictionary.to_pylist() for c in codes]
            for a, b in zip([0, *ends], [*ends, len(values)]):
                key = tuple(w[i] for w, i in zip(words, at[:, a]))
                if key not in summaries:
                    summaries[key] = Summary(size)
                summaries[key].add(values[a:b])

        for batch in batches:
            if batch.num_rows:
                got.append(batch)
                held += batch.num_rows
            if sum(b.num_rows for b in got) >= 400_000:
                take()
                got = []
            if held >= HELD:
                if got:
                    take()
                    got = []
                yield from _rows(summaries, part, keys, schema)
                held, summaries = 0, {}
        if got:
            take()
        yield from _rows(summaries, part, keys, schema)

    return run


def _rows(summaries: dict, part: int, keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    items = list(summaries.items())
    for start in range(0, len(items), 200):
        some = items[start : start + 200]
        columns: list[list] = [[k[i] for k, _ in some] for i in range(len(keys))]
        columns += [[part] * len(some), [s.n for _, s in some], [s.error for _, s in some]]
        columns.append([np.concatenate(s.loose) if s.loose else np.zeros(0) for _, s in some])
        columns.append([list(s.buffers) for _, s in some])
        columns.append([np.concatenate(list(s.buffers.values())) if s.buffers else np.zeros(0) for _, s in some])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _merged(keys: list[str], size: int, schema: pa.Schema):
    """Rows come sorted by keys; one summary is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, summary, done = None, None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            loose, weights, values = (batch.column(c) for c in ("loose", "weights", "buffered"))
            n, error = batch.column("n").to_pylist(), batch.column("error").to_pylist()
            for i, key in enumerate(zip(*columns)):
                if key != at or summary is None:
                    if summary is not None:
                        done.append((at, summary))
                    if len(done) >= 200:
                        yield from _rows(dict(done), 0, keys, schema)
                        done = []
                    at, summary = key, Summary(size)
                flat = np.asarray(values[i].values, dtype=np.float64)
                buffers = {w: flat[j * size : (j + 1) * size] for j, w in enumerate(weights[i].as_py())}
                summary.merge(n[i], error[i], np.asarray(loose[i].values, dtype=np.float64), buffers)
        if summary is not None:
            done.append((at, summary))
        yield from _rows(dict(done), 0, keys, schema)

    return run


def _schemas(df: DataFrame, keys: list[str]) -> tuple[str, pa.Schema]:
    kinds = dict(df.dtypes)
    ddl = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["part int, n long, error double, loose array<double>, weights array<long>, buffered array<double>"])
    arrow = {"string": pa.string(), "date": pa.date32(), "int": pa.int32(), "bigint": pa.int64()}
    return ddl, pa.schema([*[(k, arrow[kinds[k]]) for k in keys], ("part", pa.int32()), ("n", pa.int64()), ("error", pa.float64()), ("loose", pa.list_(pa.float64())), ("weights", pa.list_(pa.int64())), ("buffered", pa.list_(pa.float64()))])


def summarize(values: DataFrame, keys: list[str], value: str, size: int = SIZE) -> DataFrame:
    """One summary per key (string, date, int or long columns; null is a key of its own): keys, n, error and buffers.

    Null, NaN and negative values take no part. Each partition summarizes its own rows, so a key that holds most rows
    sends no more than a few buffers per partition; these are merged in PARTS parts, then once more.
    """
    usable = values.where((F.col(value) >= 0) & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias(value))
    ddl, schema = _schemas(usable, keys)
    partial = usable.mapInArrow(_partial(keys, value, size, schema), ddl)
    return combine(combine(partial, [*keys, "part"], size), keys, size)


def combine(summaries: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Merge summaries (of other partitions, days or runs) by some of their keys."""
    by = [k for k in keys if k != "part"]
    ddl, schema = _schemas(summaries, by)
    spread = summaries.repartition(*keys) if keys else summaries.coalesce(1)
    return spread.sortWithinPartitions(*keys).mapInArrow(_merged(by, size, schema), ddl) if keys else spread.mapInArrow(_merged(by, size, schema), ddl)


def percentiles(summaries: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """keys, n, a column per share (nearest rank: the value at rank ceil(share * n)) and max_rank_error, the ranks by
    which any of them may be off (0: exact)."""
    ddl, schema = _schemas(summaries, keys)
    out = pa.schema([*[schema.field(k) for k in keys], ("n", pa.int64()), *[(c, pa.float64()) for c in shares], ("max_rank_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                s = Summary(10**18)
                s.n = batch.column("n")[i].as_py()
                flat = np.asarray(batch.column("buffered")[i].values, dtype=np.float64)
                weights = batch.column("weights")[i].as_py()
                each = len(flat) // max(1, len(weights))
                s.buffers = {w: flat[j * each : (j + 1) * each] for j, w in enumerate(weights)}
                s.loose = [np.asarray(batch.column("loose")[i].values, dtype=np.float64)]
                rows.append(s.at(list(shares.values())))
            got = [pa.array([r[j] for r in rows], pa.float64()) for j in range(len(shares))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("n"), *got, batch.column("error")], schema=out)

    names = ", ".join([x for x in ddl.split(", ") if x.split(" ")[0] in keys] + ["n long", *[f"{c} double" for c in shares], "max_rank_error double"])
    return summaries.mapInArrow(run, names)


def weighted_values(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries as plain rows, which any engine can add up and combine: keys, value, weight (how many values it stands for)
    and max_rank_error of the summary. Equal values of a summary are one row. The value at rank k of a group is the least
    whose weight, with those of all lesser ones, reaches k."""
    size = F.coalesce(F.size("buffered") / F.nullif(F.size("weights"), F.lit(0)), F.lit(1)).cast("int")
    collapsed = F.transform("buffered", lambda x, i: F.struct(x.alias("value"), F.element_at("weights", (F.floor(i / size) + 1).cast("int")).alias("weight")))
    loose = F.transform("loose", lambda x: F.struct(x.alias("value"), F.lit(1).cast("long").alias("weight")))
    rows = summaries.select(*keys, F.col("error").alias("max_rank_error"), F.explode(F.concat(collapsed, loose)).alias("_v"))
    return rows.groupBy(*keys, "max_rank_error", "_v.value").agg(F.sum("_v.weight").alias("weight"))


def calls_once(calls: DataFrame) -> DataFrame:
    """tool, phase, day (of started, in UTC) and elapsed_ms of each call with a usable time, repeated ids once.

    Of rows of an id that differ, the one with the greatest elapsed_ms, then tool, phase and day counts. Rows without
    an id are calls of their own. A started that is null or no number gives a null day.
    """
    start = F.when(~F.isnan("started") & (F.abs("started") < 1e11), F.col("started"))
    usable = calls.where((F.col("elapsed_ms") >= 0) & ~F.isnan("elapsed_ms")).select(
        "id", F.when(F.col("id").isNull(), F.monotonically_increasing_id()).alias("_own"), F.struct("elapsed_ms", "tool", "phase", F.date_from_unix_date(F.floor(start / 86400).cast("int")).alias("day")).alias("_row")
    )
    return usable.groupBy("id", "_own").agg(F.max("_row").alias("_row")).select("_row.*")
