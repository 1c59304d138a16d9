"""Filling fixed-capacity containers with texts by a grouping genetic algorithm on islands."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import token_counts
from graphloom.session import materialize

#: Tokens a container holds.
CAPACITY = 2048
#: Items that are packed together, on average; a container holds items of one shard.
SHARD = 4096
#: Islands (populations of solutions) per shard, solutions per island, generations between migrations, migrations.
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 3, 6, 8, 4
#: Bins with room that are offered an exchange when items are packed again.
EXCHANGES = 16


def best_fit(sizes: np.ndarray, items: np.ndarray, bins: np.ndarray, fill: np.ndarray, capacity: int) -> np.ndarray:
    """Put items, in the given order, each into the fullest bin it fits in, else a new one. bins (item -> bin) and fill
    (bin -> used) of what is packed already; bins is changed, the longer fill returned."""
    room = sorted((capacity - int(u), b) for b, u in enumerate(fill) if 0 < u < capacity)
    used = list(map(int, fill))
    for i in items:
        s = int(sizes[i])
        k = bisect_left(room, (s, -1))
        if k < len(room):
            left, b = room.pop(k)
            left -= s
        else:
            left, b = capacity - s, len(used)
            used.append(0)
        bins[i] = b
        used[b] += s
        if left:
            insort(room, (left, b))
    return np.array(used, dtype=np.int64)


def tidy(sizes: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins numbered without gaps, and their fill."""
    _, bins = np.unique(bins, return_inverse=True)
    return bins, np.bincount(bins, weights=sizes).astype(np.int64)


def fitness(fill: np.ndarray, capacity: int) -> float:
    """The mean square of how full the bins are: fewer bins, and among as many, fuller ones, are better."""
    return float(np.mean((fill / capacity) ** 2)) if len(fill) else 1.0


def greedy(sizes: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    bins = np.full(len(sizes), -1, dtype=np.int64)
    return tidy(sizes, (best_fit(sizes, order, bins, np.zeros(0, np.int64), capacity), bins)[1])


def _exchange(have: list[int], room: int, pool: list[int]) -> tuple[list[int], list[int]] | None:
    """Which one or two of the sizes in a bin (places in have) to give for one or two of the pool (sorted; places in it), so
    that the bin becomes as full as can be, by at least one. None if no exchange fills it better."""
    best, found = 0, None
    for i, a in enumerate(have):
        k = bisect_right(pool, a + room) - 1
        if k >= 0 and pool[k] - a > best:
            best, found = pool[k] - a, ([i], [k])
        for j in range(i + 1, len(have)):
            pair = a + have[j]
            k = bisect_right(pool, pair + room) - 1
            if k >= 0 and pool[k] - pair > best:  # one for two
                best, found = pool[k] - pair, ([i, j], [k])
            low, high = 0, len(pool) - 1
            while low < high:
                total = pool[low] + pool[high]
                if total > pair + room:
                    high -= 1
                    continue
                if total - pair > best:
                    best, found = total - pair, ([i, j], [low, high])
                low += 1
            if best == room:
                return found
    return found


def exchanged(sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, out: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Before the items out (none of them in a bin) are packed again: up to EXCHANGES bins with room give one or two items
    for larger ones among them, so that what remains to be packed is smaller. bins and fill are changed; the items that are
    out then are returned."""
    pool = sorted((int(sizes[i]), int(i)) for i in out)
    for b in rng.permutation(np.flatnonzero((fill > 0) & (fill < capacity)))[:EXCHANGES]:
        members = np.flatnonzero(bins == b)
        have = [int(sizes[i]) for i in members]
        got = _exchange(have, capacity - int(fill[b]), [s for s, _ in pool])
        if got is None:
            continue
        give, take = got
        chosen = [pool[k] for k in take]
        for k in sorted(take, reverse=True):
            del pool[k]
        for k in give:
            bins[members[k]] = -1
            insort(pool, (have[k], int(members[k])))
        for s, i in chosen:
            bins[i] = b
        fill[b] += sum(s for s, _ in chosen) - sum(have[k] for k in give)
    return np.array([i for _, i in pool], dtype=np.int64)


def repack(sizes: np.ndarray, bins: np.ndarray, out: np.ndarray, capacity: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Take the items in the mask `out` out of their bins, exchange them for smaller ones where that fills a bin better, and
    best-fit what is out then, the longest first."""
    bins = bins.copy()
    bins[out] = -1
    kept = ~out
    if kept.any():
        bins[kept], fill = tidy(sizes[kept], bins[kept])
    else:
        fill = np.zeros(0, np.int64)
    displaced = exchanged(sizes, bins, fill, np.flatnonzero(out), capacity, rng)
    best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], bins, fill, capacity)
    return tidy(sizes, bins)


def crossover(sizes: np.ndarray, a: tuple, b: tuple, capacity: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Inject whole well-filled bins of b into a: a's bins that share items with them are dissolved, and their other
    items best-fitted."""
    (bins, fill), (other, other_fill) = a, b
    full = np.flatnonzero(other_fill >= np.median(other_fill))
    chosen = rng.permutation(full)[: max(1, len(full) // 3)]
    injected = np.isin(other, chosen)
    touched = np.isin(bins, bins[injected])
    joint = np.where(injected, other + len(fill), bins)
    return repack(sizes, joint, touched & ~injected, capacity, rng)


def mutate(sizes: np.ndarray, a: tuple, capacity: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Dissolve the emptiest bins and a few others."""
    bins, fill = a
    worst = np.argsort(fill, kind="stable")[: max(1, len(fill) // 50)]
    some = rng.integers(0, len(fill), max(1, len(fill) // 50))
    return repack(sizes, bins, np.isin(bins, np.concatenate([worst, some])), capacity, rng)


def evolve(sizes: np.ndarray, population: list[tuple], capacity: int, rng: np.random.Generator, generations: int) -> list[tuple]:
    """The population after so many generations, the best first. It ends early where no bin can be saved."""
    least = -(-int(sizes.sum()) // capacity)
    rank = lambda s: (len(s[1]), -fitness(s[1], capacity))
    population = sorted(population, key=rank)
    for _ in range(generations):
        if len(population[0][1]) <= least or len(sizes) < 3:
            break
        i, j = sorted(rng.integers(0, len(population), 2))
        child = crossover(sizes, population[i], population[j if j != i else -1], capacity, rng)
        child = min(child, mutate(sizes, child, capacity, rng), key=rank)
        population = sorted([*population, child], key=rank)[: len(population)]
    return population


_ISLAND = "shard long, island int, sizes array<int>, population array<array<int>>, elite array<int>, n_bins int, fitness double"
_ISLAND_ARROW = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())), ("population", pa.list_(pa.list_(pa.int32()))), ("elite", pa.list_(pa.int32())), ("n_bins", pa.int32()), ("fitness", pa.float64())])


def _epoch(capacity: int, epoch: int, population: int, generations: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                rng = np.random.default_rng([row["shard"] & 0xFFFFFFFF, row["island"], epoch])
                if epoch == 0:  # one of longest first, the others in orders that stray from it
                    orders = [np.argsort(-sizes * rng.uniform(1 - spread, 1 + spread, len(sizes)), kind="stable") for spread in np.linspace(0, 0.5, population)]
                    solutions = [greedy(sizes, o, capacity) for o in orders]
                else:
                    solutions = [tidy(sizes, np.array(x, dtype=np.int64)) for x in [row["migrant"], *row["population"]] if x is not None]
                solutions = evolve(sizes, solutions, capacity, rng, generations)[:population]
                best = solutions[0]
                done = dict(row, population=[] if last else [b for b, _ in solutions[1:]], elite=best[0], n_bins=len(best[1]), fitness=fitness(best[1], capacity))
                yield pa.RecordBatch.from_pydict({n: [done[n]] for n in _ISLAND_ARROW.names}, schema=_ISLAND_ARROW)

    return run


def items_of(counts: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """Items from counts (doc_id, n_tokens): (pieces that fill a container alone, items to pack), both with doc_id,
    piece, first_token and n_tokens. Only texts longer than a container are split; zero-length ones have no item."""
    whole = F.floor(F.col("n_tokens") / capacity).cast("int")
    split = counts.where(F.col("n_tokens") > capacity)
    full = split.select("doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    full = full.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"))
    piece = F.when(F.col("n_tokens") > capacity, whole).otherwise(0)
    rest = counts.select("doc_id", piece.alias("piece"), (piece.cast("long") * capacity).alias("first_token"), (F.col("n_tokens") - piece.cast("long") * capacity).alias("n_tokens"))
    return full, rest.where("n_tokens > 0")


def fill_containers(counts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS) -> DataFrame:
    """Containers for counts (doc_id, n_tokens; doc_id unique): container_id, doc_id, piece, first_token, n_tokens.

    Every token of every document is in exactly one container. Items are spread over shards of some 4096 by a hash of
    their document, so shards are alike whatever the order or size of documents. On each shard several islands evolve
    solutions apart; after each epoch the best one of an island migrates to the next, and the best of all is kept.
    Null counts and counts of 0 have no rows. The result doesn't depend on partitioning.
    """
    full, rest = items_of(counts.where("n_tokens > 0"), capacity)
    rest = materialize(rest)
    shards = max(1, -(-rest.count() // shard))
    item = F.struct(F.xxhash64("doc_id", "piece").alias("h"), "doc_id", "piece", "first_token", "n_tokens")
    keyed = rest.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), item.alias("item"))
    packed = materialize(keyed.groupBy("shard").agg(F.sort_array(F.collect_list("item")).alias("items")))
    n = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards * islands // 8))
    state = packed.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.transform("items.n_tokens", lambda x: x.cast("int")).alias("sizes"))
    for epoch in range(epochs):
        if epoch:
            migrant = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("migrant"))
            state = state.join(migrant, ["shard", "island"]).withColumn("population", F.concat(F.array("elite"), "population"))
        last = epoch == epochs - 1
        state = materialize(state.repartition(n, "shard", "island").mapInArrow(_epoch(capacity, epoch, population, generations, last), _ISLAND))
    best = state.groupBy("shard").agg(F.min(F.struct("n_bins", (-F.col("fitness")).alias("f"), "island", "elite")).alias("best")).select("shard", "best.elite")
    pairs = packed.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", F.col("elite").alias("bin"))).alias("x"))
    columns = [F.col(f"x.items.{c}").alias(c) for c in ("doc_id", "piece", "first_token", "n_tokens")]
    together = pairs.select(F.concat_ws("-", F.lit("shard"), "shard", "x.bin").alias("container_id"), *columns)
    alone = full.select(F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "first_token", "n_tokens")
    return together.unionByName(alone)


def fill_with_texts(texts: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """fill_containers over the token counts of texts (doc_id, text)."""
    return fill_containers(materialize(token_counts(texts, path)), capacity)
