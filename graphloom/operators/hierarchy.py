"""Parent-child rows as full hierarchies: root, depth, path and descendants of every node, circles apart.

Every node has at most one parent, so the links form trees, some of which end in a circle instead of a root. A link
carries a weight: the number of levels it spans, the smallest id on it and, where paths are asked for, the names on it.
Each partition folds its own links with a weighted disjoint-set forest, which leaves one exit per local tree; the exits
are links again, far fewer, and are folded in larger and larger groups of partitions. What a group resolves is joined
back to the smaller ones. Should the exits not shrink enough for one task, they are resolved by doubling joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize, small, weight

#: Exits that one task may fold at once, and bytes of their ids and of what lies above them.
MERGE_ROWS = 250_000
MERGE_BYTES = 128 << 20
#: Rows that a partition of the first fold gets at most, on average.
LOCAL_ROWS = 100_000
#: Partitions whose exits are folded together.
FAN = 16

_LINK = "id string, parent string, pid int, w long, low string, names array<string>, ids array<string>, cycle string"
_FOLD = "id string, pid int, rep string, off long, low string, cycle string, exit string, exit_w long, exit_low string, exit_names array<string>, exit_ids array<string>, names array<string>, ids array<string>"
_STRINGS = pa.list_(pa.string())
_FOLD_ARROW = pa.schema([("id", pa.string()), ("pid", pa.int32()), ("rep", pa.string()), ("off", pa.int64()), ("low", pa.string()), ("cycle", pa.string()), ("exit", pa.string()), ("exit_w", pa.int64()), ("exit_low", pa.string()), ("exit_names", _STRINGS), ("exit_ids", _STRINGS), ("names", _STRINGS), ("ids", _STRINGS)])


def _least(a: str | None, b: str | None) -> str | None:
    return b if a is None else a if b is None else min(a, b)


class Forest:
    """A weighted disjoint-set forest over links id -> parent with a level count and the least id above id up to parent."""

    def __init__(self, ids: list[str], parents: list[str | None], weights: list[int], lows: list[str | None]):
        self.at = at = {x: i for i, x in enumerate(ids)}
        n = len(ids)
        self.up, self.off, self.low = list(range(n)), [0] * n, [None] * n
        self.parent = [-1] * n  # the parent within, unless the link closes a circle
        self.cycle: dict[int, str] = {}
        for c, p in enumerate(parents):
            if p is None or (i := at.get(p)) is None:
                continue
            if self.find(i) == c:
                self.cycle[c] = _least(self.low[i] if i != c else None, lows[c])
            else:
                self.up[c], self.off[c], self.low[c], self.parent[c] = i, weights[c], lows[c], i
        for i in range(n):
            self.find(i)

    def find(self, i: int) -> int:
        up, path = self.up, []
        while up[i] != i:
            path.append(i)
            i = up[i]
        for j in path[-2::-1]:
            u = up[j]
            self.off[j] += self.off[u]
            self.low[j] = _least(self.low[j], self.low[u])
            up[j] = i
        return i

    def above(self, pieces: list[list[str]]) -> list[list[str] | None]:
        """For each id the pieces from its root to itself, one after another; None on or below a circle."""
        done: list[list[str] | None] = [None] * len(self.up)
        known = [False] * len(self.up)
        for i in range(len(self.up)):
            chain = []
            while not known[i]:
                chain.append(i)
                if self.parent[i] < 0:
                    break
                i = self.parent[i]
            for j in reversed(chain):
                p = self.parent[j]
                if self.up[j] in self.cycle:
                    done[j] = None
                else:
                    done[j] = pieces[j] if p < 0 else done[p] + pieces[j]
                known[j] = True
        return done


def _folder(base: bool, paths: bool, group: bool):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(got) if (got := list(batches)) else None
        if t is None or not t.num_rows:
            return
        c = {n: t[n].to_pylist() for n in t.column_names}
        ids, parents, n = c["id"], c["parent"], t.num_rows
        weights, lows = ([1] * n, parents) if base else (c["w"], c["low"])
        pid = TaskContext.get().partitionId() if base or not group else 0
        pids = [pid] * n if base else c["pid"]
        f = Forest(ids, parents, weights, lows)
        known = [None] * n if base else c["cycle"]
        above = {}
        if paths:  # at the base a piece is the node itself, later it is what lies above the node
            above = {k: f.above([[x] for x in c[b]] if base else [x if f.parent[i] >= 0 else [] for i, x in enumerate(c[k])]) for k, b in (("names", "name"), ("ids", "id"))}
        for start in range(0, n, 4000):
            some = range(start, min(n, start + 4000))
            rows: dict[str, list] = {x: [] for x in _FOLD_ARROW.names}
            for i in some:
                r = f.up[i]
                leaves = f.parent[r] < 0 and r not in f.cycle and parents[r] is not None
                for k, v in (("id", ids[i]), ("pid", pids[i]), ("rep", ids[r]), ("off", f.off[i]), ("low", f.low[i]), ("cycle", f.cycle.get(r) or known[r]), ("exit", parents[r] if leaves else None), ("exit_w", weights[r] if leaves else None), ("exit_low", lows[r] if leaves else None)):
                    rows[k].append(v)
                for k in ("names", "ids"):
                    rows[k].append(above[k][i] if paths else None)
                    rows[f"exit_{k}"].append(c[k][r] if paths and leaves and not base else None)
            yield pa.RecordBatch.from_pydict(rows, schema=_FOLD_ARROW)

    return fold


def _joined(left: DataFrame, right: DataFrame, on, how: str, few: bool) -> DataFrame:
    return left.join(F.broadcast(right) if few else right, on, how)


def _exits(fold: DataFrame, base: bool) -> DataFrame:
    """The exits of a fold as links between the roots of local trees."""
    leaving = fold.where("exit is not null and id = rep")
    target = fold.select(F.col("id").alias("exit"), F.col("rep").alias("t_rep"), F.col("off").alias("t_off"), F.col("low").alias("t_low"), F.col("cycle").alias("t_cycle"), F.col("names").alias("t_names"), F.col("ids").alias("t_ids"))
    wanted = leaving.select("id", "pid", "exit", "exit_w", "exit_low", "exit_names", "exit_ids")
    # the exits are the small side; which of the targets exist shows in the join
    sought = wanted.select("exit").distinct()
    found = _joined(target, sought, "exit", "left_semi", small(sought))
    links = wanted.join(found, "exit", "left")
    exists = F.col("t_rep").isNotNull()
    # at the base an exit that isn't found is a missing parent: the local root is a root. Later it is a root already.
    missing = F.lit(None).cast("string") if base else F.col("exit")
    both = lambda k: F.col(f"t_{k}") if base else F.when(exists, F.concat(f"t_{k}", f"exit_{k}")).otherwise(F.col(f"exit_{k}"))
    return links.select(
        "id",
        F.when(exists & F.col("t_cycle").isNull(), F.col("t_rep")).when(~exists, missing).alias("parent"),
        "pid",
        (F.coalesce("t_off", F.lit(0)) + F.col("exit_w")).alias("w"),
        F.least("t_low", "exit_low").alias("low"),
        both("names").alias("names"),
        both("ids").alias("ids"),
        F.col("t_cycle").alias("cycle"),
    )


def _finished(fold: DataFrame) -> DataFrame:
    """A fold of all links: each id with its root, levels to it, circle and what lies above it."""
    joint = lambda k: F.when(F.col("exit").isNotNull(), F.concat(f"exit_{k}", k)).otherwise(F.col(k))
    return fold.select("id", F.coalesce("exit", "rep").alias("root"), (F.col("off") + F.coalesce("exit_w", F.lit(0))).alias("off"), "cycle", joint("names").alias("names"), joint("ids").alias("ids"))


def _doubled(links: DataFrame, rows: int) -> DataFrame:
    """Links too many for one task: each pass joins them with themselves and so doubles what they span."""
    step = materialize(links.select("id", "parent", F.col("cycle"), "w", "low"))
    span = 1
    while True:
        nxt = step.select(F.col("id").alias("parent"), F.col("parent").alias("p2"), F.col("cycle").alias("c2"), F.col("w").alias("w2"), F.col("low").alias("l2"))
        j = step.join(nxt, "parent", "left")
        on = F.col("p2").isNotNull()
        step = materialize(j.select("id", F.when(on, F.col("p2")).otherwise(F.col("parent")).alias("parent"), F.coalesce("cycle", "c2").alias("cycle"), (F.col("w") + F.when(on, F.col("w2")).otherwise(0)).alias("w"), F.when(on, F.least("low", "l2")).otherwise(F.col("low")).alias("low")))
        span *= 2
        # whoever still has a link out of its last stop after as many steps as there are links is on a circle or below one
        if span > 2 * rows:
            break
        more = step.join(links.where("parent is not null").select(F.col("id").alias("parent")), "parent", "left_semi")
        if more.isEmpty():
            break
    inside = links.where("parent is not null").select(F.col("id").alias("parent"), F.lit(True).alias("_on"))
    lows = step.select(F.col("id").alias("parent"), F.col("low").alias("circle"))
    roots = step.join(inside, "parent", "left").join(lows, "parent", "left")
    roots = materialize(roots.select("id", F.coalesce("parent", "id").alias("root"), F.col("w").alias("off"), F.when(F.col("cycle").isNotNull(), F.col("cycle")).when(F.col("_on"), F.col("circle")).alias("cycle")))
    # what lies above, only where there is an end to it
    above = materialize(links.select("id", "parent", "names", "ids").join(roots.where("cycle is null").select("id"), "id", "left_semi"))
    while not above.join(above.where("parent is not null").select(F.col("id").alias("parent")), "parent", "left_semi").isEmpty():
        nxt = above.select(F.col("id").alias("parent"), F.col("parent").alias("p2"), F.col("names").alias("n2"), F.col("ids").alias("i2"), F.lit(True).alias("_on"))
        j = above.join(nxt, "parent", "left")
        above = materialize(j.select("id", F.when(F.col("_on"), F.col("p2")).otherwise(F.col("parent")).alias("parent"), F.when(F.col("_on"), F.concat("n2", "names")).otherwise(F.col("names")).alias("names"), F.when(F.col("_on"), F.concat("i2", "ids")).otherwise(F.col("ids")).alias("ids")))
    return roots.join(above.select("id", "names", "ids"), "id", "left")


def _resolve(links: DataFrame, paths: bool, last: int | None = None) -> tuple[DataFrame, int]:
    links = materialize(links, measured=True)
    rows, n_bytes = weight(links)
    if rows <= MERGE_ROWS and n_bytes <= MERGE_BYTES:
        return materialize(_finished(links.coalesce(1).mapInArrow(_folder(False, paths, True), _FOLD)), measured=True), rows
    groups = links.select(F.max("pid")).first()[0] + 1
    if groups == 1 or last is not None and rows > 0.7 * last:
        return materialize(_doubled(links, rows)), rows
    wide = links.withColumn("pid", F.floor(F.col("pid") / FAN).cast("int"))
    fold = materialize(wide.repartition(max(1, -(-groups // FAN)), "pid").mapInArrow(_folder(False, paths, False), _FOLD))
    upper, _ = _resolve(_exits(fold, False), paths, rows)
    return materialize(_composed(fold, upper)), rows


def _composed(fold: DataFrame, upper: DataFrame) -> DataFrame:
    """fold joined with the written result for its local roots; that is broadcast only if, paths included, it is small."""
    up = upper.select(F.col("id").alias("rep"), F.col("root").alias("u_root"), F.col("off").alias("u_off"), F.col("cycle").alias("u_cycle"), F.col("names").alias("u_names"), F.col("ids").alias("u_ids"))
    j = _joined(fold, up, "rep", "left", small(upper))
    on = F.col("u_root").isNotNull()
    joint = lambda k: F.when(on, F.concat(f"u_{k}", k)).otherwise(F.col(k)).alias(k)
    return j.select("id", F.coalesce("u_root", "rep").alias("root"), (F.col("off") + F.coalesce("u_off", F.lit(0))).alias("off"), F.coalesce("cycle", "u_cycle").alias("cycle"), joint("names"), joint("ids"))


def resolve_links(nodes: DataFrame, paths: bool = False, near: list[str] | None = None) -> DataFrame:
    """Roots, depths, circles and paths of all nodes.

    nodes: id (unique, non-null; other rows with a null id are left out), parent_id, name (if paths) and the columns
    `near`, by which related nodes lie close together; rows are range-partitioned by them, which splits hot values and
    keeps most links within a partition. Returns id, root, off (levels below the root; on or below a circle
    meaningless), cycle (smallest id on the circle that the node lies on or runs into, else null), names and ids (from
    the root to the node itself; null unless paths, and on or below circles). A parent_id that is null or in no row
    makes a root. A null name counts as an empty one.
    """
    near = near or []
    rows = materialize(nodes.where("id is not null").select("id", F.col("parent_id").alias("parent"), *([F.coalesce("name", F.lit("")).alias("name")] if paths else []), *near))
    spark = nodes.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // LOCAL_ROWS))
    placed = rows.repartitionByRange(n, *near, "id").select("id", "parent", *(["name"] if paths else []))
    fold = materialize(placed.mapInArrow(_folder(True, paths, False), _FOLD))
    upper, _ = _resolve(_exits(fold, True), paths)
    return _composed(fold, upper)


def current_nodes(nodes: DataFrame) -> DataFrame:
    from graphloom.operators.latest import latest_per_key

    return latest_per_key(nodes, ["id"], ["updated_at"], ["parent_id", "file_id", "name", "start_line"])


def circles(nodes: DataFrame) -> DataFrame:
    """(node_id, cycle_id) of every current node on a circle of parents or whose parents run into one."""
    found = resolve_links(current_nodes(nodes), near=["file_id", "start_line"]).where("cycle is not null")
    return found.select(F.col("id").alias("node_id"), F.col("cycle").alias("cycle_id"))


def hierarchy(nodes: DataFrame) -> DataFrame:
    """One row per current node: node_id, root_id, depth (0 at roots), path (names from root to node, as an array),
    ids (the same as ids), cycle_id. On and below circles all but node_id and cycle_id are null."""
    r = resolve_links(current_nodes(nodes), paths=True, near=["file_id", "start_line"])
    free = F.col("cycle").isNull()
    return r.select(F.col("id").alias("node_id"), F.when(free, F.col("root")).alias("root_id"), F.when(free, F.col("off")).alias("depth"), F.col("names").alias("path"), "ids", F.col("cycle").alias("cycle_id"))


def descendants(tree: DataFrame) -> DataFrame:
    """(node_id, descendant_id, distance) of every pair of ancestor and descendant, from the ids of hierarchy().

    Nodes on and below circles have no rows. Each node's own path gives its pairs, so nothing is shuffled, however
    many descendants a node has.
    """
    pairs = tree.where("cycle_id is null").select(F.col("node_id").alias("descendant_id"), "depth", F.posexplode(F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0)))).alias("_at", "node_id"))
    return pairs.select("node_id", "descendant_id", (F.col("depth") - F.col("_at")).alias("distance"))
