"""Operators on graphs given as edge rows (src, dst)."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import hinted, materialize, small, weight

#: Distinct edges that one task may hold to finish a search for components.
TASK_EDGES = 500_000
#: Distinct edges between numbered nodes (16 bytes each) that one task may hold for the same.
TASK_PAIRS = 8_000_000


def distinct_edges(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges once each. Where keys repeat with other confidences, the least one holds."""
    keys = keys or ["edge_id", "src_id", "dst_id", "kind", "site_line"]
    return edges.groupBy(*keys).agg(F.min("confidence").alias("confidence"))


def in_degree(edges: DataFrame) -> DataFrame:
    """dst and degree, the number of edges (parallel ones count) into it. Partial counts are made before the shuffle."""
    return edges.where("dst is not null").groupBy("dst").agg(F.count("*").alias("degree"))


class Search(NamedTuple):
    """What a search reached: nodes (id, distance), the edges walked (with their level), whether a limit cut it short."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def bounded_search(edges: DataFrame, roots: DataFrame, depth: int = 3, forward: bool = True, once: Callable[[DataFrame], DataFrame] | None = None, limit: int | None = None) -> Search:
    """What is reached from roots (id) in at most depth steps: nodes with their least distance, and every edge walked with
    the level at which it was, from 1. forward: along src -> dst, else against.

    Each node is expanded once. The frontier is written and measured each level; it is broadcast only while small. once
    makes repeated edge rows one; it is applied to the edges at the frontier, so the whole table is never aggregated.
    limit: the search ends when so many edges were walked, level by level in order of the frontier's ids, then of the
    other columns; then it is truncated.
    """
    if not 1 <= depth <= 50:
        raise ValueError("depth must be from 1 to 50")
    if limit is not None and not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    here, there = ("src", "dst") if forward else ("dst", "src")
    once = once or (lambda rows: rows)
    frontier = materialize(roots.where("id is not null").select("id").distinct(), measured=True)
    visited = frontier.withColumn("distance", F.lit(0))
    if limit is not None:
        return _limited_search(edges, frontier, visited, depth, here, there, once, limit)
    expanded, few = visited, small(frontier)
    for level in range(1, depth + 1):
        if not weight(frontier)[0]:
            break
        ends = edges.join(hinted(frontier).withColumnRenamed("id", here), here, "left_semi").where(F.col(there).isNotNull())
        frontier = ends.select(F.col(there).alias("id")).distinct().join(visited.select("id"), "id", "left_anti")
        if level < depth:  # the last one isn't expanded; it is made only where nodes are asked for
            frontier = materialize(frontier, measured=True)
            few &= small(frontier)
        visited = visited.unionByName(frontier.withColumn("distance", F.lit(level)))
        expanded = visited if level < depth else expanded
    # every node is expanded once, so one pass over the edges gives all that were walked
    side = expanded.select(F.col("id").alias(here), (F.col("distance") + 1).alias("level"))
    walked = once(edges.join(F.broadcast(side.select(here)) if few else side.select(here), here, "left_semi").select(*edges.columns))
    return Search(visited, walked.join(F.broadcast(side) if few else side, here).select(*walked.columns, "level"), False)


def _limited_search(edges: DataFrame, frontier: DataFrame, visited: DataFrame, depth: int, here: str, there: str, once: Callable[[DataFrame], DataFrame], limit: int) -> Search:
    """At most `limit` edges are walked, so all that is kept of a level is small."""
    walked, taken, truncated = once(edges).withColumn("level", F.lit(0)).limit(0), 0, False
    for level in range(1, depth + 1):
        if truncated or not weight(frontier)[0]:
            break
        step = once(edges.join(hinted(frontier).withColumnRenamed("id", here), here, "left_semi").select(*edges.columns))
        order = [here, there, *(c for c in step.columns if c not in (here, there))]
        step = materialize(step.orderBy(*order).limit(limit - taken + 1), measured=True)
        n = weight(step)[0]
        truncated = n > limit - taken
        step = materialize(step.orderBy(*order).limit(limit - taken).withColumn("level", F.lit(level)))
        taken += min(n, limit - taken)
        walked = step if level == 1 else walked.unionByName(step)
        fresh = step.where(F.col(there).isNotNull()).select(F.col(there).alias("id")).distinct().join(visited.select("id"), "id", "left_anti")
        frontier = materialize(fresh, measured=True)
        visited = visited.unionByName(frontier.withColumn("distance", F.lit(level)))
    return Search(visited, walked, truncated)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) as links from each id to the least of its component, by union of disjoint sets."""
    up: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while (y := up.setdefault(root, root)) != root:
            root = y
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in up if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["u", "v"])


def _strongly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strongly connected components of two nodes or more of edges (src, dst), by depth-first search without recursion."""
    out: dict[str, list[str]] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out.setdefault(a, []).append(b)
            out.setdefault(b, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: dict[str, bool] = {}
    path: list[str] = []
    found: list[tuple[str, str]] = []
    for first in out:
        if first in number:
            continue
        work = [(first, iter(out[first]))]
        number[first] = low[first] = len(number)
        path.append(first)
        open_[first] = True
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    path.append(nxt)
                    open_[nxt] = True
                    work.append((nxt, iter(out[nxt])))
                    break
                if open_.get(nxt):
                    low[node] = min(low[node], number[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while True:
                        x = path.pop()
                        open_[x] = False
                        members.append(x)
                        if x == node:
                            break
                    if len(members) > 1:
                        least = min(members)
                        found += [(x, least) for x in members]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.string()) for i in (0, 1)], ["id", "component"])


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): weakly connected components, named by their least id. nodes (id) adds isolated ones.

    Alternating large-star and small-star steps: each node's links go to the least neighbour, so hubs shrink instead of
    growing and the number of rounds is logarithmic in practice. A hub's neighbours are never gathered: only its least
    neighbour, a partial aggregate, is. Up to TASK_EDGES distinct links one task unites them at once.
    """
    pairs = edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    links = materialize(pairs)
    last = None
    if links.count() <= TASK_EDGES:
        links = materialize(links.coalesce(1).mapInArrow(_united, "u string, v string"))
        last = "done"
    while last != "done":
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("m"))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        links = materialize(large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct())
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        last = "done" if mark == last else mark
    named = links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    ends = named.select(F.col("component").alias("id")).distinct().select("id", F.col("id").alias("component"))
    out = named.unionByName(ends)
    if nodes is not None:
        alone = nodes.where("id is not null").select("id").distinct().join(out, "id", "left_anti")
        out = out.unionByName(alone.select("id", F.col("id").alias("component")))
    return out


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (src, dst) left when nodes without in- or without out-edges are gone, in time linear in the edges."""
    edges = [e for batch in batches for e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    out: dict[str, set[str]] = {}
    into: dict[str, set[str]] = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)
    loose = [x for x in out.keys() | into.keys() if not out.get(x) or not into.get(x)]
    while loose:
        x = loose.pop()
        for y in out.pop(x, ()):
            into[y].discard(x)
            if not into[y]:
                loose.append(y)
        for y in into.pop(x, ()):
            if y in out:
                out[y].discard(x)
                if not out[y]:
                    loose.append(y)
    left = [(a, b) for a, several in out.items() for b in several]
    yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in left], pa.string()) for i in (0, 1)], ["src", "dst"])


def peeled(edges: DataFrame) -> DataFrame:
    """The edges left after nodes without in- or without out-edges are taken away again and again: none if the graph has
    no circle. What remains lies on circles or on ways between them. Up to TASK_EDGES edges that are left, one task finishes."""
    rest = materialize(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), measured=True)
    n = weight(rest)[0]
    while n > TASK_EDGES:
        kept = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        rest = materialize(kept.select("src", "dst"), measured=True)
        m = weight(rest)[0]
        if m == n:
            return rest
        n = m
    return materialize(rest.coalesce(1).mapInArrow(_peel, "src string, dst string")) if n else rest


def _strongly_numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _strongly, of edges (a, b) between numbered nodes: (n, c), c being a number of the component. All is kept in flat
    arrays; the search takes time linear in the edges."""
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    src, dst = (np.concatenate([np.empty(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1))
    del parts
    names = np.unique(np.concatenate([src, dst]))
    src, dst = (np.searchsorted(names, x).astype(np.int32) for x in (src, dst))
    n, before = len(names), np.inf
    while len(src) < 0.99 * before:  # ends that lie on no circle go first, as long as that thins the edges
        before = len(src)
        into, out = np.zeros(n, bool), np.zeros(n, bool)
        into[dst], out[src] = True, True
        keep = into[src] & out[dst]
        src, dst = src[keep], dst[keep]

    def flat(x: np.ndarray) -> array:
        return array("i", x.astype(np.int32).tobytes())

    to = flat(dst[np.argsort(src, kind="stable")])
    last = np.cumsum(np.bincount(src, minlength=n))
    at, end = flat(np.concatenate([[0], last[:-1]]) if n else last), flat(last)
    del src, dst, last
    low, part = flat(np.zeros(n)), flat(np.full(n, -1))  # 0: not seen; -1: in no component yet
    path: list[int] = []
    count = 0
    for first in range(n):
        if low[first] or at[first] == end[first]:
            continue
        count += 1
        low[first] = count
        path.append(first)
        work, number = [first], [count]
        while work:
            x = work[-1]
            i = at[x]
            if i < end[x]:
                at[x] = i + 1
                y = to[i]
                if not low[y]:
                    count += 1
                    low[y] = count
                    path.append(y)
                    work.append(y)
                    number.append(count)
                elif part[y] < 0 and low[y] < low[x]:
                    low[x] = low[y]
                continue
            work.pop()
            if work and low[x] < low[work[-1]]:
                low[work[-1]] = low[x]
            if low[x] == number.pop():
                while (y := path.pop()) != x:
                    part[y] = x
                part[x] = x
    of = np.frombuffer(part, np.int32)
    members = np.flatnonzero(of >= 0)
    members = members[np.bincount(of[members], minlength=n)[of[members]] > 1]
    yield pa.RecordBatch.from_arrays([pa.array(names[members]), pa.array(names[of[members]])], ["n", "c"])


def _thinned(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, written) as peeled would leave them, but only as long as a round takes away a tenth; no circle is touched."""
    n = weight(pairs)[0]
    while n > TASK_PAIRS:
        kept = pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        pairs = materialize(kept.join(kept.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), measured=True)
        before, n = n, weight(pairs)[0]
        if n > 0.9 * before:
            break
    return pairs


def _reached(links: DataFrame, found: DataFrame) -> DataFrame:
    """found (n, c, written) and all that is reached from there along links (a, b, c) of the same c."""
    front = found
    while True:
        step = links.join(hinted(front).withColumnRenamed("n", "a"), ["a", "c"]).select(F.col("b").alias("n"), "c").distinct()
        front = materialize(step.join(found, ["n", "c"], "left_anti"), measured=True)
        if not weight(front)[0]:
            return found
        found = materialize(found.unionByName(front))


def _strong_at_pivot(pairs: DataFrame) -> DataFrame:
    """(n, c) of the component of the node with most ways through it (in- times out-edges), which is where one component
    holds most of a graph."""
    ways = pairs.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("x")).join(pairs.groupBy(F.col("b").alias("n")).agg(F.count("*").alias("y")), "n")
    pivot = materialize(ways.orderBy(F.desc(F.col("x") * F.col("y")), "n").limit(1).select("n", F.col("n").alias("c")), measured=True)
    links = pairs.crossJoin(F.broadcast(pivot.select("c")))
    after = _reached(links, pivot)
    before = _reached(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"), pivot)
    return materialize(after.join(before, ["n", "c"]).select("n", "c"))


def _strong_by_color(pairs: DataFrame) -> DataFrame:
    """(n, c) of one component of every colour: each node takes the least number that reaches it, c; those of its colour that
    reach the node c form a component. Both searches are joins over all pairs; one round handles all colours at once."""
    color = materialize(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct().select("n", F.col("n").alias("c")))
    while True:
        sent = pairs.join(color.withColumnRenamed("n", "a"), "a").groupBy("b").agg(F.min("c").alias("m"))
        new = materialize(color.join(sent.withColumnRenamed("b", "n"), "n", "left").select("n", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("_moved")))
        color = new.select("n", "c")
        if new.where("_moved").isEmpty():
            break
    inner = pairs.join(color.withColumnRenamed("n", "a"), "a").join(color.select(F.col("n").alias("b"), F.col("c").alias("_c")), "b").where("c = _c")
    return _reached(materialize(inner.select(F.col("b").alias("a"), F.col("a").alias("b"), "c")), materialize(color.where("n = c"), measured=True))


def _strong_by_number(edges: DataFrame) -> DataFrame:
    """As _strongly, of any number of distinct edges (src, dst, written). Nodes are numbered, so that one task can hold far
    more edges. Beyond TASK_PAIRS the component at a pivot is taken out first, then, round by round, one of each colour."""
    ids = materialize(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.monotonically_increasing_id().alias("n")))
    pairs = edges.join(ids.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst")
    pairs = _thinned(materialize(pairs.select("a", "b"), measured=True))
    done, found = ids.select("n", F.col("n").alias("c")).limit(0), None
    while n := weight(pairs)[0]:
        if n <= TASK_PAIRS:
            done = done.unionByName(materialize(pairs.coalesce(1).mapInArrow(_strongly_numbered, "n long, c long")))
            break
        found = _strong_by_color(pairs) if found is not None else _strong_at_pivot(pairs)
        done = done.unionByName(found)
        rest = pairs.join(found.select(F.col("n").alias("a")), "a", "left_anti").join(found.select(F.col("n").alias("b")), "b", "left_anti")
        pairs = _thinned(materialize(rest.select("a", "b"), measured=True))
    members = materialize(done.join(ids, "n").select("id", "c"))
    named = members.groupBy("c").agg(F.min("id").alias("component"), F.count("*").alias("k")).where("k > 1")
    return members.join(named, "c").select("id", "component")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes on circles: strongly connected components of two nodes or more, and self-loops as
    components of one, named by their least id.

    One depth-first search finds them, in one task: on the edges as they are up to TASK_EDGES, on numbered nodes up to
    TASK_PAIRS. Beyond that searches by joins take components out until no more edges are left than one task may hold.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    rest = materialize(edges.where("src <> dst").select("src", "dst").distinct(), measured=True)
    if weight(rest)[0] <= TASK_EDGES:
        done = materialize(rest.coalesce(1).mapInArrow(_strongly, "id string, component string"))
    else:
        done = materialize(_strong_by_number(rest))
    alone = loops.join(done.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return done.unionByName(alone)


def shape(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node (id) the distinct neighbours in and out, parallel edges once and self-loops aside, and its part: source,
    sink, fork (more than one out), join (more than one in), isolated."""
    once = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    out = once.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    into = once.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    all_ = nodes.select("id").where("id is not null").distinct().join(out, "id", "left").join(into, "id", "left")
    n_in, n_out = F.coalesce("n_in", F.lit(0)), F.coalesce("n_out", F.lit(0))
    return all_.select("id", n_in.alias("n_in"), n_out.alias("n_out"), ((n_in == 0) & (n_out > 0)).alias("is_source"), ((n_out == 0) & (n_in > 0)).alias("is_sink"), (n_out > 1).alias("is_fork"), (n_in > 1).alias("is_join"), ((n_in == 0) & (n_out == 0)).alias("is_isolated"))


def rolled_up(edges: DataFrame, groups: DataFrame, loose: bool = True) -> DataFrame:
    """Edges (src, dst, kind) between groups (id, group_id): from_group, to_group, kind, n_edges, n_members (distinct
    pairs). Edges within a group are folded into rows with from_group = to_group. Ends without a group stand for themselves,
    unless `loose` is False, which leaves their edges out."""
    src = groups.select(F.col("id").alias("src"), F.col("group_id").alias("_from"))
    dst = groups.select(F.col("id").alias("dst"), F.col("group_id").alias("_to"))
    # pairs are counted first, so a pair with many parallel edges is one row in the joins
    pairs = edges.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))
    how = "left" if loose else "inner"
    both = pairs.join(src, "src", how).join(dst, "dst", how)
    return both.groupBy(F.coalesce("_from", "src").alias("from_group"), F.coalesce("_to", "dst").alias("to_group"), "kind").agg(F.sum("n").alias("n_edges"), F.count("*").alias("n_members"))
