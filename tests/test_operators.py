"""Graph, interval, ordered, text, change and resolution operators on small data against brute force."""

import random
import time

import pyarrow as pa
import pytest

from graphloom.functions import paths
from graphloom.operators import changes, graph, intervals, ordered, resolution, text
from graphloom.operators.latest import latest_per_key


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def reach(pairs):
    out = {}
    for a, b in pairs:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
    closed = {}
    for x in {y for p in pairs for y in p if y is not None}:
        seen, todo = set(), [x]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        closed[x] = seen
    return closed


@pytest.mark.parametrize("small", [True, False])
def test_components(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(graph, "TASK_EDGES", 0)
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(22)] + [("hub", f"h{i}") for i in range(12)] + [("s", "s"), (None, "q"), ("q", None)]
    both = pairs + [(b, a) for a, b in pairs]
    r = reach(both)
    weak = {x: min(r[x] | {x}) for x in r if len(r[x] - {x})}
    got = {x["id"]: x["component"] for x in graph.components(edges_of(spark, pairs)).collect()}
    assert got == weak
    from collections import Counter

    left = {p for p in pairs if None not in p}
    while True:
        kept = {(a, b) for a, b in left if any(y == a for _, y in left) and any(x == b for x, _ in left)}
        if kept == left:
            break
        left = kept
    assert Counter(tuple(r) for r in graph.peeled(edges_of(spark, pairs)).collect()) == Counter(left)
    r = reach(pairs)
    strong = {x: min({y for y in r[x] if x in r[y]} | {x}) for x in r if x in r[x]}
    got = {x["id"]: x["component"] for x in graph.strong_components(edges_of(spark, pairs)).collect()}
    assert got == strong


@pytest.mark.parametrize("task_pairs", [10**6, 10, 0])
def test_strong_components_by_number(spark, monkeypatch, task_pairs):
    """Beyond TASK_EDGES one task holds numbered nodes; beyond TASK_PAIRS joins find a pivot's component, then colours."""
    monkeypatch.setattr(graph, "TASK_EDGES", 0)
    monkeypatch.setattr(graph, "TASK_PAIRS", task_pairs)
    rng = random.Random(7)
    ring = [f"r{i}" for i in range(6)]
    pairs = [(f"n{rng.randrange(25):02d}", f"n{rng.randrange(25):02d}") for _ in range(45)] + list(zip(ring, ring[1:] + ring[:1])) + [("r0", "n00"), ("n01", "t0"), ("t0", "t1"), ("t1", "t1"), ("r1", "r1"), ("u", "v"), ("v", "u"), (None, "u"), ("u", None)]
    pairs += rng.sample(pairs, 10)
    r = reach(pairs)
    strong = {x: min({y for y in r[x] if x in r[y]} | {x}) for x in r if x in r[x]}
    got = [tuple(x) for x in graph.strong_components(edges_of(spark, pairs)).collect()]
    assert len(got) == len(strong) and dict(got) == strong


def test_strong_components_of_a_long_ring(spark, monkeypatch):
    """The work beyond TASK_EDGES doesn't grow with the length of a circle: joins needed a round for each of its nodes."""
    monkeypatch.setattr(graph, "TASK_EDGES", 0)
    written, materialize = [], graph.materialize

    def counted(*args, **kwargs):
        written.append(1)
        assert len(written) < 20, "too many rounds"
        return materialize(*args, **kwargs)

    monkeypatch.setattr(graph, "materialize", counted)
    pairs = [(f"n{i:03d}", f"n{(i + 1) % 300:03d}") for i in range(300)] + [("n007", f"tail{i}") for i in range(3)]
    got = {x["id"]: x["component"] for x in graph.strong_components(edges_of(spark, pairs)).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(300)}
    assert graph.strong_components(edges_of(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_large_component_is_named_once():
    """The least id of a component is sought once, not once for each of its nodes."""
    ids = [f"n{i:05d}" for i in range(60_000)]
    began = time.process_time()
    (got,) = graph._strongly(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[1:] + ids[:1])], ["src", "dst"])]))
    assert time.process_time() - began < 10
    assert got.num_rows == 60_000 and set(got.column(1).to_pylist()) == {"n00000"}


def test_search_shape_rollup(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "name:x"), ("a", "b")]
    e = edges_of(spark, pairs)
    roots = spark.createDataFrame([("a",)], "id string")
    nodes, walked, _ = graph.bounded_search(e, roots, 2)
    assert {(r["id"], r["distance"]) for r in nodes.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert sorted((r["level"], r["src"]) for r in walked.collect()) == [(1, "a"), (1, "a"), (2, "b")]
    nodes = graph.bounded_search(e, roots, 50, forward=False).nodes
    assert {r["id"] for r in nodes.collect()} == {"a", "b", "c"}
    cut = graph.bounded_search(e, roots, 3, once=lambda x: x.distinct(), limit=2)
    assert cut.truncated and sorted((r["level"], r["dst"]) for r in cut.edges.collect()) == [(1, "b"), (2, "c")]
    whole = graph.bounded_search(e, roots, 3, once=lambda x: x.distinct(), limit=4)
    assert not whole.truncated and whole.edges.count() == 4
    with pytest.raises(ValueError):
        graph.bounded_search(e, roots, 0)
    s = {r["id"]: r for r in graph.shape(e, spark.createDataFrame([("a",), ("c",), ("z",)], "id string")).collect()}
    assert s["a"]["n_out"] == 1 and s["c"]["is_fork"] and s["z"]["is_isolated"]
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "id string, group_id string")
    got = {(r["from_group"], r["to_group"]): (r["n_edges"], r["n_members"]) for r in graph.rolled_up(e.selectExpr("*", "'call' as kind"), groups).collect()}
    assert got == {("g", "g"): (2, 1), ("g", "h"): (1, 1), ("h", "g"): (1, 1), ("h", "d"): (1, 1), ("d", "name:x"): (1, 1)}
    assert graph.peeled(edges_of(spark, [("a", "b"), ("b", "c")])).count() == 0
    assert graph.peeled(e).count() == 3


def test_intervals(spark):
    rng = random.Random(1)
    rows = [("f", a, a + rng.randrange(-1, 6)) for a in (rng.randrange(1, 60) for _ in range(14))] + [("g", 3, None), ("g", 5, 5), (None, 1, 2)]
    df = spark.createDataFrame(rows, "file_id string, start_line long, end_line long")
    covered = {i for f, a, b in rows if f == "f" for i in range(a, b + 1)}
    got = sorted((r["start_line"], r["end_line"]) for r in intervals.merged(df, ["file_id"]).where("file_id = 'f'").collect())
    assert {i for a, b in got for i in range(a, b + 1)} == covered and all(b + 1 < c for (_, b), (c, _) in zip(got, got[1:]))
    free = {i for r in intervals.gaps(df.where("file_id = 'f'").selectExpr("*", "1L as low", "70L as high"), ["file_id"], "low", "high").collect() for i in range(r["gap_start"], r["gap_end"] + 1)}
    assert free == set(range(1, 71)) - covered
    spans = spark.createDataFrame([("f", "out", 1, 500), ("f", "in", 60, 70), ("f", "in2", 60, 70), ("g", "x", 1, 9)], "file_id string, id string, start_line long, end_line long")
    points = spark.createDataFrame([("f", 1, 65), ("f", 2, 71), ("f", 3, 501), ("f", 4, None)], "file_id string, point_id long, at long")
    assert {(r["point_id"], r["span_id"]) for r in intervals.innermost(points, spans, ["file_id"], "at").collect()} == {(1, "in"), (2, "out")}


def test_ordered(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["big", "big", "big", "s", None]), i, rng.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    want, last = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        want[i], last[k] = last.get(k), v
    got = {r["i"]: r["v_before"] for r in ordered.with_previous(df, ["k"], ["i"], ["v"]).collect()}
    assert got == want
    ranked = ordered.with_rank(df, ["v", "i"])
    assert [r["i"] for r in ranked.orderBy("rank").collect()] == [i for _, i, _ in sorted(rows, key=lambda r: (r[2], r[1]))]
    assert {r["next_offset"] for r in ordered.page(ranked, 190, 5).collect()} == {195}
    assert {r["next_offset"] for r in ordered.page(ranked, 190, 10).collect()} == {None}
    assert ordered.with_previous(df.limit(0), ["k"], ["i"], ["v"]).count() == 0
    assert got == {r["i"]: r["x_before"] for r in ordered.with_previous(df.withColumnRenamed("v", "x"), ["k"], ["i"], ["x"]).collect()}
    costs = spark.createDataFrame([("a", 1, 6), ("a", 2, 5), ("a", 3, 3), ("a", 4, 2), ("b", 1, 11), ("b", 2, 10), ("b", 3, None)], "k string, o long, cost long")
    assert {(r["k"], r["o"]) for r in ordered.within_budget(costs, ["k"], ["o"], "cost", 10).collect()} == {("a", 1), ("a", 3), ("b", 2), ("b", 3)}


def test_ordered_with_split_files(spark):
    """Written files that are read in many splits: every row still gets its own predecessor and rank."""
    settings = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "0", "parquet.block.size": "1024"}
    before = {k: spark.conf.get(k, None) for k in settings}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "1024")
    hadoop.set("parquet.page.size", "256")
    hadoop.set("parquet.block.size.row.check.min", "10")
    hadoop.set("parquet.page.size.row.check.min", "10")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rng = random.Random(9)
        rows = [(rng.choice(["big", "big", "s", None]), i, f"{rng.random()}" * 3) for i in range(6000)]
        df = spark.createDataFrame(rows, "k string, i long, v string").repartition(3)
        assert ordered._placed(df, ["k"], ["i"]).rdd.getNumPartitions() > 8  # the files are split
        want, last = {}, {}
        for k, i, v in rows:
            want[i], last[k] = last.get(k), v
        assert {r["i"]: r["v_before"] for r in ordered.with_previous(df, ["k"], ["i"], ["v"]).collect()} == want
        places = ordered.with_rank(df, ["v", "i"]).orderBy("rank").collect()
        assert [r["i"] for r in places] == [i for _, i, _ in sorted(rows, key=lambda r: (r[2], r[1]))] and places[-1]["rank"] == 6000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for k in ("parquet.block.size", "parquet.page.size", "parquet.block.size.row.check.min", "parquet.page.size.row.check.min"):
            hadoop.unset(k)


@pytest.mark.parametrize("keys", [["k"], []])
def test_within_budget_against_a_plain_fold(spark, keys):
    rng = random.Random(7)
    rows = [(rng.choice("aaab") if keys else "a", i, rng.choice([None, 0, 1, 3, 7, 20, 60, 90, 101])) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o long, cost long").repartition(9)
    want, left = set(), {}
    for k, o, c in rows:
        if (c or 0) <= left.setdefault(k, 100):
            left[k] -= c or 0
            want.add((k, o))
    kept = ordered.within_budget(df, keys, ["o"], "cost", 100)
    assert {(r["k"], r["o"]) for r in kept.collect()} == want
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("MapInArrow") == 2  # rows are thinned before they are shuffled


def test_text(spark):
    df = spark.createDataFrame([("a", "One\r\ntwo\x0bthree "), ("b", ""), ("c", None), ("d", "x\n\nONE one")], "k string, t string")
    got = {}
    for r in text.lines(df, "k", "t").orderBy("k", "line_no").collect():
        got.setdefault(r["k"], []).append(r["line"])
    assert got == {"a": ["One", "two", "three"], "b": [""], "d": ["x", "", "ONE one"]}
    assert {(r["k"], r["line_no"]) for r in text.grep(df, "k", "t", "oNe").collect()} == {("a", 1), ("d", 3)}
    page = text.line_range(df, "k", "t", 2, 1).collect()
    assert {(r["k"], r["line"], r["next_start"]) for r in page} == {("a", "two", 3), ("d", "", 3)}
    scores = text.search(df, "k", ["t"], "one", None).collect()
    assert {r["k"] for r in scores} == {"a", "d"} and all(r["score"] > 0 for r in scores)
    ix = text.TextIndex.build(df, "k", ["t"])
    assert {r["k"]: round(r["score"], 9) for r in ix.search("one", None).collect()} == {r["k"]: round(r["score"], 9) for r in scores}
    assert ix.differs(df).count() == 0 and [r["k"] for r in ix.search("one x").collect()] == ["d"] == [r["k"] for r in text.search(df, "k", ["t"], "x one").collect()]
    changed = spark.createDataFrame([("a", "four"), ("e", "one one")], "k string, t string")
    now = df.where("k not in ('a', 'b')").unionByName(changed)
    assert ix.differs(now).count() > 0
    newer = ix.update(changed, spark.createDataFrame([("b",)], "k string"))
    assert newer.differs(now).count() == 0 and {r["k"] for r in newer.search("one").collect()} == {"d", "e"}
    assert ix.search("absent").count() == 0 == text.search(df.limit(0), "k", ["t"], "one").count()
    assert {(r["k"], r["term"], r["tf"]) for r in text.index(df, "k", ["t"]).where("k = 'd'").collect()} == {("d", "x", 1), ("d", "one", 2)}


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "id long, p string, q string")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", "z")], "id long, p string, q string")
    got = {(r["id"], r["change"], tuple(r["changed_fields"])) for r in changes.compare(old, new, ["id"], ["p", "q"]).collect()}
    assert got == {(2, "modified", ("q",)), (3, "deleted", ()), (4, "added", ())}
    files = "g string, path string, sha256 string"
    gone = spark.createDataFrame([("g", "a", "1"), ("g", "b", "2"), ("g", "c", "2"), ("g", "d", None)], files)
    came = spark.createDataFrame([("g", "x", "1"), ("g", "y", "2"), ("h", "z", "1"), ("g", "w", None)], files)
    assert [tuple(r) for r in changes.exact_renames(gone, came, ["g"]).collect()] == [("g", "a", "x")]
    symbols = "file_id string, id string, kind string, qualified_name string, signature string, start_line long, semantic_sha string"
    a = spark.createDataFrame([("f", "o1", "function", "x", "x()", 1, "s1"), ("f", "o2", "function", "x", "x()", 5, "s2"), ("f", "o3", "function", "y", "y(a)", 9, "s3")], symbols)
    b = spark.createDataFrame([("f", "n1", "function", "x", "x()", 2, "s9"), ("f", "n2", "function", "x", "x()", 7, "s8"), ("f", "n3", "function", "y", "y(b)", 9, "s3")], symbols)
    assert {tuple(r) for r in changes.rematched(a, b).collect()} == {("o1", "n1"), ("o2", "n2"), ("o3", "n3")}
    inv = changes.invalidated(spark.createDataFrame([("b",)], "id string"), edges_of(spark, [("a", "b"), ("c", "a"), ("b", "b")]))
    assert {tuple(r) for r in inv.collect()} == {("b", "stale"), ("a", "suspect")}
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "p"), ("b", 1, "q"), (None, 1, "n")], "k string, o long, v string")
    assert {tuple(r) for r in latest_per_key(rows, ["k"], ["o"], ["v"]).select("k", "v").collect()} == {("a", "y"), ("b", "q"), (None, "n")}


def test_resolution_subset_equals_full(spark):
    rng = random.Random(3)

    def repo(seed):
        r = random.Random(seed)
        symbols = []
        for f in range(6):
            for i in range(4):
                scope = r.choice(["", "", "A", "A.m"])
                name = r.choice(["f", "g", "h", "k"])
                symbols.append((f"s{f}_{i}", "p", f"file{f}", name, f"{scope}.{name}" if scope else name))
        return symbols

    before = repo(1)
    after = [s for s in before if s[2] != "file3"] + [("new", "p", "file3", "z", "z"), ("new2", "p", "file3", "f", "A.f")]
    sites = [(i, "p", f"file{rng.randrange(6)}", rng.choice(["", "A", "A.m", None]), rng.choice(["f", "g", "h", "k", "z", "A.f", "q.r", None])) for i in range(80)]
    sd = spark.createDataFrame(sites, "site_id long, group_id string, file_id string, scope string, name string")
    cols = "id string, group_id string, file_id string, name string, qualified_name string"
    a, b = spark.createDataFrame(before, cols), spark.createDataFrame(after, cols)
    full = {tuple(r) for r in resolution.resolve_names(sd, b).collect()}
    lost = {s[0] for s in before} ^ {s[0] for s in after}
    names = {x for s in before + after if s[0] in lost for x in (s[3], s[4])}
    again = resolution.resolved_again(sd, b, resolution.resolve_names(sd, a), spark.createDataFrame([("file3",)], "file_id string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {tuple(r) for r in again.collect()} == full
    by = {}
    for s, dst, c in full:
        by.setdefault(s, []).append((dst, c))
    for i, _, f, scope, name in sites:
        if name is None:
            assert i not in by
            continue
        levels = []
        if "." not in name:
            parts = (scope or "").split(".") if scope else []
            levels = [[s for s in after if s[2] == f and s[4] == ".".join([*parts[:k], name])] for k in range(len(parts), -1, -1)]
        else:
            levels = [[s for s in after if s[2] == f and s[4] == name]]
        hit = next((x for x in levels if x), None)
        place = "resolved_local"
        if hit is None:
            hit, place = [s for s in after if name in (s[3], s[4])], "unique_in_project"
        want = [(f"name:{name}", "unresolved")] if not hit else [(s[0], place if len(hit) == 1 else "ambiguous") for s in hit]
        assert sorted(by[i]) == sorted(want)


def test_glob():
    import re

    yes = [("**/*.py", "a/b/c.py"), ("**/*.py", "c.py"), ("a/*.c", "a/x.c"), ("x[!a].t", "xb.t"), ("a+b.c", "a+b.c")]
    no = [("*.py", "a/c.py"), ("a/*.c", "a/b/x.c"), ("x[!a].t", "xa.t"), ("a.b", "axb")]
    assert all(re.match(paths.glob(g), p) for g, p in yes) and not any(re.match(paths.glob(g), p) for g, p in no)
