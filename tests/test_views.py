"""Reports, overlays and guarded reads against brute force, with nulls, repeated rows and empty tables."""

import hashlib
import random

from pyspark.sql import functions as F

from graphloom.operators import views


def test_slots(spark):
    rng = random.Random(1)
    for saved in ({}, {"a": 0, "b": 2, "c": 3, "d": 9}, {"b": 1}, {f"s{i}": rng.randrange(30) for i in range(12)}):
        ids = [f"n{i:02d}" for i in range(15)] + list(saved)
        want, free = dict(saved), iter(sorted(set(range(100)) - set(saved.values())))
        for x in sorted(set(ids) - set(saved)):
            want[x] = next(free)
        got = views.slots(spark.createDataFrame(list(saved.items()), "id string, slot long"), spark.createDataFrame([(x,) for x in [*ids, None, "n03"]], "id string"))
        assert {r["id"]: r["slot"] for r in got.collect()} == want


def test_nearest(spark):
    rng = random.Random(2)
    rows = [(f"n{i}", f"n{rng.randrange(i)}" if i and rng.random() < 0.95 else None, rng.choice("abbbb")) for i in range(120)]
    rows += [("x", "y", "b"), ("y", "x", "b"), ("z", "x", "b"), ("p", "q", "a"), ("q", "p", "b"), ("o", "gone", "b")]
    up = {i: (p, k) for i, p, k in rows}

    def walk(x):
        seen = set()
        while (x := up[x][0]) in up and x not in seen:
            seen.add(x)
            if up[x][1] == "a":
                return x
        return None

    df = spark.createDataFrame([*rows, (None, "n0", "a")], "id string, parent_id string, kind string").withColumn("to", F.lit(1))
    assert {r["id"]: r["ancestor"] for r in views.nearest(df, ["a"]).collect()} == {i: walk(i) for i in up}
    assert views.nearest(df.limit(0), ["a"]).count() == 0


def test_overlapping(spark):
    rng = random.Random(3)
    rows = [(rng.choice("fg"), f"i{i}", a, a + rng.randrange(-2, 200)) for i, a in enumerate(rng.randrange(1, 400) for _ in range(60))] + [("f", "n1", None, 3), ("f", "n2", 3, None), (None, "n3", 1, 9)]
    df = spark.createDataFrame(rows, "file_id string, id string, start_line long, end_line long")
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] and x[0] == y[0] and None not in x + y and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]}
    got = [tuple(r) for r in views.overlapping(df, df, ["file_id"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sets_and_repairs(spark):
    a, b = spark.createDataFrame([("k", "1"), ("k", "1"), ("k", None), ("l", "2")], "k string, v string"), spark.createDataFrame([("k", "1"), ("l", "3"), ("l", None)], "k string, v string")
    assert {tuple(r) for r in views.symmetric_difference(a, b).collect()} == {("k", None, "left"), ("l", "2", "left"), ("l", "3", "right"), ("l", None, "right")}
    assert {tuple(r) for r in views.set_changes(a, b, "k", ["v"]).collect()} == {("k", 1, 0), ("l", 1, 2)}
    lists = spark.createDataFrame([("a", ["1", "2", "1", None]), ("b", []), ("c", None), ("d", ["3"])], "id string, ids array<string>").withColumnRenamed("id", "key")
    gone = spark.createDataFrame([("1",), ("1",), ("9",)], "id string")
    got = {r["key"]: (r["ids"], r["stale"]) for r in views.without_retired(lists, "key", "ids", gone).collect()}
    assert got == {"a": (["2", None], True), "b": ([], False), "c": (None, False), "d": (["3"], False)}
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("d", "e"), ("a", None)], "src string, dst string")
    near = views.neighbourhood(edges, spark.createDataFrame([("a",), (None,), ("a",)], "id string"))
    assert {tuple(r) for r in near.collect()} == {("a", True), ("b", False), ("c", False)}


def test_guarded_reads(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    big = "x" * (views.READ_BYTES + 1)
    texts = spark.createDataFrame([(sha("hé"), "hé"), ("00", "other"), (sha(big), big), (sha(""), "")], "sha256 string, content string")
    sources = spark.createDataFrame([("ok", sha("hé")), ("bad", "00"), ("none", "11"), ("null", None), ("big", sha(big)), ("empty", sha(""))], "id string, sha256 string").withColumn("content", F.lit("own"))
    got = {r["id"]: (r["state"], r["content"]) for r in views.verified_texts(sources, texts).collect()}
    assert got == {"ok": ("read", "hé"), "bad": ("changed", None), "none": ("absent", None), "null": ("absent", None), "big": ("too_large", None), "empty": ("read", "")}
    spans = spark.createDataFrame([("a", "k", 1, 2, sha("one\ntwo")), ("b", "k", 2, 2, "zz"), ("c", "k", 3, 9, None), ("d", "k", 0, 1, None), ("e", "gone", 1, 1, None), ("f", "k", 3, 3, None)], "id string, key string, start_line long, end_line long, sha string")
    got = {r["id"]: r["state"] for r in views.span_texts(spans, spark.createDataFrame([("k", "one\r\ntwo\nthree")], "key string, content string")).collect()}
    assert got == {"a": "read", "b": "changed", "c": "outside", "f": "read"}


def test_columns(spark):
    df = spark.createDataFrame([("é" * 300, 5), ("short", None), (None, 7)], "s string, n long")
    got = df.select(views.shortened("s").alias("i"), views.bounded_text("s", 3).alias("b"), views.cursor("s", "n").alias("c"), views.failure_kind("s", {"brief": ["SHO"]}).alias("k")).collect()
    assert [r["i"] for r in got] == ["sha256:" + hashlib.sha256(("é" * 300).encode()).hexdigest(), "short", None]
    assert [(r["b"]["text"], r["b"]["truncated"]) for r in got] == [("ééé", True), ("sho", True), (None, False)]
    assert [r["k"] for r in got] == ["other", "brief", None] and not any(set(r["c"]) & set("+/=") for r in got)
    back = df.select("s", "n", views.cursor("s", "n").alias("c")).select("s", "n", views.cursor_fields("c", "s string, n long").alias("x")).collect()
    assert all((r["x"]["s"], r["x"]["n"]) == (r["s"], r["n"]) for r in back)
    assert spark.createDataFrame([("no cursor!",)], "c string").select(views.cursor_fields("c", "n long").alias("x")).first()["x"] in (None, (None,))


def test_reports(spark):
    src = spark.createDataFrame([("a", None, "read", True), ("b", True, None, True), ("c", True, "read", None), ("d", True, "read", True), ("d", False, None, None)], "p string, included boolean, read_state string, symbols_complete boolean")
    got = {r["p"]: r["status"] for r in views.completion(src, "p").collect()}
    assert got == {"a": "inventory_incomplete", "b": "partial", "c": "coverage_with_unresolved_relations", "d": "complete"}
    bad = spark.createDataFrame([("r", f"{i:03d}") for i in range(100)] + [("q", None)], "rule string, record_id string")
    rows = views.issues(bad, 40).collect()
    assert len(rows) == 41 and {r["n"] for r in rows} == {100, 1}
    tasks = spark.createDataFrame([("a", "queued"), ("b", "done"), ("c", "queued"), ("d", None), ("e", "queued")], "id string, state string")
    needs = spark.createDataFrame([("a", "b"), ("c", "a"), ("e", None), ("c", "b")], "id string, needs_id string")
    assert {r["id"] for r in views.ready(tasks, needs).collect()} == {"a", "e"}
    scope = views.scope_report(spark.createDataFrame([("r", "r"), ("a", "r"), ("s", "s"), ("z", None)], "id string, root_id string"), spark.createDataFrame([("a", "r"), ("a", "s"), ("a", "s"), ("a", "name:x"), ("z", "a"), ("a", None)], "src string, dst string"))
    assert {tuple(r) for r in scope.collect()} == {("r", 2, 5, 2, 2), ("s", 1, 0, 0, 0)}
    fresh = views.with_freshness(spark.createDataFrame([("a",), (None,)], "k string"), "k", spark.createDataFrame([("a",), ("a",)], "id string"))
    assert {tuple(r) for r in fresh.collect()} == {("a", "stale"), (None, "current")}


def test_sync_plan(spark):
    file = "id string, sha256 string, state string"
    known = spark.createDataFrame([("same", "1", "parsed"), ("moved", "1", "parsed"), ("failed", "1", "unavailable"), ("gone", "1", "parsed")], file)
    found = spark.createDataFrame([("same", "1"), ("moved", "2"), ("failed", "1"), ("new", "9")], "id string, sha256 string")
    node = "id string, name string, body_sha string"
    old = spark.createDataFrame([("a", "a", "1"), ("b", "b", "1"), ("c", "c", "1"), ("d", "d", "1")], node)
    new = spark.createDataFrame([("a", "a", "2"), ("b", "b2", "1"), ("c", "c", "1"), ("e", "e", "1")], node)
    calls = spark.createDataFrame([("c", "a"), ("a", "a"), ("x", "a"), ("c", "b")], "src string, dst string")
    got = {tuple(r) for r in views.sync_plan(known, found, old, new, calls, ["name"]).collect()}
    assert got == {("reconcile", "same", "reuse"), ("reconcile", "moved", "parse"), ("reconcile", "failed", "parse"), ("reconcile", "gone", "drop"), ("reconcile", "new", "parse"), ("persist", "a", "modified"), ("persist", "b", "modified"), ("persist", "d", "deleted"), ("persist", "e", "added"), ("invalidate", "a", "stale"), ("invalidate", "c", "suspect"), ("invalidate", "x", "suspect"), ("enqueue", "a", "queued"), ("enqueue", "c", "queued")}
    none = [df.limit(0) for df in (known, found, old, new, calls)]
    assert views.sync_plan(*none, ["name"]).count() == 0
