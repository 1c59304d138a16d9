"""The hierarchy operator against walking the parents row by row."""

import random

import pytest

from graphloom.operators import hierarchy as H

SCHEMA = "id string, parent_id string, file_id string, name string, start_line long, updated_at string"


def expected(rows):
    """id -> (root, depth, path) or the least id of the circle."""
    parent = {r[0]: r[1] for r in rows}
    name = {r[0]: r[3] or "" for r in rows}
    out = {}
    for x in parent:
        seen, at = {}, x
        while at in parent and at not in seen:
            seen[at] = len(seen)
            at = parent[at]
        if at in seen:
            out[x] = min(y for y, k in seen.items() if k >= seen[at])
        else:
            chain = sorted(seen, key=seen.get, reverse=True)
            out[x] = (chain[0], len(chain) - 1, [name[y] for y in chain])
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in H.hierarchy(df).collect():
        got[r["node_id"]] = r["cycle_id"] if r["cycle_id"] is not None else (r["root_id"], r["depth"], list(r["path"]))
    want = expected(rows)
    assert got == want
    assert {(r["node_id"], r["cycle_id"]) for r in H.circles(df).collect()} == {(k, v) for k, v in want.items() if isinstance(v, str)}
    pairs = {(r["node_id"], r["descendant_id"], r["distance"]) for r in H.descendants(H.hierarchy(df)).collect()}
    parent = {r[0]: r[1] for r in rows}
    true = set()
    for x, v in want.items():
        if not isinstance(v, str):
            at, k = parent[x], 1
            while at in parent:
                true.add((at, x, k))
                at, k = parent[at], k + 1
    assert pairs == true


def forest(seed, n, circles=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = rng.choice([None, f"gone{i}", *[f"n{rng.randrange(n if circles else max(1, i))}" for _ in range(8)]])
        rows.append((f"n{i}", p if p != f"n{i}" or circles else None, f"f{rng.randrange(5)}" if rng.random() < 0.9 else None, rng.choice(["a", "b", None]), rng.randrange(100), "2025"))
    return rows


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 150)])
def test_random(spark, seed, n):
    check(spark, forest(seed, n))


def test_long_chain_one_file(spark):
    rows = [(f"n{i:04d}", f"n{i - 1:04d}" if i else None, "f", "x", 7, None) for i in range(700)]
    check(spark, rows)


@pytest.mark.parametrize("merge,fan", [(3, 2), (0, 2), (10, 100)])
def test_levels_and_doubling(spark, monkeypatch, merge, fan):
    """Small limits take the same rows through grouped merging and through doubling."""
    monkeypatch.setattr(H, "MERGE_ROWS", merge)
    monkeypatch.setattr(H, "FAN", fan)
    monkeypatch.setattr(H, "LOCAL_ROWS", 10)
    check(spark, forest(3, 60))
    check(spark, [(f"n{i:02d}", f"n{(i + 1) % 30:02d}", f"f{i % 7}", "x", i, None) for i in range(30)] + [("t1", "n05", "f1", "y", 1, None), ("t2", "t1", "f2", "z", 2, None)])


def test_current_rows_nulls_and_empty(spark):
    rows = [("a", None, "f", "a", 1, "2025-02"), ("a", "b", "f", "a", 1, "2025-01"), ("b", "a", None, None, None, None), ("b", "a", None, None, None, None), (None, "a", "f", "n", 1, None), ("self", "self", "f", "s", 1, None)]
    tree = {r["node_id"]: r for r in H.hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(tree) == {"a", "b", "self"}
    assert tree["b"]["root_id"] == "a" and tree["b"]["depth"] == 1 and list(tree["b"]["path"]) == ["a", ""]
    assert tree["self"]["cycle_id"] == "self" and tree["self"]["path"] is None
    assert H.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.circles(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns(spark):
    rows = [("a", None, "f", "a", 1, None, "x", 3), ("b", "a", "f", "b", 2, None, "y", 4)]
    df = spark.createDataFrame(rows, SCHEMA + ", parent string, rep long")
    assert H.hierarchy(df).count() == 2
