"""Orphan references and snapshot changes."""

import json
import random

from graphloom.operators import references as R
from graphloom.operators import snapshots as S


def test_orphans_hot_keys_and_limits(spark, monkeypatch):
    refs = [("k1",)] * 500 + [("k2",)] * 3 + [("p",)] * 4 + [(None,)] * 2 + [("P",)]
    df = spark.createDataFrame(refs, "ref_id string")
    parents = spark.createDataFrame([("p",), ("p",), (None,)], "id string")
    count = lambda: {r["ref_id"]: r["n"] for r in R.orphans(df, parents).groupBy("ref_id").count().withColumnRenamed("count", "n").collect()}
    want = {"k1": 500, "k2": 3, "P": 1}
    assert count() == want
    monkeypatch.setattr(R, "small", lambda df: False)
    monkeypatch.setattr(R, "HOT_KEYS", 1)
    assert count() == want
    assert {r["ref_id"]: r["n"] for r in R.missing_keys(df, parents).collect()} == want


def test_orphans_empty(spark):
    none = spark.createDataFrame([], "ref_id string")
    ids = spark.createDataFrame([], "id string")
    assert R.orphans(none, ids).count() == 0
    assert R.orphans(spark.createDataFrame([("a",)], "ref_id string"), ids).count() == 1


def test_code_graph_orphans(spark):
    nodes = spark.createDataFrame([("n1", "f1", "2025"), ("n1", "gone", "2024"), ("n2", "gone", None), ("n3", None, None)], "id string, file_id string, updated_at string")
    files = spark.createDataFrame([("f1",)], "id string")
    edges = spark.createDataFrame([(1, "n1", "n2", "unresolved"), (1, "n1", "n2", "unresolved"), (2, "f1", "name:x", "unresolved"), (3, "zz", "name:x", "ambiguous"), (4, "n1", "name:y", None), (5, None, "f1", "x"), (6, "n1", None, None)], "edge_id long, src_id string, dst_id string, confidence string").selectExpr("*", "timestamp_ntz'2025-01-02' as recorded_at")
    got = {tuple(r)[:4] for r in R.code_graph_orphans(nodes, files, edges).collect()}
    assert got == {("nodes", "file_id", "n2", "gone"), ("edges", "src_id", "3", "zz"), ("edges", "dst_id", "3", "name:x"), ("edges", "dst_id", "4", "name:y"), ("edges", "dst_id", "5", "f1")}


def brute(history, current):
    """Changes between consecutive snapshots, by dictionaries."""
    projects = {}
    for p, r, entries in history:
        snap = projects.setdefault(p, {}).setdefault((0, r), {})
        for path, sha in entries:
            path, sha = S.normal_path(path), sha.lower()
            snap[path] = max(sha, snap.get(path, ""))
    for p, r, path, sha in current:
        projects.setdefault(p, {})
    last = {}
    for p, r, path, sha in current:
        last[p] = max(r, last.get(p, r))
    for p, r, path, sha in current:
        projects[p].setdefault((1, last[p]), {})[S.normal_path(path)] = sha.lower()
    out = set()
    for p, snaps in projects.items():
        order = sorted(snaps)
        for a, b in zip(order, order[1:]):
            x, y = snaps[a], snaps[b]
            for path in {*x, *y}:
                kind = "added" if path not in x else "removed" if path not in y else "changed" if x[path] != y[path] else None
                if kind:
                    out.add((p, a[1], b[1], path, kind))
    return out


def test_snapshot_changes(spark):
    rng = random.Random(5)
    history, current = [], []
    for p in ("p1", "p2", "big", "only"):
        revisions = sorted(rng.sample(range(50), 1 if p == "only" else 6))
        for r in revisions:
            history.append((p, r, [(rng.choice(["./", "", ""]) + rng.choice(["a/b.py", "a\\b.py", "c.py", "d/e.py", "a/é.py", "a/é.py", "C.py"]), rng.choice(["AB", "ab", "cd"])) for _ in range(rng.randrange(1, 8))]))
        for i, path in enumerate(rng.sample(["a/b.py", "c.py", "x.py"], 2)):
            current.append((p, 60 + i, path, rng.choice(["ab", "CD"])))
    rng.shuffle(history)
    docs = [(p, r, json.dumps({"project": {}, "sources": [{"path": a, "sha256": b} for a, b in e]})) for p, r, e in history]
    docs += docs[:2] + [("p1", 1000, None), ("p1", 1001, "no json"), ("p1", 1002, '{"sources": 3}')]
    docs = [d for d in docs if d[1] < 1000] + [("empty", 1, '{"sources": []}')]
    h = spark.createDataFrame(docs, "project_id string, revision long, document string")
    m = spark.createDataFrame([(f"{p}{path}", p, r, path, s) for p, r, path, s in current], "id string, project_id string, revision long, path string, sha256 string").selectExpr("*", "timestamp_ntz'2025-01-02' as delivered_at")
    got = [(r["project_id"], r["from_revision"], r["to_revision"], r["path"], r["change_kind"]) for r in S.map_changes(h, m).collect()]
    want = brute(history, current)
    assert len(got) == len(set(got)) and set(got) == want


def test_snapshot_batches(spark):
    """Arrow batches of two rows: keys continue from batch to batch, repeats as well."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        test_snapshot_changes(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_snapshots_bad_documents_and_empty(spark):
    h = spark.createDataFrame([("p", 0, '{"sources": []}'), ("p", 1, None), ("p", 2, "{"), ("p", 3, '{"sources": [{"path": "a", "sha256": null}, {"path": 3}, 5]}')], "project_id string, revision long, document string")
    m = spark.createDataFrame([], "id string, project_id string, revision long, path string, sha256 string, delivered_at timestamp_ntz")
    got = {tuple(r)[1:5] for r in S.map_changes(h, m).collect()}
    assert got == {(0, 3, "a", "added")}  # what 1 and 2 held is unknown, so nothing is said to have gone
    assert {r["revision"] for r in S.bad_documents(h.selectExpr("*", "'s' as snapshot_id")).collect()} == {1, 2}
    assert S.map_changes(h.limit(0), m).count() == 0
