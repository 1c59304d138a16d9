"""Tree scan, parsing, versioned store and streams."""

import os

import pytest

from graphloom.sources import store as st
from graphloom.sources import tree
from graphloom.streaming import calls as stream

CODE = '''import os
from a import b as c

class K(Base):
    @deco
    def m(self, x=1):
        return helper(x) + self.n()

    def n(self):
        def inner():
            pass
        return inner()

def helper(x):
    return os.path.join(x)

def helper(x):
    return 2
'''


def test_parse_python():
    symbols, sites = tree.parse_python("f", CODE)
    assert [(s["kind"], s["qualified_name"], s["start_line"], s["end_line"]) for s in symbols] == [("class", "K", 4, 12), ("method", "K.m", 5, 7), ("method", "K.n", 9, 12), ("function", "K.n.inner", 10, 11), ("function", "helper", 14, 15), ("function", "helper", 17, 18)]
    assert len({s["id"] for s in symbols}) == 6
    assert {(s["kind"], s["target_name"]) for s in sites} == {("import", "import os"), ("import", "from a import b as c"), ("call", "helper"), ("call", "self.n"), ("call", "inner"), ("call", "os.path.join")}
    moved, _ = tree.parse_python("f", "# note\n\n" + CODE.replace("return 2", "return 3"))
    assert [s["id"] for s in moved] == [s["id"] for s in symbols]
    assert [s["semantic_sha"] == t["semantic_sha"] for s, t in zip(symbols, moved)] == [True] * 5 + [False]
    assert all(s["contract_sha"] == t["contract_sha"] for s, t in zip(symbols, moved))
    bad, none = tree.parse_python("f", "def (:")
    assert bad[0]["state"] == "unavailable" and none == []


def test_scan(spark, tmp_path):
    for name, data in {"src/a.py": b"\xef\xbb\xbfx = 1\n", "b.bin": b"a\0b", "u.txt": "hé".encode("utf-16"), ".git/config": b"x", "node_modules/x.js": b"y", "empty.md": b"", "bad.txt": b"\xff\xfe"[:1]}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r["path"]: r for r in tree.scan(spark, str(tmp_path), ["node_modules/**"]).collect()}
    assert set(rows) == {"src/a.py", "b.bin", "u.txt", "empty.md", "bad.txt"}
    assert rows["src/a.py"]["text"] == "x = 1\n" and rows["src/a.py"]["language"] == "python"
    assert rows["src/a.py"]["id"].startswith("file-") and len({r["id"] for r in rows.values()}) == 5
    assert rows["b.bin"]["read_state"] == "binary" and rows["u.txt"]["text"] == "hé" and rows["empty.md"]["text"] == ""
    assert rows["bad.txt"]["encoding"] is None


def test_store(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert s.read("t") is None
    assert s.publish({"t": one}, 0, ("b1", st.digest([1]))) == 1
    assert s.publish({"t": one}, 0, ("b1", st.digest([1]))) == 1
    with pytest.raises(st.Conflict):
        s.publish({"t": one}, 1, ("b1", st.digest([2])))
    with pytest.raises(st.Conflict):
        s.publish({"t": one}, 0)
    new = st.upserted(s.read("t"), spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string"), ["id"])
    assert s.publish({"t": new}, 1) == 2
    assert {tuple(r) for r in s.read("t").collect()} == {(1, "a"), (2, "B"), (3, "c")}
    assert s.read("t", 1).count() == 2 and s.versions() == [2, 1]
    more = st.inserted(s.read("t"), spark.createDataFrame([(3, "no"), (4, "y"), (4, "x")], "id long, v string"), ["id"])
    assert {tuple(r) for r in more.where("id > 2").collect()} == {(3, "c"), (4, "x")}
    assert st.without(more, spark.createDataFrame([(4,)], "id long"), ["id"]).count() == 3


def test_leases(spark):
    rows = [("a", "queued", 9, 50, None, None, None, 0), ("b", "running", 8, 40, "l", "w", 5.0, 1), ("c", "running", 7, 10, "l", "w", 50.0, 1), ("d", "queued", 6, 90, None, None, None, 0), ("e", "queued", 5, 10, None, None, None, 0)]
    cols = "node_id string, state string, priority long, estimated_tokens long, lease_id string, worker string, expires_at double, generation long"
    t = st.claimed(spark.createDataFrame(rows, cols), "me", 10.0, 60.0, 3, 100, "L")
    got = {r["node_id"]: (r["state"], r["worker"], r["generation"]) for r in t.collect()}
    assert got == {"a": ("running", "me", 1), "b": ("running", "me", 2), "c": ("running", "w", 1), "d": ("queued", None, 0), "e": ("running", "me", 1)}


def test_streams(spark, tmp_path):
    rows = [(f"2025-01-01 00:{m:02d}:00", "u", 1.0) for m in (0, 1, 2, 30, 59)]
    spark.createDataFrame(rows, "ts string, user string, value double").selectExpr("cast(ts as timestamp_ntz) ts", "user", "value").write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    want = {tuple(r) for r in stream.tumbling(batch, "ts", "10 minutes", ["user"]).collect()}
    live = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    q = stream.tumbling(live, "ts", "10 minutes", ["user"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("w").collect()} == want and len(want) == 3
    assert sorted(r["n"] for r in stream.sessions(batch, "ts", "5 minutes", ["user"]).collect()) == [1, 1, 3]
    reads = spark.createDataFrame([("s", 1, 10), ("s", 5, 12), ("t", 3, 3), ("s", 20, 20), ("s", 11, 21)], "source_id string, start_line long, end_line long").coalesce(1)
    reads.write.parquet(f"{tmp_path}/r")
    live = spark.readStream.schema(reads.schema).parquet(f"{tmp_path}/r")
    q = stream.delivered_lines(live).writeStream.format("memory").queryName("d").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination()
    got = {(r["source_id"], r["start_line"]): (r["new_lines"], r["repeated_lines"]) for r in spark.table("d").collect()}
    assert got == {("s", 1): (10, 0), ("s", 5): (2, 6), ("t", 3): (1, 0), ("s", 20): (1, 0), ("s", 11): (8, 3)}
