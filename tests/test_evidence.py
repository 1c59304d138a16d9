"""Record-graph operators and the API."""

import pytest

from graphloom.api import CodeGraph
from graphloom.operators import evidence as E


def test_violations_and_retirement(spark):
    sources = spark.createDataFrame([("s1",), ("s2",)], "id string")
    entities = spark.createDataFrame([("e1", ["s1", "s2"]), ("e2", ["s1", "s1"]), ("e3", ["zz", None]), ("e3", None)], "id string, source_ids array<string>")
    ports = spark.createDataFrame([("p1", "e1"), ("p2", "e2"), ("p3", None), ("p4", "nope")], "id string, entity_id string")
    tables = {"sources": sources, "entities": entities, "ports": ports}
    many, one = E.Reference("entities", "source_ids", "sources", True), E.Reference("ports", "entity_id", "entities")
    got = {tuple(r) for r in E.violations(tables, [many, one]).collect()}
    assert got == {("entities", "e3", "source_ids", "missing", "zz"), ("entities", "e2", "source_ids", "repeated", "s1"), ("ports", "p4", "entity_id", "missing", "nope"), ("entities", "e3", "id", "duplicate", "e3")}
    gone = spark.createDataFrame([("sources", "s1")], "table string, id string")
    assert {tuple(r) for r in E.retired(tables, gone, [one], [many]).collect()} == {("sources", "s1"), ("entities", "e2"), ("ports", "p2")}


def test_links(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    assert not E.circular(links) and E.circular(links.unionByName(spark.createDataFrame([("c", "a")], "src string, dst string")))
    assert {r["id"] for r in E.reached(links, spark.createDataFrame([("a",)], "id string")).collect()} == {"a", "b", "c"}
    rel = spark.createDataFrame([("call", "f", "g"), ("data", "p", "q")], "kind string, from_id string, to_id string")
    assert {tuple(r) for r in E.impact_links(rel).collect()} == {("g", "f"), ("p", "q")}
    spans = "source_id string, kind string, name string, id string, start_line long, end_line long"
    outer = spark.createDataFrame([("s", "k", "n", "o1", 1, 10), ("s", "k", "m", "o2", 1, 5), ("s", "k", "m", "o3", 1, 9)], spans)
    inner = spark.createDataFrame([("s", "k", "n", "i1", 2, 3), ("s", "k", "m", "i2", 2, 3)], spans)
    assert [tuple(r) for r in E.matched_by_range(outer, inner).collect()] == [("o1", "i1")]


def test_imports(spark):
    files = spark.createDataFrame([("g", f"f{i}", p) for i, p in enumerate(["a/b.py", "a/__init__.py", "a/c/d.py", "x.py", "a/c/__init__.py"])], "group_id string, id string, path string")
    sites = spark.createDataFrame([(1, "g", "a/c/d.py", "from . import e, d"), (2, "g", "a/c/d.py", "from ..b import z"), (3, "g", "q.py", "import x"), (4, "g", "q.py", "from a import b as k"), (5, "g", "q.py", "import a.c.d as y"), (6, "g", "q.py", None)], "site_id long, group_id string, path string, text string")
    got = {tuple(r) for r in E.import_candidates(sites, files).collect()}
    assert got == {(1, "f4", "package"), (1, "f2", "member"), (2, "f0", "module"), (3, "f3", "module"), (4, "f1", "package"), (4, "f0", "member"), (5, "f2", "module")}


def test_api(spark):
    files = spark.createDataFrame([("f", "p", "src/a.py", "1", "python", "parsed", "x")], "id string, project_id string, path string, sha256 string, language string, state string, updated_at string")
    node = "id string, file_id string, kind string, name string, qualified_name string, parent_id string, start_line long, end_line long, signature string, body_sha string, degree long, updated_at string"
    nodes = spark.createDataFrame([("n1", "f", "function", "load", "load", None, 1, 2, "load(path)", "b", 0, None), ("n2", "f", "function", "load_all", "K.load_all", None, 3, 9, "load_all(paths)", "b", 1, None), ("n3", "gone", "function", "save", "save", None, 1, 1, "save()", "b", 5, None)], node)
    edges = spark.createDataFrame([(1, "n1", "n2", "call", "resolved_local", 1), (2, "zz", "n9", "call", "ambiguous", 2), (3, "n2", "name:q", "call", "unresolved", 3)], "edge_id long, src_id string, dst_id string, kind string, confidence string, site_line long")
    g = CodeGraph(files, nodes, edges)
    assert [r["id"] for r in g.find_symbol("load").collect()] == ["n1"]
    assert {r["id"] for r in g.find_symbol("LOAD", fuzzy=True).collect()} == {"n1", "n2"}
    assert [(r["src"], r["level"]) for r in g.callers("K.load_all", 2).edges.collect()] == [("n1", 1)]
    assert [r["dst"] for r in g.callees("load", 2).edges.collect()] == ["n2", "name:q"]
    assert [r["id"] for r in g.search("paths").collect()] == ["n2"]
    assert [r["id"] for r in g.repo_map(30).collect()] == ["n2"]
    assert {r["check"]: r["n"] for r in g.doctor().collect()} == {"dangling_source": 1, "dangling_target": 1, "degree_differs": 1, "file_missing": 1}
    for bad in (lambda: g.callers("load", 4), lambda: g.repo_map(-1), lambda: g.find_symbol("x", limit=0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(LookupError):
        g.callers("nothing")
    assert [r["id"] for r in E.records(nodes, name="save").collect()] == ["n3"]
