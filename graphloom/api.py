"""The questions one asks of a code graph, on the tables files, nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph, ordered, text
from graphloom.operators.latest import latest_per_key
from graphloom.session import materialize


class CodeGraph:
    """Current rows of files (id, path, updated_at), nodes and edges (see TESTDATA.md for their columns)."""

    def __init__(self, files: DataFrame, nodes: DataFrame, edges: DataFrame):
        self.files = latest_per_key(files, ["id"], ["updated_at"], ["project_id", "path", "sha256", "language", "state"])
        self.nodes = latest_per_key(nodes, ["id"], ["updated_at"], ["file_id", "kind", "name", "qualified_name", "parent_id", "start_line", "end_line", "signature", "body_sha", "degree"])
        self.edges = graph.distinct_edges(edges)
        self._call_rows = edges.where("kind = 'call'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "site_line", "edge_id", "confidence")
        self.calls = self.edges.where("kind = 'call'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "site_line", "confidence")

    def _located(self, nodes: DataFrame) -> DataFrame:
        return nodes.join(self.files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")

    def find_symbol(self, query: str, kind: str | None = None, fuzzy: bool = False, limit: int = 50) -> DataFrame:
        """Symbols by id, name or qualified name; with fuzzy, those whose names contain query, whatever the case."""
        if not 1 <= limit <= 500:
            raise ValueError("limit must be from 1 to 500")
        hit = F.lower("name").contains(query.lower()) | F.lower("qualified_name").contains(query.lower()) if fuzzy else (F.col("id") == query) | (F.col("name") == query) | (F.col("qualified_name") == query)
        found = self.nodes.where(hit if kind is None else hit & (F.col("kind") == kind))
        return self._located(found).orderBy("path", "start_line", "id").limit(limit)

    def _root(self, symbol: str) -> DataFrame:
        found = self.find_symbol(symbol, limit=2).select("id").collect()
        if len(found) != 1:
            raise LookupError(f"{symbol} names {'several symbols' if found else 'no symbol'}")
        return self.nodes.sparkSession.createDataFrame([(found[0]["id"],)], "id string")

    def callers(self, symbol: str, depth: int = 1, limit: int = 100) -> graph.Search:
        """What leads to a symbol in at most depth (1 to 3) calls: symbols with their distance, the first `limit` (1 to 500)
        calls with their level, and whether there were more."""
        return self._search(symbol, depth, limit, False)

    def callees(self, symbol: str, depth: int = 1, limit: int = 100) -> graph.Search:
        """As callers, along the calls."""
        return self._search(symbol, depth, limit, True)

    def _search(self, symbol: str, depth: int, limit: int, forward: bool) -> graph.Search:
        if not 1 <= depth <= 3:
            raise ValueError("depth must be from 1 to 3")
        once = lambda rows: graph.distinct_edges(rows, ["src", "dst", "site_line", "edge_id"])
        found = graph.bounded_search(self._call_rows, self._root(symbol), depth, forward, once, limit)
        known = self._located(self.nodes.join(found.nodes, "id"))
        return graph.Search(known, found.edges.drop("edge_id").orderBy("level", "src", "dst", "site_line"), found.truncated)

    def search(self, query: str, limit: int = 50) -> DataFrame:
        """Ranked full-text search over qualified names and signatures."""
        return self._located(text.search(self.nodes, "id", ["qualified_name", "signature"], query, limit).join(self.nodes, "id")).orderBy(F.desc("score"), "id")

    def repo_map(self, budget: int = 2000, prefix: str = "") -> DataFrame:
        """The most called symbols below a path prefix whose lines fit into a budget of UTF-8 bytes."""
        if not 0 <= budget <= 32_000:
            raise ValueError("budget must be from 0 to 32000")
        rows = self._located(self.nodes).where(F.col("path").startswith(prefix))
        line = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("  "), F.coalesce("signature", "qualified_name", "name", F.lit("")))
        rows = rows.select("id", "path", "start_line", line.alias("line"), (-F.col("degree")).alias("neg_degree"), (F.octet_length(line) + 1).alias("cost"))
        return ordered.within_budget(rows, [], ["neg_degree", "path", "start_line", "id"], "cost", budget)

    def doctor(self) -> DataFrame:
        """What is wrong with the graph: check and n, one row per check."""
        ids = self.nodes.select("id")
        known = materialize(ids.unionByName(self.files.select("id")).distinct())
        src = self.edges.join(known.select(F.col("id").alias("src_id")), "src_id", "left_anti")
        dst = self.edges.where("dst_id not like 'name:%'").join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_anti")
        counted = graph.in_degree(self.calls).select(F.col("dst").alias("id"), F.col("degree").alias("counted"))
        degree = self.nodes.join(counted, "id", "left").where(F.coalesce("counted", F.lit(0)) != F.coalesce("degree", F.lit(0)))
        files = self.nodes.join(self.files.select(F.col("id").alias("file_id")), "file_id", "left_anti").where("file_id is not null")
        parts = [df.agg(F.lit(name).alias("check"), F.count("*").alias("n")) for name, df in (("dangling_source", src), ("dangling_target", dst), ("degree_differs", degree), ("file_missing", files))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
