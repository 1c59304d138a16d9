"""Queries on hierarchies, orphan references and snapshots (problems 3, 5 and 6), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hierarchy, references, snapshots
from graphloom.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.circles(table(spark, d, "nodes"))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.hierarchy(table(spark, d, "nodes"))
    return tree.select("node_id", "root_id", "depth", F.array_join("path", "/").alias("path"), "cycle_id")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, d, "nodes")))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.code_graph_orphans(table(spark, d, "nodes"), table(spark, d, "files"), table(spark, d, "edges"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "field_name", "record_id", "ref_id")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    found = _orphans(spark, d).withColumn("period", F.date_format("happened_at", "yyyy-MM"))
    return references.orphan_counts(found, ["table_name", "field_name", "period"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    changes = snapshots.map_changes(table(spark, d, "snapshot_history"), table(spark, d, "sample_map"))
    return changes.select("project_id", "from_revision", "to_revision", "path", "change_kind")


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_descendants, p5_found, p5_counts, p6_found)}

_NODES = """cur AS (SELECT id, parent_id, file_id, name, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY updated_at DESC NULLS LAST, parent_id DESC NULLS LAST) rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)"""
_TREE = f"""{_NODES},
tree AS (SELECT c.id, c.id AS root_id, 0 AS depth, coalesce(c.name, '') AS path, [c.id] AS ids FROM cur c
    WHERE c.parent_id IS NULL OR c.parent_id NOT IN (SELECT id FROM cur)
  UNION ALL SELECT c.id, t.root_id, t.depth + 1, t.path || '/' || coalesce(c.name, ''), list_append(t.ids, c.id)
    FROM cur c JOIN tree t ON c.parent_id = t.id)"""
_CIRCLES = """loose AS (SELECT id, parent_id FROM cur WHERE id NOT IN (SELECT id FROM tree)),
walk AS (SELECT id AS node_id, parent_id AS here, [id] AS path FROM loose
  UNION ALL SELECT w.node_id, l.parent_id, list_append(w.path, l.id) FROM walk w JOIN loose l ON w.here = l.id WHERE NOT list_contains(w.path, w.here)),
rings AS (SELECT node_id, list_min(path[list_position(path, here):]) AS cycle_id FROM walk WHERE list_contains(path, here))"""
_ORPHANS = f"""WITH {_NODES},
orphans AS (
  SELECT 'nodes' AS table_name, 'file_id' AS field_name, id AS record_id, file_id AS ref_id, strftime(CAST(updated_at AS TIMESTAMP), '%Y-%m') AS period
    FROM cur WHERE file_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.id = cur.file_id)
  UNION SELECT 'edges', 'src_id', CAST(edge_id AS VARCHAR), src_id, strftime(recorded_at, '%Y-%m') FROM edges e
    WHERE src_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.src_id) AND NOT EXISTS (SELECT 1 FROM files f WHERE f.id = e.src_id)
  UNION SELECT 'edges', 'dst_id', CAST(edge_id AS VARCHAR), dst_id, strftime(recorded_at, '%Y-%m') FROM edges e
    WHERE dst_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.dst_id)
      AND NOT (starts_with(dst_id, 'name:') AND confidence IS NOT DISTINCT FROM 'unresolved'))"""

SQL = {
    "p3_found": f"WITH RECURSIVE {_TREE}, {_CIRCLES} SELECT node_id, cycle_id FROM rings",
    "p3_hierarchy": f"""WITH RECURSIVE {_TREE}, {_CIRCLES}
SELECT id AS node_id, root_id, CAST(depth AS BIGINT) AS depth, path, CAST(NULL AS VARCHAR) AS cycle_id FROM tree
UNION ALL SELECT node_id, NULL, NULL, NULL, cycle_id FROM rings""",
    "p3_descendants": f"""WITH RECURSIVE {_TREE}, steps AS (SELECT id, depth, unnest(ids) AS node_id, unnest(range(len(ids))) AS place FROM tree)
SELECT node_id, id AS descendant_id, CAST(depth - place AS BIGINT) AS distance FROM steps WHERE node_id <> id""",
    "p5_found": f"{_ORPHANS} SELECT table_name, field_name, record_id, ref_id FROM orphans",
    "p5_counts": f"""{_ORPHANS} SELECT table_name, field_name, period, count(*) AS n_orphans, count(DISTINCT ref_id) AS n_missing_keys
FROM orphans GROUP BY ALL""",
    "p6_found": """WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delivered_at DESC NULLS LAST) rn FROM sample_map) WHERE rn = 1),
docs AS (SELECT DISTINCT project_id, revision, unnest(from_json(json_extract(document, '$.sources'), '[{"path":"VARCHAR","sha256":"VARCHAR"}]')) AS s FROM snapshot_history),
entries AS (
  SELECT project_id, 0 AS latest, revision, nfc_normalize(regexp_replace(replace(s.path, '\\', '/'), '^(\\./+)+', '')) AS path, max(lower(s.sha256)) AS sha FROM docs GROUP BY ALL
  UNION ALL SELECT project_id, 1, max(revision) OVER (PARTITION BY project_id), nfc_normalize(regexp_replace(replace(path, '\\', '/'), '^(\\./+)+', '')), lower(sha256) FROM cur),
chain AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY latest, revision) AS k FROM (
  SELECT project_id, 0 AS latest, revision FROM snapshot_history UNION SELECT DISTINCT project_id, latest, revision FROM entries)),
e AS (SELECT * FROM entries JOIN chain USING (project_id, latest, revision)),
gone AS (SELECT a.project_id, a.revision AS from_revision, c.revision AS to_revision, a.path, a.sha, b.sha AS new_sha, b.path AS new_path
  FROM e a JOIN chain c ON c.project_id = a.project_id AND c.k = a.k + 1 LEFT JOIN e b ON b.project_id = a.project_id AND b.k = a.k + 1 AND b.path = a.path)
SELECT project_id, from_revision, to_revision, path, CASE WHEN new_path IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM gone WHERE new_path IS NULL OR sha IS DISTINCT FROM new_sha
UNION ALL SELECT b.project_id, c.revision, b.revision, b.path, 'added' FROM e b JOIN chain c ON c.project_id = b.project_id AND c.k = b.k - 1
  WHERE NOT EXISTS (SELECT 1 FROM e a WHERE a.project_id = b.project_id AND a.k = b.k - 1 AND a.path = b.path)""",
}
