"""Queries on texts and measurements (problems 1, 2, 4, 7, 8 and 9), with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, handwritten, mojibake, packing, quantiles
from graphloom.llm.syntax import files as syntax
from graphloom.session import materialize, table

SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _not_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.find_not_handwritten(table(spark, d, "sample_map"), table(spark, d, "source_texts"), table(spark, d, "upstream_files"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _not_handwritten(spark, d).select("source_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _not_handwritten(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The files whose repair has a cost."""
    return p2_damage(spark, d).where("cost > 0").select("file_id")


def p2_damage(spark: SparkSession, d: str) -> DataFrame:
    found = syntax.invalid_files(syntax.current_files(table(spark, d, "files")), table(spark, d, "source_texts"))
    return found.select(F.col("id").alias("file_id"), "project_id", "path", "syntax", "cost", "damage", "line", "exact")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(materialize(syntax.current_files(table(spark, d, "files"))), table(spark, d, "source_texts"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.summarize(quantiles.calls_once(table(spark, d, "calls")), ["tool", "phase", "day"], "elapsed_ms")


def p4_daily(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(_daily(spark, d), ["tool", "phase", "day"], SHARES)


def p4_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What is kept of each day to be combined later: of tool, phase and day the values of the summary, each with the number
    of values it stands for."""
    return quantiles.weighted_values(_daily(spark, d), ["tool", "phase", "day"])


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(quantiles.combine(_daily(spark, d), ["tool", "phase"]), ["tool", "phase"], SHARES)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_with_texts(table(spark, d, "documents").select("doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, d, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, d, "documents")).select("doc_id", "restored", "fully", "steps")


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p2_found, p2_damage, p2_rates, p4_summaries, p4_percentiles, p4_daily, p7_ids, p8_containers, p9_found, p9_restored)}


def _exact(keys: str) -> str:
    shares = ", ".join(f"max(CASE WHEN k = greatest(1, CAST(ceil({q} * n - 1e-9) AS BIGINT)) THEN elapsed_ms END) AS {c}" for c, q in SHARES.items())
    return f"""WITH once AS (SELECT id, max(elapsed_ms) AS elapsed_ms, max(tool) AS tool, max(phase) AS phase,
    CAST(make_timestamp(CAST(floor(max(started)) AS BIGINT) * 1000000) AS DATE) AS day
  FROM calls WHERE elapsed_ms >= 0 AND NOT isnan(elapsed_ms) GROUP BY id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY elapsed_ms) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM once)
SELECT {keys}, n, {shares}, CAST(0 AS DOUBLE) AS max_rank_error FROM ranked GROUP BY {keys}, n"""


#: Up to quantiles.SIZE values a group's summary and percentiles are exact; SQL has the exact ones.
SQL = {
    "p4_summaries": """WITH once AS (SELECT id, max(elapsed_ms) AS elapsed_ms, max(tool) AS tool, max(phase) AS phase,
    CAST(make_timestamp(CAST(floor(max(started)) AS BIGINT) * 1000000) AS DATE) AS day
  FROM calls WHERE elapsed_ms >= 0 AND NOT isnan(elapsed_ms) GROUP BY id)
SELECT tool, phase, day, elapsed_ms AS value, count(*) AS weight, CAST(0 AS DOUBLE) AS max_rank_error FROM once GROUP BY ALL""",
    "p4_percentiles": _exact("tool, phase"),
    "p4_daily": _exact("tool, phase, day"),
}
