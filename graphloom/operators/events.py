"""Reports on a log of tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ordered import with_previous


def once(calls: DataFrame, columns: list[str]) -> DataFrame:
    """Each call once: of rows with the same id, the greatest in columns."""
    return calls.groupBy("id").agg(F.max(F.struct(*columns)).alias("_r")).select("id", "_r.*")


def number(c: str) -> Column:
    """A measured value, or null if it is no number or negative."""
    return F.when(~F.isnan(c) & (F.col(c) >= 0), F.col(c))


def gaps_between(calls: DataFrame) -> DataFrame:
    """id, session and gap: milliseconds between the end of the call before in the session (by id) and this one's start,
    at least 0, null for the first and after a call that didn't end."""
    rows = with_previous(once(calls, ["session", "started", "ended"]), ["session"], ["id"], ["ended"])
    return rows.select("id", "session", F.round(F.greatest(F.lit(0.0), (F.col("started") - F.col("ended_before")) * 1000), 3).alias("gap"))


def repeats(calls: DataFrame) -> DataFrame:
    """id, repeated (an earlier call of the session had the same fingerprint) and retried (the last such call failed)."""
    rows = with_previous(once(calls, ["session", "fingerprint", "status"]).where("fingerprint is not null"), ["session", "fingerprint"], ["id"], ["id", "status"])
    return rows.select("id", F.col("id_before").isNotNull().alias("repeated"), F.coalesce((F.col("status_before") == "error"), F.lit(False)).alias("retried"))


def totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: calls, failed and unfinished ones, batches, time and bytes, first start and last end."""
    rows = once(calls, ["session", "phase", "tool", "task_id", "status", "elapsed_ms", "batch_id", "input_bytes", "output_bytes", "started", "ended"])
    ms = number("elapsed_ms")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_calls"),
        F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("ended").isNull(), 1).otherwise(0)).alias("n_open"),
        F.countDistinct("batch_id").alias("n_batches"),
        F.coalesce(F.sum(ms.cast("decimal(18,3)")), F.lit(0)).cast("double").alias("tool_ms"),
        F.coalesce(F.sum("input_bytes"), F.lit(0)).alias("input_bytes"),
        F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("output_bytes"),
        F.min("started").alias("first_start"),
        F.max(F.coalesce("ended", "started")).alias("last_end"),
    )
