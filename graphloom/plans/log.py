"""Queries on the log of tool calls and the event table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import events
from graphloom.session import table
from graphloom.streaming import calls as stream


def call_gaps(spark: SparkSession, d: str) -> DataFrame:
    return events.gaps_between(table(spark, d, "calls"))


def call_repeats(spark: SparkSession, d: str) -> DataFrame:
    return events.repeats(table(spark, d, "calls"))


def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return events.totals(table(spark, d, "calls"), ["session"])


def phase_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return events.totals(table(spark, d, "calls"), ["phase"]).select("phase", "n_calls", "n_failed", "tool_ms")


def task_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """The 30 tasks that took longest."""
    rows = events.totals(table(spark, d, "calls").where("task_id is not null"), ["task_id"])
    return rows.orderBy(F.desc("tool_ms"), "task_id").limit(30).select("task_id", "n_calls", "tool_ms")


def recent_calls(spark: SparkSession, d: str) -> DataFrame:
    """The last 60 calls of each session."""
    w = Window.partitionBy("session").orderBy(F.desc("id"))
    rows = events.once(table(spark, d, "calls"), ["session", "tool"]).withColumn("place", F.row_number().over(w)).where("place <= 60")
    return rows.select("session", "id", "tool", "place")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return stream.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"])


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return stream.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"])


def event_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (call_gaps, call_repeats, session_summary, phase_breakdown, task_breakdown, recent_calls, event_windows, event_sessions, event_props)}

_ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY started) AS rn FROM calls) WHERE rn = 1)"
_MS = "CASE WHEN NOT isnan(elapsed_ms) AND elapsed_ms >= 0 THEN elapsed_ms END"
SQL = {
    "call_gaps": f"WITH {_ONCE} SELECT id, session, round(greatest(0.0, (started - lag(ended) OVER w) * 1000), 3) AS gap FROM once WINDOW w AS (PARTITION BY session ORDER BY id)",
    "call_repeats": f"""WITH {_ONCE} SELECT id, lag(id) OVER w IS NOT NULL AS repeated, coalesce(lag(status) OVER w = 'error', false) AS retried
FROM once WHERE fingerprint IS NOT NULL WINDOW w AS (PARTITION BY session, fingerprint ORDER BY id)""",
    "session_summary": f"""WITH {_ONCE} SELECT session, count(*) AS n_calls, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
  CAST(sum(CASE WHEN ended IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_open, count(DISTINCT batch_id) AS n_batches, CAST(coalesce(sum(CAST({_MS} AS DECIMAL(18,3))), 0) AS DOUBLE) AS tool_ms,
  CAST(coalesce(sum(input_bytes), 0) AS BIGINT) AS input_bytes, CAST(coalesce(sum(output_bytes), 0) AS BIGINT) AS output_bytes,
  min(started) AS first_start, max(coalesce(ended, started)) AS last_end FROM once GROUP BY session""",
    "phase_breakdown": f"""WITH {_ONCE} SELECT phase, count(*) AS n_calls, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(coalesce(sum(CAST({_MS} AS DECIMAL(18,3))), 0) AS DOUBLE) AS tool_ms FROM once GROUP BY phase""",
    "task_breakdown": f"""WITH {_ONCE} SELECT task_id, count(*) AS n_calls, CAST(coalesce(sum(CAST({_MS} AS DECIMAL(18,3))), 0) AS DOUBLE) AS tool_ms FROM once WHERE task_id IS NOT NULL GROUP BY task_id ORDER BY tool_ms DESC, task_id LIMIT 30""",
    "recent_calls": f"""WITH {_ONCE} SELECT session, id, tool, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY id DESC) AS place FROM once) WHERE place <= 60""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS value_sum FROM events GROUP BY ALL",
    "event_sessions": """WITH marked AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM runs GROUP BY user_id, run""",
    "event_props": "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL",
}
