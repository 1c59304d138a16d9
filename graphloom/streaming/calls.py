"""The call log and event tables as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums of value per window of width and keys. The same plan serves a table and a stream; of a stream, rows
    later than `late` behind the newest are left out."""
    rows = events.withColumn("_t", F.col(at).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_t", late or "10 minutes")
    out = rows.groupBy(F.window("_t", width), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value_sum"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *keys, "n", "value_sum")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Runs of rows per keys with less than gap between them: start, end (gap after the last), rows."""
    rows = events.withColumn("_t", F.col(at).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_t", late or "10 minutes")
    out = rows.groupBy(F.session_window("_t", gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), F.col("session_window.end").cast("timestamp_ntz").alias("session_end"), *keys, "n")


def delivered_lines(reads: DataFrame) -> DataFrame:
    """A stateful stream of line ranges (source_id, start_line, end_line in order of arrival): each with new_lines and
    repeated_lines, counted against what was delivered of the source before. The state is the merged ranges of a source."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known: list[tuple[int, int]] = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            out = []
            for a, b in zip(batch["start_line"], batch["end_line"]):
                seen = sum(max(0, min(b, y) - max(a, x) + 1) for x, y in known)
                joined: list[tuple[int, int]] = []
                for x, y in sorted([*known, (int(a), int(b))]):
                    if joined and x <= joined[-1][1] + 1:
                        joined[-1] = (joined[-1][0], max(joined[-1][1], y))
                    else:
                        joined.append((x, y))
                known = joined
                out.append((key[0], int(a), int(b), int(b - a + 1 - seen), int(seen)))
            yield pd.DataFrame(out, columns=["source_id", "start_line", "end_line", "new_lines", "repeated_lines"])
        state.update(([x for x, _ in known], [y for _, y in known]))

    return reads.groupBy("source_id").applyInPandasWithState(fold, "source_id string, start_line long, end_line long, new_lines long, repeated_lines long", "starts array<long>, ends array<long>", "append", "NoTimeout")
