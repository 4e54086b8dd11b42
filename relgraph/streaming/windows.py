"""Debounce with a maximum wait, and rate limits with anchored windows.

Both cut a key's timeline greedily: where one window ends decides where the next
begins, which time-bucket windows cannot say. The batch twins first reduce each key to
its distinct millisecond stamps, combined map-side, and make one sorted streaming pass
over those with two numbers of state; everything else is ordinary Spark. The streaming
forms keep the same two numbers as keyed state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUIET_MS, MAX_WAIT_MS = 750, 3000
RATE_SECONDS = 60


def _anchored(stamps: DataFrame, key: str, width_ms: int, quiet_ms: int | None) -> DataFrame:
    """Adds ``anchor``: the first stamp of the window each stamp falls into."""

    def cut(batches):
        import numpy as np

        current, anchor, last = None, 0, 0
        for batch in batches:
            anchors = np.empty(len(batch), dtype=np.int64)
            for i, (k, ts) in enumerate(zip(batch[key].to_numpy(), batch["ts_ms"].to_numpy())):
                quiet_over = quiet_ms is not None and ts >= last + quiet_ms
                if k != current or ts >= anchor + width_ms or quiet_over:
                    current, anchor = k, ts
                last = ts
                anchors[i] = anchor
            yield batch.assign(anchor=anchors)

    placed = stamps.repartition(key).sortWithinPartitions(key, "ts_ms")
    return placed.mapInPandas(cut, f"{key} string, ts_ms long, anchor long")


def debounce(hints: DataFrame, quiet_ms: int = QUIET_MS, max_ms: int = MAX_WAIT_MS) -> DataFrame:
    """Distinct paths per flush; a flush is due at min(last + quiet, first + max)."""
    stamps = hints.select("project_id", "ts_ms").distinct()
    windows = _anchored(stamps, "project_id", max_ms, quiet_ms)
    last = windows.groupBy("project_id", "anchor").agg(F.max("ts_ms").alias("last_ms"))
    due = F.least(F.col("last_ms") + quiet_ms, F.col("anchor") + max_ms)
    trigger = F.when(F.col("anchor") + max_ms <= F.col("last_ms") + quiet_ms, "maximum_wait").otherwise("quiet_period")
    flushes = last.select("project_id", "anchor", due.alias("flush_ms"), trigger.alias("trigger"))
    return (
        hints.select("project_id", "ts_ms", "path")
        .join(windows, ["project_id", "ts_ms"])
        .select("project_id", "anchor", "path")
        .distinct()
        .join(flushes, ["project_id", "anchor"])
        .select("project_id", "flush_ms", "trigger", "path")
    )


def rate_limit(records: DataFrame, per_window: int, seconds: int = RATE_SECONDS, salts: int = 32) -> DataFrame:
    """recorded / notice / suppressed for each ``(target, ts_ms, seq)`` record.

    Only the first ``per_window + 1`` records of a window can be anything but suppressed,
    so each salt keeps that many and only those are ranked together.
    """
    stamps = records.select("target", "ts_ms").distinct()
    windows = _anchored(stamps, "target", seconds * 1000, None)
    order = ["ts_ms", "seq"]
    salted = records.join(windows, ["target", "ts_ms"]).withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(salts)))
    local = salted.withColumn("n", F.row_number().over(W.partitionBy("target", "anchor", "salt").orderBy(*order)))
    early = local.where(F.col("n") <= per_window + 1)
    late = local.where(F.col("n") > per_window + 1)
    ranked = early.withColumn("n", F.row_number().over(W.partitionBy("target", "anchor").orderBy(*order)))
    outcome = F.when(F.col("n") <= per_window, "recorded").when(F.col("n") == per_window + 1, "notice").otherwise("suppressed")
    return ranked.select(*records.columns, outcome.alias("outcome")).unionByName(
        late.select(*records.columns, F.lit("suppressed").alias("outcome"))
    )
