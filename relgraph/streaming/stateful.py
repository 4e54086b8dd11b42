"""Stateful streams: debounce, dirty-path pressure, rate limits, intent coalescing.

State per key is a few values (and, for pressure, at most the bound of paths), so a
busy key costs time but not memory; ``maxFilesPerTrigger`` on the source bounds what
one micro-batch brings. The processors are built inside functions so that workers need
no copy of this package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store these operators need; it keeps state on executor disks, not in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _numbers(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def debounce_stream(hints: DataFrame, quiet_ms: int, max_ms: int, watermark: str = "0 seconds") -> DataFrame:
    """Flushes of distinct paths per project, released by event-time timers.

    ``hints(project_id, ts, ts_ms, path)``. Rows of ``(project_id, flush_ms, trigger, path)``.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    times_schema, path_schema = _numbers("first", "last"), _text("path")

    class Debounce(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.times = handle.getValueState("times", times_schema)
            self.paths = handle.getMapState("paths", path_schema, path_schema)

        def _deadline(self, first, last):
            return min(last + quiet_ms, first + max_ms)

        def _flush(self, key, first, last):
            trigger = "maximum_wait" if first + max_ms <= last + quiet_ms else "quiet_period"
            rows = [(key[0], self._deadline(first, last), trigger, p[0]) for p in list(self.paths.keys())]
            self.paths.clear()
            self.times.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            return rows

        def handleInputRows(self, key, rows, timerValues):
            frames = list(rows)
            batch = pd.concat(frames).sort_values("ts_ms", kind="stable") if frames else pd.DataFrame(columns=["ts_ms", "path"])
            out = []
            for ts, path in zip(batch["ts_ms"], batch["path"]):
                state = self.times.get() if self.times.exists() else None
                if state is not None and ts >= self._deadline(*state):
                    out += self._flush(key, *state)
                    state = None
                first = int(ts) if state is None else state[0]
                last = int(ts) if state is None else max(int(ts), state[1])
                self.times.update((first, last))
                self.paths.updateValue((path,), (path,))
            if self.times.exists():
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(self._deadline(*self.times.get()))
            yield pd.DataFrame(out, columns=["project_id", "flush_ms", "trigger", "path"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            out = self._flush(key, *self.times.get()) if self.times.exists() else []
            yield pd.DataFrame(out, columns=["project_id", "flush_ms", "trigger", "path"])

        def close(self):
            pass

    return (
        hints.withWatermark("ts", watermark)
        .groupBy("project_id")
        .transformWithStateInPandas(
            statefulProcessor=Debounce(), outputStructType="project_id string, flush_ms long, trigger string, path string",
            outputMode="Append", timeMode="EventTime",
        )
    )


def pressure_stream(hints: DataFrame, limit: int) -> DataFrame:
    """Decision per hint: normal with the distinct count, high_water once, then coalesced."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    flag_schema, path_schema = _numbers("full", "distinct"), _text("path")
    bound = max(1, limit)

    class Pressure(StatefulProcessor):
        def init(self, handle):
            self.flag = handle.getValueState("flag", flag_schema)
            self.paths = handle.getMapState("paths", path_schema, path_schema)

        def handleInputRows(self, key, rows, timerValues):
            full, distinct = self.flag.get() if self.flag.exists() else (0, 0)
            frames = list(rows)
            batch = pd.concat(frames).sort_values("seq", kind="stable")
            out = []
            for seq, path in zip(batch["seq"], batch["path"]):
                if full:
                    out.append((key[0], int(seq), "coalesced", 0))
                    continue
                if not self.paths.containsKey((path,)):
                    self.paths.updateValue((path,), (path,))
                    distinct += 1
                if distinct >= bound:
                    full, distinct = 1, 0
                    self.paths.clear()
                    out.append((key[0], int(seq), "high_water", 0))
                else:
                    out.append((key[0], int(seq), "normal", int(distinct)))
            self.flag.update((int(full), int(distinct)))
            yield pd.DataFrame(out, columns=["project_id", "seq", "decision", "distinct"])

        def close(self):
            pass

    return hints.groupBy("project_id").transformWithStateInPandas(
        statefulProcessor=Pressure(), outputStructType="project_id string, seq long, decision string, distinct long",
        outputMode="Append", timeMode="None",
    )


def rate_limit_stream(records: DataFrame, per_window: int, seconds: int) -> DataFrame:
    """recorded / notice / suppressed per record, in windows anchored at their first record."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    state_schema = _numbers("start", "count")
    width = seconds * 1000

    class RateLimit(StatefulProcessor):
        def init(self, handle):
            self.window = handle.getValueState("window", state_schema)

        def handleInputRows(self, key, rows, timerValues):
            start, count = self.window.get() if self.window.exists() else (None, 0)
            frames = list(rows)
            batch = pd.concat(frames).sort_values(["ts_ms", "seq"], kind="stable")
            out = []
            for ts, seq in zip(batch["ts_ms"], batch["seq"]):
                if start is None or ts - start >= width:
                    start, count = int(ts), 0
                count += 1
                outcome = "recorded" if count <= per_window else "notice" if count == per_window + 1 else "suppressed"
                out.append((key[0], int(ts), int(seq), outcome))
            self.window.update((int(start), int(count)))
            yield pd.DataFrame(out, columns=["target", "ts_ms", "seq", "outcome"])

        def close(self):
            pass

    return records.groupBy("target").transformWithStateInPandas(
        statefulProcessor=RateLimit(), outputStructType="target string, ts_ms long, seq long, outcome string",
        outputMode="Append", timeMode="None",
    )


def coalesce_stream(intents: DataFrame) -> DataFrame:
    """Pending row per scope, for ``update`` output: the streaming form of intent coalescing."""
    return intents.groupBy("solution_id", "kind", "scope_key").agg(
        F.min_by("id", "seq").alias("id"), F.max("target_event_seq").alias("target_event_seq"),
        F.max("priority").alias("priority"), F.min("ready_at").alias("ready_at"), F.count(F.lit(1)).alias("intents"),
    )
