"""A memory with time to live as a processor with state and timers.

State lies in RocksDB, a value and its end for each key, so it grows beyond an executor's heap; timers end entries whether
their key gets new input or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "subject string, key string, value string, alive boolean"
#: Longest time an entry without a time to live is kept after its last change, where one is asked for.
_NEVER = -1


class Memory(StatefulProcessor):
    """The latest value of each (subject, key); a later ``seq`` wins, ``forget`` removes, a timer ends what has a time to live.

    Out come changes: a new value with ``alive``, and a last row without when it is forgotten or its time has come. Once a
    later entry was seen, earlier ones change nothing, also after a forget.
    """

    def __init__(self, clock: str) -> None:
        self.clock = clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entry", "value string, seq long, end long, alive boolean")

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.clock == "EventTime" else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("seq", kind="stable").iloc[-1]
        before = self.state.get() if self.state.exists() else None
        if before is not None and before[1] >= int(last["seq"]):
            return
        if before is not None and before[2] != _NEVER:
            self.handle.deleteTimer(before[2])
        if last["op"] == "forget":
            self.state.update((None, int(last["seq"]), _NEVER, False))
            if before is not None and before[3]:
                yield self._row(key, None, False)
            return
        end = _NEVER
        if pd.notna(last["ttl_seconds"]):
            start = last["ts"].timestamp() * 1000 if self.clock == "EventTime" else self._now(timerValues)
            end = max(int(start + last["ttl_seconds"] * 1000), self._now(timerValues) + 1)
            self.handle.registerTimer(end)
        self.state.update((last["value"], int(last["seq"]), end, True))
        yield self._row(key, last["value"], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, seq, end, alive = self.state.get()
        if alive and end == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((None, seq, _NEVER, False))
            yield self._row(key, value, False)

    @staticmethod
    def _row(key, value: str | None, alive: bool) -> pd.DataFrame:
        return pd.DataFrame({"subject": [key[0]], "key": [key[1]], "value": pd.Series([value], dtype=object), "alive": [alive]})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the session's streaming state in RocksDB. A running query keeps what it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def memory_timers(log: DataFrame, *, clock: str = "EventTime", late: str = "1 hour") -> DataFrame:
    """Changes (subject, key, value, alive) of a log (subject, key, value, seq, ts, op, ttl_seconds) as a stream.

    ``clock``: "EventTime" counts a time to live from ``ts`` and ends it as the watermark passes; "ProcessingTime" counts
    from when the entry is read, by the cluster's clock.
    """
    if clock not in ("EventTime", "ProcessingTime"):
        raise ValueError(f"unknown clock {clock!r}")
    use_rocksdb(log.sparkSession)
    timed = log.withWatermark("ts", late) if clock == "EventTime" else log
    return timed.groupBy("subject", "key").transformWithStateInPandas(Memory(clock), outputStructType=OUTPUT, outputMode="Update", timeMode=clock)
