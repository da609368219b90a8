"""The rate limit on a stream: requests wait for the watermark, so that late ones are walked in their place."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docassay.operators.limits import DEFAULT_LIMITS, SlidingLog

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """State of a key: requests that the watermark has not passed, and accepted times of the widest window.

    A timer stands at the earliest waiting request, and when none waits, at the
    time when the last accepted one runs out.
    """

    def __init__(self, limits: Sequence[tuple[int, int]], seq_type: str):
        self.limits, self.seq_type = limits, seq_type
        self.widest = max(seconds for seconds, _ in limits) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"micros long, seq {self.seq_type}")
        self.accepted = handle.getListState("accepted", "micros long")

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(m), s) for frame in rows for m, s in zip(frame["micros"], frame["seq"].tolist())]
        self.waiting.appendList(new)
        self._wake(min(m for m, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        every = [(m, s) for m, s in self.waiting.get()] if self.waiting.exists() else []
        due, later = sorted(x for x in every if x[0] <= passed), [x for x in every if x[0] > passed]
        kept = [m for (m,) in self.accepted.get()] if self.accepted.exists() else []
        log = SlidingLog(self.limits, kept)
        answers = [log.accept(m) for m, _ in due]
        left = [m for m in log.accepted if later or m + self.widest > passed]
        for state, values in ((self.waiting, later), (self.accepted, [(m,) for m in left])):
            state.put(values) if values else state.clear()
        if later:
            self._wake(min(m for m, _ in later))
        elif left:
            self._wake(left[-1] + self.widest)
        if due:
            yield pd.DataFrame({"key": [key[0]] * len(due), "micros": [m for m, _ in due], "seq": [s for _, s in due], "accepted": answers})

    def close(self) -> None:
        pass


def rate_limited_stream(
    requests: DataFrame, limits: Sequence[tuple[int, int]] = DEFAULT_LIMITS, lateness: str = "1 minute"
) -> DataFrame:
    """(key, ts, seq, accepted) of a stream of (key, ts, seq), as `rate_limited` has it for the whole of them.

    A request is answered when the watermark has passed it, so that all that come
    up to `lateness` late are walked in the order of (ts, seq), whatever order
    they came in. Later ones are dropped by the watermark and do not count.
    Requests without a time are left out. A key's state is what waits and the
    accepted times of the widest window; it goes when they have run out. The
    session's state store has to be RocksDB's.
    """
    spark = requests.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    fields = {f.name: f.dataType.simpleString() for f in requests.schema}
    timed = requests.where("ts IS NOT NULL").selectExpr("key", "CAST(ts AS timestamp) AS ts", "seq").withWatermark("ts", lateness)
    walked = timed.selectExpr("key", "unix_micros(ts) AS micros", "seq", "ts").groupBy("key").transformWithStateInPandas(
        Limiter(limits, fields["seq"]), f"key {fields['key']}, micros long, seq {fields['seq']}, accepted boolean", "Append", "EventTime"
    )
    return walked.selectExpr("key", "timestamp_micros(micros) AS ts", "seq", "accepted")
