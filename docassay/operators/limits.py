"""Sliding-log rate limit: only accepted requests count against later ones."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (window in seconds, requests accepted in it), in the order in which they are tested.
DEFAULT_LIMITS = ((60, 10), (86_400, 100))


class SlidingLog:
    """Accepted times of one key, as many as the widest window can hold."""

    def __init__(self, limits: Sequence[tuple[int, int]], accepted: Iterable[int] = ()):
        self.limits = [(seconds * 1_000_000, most) for seconds, most in limits]
        self.widest = max(w for w, _ in self.limits)
        self.accepted = deque(accepted)

    def accept(self, micros: int) -> bool:
        """Whether a request at this time passes; times must not go back."""
        while self.accepted and micros - self.accepted[0] >= self.widest:
            self.accepted.popleft()
        for window, most in self.limits:
            if sum(1 for t in self.accepted if micros - t < window) >= most:
                return False
        self.accepted.append(micros)
        return True


def rate_limited(requests: DataFrame, limits: Sequence[tuple[int, int]] = DEFAULT_LIMITS) -> DataFrame:
    """`requests` (key, ts, seq, ...) with accepted, in the order of (ts, seq) for each key.

    A key's requests depend on each other and are walked in order, but the walk
    keeps only the accepted times of the widest window, whatever the key's size:
    partitions by key, sorted within, streamed in Arrow batches. A null key is a
    key of its own; requests without a time are refused and do not count.
    """
    columns = [c for c in requests.columns if c != "accepted"]
    base = requests.select(*columns).withColumn("__micros", F.unix_micros(requests["ts"].cast("timestamp_ntz").cast("timestamp")))
    sorted_by_key = base.repartition("key").sortWithinPartitions("key", "__micros", "seq")

    def walk(batches):
        current, log = object(), None
        for batch in batches:
            out = []
            for key, micros in zip(batch.column("key").to_pylist(), batch.column("__micros").to_pylist()):
                if log is None or key != current:
                    current, log = key, SlidingLog(limits)
                out.append(micros is not None and log.accept(micros))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_by_key.schema) + ", accepted boolean"
    return sorted_by_key.mapInArrow(walk, schema).drop("__micros")
