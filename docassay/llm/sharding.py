"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Row counts of the partitions and the wanted shard sizes fix the margins of a
matrix: how many rows go from each partition to each shard. It is drawn exactly
(every assignment of rows to shards is equally likely), each partition permutes
its rows and deals them out by its row of the matrix, rows are exchanged, and
every shard permutes once more. Shards are permuted in buckets of a random key,
so that no task holds a whole shard.
"""

from __future__ import annotations

from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docassay.llm.common import shared_checkpoint

KEY_BITS = 63


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows, drawn without replacement, are among the `good` ones.

    By inversion around the mode, for counts of any size (numpy's own stops at 1e9).
    Terms are left out only where they are below 1e-30 of the largest.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    share = good / total
    spread = sqrt(draws * share * (1 - share) * max(0.0, (total - draws) / max(1, total - 1)))
    reach = int(12 * spread) + 64
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    below = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    at = np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right")
    return mode - len(below) + int(min(at, len(weights) - 1))


def communication_matrix(rows_of: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Exact draw of partition-to-shard counts with the given row and column sums."""
    rng = np.random.default_rng(seed)
    left = [int(x) for x in shard_sizes]
    out = np.zeros((len(rows_of), len(left)), np.int64)
    for p, n in enumerate(rows_of):
        n, rest = int(n), sum(left)
        for s in range(len(left)):
            rest -= left[s]
            out[p, s] = draw_hypergeometric(rng, left[s], rest, n)
            n -= int(out[p, s])
            left[s] -= int(out[p, s])
    return out


def shuffle_into_shards(
    df: DataFrame, shards: int = 8, seed: int = 7, bucket_rows: int = 16384
) -> DataFrame:
    """`df` with shard (0 to shards - 1) and slot (gapless from 0 in its shard).

    Shard sizes differ by one at most. Columns shard and slot of `df`, if any,
    are replaced; all others stay, whatever they hold, nulls and repeated rows
    included. The result repeats as long as `df` comes in the same partitions.
    The rows are written once to the shared checkpoint folder, so that counting
    and dealing see the same partitions; select few columns before where texts
    are long. One row of counts a partition passes through the driver. An empty
    `df` gives an empty result.
    """
    base = df.drop("shard", "slot")
    rows = shared_checkpoint(base.withColumn("__part", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in rows.groupBy("__part").count().collect()}
    total, parts = sum(counts.values()), sorted(counts)
    sizes = np.full(shards, total // shards)
    sizes[np.random.default_rng(seed).permutation(shards)[: total % shards]] += 1
    matrix = communication_matrix([counts[p] for p in parts], sizes.tolist(), seed)
    dealt_by = {p: matrix[k].tolist() for k, p in enumerate(parts)}
    bits = min(14, ceil(log2(max(1.0, total / shards / bucket_rows))))

    def deal(batches):
        left = rng = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if left is None:
                part = batch.column(batch.num_columns - 1)[0].as_py()
                left, rng = np.array(dealt_by[part]), np.random.default_rng([seed, part])
            # dealing a permuted partition in order is drawing without replacement
            here, n = np.zeros(shards, np.int64), batch.num_rows
            for s in range(shards):
                rest = int(left[s + 1 :].sum())
                here[s] = draw_hypergeometric(rng, int(left[s]), rest, n)
                n -= int(here[s])
            left = left - here
            shard = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), here))
            key = rng.integers(0, 2**KEY_BITS, batch.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard), pa.array(key)],
                names=[*batch.schema.names, "shard", "__key"],
            )

    schema = T.StructType(
        [*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("__key", T.LongType())]
    )
    dealt = rows.mapInArrow(deal, schema).withColumn(
        "__bucket", F.shiftright("__key", KEY_BITS - bits).cast("int")
    )
    # shards * 2^14 buckets at most, so their offsets are a small table
    each = Window.partitionBy("__shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(F.col("shard").alias("__shard"), F.col("__bucket").alias("__b"))
        .count()
        .select("__shard", "__b", F.coalesce(F.sum("count").over(each), F.lit(0)).alias("__before"))
    )
    in_bucket = Window.partitionBy("shard", "__bucket").orderBy("__key")
    return (
        dealt.withColumn("__rank", F.row_number().over(in_bucket))
        .join(
            F.broadcast(offsets),
            (F.col("shard") == F.col("__shard")) & (F.col("__bucket") == F.col("__b")),
        )
        .select(*base.columns, "shard", (F.col("__before") + F.col("__rank") - 1).alias("slot"))
    )
