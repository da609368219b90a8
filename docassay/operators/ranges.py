"""The first range in order that holds a number, for tables of ranges of any size.

A range of whole numbers is cut into the fewest blocks of 1, 2, 4, ... numbers
that begin at a multiple of their size: two of each size at most. A number lies
in one block of each size. So numbers and ranges meet by equality of blocks,
exactly; of all ranges that share a block only the first is kept, so that a
block which very many ranges cover is one row. No range holds a block larger than
itself, so numbers are not asked under larger ones than the longest range. Both
sides are dealt out and merged: Spark takes a number's blocks for as small as the
number, and would send them all through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.sources.tables import spread


def _block(number: Column, level: Column) -> Column:
    return F.call_function("shiftright", number, level)


def blocks_of_ranges(spans: DataFrame, levels: int) -> DataFrame:
    """`spans` with level and block: a row for each block of up to 2^levels numbers of low to high (both included)."""
    k, size = F.col("level"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    # blocks a to b - 1 are inside; those of a larger one are not needed
    ends = spans.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).where(size <= F.col("high") - F.col("low") + 1)
    ends = ends.withColumns({"__a": _block(F.col("low") + size - 1, k), "__b": _block(F.col("high") + 1, k)}).where("__a < __b AND (__a % 2 = 1 OR __b % 2 = 1)")
    a, b = F.col("__a"), F.col("__b")
    block = F.explode(F.array(F.when(a % 2 == 1, a), F.when(b % 2 == 1, b - 1)))
    return ends.withColumn("block", block).where("block IS NOT NULL").drop("__a", "__b")


def first_of_ranges(points: DataFrame, ranges: DataFrame, point: str, out: str = "value") -> DataFrame:
    """`points` with the value in `out` of the first of `ranges` that holds the number in column `point`; null for none.

    `ranges`: ord, low, high (both included), value; those with a null or an
    empty span hold nothing. Numbers are not negative (a range is cut off at 0,
    a negative point is in none). Distinct numbers are looked up once each.
    """
    spans = ranges.where("low IS NOT NULL").select("ord", F.greatest(F.col("low").cast("long"), F.lit(0)).alias("low"), F.col("high").cast("long").alias("high"), "value")
    spans = spans.where("low <= high")
    longest = spans.agg(F.max(F.col("high").cast("decimal(38)") - F.col("low") + 1)).first()[0]
    levels = max(int(longest or 0).bit_length() - 1, 0)
    first = F.min(F.struct("ord", "value")).alias("x")
    held = blocks_of_ranges(spread(spans), levels).groupBy("level", "block").agg(first)
    asked = points.select(F.col(point).cast("long").alias("p")).where("p >= 0").distinct()
    in_blocks = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("block", _block(F.col("p"), F.col("level")))
    found = in_blocks.join(held.hint("merge"), ["level", "block"]).groupBy("p").agg(F.min("x").alias("x"))
    kept = [c for c in points.columns if c != out]
    joined = points.select(*kept, F.col(point).cast("long").alias("__p")).join(found.hint("merge"), F.col("__p") == F.col("p"), "left")
    return joined.select(*kept, F.col("x.value").alias(out))
