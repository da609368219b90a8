"""Duplicate submissions: equal image digests or perceptual hashes within a few bits.

Similar hashes meet by bands. If two 64-bit hashes differ in at most `bits`
bits, then of m bands at least one differs in bits // m bits at most. A class of
equal hashes is found under all values within half of that distance of its own,
and asks under all within the other half, so that two such values meet half way:
rows grow with the classes, not with their pairs. The number of band values is
bounded (2^18 at most), so their sizes are a small table; it cuts a value that
many classes share into tiles.

For a log that grows, the values under which classes are found are kept as a
table, partitioned by band and by the value's first bits. A new batch asks only
the partitions that its own values lead to, and adds itself.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes on a side of a tile, and rows that a task's group of tiles holds on average.
TILE_ROWS, GROUP_ROWS = 4096, 100_000
#: Asking and found classes that are compared at once: small enough for a core's cache.
ASKS_AT_ONCE, FOUND_AT_ONCE = 128, 1024
#: Bits of a band's value that name a partition of the index.
PART_BITS = 3


def bands_of(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the bands of 64 bits: four of 16 at least, so many that two bits' distance in one suffices."""
    m = max(4, bits // 3 + 1)
    edges = [64 * k // m for k in range(m + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def near_masks(width: int, most: int) -> list[int]:
    """All numbers of `width` bits with at most `most` bits set."""
    return [sum(1 << i for i in places) for n in range(most + 1) for places in combinations(range(width), n)]


def _first_near(table: pa.Table, bits: int) -> pa.Table:
    """phash and near_first: of every asking class the least `first` among near or equal ones of the same tile.

    Those after the last asking class are not compared, and a class that has found one asks no further.
    """
    asks = table.column("asks").to_numpy()
    tile, first = (table.column(k).to_numpy() for k in ("tile", "first"))
    hashes = table.column("phash").to_numpy().view(np.uint64)
    order = np.lexsort((first, ~asks, tile))  # a tile's asking classes, then the others, earliest first
    begins = np.flatnonzero(np.r_[True, np.diff(tile[order]) != 0]) if len(order) else []
    out = []
    for begin, end in zip(begins, [*begins[1:], len(order)]):
        at = order[begin:end]
        mine, theirs = at[asks[at]], at[~asks[at]]
        if not len(mine) or not len(theirs):
            continue
        for i in range(0, len(mine), ASKS_AT_ONCE):
            x = mine[i : i + ASKS_AT_ONCE]
            earlier = theirs[: np.searchsorted(first[theirs], first[x[-1]])]
            for j in range(0, len(earlier), FOUND_AT_ONCE):
                y = earlier[j : j + FOUND_AT_ONCE]
                near = np.bitwise_count(hashes[x][:, None] ^ hashes[y][None, :]) <= bits
                nearest = near.argmax(1)
                found = near[np.arange(len(x)), nearest]
                out.append((hashes[x[found]].view(np.int64), first[y[nearest[found]]]))
                x = x[~found]
                if not len(x):
                    break
    a, b = map(np.concatenate, zip(*out)) if out else (np.empty(0, np.int64),) * 2
    return pa.table({"phash": a, "near_first": b})


def _masks(bits: int, asks: bool, bands: list[tuple[int, int]] | None = None) -> Column:
    """For each band the differences under which a class asks, or under which it is found: half of the distance each."""
    bands = bands_of(bits) if bands is None else bands
    most = bits // len(bands)
    radius = most - most // 2 if asks else most // 2
    return F.array(*(F.array(*map(F.lit, near_masks(width, radius))).cast("array<long>") for _, width in bands))


def under_values(classes: DataFrame, bits: int, asks: bool, bands: list[tuple[int, int]] | None = None) -> DataFrame:
    """(band, v, phash, first): `classes` (phash, first) under the values of each band at which they ask, or are found."""
    bands = bands_of(bits) if bands is None else bands
    masks = _masks(bits, asks, bands)

    def of_band(k: int, shift: int, width: int) -> Column:
        value = F.shiftrightunsigned("phash", shift).bitwiseAND(F.lit((1 << width) - 1))
        return F.transform(F.get(masks, F.lit(k)), lambda mask: F.struct(F.lit(k).alias("band"), value.bitwiseXOR(mask).alias("v")))

    values = F.array(*(of_band(k, *band) for k, band in enumerate(bands)))
    return classes.select("phash", "first", F.explode(F.flatten(values)).alias("p")).select("p.*", "phash", "first")


def _earliest(usable: DataFrame, classes: DataFrame, found: DataFrame, asking: DataFrame, held: DataFrame, askers: DataFrame, bits: int) -> DataFrame:
    """(seq, similar_seq) of `usable` (seq, phash), whose `classes` (phash, first) ask among those that are found.

    `found`, `asking`: as `under_values` gives them. `held`, `askers`: band, v
    and how many are found there (n), or ask there (asking).
    """
    pieces = lambda n: F.ceil(F.col(n) / TILE_ROWS).cast("int")
    values = held.join(askers, ["band", "v"]).select("band", "v", "n", "asking", pieces("asking").alias("lefts"), pieces("n").alias("rights"))
    rows = values.agg(F.sum(F.col("n") * F.col("lefts") + F.col("asking") * F.col("rights"))).first()[0] or 0
    groups = max(int(usable.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows / GROUP_ROWS))
    # a row for every value that a band can have, at most: 2^18 of them
    values = F.broadcast(values.select("band", "v", "lefts", "rights"))
    side = lambda n: F.pmod(F.xxhash64("phash"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = (
        asking.join(values, ["band", "v"]).select("band", "v", side("lefts").alias("l"), every("rights").alias("r"), F.lit(True).alias("asks"), "phash", "first")
        .unionByName(found.join(values, ["band", "v"]).select("band", "v", every("lefts").alias("l"), side("rights").alias("r"), F.lit(False).alias("asks"), "phash", "first"))
        .select(F.xxhash64("band", "v", "l", "r").alias("tile"), "asks", "phash", "first")
    )
    near = (
        dealt.groupBy(F.pmod("tile", F.lit(groups)).alias("g"))
        .applyInArrow(lambda table: _first_near(table, bits), "phash long, near_first long")
        .groupBy("phash")
        .agg(F.min("near_first").alias("near_first"))
    )
    of_class = classes.join(near, "phash", "left").select(
        "phash", F.least("first", F.coalesce("near_first", "first")).alias("earliest")
    )
    return usable.join(of_class, "phash").where("earliest < seq").select("seq", F.col("earliest").alias("similar_seq"))


def first_similar(entries: DataFrame, bits: int = 10) -> DataFrame:
    """(seq, similar_seq): each entry's earliest earlier entry whose phash differs in at most `bits` bits.

    `entries`: seq (unique long), phash (long bits). Rows with a null phash take
    no part, entries without such an earlier one are left out. Equal hashes are
    one class, so a hot hash costs one row; no pairs are made.
    """
    usable = entries.where("phash IS NOT NULL").select("seq", "phash")
    classes = usable.groupBy("phash").agg(F.min("seq").alias("first"))
    found, asking = under_values(classes, bits, False), under_values(classes, bits, True)
    own = under_values(classes, 0, False, bands_of(bits)).groupBy("band", "v").agg(F.count("*").alias("n"))
    around = lambda asks: F.explode(F.transform(F.get(_masks(bits, asks), F.col("band")), lambda mask: F.col("v").bitwiseXOR(mask))).alias("v")
    held = own.select("band", around(False), "n").groupBy("band", "v").agg(F.sum("n").alias("n"))
    askers = own.select("band", around(True), "n").groupBy("band", "v").agg(F.sum("n").alias("asking"))
    return _earliest(usable, classes, found, asking, held, askers, bits)


def _in_partitions(values: DataFrame, bits: int) -> DataFrame:
    """`values` (band, v, ...) with part, the first PART_BITS bits of a value of its band."""
    widths = F.array(*(F.lit(width) for _, width in bands_of(bits)))
    return values.withColumn("part", F.call_function("shiftrightunsigned", F.col("v"), F.get(widths, F.col("band")) - PART_BITS).cast("int"))


def index_of(asks: DataFrame, path: str, bits: int) -> DataFrame | None:
    """The partitions of the index at `path` that `asks` (band, part, ...) lead to; None if there is no index yet."""
    spark = asks.sparkSession
    try:
        index = spark.read.schema("v long, phash long, first long, batch string, band int, part int").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    parts: dict[int, list[int]] = {}
    for x in asks.select("band", "part").distinct().collect():  # bands times 2^PART_BITS at most
        parts.setdefault(x.band, []).append(x.part)
    within = F.lit(False)
    for band, own in parts.items():
        within = within | ((F.col("band") == band) & F.col("part").isin(own))
    return index.where(within)


def first_similar_in_log(batch: DataFrame, path: str, batch_id: str, bits: int = 10) -> DataFrame:
    """(seq, similar_seq) of the entries of `batch` (seq, phash): as `first_similar`, against all batches before and this one.

    The batch is added to the index at `path` under `batch_id`; what an earlier
    try of the same batch left there is replaced and not asked. All batches have
    the same `bits`; any batch may be the first. Entries of earlier batches are
    not judged again, so entries have to come in the order of seq. The answers are
    written beside the index (`path`-answers) before the batch is added.
    """
    usable = batch.where("phash IS NOT NULL").select("seq", "phash")
    classes = usable.groupBy("phash").agg(F.min("seq").alias("first"))
    asking, found = under_values(classes, bits, True), under_values(classes, bits, False)
    index = index_of(_in_partitions(asking, bits), path, bits)
    if index is None:
        answers = first_similar(batch, bits)
    else:
        # earlier batches and this one are asked together, by tiles; an entry equal to one of an earlier batch finds it there
        every = index.where(F.col("batch") != batch_id).select(found.columns).unionByName(found)
        of_value = lambda df, n: df.groupBy("band", "v").agg(F.count("*").alias(n))
        answers = _earliest(usable, classes, every, asking, of_value(every, "n"), of_value(asking, "asking"), bits)
    answers.write.mode("overwrite").parquet(f"{path}-answers/batch={batch_id}")
    added = _in_partitions(found, bits).select("v", "phash", "first", F.lit(batch_id).alias("batch"), "band", "part")
    added.repartition("band", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "band", "part").parquet(path)
    return batch.sparkSession.read.schema("seq long, similar_seq long").parquet(f"{path}-answers/batch={batch_id}")


def first_equal(entries: DataFrame) -> DataFrame:
    """(seq, equal_seq): each entry's earliest earlier entry with the same digest; null or empty ones never match."""
    usable = entries.where("coalesce(digest, '') <> ''").select("seq", "digest")
    firsts = usable.groupBy("digest").agg(F.min("seq").alias("equal_seq"))
    return usable.join(firsts, "digest").where("equal_seq < seq").select("seq", "equal_seq")


def duplicates(entries: DataFrame, bits: int = 10) -> DataFrame:
    """entries with is_duplicate and duplicate_of: the earliest earlier entry that is equal or similar."""
    found = F.least("equal_seq", "similar_seq")
    return (
        entries.join(first_equal(entries), "seq", "left")
        .join(first_similar(entries, bits), "seq", "left")
        .withColumns({"is_duplicate": found.isNotNull(), "duplicate_of": found})
        .drop("equal_seq", "similar_seq")
    )
