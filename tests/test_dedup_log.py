"""Duplicates against a log that grows, batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from docassay.operators import dedup


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def flipped(r, h, n):
    for i in r.sample(range(64), n):
        h ^= 1 << i
    return h


@pytest.mark.parametrize("bits", [0, 3, 10, 16])
def test_ten_batches_equal_one(spark, tmp_path, bits):
    r = random.Random(bits)
    hashes = [r.getrandbits(64) for _ in range(60)]
    rows = []
    for seq in range(400):
        h = r.choice(hashes)
        rows.append((seq, None if seq % 37 == 5 else signed(flipped(r, h, r.choice([0, 1, bits // 2, bits, bits + 1, 20])))))
    usable = [(s, h) for s, h in rows if h is not None]
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= bits
    want = {}
    for k, (seq, h) in enumerate(usable):
        earlier = [s for s, g in usable[:k] if near(g, h)]
        if earlier:
            want[seq] = earlier[0]
    entries = spark.createDataFrame([(*x, "extra") for x in rows], "seq long, phash long, first string")
    assert {x.seq: x.similar_seq for x in dedup.first_similar(entries, bits).collect()} == want
    if bits in (3, 16):
        got, path = {}, str(tmp_path / "index")
        edges = [0, 40, 41, 90, 200, 400]
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            batch = entries.where((F.col("seq") >= a) & (F.col("seq") < b))
            for _ in range(2 if n == 3 else 1):  # a batch that is tried again finds no entry of its own
                answers = dedup.first_similar_in_log(batch, path, f"b{n}", bits)
            got |= {x.seq: x.similar_seq for x in answers.collect()}
        assert got == want


def test_a_batch_reads_only_the_partitions_that_it_asks(spark, tmp_path):
    r = random.Random(1)
    path = str(tmp_path / "index")
    many = spark.createDataFrame([(k, signed(r.getrandbits(64))) for k in range(500)], "seq long, phash long")
    dedup.first_similar_in_log(many, path, "old", 10)
    one = spark.createDataFrame([(900, signed(r.getrandbits(64)))], "first long, phash long")
    asks = dedup._in_partitions(dedup.under_values(one, 10, True), 10)
    pruned = dedup.index_of(asks, path, 10)
    whole = spark.read.parquet(path)
    assert 0 < len(pruned.inputFiles()) <= len(whole.inputFiles())
    assert pruned.select("band", "part").distinct().count() < whole.select("band", "part").distinct().count()
    assert dedup.index_of(asks, str(tmp_path / "none"), 10) is None


def test_an_empty_batch(spark, tmp_path):
    empty = spark.createDataFrame([], "seq long, phash long")
    assert dedup.first_similar_in_log(empty, str(tmp_path / "i"), "x").count() == 0


def test_a_log_is_asked_by_tiles_without_pairs(spark, tmp_path, monkeypatch):
    """Classes of earlier batches meet a batch in tiles as its own do; a join on the values would make a row for every pair."""
    tables = []
    kept = dedup._earliest
    monkeypatch.setattr(dedup, "_earliest", lambda *a: tables.append(a[2]) or kept(*a))
    path = str(tmp_path / "index")
    entries = spark.createDataFrame([(k, k % 7) for k in range(50)], "seq long, phash long")
    dedup.first_similar_in_log(entries.where("seq < 5"), path, "a", 0)
    got = {x.seq: x.similar_seq for x in dedup.first_similar_in_log(entries.where("seq >= 5"), path, "b", 0).collect()}
    assert got == {k: k % 7 for k in range(7, 50)} and len(tables) == 2
    # four bands, five classes of the first batch and seven of the second: no pairs
    assert tables[1].count() <= 4 * (5 + 7)
