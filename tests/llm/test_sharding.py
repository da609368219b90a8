from collections import Counter
from math import comb

import numpy as np
import pytest

from docassay.llm.sharding import communication_matrix, draw_hypergeometric, shuffle_into_shards


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 4), (3, 3, 6), (10, 1, 8), (0, 4, 2), (40, 60, 30)])
def test_draws_follow_the_law(good, bad, draws):
    rng = np.random.default_rng(1)
    n = 20000
    got = Counter(draw_hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(draws + 1):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        assert abs(got[k] / n - p) < 4.5 * (p * (1 - p) / n) ** 0.5 + 1e-9


def test_large_counts():
    rng = np.random.default_rng(2)
    x = [draw_hypergeometric(rng, 5 * 10**9, 35 * 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(x) - 125000) < 4 * 331 / 200**0.5


def test_matrix_margins():
    rows, sizes = [0, 5, 100, 1, 17], [31, 31, 31, 30]
    m = communication_matrix(rows, sizes, 3)
    assert m.sum(1).tolist() == rows and m.sum(0).tolist() == sizes and (m >= 0).all()


@pytest.mark.parametrize("bucket_rows", [16384, 20])
def test_rows_and_slots(spark, bucket_rows):
    data = [(i, f"t{i % 9}", None) for i in range(1003)] + [(None, None, 1)] * 300
    df = spark.createDataFrame(data, "doc_id long, text string, shard int").repartition(7, "doc_id")
    out = shuffle_into_shards(df, 8, bucket_rows=bucket_rows)
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(x[:2] for x in data)
    per = Counter(r.shard for r in rows)
    assert sorted(per) == list(range(8)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    ids = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert abs(np.corrcoef(np.arange(len(ids)), ids)[0, 1]) < 0.15
    assert sorted(map(tuple, shuffle_into_shards(df, 8, bucket_rows=bucket_rows).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_uniform_over_seeds(spark):
    df = spark.range(12, numPartitions=3).withColumnRenamed("id", "doc_id").cache()
    seen = Counter()
    for seed in range(40):
        for r in shuffle_into_shards(df, 3, seed).collect():
            seen[r.doc_id, r.shard] += 1
    assert len(seen) == 36 and max(seen.values()) < 30


def test_few_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long")
    assert shuffle_into_shards(empty, 8).count() == 0
    assert shuffle_into_shards(spark.range(3), 8).where("slot = 0").count() == 3
