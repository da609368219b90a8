import numpy as np
import pytest

from docassay.llm.maxscore import Shard, maxscore, scaled, top_k


def brute(rows, queries, k):
    out = []
    for qi, q in queries:
        scores = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qi]
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed,scale,n", [(0, 30, 900), (1, 3, 300), (2, 2**20, 200), (3, 2**26, 200), (4, 30, 5), (5, 2**30, 150), (6, 2**40, 60)])
def test_numpy_part(seed, scale, n):
    r = np.random.default_rng(seed)
    v = r.integers(-scale, scale + 1, (n, 8))
    v[n // 2 :: 3] = v[0]
    ids = r.permutation(n * 2)[:n]
    if scale == 2**40:  # beyond a long
        with pytest.raises(OverflowError):
            maxscore(ids, v, ids[:40], v[:40], 7)
        return
    q, vec, score = maxscore(ids, v, ids[:40], v[:40], 7)
    rows = list(zip(ids.tolist(), v.tolist()))
    want = brute(rows, rows[:40], 7)
    got = sorted((int(ids[a]), int(b), int(c)) for a, b, c in zip(q, vec, score))
    assert got == sorted((a, b, c) for a, _, b, c in want)


@pytest.mark.parametrize("share", [0.0, 0.25, 1.0])
@pytest.mark.parametrize("n", [100, 3000])
def test_any_split_gives_the_same(share, n, monkeypatch):
    monkeypatch.setattr("docassay.llm.maxscore.NON_ESSENTIAL_SHARE", share)
    monkeypatch.setattr("docassay.llm.maxscore.STRETCHES", (20, 300))
    r = np.random.default_rng(3)
    v = r.integers(-9, 10, (n, 12)) * np.array([9, 9, 5, 3, 2, 1, 1, 1, 1, 0, 0, 0])
    queries = np.concatenate([v[:30], r.integers(-9, 10, (10, 12))])
    ids = np.arange(n)
    q, vec, score = maxscore(ids, v, np.r_[ids[:30], -np.ones(10, np.int64)], queries, 20)
    for i in range(40):
        every = v @ queries[i]
        order = [j for j in np.lexsort((ids, -every)) if i >= 30 or j != i][:20]
        assert vec[q == i].tolist() == order and score[q == i].tolist() == every[order].tolist()


def test_postings_that_are_not_essential_are_not_read():
    r = np.random.default_rng(9)
    v = r.integers(-4, 5, (6000, 16))
    v[:, 0] *= 100
    shard, read = Shard(np.arange(6000), v), []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and self.ndim == 2:
                read.append(len(key))
            return super().__getitem__(key)

    shard._as[np.float32] = shard.as_kind(np.float32).view(Watched)
    shard.best(np.array([-1]), v[:1], 20)
    assert read and max(read) < 16


def test_few_essential_terms_suffice():
    r = np.random.default_rng(9)
    v = r.integers(-4, 5, (6000, 16))
    v[:, 0] *= 12
    q, vec, score = maxscore(np.arange(6000), v, np.array([-1]), v[:1], 20)
    full = v @ v[0]
    assert sorted(score.tolist()) == sorted(np.sort(full)[-20:].tolist())


def test_tables(spark, monkeypatch):
    monkeypatch.setattr("docassay.llm.maxscore.LEAST_SHARD", 50)
    monkeypatch.setattr("docassay.llm.maxscore.QUERY_BLOCK", 4)
    r = np.random.default_rng(1)
    data = [(i, [float(x) for x in r.normal(size=6)]) for i in range(260)]
    data += [(i, data[0][1]) for i in range(300, 400)]
    odd = [(1000, None), (1001, [1.0, None]), (1020, [float("nan")] * 6), (1040, [float("inf")] * 6), (None, data[0][1]), (1060, []), (1080, [1.0])]
    df = spark.createDataFrame([(*x, 1) for x in data + odd], "vec_id long, embedding array<float>, score int")
    vectors = df.select("vec_id", scaled("embedding").alias("vector"), "score")
    got = sorted(map(tuple, top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()))
    f = lambda v: [int(np.floor(64 * float(np.float32(x)))) for x in v] + [0] * (6 - len(v))
    rows = [(i, f(v)) for i, v in data + [(1060, []), (1080, [1.0])]]
    assert got == brute(rows, [x for x in rows if x[0] % 20 == 0], 20)


def test_large_components(spark):
    rows = [(0, [3e6, 1.0]), (1, [-1.0, 3e6]), (2, [3e6, 3e6]), (3, [0.5, -0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", scaled("embedding").alias("vector"))
    assert df.first().vector == [192_000_000, 64]
    got = sorted(map(tuple, top_k(df, df.where("vec_id = 0"), 20).collect()))
    ints = [(i, [int(64 * x) for x in v]) for i, v in rows]
    assert got == brute(ints, ints[:1], 20)
    for e in ([1e300], [2.0**57]):
        with pytest.raises(Exception, match="too large"):
            spark.createDataFrame([(0, e)], "vec_id long, embedding array<double>").select(scaled("embedding")).collect()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, vector array<int>")
    assert top_k(empty, empty).count() == 0
