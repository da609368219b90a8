import random
import re
from collections import Counter, defaultdict
from itertools import product

import pytest

from docassay.llm.mixing import fit_budget, mix, source_targets


@pytest.mark.parametrize("seed", range(30))
def test_fit_is_as_near_as_brute_force(seed):
    r = random.Random(seed)
    sizes = r.sample(range(0, 40), 4)
    counts = [r.randrange(1, 4) for _ in sizes]
    budget = r.randrange(sum(s * c for s, c in zip(sizes, counts)) + 1)
    got = fit_budget(sizes, counts, budget)
    assert all(0 <= t <= c for t, c in zip(got, counts))
    near = lambda t: abs(sum(s * n for s, n in zip(sizes, t)) - budget)
    options = product(*(range(c + 1 if s else 1) for s, c in zip(sizes, counts)))
    assert near(got) == min(map(near, options))


def nearest(sizes, counts, budget):
    """The least distance of any sum, over the set of all sums."""
    sums = {0}
    for s, c in zip(sizes, counts):
        sums = {x + k * s for x in sums for k in range(c + 1)}
    return min(abs(x - budget) for x in sums)


@pytest.mark.parametrize("seed", range(10))
def test_few_documents_of_any_size_are_fitted_as_near_as_can_be(seed):
    r = random.Random(seed)
    for _ in range(100):
        unit = r.choice([1, 1, 1, 7, 1000])
        sizes = sorted({unit * r.randrange(1, r.choice([50, 60_000, 400_000]) // unit + 2) for _ in range(r.randrange(1, 6))})
        counts = [r.randrange(1, 5) for _ in sizes]
        budget = r.randrange(sum(s * c for s, c in zip(sizes, counts)) + 1)
        got = fit_budget(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(got, counts))
        assert abs(sum(s * t for s, t in zip(sizes, got)) - budget) == nearest(sizes, counts, budget)


def test_the_case_that_a_greedy_part_missed():
    got = fit_budget([56451, 56984, 40666, 44568], [1, 3, 2, 4], 153089)
    assert abs(sum(s * t for s, t in zip([56451, 56984, 40666, 44568], got)) - 153089) == 1012


def test_large_budget():
    sizes, counts = list(range(1, 3000)), [7] * 2999
    total = sum(sizes) * 7
    for budget in (0, 1, total // 3, total - 1, total):
        got = fit_budget(sizes, counts, budget)
        assert sum(s * t for s, t in zip(sizes, got)) == budget and max(got) <= 7
    assert fit_budget([], [], 5) == [] and fit_budget([0], [9], 5) == [0]


@pytest.mark.parametrize("sizes,counts,budget,want", [
    ([300_000], [5], 800_000, 900_000), ([300_000], [5], 750_000, 600_000), ([70_000, 500_000], [3, 2], 620_000, 640_000),
    ([300_000, 1], [5, 200_000], 800_000, 800_000), ([2_000_000, 1_999_999], [2, 2], 5_000_000, 5_999_998), ([10**7], [1], 10**7 - 1, 10**7),
])
def test_very_long_documents(sizes, counts, budget, want):
    got = fit_budget(sizes, counts, budget)
    assert sum(s * t for s, t in zip(sizes, got)) == want and all(t <= c for t, c in zip(got, counts))


@pytest.mark.parametrize("seed", range(20))
def test_what_is_left_to_the_programme_is_bounded(seed, monkeypatch):
    monkeypatch.setattr("docassay.llm.mixing.PROGRAMMED", 8)
    r = random.Random(seed)
    sizes = r.sample(range(1, 40), 6)
    counts = [r.randrange(1, 9) for _ in sizes]
    budget = r.randrange(sum(s * c for s, c in zip(sizes, counts)) + 1)
    got = fit_budget(sizes, counts, budget)
    assert all(0 <= t <= c for t, c in zip(got, counts))
    assert abs(sum(s * t for s, t in zip(sizes, got)) - budget) <= min(sizes)


def test_targets():
    assert source_targets([], (3, 1, 2), 1.5, 2) == []
    got = dict(source_targets([(None, 10), ("b", 100), ("a", 4), ("é", 50)], (3, 1, 2), 1.5, 2))
    # a is capped at 8; 238 are left for b : é : null = 1 : 2 : 3; null then é reach their caps
    assert got == {"a": 8.0, None: 20.0, "é": 100.0, "b": 118.0}


def test_documents(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.choice([1, 40, 200])) if i % 50 else None, r.choice(["a", "b", "c", "dd", None])) for i in range(700)]
    rows += [(7, "x y\tz\n\x0bq\xa0r", "a")] * 3 + [(None, "n u l l", "b"), (1, "", "c")]
    rows += [(1000 + i, "same text", "hot") for i in range(400)]
    df = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, source string, target int").repartition(5)
    got = mix(df).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((x.doc_id, x.size) for x in got) == Counter((i, words(t)) for i, t, _ in rows)
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += words(t)
    want = dict(source_targets(list(total.items()), (3, 1, 2), 1.5, 2.0))
    source = {i: s for i, _, s in rows if i not in (1, 7, None)}
    sums = defaultdict(int)
    for x in got:
        assert x.taken == x.times * x.size and x.times in (0, 1, 2)
        if x.doc_id in source:
            assert x.source_size == total[source[x.doc_id]] and x.target == want[source[x.doc_id]]
        sums[x.target, x.source_size] += x.taken
    for (target, _), taken in sums.items():
        assert abs(taken - target) <= 2, (target, _, taken)
    again = Counter(map(tuple, mix(df.repartition(2)).collect()))
    assert again == Counter(map(tuple, got))


@pytest.mark.parametrize("bits", [2, 12])
def test_hot_sizes_are_ranked_in_cells(spark, monkeypatch, bits):
    monkeypatch.setattr("docassay.llm.mixing.CELL_BITS", bits)
    df = spark.range(1000).selectExpr("id AS doc_id", "'a b c' AS text", "if(id % 4 = 0, 'x', 'y') AS source")
    got = mix(df).collect()
    for source_size in {x.source_size for x in got}:
        own = [x for x in got if x.source_size == source_size]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 3


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
