"""The join of similar names against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docassay.operators import names
from docassay.operators.names import similar_names


def brute(rows, threshold):
    """{id: (similar names, least id)} by comparing all names, as 0/1 rows of bigrams."""
    normal = {i: " ".join("".join(c for c in (n or "").upper() if "A" <= c <= "Z" or c.isspace()).split()) for i, n in rows}
    least = {}
    for i, x in normal.items():
        if x:
            least[x] = min(i, least.get(x, i))
    names = sorted(least)
    sets = [{p[k : k + 2] for k in range(len(p) - 1)} for p in (x.replace(" ", "") for x in names)]
    grams = {g: k for k, g in enumerate(sorted(set().union(*sets)))} if sets else {}
    has = np.zeros((len(names), len(grams)), np.float32)
    for k, s in enumerate(sets):
        has[k, [grams[g] for g in s]] = 1
    sizes = has.sum(1)
    found = {}
    for k, x in enumerate(names):
        both = has @ has[k]
        near = np.flatnonzero(both >= threshold * (sizes + sizes[k] - both) - 1e-4) if sizes[k] else []
        others = [names[j] for j in near if j != k and sizes[j]]
        found[x] = (len(others), min(least[o] for o in [x, *others]))
    return {i: found.get(x, (0, None)) for i, x in normal.items()}


def got(spark, rows, threshold=0.75):
    df = spark.createDataFrame([(*x, 1, "n") for x in rows], "id long, person string, similar_names int, name string").repartition(3)
    found = similar_names(df, "id", "person", threshold)
    assert found.columns == ["id", "person", "name", "similar_names", "first_id"]
    return {x.id: (x.similar_names, x.first_id) for x in found.collect()}


@pytest.mark.parametrize("threshold", [0.75, 0.5, 1.0])
def test_odd_names(spark, threshold):
    names = ["Anil Sharma", "ANIL  SHARMA", "anil sharmaa", "Anil Sharm", "A", "B", "a", "", None, " . ", "aaaa", "aaab", "aa", "ab", "É", "x y", "xy", "xyz", "Anil Sharma"]
    rows = list(enumerate(names)) + [(100 + k, "hot name") for k in range(300)]
    assert got(spark, rows, threshold) == brute(rows, threshold)


def test_ten_thousand_names(spark):
    r = random.Random(2)
    first, last = (["".join(r.choice("abdehiklmnoprstuy") for _ in range(r.randrange(3, 9))) for _ in range(120)] for _ in range(2))
    rows = []
    for k in range(10_000):
        name = list(r.choice(first) + " " + r.choice(last))
        for _ in range(r.choice([0, 0, 1, 2])):
            name[r.randrange(len(name))] = r.choice("abcdexyz")
        rows.append((k, "".join(name)))
    want = brute(rows, 0.75)
    assert sum(n for n, _ in want.values()) > 500
    assert got(spark, rows) == want


@pytest.mark.parametrize("threshold", [0.3, 0.75, 0.9])
def test_short_and_long_names(spark, threshold):
    """Sets of 1 to more than LONG bigrams, which meet by sizes or under single bigrams."""
    r = random.Random(5)
    whole = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150)) for _ in range(4)]
    rows = list(enumerate(w[k : k + n] for w in whole for n in (2, 3, 4, 5, 9, 30, 47, 48, 49, 50, 55, 60, 65, 100, 149) for k in (0, 1)))
    assert got(spark, rows, threshold) == brute(rows, threshold)


def test_few_names_meet_by_chance(spark, monkeypatch):
    """Of 4,000 names of 12 bigrams out of 256, a million pairs would meet under single bigrams."""
    r = random.Random(6)
    rows = [(k, "".join(r.choice("abcdefghijklmnop") for _ in range(13))) for k in range(4000)]
    looked_at = spark.sparkContext.accumulator(0)

    def counted(function, name):
        seen = F.udf(lambda x: looked_at.add(1) or x, "int").asNondeterministic()
        return lambda x: seen(function(x)) if name in str(x) else function(x)

    monkeypatch.setattr(names.F, "size", counted(F.size, "both"))
    monkeypatch.setattr(names.F, "bit_count", counted(F.bit_count, "a_w0"))
    assert len(got(spark, rows)) == 4000
    assert 0 < looked_at.value < 100_000


def test_no_records(spark):
    assert got(spark, []) == {}
