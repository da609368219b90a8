"""District names by trigrams and ranges by blocks, against loops."""

import contextlib
import io
import random

import pytest

from docassay.operators.districts import state_of_district
from docassay.operators.ranges import first_of_ranges


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def loop(claims, districts):
    """expected_state of each claim by comparing it with all names."""
    out = []
    for c in claims:
        q = (c or "").strip(" ").lower()
        exact = [(o, s) for o, d, s in districts if d == q and q]
        partial = [(o, s) for o, d, s in districts if d is not None and q and (d in q or q in d)]
        out.append(min(exact or partial, default=(0, None))[1])
    return out


ODD = [(1, "pune", "M"), (2, "pu", "short"), (3, "north pune rural", "N"), (4, "x", "letter"), (5, "aaaa", "A"), (6, "aaaaaa", "A6"), (7, None, "null"), (9, "pune", "later"), (8, "über", "U")]
CLAIMS = ["Pune", "une", "ne", "n", "p", "x", "Pune City", "the x", "aaa", "aaaaa", "zz", "", " ", None, "ÜBER", "ural", "north", "a", "puneri", "unknown place"]


@pytest.mark.parametrize("more", [[], [(0, "", "nameless")], [(99, "", "nameless")]])
def test_odd_names(spark, more):
    districts = ODD + more
    known = spark.createDataFrame([(*x, 5) for x in districts], "ord int, district string, state string, q int")
    claims = spark.createDataFrame([(i, c, "old", "s") for i, c in enumerate(CLAIMS)], "i int, district string, expected_state string, s string")
    got = {x.i: x.expected_state for x in state_of_district(claims, known).collect()}
    assert [got[i] for i in range(len(CLAIMS))] == loop(CLAIMS, districts)


def test_a_hundred_thousand_names(spark):
    r = random.Random(3)
    parts = ["pur", "nagar", "gan", "raj", "dev", "kot", "bad", "ra", "i", "north ", "new "]
    names = {"".join(r.choice(parts) for _ in range(r.randrange(2, 6))) + str(r.randrange(10_000)) for _ in range(120_000)}
    districts = [(i, d, f"S{i % 40}") for i, d in enumerate(r.sample(sorted(names), 100_000))]
    claims = []
    for _ in range(150):
        d = r.choice(districts)[1]
        a, b = sorted(r.sample(range(len(d) + 1), 2))
        claims.append(r.choice([d, d.upper() + " city", d[a:b], d[a:b] + "q"]))
    known = spark.createDataFrame(districts, "ord int, district string, state string")
    asked = spark.createDataFrame(list(enumerate(claims)), "i int, district string")
    found = state_of_district(asked, known)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    got = {x.i: x.expected_state for x in found.collect()}
    assert [got[i] for i in range(len(claims))] == loop(claims, districts)


def test_no_names_and_no_claims(spark):
    known = spark.createDataFrame([], "ord int, district string, state string")
    asked = spark.createDataFrame([(1, "a"), (2, None)], "i int, district string")
    assert {tuple(x) for x in state_of_district(asked, known).select("i", "expected_state").collect()} == {(1, None), (2, None)}
    assert state_of_district(asked.limit(0), spark.createDataFrame(ODD, "ord int, district string, state string")).count() == 0


def check_ranges(spark, ranges, points):
    table = spark.createDataFrame([(*x, 1) for x in ranges], "ord int, low long, high long, value string, p int")
    asked = spark.createDataFrame([(i, p, "old", 2) for i, p in enumerate(points)], "i int, pin long, value string, block int")
    found = first_of_ranges(asked, table, "pin")
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {x.i: x.value for x in found.collect()}
    held = lambda p: [(o, v) for o, low, high, v in ranges if None not in (low, high, p) and p >= 0 and low <= p <= high]
    assert [got[i] for i in range(len(points))] == [min(held(p), default=(0, None))[1] for p in points]


@pytest.mark.parametrize("top", [0, 1, 7, 100, 1023, 1024, 2**40])
def test_ranges_of_all_shapes(spark, top):
    r = random.Random(top)
    ranges = [(k, *sorted(r.randrange(top + 1) for _ in range(2)), f"v{k}") for k in range(60)]
    ranges += [(70, 5, 3, "empty"), (71, None, 9, "null"), (72, 3, None, "null"), (-1, -9, 0, "from below"), (80, 0, top, "all")]
    points = [None, -1, 0, 1, top, top + 1, *(r.randrange(top + 2) for _ in range(80)), *(x[1] for x in ranges), *(x[2] for x in ranges)]
    check_ranges(spark, ranges, points)


def test_a_hundred_thousand_ranges(spark):
    r = random.Random(9)
    ranges = []
    for k in range(100_000):
        low = r.randrange(900_000)
        ranges.append(((k * 7919) % 1_000_003, low, low + r.choice([0, 3, 500, 90_000]), f"v{k % 50}"))
    check_ranges(spark, ranges, [r.randrange(1_000_000) for _ in range(200)])


def test_numbers_in_blocks_are_not_broadcast(spark, tmp_path):
    """A few bytes of numbers become many rows of blocks, which Spark's guess of sizes does not see."""
    spark.range(5000).selectExpr("id AS pin").write.parquet(f"{tmp_path}/points")
    spark.range(5000).selectExpr("id AS ord", "id * 3 AS low", "id * 3 + 99 AS high", "string(id) AS value").write.parquet(f"{tmp_path}/ranges")
    found = first_of_ranges(spark.read.parquet(f"{tmp_path}/points"), spark.read.parquet(f"{tmp_path}/ranges"), "pin")
    assert "BroadcastExchange" not in plan_of(found)
    assert {(x.pin, x.value) for x in found.collect()} == {(p, str(max(0, -(-(p - 99) // 3)))) for p in range(5000)}


def test_no_ranges(spark):
    check_ranges(spark, [], [1, None])
