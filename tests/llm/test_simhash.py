import random

import pytest
import xxhash
from pyspark.sql import functions as F

from docassay.llm.simhash import components, hex16, links, near_duplicates, simhash64


def brute(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, " \t\n", "One", "one two", "A b c d e", "É a\xa0b c", "x " * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_matches_brute_force(text):
    assert simhash64(None if text is None else text.encode(), 3) == brute(text)


def test_hash_equals_sparks_own(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0]
    assert h % 2**64 == xxhash.xxh64_intdigest("a b é".encode(), seed=42)


def reachable(values, radius):
    left, out = set(values), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if bin(x ^ y).count("1") <= radius}
            left -= near
            todo += near
        out |= {x: frozenset(group) for x in group}
    return out


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_keep_every_component(spark, radius):
    r = random.Random(radius)
    values = {0, 2**64 - 1, 3, 7}
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(8):
            values.add(x)
            for b in r.sample(range(64), r.choice([1, 2, 3])):
                x ^= 1 << b
    want = reachable(values, radius)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    fps = spark.createDataFrame([(signed(v),) for v in sorted(values)], "fp long").repartition(3)
    got = {r["node"] % 2**64: r["root"] % 2**64 for r in components(links(fps, radius)).collect()}
    for v, group in want.items():
        assert {u for u in want if got.get(u, u) == got.get(v, v)} == group


def test_cut_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr("docassay.llm.simhash.MIN_TILE", 8)
    values = {1 << a | 1 << b for a in range(16) for b in range(16) if a != b}
    fps = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")
    roots = components(links(fps, 2)).collect()
    assert {r["node"] for r in roots} == values and len({r["root"] for r in roots}) == 1


def test_a_hot_centre(spark):
    centre = 0x0F0F0F0F0F0F0F0F
    values = {centre, *(centre ^ 1 << a for a in range(63)), *(centre ^ 1 << a ^ 1 << b for a in range(63) for b in range(a))}
    fps = spark.createDataFrame([(v,) for v in sorted(values)], "fp long").repartition(3)
    roots = components(links(fps, 2)).collect()
    assert {r["node"] for r in roots} == values and {r["root"] for r in roots} == {min(values)}
    star = spark.range(1, 200_000).selectExpr("id AS a", "0L AS b").union(spark.createDataFrame([(200_000, 199_999)], "a long, b long"))
    assert components(star).where("root = 0").count() == 200_001


def test_documents(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(300))
    rows = [(10, base), (4, base.upper()), (7, base + " end"), (8, "quite another text here"), (None, base), (1, ""), (2, None), (8, "quite another text here")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, component_id string")
    got = sorted(near_duplicates(docs).select("doc_id", hex16("fp"), "component_id").collect(), key=str)
    assert len(got) == len(rows)
    by = {r[0]: (r[1], r[2]) for r in got}
    assert all(by[i][0] == f"{brute(t):016x}" for i, t in rows)
    assert by[10][1] == by[4][1] == by[None][1] == 4 and by[1] == by[2] == ("0" * 16, 1) and by[8][1] == 8
    near = bin(int(by[7][0], 16) ^ int(by[10][0], 16)).count("1") <= 2
    assert by[7][1] == (4 if near else 7)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
