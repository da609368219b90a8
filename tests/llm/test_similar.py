"""The pipeline's near-dedup against brute force over shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from docassay.llm.simhash import family_links, keep_one_of_similar, similar_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def edited_copies():
    r = random.Random(4)
    rows, word = [], lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    for _ in range(40):
        base = [word() for _ in range(r.randrange(60, 300))]
        copies = [base]
        for _ in range(4):
            words = list(r.choice(copies))
            for _ in range(r.randrange(0, 1 + len(words) // 40)):
                words[r.randrange(len(words))] = word()
            del words[len(words) - r.randrange(0, len(words) // 12) :]
            copies.append(words)
        rows += [" ".join(x) for x in copies]
    rows += [rows[0].upper(), "", None, " \n", "one two", "One  two", "one"]
    r.shuffle(rows)
    return [(i, t, "aa", "s", len(t or "")) for i, t in enumerate(rows)]


def test_edited_copies_are_found_and_others_stay(spark):
    rows = edited_copies()
    sets = [shingles(x[1]) for x in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {x.doc_id for x in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert got == set(root) and len(got) < len(rows) / 2


def test_a_large_group_and_pairs_below_the_limit(spark):
    r = random.Random(5)
    words = [str(r.random()) for _ in range(200)]
    near = [(i, " ".join([*words[:-1], str(i)])) for i in range(300)]
    far = [(1000 + i, " ".join([f"{i}-{w}" if k % 18 == 0 else w for k, w in enumerate(words)])) for i in range(6)]
    assert not linked(shingles(far[0][1]), shingles(far[1][1]))
    got = keep_one_of_similar(spark.createDataFrame(near + far, "doc_id long, text string"))
    assert {x.doc_id for x in got.collect()} == {0, *(i for i, _ in far)}


def components(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        old, new = max(root[i], root[j]), min(root[i], root[j])
        root = [new if x == old else x for x in root]
    return root


@pytest.mark.parametrize("seed", range(8))
def test_similar_sets_against_all_pairs(seed):
    r = random.Random(seed)
    sets = []
    for _ in range(40):
        base = r.sample(range(2000 if seed % 2 else 60), r.randrange(1, 30))
        for _ in range(r.randrange(1, 6)):
            drop = r.sample(base, min(len(base) - 1, r.randrange(3)))
            sets.append({*base} - {*drop} | {r.randrange(3000) for _ in range(r.randrange(3))})
    sets = [set(x) for x in {frozenset(x) for x in sets}]
    arrays = [np.array(sorted(x), np.uint64) for x in sets]
    sides = np.array([r.randrange(2) for _ in sets])
    good = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    assert components(len(sets), similar_sets(arrays, None, 0.8)) == components(len(sets), good)
    across = [(i, j) for i, j in good if sides[i] != sides[j]]
    assert components(len(sets), similar_sets(arrays, sides, 0.8)) == components(len(sets), across)


def test_families_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr("docassay.llm.simhash.MIN_TILE", 7)
    monkeypatch.setattr("docassay.llm.simhash.MAX_TILE", 7)
    monkeypatch.setattr("docassay.llm.simhash.FAMILY_PIECE", 10)
    r = random.Random(8)
    rows = []
    for k in range(60):
        hi, lo = r.getrandbits(62), r.getrandbits(62)
        for _ in range(4):
            rows.append((len(rows), r.randrange(70, 140), hi ^ 1 << r.randrange(60), lo ^ 1 << r.randrange(60)))
    edges = family_links(spark.createDataFrame(rows, "c long, n long, hi long, lo long").repartition(3), 32, 0.8).collect()
    near = lambda x, y: bin(x[2] ^ y[2]).count("1") + bin(x[3] ^ y[3]).count("1") <= 32 and min(x[1], y[1]) >= 0.8 * max(x[1], y[1])
    want = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if near(rows[i], rows[j])])
    assert components(len(rows), [(e.a, e.b) for e in edges]) == want
    words = [str(r.random()) for _ in range(100)]
    chain = [(i, " ".join([*words[: 100 - i], *(f"x{i}" for i in range(i))])) for i in range(35)]
    assert [x.doc_id for x in keep_one_of_similar(spark.createDataFrame(chain, "doc_id long, text string")).collect()] == [0]
