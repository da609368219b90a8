"""The pipeline's stages against plain Python, one after the other."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from docassay.llm.mixing import mixed_documents
from docassay.llm.simhash import simhash64

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(8)
    letters = {"aa": "abcde", "bb": "vwxyz"}
    rows = []
    for i in range(120):
        lang = "aa" if i % 3 else "bb"
        lines = [" ".join("".join(r.choice(letters[lang]) for _ in range(5)) for _ in range(r.randrange(4, 30))) for _ in range(r.randrange(1, 6))]
        if i % 4 == 0:
            lines.append(f"{' ' * (i % 3)}Shared Line\t")
        text = "\n".join(lines)
        rows.append([i, text, lang, f"s{i % 5}" if i % 7 else None, len(text)])
    rows += [[200 + k, rows[1][1], "aa", "s1", 3] for k in range(15)]
    rows += [[300, None, None, "s0", 0], [301, "", None, "s0", 0], [302, "12 !?", None, "s1", 5], [None, "vvv www xxx", "bb", "s2", 2]]
    return rows


def test_every_stage(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "packing"]

    found = stages["language_id"](spark, docs, "").cache()
    want = [tuple(r) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert found.columns == COLUMNS and Counter(map(tuple, found.collect())) == Counter(want)

    cleaned = stages["line_dedup"](spark, found, "").cache()
    where = defaultdict(set)
    for i, text, *_ in want:
        for x in text.split("\n"):
            where[x.strip(" \t").lower()].add(i)
    want = [(i, t, *rest, len(t)) for i, text, *rest, _ in want for t in ["\n".join(x for x in text.split("\n") if len(where[x.strip(" \t").lower()]) < 10)]]
    assert cleaned.columns == COLUMNS and Counter(map(tuple, cleaned.collect())) == Counter(want)
    assert "Shared Line" not in "".join(t for _, t, *_ in want)

    kept = stages["simhash_near_dedup"](spark, cleaned, "").cache()
    left = sorted(want, key=lambda x: (x[0] is None, x[0] or 0))
    fp = {x: simhash64(x[1].encode(), 3) for x in left}
    groups = []
    for x in left:
        near = [g for g in groups if any(bin(fp[x] ^ fp[y]).count("1") <= 2 for y in g)]
        groups = [g for g in groups if g not in near] + [[x, *(y for g in near for y in g)]]
    best = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups]
    assert kept.columns == COLUMNS and Counter(map(tuple, kept.collect())) == Counter(best)

    mixed = stages["mixing"](spark, kept, "").cache()
    assert mixed.columns == COLUMNS
    taken, all_words = Counter(map(tuple, mixed.collect())), Counter()
    assert set(taken) <= set(best) and max(taken.values()) <= 2
    for x in best:
        all_words[x[3]] += len(x[1].split())
    total = sum(len(x[1].split()) * n for x, n in taken.items())
    assert abs(total - 1.5 * sum(all_words.values())) <= 5

    pieces = stages["packing"](spark, mixed, "").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for x, n in taken.items():
        tokens[x[0]] += n * (len(tokenizer.encode(x[1], add_special_tokens=False).ids) + 1)
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == tokens


def test_run_over_a_table(spark):
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    by_row = defaultdict(list)
    for p in pieces:
        by_row[p.row].append(p)
    for own in by_row.values():  # a document that the mix takes twice has two rows
        own.sort(key=lambda p: p.start)
        assert len({p.doc_id for p in own}) == 1 and sum(p.length for p in own) == own[0].doc_tokens
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    copies = Counter(own[0].doc_id for own in by_row.values())
    assert len(copies) > 50 and max(copies.values()) == 2


def test_repeated_rows_in_a_mix(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "a b", "y"), (1, "c d e", "x"), (None, "f", "x"), (None, "f", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = Counter(map(tuple, mixed_documents(df).collect()))
    most = Counter(rows)
    assert all(got[k] <= 2 * most[k] for k in got) and 0.9 < sum(len(k[1].split()) * n for k, n in got.items()) / (1.5 * sum(len(r[1].split()) for r in rows)) < 1.1


def test_empty_table(spark):
    assert corpus_pipeline.run.__doc__
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name
    assert np.int64(0) == 0
