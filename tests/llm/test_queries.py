"""The registered queries themselves over the smallest tables: against their SQL, or plain Python where there is none."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docassay.llm import q_language_id, q_quality, registry
from docassay.llm.bytecnn import OVERLAP, STRIDE, WINDOW
from docassay.llm.mixing import source_targets
from docassay.sources import read_table
from tests.llm.test_simhash import brute as simhash

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels", "conversations")


@pytest.fixture(scope="module")
def docs(spark):
    return {x.doc_id: x for x in read_table(spark, SF, "documents").collect()}


def rounded(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(registry.oracle_sql()[name])
    order = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted((rounded(r[k] for k in order) for r in found.fetchall()), key=str)
    assert sorted((rounded(r) for r in df.select(*columns).collect()), key=str) == want


def test_op3(spark, docs):
    rows = registry.queries()["op3_sharding"](spark, SF).collect()
    text = {i: (x.text or "").encode() for i, x in docs.items()}
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in text.items())
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    per = Counter(r.shard for r in rows)
    assert sorted(per) == list(range(8)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))


def test_op8(spark, docs):
    rows = registry.queries()["op8_mixing"](spark, SF).collect()
    words = {i: len([w for w in (x.text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]) for i, x in docs.items()}
    total = Counter()
    for i, x in docs.items():
        total[x.source] += words[i]
    target = dict(source_targets(list(total.items()), (3, 1, 2), 1.5, 2.0))
    taken = Counter()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        source = docs[r.doc_id].source
        assert (r["size"], r.source_size) == (words[r.doc_id], total[source]) and abs(r.target - target[source]) < 1e-6
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[source] += r.taken
    for s in target:  # as near as any choice of the source's documents, beyond whole passes over it
        whole = int(target[s] // total[s]) * total[s] if total[s] else 0
        reach = 1
        for i, x in docs.items():
            reach |= reach << words[i] if x.source == s else 0
        best = min(abs(whole + n - target[s]) for n in range(total[s] + 1) if reach >> n & 1)
        assert abs(taken[s] - target[s]) <= best + 0.5 + 1e-6


def test_op9(spark, docs):
    rows = registry.queries()["op9_simhash_near_dedup"](spark, SF).collect()
    prints = {i: simhash(x.text) for i, x in docs.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    component = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for i in docs:
            least = min(component[j] for j in docs if (prints[i] ^ prints[j]).bit_count() <= 2)
            changed |= least != component[i]
            component[i] = least
    assert {r.doc_id: r.component_id for r in rows} == component


def test_op10(spark, docs):
    rows = registry.queries()["op10_packing"](spark, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == docs.keys()
    for i, own in pieces.items():
        ids = np.array([*tokenizer.encode(docs[i].text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    tokens = sum(r.length for r in rows)
    assert len(sequences) * 1024 <= 1.02 * tokens + 1024


def windows(text):
    starts = range(0, max(1, len(text) - OVERLAP), STRIDE)
    return [text[i : i + WINDOW].ljust(WINDOW, b"\0") for i in starts]


def answers(filters, window):
    """Pooled answers of one window, filter by filter and place by place."""
    out = []
    for table in filters.tables:
        width = len(table)
        places = [sum(table[o][window[i + o]].astype(np.float64) for o in range(width)) for i in range(WINDOW - width + 1)]
        out.append(np.max(places, axis=0))
    return np.maximum(np.concatenate(out) + filters.bias, 0)


@pytest.fixture(scope="module")
def some(docs):
    """Short, empty and long texts: a forward pass in plain Python is slow."""
    by_length = sorted(docs.values(), key=lambda x: len(x.text or ""))
    return [*by_length[:4], *by_length[len(by_length) // 2 :][:4], by_length[-1]]


def test_op2_scores_are_the_networks(spark, some):
    table, labels = (read_table(spark, SF, t) for t in ("documents", "labels"))
    model = q_quality.learn(table, labels)
    got = {x.doc_id: x for x in q_quality.query(spark, SF).collect()}
    assert len(got) == table.count()
    for x in some:
        h = np.array([answers(model.filters, w) for w in windows((x.text or "").encode())])
        z = np.concatenate([h.mean(0), h.max(0)]) @ model.dense.astype(np.float64) + model.offset
        assert abs(got[x.doc_id].score - 1 / (1 + np.exp(-z))) < 1e-3
        assert got[x.doc_id].predicted == int(got[x.doc_id].score >= 0.5)
        assert got[x.doc_id].held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1)


def test_op5_scores_are_the_networks(spark, some):
    model = q_language_id.learn(read_table(spark, SF, "documents"))
    got = {x.doc_id: x for x in q_language_id.query(spark, SF).collect()}
    for x in some:
        votes = np.zeros(len(model.labels))
        for w in windows((x.text or "").encode()):
            z = answers(model.filters, w) @ model.dense.astype(np.float64) + model.offset
            votes += z - np.log(np.exp(z - z.max()).sum()) - z.max()
        chance = np.exp(votes - votes.max())
        chance /= chance.sum()
        if x.text and any(c.isalpha() for c in x.text):
            assert got[x.doc_id].lang_pred == model.labels[int(votes.argmax())] and abs(got[x.doc_id].score - chance.max()) < 1e-2
        else:
            assert (got[x.doc_id].lang_pred, got[x.doc_id].score) == ("und", 0.0)
        assert got[x.doc_id].held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2)


