import random
from zlib import crc32

import numpy as np
import pytest

from docassay.llm import q_language_id, q_quality
from docassay.llm.bytecnn import OVERLAP, STRIDE, WINDOW, Filters, cut, window_count
from docassay.llm.classifiers import LanguageModel, QualityModel, identify_languages, labelled_sample, remainder, score_quality
from docassay.sources import read_table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [0, 1, OVERLAP, 255, 256, 257, 496, 497, 5000])
def test_windows_cover_whole_texts(n):
    text = bytes(1 + i % 255 for i in range(n))
    flat, starts, first = cut([b"abc", text, b""])
    own = starts[first[1] : first[2]]
    assert len(own) == window_count(n) and len(starts) == len(own) + 2
    windows = flat[own[:, None] + np.arange(WINDOW)]
    joined = b"".join(w[: STRIDE if k < len(own) - 1 else WINDOW].tobytes() for k, w in enumerate(windows))
    assert joined[:n] == text and not any(joined[n:])


def test_pair_lookups_equal_training_answers():
    rng = np.random.default_rng(0)
    f = Filters.fresh(rng, (2, 3, 5), 4)
    f.bias[:] = rng.normal(size=12)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 10, 700)]
    flat, starts, _ = cut(texts)
    raw, _ = f.pooled(flat[starts[:, None] + np.arange(WINDOW)])
    assert np.allclose(f.features(flat, starts), np.maximum(raw, 0), atol=1e-4)


def test_gradients_are_the_differences():
    rng = np.random.default_rng(1)
    f = Filters.fresh(rng, (2, 3), 3)
    f.tables = [t.astype(np.float64) for t in f.tables]
    x = rng.integers(0, 9, (4, 20)).astype(np.uint8)
    g = rng.normal(size=(4, 6)).astype(np.float32)
    raw, at = f.pooled(x)
    grads = f.gradients(x, at, g)
    byte, step = int(x[0, 3]), 1e-3
    for k in (0, 1):
        before = (f.pooled(x)[0] * g).sum()
        f.tables[k][1, byte, 2] += step
        after = (f.pooled(x)[0] * g).sum()
        f.tables[k][1, byte, 2] -= step
        assert abs((after - before) / step - grads[k][1, byte, 2]) < 0.05


def test_remainder(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, 123456, -3, None)], "doc_id long")
    for r in rows.select("doc_id", remainder("doc_id", 3).alias("m")).collect():
        assert r.m == (None if r.doc_id is None else crc32(str(r.doc_id).encode()) % 3)


def test_languages_of_held_out_documents(spark):
    docs = read_table(spark, SF, "documents")
    got = q_language_id.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([x.lang == x.lang_pred for x in got]) > 0.97
    assert all(0 <= x.score <= 1 for x in got)


def test_quality_of_held_out_documents(spark):
    got = q_quality.query(spark, SF).join(read_table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    right = [x.predicted == x.quality for x in got]
    assert len(got) > 100 and np.mean(right) > 0.95
    for label in (0, 1):
        assert np.mean([r for r, x in zip(right, got) if x.quality == label]) > 0.8


def test_odd_rows(spark):
    rng = random.Random(1)
    word = {"a": "abc", "b": "xyz"}
    text = lambda k: " ".join("".join(rng.choice(word[k]) for _ in range(4)) for _ in range(30))
    rows = [(i, text(k), k) for i, k in enumerate("ab" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    model = LanguageModel.train(labelled_sample(df.drop("text"), df.drop("label"), 1, 50))
    odd = [(1, None, 1, 2), (2, "", 1, 2), (3, "123 !?", 1, 2), (3, "aabb cab " * 20000, 1, 2), (3, "xzy yzx", 1, 2), (None, "xzy yzx", 1, 2)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang_pred int, extra int")
    got = identify_languages(docs, model)
    assert got.columns == ["doc_id", "text", "extra", "lang_pred", "score"]
    assert [x.lang_pred for x in got.collect()] == ["und", "und", "und", "a", "b", "b"]
    empty = spark.createDataFrame([], "doc_id long, text string, label string")
    assert labelled_sample(empty, empty, 1) == [] and labelled_sample(df.drop("text"), empty.drop("label"), 1) == []
    assert {x.lang_pred for x in identify_languages(docs, LanguageModel.train([])).collect()} == {"und"}
    assert [x.lang_pred for x in identify_languages(docs, LanguageModel.train([("q", [b"a"])])).collect()][3] == "q"
    scored = score_quality(docs, QualityModel.train([])).collect()
    assert {x.score for x in scored} == {0.5} and {x.predicted for x in scored} == {1}
    one = score_quality(docs, QualityModel.train([(1, [b"a"])] * 8)).first()
    assert abs(one.score - 0.9) < 1e-9
    assert score_quality(empty, QualityModel.train([])).count() == 0 and identify_languages(empty, model).count() == 0
    good = [(k, [t.encode()]) for k, t in ((int(label == "a"), t) for _, t, label in rows)]
    scored = score_quality(docs, QualityModel.train(good, least_steps=100)).collect()
    assert all(0 <= x.score <= 1 for x in scored) and [x.predicted for x in scored[3:]] == [1, 0, 0]
