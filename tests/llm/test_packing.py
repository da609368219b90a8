import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docassay.llm.packing import pack
from docassay.llm.tokens import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n a", "a\n", "x  y", "it's we'll 'tis", "é ü 漢字   z", "<|endoftext|> x", "a <|endoftext|> x", "x <|endoftext|>", "1 23 four5", "a\x1c b", "\r\n\r\n q", "z" * 3000]


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_tokenizers_library(plain, text):
    assert np.frombuffer(byte_bpe(PATH).all_ids(text), "<u4").tolist() == plain(text)


def test_random_texts(plain):
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["a", "the", " ", "  ", "\n", "é", "!", "9", "\t", "'s", " ", "Z"]) for _ in range(40))
        assert np.frombuffer(byte_bpe(PATH).all_ids(text), "<u4").tolist() == plain(text)


def check(rows, docs, plain, length):
    """Every id in one piece, sequences gapless and not too long; returns the share of padding."""
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(plain(t or "") + [0])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
        by_seq[x.sequence_id].append((x.offset, x.length))
        assert len(x.ids) == 4 * x.length and zlib.crc32(x.ids) == x.ids_crc32
    assert by_doc.keys() == want.keys()
    for i, pieces in by_doc.items():
        if len(want[i]) == 1:
            pieces.sort(key=lambda x: x.start)
            assert np.frombuffer(b"".join(x.ids for x in pieces), "<u4").tolist() == want[i][0]
            at = 0
            for x in pieces:
                assert x.start == at and x.doc_tokens == len(want[i][0])
                at += x.length
        assert sum(x.length for x in pieces) == sum(map(len, want[i]))
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= length
        padding += length - at
    return padding / (len(by_seq) * length)


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_round_trip(spark, plain, parts):
    r = random.Random(parts)
    docs = [(i, " ".join(f"word{r.randrange(99)}" for _ in range(r.choice([0, 1, 5, 40, 300])))) for i in range(150)]
    docs += [(900, None), (901, ""), (5, "again"), (5, "again"), (None, "no id"), (902, "long " * 9000), (903, "end <|endoftext|> of <|endoftext|>")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int").repartition(parts)
    rows = pack(df, PATH, 128, windows=4, with_ids=True).collect()
    assert check(rows, docs, plain, 128) < 0.05
    by_row = defaultdict(list)
    for x in rows:
        by_row[x.row].append(x)
    assert len(by_row) == len(docs)
    for pieces in by_row.values():  # also those of rows that repeat an id
        pieces.sort(key=lambda x: x.start)
        assert [x.start for x in pieces] == [sum(y.length for y in pieces[:k]) for k in range(len(pieces))]
        assert len({x.doc_id for x in pieces}) == 1 and sum(x.length for x in pieces) == pieces[0].doc_tokens


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
