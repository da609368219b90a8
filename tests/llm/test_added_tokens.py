"""Added tokens in a text: ids as the unmodified `tokenizers` file gives them."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docassay.llm.packing import pack
from docassay.llm.tokens import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def contract():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [END, f"a {END} x", f"{END}{END}", f" {END}\n", f"a{END}b  c", "<|endoftext| >", f"<|endof{END}text|>", ""])
def test_ids(contract, text):
    assert np.frombuffer(byte_bpe(PATH).all_ids(text), "<u4").tolist() == contract(text)


def test_random_texts(contract):
    r = random.Random(9)
    for _ in range(200):
        text = "".join(r.choice([END, "the", " ", "  ", "\n", "é", "<|", "|>", "'s", "7"]) for _ in range(30))
        assert np.frombuffer(byte_bpe(PATH).all_ids(text), "<u4").tolist() == contract(text)


def test_packed_lengths(spark, contract):
    texts = [f"a {END} x", "plain text", END]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.doc_tokens for x in pack(docs, PATH, length=64).collect()}
    assert got == {i: len(contract(t)) + 1 for i, t in enumerate(texts)}
