"""The pipeline's language stage: the model's answer decides."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the house stands near the water and all the people of the town know what they want there".split(),
    "de": "das haus steht nicht weit vom wasser und alle leute der stadt wissen was sie dort wollen".split(),
}


def clean(n):
    r = random.Random(6)
    return [(i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randrange(12, 80))), lang, "s", 1) for i in range(n) for lang in ["en" if i % 2 else "de"]]


def kept(spark, rows):
    return {x.doc_id for x in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()}


def test_text_in_no_language_goes_and_clean_text_stays(spark):
    r = random.Random(7)
    rows = clean(160)
    odd = ["".join(r.choice("0123456789.,;:-+*/ ") for _ in range(300)) + "a", " ".join("".join(r.choice("bcdfghjkqvwxzy") for _ in range(7)) for _ in range(60)), "\u041f\u0440\u0438\u0432\u0435\u0442 \u043a\u0430\u043a \u0434\u0435\u043b\u0430 \u0441\u0435\u0433\u043e\u0434\u043d\u044f"]
    assert kept(spark, rows + [(900 + k, x, None, "s", 1) for k, x in enumerate(odd)]) == {x[0] for x in rows}


def test_without_labels_texts_with_letters_stay(spark):
    rows = [(i, t, None, s, n) for i, t, _, s, n in clean(8)]
    assert kept(spark, rows + [(90, "12 !", None, "s", 1), (91, None, None, "s", 0)]) == set(range(8))


def test_one_language(spark):
    rows = [x for x in clean(40) if x[2] == "en"]
    assert kept(spark, rows + [(90, "9;6/1 2-+* " * 20 + "x", None, "s", 1)]) == {x[0] for x in rows}
