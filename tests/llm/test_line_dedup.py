import random

from docassay.llm.line_dedup import drop_common_lines

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, least, min_chars):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    where = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            where.setdefault(low(x.strip(WHITE)), set()).add(("text", t) if i is None else i)
    gone = {k for k, d in where.items() if len(d) >= least and len(k) >= max(1, min_chars)}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if low(x.strip(WHITE)) not in gone]
        out.append((i, t if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(1)
    pool = ["", " ", "Header", "header ", "\tHEADER", "É", "é", "a", "bb", "ünï", "x\r", "very long " * 400]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(6)))) for i in range(60)]
    rows += [(3, "Header\nHeader"), (3, "Header\nHeader"), (None, "bb"), (None, "bb\na"), (70, None), (71, ""), (72, "\n\n")]
    docs = spark.createDataFrame(
        [(i, t, "k", 5) for i, t in rows], "doc_id long, text string, key string, n_lines int"
    ).repartition(3)
    for least, chars in ((10, 1), (2, 1), (10, 2), (5, 4)):
        got = drop_common_lines(docs, least, chars)
        assert got.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
        found = sorted([(x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got.collect()], key=str)
        assert found == brute(rows, least, chars)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_common_lines(empty).count() == 0
