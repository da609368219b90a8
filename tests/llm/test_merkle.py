import random
import re
from hashlib import md5, sha256

from docassay.llm.merkle import compare_with_next, edited_branches, likeness, root, with_fingerprint

hexed = lambda s: md5(s.encode()).hexdigest()


def brute(text):
    leaves = [[[hexed(p[i : i + 48]) for i in range(0, len(p), 48)] for p in s.split("\n")] for s in (text or "").split("\n\n")]
    paragraphs = [[hexed("".join(p)) for p in s] for s in leaves]
    sections = [hexed("".join(s)) for s in paragraphs]
    cut = lambda x: "".join(d[:8] for d in x)
    tree = [sha256("".join(sections).encode()).hexdigest(), cut(sections), "/".join(map(cut, paragraphs))]
    return "|".join([*tree, "/".join(".".join(map(cut, s)) for s in leaves)])


def alike(a, b):
    if a.split("|")[0] == b.split("|")[0]:
        return 1.0
    x, y = (set(re.findall("[0-9a-f]{8}", f.split("|")[3])) for f in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_rows(spark):
    r = random.Random(1)
    text = lambda: "".join(r.choice("abé漢😀 \n\n.") for _ in range(r.choice([0, 3, 60, 400])))
    rows = [(i * 3, text()) for i in range(40)] + [(500, None), (501, ""), (502, "x" * 100000), (4, "A"), (4, "B"), (None, "no id")]
    rows += [(7, "again\n\nand again")] * 3
    df = spark.createDataFrame([(*x, "f") for x in rows], "doc_id long, text string, h string").repartition(4)
    h = {(x.doc_id, x.text): x.k for x in df.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) k").collect()}
    order = sorted(h, key=lambda k: (k[0] is not None, k[0] or 0, h[k]))
    got = compare_with_next(df).select("*", likeness("fingerprint", "edited_fingerprint").alias("e"), likeness("fingerprint", "next_fingerprint").alias("n")).collect()
    assert len(got) == len(rows)
    for x in got:
        nxt = order[(order.index((x.doc_id, x.text)) + 1) % len(order)][1]
        q = len(x.text) // 4
        assert x.edited == x.text[: len(x.text) - q] + nxt[:q]
        assert (x.fingerprint, x.edited_fingerprint, x.next_fingerprint) == (brute(x.text), brute(x.edited), brute(nxt))
        assert x.e == alike(x.fingerprint, x.edited_fingerprint) and x.n == alike(x.fingerprint, x.next_fingerprint)


def test_branches_locate_edits(spark):
    a = "one\ntwo\n\nthree\nfour\n\nfive"
    cases = {a: [], a.replace("four", "fuor"): [(1, 1)], a.replace("one", "1").replace("five", "5\n6"): [(0, 0), (2, 0), (2, 1)]}
    df = spark.createDataFrame([(a, b) for b in cases], "a string, b string")
    df = with_fingerprint(with_fingerprint(df, "a", "fa"), "b", "fb")
    for x in df.select("b", edited_branches("fa", "fb").alias("at"), (root("fa") == root("fb")).alias("same")).collect():
        assert [tuple(p) for p in x["at"]] == cases[x["b"]] and x["same"] == (x["b"] == a)


def test_few_rows(spark):
    assert compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = compare_with_next(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited == "abcdefab" and one.fingerprint == one.next_fingerprint


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = compare_with_next(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
