import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from docassay.llm import conversations
from docassay.llm.conversations import Costs, block_weights, cost_and_audit, joined, repaired_rows, repairs, whole, width_of
from docassay.llm.q_conversations import damaged, repaired

SOUND = re.compile(r"(s?(ua)+)?")


def every_repair(rows):
    """(cost, audit, repaired rows) of all edits with up to two insertions in a place; rows: (role, text, fault)."""

    def put(k, cost, audit, said):
        for roles in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
            here = cost + 2 * len(roles), audit + "I" * len(roles), said + [(r, "") for r in roles]
            if k == len(rows):
                yield here
                continue
            (role, text, fault), (c, a, s) = rows[k], here
            yield from put(k + 1, c + 3, a + "D", s)
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                yield from put(k + 1, c, a + "K", [*s, (role, text)])
                for to in ("user", "assistant"):
                    yield from put(k + 1, c + 2, a + "R", [*s, (to, text)])

    return [x for x in put(0, 0, "", []) if SOUND.fullmatch("".join(r[:1] or "-" for r, _ in x[2]))]


def code(role, fault):
    kind = role[:1] if role[:1] in tuple("sua") else "o"
    return "-" if fault in ("blank", "duplicate") else kind.upper() if fault else kind


@pytest.mark.parametrize("seed", range(60))
def test_equals_all_edits(seed):
    r = random.Random(seed)
    rows = [(r.choice(["system", "user", "assistant", "tool", ""]), "x", r.choice(["", "", "truncated", "blank"])) for _ in range(seed % 4)]
    codes = "".join(code(role, fault) for role, _, fault in rows)
    assert cost_and_audit(whole(codes, Costs()), width_of(codes)) == min(every_repair(rows))[:2]


@pytest.mark.parametrize("seed", range(40))
def test_blocks_put_together_equal_the_whole(seed):
    r = random.Random(seed)
    codes = "".join(r.choice("suaoSUA-" if seed % 2 else "ua") for _ in range(r.randrange(2, 90)))
    parts, at = [], 0
    while at < len(codes):
        n = r.randrange(1, 9)
        parts.append(codes[at : at + n])
        at += n
    weights, width = block_weights(parts[0], Costs()), width_of(parts[0])
    for x in parts[1:]:
        weights, width = joined(weights, width, block_weights(x, Costs()), width_of(x)), width + width_of(x)
    assert cost_and_audit(min(weights[0], weights[3]), width) == cost_and_audit(whole(codes, Costs()), width_of(codes))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain(rows, damage=True):
    """The contract by plain Python over (conv_id, turn, role, text); `whole` is held against all edits above."""
    by, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        if k:
            by[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).hexdigest()))
        said, found = [x[1:] for x in own], faults([x[1:] for x in own])
        codes = "".join(code(role, fault) for (role, _), fault in zip(said, found))
        cost, audit = cost_and_audit(whole(codes, Costs()), width_of(codes))
        kept, rest = [], iter(said)
        for a in audit:
            role, text = ("user", "") if a == "I" else next(rest)
            spoken = len(kept) - (kept[0][0][:1] == "s" if kept else 0)
            if a != "D":
                kept.append((role if a == "K" else "assistant" if spoken % 2 else "user", text))
        assert SOUND.fullmatch("".join(role[:1] for role, _ in kept))
        turns = {t for t, *_ in own if t is not None}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(found.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(x not in ("su", "ua", "au") for x in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest(),
        )
    return out


def odd_rows():
    r = random.Random(5)
    texts = ["Yes.", "No!", "cut", "", " \t\x0b", "ends \n", "Why? ", None, "é.", "long. " * 5000, "\xa0"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "User", "", None]), r.choice(texts)) for c in range(60) for t in range(r.randrange(7))]
    rows += [(100, t, ["user", "assistant"][t % 2], f"turn {t // 3}.") for t in range(300)]  # one of a third of all
    rows += [(None, None, "user", "lost."), (None, 3, None, None), (101, None, "user", "a."), (101, None, "assistant", "b."), (101, None, "user", "a.")]
    rows += [(102, 5, "user", "same.")] * 7 + [(103, -(2**63) + 1, "user", "far."), (103, 2**63 - 1, "assistant", "away.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, audit int, cost string"


@pytest.mark.parametrize("block,parts", [(256, 3), (4, 1), (7, 9)])
def test_odd_rows(spark, monkeypatch, block, parts):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = odd_rows()
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], SCHEMA).repartition(parts)
    want = plain(rows)
    want[103] = (min(want[103][0], 2**63 - 1), *want[103][1:])
    assert {x[0]: tuple(x[1:]) for x in repaired(df).collect()} == want


def test_every_row_dropped_leaves_zeros(spark):
    dropped = [(c, t) for c in range(300) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:4]
    df = spark.createDataFrame([(c, t, "user", "x.") for c, t in dropped], "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(x) for x in repaired(df).collect()} == {(c, 0, 0, 0, 0, 0, 0, "", empty) for c, _ in dropped}
    assert damaged(df).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repairs(df).count() == 0 and repaired(df).count() == 0


def test_rows_of_the_operator(spark):
    rows = [("a", 1, "system", "Be kind."), ("a", 2, "user", "Hi."), ("a", 3, "user", "Hi?"), ("b", 1, "assistant", "Well."), ("c", 1, "tool", "")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    found = repairs(df)
    assert {(x.conv_id, x.n_rows, x.cost, x.audit) for x in found.collect()} == {("a", 3, 2, "KKR"), ("b", 1, 2, "IK"), ("c", 1, 3, "D")}
    got = [tuple(x) for x in repaired_rows(df, found).orderBy("conv_id", "position").collect()]
    assert got == [
        ("a", 0, "K", 1, "system", "Be kind."), ("a", 1, "K", 2, "user", "Hi."), ("a", 2, "R", 3, "assistant", "Hi?"),
        ("b", 0, "I", None, "user", ""), ("b", 1, "K", 1, "assistant", "Well."),
    ]


def test_sql_on_odd_rows(spark):
    """The registered SQL says the same as the plain Python, ties of turns included."""
    import pandas as pd

    from docassay.llm.q_conversations import SQL

    rows = [x for x in odd_rows() if x[0] != 103]
    con = duckdb.connect()
    con.register("pandas_rows", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM pandas_rows")
    assert {x[0]: tuple(x[1:]) for x in con.execute(SQL).fetchall()} == plain(rows)

