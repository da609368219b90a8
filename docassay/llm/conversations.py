"""Conversation structure repair by integer weights.

A conversation is sound if its roles read `(s?(ua)+)?` by their initials. The
cheapest edits that make it so are found by a dynamic programme over four states
(what has been said so far), from the last row to the first. A path's weight is
one integer: its cost in the high digits, below it the audit, a digit of three
bits for each edit in order, padded with zeros at the end. So the least integer
has the least cost and, of equal costs, the audit that comes first in ASCII; no
other comparison decides anything.

No conversation has to come together in one task for that. Rows go without their
texts (role, digest, faults), counted where they repeat, are range-partitioned
in reading order and cut into blocks. A block is worked off for every state
before and after it (4 x 4 weights), and the blocks of a conversation are
multiplied in order, minimum for sum. That is exact: two different audits of a
block for the same states and the same cost never are a prefix of one another,
since an audit has a letter for each row and what it has beyond are insertions,
which cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import ASCII_SPACE, pieces, shared_checkpoint

#: Edits in ASCII order, which is that of their digits 1 to 4; 0 is the padding.
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = ".DIKR"
DIGIT = 3
#: What has been said: nothing, a system row, a user's row to be answered, an answer.
NOTHING, OPENED, ASKED, ANSWERED = STATES = range(4)
SOUND = (NOTHING, ANSWERED)
#: The state after the next user or assistant row, and after a kept row of a role.
SPOKEN = (ASKED, ASKED, ANSWERED, ASKED)
KEPT = {"s": {NOTHING: OPENED}, "u": {NOTHING: ASKED, OPENED: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}, "o": {}}
LEGAL = {"su", "ua", "au"}
#: Rows of a block. Integers have 9 bits a row, so work on a block grows with its square.
BLOCK = 256
LONG_MAX = 2**63 - 1


class Costs(NamedTuple):
    """Of edits (all above 0), and what a truncated row costs that stays."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


def width_of(codes: str) -> int:
    """Digits that any path over the rows can need: each row's edit, two insertions before it and two at the end."""
    return 3 * len(codes) + 2


def backward(codes: str, after: list[int], costs: Costs, width: int) -> list[int]:
    """The least weight from every state before the rows, given the weights after them.

    A row's code is its role's initial (`o`: no such role), upper case if it is
    truncated, or `-` if it has to go. Two insertions in one place suffice: a
    third would return to a state that was there two insertions before.
    """
    top = DIGIT * width
    digits = (1 << top) - 1

    def edited(letter: int, cost: int, rest: int) -> int:
        return (rest >> top) + cost << top | letter << top - DIGIT | (rest & digits) >> DIGIT

    def with_insertions(best: list[int]) -> list[int]:
        once = [min(best[s], edited(INSERT, costs.insert, best[SPOKEN[s]])) for s in STATES]
        return [min(best[s], edited(INSERT, costs.insert, once[SPOKEN[s]])) for s in STATES]

    best = with_insertions(after)
    for code in reversed(codes):
        edits = [[edited(DELETE, costs.delete, best[s])] for s in STATES]
        if code != "-":
            more = costs.truncated if code.isupper() else 0
            for s, to in KEPT[code.lower()].items():
                edits[s].append(edited(KEEP, more, best[to]))
            for s in STATES:
                edits[s].append(edited(REROLE, costs.rerole + more, best[SPOKEN[s]]))
        best = with_insertions([min(x) for x in edits])
    return best


def unreachable(width: int) -> int:
    return 1 << DIGIT * width + 64


@lru_cache(maxsize=1 << 15)
def whole(codes: str, costs: Costs) -> int:
    """The weight of a whole conversation."""
    width = width_of(codes)
    far = unreachable(width)
    return backward(codes, [0 if s in SOUND else far for s in STATES], costs, width)[NOTHING]


def block_weights(codes: str, costs: Costs) -> list[int]:
    """Weights by state before (rows of four) and after."""
    width = width_of(codes)
    far = unreachable(width)
    columns = [backward(codes, [0 if s == to else far for s in STATES], costs, width) for to in STATES]
    return [columns[to][s] for s in STATES for to in STATES]


def joined(first: list[int], width: int, second: list[int], width2: int) -> list[int]:
    """The weights of two blocks in a row; they have `width` + `width2` digits."""
    top, top2 = DIGIT * width, DIGIT * width2
    digits, digits2, far = (1 << top) - 1, (1 << top2) - 1, unreachable(width + width2)

    def after_each_other(a: int, b: int) -> int:
        if a >> top + 64 or b >> top2 + 64:
            return far
        audit = a & digits
        empty = ((audit & -audit).bit_length() - 1) // DIGIT if audit else width  # its digits of padding
        return (a >> top) + (b >> top2) << top + top2 | audit << top2 | (b & digits2) << DIGIT * empty

    return [min(after_each_other(first[4 * s + m], second[4 * m + to]) for m in STATES) for s in STATES for to in STATES]


def cost_and_audit(weight: int, width: int) -> tuple[int, str]:
    top = DIGIT * width
    digits = format(weight & (1 << top) - 1, "o").zfill(width).rstrip("0")
    return weight >> top, digits.translate({ord("0") + k: x for k, x in enumerate(LETTERS)})


class Stretch:
    """Rows of one conversation in order: counts, its ends, weights."""

    #: Counts are added up; of the ends, `first` and `low` are the first stretch's, `last` and `high` the last one's.
    COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
    ENDS = ("first", "last", "low", "high")
    TYPES = [(x, pa.int64()) for x in COUNTS] + [("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64())]
    __slots__ = (*COUNTS, *ENDS, "codes", "width", "weights", "before")

    def __init__(self):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = self.before = None
        self.codes, self.width, self.weights = [], 0, []

    def add(self, turn, kind: str, fault: str | None) -> None:
        if self.n == 0:
            self.first = kind
        elif self.last + kind not in LEGAL:
            self.illegal += 1
        self.n, self.last = self.n + 1, kind
        if fault is not None:
            setattr(self, fault, getattr(self, fault) + 1)
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.codes.append("-" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)

    def then(self, other: "Stretch") -> "Stretch":
        out = Stretch()
        for x in self.COUNTS:
            setattr(out, x, getattr(self, x) + getattr(other, x))
        out.illegal += self.last + other.first not in LEGAL
        out.turns -= self.high is not None and self.high == other.low
        out.first, out.last = self.first, other.last
        out.low = other.low if self.low is None else self.low
        out.high = self.high if other.high is None else other.high
        out.weights, out.width = joined(self.weights, self.width, other.weights, other.width), self.width + other.width
        return out

    @property
    def gaps(self) -> int:
        return 0 if self.high is None else min(LONG_MAX, self.high - self.low + 1 - self.turns)


def _with_order(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest: nulls as one space; rows of a turn come by role, then by MD5 of the text."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("digest", F.md5(F.col("text").cast("binary")))


def _flagged(conversations: DataFrame) -> DataFrame:
    """A row for each different (conv_id, turn, role, digest): kind, blank, truncated, duplicate, and n, how often it is there."""
    said = F.rtrim("text", F.lit(ASCII_SPACE))
    kind: Column = F.substring("role", 1, 1)
    rows = _with_order(conversations).select(
        "conv_id", "turn", "role", "digest",
        F.when(kind.isin("s", "u", "a"), kind).otherwise("o").alias("kind"),
        (said == "").alias("blank"),
        (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    # only what is said in several turns is looked up again, and such a row may be split by Spark in the join
    first = (
        counted.groupBy(F.col("conv_id").alias("__conv"), F.col("role").alias("__role"), F.col("digest").alias("__digest"))
        .agg(F.min(F.struct(F.isnotnull("turn").alias("known"), "turn")).alias("__first"), F.count("*").alias("__turns"))
        .where("__turns > 1")
    )
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest"))
    later = F.col("__first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("__first.turn"))
    return counted.join(first, same, "left").select(*counted.columns, later.alias("duplicate"))


def _stretches(flagged: DataFrame, costs: Costs) -> DataFrame:
    """Blocks of conversations in reading order; `part` and `seq` number them."""
    from pyspark.sql.pandas.types import to_arrow_type

    order = ["conv_id", "turn", "role", "digest"]
    ordered = flagged.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = flagged.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("part", pa.int32()), ("seq", pa.int64()), *Stretch.TYPES, ("width", pa.int64()), ("weights", pa.list_(pa.binary()))])
    ddl = f"conv_id {kind.simpleString()}, part int, seq long, n long, blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, low long, high long, width long, weights array<binary>"

    def blocks(batches: Iterator[pa.RecordBatch]):
        """(conv_id, rows, whether they are all of the conversation): that is known but for the first and the last here."""
        conv, rows, begun = None, None, False
        for batch in batches:
            for c, turn, kind, blank, truncated, duplicate, n in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if rows is None or c != conv:
                    if rows is not None:
                        yield conv, rows, begun and rows.before is None
                    begun, conv, rows = rows is not None, c, Stretch()
                for copy in range(n):
                    if rows.n == BLOCK:
                        yield conv, rows, False
                        rows = Stretch()
                        rows.before = True
                    rows.add(turn, kind, "blank" if blank else "duplicate" if duplicate or copy else "truncated" if truncated else None)
        if rows is not None:
            yield conv, rows, False

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []

        def table():
            columns = list(zip(*out)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for seq, (conv, rows, complete) in enumerate(blocks(batches)):
            codes = "".join(rows.codes)
            weights = [whole(codes, costs)] if complete else block_weights(codes, costs)
            counts = [getattr(rows, x) for x, _ in Stretch.TYPES]
            out.append((conv, part, seq, *counts, width_of(codes), [w.to_bytes(w.bit_length() // 8 + 1, "little") for w in weights]))
            if len(out) == 1024:
                yield table()
                out.clear()
        yield table()

    columns = ["conv_id", "turn", "kind", "blank", "truncated", "duplicate", "n"]
    return ordered.select(*columns).mapInArrow(of_partition, ddl)


def repairs(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """A row for each conv_id: n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit.

    `conversations` has conv_id (any type that can be ordered), turn (an
    integer), role and text; other columns are not read. Rows are taken by turn,
    nulls first, those of one turn by role, then by MD5 of the text. A null role
    or text is one space, a null conv_id is a conversation of its own. A row's
    first fault counts: blank (only ASCII white space), duplicate (role and text
    were there before), truncated (does not end in `.`, `!` or `?`). illegal:
    neighbours whose initials are not su, ua or au; gaps: numbers of turns left
    out (at most the largest long). Blank and duplicate rows have to be deleted.
    audit: the initials of the cheapest edits Delete, Insert, Keep, Rerole, of
    equal costs the first in ASCII. An empty table gives an empty result.

    A task holds a block of BLOCK rows, and when blocks are put together their
    weights, some 20 bytes for each row of one conversation; the audit, a cell of
    the result, has itself a byte for each.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    stretches = _stretches(_flagged(conversations), costs)
    kind = conversations.schema["conv_id"].dataType
    names = ["n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *((x, pa.int64()) for x in names), ("audit", pa.string())])
    ddl = f"conv_id {kind.simpleString()}, {', '.join(f'{x} long' for x in names)}, audit string"

    def result(conv, stack: list[tuple[int, Stretch]]) -> tuple:
        while len(stack) > 1:
            (_, b), (_, a) = stack.pop(), stack.pop()
            stack.append((0, a.then(b)))
        rows = stack[0][1]
        weight = rows.weights[0] if len(rows.weights) == 1 else min(rows.weights[s] for s in SOUND)
        cost, audit = cost_and_audit(weight, rows.width)
        return conv, rows.n, rows.gaps, rows.blank, rows.duplicate, rows.truncated, rows.illegal, cost, audit

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, stack, out = None, [], []  # stack: stretches of 2^level blocks, so that each weight is joined log times

        def table():
            columns = list(zip(*out)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for c, _, _, *fields, width, weights in zip(*(x.to_pylist() for x in batch.columns)):
                if stack and c != conv:
                    out.append(result(conv, stack))
                    stack = []
                    if len(out) == 4096:
                        yield table()
                        out.clear()
                conv, rows, level = c, Stretch(), 0
                for (x, _), v in zip(Stretch.TYPES, fields):
                    setattr(rows, x, v)
                rows.width, rows.weights = width, [int.from_bytes(w, "little") for w in weights]
                while stack and stack[-1][0] == level:
                    rows, level = stack.pop()[1].then(rows), level + 1
                stack.append((level, rows))
        if stack:
            out.append(result(conv, stack))
        yield table()

    dealt = stretches.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return dealt.mapInArrow(put_together, ddl)


def repaired_rows(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, position, edit, turn, role, text.

    `found` is what `repairs` gave for the same rows, written down (its audits
    are read here). Kept rows stay as they are, reroled ones have role user or
    assistant, inserted ones (turn null) an empty text too. All rows of a
    conversation are in one partition, in order: they stream past one task, which
    holds the audit and a batch of rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = conversations.schema["conv_id"].dataType
    audits = found.select("conv_id", F.lit(False).alias("row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    rows = _with_order(conversations).select("conv_id", F.lit(True).alias("row"), "turn", "role", "digest", "text")
    together = audits.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "row", "turn", "role", "digest")
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    ddl = f"conv_id {kind.simpleString()}, position long, edit string, turn long, role string, text string"

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, position, out = None, "", 0, NOTHING, 0, []

        def say(edit: str, turn, role: str | None, text: str) -> None:
            nonlocal state, position
            to = SPOKEN[state] if role is None or edit != "K" else KEPT[role[0]][state]
            out.append((conv, position, edit, turn, role if edit == "K" else "assistant" if to == ANSWERED else "user", text))
            state, position = to, position + 1

        def insertions() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                say("I", None, None, "")
                at += 1

        def table():
            columns = list(zip(*out)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in pieces(batches):
            for c, row, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not row:
                    insertions()
                    conv, audit, at, state, position = c, text, 0, NOTHING, 0
                    continue
                insertions()
                if audit[at] != "D":
                    say(audit[at], turn, role, text)
                at += 1
            yield table()
        insertions()
        yield table()

    return together.select("conv_id", "row", "turn", "role", "text").mapInArrow(edited, ddl)


def text_digests(rows: DataFrame) -> DataFrame:
    """conv_id, sha256: over `role:text` of `repaired_rows`, joined by newlines; conversations without rows are left out."""
    import hashlib

    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("sha256", pa.string())])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        for batch in pieces(batches):
            done = []
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if sha is None or c != conv:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256(line)
                else:
                    sha.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], f.type) for k, f in enumerate(schema)], schema=schema)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], schema[0].type), pa.array([sha.hexdigest()])], schema=schema)

    return rows.select("conv_id", "role", "text").mapInArrow(digested, f"conv_id {kind.simpleString()}, sha256 string")


def repaired_digests(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """`repairs` with repaired_sha256, the digest of the repaired rows (of the empty string where none is left)."""
    found = shared_checkpoint(repairs(conversations, costs))
    digests = text_digests(repaired_rows(conversations, found)).withColumnRenamed("conv_id", "__conv")
    together = found.join(digests, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    return together.select(*found.columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
