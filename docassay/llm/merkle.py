"""Document fingerprints: a Merkle tree over sections, paragraphs and spans.

Sections are separated by an empty line, paragraphs by a line end, and a
paragraph's leaves are its spans of up to 48 code points, so that an edit shifts
no span outside its paragraph. A node is the MD5 of its children in hex, the
root the SHA-256 of the sections: equal texts have equal roots, and going down
the branches that differ locates an edit.

A fingerprint is one string: root|sections|paragraphs|leaves. Below the root
every node shows its first 8 digits; "." separates paragraphs, "/" sections.
Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.common import shared_checkpoint

SPAN = 48
SHOWN = 8


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """`df` with the fingerprint of `text_col` (null: of the empty text) in `out`.

    Each level is a column of its own, so that it is computed once.
    """
    span = F.lit(f"(?s).{{1,{SPAN}}}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    leaves = F.transform(
        F.split(text, "\n\n", -1),
        lambda section: F.transform(
            F.split(section, "\n", -1),
            lambda paragraph: F.transform(F.regexp_extract_all(paragraph, span, F.lit(0)), F.md5),
        ),
    )
    shown = lambda digests: F.array_join(F.transform(digests, lambda d: F.left(d, F.lit(SHOWN))), "")
    node = lambda digests: F.md5(F.array_join(digests, ""))
    return (
        df.withColumn("__leaves", leaves)
        .withColumn("__paragraphs", F.transform("__leaves", lambda s: F.transform(s, node)))
        .withColumn("__sections", F.transform("__paragraphs", node))
        .withColumn(
            out,
            F.concat_ws(
                "|",
                F.sha2(F.array_join("__sections", ""), 256),
                shown(F.col("__sections")),
                F.array_join(F.transform("__paragraphs", shown), "/"),
                F.array_join(
                    F.transform("__leaves", lambda s: F.array_join(F.transform(s, shown), ".")), "/"
                ),
            ),
        )
        .drop("__leaves", "__paragraphs", "__sections")
    )


def root(fingerprint: Column | str) -> Column:
    return F.substring_index(fingerprint, "|", 1)


def _leaves(fingerprint: Column | str) -> Column:
    last = F.substring_index(fingerprint, "|", -1)
    return F.array_distinct(F.regexp_extract_all(last, F.lit("[0-9a-f]{8}"), F.lit(0)))


def likeness(a: Column | str, b: Column | str) -> Column:
    """1 for equal roots, else twice the distinct leaves in common over those of both (0 to 1).

    Null if a fingerprint is null.
    """
    x, y = _leaves(a), _leaves(b)
    both = F.size(x) + F.size(y)
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(
        F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), both.cast("double")), F.lit(0.0))
    )


def edited_branches(a: Column | str, b: Column | str) -> Column:
    """Where two fingerprints differ: an array of (section, paragraph) positions from 0.

    Only sections whose digests differ are gone into, and of them the paragraphs
    whose digests differ, position by position. Empty for equal roots.
    """
    part = lambda f, k: F.split(F.element_at(F.split(f, r"\|", -1), k), "/", -1)
    eight = lambda s: F.regexp_extract_all(s, F.lit("[0-9a-f]{8}"), F.lit(0))
    pairs = lambda x, y: F.zip_with(x, y, lambda p, q: F.struct(p.alias("x"), q.alias("y")))
    differ = lambda s: ~s["x"].eqNullSafe(s["y"])
    found = F.flatten(
        F.transform(
            pairs(part(a, 3), part(b, 3)),
            lambda s, k: F.when(
                differ(s),
                F.filter(
                    F.transform(
                        pairs(eight(F.coalesce(s["x"], F.lit(""))), eight(F.coalesce(s["y"], F.lit("")))),
                        lambda p, n: F.when(differ(p), F.struct(k.alias("section"), n.alias("paragraph"))),
                    ),
                    lambda x: x.isNotNull(),
                ),
            ).otherwise(F.array().cast("array<struct<section:int,paragraph:int>>")),
        )
    )
    return F.when(root(a) == root(b), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(found)


def neighbours(keys: DataFrame) -> DataFrame:
    """Each (doc_id, h) with that of the next in ascending order, after the last the first.

    `keys` holds distinct pairs (nulls first) and further columns, which stay.
    Sorted by range, so that no task holds more than one range; the first pair
    of each range, a row a partition, closes the gaps.
    """
    ranges = shared_checkpoint(
        keys.repartitionByRange("doc_id", "h").withColumn("__range", F.spark_partition_id())
    )
    inside = Window.partitionBy("__range").orderBy("doc_id", "h")
    firsts = ranges.groupBy("__range").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    all_ranges = Window.orderBy("__of")
    following = firsts.select(F.col("__range").alias("__of"), "first").select(
        "__of",
        F.coalesce(F.lead("first").over(all_ranges), F.first("first").over(all_ranges)).alias("__after"),
    )
    return (
        ranges.withColumn("next", F.lead(F.struct("doc_id", "h")).over(inside))
        .join(F.broadcast(following), F.col("__range") == F.col("__of"))  # a row a partition
        .withColumn("next", F.coalesce("next", "__after"))
        .drop("__range", "__of", "__after")
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, fingerprint, edited_fingerprint, next_fingerprint for every row.

    edited: the text with its last quarter of code points (rounded down) replaced
    by as many (or all) first ones of the next document in ascending doc_id
    (nulls first, equal ids by text hash; after the last the first). Null texts
    are empty. Rows that repeat both id and text are one document in that order
    and get the same result. A single document is its own next one. Other
    columns are not read; an empty table gives an empty result.

    Fingerprints of the texts are made once, before the texts are shuffled; from
    a document to the one before it go only the code points that it needs and
    the fingerprint. A fingerprint grows with its text: 8 digits a span.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text"))
    keys = shared_checkpoint(
        rows.groupBy("doc_id", "h").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows"))
    )
    order = neighbours(keys.drop("rows"))
    to_previous = order.select(
        F.col("next.doc_id").alias("d"), F.col("next.h").alias("g"), F.struct("doc_id", "h").alias("to"), F.floor(F.col("n") / 4).cast("int").alias("quarter")
    )
    same = lambda d, g: F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("h") == F.col(g))
    printed = with_fingerprint(rows, "text", "fingerprint")
    sent = printed.join(to_previous, same("d", "g")).select(
        F.col("to.doc_id").alias("to_d"),
        F.col("to.h").alias("to_g"),
        F.left("text", "quarter").alias("beginning"),
        F.col("fingerprint").alias("next_fingerprint"),
    )
    if keys.where("rows > 1").limit(1).count():
        sent = sent.dropDuplicates(["to_d", "to_g"])
    n = F.length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 4).cast("int")), "beginning")
    met = printed.join(sent, same("to_d", "to_g")).withColumn("edited", edited)
    return with_fingerprint(met, "edited", "edited_fingerprint").select(
        "doc_id", "text", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint"
    )
