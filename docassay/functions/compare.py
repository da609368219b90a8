"""Comparators between an OCR reading and a QR payload.

Each gives true or false; a caller that has no value on one side skips the
comparison (null) before it comes here. Empty or null sides compare as false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) != ""


def not_missing(value: Column) -> Column:
    """The value, or null where it is null, empty, "None" or a dash."""
    return F.when(~F.trim(value).isin("", "None", "—"), value)


def normal_name(name: Column) -> Column:
    upper = F.upper(F.coalesce(name, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(upper, r"[^A-Za-z\s]", ""), r"\s+", " "))


def bigrams(normal: Column) -> Column:
    """Distinct pairs of neighbours, spaces left out."""
    packed = F.replace(normal, F.lit(" "), F.lit(""))
    n = F.length(packed)
    return F.when(
        n >= 2,
        F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(packed, i, 2))),
    ).otherwise(F.array().cast("array<string>"))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard of bigrams; 1 if equal, 0.5 if a side has no bigram, 0 if one is empty."""
    x, y = normal_name(a), normal_name(b)
    p, q = bigrams(x), bigrams(y)
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when((F.size(p) == 0) | (F.size(q) == 0), 0.5)
        .otherwise(F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q)))
    )


def names_match(a: Column, b: Column, threshold: float = 0.75) -> Column:
    x, y = normal_name(a), normal_name(b)
    few = (F.size(bigrams(x)) == 0) | (F.size(bigrams(y)) == 0)
    return (
        F.when((x == "") | (y == ""), False)
        .when(x == y, True)
        .when(few, F.contains(x, y) | F.contains(y, x))
        .otherwise(name_similarity(a, b) >= threshold)
    )


def _slashed(dob: Column) -> Column:
    return F.regexp_replace(F.trim(dob), r"[-/.]", "/")


def dobs_match(a: Column, b: Column) -> Column:
    """Equal with any separator, or day and month swapped in the same year."""
    x, y = _slashed(a), _slashed(b)
    p, q = F.split(x, "/", -1), F.split(y, "/", -1)
    swapped = (
        (F.size(p) == 3)
        & (F.size(q) == 3)
        & (F.get(p, 2) == F.get(q, 2))
        & (F.get(p, 0) == F.get(q, 1))
        & (F.get(p, 1) == F.get(q, 0))
    )
    return F.when(~present(a) | ~present(b), False).otherwise((x == y) | F.coalesce(swapped, F.lit(False)))


def pins_match(a: Column, b: Column) -> Column:
    x, y = (F.regexp_replace(F.coalesce(v, F.lit("")), r"[^0-9]", "") for v in (a, b))
    return (x == y) & (F.length(x) == 6)


def places_match(a: Column, b: Column) -> Column:
    """Equal, or one holds the other, whatever the case."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when(~present(a) | ~present(b), False).otherwise(F.contains(x, y) | F.contains(y, x))


def differing_positions(a: Column, b: Column, length: int) -> Column:
    """Positions of two strings of `length` characters that differ."""
    out = F.lit(0)
    for i in range(1, length + 1):
        out = out + (F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int")
    return out


def numbers_match(ocr: Column, qr_full: Column, qr_last4: Column, qr_secure: Column) -> Column:
    """Twelve digits with at most one misread, else the last four; null where the secure payload has none."""
    x = F.regexp_replace(ocr, r"[^0-9]", "")
    y = F.regexp_replace(qr_full, r"[^0-9]", "")
    return (
        F.when(F.coalesce(ocr, F.lit("")) == "", False)
        .when((F.length(x) == 12) & (F.length(y) == 12), differing_positions(x, y, 12) <= 1)
        .when((F.coalesce(qr_last4, F.lit("")) != "") & (F.length(x) == 12), F.right(x, F.lit(4)) == qr_last4)
        .when(F.coalesce(qr_secure, F.lit(False)), F.lit(None).cast("boolean"))
        .otherwise(False)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, as doubles; null where a norm is zero."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs; 64 where one is null."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)).cast("int"), F.lit(64))
