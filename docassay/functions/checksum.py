"""Verhoeff's check digit as one expression, without UDF or higher-order function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verhoeff's permutation; its powers apply from right to left.
PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _product(a: int, b: int) -> int:
    """Of the dihedral group of order ten: 0-4 turn, 5-9 turn and mirror."""
    turned = (a + (b if a < 5 else -b)) % 5
    return turned + 5 * ((a < 5) != (b < 5))


def product_table() -> list[int]:
    """The group's table, row after row."""
    return [_product(a, b) for a in range(10) for b in range(10)]


def permutations() -> list[list[int]]:
    """The first eight powers of the permutation."""
    out = [list(range(10))]
    while len(out) < 8:
        out.append([out[-1][PERMUTATION[d]] for d in range(10)])
    return out


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def check_value(digits: Column, length: int = 12) -> Column:
    """0 for a valid number of `length` digits; other values tell what is wrong by group element."""
    table = F.array(*map(F.lit, product_table()))
    powers = [F.array(*map(F.lit, p)) for p in permutations()]
    value = F.lit(0)
    for i in range(length):
        digit = F.substring(digits, length - i, 1).try_cast("int")
        value = F.get(table, value * 10 + F.get(powers[i % 8], digit))
    return value


def is_valid(number: Column, length: int = 12) -> Column:
    """True for `length` digits (others are skipped) that start with 2 to 9 and check; null is false."""
    digits = digits_only(F.coalesce(number, F.lit("")))
    return (
        (F.length(digits) == length)
        & digits.rlike("^[2-9]")
        & F.coalesce(check_value(digits, length) == 0, F.lit(False))
    )


def score(number: Column) -> Column:
    """100 valid, 0 invalid, 40 if there is no number."""
    return F.when(F.coalesce(number, F.lit("")) == "", 40).when(is_valid(number), 100).otherwise(0)
