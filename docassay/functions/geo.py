"""States from aliases and PINs, name plausibility: expressions over small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.reference_data import (
    NAME_PARTS,
    NAME_SEQUENCES,
    PIN_OVERRIDES,
    PIN_PREFIXES,
    PIN_RANGES,
    STATE_ALIASES,
)


def canonical_state(state: Column) -> Column:
    """The alias's state; any other text, trimmed, as it is."""
    alias = F.create_map(*(F.lit(x) for pair in STATE_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(alias, F.lower(F.trim(state))), F.trim(state))


def _state_of(pin: int, ranges) -> str | None:
    first = lambda table, x: next((state for low, high, state in table if low <= x <= high), None)
    found = first(ranges, pin)
    return (first(PIN_OVERRIDES, pin) or found) if found else PIN_PREFIXES.get(str(pin // 10000))


def pin_segments(longest_match: bool = False) -> list[tuple[int, int, str]]:
    """(first, last, state): disjoint runs of six-digit PINs with the same state, those without one left out."""
    ranges = sorted(PIN_RANGES, key=lambda r: r[1] - r[0]) if longest_match else PIN_RANGES
    cuts = {100_000, 1_000_000}
    for low, high, _ in (*PIN_RANGES, *PIN_OVERRIDES):
        cuts |= {low, high + 1}
    for prefix in PIN_PREFIXES:
        cuts |= {int(prefix) * 10_000, (int(prefix) + 1) * 10_000}
    out: list[tuple[int, int, str]] = []
    order = sorted(cuts)
    for low, after in zip(order, order[1:]):
        state = _state_of(low, ranges)
        if state and out and out[-1][2] == state and out[-1][1] == low - 1:
            out[-1] = (out[-1][0], after - 1, state)
        elif state:
            out.append((low, after - 1, state))
    return out


def with_state_of_pin(df: DataFrame, pin_col: str, out: str, longest_match: bool = False) -> DataFrame:
    """`df` with the state of a six-digit PIN in `out`, null if unknown.

    The first range in order decides, with two overrides, then the prefix. With
    `longest_match` the narrowest range decides, so that states whose range lies
    in another's are found too. The PIN is a number of its own first, so that
    the search over disjoint runs is a chain of plain comparisons.
    """
    digits = F.regexp_replace(F.col(pin_col), r"[^0-9]", "")
    number = F.col("__pin")
    state = F.lit(None).cast("string")
    for low, high, name in reversed(pin_segments(longest_match)):
        state = F.when((number >= low) & (number <= high), name).otherwise(state)
    return df.withColumn("__pin", F.when(F.length(digits) == 6, digits.try_cast("int"))).withColumn(out, state).drop("__pin")


def same_state(expected: Column, stated: Column) -> Column:
    """Equal or one within the other, whatever the case; null where either is unknown."""
    x, y = F.lower(expected), F.lower(canonical_state(stated))
    return F.when((F.coalesce(stated, F.lit("")) != "") & x.isNotNull(), F.contains(x, y) | F.contains(y, x))


def three_way_score(matched: Column, unknown: int) -> Column:
    return F.when(matched, 100).when(~matched, 0).otherwise(unknown)


def with_name_plausibility(df: DataFrame, name_col: str, out: str) -> DataFrame:
    """`df` with struct(score, passed) in `out`: how plausible a holder's name is, 0 to 100.

    Words and counts are columns of their own first.
    """
    upper, words, n = F.col("__upper"), F.col("__words"), F.size("__words")
    letters = F.length(F.replace(upper, F.lit(" "), F.lit("")))
    vowels = F.length(upper) - F.length(F.regexp_replace(upper, "[AEIOU]", ""))
    lower = F.col("__lower")
    held = lambda text, parts: sum((F.contains(text, F.lit(p)).cast("int") for p in parts), F.lit(0))
    counted = (
        df.withColumn("__upper", F.upper(F.trim(F.coalesce(F.col(name_col), F.lit("")))))
        .withColumns({"__words": F.filter(F.split(upper, r"\s+"), lambda w: w != ""), "__lower": F.lower(upper)})
        .withColumns(
            {
                "__repeated": F.size(F.filter(words, lambda w: w.rlike(r"^(.)\1\1+$"))),
                "__identical": (n > 1) & (F.size(F.array_distinct(words)) == 1),
                "__sequences": held(upper, NAME_SEQUENCES),
                "__parts": held(lower, NAME_PARTS),
                "__ratio": vowels / F.greatest(letters, F.lit(1)),
                "__clean": (upper != "") & upper.rlike(r"^[A-Z\s.\-']+$"),
                "__n": n,
            }
        )
    )
    c = F.col
    raw = (
        F.lit(60)
        - 30 * c("__repeated")
        - F.when(c("__identical"), 40).otherwise(0)
        - 35 * c("__sequences")
        + F.when(c("__parts") > 0, F.least(F.lit(25), 10 * c("__parts"))).otherwise(-5)
        - F.when(c("__ratio") < 0.15, 15).when(c("__ratio") > 0.65, 10).otherwise(0)
    )
    scored = counted.withColumn("__full", F.greatest(F.lit(0), F.least(F.lit(100), raw)))
    score = (
        F.when(upper == "", 0).when(~c("__clean"), 20).when(c("__n") < 2, 30).when(c("__n") > 5, 40).otherwise(c("__full"))
    )
    unmarked = (c("__repeated") == 0) & ~c("__identical") & (c("__sequences") == 0)
    passed = c("__clean") & c("__n").between(2, 5) & (c("__full") >= 45) & unmarked
    temporary = ["__upper", "__words", "__lower", "__repeated", "__identical", "__sequences", "__parts", "__ratio", "__clean", "__n", "__full"]
    return scored.withColumn(out, F.struct(score.cast("int").alias("score"), passed.alias("passed"))).drop(*temporary)
