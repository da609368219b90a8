"""Which state a stated district lies in: exact names first, then names that hold each other.

Names that hold each other are found by an inverted index of their trigrams
(pairs and single letters of shorter names) and then compared, so that nothing is
compared with all names: a claim looks for names that hold it under its rarest
trigram, and for names that it holds under each of its own, where every name
stands under its rarest one only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, n: int) -> Column:
    """The distinct parts of n characters; none of a shorter text."""
    at = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def _rarest(names: DataFrame, name: str, frequent: DataFrame) -> DataFrame:
    """(name, gram): the trigram of each name that the fewest known names have; names with one that none has are left out."""
    own = names.select(name, F.explode(grams(F.col(name), GRAM)).alias("gram")).join(frequent, "gram", "left")
    least = own.groupBy(name).agg(F.min(F.struct("n", "gram")).alias("least"), F.count_if(F.col("n").isNull()).alias("unknown"))
    return least.where("unknown = 0").select(name, "least.gram")


def partly_named(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(q, ord, s): the first of the known names (ord, d, s) that holds the text q, or that q holds.

    `asked`: q, distinct and not empty; `known`: d, distinct. Texts that nothing
    holds and that hold nothing are left out. An empty name is held by every text.
    """
    frequent = known.select(F.explode(grams(F.col("d"), GRAM)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    postings = known.select(F.explode(grams(F.col("d"), GRAM)).alias("gram"), "ord", "d", "s")
    first = F.min(F.struct("ord", "s")).alias("x")
    # names that hold q: a short q is itself a part of the name, and the first name of each part is all that is needed
    short = known.select(F.explode(F.concat(grams(F.col("d"), 1), grams(F.col("d"), 2))).alias("q"), "ord", "s").groupBy("q").agg(first)
    holders = asked.where(F.length("q") < GRAM).join(short, "q").select("q", "x")
    long = _rarest(asked.where(F.length("q") >= GRAM), "q", frequent)
    holders = holders.unionByName(long.join(postings, "gram").where(F.contains("d", "q")).groupBy("q").agg(first))
    # names that q holds: each under one part, its rarest, or itself if it is short
    under = known.join(_rarest(known.select("d").where(F.length("d") >= GRAM), "d", frequent), "d").select("gram", "ord", "d", "s")
    under = under.unionByName(known.where(F.length("d").between(1, GRAM - 1)).select(F.col("d").alias("gram"), "ord", "d", "s"))
    parts = asked.select("q", F.explode(F.concat(*(grams(F.col("q"), n) for n in range(1, GRAM + 1)))).alias("gram"))
    held = parts.join(under, "gram").where(F.contains("q", "d")).groupBy("q").agg(first)
    found = holders.unionByName(held)
    nameless = known.where("d = ''").select("ord", "s").first()  # one row at most
    if nameless is not None:
        found = found.unionByName(asked.select("q", F.struct(F.lit(nameless.ord).alias("ord"), F.lit(nameless.s).cast("string").alias("s")).alias("x")))
    return found.groupBy("q").agg(F.min("x").alias("x")).select("q", "x.ord", "x.s")


def state_of_district(claims: DataFrame, districts: DataFrame) -> DataFrame:
    """`claims` (with district) and expected_state, null where no district fits.

    `districts`: ord, district (lower case), state; any number of them. An equal
    name decides; else of all that hold the claim, or are held by it, the first
    in order. Distinct claims are looked up once each. Claims and districts that
    are null fit nothing, and neither does an empty claim.
    """
    known = (
        districts.where("district IS NOT NULL").groupBy(F.col("district").alias("d"))
        .agg(F.min(F.struct("ord", "state")).alias("x")).select("d", "x.ord", F.col("x.state").alias("s"))
    )
    asked = claims.select(F.lower(F.trim("district")).alias("q")).where("q <> ''").distinct()
    exact = asked.join(known, F.col("q") == F.col("d"), "left").select("q", "d", F.col("s").alias("exact"))
    partial = partly_named(exact.where("d IS NULL").select("q"), known).select("q", F.col("s").alias("partial"))
    found = exact.join(partial, "q", "left").select("q", F.when(F.col("d").isNotNull(), F.col("exact")).otherwise(F.col("partial")).alias("expected_state"))
    kept = [c for c in claims.columns if c != "expected_state"]
    return claims.select(*kept, F.lower(F.trim("district")).alias("__q")).join(found, F.col("__q") == F.col("q"), "left").drop("q", "__q")
