"""Majority votes between readings of the same document.

Ties go to the value met first, so every reading carries its ordinal. Equal
readings of a key are counted with map-side combine; what is left of a key then
meets in one shuffle, which serves all that follows. No reading list is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docassay.functions.text import date_codes, date_text, digits_behind, from_label, is_date, unpacked_date
from docassay.sources import spread


def vote_components(df: DataFrame, key: str, parts: list[str], ordinal: str | list[str]) -> DataFrame:
    """key and the modal value of every part, each voted on its own. Several ordinals count one after the other.

    Equal readings are counted first, so that a key keeps as many rows as it has
    different ones. Then all rows of a key meet once: the parts become rows of one
    long table, and one pair of aggregates serves them all without another shuffle.
    """
    first, *rest = [ordinal] if isinstance(ordinal, str) else ordinal
    counted = df.groupBy(key, *parts, *rest).agg(F.count("*").alias("__n"), F.min(first).alias("__first"))
    values = F.array(*(F.struct(F.lit(i).alias("part"), F.col(p).cast("long").alias("value")) for i, p in enumerate(parts)))
    long = (
        counted.repartition(key)
        .select(key, "__n", F.struct("__first", *rest).alias("__first"), F.explode(values).alias("x"))
        .where("x.value IS NOT NULL")
        .groupBy(key, F.col("x.part").alias("__part"), F.col("x.value").alias("__value"))
        .agg(F.sum("__n").alias("__n"), F.min("__first").alias("__first"))
    )
    rank = F.struct(-F.col("__n"), "__first", "__value")
    return long.groupBy(key).agg(
        *(F.min(F.when(F.col("__part") == i, rank))["__value"].cast("int").alias(p) for i, p in enumerate(parts))
    )


def date_votes(passes: DataFrame, last_year: int = 2025) -> DataFrame:
    """(doc_id, dob) by component votes over all date candidates of all OCR passes.

    `passes`: doc_id, pass_no, text; dealt over all cores first where they are
    stored in fewer pieces. Candidates of one pass count once, those of several
    passes again; the first pass's come first.
    """
    text, near, digits = F.col("text"), F.col("near"), F.col("digits")
    read = (
        spread(passes.select("doc_id", "pass_no", "text"))
        .withColumn("near", from_label(text))
        .withColumn("digits", digits_behind(near))
        .select("doc_id", "pass_no", F.array_distinct(date_codes(text, near, digits)).alias("codes"))
    )
    # outer, as the filter that Spark infers from an inner one would make the codes again
    each = read.select("doc_id", "pass_no", F.posexplode_outer("codes").alias("k", "code")).where(is_date(F.col("code"), last_year))
    dates = each.select("doc_id", "pass_no", "k", *(c.alias(p) for c, p in zip(unpacked_date(F.col("code")), "dmy")))
    voted = vote_components(dates, "doc_id", ["d", "m", "y"], ["pass_no", "k"])
    return voted.select("doc_id", date_text(F.struct("d", "m", "y")).alias("dob"))


def vote_string(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """(key, winner): the modal string if it occurs twice; else, among strings as
    long as the first (two at least), the modal character of each position; else
    the longest. Empty and null readings do not vote; ties go to the first.

    Equal strings are counted first, then all of a key meet once: what follows,
    the votes on positions too, needs no other shuffle, and no table is joined.
    """
    usable = df.where(F.coalesce(F.col(value), F.lit("")) != "")
    counted = usable.groupBy(key, F.col(value).alias("__value")).agg(F.count("*").alias("__n"), F.min(ordinal).alias("__first"))
    size = F.length("__value")
    in_order = Window.partitionBy(key).orderBy(F.asc_nulls_last("__first"), "__value")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = counted.repartition(key).select(
        "*", F.max("__n").over(whole).alias("__most"), F.first(size).over(whole).alias("__size"), F.max(size).over(whole).alias("__longest")
    )
    alike = size == F.col("__size")
    best = F.when(F.col("__most") > 1, F.col("__n") == F.col("__most")).otherwise(size == F.col("__longest"))
    ranked = known.select(
        "*", best.alias("__best"), F.sum(alike.cast("long")).over(whole).alias("__voters"), F.sum(best.cast("long")).over(so_far).alias("__rank")
    )
    # only keys without a repeated string need positions; any other key's winner is one piece, whole
    spelled = (F.col("__most") == 1) & (F.col("__voters") >= 2)
    winner = ~spelled & F.col("__best") & (F.col("__rank") == 1)
    split = F.when(spelled & alike, F.split("__value", "")).when(winner, F.array("__value"))
    pieces = ranked.select(key, "__first", F.posexplode_outer(split).alias("__place", "__letter")).where("__place IS NOT NULL")
    letters = pieces.groupBy(key, "__place", "__letter").agg(F.count("*").alias("__n"), F.min("__first").alias("__first"))
    places = letters.groupBy(key, "__place").agg(F.min(F.struct(-F.col("__n"), "__first", "__letter"))["__letter"].alias("__letter"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__place", "__letter"))), lambda x: x["__letter"]), "")
    return places.groupBy(key).agg(joined.alias("winner"))
