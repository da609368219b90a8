"""Similar names over all records: a join of bigram sets by the rarest bigrams that two of their sizes must share.

Two sets of sizes a and b whose Jaccard similarity is t or more share at least
o = ceil((a + b) t / (1 + t)) bigrams. In any common order, the rarest first,
the first l of those lie in the first a - o + l of the one and the first
b - o + l of the other. So names meet under (a, b, l bigrams) for every choice of
l from there, with l up to 3: of millions of names few share three rare bigrams
by chance, where very many share one. A pair is compared under its first l shared
bigrams and nowhere else, so that pairs need not be made distinct: they go from
the join into counts in the same task, and no list of pairs is ever dealt out.
Sets of more than `LONG` bigrams, for which there were too many choices, meet
others under single bigrams.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.compare import bigrams, normal_name

#: Bigrams of A to Z.
CODES = 26 * 26
#: The largest set that meets others by their sizes; how many bigrams at most make a meeting; choices of these at most.
LONG, TOGETHER, CHOICES = 48, 3, 64


def _code(gram: Column) -> Column:
    letter = lambda k: F.ascii(F.substring(gram, k, 1)) - 65
    return letter(1) * 26 + letter(2)


def _meetings(sizes: list[int], share: Fraction) -> list[tuple[int, int, int, int, int]]:
    """(size, code of both sizes, three places in the set or 0): where sets of each size meet sets of all sizes."""
    out = []
    for a in sizes:
        for b in sizes:
            if max(a, b) <= LONG and a >= b * share and b >= a * share:
                o = ceil((a + b) * share / (1 + share))
                fits = lambda n: n <= o and comb(max(a, b) - o + n, n) <= CHOICES
                together = max((n for n in range(1, TOGETHER + 1) if fits(n)), default=1)
                chosen = combinations(range(1, a - o + together + 1), together)
                out += [(a, min(a, b) * 64 + max(a, b), *places, *[0] * (3 - together)) for places in chosen]
        if any(max(a, b) > LONG and a >= b * share and b >= a * share for b in sizes):
            out += [(a, 0, k, 0, 0) for k in range(1, a - ceil(a * share) + 2)]
    return out


def similar_names(records: DataFrame, id_col: str, name_col: str, threshold: float = 0.75) -> DataFrame:
    """`records` with similar_names and first_id.

    Names are compared as `normal_name` has them, by the Jaccard similarity of
    their bigrams. similar_names: how many other names have `threshold` or more,
    each counted once however many records have it; first_id: the least id of the
    records with an equal or a similar name. Equal names are one class, so a name
    of very many records costs one row. A name of fewer than two letters is equal
    to itself only; null and empty names have 0 and null.
    """
    share = Fraction(str(threshold))
    kept = [c for c in records.columns if c not in ("similar_names", "first_id")]
    named = records.select(*kept, normal_name(F.col(name_col)).alias("__name"))
    # as many tasks as the session has it, also where few bytes of names have very many meetings
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = named.where("__name <> ''").repartition(parts, "__name").groupBy(F.col("__name").alias("name")).agg(F.min(id_col).alias("least"))
    grams = classes.select(bigrams(F.col("name")).alias("grams"))
    counted = grams.select(F.explode("grams").alias("gram")).groupBy("gram").count().collect()  # as many as letters allow at most
    place = dict.fromkeys(range(CODES), 0)
    for k, x in enumerate(sorted(counted, key=lambda x: (x["count"], x["gram"])), 1):
        place[(ord(x["gram"][0]) - 65) * 26 + ord(x["gram"][1]) - 65] = k
    sizes = sorted(x[0] for x in grams.select(F.size("grams")).distinct().collect() if x[0])
    meetings = records.sparkSession.createDataFrame(_meetings(sizes, share), "n int, sizes long, i int, j int, k int")
    places = F.array(*map(F.lit, place.values())).cast("array<smallint>")
    ranked = F.array_sort(F.transform(bigrams(F.col("name")), lambda g: F.get(places, _code(g))))
    sets = classes.select("name", "least", ranked.alias("set")).withColumn("n", F.size("set"))
    at = lambda x, k: F.coalesce(F.get(x, k - 1), F.lit(0)).cast("long")
    key = lambda sizes, *three: ((sizes * 1024 + three[0]) * 1024 + three[1]) * 1024 + three[2]
    met = sets.join(F.broadcast(meetings), "n").select("name", "least", "set", "n", "sizes", F.col("j").alias("second"), F.col("k").alias("third"), key(F.col("sizes"), *(at(F.col("set"), F.col(c)) for c in "ijk")).alias("key"))
    side = lambda p: met.select("key", *(F.col(c).alias(f"{p}_{c}") for c in met.columns if c != "key"))
    a, b, both = F.col("a_n"), F.col("b_n"), F.col("both")
    fits = lambda x, y: x * share.denominator >= y * share.numerator
    first = key(F.col("a_sizes"), at(both, F.lit(1)), *(F.when(F.col(f"a_{c}") > 0, at(both, F.lit(k))).otherwise(0) for k, c in ((2, "second"), (3, "third"))))
    pairs = (
        side("a").join(side("b").hint("merge"), "key")
        .where(F.col("a_name") != F.col("b_name"))
        .where(F.when(F.greatest(a, b) > LONG, fits(a, b) & fits(b, a) & (F.col("a_sizes") == 0)).otherwise(F.col("a_sizes") == F.least(a, b) * 64 + F.greatest(a, b)))
        .withColumn("both", F.array_intersect("a_set", "b_set"))
        .where(F.size(both) * (share.numerator + share.denominator) >= (a + b) * share.numerator)
        .where(first == F.col("key"))
    )
    near = pairs.groupBy(F.col("a_name").alias("name")).agg(F.count("*").alias("similar"), F.min("b_least").alias("nearest"))
    found = classes.join(near, "name", "left").select("name", F.coalesce("similar", F.lit(0)).alias("similar_names"), F.least("least", "nearest").alias("first_id"))
    joined = named.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(kept)), "__name").join(found, F.col("__name") == F.col("name"), "left")
    return joined.select(*(F.col(f"__{k}").alias(c) for k, c in enumerate(kept)), F.coalesce("similar_names", F.lit(0)).cast("long").alias("similar_names"), "first_id")
