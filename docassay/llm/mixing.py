"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact size. Each source takes all of its
documents as often as its target has room for, a proportional share of every
size of what is left, and bounded-knapsack dynamic programming over the counts
still free for the last part of its budget. Which documents of a size are taken
follows a seeded hash. Documents are counted and ranked in cells of source, size
and the hash's first bits, so that neither a source nor a size of which there
are very many documents comes together in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.common import seeded_long, shared_checkpoint

#: The dynamic programme has this much of the budget (in units of the sizes' greatest common divisor), or two of the
#: largest documents if that is more, and all of a smaller budget: up to there the sum is the nearest that there is.
#: It reaches one largest document beyond, so that a sum above the budget may be the nearest.
PROGRAMMED = 1 << 24
#: What is tried first, as it mostly meets the budget exactly.
FIRST_PROGRAMMED = 1 << 16
#: Bits of the hash that cut a size into cells.
CELL_BITS = 12


def source_targets(totals: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, most: float) -> list[tuple[str | None, float]]:
    """(source, target): `share` of all sizes dealt by weight, none above `most` times its source's size.

    Sources come in order of code points, null last, and take the weights in
    turn. What is above a cap is dealt again by weight until none is above.
    """
    order = sorted(totals, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = [weights[k % len(weights)] for k in range(len(order))]
    cap = [most * size for _, size in order]
    budget = min(share * sum(size for _, size in order), sum(cap))
    target, free = [0.0] * len(order), set(range(len(order)))
    while free:
        rest = budget - sum(cap[k] for k in range(len(order)) if k not in free)
        each = rest / sum(weight[k] for k in free)
        above = {k for k in free if each * weight[k] > cap[k]}
        for k in above:
            target[k] = float(cap[k])
        if not above:
            for k in free:
                target[k] = float(each * weight[k])
            break
        free -= above
    return [(s, t) for (s, _), t in zip(order, target)]


def fit_budget(sizes: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each size to take so that their sizes sum nearly to `budget`.

    Shares of every size come first; bounded-knapsack dynamic programming over
    the documents that are free again ends it. Of equally near sums the smaller.
    No other choice comes nearer if the budget, the greatest common divisor of
    the sizes taken out, is at most PROGRAMMED. Beyond that the programme has
    the last PROGRAMMED units: no sum of the documents that are free for it, the
    small ones first, comes nearer, but one that takes other documents might; the
    sum is never further off than half of the largest document.
    """
    sizes, counts = [int(x) for x in sizes], [int(x) for x in counts]
    unit = gcd(*sizes) or 1
    total = sum(s * c for s, c in zip(sizes, counts))
    budget = max(0, min(int(budget), total))
    if unit > 1:
        low = budget // unit
        sizes = [s // unit for s in sizes]
        near = [(abs(sum(s * t for s, t in zip(sizes, taken)) * unit - budget), k, taken) for k, taken in enumerate(fit_budget(sizes, counts, x) for x in (low, low + 1))]
        return min(near)[2]
    for programmed in sorted({min(FIRST_PROGRAMMED, PROGRAMMED), PROGRAMMED}):
        taken = _fitted(sizes, counts, budget, programmed)
        if sum(s * t for s, t in zip(sizes, taken)) == budget:
            break
    return taken


def _fitted(sizes: list[int], counts: list[int], budget: int, programmed: int) -> list[int]:
    """Shares of every size, then large documents, until the programme holds what is left of the budget."""
    total = sum(s * c for s, c in zip(sizes, counts))
    taken = [c * budget // total if s else 0 for s, c in zip(sizes, counts)] if total else [0] * len(sizes)
    left = budget - sum(s * t for s, t in zip(sizes, taken))
    order = sorted((k for k in range(len(sizes)) if sizes[k]), key=lambda k: -sizes[k])
    largest = sizes[order[0]] if order else 0
    programmed = max(programmed, 2 * largest)
    for k in order:
        more = min(counts[k] - taken[k], max(0, left - programmed) // sizes[k])
        taken[k] += more
        left -= more * sizes[k]
    for k in reversed(order):  # small sizes are free again as far as the programme holds them
        back = min(taken[k], max(0, programmed - left) // sizes[k])
        taken[k] -= back
        left += back * sizes[k]
    # bounded knapsack over what is left: items of 1, 2, 4, ... documents of a size
    room = left + largest
    reached, full = 1, (1 << (room + 1)) - 1
    by = np.full(room + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for k in order:
        free, chunk = min(counts[k] - taken[k], room // sizes[k]), 1
        while free > 0 and not reached >> left & 1:
            n = min(chunk, free)
            new = reached << n * sizes[k] & full & ~reached
            if new:
                found = np.frombuffer(new.to_bytes(room // 8 + 1, "little"), np.uint8)
                byte = np.flatnonzero(found)
                at, bit = np.nonzero(np.unpackbits(found[byte, None], axis=1, bitorder="little"))
                by[byte[at] * 8 + bit] = len(items)
                items.append((k, n))
                reached |= new
            free, chunk = free - n, chunk * 2
    sums = np.flatnonzero(np.unpackbits(np.frombuffer(reached.to_bytes(room // 8 + 1, "little"), np.uint8), bitorder="little"))
    best = int(sums[np.abs(sums - left).argmin()])
    while best > 0:
        k, n = items[by[best]]
        taken[k] += n
        best -= n * sizes[k]
    return taken


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(int(s) * int(c) for s, c in zip(pdf["size"], pdf["n"]))
    target = float(pdf["target"].iloc[0])
    whole = int(target // total) if total else 0
    pdf = pdf.sort_values("size", ignore_index=True)
    pdf["whole"] = whole
    pdf["extra"] = fit_budget(pdf["size"], pdf["n"], round(target - whole * total))
    pdf["source_size"] = total
    return pdf[["source_key", "size", "n", "whole", "extra", "source_size", "target"]]


def _chosen(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """As `mix`, with the seeded hash `u` of doc_id and text."""
    spark = docs.sparkSession
    sizes = shared_checkpoint(
        docs.select(
            "doc_id",
            "source",
            F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source")).alias("source_key"),
            F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            seeded_long(seed, "doc_id", "text").alias("u"),
        ).withColumn("cell", F.shiftrightunsigned("u", 64 - CELL_BITS).cast("int"))
    )
    group = ["source_key", "size"]
    cells = shared_checkpoint(sizes.groupBy("source", *group, "cell").agg(F.count("*").alias("n")))
    counted = cells.groupBy("source", *group).agg(F.sum("n").alias("n"))
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n"))).collect()
    targets = source_targets([(r[0], r[1]) for r in totals], weights, share, most)
    target = spark.createDataFrame(
        [("0" if s is None else "1" + s, t) for s, t in targets], "source_key string, target double"
    )
    plan = shared_checkpoint(
        counted.drop("source")
        .join(target, "source_key")
        .groupBy("source_key")
        .applyInPandas(_fit, "source_key string, size long, n long, whole int, extra long, source_size long, target double")
    )
    earlier = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    quota = cells.drop("source").join(plan.drop("n"), group).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # dealt by cell, or the join would keep to (source, size), and with it all of a hot size in one task
    quota = quota.drop("n").repartition(*group, "cell")
    ranked = Window.partitionBy(*group, "cell").orderBy("u", "doc_id")
    rank = F.col("before") + F.row_number().over(ranked)
    times = F.col("whole") + F.when(rank <= F.col("extra"), 1).otherwise(0)
    return (
        sizes.drop("source")
        .join(quota, [*group, "cell"])
        .withColumn("times", times.cast("int"))
        .select("doc_id", "u", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """doc_id, size, source_size, target, times, taken for every row of `docs`.

    size: words (runs of other than ASCII white space; null text: none); times:
    how often the mix takes the row; taken: times * size. With `most` 2, times
    is 0, 1 or 2. Rows of size 0 add nothing and are taken as often as their
    whole source is. Null is a source of its own, the last. The choice depends
    on seed, doc_id and text alone; repeated rows are chosen one by one. One row
    a source passes through the driver, the counts by size only through tasks.
    Other columns are not read; an empty table gives an empty result.
    """
    return _chosen(docs, weights, share, most, seed).drop("u")


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; columns stay as they are.

    Rows that repeat both doc_id and text share what the mix takes of them
    evenly, the first by source taking what is left over.
    """
    chosen = shared_checkpoint(
        _chosen(docs, weights, share, most, seed)
        .groupBy(F.col("doc_id").alias("__id"), F.col("u").alias("__u"))
        .agg(F.sum("times").alias("__times"), F.count("*").alias("__rows"))
    )
    rows = docs.withColumn("__own", seeded_long(seed, "doc_id", "text")).join(
        chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__u"))
    )
    times = F.col("__times")
    if chosen.where("__rows > 1").limit(1).count():
        same = Window.partitionBy("__id", "__u").orderBy("source")
        rows = rows.withColumn("__n", F.row_number().over(same))
        times = F.floor(times / F.col("__rows")) + (F.col("__n") <= times % F.col("__rows")).cast("int")
    often = F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.select(*docs.columns, F.explode(often).alias("__copy")).drop("__copy")
