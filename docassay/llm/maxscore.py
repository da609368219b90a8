"""Exact top-k inner products by MaxScore over sharded postings.

Every dimension is a query term; its posting list in a shard is a row of the
shard's transposed matrix, bounded by the list's least and greatest component.
After a first stretch of each list has given a query k scores to beat, its
terms are split by their bounds: the weakest, which together stay under a share
of that score, are non-essential and their postings are not read. Only the
essential lists are traversed; a vector's other terms are probed, strongest
bound first, only while the vector can still compete. Alone, non-essential
terms lift no vector over the score; as postings are dense, a smaller share
than MaxScore allows leaves far fewer vectors to probe.

A task holds one shard and streams its queries past it in Arrow batches. It
gives k results a query at most, and the shards' results are merged.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.common import pieces

#: Vectors of a shard: the fewest while there are less than SHARDS of them, the most whatever the table; queries past it.
LEAST_SHARD, MOST_SHARD, SHARDS = 8192, 131_072, 64
QUERY_BLOCK = 262_144
#: Queries answered together, and vectors of the first stretches of the postings.
TOGETHER, STRETCHES = 512, (512, 2048)
PROBED_TOGETHER = 8
#: Non-essential terms may add up to this share of the score to beat.
NON_ESSENTIAL_SHARE = 0.25


def scaled(embedding: Column | str, factor: int = 64) -> Column:
    """floor(factor * x) of every component as longs; null for vectors that take no part.

    A finite component whose product does not fit a long is an error: it has no such value.
    """
    v = F.col(embedding) if isinstance(embedding, str) else embedding
    usable = v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    product = lambda x: x.cast("double") * factor
    whole = lambda x: F.when(F.abs(product(x)) < float(1 << 62), F.floor(product(x)).cast("long")).otherwise(
        F.raise_error(F.lit("a component is too large to be scaled to a long")).cast("long")
    )
    return F.when(usable, F.transform(v, whole))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of a matrix, shorter ones padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _number_kind(largest: int) -> type:
    """The fastest numbers that hold every sum of two scores exactly; beyond a long, Python's own."""
    return np.float32 if largest < 2**22 else np.float64 if largest < 2**51 else np.int64 if largest < 2**61 else object


class Shard:
    """The postings of one shard: a row for every term, vectors in the order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that a later vector loses every tie
        self.ids, self.postings = ids[order], vectors[order].T
        self.low = self.postings.min(1, initial=0) if self.postings.size else np.zeros(len(self.postings), np.int64)
        self.high = self.postings.max(1, initial=0) if self.postings.size else np.zeros(len(self.postings), np.int64)
        self._as: dict[type, np.ndarray] = {}

    def as_kind(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = np.ascontiguousarray(self.postings.astype(kind))
        return self._as[kind]

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, vec_id, score) of every query's k best; ties to the smaller vec_id.

        Vectors whose id is the query's own are left out.
        """
        d = min(len(self.postings), queries.shape[1])
        own, queries = self.postings[:d], queries[:, :d]  # what one side lacks is zero
        largest = sum(int(a) * int(b) for a, b in zip(np.abs(queries).max(0, initial=0), np.maximum(self.high, -self.low)[:d]))
        kind = _number_kind(largest)
        postings, exact = self.as_kind(kind)[:d], object if kind is object else np.int64
        q = queries.astype(exact)
        low, high = self.low[:d].astype(exact), self.high[:d].astype(exact)
        most = np.maximum(q * low, q * high)  # a term's greatest contribution; never negative
        terms = np.argsort(-most, axis=1, kind="stable")  # strongest bound first
        rest = np.zeros((len(q), d + 1), exact)  # greatest sum of the terms from a place on
        rest[:, :d] = np.take_along_axis(most, terms, 1)[:, ::-1].cumsum(1)[:, ::-1]
        found: list[list] = [[] for _ in range(3)]
        first, last = min(STRETCHES[0], len(self.ids)), len(self.ids)
        begun = queries.astype(kind) @ postings[:, :first]  # nothing to beat yet: every term is essential
        bounds = [first, *(min(x, last) for x in STRETCHES[1:]), last]
        for n in range(len(q)):
            at = np.flatnonzero(self.ids[:first] != query_ids[n])
            score, at = self._kept(begun[n, at].astype(exact), at, k)
            for begin, end in zip(bounds, bounds[1:]):
                if begin < end:
                    theta = score[-1] if len(score) == k else None
                    more, place = self._competing(own, postings[:, begin:end], begin, q[n], terms[n], rest[n], theta)
                    other = self.ids[place] != query_ids[n]
                    score, at = self._kept(np.concatenate([score, more[other]]), np.concatenate([at, place[other]]), k)
            found[0].append(np.full(len(at), n))
            found[1].append(self.ids[at])
            found[2].append(score)
        position, ids, scores = (np.concatenate(x) if x else np.empty(0, np.int64) for x in found)
        if exact is object and any(abs(x) >= 1 << 63 for x in scores):
            raise OverflowError("a score is too large for a long")
        return position, ids, scores.astype(np.int64)

    @staticmethod
    def _kept(score: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of candidates, best first; `at` follows the ids."""
        if len(score) > 4 * k and score.dtype != object:
            least = np.partition(score, len(score) - k)[len(score) - k]
            score, at = score[score >= least], at[score >= least]
        order = np.lexsort((at, -score))[:k] if score.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (-score[i], at[i]))[:k], np.int64)
        return score[order], at[order]

    @staticmethod
    def _competing(own, postings, begin, query, terms, rest, theta) -> tuple[np.ndarray, np.ndarray]:
        """(score, place) of the stretch's vectors that beat theta (all without one)."""
        # what the terms from a place on may add falls from place to place
        essential = len(terms) if theta is None else int((rest[:-1] > NON_ESSENTIAL_SHARE * max(int(theta), 0)).sum())
        used = terms[:essential]
        partial = query[used].astype(postings.dtype) @ postings[used] if essential else np.zeros(postings.shape[1], postings.dtype)
        if theta is None:
            at = np.arange(len(partial))
        else:
            least = int(theta) - int(rest[essential])  # in the postings' own numbers, or all would be converted
            at = np.flatnonzero(partial > (least if postings.dtype == object else postings.dtype.type(least)))
        score = partial[at].astype(rest.dtype)
        for r in range(essential, len(terms), PROBED_TOGETHER):
            t = terms[r : r + PROBED_TOGETHER]
            score = score + query[t] @ own[t[:, None], at + begin].astype(rest.dtype)
            compete = score + rest[r + len(t)] > theta
            score, at = score[compete], at[compete]
        return score, at + begin


def maxscore(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vec_id, score) of every query's k best among the vectors."""
    return Shard(ids, vectors).best(query_ids, queries, k)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    seed: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "vector",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: every query's k highest inner products, exactly.

    Both sides have a long id and a vector of longs or ints (see `scaled`); rows
    with a null id or vector take no part. A vector with the query's own id is no
    candidate. Shorter vectors count as padded with zeros. Ties go to the smaller
    vec_id; candidates that repeat an id and score are separate results, and
    queries that repeat an id are answered by the best of their results. Fewer
    than k candidates give fewer rows; empty tables none. A score that does not
    fit a long is an error. Other columns are not read.

    A vector is sent once for every QUERY_BLOCK queries and a query once to every
    shard, of MOST_SHARD vectors in large tables; the search itself grows with
    the product of both. A task holds a shard and a batch of queries.
    """
    of = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    vectors, queries = of(vectors), of(queries)
    n = vectors.count()
    shards = max(1, ceil(n / min(MOST_SHARD, max(LEAST_SHARD, n // SHARDS))))
    blocks = max(1, ceil(queries.count() / QUERY_BLOCK))
    drawn = lambda n: F.pmod(F.xxhash64(F.lit(seed), "id", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # a row's place is drawn before it is repeated, so that all its copies share it
    placed, asked = vectors.withColumn("shard", drawn(shards)), queries.withColumn("block", drawn(blocks))
    tiled = placed.select("shard", every(blocks).alias("block"), F.lit(False).alias("asks"), "id", "v").unionByName(
        asked.select(every(shards).alias("shard"), "block", F.lit(True).alias("asks"), "id", "v")
    )
    tile = F.col("shard") * F.lit(blocks) + F.col("block")
    dealt = tiled.withColumn("tile", tile).repartitionByRange(shards * blocks, "tile").sortWithinPartitions("tile", "asks")

    def search(batches):
        tile, ids, rows, shard = None, [], [], None
        for batch in pieces(batches):
            tiles, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if begin == end:
                    continue
                if tiles[begin] != tile:
                    tile, ids, rows, shard = tiles[begin], [], [], None
                part = batch.slice(begin, end - begin)
                if not asks[begin]:
                    ids.append(part.column(2).to_numpy())
                    rows.append(matrix(part.column(3)))
                    continue
                if shard is None:
                    if not ids:
                        continue  # queries of a shard without vectors
                    width = max(x.shape[1] for x in rows)
                    whole = np.zeros((sum(map(len, rows)), width), np.int64)
                    at = 0
                    for x in rows:
                        whole[at : at + len(x), : x.shape[1]] = x
                        at += len(x)
                    shard, rows = Shard(np.concatenate(ids), whole), []
                asking, values = part.column(2).to_numpy(), matrix(part.column(3))
                for i in range(0, len(asking), TOGETHER):
                    q, vec_id, score = shard.best(asking[i : i + TOGETHER], values[i : i + TOGETHER], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asking[i : i + TOGETHER][q]), pa.array(vec_id), pa.array(score)], names=["query_id", "vec_id", "score"]
                    )

    streamed = dealt.select("tile", "asks", "id", "v")
    found = streamed.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
