"""SimHash near-duplicates by tiled exact comparison.

Every document gets a 64-bit SimHash over word shingles. Two fingerprints are
linked if they differ in at most `radius` bits. The comparison is exact: tiles
of distinct fingerprints meet under exclusive-or and a bit count in numpy. A
tile holds fingerprints with the same population counts in each of the four
16-bit words. Flipping one bit moves one of these counts by one, so two tiles
whose counts are further apart than the radius (summed over the words) hold no
link and never meet.

`keep_one_of_similar` is for similarity, not for a fixed radius: 128-bit
SimHashes within a wide radius make families, and in these the exact Jaccard
similarity of the shingle sets decides.
"""

from __future__ import annotations

from itertools import product, repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import delete_shared, pieces, shared_checkpoint, shared_folder, shared_table, utf8
from docassay.sources import spread

SEED = 42
#: Population counts of a 16-bit word: 0 to 16.
LEVELS = 17
#: Least rows of a tile; larger inputs take larger ones, up to MAX_TILE.
MIN_TILE, MAX_TILE = 1024, 32768
#: Of 128 bits: the radius that joins pairs of similarity 0.8, which differ in 19 bits on average (README).
WIDE_RADIUS = 32
#: Sets and shingles of a piece of a family, and bytes that a task's group of tiles holds on average.
FAMILY_PIECE, PIECE_SHINGLES, GROUP_BYTES = 512, 500_000, 16 << 20


def shingle_digests(text: bytes | None, shingle_words: int) -> np.ndarray:
    """xxh3 (128 bits, big-endian, a row each) of the distinct word shingles, sorted; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty((0, 16), np.uint8)
    shingles = {b" ".join(words)} if len(words) < shingle_words else set(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
    digests = b"".join(sorted(map(xxhash.xxh3_128_digest, shingles, repeat(SEED))))
    return np.frombuffer(digests, np.uint8).reshape(-1, 16)


def simhash128(digests: np.ndarray) -> np.ndarray:
    """The SimHash of a shingle set's digests, as two unsigned longs."""
    counts = np.zeros(128, np.int64)
    for i in range(0, len(digests), 65536):
        counts += np.unpackbits(digests[i : i + 65536], axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(digests)).view(">u8").astype(np.uint64)


def simhash64(text: bytes | None, shingle_words: int) -> int:
    """The unsigned 64-bit SimHash of one text; no words (or null): 0."""
    words = (text or b"").lower().split()  # bytes: lower() and split() see ASCII only
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
        n = len(words) - shingle_words + 1
    counts = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for start in range(0, n, 65536):
        part = np.fromiter(hashes, ">u8", min(65536, n - start))
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(
    docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and `fp` (the fingerprint's bits as a signed long), a row per row."""

    def hashed(batches):
        for batch in pieces(batches):
            values = [simhash64(x.as_py(), shingle_words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))],
                names=["doc_id", "fp"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")))
    return texts.mapInArrow(
        hashed, f"doc_id {id_type}, fp long"
    )


def hex16(fp: Column | str) -> Column:
    """16 lowercase hex digits of a signed long's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _counts(fp: str) -> list[Column]:
    """Population counts of the four 16-bit words."""
    return [
        F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int")
        for k in range(4)
    ]


def _cell(counts: list[Column]) -> Column:
    out = F.lit(0)
    for c in counts:
        out = out * LEVELS + c
    return out


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Steps to cells within the radius, one of each pair of opposite steps."""
    steps = product(range(-radius, radius + 1), repeat=4)
    zero = (0, 0, 0, 0)
    return [s for s in steps if s >= zero and sum(map(abs, s)) <= radius]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges a-b as stars around each component's smallest value."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, label[u], low)
        np.minimum.at(after, label[v], low)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def _links_of_tile(radius: int):
    def links(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        left = table.column("is_left").to_numpy().astype(bool)
        a, b = fp[left].view(np.uint64), fp[~left].view(np.uint64)
        found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(0, len(a), 1024):
            for j in range(0, len(b), 4096):
                x, y = a[i : i + 1024], b[j : j + 4096]
                near_x, near_y = np.nonzero(
                    np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
                )
                other = x[near_x] != y[near_y]
                p = x[near_x][other].view(np.int64)
                q = y[near_y][other].view(np.int64)
                if len(p):
                    p, q = _forest(p, q)  # as many edges as fingerprints at most
                    found_a.append(p)
                    found_b.append(q)
        p, q = np.concatenate(found_a), np.concatenate(found_b)
        if len(p):
            p, q = _forest(p, q)
        return pa.table({"a": p, "b": q})

    return links


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that keep their components.

    `fps` holds distinct longs in `fp` and is read twice. Of each tile's links a
    spanning forest is returned, so a group of near copies yields rows in
    proportion to its distinct fingerprints. The sizes of all cells (17^4 at
    most, whatever the input) pass through the driver to cut large cells.
    """
    spark = fps.sparkSession
    sizes = (
        fps.select(_cell(_counts("fp")).alias("cell")).groupBy("cell").count().collect()
    )
    grid = np.zeros((LEVELS,) * 4, np.int64)
    for cell, count in sizes:
        grid.reshape(-1)[cell] = count
    around = np.zeros_like(grid)
    steps = _offsets(radius)
    for step in steps:
        to = tuple(slice(max(0, -d), LEVELS - max(0, d)) for d in step)
        of = tuple(slice(max(0, d), LEVELS - max(0, -d)) for d in step)
        around[to] += grid[of]
    tile = int(np.clip(grid.sum() // 2048, MIN_TILE, MAX_TILE))
    plan = [
        (i, -(-int(n) // tile), -(-int(m) // (4 * tile)))
        for i, (n, m) in enumerate(zip(grid.reshape(-1), around.reshape(-1)))
        if n
    ]
    cells = spark.createDataFrame(plan, "cell int, lefts int, rights int")  # 83,521 rows at most
    steps_col = F.array(*(F.struct(*(F.lit(d).alias(f"d{k}") for k, d in enumerate(s))) for s in steps))
    # dealt out anew: each fingerprint makes a row for every step, and few tasks may hold all of them
    dealt_fps = fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    moved = dealt_fps.select("fp", F.array(*_counts("fp")).alias("n"), F.explode(steps_col).alias("s")).select(
        "fp",
        F.array(*(F.col("n")[k] - F.col(f"s.d{k}") for k in range(4))).alias("to"),
        ((F.col("s.d0") == 0) & (F.col("s.d1") == 0) & (F.col("s.d2") == 0) & (F.col("s.d3") == 0)).alias("home"),
    )
    inside = F.forall("to", lambda x: (x >= 0) & (x < LEVELS))
    met = moved.where(inside).select(
        "fp", "home", _cell([F.col("to")[k] for k in range(4)]).alias("cell")
    ).join(F.broadcast(cells), "cell")
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "fp"), F.col(n)).cast("int")
    as_right = F.transform(
        F.sequence(F.lit(0), F.col("lefts") - 1),
        lambda k: F.struct(k.alias("l"), own(1, "rights").alias("r"), F.lit(False).alias("is_left")),
    )
    as_left = F.transform(
        F.sequence(F.lit(0), F.col("rights") - 1),
        lambda k: F.struct(own(2, "lefts").alias("l"), k.alias("r"), F.lit(True).alias("is_left")),
    )
    dealt = met.select(
        "fp", "cell", F.explode(F.when(F.col("home"), F.concat(as_left, as_right)).otherwise(as_right)).alias("t")
    ).select("cell", "t.l", "t.r", "t.is_left", "fp")
    return dealt.groupBy("cell", "l", "r").applyInArrow(_links_of_tile(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is its component's smallest node.

    Alternates large-star and small-star steps, each a group's minimum and a
    join, until nothing changes; the number of rounds grows with the logarithm
    of the longest chain. Every step is written as a table and the round before
    it deleted. The minima are written before the join, which then has two plain
    shuffles, and of these Spark can split the one partition that holds a hot
    centre's edges.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid4().hex}"

    def star(directed: DataFrame, larger: bool, path: str) -> DataFrame:
        least = shared_table(directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{path}-least")
        joined = directed.join(least, "u")
        if larger:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )

    def down(e: DataFrame) -> DataFrame:
        return (
            e.where("u != v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    turn = 0
    current = shared_table(down(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), f"{folder}/0/edges")
    before = state(current)
    while before[0]:
        turn += 1
        path = f"{folder}/{turn}"
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lifted = shared_table(down(star(both, True, f"{path}/large")), f"{path}/lifted")
        current = shared_table(down(star(lifted, False, f"{path}/small")), f"{path}/edges")
        delete_shared(spark, f"{folder}/{turn - 1}")
        now = state(current)
        if now == before:
            break
        before = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select("v", "v").distinct()
    )


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 3,
    radius: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, fp (signed long) and component_id for every row of `docs`.

    Null or empty texts and texts of white space have the fingerprint zero and
    are linked like any other. Rows with the same text, or the same doc_id, stay
    separate rows; component_id is the smallest non-null doc_id reachable, null
    only if there is none. An empty table gives an empty result. Other columns
    of `docs` are not read.
    """
    fps = shared_checkpoint(fingerprints(docs, shingle_words, id_col, text_col))
    classes = shared_checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(classes.select("fp"), radius))
    linked = roots.join(classes, F.col("node") == F.col("fp")).select("fp", "root", "least_id")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # written down, so that the join below has shuffles of its own whose hot fingerprints Spark can split
    of_class = shared_checkpoint(
        classes.join(linked.join(least, "root").select("fp", "component_id"), "fp", "left").select(
            "fp", F.coalesce("component_id", "least_id").alias("component_id")
        )
    )
    return fps.join(of_class, "fp", "left").select("doc_id", "fp", "component_id")


def shingle_classes(ids: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, `c` (hash of the shingle set), `n` (its size) and the 128-bit SimHash (hi, lo), a row per row of (doc_id, text)."""

    def hashed(batches):
        for batch in pieces(batches):
            sets = [shingle_digests(x.as_py(), shingle_words) for x in batch.column(1)]
            prints = np.array([simhash128(x) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
            c = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(c), pa.array(np.array([len(x) for x in sets], np.int64)), pa.array(prints[:, 0]), pa.array(prints[:, 1])],
                names=["doc_id", "c", "n", "hi", "lo"],
            )

    id_type = ids.schema["doc_id"].dataType.simpleString()
    texts = spread(ids.select("doc_id", utf8("text").alias("text")))
    return texts.mapInArrow(hashed, f"doc_id {id_type}, c long, n long, hi long, lo long")


def _families_of_tile(radius: int, similarity: float):
    def join(table: pa.Table) -> pa.Table:
        left = table.column("is_left").to_numpy().astype(bool)
        c, n = table.column("c").to_numpy(), table.column("n").to_numpy()
        fp = np.stack([table.column(k).to_numpy().view(np.uint64) for k in ("hi", "lo")], 1)
        li, ri = np.flatnonzero(left), np.flatnonzero(~left)
        ri = ri[np.argsort(n[ri], kind="stable")]
        found = [(np.empty(0, np.int64),) * 2]
        for i in range(0, len(li), 512):
            x = li[i : i + 512]
            within = ri[np.searchsorted(n[ri], n[x].min() * similarity - 1) : np.searchsorted(n[ri], n[x].max() / similarity + 1)]
            for j in range(0, len(within), 4096):
                y = within[j : j + 4096]
                far = np.bitwise_count(fp[x, None, 0] ^ fp[None, y, 0])
                far += np.bitwise_count(fp[x, None, 1] ^ fp[None, y, 1])
                p, q = np.nonzero(far <= radius)
                p, q = x[p], y[q]
                usable = (c[p] != c[q]) & (np.minimum(n[p], n[q]) >= similarity * np.maximum(n[p], n[q]) - 1e-6)
                if usable.any():
                    found.append(_forest(c[p[usable]], c[q[usable]]))  # as many edges as sets at most
        a, b = map(np.concatenate, zip(*found))
        if len(a):
            a, b = _forest(a, b)
        return pa.table({"a": a, "b": b})

    return join


def family_links(classes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Edges (a, b) that keep the families: classes (c, n, hi, lo) whose SimHashes differ in `radius` bits at most.

    Sets of which one is less than `similarity` of the other's size cannot be
    similar: classes meet within bands of size and with the next band only. The
    sizes of all bands (a hundred or so, by the logarithm of the longest text)
    pass through the driver to cut them into tiles. A tile gives a spanning forest.
    """
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(-float(np.log(similarity))) + F.lit(1e-9)).cast("int")
    banded = classes.where("n > 0").select("c", "n", "hi", "lo", band.alias("band"))
    size = {r[0]: r[1] for r in banded.groupBy("band").count().collect()}
    tile = int(np.clip(sum(size.values()) // 32, MIN_TILE, MAX_TILE))
    sides = {b: (-(-size[b] // tile), -(-(size[b] + size.get(b + 1, 0)) // tile)) for b in size}
    plan = [(b, *sides[b], *sides.get(b - 1, (0, 0))) for b in size]
    bands = classes.sparkSession.createDataFrame(plan, "band int, lefts int, rights int, lefts_below int, rights_below int")
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "c"), F.col(n)).cast("int")
    place = lambda cell, l, r, is_left: F.struct(cell.alias("cell"), l.alias("l"), r.alias("r"), F.lit(is_left).alias("is_left"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none = F.array().cast("array<struct<cell: int, l: int, r: int, is_left: boolean>>")
    places = F.concat(
        F.transform(every("rights"), lambda k: place(F.col("band"), own(2, "lefts"), k, True)),
        F.transform(every("lefts"), lambda k: place(F.col("band"), k, own(1, "rights"), False)),
        F.when(F.col("lefts_below") > 0, F.transform(every("lefts_below"), lambda k: place(F.col("band") - 1, k, own(1, "rights_below"), False))).otherwise(none),
    )
    dealt = banded.join(F.broadcast(bands), "band").withColumn("t", F.explode(places)).select("t.cell", "t.l", "t.r", "t.is_left", "c", "n", "hi", "lo")
    return dealt.groupBy("cell", "l", "r").applyInArrow(_families_of_tile(radius, similarity), "a long, b long")


def _shared_prefixes(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """How many of their rarest shingles each two sets share: none if they cannot be similar.

    Of two sets with Jaccard similarity s the larger's share in common is s at
    least, so they share one of the n - ceil(s n) + 1 that come first in any order.
    """
    sizes = np.array(list(map(len, sets)), np.int64)
    owner, begins = np.repeat(np.arange(len(sets)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((code, count[code], owner))
    prefix = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    kept = order[(np.arange(len(order)) - np.repeat(begins, sizes) < np.repeat(prefix, sizes)) & (count[code[order]] > 1)]
    kept = kept[np.argsort(code[kept], kind="stable")]
    shared = np.zeros((len(sets), len(sets)), np.int32)
    for group in np.split(owner[kept], np.flatnonzero(np.diff(code[kept])) + 1):
        if len(group) > 1:
            shared[np.ix_(group, group)] += 1
    return shared


def similar_sets(sets: list[np.ndarray], sides: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) that keep the components of sets with a Jaccard similarity of `similarity` or more.

    `sides`: only pairs of different sides count; None: all pairs do.
    """
    shared = np.triu(_shared_prefixes(sets, similarity), 1)
    if sides is not None:
        shared[sides[:, None] == sides[None, :]] = 0
    i, j = np.nonzero(shared)
    order = np.argsort(-shared[i, j], kind="stable")  # the likeliest first: later ones are joined by then
    parent, out = list(range(len(sets))), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for p, q in zip(i[order].tolist(), j[order].tolist()):
        x, y = root(p), root(q)
        if x != y and min(len(sets[p]), len(sets[q])) >= similarity * max(len(sets[p]), len(sets[q])) - 1e-6:
            both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if both >= similarity * (len(sets[p]) + len(sets[q]) - both) - 1e-9:
                parent[max(x, y)] = min(x, y)
                out.append((p, q))
    return out


def _links_of_families(similarity: float):
    def links(table: pa.Table) -> pa.Table:
        tile, side, c = (table.column(k).to_numpy() for k in ("tile", "side", "c"))
        packed = table.column("shingles").combine_chunks()
        order = np.argsort(tile, kind="stable")
        a, b = [], []
        for at in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
            if len(at) > 1:
                sets = [np.frombuffer(packed[int(k)].as_py(), np.uint64) for k in at]
                sides = side[at] if side[at].min() != side[at].max() else None
                for p, q in similar_sets(sets, sides, similarity):
                    a.append(c[at[p]])
                    b.append(c[at[q]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def similar_links(members: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between similar sets of the same family. `members`: c, family, shingles (sorted 64-bit hashes, packed).

    Families are cut into pieces of FAMILY_PIECE sets or PIECE_SHINGLES shingles,
    whichever are more pieces, and every two pieces meet in one tile; tiles are
    grouped by their bytes, so that a task has many small ones together. A set
    goes to as many tiles as its family has pieces.
    """
    spark = members.sparkSession
    bytes_of = F.length("shingles")
    pieces = F.ceil(F.greatest(F.col("m") / FAMILY_PIECE, F.col("bytes") / (8 * PIECE_SHINGLES))).cast("int")
    families = shared_checkpoint(members.groupBy("family").agg(F.count("*").alias("m"), F.sum(bytes_of).alias("bytes")).withColumn("pieces", pieces))
    total = families.agg(F.sum(F.col("bytes") * F.col("pieces"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // GROUP_BYTES)
    own = F.pmod(F.xxhash64("c"), F.col("pieces")).cast("int")
    placed = members.join(families.select("family", "pieces"), "family").withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    tile = F.xxhash64("family", F.least("own", "k"), F.greatest("own", "k"))
    dealt = placed.select(tile.alias("tile"), F.col("own").alias("side"), "c", "shingles").withColumn("g", F.pmod("tile", F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(_links_of_families(similarity), "a long, b long")


def keep_one_of_similar(
    docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS
) -> DataFrame:
    """The rows of `docs` with one row left of each group of similar texts.

    Two texts are linked if the Jaccard similarity of their sets of word
    shingles is `similarity` or more (texts without a word are linked with each
    other); groups are the components of these links. Texts whose 128-bit
    SimHashes differ in `radius` bits at most, directly or by others, are a
    family; the sets of each family decide which of them are similar. The row
    with the smallest doc_id stays (rows without one count as largest; among equal
    ids the smallest text hash).
    """
    ids = docs.select(
        F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text"
    )
    rows = shared_checkpoint(shingle_classes(ids, shingle_words))
    classes = shared_checkpoint(
        rows.groupBy("c").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("hi").alias("hi"), F.first("lo").alias("lo"))
    )
    families = shared_checkpoint(components(family_links(classes, radius, similarity)).select(F.col("node").alias("c"), F.col("root").alias("family")))
    sets = _shingles(docs, classes.join(families.select("c"), "c"), shingle_words)
    roots = components(similar_links(shared_checkpoint(families.join(sets, "c")), similarity))
    of_root = classes.join(roots, F.col("c") == F.col("node"), "left").groupBy(F.coalesce("root", "c").alias("root"))
    found = _rows_of(docs, of_root.agg(F.min("least_id").alias("least_id")))
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        found = found.dropDuplicates(["doc_id", "__h"])
    return found.drop("__h")


def _rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs`, with the text's hash as __h, that a least_id names."""
    return docs.withColumn("__h", F.xxhash64("text")).join(
        ids.select(F.col("least_id.doc_id").alias("__id"), F.col("least_id.h").alias("__kept")),
        F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__kept")),
        "left_semi",
    )


def _shingles(docs: DataFrame, classes: DataFrame, shingle_words: int) -> DataFrame:
    """c and shingles (64 bits of each digest, sorted and packed): the sets of the classes, from their least rows' texts."""

    def digested(batches):
        for batch in pieces(batches):
            for start in range(0, batch.num_rows, 256):  # the sets are larger than the texts
                sets = [shingle_digests(x.as_py(), shingle_words) for x in batch.column(0).slice(start, 256)]
                c = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                packed = [np.sort(np.ascontiguousarray(x[:, 8:]).view(np.uint64).ravel()).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(packed, pa.binary())], names=["c", "shingles"])

    texts = _rows_of(docs, classes.select("least_id")).select(utf8("text").alias("text"))
    return texts.mapInArrow(digested, "c long, shingles binary").dropDuplicates(["c"])
