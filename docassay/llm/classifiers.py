"""Language ID and quality by byte convolutional networks (see `bytecnn`).

Both learn on the driver from a bounded sample of labelled windows and are then
applied to every window of every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.llm.bytecnn import OVERLAP, STRIDE, WINDOW, Adam, Filters, cut
from docassay.llm.common import seeded_long, spans, utf8
from docassay.sources import spread

#: Bounds of the training sample: documents of a label and windows of a document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 600, 8
UNDETERMINED = "und"


def _sampled_windows(text: Column, windows: int) -> Column:
    """Up to `windows` windows of the bytes, evenly spread, so that no long text reaches the driver."""
    n = F.octet_length(text)
    count = F.greatest(F.lit(1), F.ceil((n - OVERLAP) / STRIDE)).cast("int")
    taken = F.least(count, F.lit(windows))
    return F.transform(
        F.sequence(F.lit(0), taken - 1),
        lambda i: F.substring(text, F.floor(i * count / taken).cast("int") * STRIDE + 1, F.lit(WINDOW)),
    )


def labelled_sample(
    labels: DataFrame,
    texts: DataFrame,
    seed: int,
    docs_per_label: int = SAMPLE_DOCS,
    windows: int = SAMPLE_WINDOWS,
) -> list[tuple[object, list[bytes]]]:
    """(label, windows) of about `docs_per_label` documents of each label, in a fixed order.

    `labels`: doc_id and label, `texts`: doc_id and text; rows without id, label
    or text are left out. A seeded hash of the id picks the ids by their label's
    count, and only the picked ones' texts are looked up: the ids, twice the
    wanted number at most, are broadcast and no text is shuffled.
    """
    usable = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "label")
    counts = usable.groupBy("label").count().collect()  # a row a label
    if not counts:
        return []
    most = 2 * docs_per_label * len(counts)
    share = F.create_map(*(F.lit(x) for r in counts for x in (r[0], min(1.0, docs_per_label / r[1]))))
    u = F.shiftrightunsigned(seeded_long(seed, "doc_id"), 11) / F.lit(float(1 << 53))
    picked = (
        usable.withColumn("u", u)
        .where(F.col("u") < F.element_at(share, F.col("label")))
        .orderBy("u", F.col("label").cast("string"))
        .limit(most)
    )
    rows = (
        texts.where("octet_length(text) > 0")
        .join(F.broadcast(picked), "doc_id")
        .select("u", "label", _sampled_windows(utf8("text"), windows).alias("w"))
        .orderBy("u", F.col("label").cast("string"), "w")
        .limit(most)
        .collect()
    )
    return [(r["label"], [bytes(w) for w in r["w"]]) for r in rows]


def background_windows(sample, seed: int = 1) -> list[tuple[str, list[bytes]]]:
    """Windows that are in no language, labelled `und`: a quarter as many as the sample's (64 at least), of the same lengths.

    Letters drawn evenly (a to z; or of one of several scripts), printable ASCII, and
    digits and signs with a letter now and then. A text of the sample is never taken apart
    for it, so that any labelled text can be told from it by its letters or their order.
    """
    rng = np.random.default_rng(seed)
    alphabets = [
        [chr(c) for c in range(97, 123)],
        [chr(c) for c in range(33, 127)],
        [*"0123456789!?#$%&*+-=/<>@^~|.,:;()[]{}" * 3, *"abcdefghijklmnopqrstuvwxyz"],
        *([chr(c) for c in range(a, b)] for a, b in ((0x391, 0x3CA), (0x410, 0x450), (0x5D0, 0x5EB), (0x621, 0x64B), (0x905, 0x93A), (0x3041, 0x3097), (0x4E00, 0x9FFF), (0xAC00, 0xD7A4))),
    ]
    sizes = [len(w) for _, ws in sample for w in ws]
    if not sizes:
        return []
    sizes, out = (sizes[::4] * 64)[: max(64, -(-len(sizes) // 4))], []
    for k, size in enumerate(sizes):
        kind = k % 4
        letters = alphabets[kind] if kind < 3 else alphabets[3 + int(rng.integers(len(alphabets) - 3))]
        drawn = rng.integers(len(letters), size=size)
        spaced = rng.random(size) < 1 / rng.integers(3, 12)
        text = "".join(" " if gap else letters[i] for i, gap in zip(drawn, spaced))
        if kind == 0 and k % 8 < 4:
            text = text.title()
        out.append((UNDETERMINED, [text.encode()[: max(1, size)]]))
    return out


def _padded(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


@dataclass
class LanguageModel:
    """Multi-width filters, max pooling and softmax for every window; windows vote by log-probability."""

    labels: list[str]
    filters: Filters | None
    dense: np.ndarray | None
    offset: np.ndarray | None

    @classmethod
    def train(cls, sample, seed: int = 1, widths=(2, 3, 4), filters: int = 8, epochs: int = 6, batch: int = 128, rate: float = 0.01, least_steps: int = 0) -> LanguageModel:
        labels = sorted({label for label, _ in sample})
        if len(labels) < 2:
            return cls(labels, None, None, None)
        rng = np.random.default_rng(seed)
        x = _padded([w for _, ws in sample for w in ws])
        epochs = max(epochs, -(-least_steps * batch // len(x)))
        y = np.array([labels.index(label) for label, ws in sample for _ in ws])
        conv = Filters.fresh(rng, widths, filters)
        dense = rng.normal(0, 0.3, (len(conv.bias), len(labels))).astype(np.float32)
        offset = np.zeros(len(labels), np.float32)
        adam = Adam([*conv.tables, conv.bias, dense, offset], rate)
        # every label weighs the same
        weight = (len(y) / len(labels) / np.bincount(y, minlength=len(labels)))[y].astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                at = order[i : i + batch]
                raw, places = conv.pooled(x[at])
                h = np.maximum(raw, 0)
                grad = np.exp(_log_softmax(h @ dense + offset))
                grad[np.arange(len(at)), y[at]] -= 1
                grad *= weight[at, None] / len(at)
                below = grad @ dense.T * (raw > 0)
                adam.step([*conv.gradients(x[at], places, below), below.sum(0), h.T @ grad + 1e-4 * dense, grad.sum(0)])
        return cls(labels, conv, dense, offset)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(label position, its probability) of each text, over all of its windows."""
        if self.filters is None or not texts:
            return np.zeros(len(texts), np.int64), np.full(len(texts), float(len(self.labels)))
        flat, starts, first = cut(texts)
        votes = np.add.reduceat(_log_softmax(self.filters.features(flat, starts) @ self.dense + self.offset), first, 0)
        chance = np.exp(_log_softmax(votes.astype(np.float64)))
        best = chance.argmax(1)
        return best, chance[np.arange(len(best)), best]


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with lang_pred and score (in place of columns of that name).

    `und` and score 0 where the text is null or has no letter, or where no
    language was learnt. With a single learnt language every other text has it,
    with score 1. Texts of any length are read whole; other columns stay.
    """
    base = spread(docs.drop("lang_pred", "score"))

    @F.pandas_udf("struct<p: int, s: double>")
    def predicted(text):
        import pandas as pd

        texts = [t or b"" for t in text]
        found = [model.predict(texts[part]) for part in spans(map(len, texts))] or [model.predict([])]
        best, chance = map(np.concatenate, zip(*found))
        return pd.DataFrame({"p": best.astype(np.int32), "s": chance})

    if not model.labels:
        return base.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    known = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))
    labels = F.array(*map(F.lit, model.labels))
    return base.withColumn("__p", predicted(utf8("text"))).select(
        *base.columns,
        F.when(known, F.get(labels, F.col("__p.p"))).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(known, F.col("__p.s")).otherwise(0.0).alias("score"),
    )


@dataclass
class QualityModel:
    """Filters over overlapping chunks; the mean and the greatest of the chunks' pooled answers give one probability."""

    filters: Filters | None
    dense: np.ndarray | None
    offset: float

    @classmethod
    def train(cls, sample, seed: int = 1, widths=(3, 5), filters: int = 8, epochs: int = 8, batch: int = 32, rate: float = 0.01, least_steps: int = 600, share: float | None = None) -> QualityModel:
        """`share`: of label 1 among all labelled rows, where the sample was drawn by label."""
        y = np.array([int(label) for label, _ in sample], np.float32)
        drawn = float(y.mean()) if len(y) else 0.5
        if drawn in (0.0, 1.0) or not len(y):
            return cls(None, None, float(np.log((drawn * len(y) + 1) / ((1 - drawn) * len(y) + 1))))
        share = drawn if share is None else share
        epochs = max(epochs, -(-least_steps * batch // len(y)))
        rng = np.random.default_rng(seed)
        x = [_padded(ws) for _, ws in sample]
        conv = Filters.fresh(rng, widths, filters)
        n = len(conv.bias)
        dense, offset = rng.normal(0, 0.1, 2 * n).astype(np.float32), np.zeros(1, np.float32)
        adam = Adam([*conv.tables, conv.bias, dense, offset], rate)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                at = order[i : i + batch]
                windows = np.concatenate([x[k] for k in at])
                sizes = np.array([len(x[k]) for k in at])
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                raw, places = conv.pooled(windows)
                h = np.maximum(raw, 0)
                both = np.concatenate([np.add.reduceat(h, first, 0) / sizes[:, None], np.maximum.reduceat(h, first, 0)], 1)
                grad = (1 / (1 + np.exp(-(both @ dense + offset[0]))) - y[at]) / len(at)
                down = grad[:, None] * dense
                of = np.repeat(np.arange(len(at)), sizes)
                below = down[of, :n] / sizes[of, None] + down[of, n:] * (h == both[of, n:])
                below = (below * (raw > 0)).astype(np.float32)
                adam.step([*conv.gradients(windows, places, below), below.sum(0), both.T @ grad + 1e-4 * dense, grad.sum(keepdims=True)])
        odds = lambda p: float(np.log(p / (1 - p)))
        return cls(conv, dense, float(offset[0]) + odds(share) - odds(drawn))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.filters is None or not texts:
            return np.full(len(texts), 1 / (1 + np.exp(-self.offset)))
        flat, starts, first = cut(texts)
        h = self.filters.features(flat, starts)
        sizes = np.diff([*first, len(starts)])
        both = np.concatenate([np.add.reduceat(h, first, 0) / sizes[:, None], np.maximum.reduceat(h, first, 0)], 1)
        return 1 / (1 + np.exp(-(both @ self.dense + self.offset).astype(np.float64)))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from 0.5 on), in place of columns of that name.

    A null text counts as empty; empty texts get the score of an empty chunk.
    Without both labels to learn from, all get the share of label 1 (smoothed;
    0.5 without any). Texts of any length are read whole; other columns stay.
    """
    base = spread(docs.drop("score", "predicted"))

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        texts = [t or b"" for t in text]
        return pd.Series(np.concatenate([model.scores(texts[part]) for part in spans(map(len, texts))] or [np.zeros(0)]))

    return base.withColumn("score", scored(utf8("text"))).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )


def remainder(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo `parts`; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % parts
