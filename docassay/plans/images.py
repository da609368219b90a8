"""Measurements of images that Spark derives from the embeddings, and ages of card holders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.operators import images as I
from docassay.plans.derive import view
from docassay.sources import read_table, spread

#: Each value of an embedding becomes a square of so many grey pixels.
CELL = 8


def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64 x 64 grey image of every embedding of 64 values: 8 x 8 squares of equal grey; others have no pixels."""
    e = read_table(spark, sf_dir, "embeddings")
    level = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.lit(128) + x.cast("double") * 250).cast("int"))))
    square = F.transform(level, lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), CELL))
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.repeat(F.array_join(F.slice(square, r * 8 + 1, F.lit(8)), ""), CELL))
    data = F.when(F.size("embedding") == 64, F.unhex(F.array_join(lines, "")))
    return spread(e).select("vec_id", data.alias("data"), *(F.lit(n).alias(k) for k, n in (("height", 64), ("width", 64), ("n_channels", 1))))


def image_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.with_measures(embedding_images(spark, sf_dir))
    at = lambda k: F.col(f"m.{k}")
    face = I.face_quality(at("sharpness"), at("brightness"), F.col("height") * F.col("width"), at("contrast"))
    alive = I.liveness(at("fft_peak"), at("fft_high"))
    checks = {
        "noise": I.noise_check(at("noise_variances")),
        "moire": I.moire_check(at("moire_peaks"), at("moire_global")),
        "ai_image": I.generated_check(at("dct_energies"), at("dct_high"), at("dct_zeros")),
        "hologram": I.hologram_check(at("corner_colourful"), at("corner_saturation"), at("corner_hues")),
        "ela": I.recompression_check(at("ela_blocks"), at("ela_pixels")),
    }
    return m.select(
        "vec_id", I.phash(at("dct64")).alias("phash"), I.blur_label(at("sharpness")).alias("blur"),
        *(c["score"].alias(k) for k, c in checks.items()), face["label"].alias("face"), alive["label"].alias("liveness"),
    )


def cleaned_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image made ready for OCR, as the digest of its pixels."""
    return I.cleaned(embedding_images(spark, sf_dir)).select("vec_id", "height", "width", F.round("sharpness", 3).alias("sharpness"), F.sha2("data", 256).alias("digest"))


def texture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texture of each image against its successor's."""
    h = embedding_images(spark, sf_dir).select("vec_id", I.texture_histograms("data", "height", "width", "n_channels").alias("h"))
    pairs = h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("other")), "vec_id")
    x = I.histogram_match(F.col("h"), F.col("other"))
    return pairs.select("vec_id", x["distance"].alias("distance"), x["score"].alias("score"), x["label"].alias("label"))


def face_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image as a face: both liveness scores, occlusion without an eye detector, and the strokes' check."""
    images = embedding_images(spark, sf_dir)
    size = ("data", "height", "width", "n_channels")
    m = images.select("vec_id", I.face_measures(*size).alias("f"))
    at = lambda k: F.col(f"f.{k}")
    frequency = I.liveness(at("fft_peak"), at("fft_high"))
    parts = I.liveness_parts(*(at(k) for k in ("entropy", "sharp_edges", "high_share", "skin_pixels", "skin_saturation", "skin_spread")))
    passive = I.passive_liveness(**parts)
    both = I.combined_liveness(frequency["score"], passive["score"])
    occlusion = I.occlusion_score(F.lit(0), at("solid"), at("variance"), at("dark"))
    return m.select(
        "vec_id", frequency["score"].alias("frequency"), passive["score"].alias("passive"), both["real"].alias("alive"), occlusion.alias("occlusion"),
        I.font_check(at("strokes"), at("stroke_spread"))["score"].alias("font"),
    )


_AGES = {"o_orderkey": "o_orderkey", "born": "CAST(o_orderdate AS DATE)", "estimate": "CAST(o_orderkey % 60 AS DOUBLE)"}


def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "orders", _AGES)
    x = I.age_check(F.col("born"), F.col("estimate"), F.lit("2026-01-01").cast("date"), F.lit(12.0))
    return o.select("o_orderkey", F.round(x["age"], 6).alias("age"), x["score"].alias("score"))


AGES = """
WITH a AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2026-01-01') / 365.25::DOUBLE AS age, (o_orderkey % 60)::DOUBLE AS e FROM orders)
SELECT o_orderkey, round(age, 6) AS age, CAST(CASE WHEN abs(age - e) <= 6 THEN 100 WHEN abs(age - e) <= 12 THEN 75 WHEN abs(age - e) <= 18 THEN 45 ELSE 10 END AS INTEGER) AS score FROM a"""

QUERIES = {
    "image_checks": (image_checks, None),
    "cleaned_images": (cleaned_images, None),
    "texture_pairs": (texture_pairs, None),
    "face_checks": (face_checks, None),
    "ages": (ages, AGES),
}
