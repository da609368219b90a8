"""Card images as rows of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of uploads; WEBP is listed though Spark's reader has no decoder for it.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, n_channels, data, readable for every image file under `path`.

    Files that do not decode stay as rows with readable false and null pixels.
    """
    image = F.col("image")
    readable = image["mode"] >= 0
    found = spark.read.format("image").option("dropInvalid", False).load(path)
    allowed = F.lower(F.regexp_extract(image["origin"], r"\.([^.]+)$", 1)).isin(*EXTENSIONS)
    value = lambda k: F.when(readable, image[k])
    return found.where(allowed).select(
        image["origin"].alias("origin"), value("height").alias("height"), value("width").alias("width"),
        value("nChannels").alias("n_channels"), value("data").alias("data"), readable.alias("readable"),
    )
