"""Audit log: entries, statistics, explanations, report digests, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.text import masked_or_null
from docassay.operators.scoring import overall_score

MAX_SIGNALS = 10

# Words that sort a signal, in order; all words of one group must occur.
SIGNAL_RULES = (
    ("checksum", "critical", (("verhoeff",), ("checksum",))),
    ("edited_region", "critical", (("ela",), ("re-compression",))),
    ("screen_or_copy", "critical", (("moire",), ("screen",))),
    ("pin_of_other_state", "critical", (("pin", "belongs to"),)),
    ("district_of_other_state", "critical", (("district", "mismatch"),)),
    ("age", "warning", (("age", "mismatch"),)),
    ("pasted_region", "warning", (("noise",), ("clone",))),
    ("generated_image", "critical", (("ai", "generat"),)),
    ("qr_missing", "warning", (("qr not detected",),)),
)


def classified_signal(signal: Column) -> Column:
    """struct(reason, severity) by the first rule that fits; other signals are warnings."""
    low = F.lower(signal)
    reason, severity = F.lit("other"), F.lit("warning")
    for code, level, groups in reversed(SIGNAL_RULES):
        fits = F.lit(False)
        for words in groups:
            every = F.lit(True)
            for w in words:
                every = every & F.contains(low, F.lit(w))
            fits = fits | every
        reason, severity = F.when(fits, code).otherwise(reason), F.when(fits, level).otherwise(severity)
    return F.struct(reason.alias("reason"), severity.alias("severity"))


def explained(signals: DataFrame) -> DataFrame:
    """`signals` (with a string column signal) and the reason and severity of each."""
    return signals.withColumn("__x", classified_signal(F.col("signal"))).select(
        *[c for c in signals.columns if c not in ("reason", "severity")], "__x.reason", "__x.severity"
    )


def statistics(log: DataFrame) -> DataFrame:
    """One row: total, verified, review, rejected, duplicates, avg_score (cut off); counts 0 for an empty log."""
    has = lambda *words: F.count_if(
        F.coalesce(sum((F.contains("verdict", F.lit(w)).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    )
    return log.agg(
        F.count("*").alias("total"),
        has("VERIFIED").alias("verified"),
        has("REVIEW").alias("review"),
        has("TAMPERED", "INVALID").alias("rejected"),
        F.count_if(F.coalesce("is_duplicate", F.lit(False))).alias("duplicates"),
        F.floor(F.try_sum(F.coalesce("overall", F.lit(0)).cast("long")) / F.greatest(F.count("*"), F.lit(1))).cast("int").alias("avg_score"),
    )


def recent(log: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The last n entries in the log's order; a top-n, not a full sort."""
    return log.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def entry(fields: dict[str, Column], signals: Column, scores: dict[str, Column]) -> dict[str, Column]:
    """Columns of an audit entry: a new id, the time, masked fields, scores with the overall one, the first ten signals.

    `scores`: qr_trust, tampering, geo, face; the overall score is theirs.
    """
    overall = overall_score(scores["qr_trust"], scores["tampering"], scores["geo"], scores["face"])
    zero = {"qr_trust": 0, "tampering": 100, "geo": 100, "face": 0}
    return {
        "log_id": F.uuid(),
        "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "scores": F.struct(*(F.coalesce(scores[k], F.lit(v)).cast("int").alias(k) for k, v in zero.items()), overall.alias("overall")),
        "fields_masked": F.struct(
            fields["name"].alias("name"), masked_or_null(fields["id_number"]).alias("id"),
            *(fields[k].alias(k) for k in ("dob", "gender", "pin", "district", "state")),
        ),
        "fraud_signals": F.slice(signals, 1, MAX_SIGNALS),
    }


def report_digest(*parts: Column) -> Column:
    """16 upper-case hex digits over the parts; a null part is empty."""
    joined = F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.upper(F.left(F.sha2(joined, 256), F.lit(16)))


def pixel_digest(data: Column) -> Column:
    """First 16 hex digits of the pixels' SHA-256."""
    return F.left(F.sha2(data, 256), F.lit(16))


def authorised(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """`requests` with auth_status: 401 without a key, 403 for an unknown one, else 200."""
    known = keys.select(F.col("api_key").alias("__known")).distinct()
    key = F.coalesce(F.trim("api_key"), F.lit(""))
    return (
        requests.join(known, key == F.col("__known"), "left")
        .withColumn("auth_status", F.when(key == "", 401).when(F.col("__known").isNull(), 403).otherwise(200))
        .drop("__known")
    )


def admission(auth: Column, rate_ok: Column, has_file: Column, quality: Column, duplicate: Column, failed: Column | None = None) -> Column:
    """HTTP status of the first gate that refuses: key, rate, file, quality, duplicate; then 500 for work that failed; else 200."""
    return (
        F.when(auth != 200, auth)
        .when(~rate_ok, 429)
        .when(~has_file, 400)
        .when(quality != "ok", 400)
        .when(duplicate, 409)
        .when(F.coalesce(F.lit(False) if failed is None else failed, F.lit(False)), 500)
        .otherwise(200)
    )


def quality_gate(width: Column, height: Column, brightness: Column, sharpness: Column) -> Column:
    """The first rule that an uploaded image breaks, else ok; null sizes are unreadable."""
    return (
        F.when(width.isNull() | height.isNull(), "unreadable")
        .when((width < 300) | (height < 200), "too_small")
        .when(brightness < 30, "too_dark")
        .when(brightness > 248, "blank")
        .when(sharpness < 5, "blurred")
        .when(~(width / height).between(0.4, 3.5), "aspect")
        .otherwise("ok")
    )
