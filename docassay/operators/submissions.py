"""What becomes of a submission's parts: corrected fields, signals, score of its QR code, audit entry and response."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.text import corrected_name, regrouped_id
from docassay.operators.audit import MAX_SIGNALS, classified_signal
from docassay.operators.scoring import UNREADABLE_QR, trust_score
from docassay.operators.voting import date_votes
from docassay.sources import spread

#: Signals of a QR code that was not found or not understood.
NO_QR, BROKEN_QR = "QR not detected", "QR present but unreadable"
#: Signal of each failed check, in the order in which they are reported.
CHECK_SIGNALS = {
    ("tamper", "ela"): "ELA: an edited region",
    ("tamper", "noise"): "Noise differs between regions",
    ("tamper", "font"): "Font differs between digits",
    ("tamper", "moire"): "Moire of a screen",
    ("tamper", "hologram"): "Hologram missing",
    ("tamper", "verhoeff"): "Verhoeff checksum does not fit",
    ("geo", "pin"): "PIN belongs to another state",
    ("geo", "district"): "District mismatch with the state",
    ("geo", "ai_image"): "AI generated image",
    ("geo", "name"): "Name not plausible",
}
LAST_PASS = (1 << 62) - 1


def corrected_cards(cards: DataFrame, passes: DataFrame, last_year: int = 2025) -> DataFrame:
    """`cards` (doc_id, name, dob, id_number, ...) with these three fields corrected.

    Misread letters of the name and digits of the number are put right. The date
    of birth is voted on by component over all readings in `passes` (doc_id,
    pass_no, text) and the card's own date, which comes last; it stays where no
    reading holds a date. Other columns stay.
    """
    fixed = {"name": corrected_name(F.col("name")), "id_number": regrouped_id(F.col("id_number"))}
    corrected = spread(cards).select(*(fixed[c].alias(c) if c in fixed else F.col(c) for c in cards.columns))
    readings = passes.select("doc_id", F.col("pass_no").cast("long").alias("pass_no"), "text")
    own = cards.select("doc_id", F.lit(LAST_PASS).cast("long").alias("pass_no"), F.col("dob").alias("text"))
    voted = date_votes(readings.unionByName(own), last_year).select(F.col("doc_id").alias("__id"), F.col("dob").alias("__dob"))
    joined = corrected.join(voted, F.col("doc_id") == F.col("__id"), "left")
    return joined.select(*(F.coalesce("__dob", "dob").alias(c) if c == "dob" else F.col(c) for c in cards.columns))


def qr_trust(found: Column, readable: Column, matches: dict[str, Column], without: Column) -> Column:
    """Trust in a submission: by the matching fields, 40 for an unreadable code, `without` where there is none."""
    return F.when(~found, without).when(~readable, UNREADABLE_QR).otherwise(trust_score(matches)).cast("int")


def _present(*signals: Column) -> Column:
    return F.array_compact(F.array(*signals))


def qr_signals(found: Column, readable: Column, matches: dict[str, Column]) -> Column:
    """Array of the signals of a QR code: absent, unreadable, or a signal for each field that does not match."""
    none = F.lit(None).cast("string")
    fields = _present(*(F.when(~m, f"{field} mismatch").otherwise(none) for field, m in matches.items()))
    return F.when(~found, F.array(F.lit(NO_QR))).when(~readable, F.array(F.lit(BROKEN_QR))).otherwise(fields)


def check_signals(checks: DataFrame) -> DataFrame:
    """(doc_id, signals): the signals of a document's failed checks, in their fixed order.

    `checks`: doc_id, module, check, passed. Documents without a failed check
    are left out; there is a signal a check at most, however often it failed.
    """
    order, signal = F.lit(None).cast("int"), F.lit(None).cast("string")
    for n, ((module, check), text) in enumerate(CHECK_SIGNALS.items()):
        same = (F.col("module") == module) & (F.col("check") == check)
        order, signal = F.when(same, n).otherwise(order), F.when(same, text).otherwise(signal)
    failed = checks.where("NOT passed").select("doc_id", F.struct(order.alias("n"), signal.alias("signal")).alias("x")).where("x.signal IS NOT NULL")
    return failed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_set("x")), lambda x: x["signal"]).alias("signals"))


def with_all_signals(submissions: DataFrame, checks: DataFrame, out: str = "signals") -> DataFrame:
    """`submissions` (doc_id, qr_signals, ...) with all signals in `out`: of the QR code, then of tampering, then of places."""
    failed = check_signals(checks).select(F.col("doc_id").alias("__id"), F.col("signals").alias("__signals"))
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce("qr_signals", none), F.coalesce("__signals", none))
    kept = [c for c in submissions.columns if c != out]
    return submissions.join(failed, F.col("doc_id") == F.col("__id"), "left").select(*kept, every.alias(out))


def signal_totals(signals: Column) -> Column:
    """struct(total, critical) of an array of signals; none for null."""
    critical = F.filter(signals, lambda s: classified_signal(s)["severity"] == "critical")
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return F.struct(F.when(signals.isNull(), 0).otherwise(count(signals)).alias("total"), F.when(signals.isNull(), 0).otherwise(count(critical)).alias("critical"))


def reported(signals: Column) -> Column:
    """The signals that an audit entry keeps."""
    return F.slice(signals, 1, MAX_SIGNALS)


def response_body(parts: Mapping[str, Column]) -> Column:
    """The parts as one JSON object; null ones stay as null."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in parts.items())), {"ignoreNullFields": "false"})


def downloads(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """`requests` (report_id, ...) with status and path: 200 and where the report is, else 404.

    `reports`: report_id, path; of several with the same id the greatest path counts.
    """
    known = reports.where("report_id IS NOT NULL AND path IS NOT NULL").groupBy(F.col("report_id").alias("__id")).agg(F.max("path").alias("__path"))
    kept = [c for c in requests.columns if c not in ("status", "path")]
    joined = requests.join(known, F.col("report_id") == F.col("__id"), "left")
    return joined.select(*kept, F.when(F.col("__path").isNull(), 404).otherwise(200).alias("status"), F.col("__path").alias("path"))
