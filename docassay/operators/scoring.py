"""Scores and verdicts over the long table check(doc_id, module, check, score, passed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions import compare as C
from docassay.functions.reference_data import MODULES, WEIGHTS


def module_scores(checks: DataFrame) -> DataFrame:
    """(doc_id, module, score, passed, verdict): weighted, truncated, capped by final failures.

    One aggregate with map-side combine; the ten weights are broadcast.
    """
    spark = checks.sparkSession
    weights = spark.createDataFrame(
        [(m, c, round(w * 100), h) for m, c, w, h in WEIGHTS], "module string, check string, w int, hard boolean"
    )
    summed = (
        checks.join(F.broadcast(weights), ["module", "check"])
        .groupBy("doc_id", "module")
        .agg(
            F.sum(F.col("score") * F.col("w")).alias("hundredths"),
            F.max(F.col("hard") & ~F.col("passed")).alias("failed"),
        )
    )
    whole = F.floor(F.col("hundredths") / 100).cast("int")
    cap = F.lit(None).cast("int")
    for module, (most, _) in MODULES.items():
        cap = F.when(F.col("module") == module, most).otherwise(cap)
    scored = summed.withColumn("score", F.when(F.col("failed"), F.least(whole, cap)).otherwise(whole))
    verdict = F.lit(None).cast("string")
    for module, (_, (good, middling, bad)) in MODULES.items():
        of_module = (
            F.when((F.col("score") >= 75) & ~F.col("failed"), good)
            .when((F.col("score") >= 50) | ~F.col("failed"), middling)
            .otherwise(bad)
        )
        verdict = F.when(F.col("module") == module, of_module).otherwise(verdict)
    return scored.select("doc_id", "module", "score", (~F.col("failed")).alias("passed"), verdict.alias("verdict"))


def format_checks(name: Column, dob: Column, gender: Column, number: Column, last_year: int = 2025) -> dict[str, Column]:
    """Three-valued validity of the four mandatory fields: true, false, or null (look by hand)."""
    digits = F.replace(F.coalesce(number, F.lit("")), F.lit(" "), F.lit(""))
    year = F.nullif(F.regexp_extract(dob, r"\d{4}", 0), F.lit("")).cast("int")
    unknown = F.lit(None).cast("boolean")
    return {
        "name": F.when(F.length(F.trim(F.coalesce(name, F.lit("")))) < 3, False)
        .when(name.rlike(r"^[A-Za-z\s.'-]+$"), True)
        .otherwise(unknown),
        "dob": F.coalesce(year.between(1900, last_year), F.lit(False)),
        "gender": F.when(F.coalesce(gender, F.lit("")) == "", False)
        .when(F.upper(gender).isin("MALE", "FEMALE", "TRANSGENDER"), True)
        .otherwise(unknown),
        "id_number": digits.rlike(r"^[2-9]\d{11}$"),
    }


def all_valid(checks: list[Column]) -> Column:
    """No check is false; null does not count against it."""
    return ~sum(((~F.coalesce(c, F.lit(True))).cast("int") for c in checks), F.lit(0)).cast("boolean")


def count_true(checks: list[Column]) -> Column:
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0))


def count_false(checks: list[Column]) -> Column:
    return sum((F.coalesce(~c, F.lit(False)).cast("int") for c in checks), F.lit(0))


# Points of each compared field.
POINTS = {"name": 20, "dob": 20, "gender": 10, "pin": 10, "district": 10, "state": 10}


def field_checks(ocr: dict[str, Column], qr: dict[str, Column]) -> dict[str, Column]:
    """Match of every field of an OCR record and a QR record; null where a side is missing.

    `ocr`: name, dob, gender, id_number, pin, district, state. `qr`: the same with
    district2, last4 and secure (boolean). The number is informational: it has no points.
    """

    def both(a: Column, b: Column, match: Column) -> Column:
        there = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
        return F.when(there, match)

    district = F.coalesce(F.nullif(qr["district"], F.lit("")), qr["district2"])
    capital = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, F.lit(2), F.length(c))))
    return {
        "name": both(ocr["name"], qr["name"], C.names_match(ocr["name"], qr["name"])),
        "dob": both(ocr["dob"], qr["dob"], C.dobs_match(ocr["dob"], qr["dob"])),
        "gender": both(ocr["gender"], qr["gender"], capital(ocr["gender"]) == capital(qr["gender"])),
        "pin": both(ocr["pin"], qr["pin"], C.pins_match(ocr["pin"], qr["pin"])),
        "district": both(ocr["district"], district, C.places_match(ocr["district"], district)),
        "state": both(ocr["state"], qr["state"], C.places_match(ocr["state"], qr["state"])),
        "id_number": C.numbers_match(ocr["id_number"], qr["id_number"], qr["last4"], qr["secure"]),
    }


def trust_score(checks: dict[str, Column]) -> Column:
    """20 for a readable payload and the points of every match, 100 at most."""
    points = sum((F.when(checks[f], p).otherwise(0) for f, p in POINTS.items()), F.lit(20))
    return F.least(points, F.lit(100)).cast("int")


def trust_verdict(score: Column) -> Column:
    return F.when(score >= 80, "LIKELY GENUINE").when(score >= 50, "REVIEW REQUIRED").otherwise("FRAUD SUSPECTED")


def score_without_qr(name: Column, dob: Column, gender: Column, number: Column, last_year: int = 2025) -> Column:
    """10 and points for well-formed OCR fields; 55 or more reads as valid fields."""
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    d, m, y = (F.get(F.split(trimmed(dob), "/"), k).try_cast("int") for k in range(3))
    dated = trimmed(dob).rlike(r"^\d{2}/\d{2}/\d{4}$") & d.between(1, 31) & m.between(1, 12) & y.between(1900, last_year)
    named = (F.length(trimmed(name)) >= 5) & trimmed(name).rlike(r"^[A-Za-z\s.'\-]+$")
    return (
        F.lit(10)
        + F.when(trimmed(number).rlike(r"^[2-9]\d{3}\s\d{4}\s\d{4}$"), 25).otherwise(0)
        + F.when(named, 15).otherwise(0)
        + F.when(dated, 10).otherwise(0)
        + F.when(F.initcap(trimmed(gender)).isin("Male", "Female", "Transgender"), 5).otherwise(0)
    ).cast("int")


#: Score of a payload that was found but not understood.
UNREADABLE_QR = 40


def full_verdict(
    mandatory: Column, trust: Column, matches: Column, mismatches: Column, liveness: Column,
    tamper_passed: Column, tamper_score: Column, geo_passed: Column, geo_score: Column,
) -> Column:
    """The verdict by ordered rules; missing module results (null) count as passed with score 100."""
    true, best = F.lit(True), F.lit(100)
    alive = F.coalesce(liveness, best) >= 40
    tampered, misplaced = ~F.coalesce(tamper_passed, true), ~F.coalesce(geo_passed, true)
    clean = (F.coalesce(tamper_score, best) >= 70) & (F.coalesce(geo_score, best) >= 70)
    return (
        F.when(mandatory < 3, "REJECTED")
        .when(mandatory == 3, "REVIEW REQUIRED")
        .when(tampered, "TAMPERED")
        .when(misplaced, "GEO INVALID")
        .when((trust >= 80) & (mismatches == 0) & alive & clean, "VERIFIED")
        .when((trust >= 60) | (matches >= 4), "LIKELY GENUINE")
        .when((trust >= 40) | (mismatches > 0), "REVIEW REQUIRED")
        .otherwise("LIKELY GENUINE")
    )


def service_verdict(valid: Column, tamper_passed: Column, geo_passed: Column, trust: Column) -> Column:
    """struct(verdict, score) of the service's shorter rule."""
    whole = valid & F.coalesce(tamper_passed, F.lit(True)) & F.coalesce(geo_passed, F.lit(True))
    pick = lambda a, b, c, d: F.when(whole & (trust >= 80), a).when(whole, b).when(valid, c).otherwise(d)
    return F.struct(
        pick("VERIFIED", "VALID", "REVIEW REQUIRED", "REVIEW REQUIRED").alias("verdict"), pick(95, 80, 60, 40).alias("score")
    )


def overall_score(trust: Column, tamper: Column, geo: Column, face: Column, rounded: bool = False) -> Column:
    """35 % trust, 25 % tamper, 25 % geo, 15 % face; missing ones 0, 100, 100, 0; cut off unless `rounded`."""
    hundredths = (
        35 * F.coalesce(trust, F.lit(0)) + 25 * F.coalesce(tamper, F.lit(100)) + 25 * F.coalesce(geo, F.lit(100)) + 15 * F.coalesce(face, F.lit(0))
    )
    return F.floor((hundredths + (50 if rounded else 0)) / 100).cast("int")


def completeness(fields: dict[str, Column]) -> Column:
    """Share of the weighted fields that are there, to three places."""
    # Weights.
    weights = {"name": 2, "dob": 1, "gender": 1, "id_number": 3, "pan_number": 3, "father_name": 1}
    there = sum(
        (F.when(F.coalesce(fields[k], F.lit("")) != "", w).otherwise(0) for k, w in weights.items() if k in fields), F.lit(0)
    )
    return F.round(there / float(sum(weights.values())), 3)


def verdict_color(verdict: Column) -> Column:
    v = F.upper(verdict)
    has = lambda s: F.contains(v, F.lit(s))
    good = has("VERIFIED") | has("GENUINE") | (has("VALID") & ~has("INVALID"))
    return F.when(good, "green").when(has("REVIEW") | has("SUSPICIOUS"), "yellow").otherwise("red")


def score_bar(score: Column, width: int = 20) -> Column:
    full = F.floor(score * width / 100).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), width - full))


def conclusion(ocr: Column, qr: Column, match: Column, mandatory: Column) -> Column:
    """Code of what a field's two readings amount to."""
    no_ocr, no_qr = C.not_missing(ocr).isNull(), C.not_missing(qr).isNull()
    return (
        F.when(no_ocr & no_qr, "not_found")
        .when(no_ocr, "only_qr")
        .when((no_qr | match.isNull()) & mandatory, "ocr_unchecked")
        .when(no_qr | match.isNull(), "ocr_only")
        .when(match, "match")
        .otherwise("mismatch")
    )


def backfilled(ocr: dict[str, Column], qr: dict[str, Column]) -> dict[str, Column]:
    """OCR fields with the missing ones taken from the QR record; a district has two sources there."""
    out = dict(ocr)
    for field in ("name", "dob", "gender", "id_number", "pin", "district", "state"):
        sources = [qr[k] for k in (field, *(["district2"] if field == "district" else []))]
        out[field] = F.coalesce(C.not_missing(ocr[field]), *map(C.not_missing, sources), ocr[field])
    return out


def accepted_suggestion(field: Column, old: Column, new: Column) -> Column:
    """The value after an outside suggestion: null-like ones are ignored; a name keeps its words and initials."""
    word = lambda c: F.split(F.trim(c), r"\s+")
    a, b = word(old), word(new)
    initials = lambda w: F.transform(w, lambda x: F.upper(F.left(x, F.lit(1))))
    guarded = (field == "name") & (F.size(a) >= 2) & (F.size(b) >= 2)
    kept = ~F.coalesce(guarded, F.lit(False)) | ((F.size(a) == F.size(b)) & (initials(a) == initials(b)))
    usable = F.coalesce(~F.lower(F.trim(new)).isin("", "null", "none", "n/a", "unknown"), F.lit(False))
    return F.when(usable & F.coalesce(kept, F.lit(True)), new).otherwise(old)


def report_checks(name: Column, dob: Column, gender: Column, number: Column) -> dict[str, Column]:
    """The report's shorter format checks, which look at a value's beginning only; null is false."""
    patterns = {"name": r"^[A-Za-z\s.'-]+", "dob": r"^\d{2}/\d{2}/\d{4}", "gender": r"^(Male|Female|Transgender)", "id_number": r"^[2-9]\d{3}\s\d{4}\s\d{4}"}
    values = {"name": name, "dob": dob, "gender": gender, "id_number": number}
    return {k: F.coalesce(values[k].rlike(p), F.lit(False)) for k, p in patterns.items()}


def location_support(pin: Column, district: Column, state: Column) -> Column:
    """Two of three places match."""
    return count_true([pin, district, state]) >= 2


def score_cards(trust: Column, tamper: Column, geo: Column, face: Column, liveness: Column) -> Column:
    """array of struct(label, score, passed) for the five cards of a result page."""
    # Least score of each card.
    cards = (("qr", trust, 60), ("tampering", tamper, 50), ("geo", geo, 50), ("face", face, 50), ("liveness", liveness, 50))
    return F.array(
        *(F.struct(F.lit(k).alias("label"), F.coalesce(v, F.lit(0)).alias("score"), (F.coalesce(v, F.lit(0)) >= least).alias("passed")) for k, v, least in cards)
    )


def ring_color(score: Column) -> Column:
    return F.when(score >= 75, "green").when(score >= 50, "yellow").otherwise("red")


def address_line(*parts: Column) -> Column:
    """Non-empty parts joined by commas, null if there is none."""
    return F.nullif(F.concat_ws(", ", *(F.nullif(F.trim(p), F.lit("")) for p in parts)), F.lit(""))
