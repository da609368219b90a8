"""Weighted module scores and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions import checksum, geo
from docassay.functions.reference_data import WEIGHTS
from docassay.operators import scoring as S
from docassay.plans.comparisons import _FIELDS, MATCHES_CTE, TRUST, customer_checks
from docassay.plans.geo import PIN_STATE, checksum_sql, name_plausibility_sql
from docassay.plans.derive import CUSTOMER_UID, OCR_NAME, PIN, STATE, cte, view


#: Detector results of every order line: one check of each line, by its number.
_CHECKS = {
    "doc_id": "l_orderkey",
    "n": "CAST(l_linenumber AS INT)",
    "score": "CAST(l_quantity * 2 AS INT)",
    "passed": "l_returnflag <> 'R'",
}
_NAMES = {1: ("tamper", "ela"), 2: ("tamper", "verhoeff"), 3: ("tamper", "noise"), 4: ("geo", "pin"), 5: ("geo", "district"), 6: ("geo", "ai_image"), 7: ("geo", "name")}


def module_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    module, check = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (m, c) in _NAMES.items():
        module, check = F.when(F.col("n") == n, m).otherwise(module), F.when(F.col("n") == n, c).otherwise(check)
    checks = view(spark, sf_dir, "lineitem", _CHECKS).withColumns({"module": module, "check": check})
    return S.module_scores(checks)


_KNOWN = {(m, c): (w, h) for m, c, w, h in WEIGHTS}
_WEIGHT_ROWS = ", ".join(f"({n}, '{m}', {round(_KNOWN[m, c][0] * 100)}, {_KNOWN[m, c][1]})" for n, (m, c) in _NAMES.items())
MODULE_SCORES = f"""
WITH w(n, module, w, hard) AS (VALUES {_WEIGHT_ROWS}),
s AS (SELECT doc_id, module, CAST(sum(score * w) // 100 AS INTEGER) AS whole, bool_or(hard AND NOT passed) AS failed
  FROM {cte("lineitem", _CHECKS)} JOIN w USING (n) GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN failed THEN least(whole, CASE module WHEN 'tamper' THEN 35 ELSE 25 END) ELSE whole END AS score FROM s)
SELECT doc_id, module, CAST(score AS INTEGER) AS score, NOT failed AS passed,
  CASE WHEN score >= 75 AND NOT failed THEN CASE module WHEN 'tamper' THEN 'CLEAN' ELSE 'VALID' END
       WHEN score >= 50 OR NOT failed THEN 'SUSPICIOUS' WHEN module = 'tamper' THEN 'TAMPERED' ELSE 'INVALID' END AS verdict FROM t"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's checks with format checks, trust, and made-up module results."""
    cards = customer_checks(spark, sf_dir)
    trust = S.trust_score({k: F.col(f"m_{k}") for k in _FIELDS})
    formats = S.format_checks(*(F.col(k) for k in ("name", "dob", "gender", "id_number")))
    tamper = (F.col("c_custkey") * 37 % 101).cast("int")
    place = (F.col("c_custkey") * 53 % 101).cast("int")
    return cards.withColumns(
        {f"f_{k}": c for k, c in formats.items()}
        | {"trust": trust, "tamper": tamper, "geo": place, "tamper_passed": tamper >= 20, "geo_passed": place >= 10, "live": (F.col("c_custkey") * 11 % 101).cast("int")}
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)
    matches = [F.col(f"m_{k}") for k in _FIELDS]
    formats = [F.col(f"f_{k}") for k in ("name", "dob", "gender", "id_number")]
    full = S.full_verdict(
        S.count_true(formats), F.col("trust"), S.count_true(matches), S.count_false(matches), F.col("live"),
        F.col("tamper_passed"), F.col("tamper"), F.col("geo_passed"), F.col("geo"),
    )
    service = S.service_verdict(S.all_valid(formats), F.col("tamper_passed"), F.col("geo_passed"), F.col("trust"))
    overall = S.overall_score(F.col("trust"), F.col("tamper"), F.col("geo"), F.col("live"))
    return j.select(
        "c_custkey", full.alias("verdict"), S.verdict_color(full).alias("color"), service["verdict"].alias("service_verdict"),
        service["score"].cast("int").alias("service_score"), overall.alias("overall"), S.score_bar(overall).alias("bar"),
    )


_JUDGED = f"""{MATCHES_CTE},
j AS (SELECT *, CAST(least(100, {TRUST}) AS INTEGER) AS trust, c_custkey * 37 % 101 AS tamper, c_custkey * 53 % 101 AS geo, c_custkey * 11 % 101 AS live,
  CASE WHEN gender IS NULL THEN FALSE ELSE TRUE END AS f_gender FROM m),
k AS (SELECT *, 3 + f_gender::INT AS mandatory, tamper >= 20 AS tok, geo >= 10 AS gok,
  {" + ".join(f"coalesce(m_{f}, FALSE)::INT" for f in _FIELDS)} AS matches, {" + ".join(f"coalesce(NOT m_{f}, FALSE)::INT" for f in _FIELDS)} AS mismatches FROM j),
v AS (SELECT *, CASE WHEN mandatory < 3 THEN 'REJECTED' WHEN mandatory = 3 THEN 'REVIEW REQUIRED' WHEN NOT tok THEN 'TAMPERED' WHEN NOT gok THEN 'GEO INVALID'
  WHEN trust >= 80 AND mismatches = 0 AND live >= 40 AND tamper >= 70 AND geo >= 70 THEN 'VERIFIED' WHEN trust >= 60 OR matches >= 4 THEN 'LIKELY GENUINE'
  WHEN trust >= 40 OR mismatches > 0 THEN 'REVIEW REQUIRED' ELSE 'LIKELY GENUINE' END AS verdict,
  CAST((35 * trust + 25 * tamper + 25 * geo + 15 * live) // 100 AS INTEGER) AS overall FROM k)"""
VERDICTS = f"""WITH {_JUDGED}
SELECT c_custkey, verdict, CASE WHEN contains(verdict, 'VERIFIED') OR contains(verdict, 'GENUINE') OR (contains(verdict, 'VALID') AND NOT contains(verdict, 'INVALID')) THEN 'green'
    WHEN contains(verdict, 'REVIEW') OR contains(verdict, 'SUSPICIOUS') THEN 'yellow' ELSE 'red' END AS color,
  CASE WHEN mandatory = 4 AND tok AND gok AND trust >= 80 THEN 'VERIFIED' WHEN mandatory = 4 AND tok AND gok THEN 'VALID' ELSE 'REVIEW REQUIRED' END AS service_verdict,
  CAST(CASE WHEN mandatory = 4 AND tok AND gok AND trust >= 80 THEN 95 WHEN mandatory = 4 AND tok AND gok THEN 80 WHEN mandatory = 4 THEN 60 ELSE 40 END AS INTEGER) AS service_score,
  overall, repeat('█', overall * 20 // 100) || repeat('░', 20 - overall * 20 // 100) AS bar FROM v"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer and field: readings, match and what they amount to."""
    cards = customer_checks(spark, sf_dir)
    rows = F.array(
        *(
            F.struct(F.lit(k).alias("field"), F.col(k).alias("ocr"), F.col(f"qr_{k}").alias("qr"), F.col(f"m_{k}").alias("matched"), F.lit(k in ("name", "dob", "gender", "id_number")).alias("mandatory"))
            for k in _FIELDS
        )
    )
    long = cards.select("c_custkey", F.explode_outer(rows).alias("x")).select("c_custkey", "x.*")
    return long.select("c_custkey", "field", S.conclusion(F.col("ocr"), F.col("qr"), F.col("matched"), F.col("mandatory")).alias("conclusion"))


def _summary_rows() -> str:
    out = []
    for k in _FIELDS:
        missing = "trim(coalesce({0}, '')) IN ('', 'None', '—')"
        ocr, qr = missing.format(k), missing.format("qr_" + k)
        alone = "ocr_unchecked" if k in ("name", "dob", "gender", "id_number") else "ocr_only"
        out.append(
            f"SELECT c_custkey, '{k}' AS field, CASE WHEN {ocr} AND {qr} THEN 'not_found' WHEN {ocr} THEN 'only_qr' WHEN {qr} OR m_{k} IS NULL THEN '{alone}' "
            f"WHEN m_{k} THEN 'match' ELSE 'mismatch' END AS conclusion FROM m"
        )
    return " UNION ALL ".join(out)


SUMMARY = f"WITH {MATCHES_CTE} {_summary_rows()}"

_FLAGSHIP = {"c_custkey": "c_custkey", "uid": CUSTOMER_UID, "pin": PIN, "state": STATE, "name": OCR_NAME}


def verdicts_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digit, PIN and name of every customer as weighted checks, counted by state and verdict."""
    c = view(spark, sf_dir, "customer", _FLAGSHIP)
    uid, matched = F.col("uid"), F.col("matched")
    placed = geo.with_state_of_pin(c, "pin", "expected").withColumns(
        {"matched": geo.same_state(F.col("expected"), F.col("state")), "checks_out": checksum.is_valid(uid)}
    )
    results = geo.with_name_plausibility(placed, "name", "person")
    check = lambda module, name, score, passed: F.struct(
        F.lit(module).alias("module"), F.lit(name).alias("check"), score.cast("int").alias("score"), passed.alias("passed")
    )
    checked = results.select(
        "c_custkey",
        F.coalesce("expected", F.lit("unknown")).alias("state"),
        F.array(
            check("tamper", "verhoeff", F.when(F.col("checks_out"), 100).otherwise(0), F.col("checks_out")),
            check("geo", "pin", geo.three_way_score(matched, 60), F.coalesce(matched, F.lit(True))),
            check("geo", "name", F.col("person.score"), F.col("person.passed")),
        ).alias("checks"),
    )
    # never empty; the outer form keeps Spark from testing that with all expressions over again
    long = checked.select(F.struct("c_custkey", "state").alias("doc_id"), F.explode_outer("checks").alias("x")).select("doc_id", "x.*")
    scored = S.module_scores(long)
    return scored.groupBy("doc_id.state", "module", "verdict").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("total_score"))


_PERSONS_OF_ALL = {"c_custkey": "c_custkey", "person": OCR_NAME}
VERDICTS_BY_STATE = f"""
WITH pins AS ({PIN_STATE}), names AS ({name_plausibility_sql(cte("customer", _PERSONS_OF_ALL))}),
ids AS ({checksum_sql(cte("customer", {"o_orderkey": "c_custkey", "uid12": CUSTOMER_UID}))}),
checks AS (
  SELECT p.c_custkey, coalesce(p.expected_state, 'unknown') AS state, 'tamper' AS module, CAST(i.score * 25 AS BIGINT) // 100 AS whole, NOT i.valid AS failed
  FROM pins p JOIN ids i ON i.o_orderkey = p.c_custkey
  UNION ALL
  SELECT p.c_custkey, coalesce(p.expected_state, 'unknown'), 'geo', CAST(p.score * 30 + n.score * 15 AS BIGINT) // 100, NOT coalesce(p.matched, TRUE)
  FROM pins p JOIN names n USING (c_custkey)
), s AS (SELECT *, CASE WHEN failed THEN least(whole, CASE module WHEN 'tamper' THEN 35 ELSE 25 END) ELSE whole END AS score FROM checks)
SELECT state, module, CASE WHEN score >= 75 AND NOT failed THEN CASE module WHEN 'tamper' THEN 'CLEAN' ELSE 'VALID' END
    WHEN score >= 50 OR NOT failed THEN 'SUSPICIOUS' WHEN module = 'tamper' THEN 'TAMPERED' ELSE 'INVALID' END AS verdict,
  count(*) AS n, CAST(sum(score) AS BIGINT) AS total_score FROM s GROUP BY 1, 2, 3"""

QUERIES = {
    "module_scores": (module_scores, MODULE_SCORES),
    "verdicts": (verdicts, VERDICTS),
    "summary_rows": (summary, SUMMARY),
    "verdicts_by_state": (verdicts_by_state, VERDICTS_BY_STATE),
}
