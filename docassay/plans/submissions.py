"""Submissions from corrected fields to the response: customers as submissions, orders and their lines as cards and passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions import checksum, geo
from docassay.operators import audit as A
from docassay.operators import scoring as S
from docassay.operators import submissions as U
from docassay.plans.comparisons import MATCHES_CTE, TRUST, WITHOUT_QR, customer_checks
from docassay.plans.derive import CUSTOMER_UID, DISTRICT, DOB, GENDER, OCR_NAME, PIN, STATE, UID12, cte, view
from docassay.plans.geo import PIN_STATE, checksum_sql, name_plausibility_sql
from docassay.plans.votes import PASSES, readings_sql
from docassay.sources import stream_table
from docassay.sources.audit_log import read_audit_log
from docassay.sources.scratch import scratch_folder
from docassay.streaming.intake import admitted, log_stream

_COMPARED = ("name", "dob", "gender", "pin", "district", "state")


def submission_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a submission: QR code (absent for a ninth, unreadable for another), checks, verdict, entry, response."""
    cards = customer_checks(spark, sf_dir)
    matches = {k: F.col(f"m_{k}") for k in _COMPARED}
    found, readable = F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 9 != 1
    without = S.score_without_qr(*(F.col(k) for k in ("name", "dob", "gender", "id_number")))
    formats = list(S.format_checks(*(F.col(k) for k in ("name", "dob", "gender", "id_number"))).values())
    placed = geo.with_state_of_pin(cards, "pin", "expected").withColumns(
        {
            "matched": geo.same_state(F.col("expected"), F.col("state")),
            "checks_out": checksum.is_valid(F.col("id_number")),
            "trust": U.qr_trust(found, readable, matches, without),
            "qr_signals": U.qr_signals(found, readable, matches),
            "valid": S.all_valid(formats),
            "doc_id": F.col("c_custkey"),
        }
    )
    judged = geo.with_name_plausibility(placed, "name", "person")
    check = lambda module, name, score, passed: F.struct(
        F.lit(module).alias("module"), F.lit(name).alias("check"), score.cast("int").alias("score"), passed.alias("passed")
    )
    checks = judged.select(
        "doc_id",
        F.explode_outer(
            F.array(
                check("tamper", "verhoeff", F.when(F.col("checks_out"), 100).otherwise(0), F.col("checks_out")),
                check("geo", "pin", geo.three_way_score(F.col("matched"), 60), F.coalesce("matched", F.lit(True))),
                check("geo", "name", F.col("person.score"), F.col("person.passed")),
            )
        ).alias("x"),
    ).select("doc_id", "x.*")
    of = lambda module: F.struct(F.max(F.when(F.col("module") == module, F.col("score"))).alias("score"), F.bool_and(F.when(F.col("module") == module, F.col("passed"))).alias("passed"))
    modules = S.module_scores(checks).groupBy("doc_id").agg(of("tamper").alias("tamper"), of("geo").alias("geo"))
    signalled = U.with_all_signals(placed, checks).join(modules, "doc_id")
    verdict = S.service_verdict(F.col("valid"), F.col("tamper.passed"), F.col("geo.passed"), F.col("trust"))
    fields = {k: F.col(k) for k in ("name", "dob", "gender", "pin", "district", "state", "id_number")}
    scores = {"qr_trust": F.col("trust"), "tampering": F.col("tamper.score"), "geo": F.col("geo.score"), "face": F.lit(None).cast("int")}
    entry = A.entry(fields, F.col("signals"), scores)
    totals = U.signal_totals(F.col("signals"))
    body = {"verdict": verdict, "tamper": F.col("tamper.score"), "geo": F.col("geo.score"), "name": F.col("name"), "gender": F.col("gender"), "issues": F.col("signals")}
    return signalled.withColumns({"entry": F.struct(*(entry[k].alias(k) for k in ("scores", "fields_masked", "fraud_signals"))), "totals": totals}).select(
        "c_custkey", "trust", F.col("tamper.score").alias("tamper"), F.col("geo.score").alias("geo"), F.col("entry.scores.overall").alias("overall"),
        F.col("entry.fields_masked.id").alias("masked"), F.array_join("entry.fraud_signals", "; ").alias("signals"),
        F.col("totals.total").alias("total"), F.col("totals.critical").alias("critical"), U.response_body(body).alias("body"),
    )


_TEXT = {check: text for (_, check), text in U.CHECK_SIGNALS.items()}
SUBMISSION_RESPONSES = f"""
WITH {MATCHES_CTE}, pins AS ({PIN_STATE}), names AS ({name_plausibility_sql(cte("customer", {"c_custkey": "c_custkey", "person": OCR_NAME}))}),
ids AS ({checksum_sql(cte("customer", {"o_orderkey": "c_custkey", "uid12": CUSTOMER_UID}))}),
x AS (SELECT m.*, i.valid, p.matched, p.score AS pin_score, w.score AS name_score, w.passed AS plausible, c_custkey % 9 AS k,
  CASE c_custkey % 9 WHEN 0 THEN {WITHOUT_QR} WHEN 1 THEN 40 ELSE CAST(least(100, {TRUST}) AS INTEGER) END AS trust
  FROM m JOIN ids i ON i.o_orderkey = m.c_custkey JOIN pins p USING (c_custkey) JOIN names w USING (c_custkey)),
y AS (SELECT *, CAST(CASE WHEN valid THEN 25 ELSE 0 END AS INTEGER) AS tamper,
  CAST(CASE WHEN NOT coalesce(matched, TRUE) THEN least(25, (pin_score * 30 + name_score * 15) // 100) ELSE (pin_score * 30 + name_score * 15) // 100 END AS INTEGER) AS geo,
  list_concat(CASE k WHEN 0 THEN ['{U.NO_QR}'] WHEN 1 THEN ['{U.BROKEN_QR}'] ELSE
      list_filter([{", ".join(f"CASE WHEN NOT m_{f} THEN '{f} mismatch' END" for f in _COMPARED)}], lambda s: s IS NOT NULL) END,
    list_filter([CASE WHEN NOT valid THEN '{_TEXT["verhoeff"]}' END, CASE WHEN NOT matched THEN '{_TEXT["pin"]}' END, CASE WHEN NOT plausible THEN '{_TEXT["name"]}' END],
      lambda s: s IS NOT NULL)) AS signals FROM x),
z AS (SELECT *, valid AND coalesce(matched, TRUE) AS sound, gender IS NOT NULL AS formed FROM y)
SELECT c_custkey, trust, tamper, geo, CAST((35 * trust + 25 * tamper + 25 * geo) // 100 AS INTEGER) AS overall, 'XXXX-XXXX-' || right(id_number, 4) AS masked,
  array_to_string(signals[:10], '; ') AS signals, CAST(len(signals) AS INTEGER) AS total,
  CAST(len(list_filter(signals, lambda s: s IN ('district mismatch', '{_TEXT["verhoeff"]}', '{_TEXT["pin"]}'))) AS INTEGER) AS critical,
  CAST(to_json({{'verdict': {{'verdict': CASE WHEN formed AND sound AND trust >= 80 THEN 'VERIFIED' WHEN formed AND sound THEN 'VALID' ELSE 'REVIEW REQUIRED' END,
      'score': CASE WHEN formed AND sound AND trust >= 80 THEN 95 WHEN formed AND sound THEN 80 WHEN formed THEN 60 ELSE 40 END}},
    'tamper': tamper, 'geo': geo, 'name': name, 'gender': gender, 'issues': signals}}) AS VARCHAR) AS body FROM z"""

_CARDS = {
    "doc_id": "o_orderkey",
    "name": "CASE o_orderkey % 4 WHEN 0 THEN ' 5UNITA DEVI ' WHEN 1 THEN 'RAM LAL' WHEN 2 THEN NULL ELSE 'GHANSHVAN DAS' END",
    "dob": "CASE o_orderkey % 3 WHEN 0 THEN '07/08/1999' WHEN 1 THEN 'unread' ELSE NULL END",
    "id_number": f"CASE o_orderkey % 2 WHEN 0 THEN translate({UID12}, '0156', 'OISG') ELSE left({UID12}, 9) END",
    "extra": "o_custkey",
}


def corrected_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.corrected_cards(view(spark, sf_dir, "orders", _CARDS), view(spark, sf_dir, "lineitem", PASSES))


CORRECTED_CARDS = f"""
WITH c AS {cte("orders", _CARDS)}, r AS (
  SELECT * FROM ({readings_sql("lineitem")})
  UNION ALL SELECT doc_id, {U.LAST_PASS}, 7, 8, 1999 FROM c WHERE dob = '07/08/1999'),
v AS (SELECT doc_id, arg_max(d, (n, -first)) AS d FROM (SELECT doc_id, d, count(*) AS n, min(pass_no) AS first FROM r GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT doc_id, arg_max(m, (n, -first)) AS m FROM (SELECT doc_id, m, count(*) AS n, min(pass_no) AS first FROM r GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT doc_id, arg_max(y, (n, -first)) AS y FROM (SELECT doc_id, y, count(*) AS n, min(pass_no) AS first FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT c.doc_id, CASE c.doc_id % 4 WHEN 0 THEN 'SUNITA DEVI' WHEN 1 THEN 'RAM LAL' WHEN 3 THEN 'GHANSHYAM DAS' END AS name,
  coalesce(format('{{:02d}}/{{:02d}}/{{:d}}', d, m, y), dob) AS dob,
  CASE c.doc_id % 2 WHEN 0 THEN left(u, 4) || ' ' || substring(u, 5, 4) || ' ' || right(u, 4) ELSE left(u, 9) END AS id_number, extra
FROM c JOIN (SELECT o_orderkey AS doc_id, {UID12} AS u FROM orders) USING (doc_id)
LEFT JOIN v USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN z USING (doc_id)"""

#: A submission for every customer: keys known, unknown and missing, fronts missing, images too dark, work that failed.
_SUBMITTED = {
    "report_id": "'S' || CAST(c_custkey AS VARCHAR(20))",
    "api_key": "CASE c_custkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'stale' ELSE 'key' || CAST(c_custkey % 5 AS VARCHAR(4)) END",
    "has_front": "c_custkey % 11 <> 0", "brightness": "CAST(c_custkey % 200 AS DOUBLE)", "failed": "c_custkey % 17 = 0",
    "name": OCR_NAME, "dob": DOB, "gender": GENDER, "id_number": CUSTOMER_UID, "pin": PIN, "district": DISTRICT, "state": STATE,
    "trust": "CAST(c_custkey % 101 AS INT)", "geo": "CAST(c_custkey % 51 AS INT)",
}
_KEYS = {"api_key": "'key' || CAST(n_nationkey % 4 AS VARCHAR(4))"}


def logged_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a stream of submissions, admitted, written to an audit log and read from it.

    The log stays in a folder under spark.checkpoint.dir, as the result is read from it.
    """
    submitted = stream_table(spark, sf_dir, "customer").selectExpr(*(f"{sql} AS {k}" for k, sql in _SUBMITTED.items()))
    quality = A.quality_gate(F.lit(900), F.lit(600), F.col("brightness"), F.lit(99.0))
    passed = admitted(submitted, view(spark, sf_dir, "nation", _KEYS), quality, failed=F.col("failed")).where("status = 200")
    fields = {k: F.col(k) for k in ("name", "dob", "gender", "pin", "district", "state", "id_number")}
    scores = {"qr_trust": F.col("trust"), "tampering": F.lit(100), "geo": F.col("geo"), "face": F.lit(0)}
    verdict = F.when(F.col("trust") >= 80, "VERIFIED").otherwise("REVIEW REQUIRED")
    signals = F.array_compact(F.array(F.when(F.col("trust") < 20, U.NO_QR)))
    entry = A.entry(fields, signals, scores) | {"report_id": F.col("report_id"), "verdict": verdict}
    folder = scratch_folder(spark, "audit-log")
    log_stream(passed.select(*(c.alias(k) for k, c in entry.items())), f"{folder}/log", f"{folder}/state").awaitTermination()
    log = read_audit_log(spark, f"{folder}/log")
    return log.select(
        "report_id", "verdict", F.col("scores.overall").alias("overall"), F.col("fields_masked.id").alias("masked"),
        F.col("fields_masked.name").alias("name"), F.size("fraud_signals").alias("signals"),
    )


LOGGED_SUBMISSIONS = f"""
WITH s AS {cte("customer", _SUBMITTED)}
SELECT report_id, CASE WHEN trust >= 80 THEN 'VERIFIED' ELSE 'REVIEW REQUIRED' END AS verdict,
  CAST((35 * trust + 25 * 100 + 25 * geo) // 100 AS INTEGER) AS overall, 'XXXX-XXXX-' || right(id_number, 4) AS masked, name, CAST(trust < 20 AS INTEGER) AS signals
FROM s WHERE api_key IN (SELECT api_key FROM {cte("nation", _KEYS)}) AND has_front AND brightness BETWEEN 30 AND 248 AND NOT failed"""

_REQUESTS = {"event_id": "event_id", "report_id": "CASE WHEN user_id % 6 = 0 THEN NULL ELSE 'R' || CAST(user_id AS VARCHAR(20)) END"}
_REPORTS = {"report_id": "'R' || CAST(c_custkey AS VARCHAR(20))", "path": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE '/reports/' || c_name END"}


def report_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.downloads(view(spark, sf_dir, "events", _REQUESTS), view(spark, sf_dir, "customer", _REPORTS))


REPORT_DOWNLOADS = f"""
SELECT event_id, e.report_id, CASE WHEN path IS NULL THEN 404 ELSE 200 END AS status, path
FROM {cte("events", _REQUESTS)} e LEFT JOIN {cte("customer", _REPORTS)} r ON r.report_id = e.report_id"""

QUERIES = {
    "submission_responses": (submission_responses, SUBMISSION_RESPONSES),
    "corrected_cards": (corrected_cards, CORRECTED_CARDS),
    "logged_submissions": (logged_submissions, LOGGED_SUBMISSIONS),
    "report_downloads": (report_downloads, REPORT_DOWNLOADS),
}
