"""OCR passes: turns of a conversation stand for the passes over a card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.operators import ocr as O
from docassay.operators import scoring as S
from docassay.plans.comparisons import MATCHES_CTE, TRUST, customer_checks
from docassay.plans.derive import cte, view

_PASSES = {
    "doc_id": "conv_id",
    "side": "CASE WHEN turn % 2 = 0 THEN 'front' ELSE 'back' END",
    "pass_no": "CAST(turn AS INT)",
    "text": "text",
    "probability": "CAST(turn % 10 AS DOUBLE) / 10.0",
}


def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.card_texts(view(spark, sf_dir, "conversations", _PASSES))
    return found.select("doc_id", F.sha2("text", 256).alias("digest"), "n_passes", "ask_again")


CARD_TEXTS = f"""SELECT doc_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY side DESC, pass_no, coalesce(text, ''))) AS digest, CAST(count(*) AS INTEGER) AS n_passes,
  sum(length(trim(replace(coalesce(text, ''), chr(10), '')))) < 80 AS ask_again FROM {cte("conversations", _PASSES)} GROUP BY doc_id"""


def confident_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = view(spark, sf_dir, "conversations", _PASSES)
    return O.confident_texts(tokens).select("doc_id", "pass_no", F.round("confidence", 6).alias("confidence"))


CONFIDENT_PASSES = f"SELECT doc_id, pass_no, round(avg(probability), 6) AS confidence FROM {cte('conversations', _PASSES)} GROUP BY 1, 2 HAVING avg(probability) >= 0.5"

_READINGS = {"doc_id": "c_custkey", "conf": "CAST(c_custkey % 7 AS DOUBLE) / 7.0", "name": "c_name"}
_SECOND = {"doc_id": "c_custkey", "conf": "CAST(c_custkey % 5 AS DOUBLE) / 5.0", "name": "upper(c_name)"}


def better_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (view(spark, sf_dir, "customer", c) for c in (_READINGS, _SECOND))
    return O.better_reading(first, second, "conf").select("doc_id", "name")


BETTER_READINGS = f"""SELECT a.doc_id, CASE WHEN b.conf > a.conf THEN b.name ELSE a.name END AS name
FROM {cte("customer", _READINGS)} a JOIN {cte("customer", _SECOND)} b USING (doc_id)"""


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a result page shows of every customer: report checks, places, score cards."""
    c = customer_checks(spark, sf_dir)
    trust = S.trust_score({k: F.col(f"m_{k}") for k in S.POINTS})
    number = F.concat_ws(" ", F.left("id_number", F.lit(4)), F.substring("id_number", 5, 4), F.right("id_number", F.lit(4)))
    checks = S.report_checks(F.col("name"), F.col("dob"), F.col("gender"), number)
    page = c.withColumn("trust", trust).withColumn("card", F.explode_outer(S.score_cards(F.col("trust"), F.col("c_custkey").cast("int") % 101, F.lit(None).cast("int"), F.lit(50), F.lit(49))))
    return page.select(
        "c_custkey", "card.label", "card.score", "card.passed", S.ring_color(F.col("card.score")).alias("color"),
        S.count_true(list(checks.values())).cast("int").alias("checks"),
        S.location_support(F.col("m_pin"), F.col("m_district"), F.col("m_state")).alias("located"),
        S.address_line(F.col("qr_district"), F.col("state"), F.col("pin")).alias("address"),
    )


RESULT_PAGES = f"""WITH {MATCHES_CTE},
t AS (SELECT *, CAST(least(100, {TRUST}) AS INTEGER) AS trust,
  3 + CASE WHEN gender IN ('Male', 'Female') THEN 1 ELSE 0 END AS checks,
  coalesce(m_pin, FALSE)::INT + coalesce(m_district, FALSE)::INT + coalesce(m_state, FALSE)::INT >= 2 AS located,
  nullif(concat_ws(', ', nullif(trim(qr_district), ''), nullif(trim(state), ''), nullif(trim(pin), '')), '') AS address FROM m),
u AS (SELECT c_custkey, 'qr' AS label, trust AS score, trust >= 60 AS passed, checks, located, address FROM t
  UNION ALL SELECT c_custkey, 'tampering', CAST(c_custkey % 101 AS INTEGER), c_custkey % 101 >= 50, checks, located, address FROM t
  UNION ALL SELECT c_custkey, 'geo', 0, FALSE, checks, located, address FROM t
  UNION ALL SELECT c_custkey, 'face', 50, TRUE, checks, located, address FROM t
  UNION ALL SELECT c_custkey, 'liveness', 49, FALSE, checks, located, address FROM t)
SELECT c_custkey, label, score, passed, CASE WHEN score >= 75 THEN 'green' WHEN score >= 50 THEN 'yellow' ELSE 'red' END AS color,
  CAST(checks AS INTEGER) AS checks, located, address FROM u"""

QUERIES = {
    "card_texts": (card_texts, CARD_TEXTS),
    "confident_passes": (confident_passes, CONFIDENT_PASSES),
    "better_readings": (better_readings, BETTER_READINGS),
    "result_pages": (result_pages, RESULT_PAGES),
}
