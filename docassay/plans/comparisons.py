"""Readings compared with QR payloads, and vectors with each other."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docassay.functions import compare as C
from docassay.operators import names as N
from docassay.operators import qr as Q
from docassay.operators import scoring as S
from docassay.operators.images import match_by_cosine
from docassay.plans.derive import CUSTOMER_CARDS, CUSTOMER_UID, DOB, OCR_NAME, PIN, cte, view
from docassay.sources import read_table, spread

_FIELDS = ("name", "dob", "gender", "id_number", "pin", "district", "state")


def customer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey and the match of each field of its OCR and QR record."""
    cards = spread(view(spark, sf_dir, "customer", CUSTOMER_CARDS))
    ocr = {k: F.col(k) for k in _FIELDS}
    qr = {k: F.col(f"qr_{k}") for k in (*_FIELDS, "last4", "secure")} | {"district2": F.lit(None).cast("string")}
    checks = S.field_checks(ocr, qr)
    return cards.select("*", *(c.alias(f"m_{k}") for k, c in checks.items()))


def field_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_checks(spark, sf_dir).select("c_custkey", *(f"m_{k}" for k in _FIELDS))


_NORMAL = "trim(regexp_replace(regexp_replace(upper({}), '[^A-Z\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 1)), lambda i: substr({0}, i, 2)))"
MATCHES_CTE = f"""
c AS {cte("customer", CUSTOMER_CARDS)},
n AS (SELECT *, {_NORMAL.format("name")} AS a, {_NORMAL.format("coalesce(qr_name, '')")} AS b FROM c),
g AS (SELECT *, {_GRAMS.format("replace(a, ' ', '')")} AS ga, {_GRAMS.format("replace(b, ' ', '')")} AS gb,
  regexp_replace(trim(dob), '[-/.]', '/', 'g') AS x, regexp_replace(trim(qr_dob), '[-/.]', '/', 'g') AS y,
  regexp_replace(id_number, '[^0-9]', '', 'g') AS i, regexp_replace(qr_id_number, '[^0-9]', '', 'g') AS j FROM n),
m AS (SELECT *,
  CASE WHEN coalesce(qr_name, '') = '' THEN NULL WHEN a = '' OR b = '' THEN FALSE WHEN a = b THEN TRUE
    WHEN len(ga) = 0 OR len(gb) = 0 THEN contains(a, b) OR contains(b, a)
    ELSE len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))) >= 0.75 END AS m_name,
  CASE WHEN coalesce(qr_dob, '') = '' THEN NULL ELSE x = y OR (split_part(x, '/', 3) = split_part(y, '/', 3)
    AND split_part(x, '/', 1) = split_part(y, '/', 2) AND split_part(x, '/', 2) = split_part(y, '/', 1)) END AS m_dob,
  CASE WHEN coalesce(gender, '') = '' OR coalesce(qr_gender, '') = '' THEN NULL ELSE lower(gender) = lower(qr_gender) END AS m_gender,
  CASE WHEN coalesce(qr_pin, '') = '' THEN NULL ELSE pin = qr_pin AND length(pin) = 6 END AS m_pin,
  CASE WHEN coalesce(qr_district, '') = '' THEN NULL ELSE contains(lower(district), lower(qr_district)) OR contains(lower(qr_district), lower(district)) END AS m_district,
  CASE WHEN coalesce(state, '') = '' OR coalesce(qr_state, '') = '' THEN NULL ELSE contains(lower(trim(state)), lower(trim(qr_state))) OR contains(lower(trim(qr_state)), lower(trim(state))) END AS m_state,
  CASE WHEN length(i) = 12 AND length(j) = 12 THEN len(list_filter(range(1, 13), lambda k: substr(i, k, 1) <> substr(j, k, 1))) <= 1
    WHEN coalesce(qr_last4, '') <> '' AND length(i) = 12 THEN right(i, 4) = qr_last4
    WHEN qr_secure THEN NULL ELSE FALSE END AS m_id_number FROM g)"""
FIELD_MATCHES = f"WITH {MATCHES_CTE} SELECT c_custkey, {', '.join('m_' + k for k in _FIELDS)} FROM m"


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = view(spark, sf_dir, "customer", CUSTOMER_CARDS)
    return cards.select("c_custkey", F.round(C.name_similarity(F.col("name"), F.col("qr_name")), 6).alias("similarity"))


NAME_SIMILARITY = f"""WITH {MATCHES_CTE} SELECT c_custkey, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0
  WHEN len(ga) = 0 OR len(gb) = 0 THEN 0.5 ELSE len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))) END::DOUBLE, 6) AS similarity FROM m"""


def trust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = customer_checks(spark, sf_dir)
    trust = S.trust_score({k: F.col(f"m_{k}") for k in _FIELDS})
    alone = S.score_without_qr(*(F.col(k) for k in ("name", "dob", "gender", "id_number")))
    return checked.select("c_custkey", trust.alias("trust"), S.trust_verdict(trust).alias("verdict"), alone.alias("without_qr"))


TRUST = """20 + CASE WHEN m_name THEN 20 ELSE 0 END + CASE WHEN m_dob THEN 20 ELSE 0 END + CASE WHEN m_gender THEN 10 ELSE 0 END
  + CASE WHEN m_pin THEN 10 ELSE 0 END + CASE WHEN m_district THEN 10 ELSE 0 END + CASE WHEN m_state THEN 10 ELSE 0 END"""
WITHOUT_QR = """CAST(10 + CASE WHEN regexp_matches(id_number, '^[2-9]\\d{3}\\s\\d{4}\\s\\d{4}$') THEN 25 ELSE 0 END
    + CASE WHEN length(trim(name)) >= 5 AND regexp_matches(name, '^[A-Za-z\\s.''-]+$') THEN 15 ELSE 0 END
    + CASE WHEN regexp_matches(dob, '^\\d{2}/\\d{2}/\\d{4}$') AND CAST(left(dob, 2) AS INT) BETWEEN 1 AND 31
        AND CAST(substring(dob, 4, 2) AS INT) BETWEEN 1 AND 12 AND CAST(right(dob, 4) AS INT) BETWEEN 1900 AND 2025 THEN 10 ELSE 0 END
    + CASE WHEN coalesce(gender, '') IN ('Male', 'Female', 'Transgender') THEN 5 ELSE 0 END AS INTEGER)"""
TRUST_SCORES = f"""WITH {MATCHES_CTE}, t AS (SELECT *, CAST(least(100, {TRUST}) AS INTEGER) AS trust FROM m)
SELECT c_custkey, trust, CASE WHEN trust >= 80 THEN 'LIKELY GENUINE' WHEN trust >= 50 THEN 'REVIEW REQUIRED' ELSE 'FRAUD SUSPECTED' END AS verdict,
  {WITHOUT_QR} AS without_qr FROM t"""


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR fields with the missing ones from the QR record."""
    cards = view(spark, sf_dir, "customer", CUSTOMER_CARDS)
    qr = {k: F.col(f"qr_{k}") for k in _FIELDS} | {"district2": F.col("qr_state")}
    merged = S.backfilled({k: F.col(k) for k in _FIELDS}, qr)
    return cards.select("c_custkey", merged["gender"].alias("gender"), merged["state"].alias("state"))


BACKFILL = f"""SELECT c_custkey, CASE WHEN trim(coalesce(gender, '')) IN ('', 'None', '—') THEN
  coalesce(CASE WHEN trim(qr_gender) NOT IN ('', 'None', '—') THEN qr_gender END, gender) ELSE gender END AS gender,
  CASE WHEN trim(coalesce(state, '')) IN ('', 'None', '—') THEN coalesce(CASE WHEN trim(qr_state) NOT IN ('', 'None', '—') THEN qr_state END, state) ELSE state END AS state
FROM {cte("customer", CUSTOMER_CARDS)}"""

_SUGGESTED = {
    "c_custkey": "c_custkey",
    "old": OCR_NAME,
    "new": f"CASE c_custkey % 5 WHEN 0 THEN upper({OCR_NAME}) WHEN 1 THEN 'Zed ' || {OCR_NAME} WHEN 2 THEN 'null' WHEN 3 THEN reverse({OCR_NAME}) ELSE NULL END",
}


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "customer", _SUGGESTED)
    return s.select("c_custkey", S.accepted_suggestion(F.lit("name"), F.col("old"), F.col("new")).alias("name"))


SUGGESTIONS = f"SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN upper(old) ELSE old END AS name FROM {cte('customer', _SUGGESTED)}"

_PAYLOADS = {
    "c_custkey": "c_custkey",
    "raw": f"""CASE c_custkey % 10
 WHEN 0 THEN '<PrintLetterBarcodeData uid="' || {CUSTOMER_UID} || '" name=" ' || {OCR_NAME} || '" gender="F" dob="' || replace({DOB}, '/', '-') || '" pc="' || {PIN} || '" dist="Pune" state="Maharashtra"/>'
 WHEN 1 THEN 'x|' || right({CUSTOMER_UID}, 8) || '|' || {OCR_NAME} || '|' || {DOB} || '|2|12 Road|' || {PIN} || '|Kerala|India'
 WHEN 2 THEN '{{"name": "' || {OCR_NAME} || '", "dob": "' || {DOB} || '", "gender": "m", "UID": "' || {CUSTOMER_UID} || '", "pin": "' || {PIN} || '"}}'
 WHEN 3 THEN 'id ' || left({CUSTOMER_UID}, 4) || ' ' || substring({CUSTOMER_UID}, 5, 4) || '-' || right({CUSTOMER_UID}, 4) || ' RAM LAL ' || '01-02-1990'
 WHEN 5 THEN '{{"name": "' || {OCR_NAME} || '"}} RAM LAL 01-02-1990}}'
 WHEN 6 THEN '<a name="RAM LAL"/><b dob="01-02-1990"/>'
 WHEN 7 THEN '{{"name": "RAM LAL", "dob": "01-02-1990", "pin": "' || {PIN}
 WHEN 8 THEN '<PrintLetterBarcodeData name="RAM LAL" dob="01-02-1990" pc="' || {PIN} || '"'
 ELSE NULL END""",
    "name": OCR_NAME, "dob": DOB, "pin": PIN,
}


@F.pandas_udf(T.StringType())
def _secure_payload(name: pd.Series, dob: pd.Series, pin: pd.Series) -> pd.Series:
    """Secure payloads as an issuer makes them: the record's parts, compressed, as one decimal number."""

    def made(*known: str) -> str:
        parts = dict.fromkeys(range(20), "") | dict(zip((3, 4, 11), known)) | {0: "V2", 2: "1234" * 5, 5: "F", 7: "Pune", 8: "near the old water tank", 13: "Kerala", 19: "Y"}
        return str(int.from_bytes(zlib.compress(b"\xff".join(parts[k].encode() for k in range(20))), "big"))

    return pd.Series([made(*x) for x in zip(name, dob, pin)], dtype="object")


def qr_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = view(spark, sf_dir, "customer", _PAYLOADS)
    secure = made.where("c_custkey % 10 = 9").withColumn("raw", _secure_payload("name", "dob", "pin"))
    parsed = Q.parsed_payloads(made.where("c_custkey % 10 <> 9").unionByName(secure))
    return parsed.select("c_custkey", "format", *(F.col(f"qr.{k}").alias(k) for k in ("name", "dob", "gender", "pin", "state", "id_number", "id_last4")))


QR_PAYLOADS = f"""
WITH c AS (SELECT c_custkey, c_custkey % 10 AS k, {OCR_NAME} AS n, {DOB} AS d, {PIN} AS p, {CUSTOMER_UID} AS u FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'xml' WHEN 1 THEN 'pipe' WHEN 2 THEN 'json' WHEN 4 THEN NULL WHEN 9 THEN 'secure' ELSE 'text' END AS format,
  CASE WHEN k < 3 OR k = 9 THEN upper(n) WHEN k <> 4 THEN 'RAM LAL' END AS name, CASE WHEN k < 3 OR k = 9 THEN d WHEN k <> 4 THEN '01/02/1990' END AS dob,
  CASE k WHEN 0 THEN 'Female' WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' WHEN 9 THEN 'Female' END AS gender, CASE WHEN k < 3 OR k = 9 THEN p END AS pin,
  CASE k WHEN 0 THEN 'Maharashtra' WHEN 1 THEN 'Kerala' WHEN 9 THEN 'Kerala' END AS state,
  CASE k WHEN 0 THEN u WHEN 2 THEN u WHEN 3 THEN left(u, 4) || ' ' || substring(u, 5, 4) || ' ' || right(u, 4) END AS id_number,
  CASE WHEN k < 3 THEN right(u, 4) END AS id_last4 FROM c"""


_SPELLED = "translate(substr(md5(CAST(c_custkey - c_custkey % 4 AS VARCHAR(20))), 1, 13), '0123456789', 'ghijklmnop')"
#: Names in families of four: one letter less, another last letter, other case and a space; some are missing.
_SPELT_NAMES = {
    "c_custkey": "c_custkey",
    "name": f"CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE CASE c_custkey % 4 WHEN 0 THEN {_SPELLED} WHEN 1 THEN left({_SPELLED}, 12) "
    f"WHEN 2 THEN left({_SPELLED}, 12) || 'z' ELSE upper(left({_SPELLED}, 5)) || ' ' || substr({_SPELLED}, 6, 9) || 'y' END END",
}


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's name against all others, by bigrams."""
    return N.similar_names(view(spark, sf_dir, "customer", _SPELT_NAMES), "c_custkey", "name").select("c_custkey", "similar_names", "first_id")


SIMILAR_NAMES = f"""
WITH n AS (SELECT c_custkey, trim(upper(coalesce(name, ''))) AS x FROM {cte("customer", _SPELT_NAMES)}),
c AS (SELECT x, min(c_custkey) AS least, replace(x, ' ', '') AS p FROM n WHERE x <> '' GROUP BY x),
g AS (SELECT x, least, list_distinct(list_transform(range(1, length(p)), lambda i: substr(p, i, 2))) AS g FROM c),
b AS (SELECT a.x, b.least, len(list_intersect(a.g, b.g)) AS common, len(a.g) + len(b.g) AS size FROM g a JOIN g b ON a.x <> b.x AND list_has_any(a.g, b.g)),
s AS (SELECT x, count(*) AS n, min(least) AS first FROM b WHERE common / (size - common) >= 0.75 GROUP BY x)
SELECT c_custkey, coalesce(s.n, 0) AS similar_names, least(c.least, s.first) AS first_id
FROM n LEFT JOIN c ON c.x = n.x LEFT JOIN s ON s.x = n.x"""


def face_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding against its successor, as a card's face against a selfie."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    x = match_by_cosine(C.cosine(F.col("embedding"), F.col("other")))
    return pairs.select("vec_id", x["matched"].alias("matched"), F.round(x["score"], 0).alias("score"))


FACE_PAIRS = """
WITH p AS (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, s >= 0.28 AS matched, round(round((s + 1) / 2 * 100, 1), 0) AS score FROM p"""

QUERIES = {
    "field_matches": (field_matches, FIELD_MATCHES),
    "similar_names": (similar_names, SIMILAR_NAMES),
    "name_similarity": (name_similarity, NAME_SIMILARITY),
    "trust_scores": (trust_scores, TRUST_SCORES),
    "backfill_from_qr": (backfill, BACKFILL),
    "guarded_suggestions": (suggestions, SUGGESTIONS),
    "qr_payloads": (qr_payloads, QR_PAYLOADS),
    "face_pairs": (face_pairs, FACE_PAIRS),
}
