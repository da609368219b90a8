"""Fields of card texts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions import text as X
from docassay.operators.scoring import completeness
from docassay.plans.derive import CARD_TEXT, UID12, cte, view
from docassay.sources import read_table, spread

_CARDS = {"o_orderkey": "o_orderkey", "text": CARD_TEXT}


def card_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return spread(view(spark, sf_dir, "orders", _CARDS)).select(
        "o_orderkey",
        X.id_number(t).alias("id_number"),
        X.virtual_id(t).alias("vid"),
        X.enrolment_number(t).alias("enrolment"),
        X.mobile(t).alias("mobile"),
        X.email(t).alias("email"),
        X.year_of_birth(t).alias("year_of_birth"),
        X.issue_date(t).alias("issue_date"),
        X.card_side(t).alias("side"),
    )


_E = "nullif(regexp_extract(text, {}), '')"
CARD_IDENTIFIERS = f"""
WITH c AS {cte("orders", _CARDS)},
r AS (
  SELECT *, regexp_replace(coalesce(
      nullif(regexp_extract(text, '\\b([2-9]\\d{{3}}\\s+\\d{{4}}\\s+\\d{{4}})\\b', 1), ''),
      nullif(regexp_extract(text, '([2-9]\\d{{3}}[^0-9]{{0,3}}\\d{{4}}[^0-9]{{0,3}}\\d{{4}})', 1), ''),
      nullif(regexp_extract(text, '\\b([2-9]\\d{{11}})\\b', 1), '')), '[^0-9]', '', 'g') AS id,
    regexp_replace(coalesce(
      nullif(regexp_extract(text, '\\b([2-9]\\d{{3}}\\s+\\d{{4}}\\s+\\d{{4}}\\s+\\d{{4}})\\b', 1), ''),
      nullif(regexp_extract(text, '\\b([2-9]\\d{{15}})\\b', 1), '')), '[^0-9]', '', 'g') AS v,
    nullif(regexp_extract(text, '\\b(\\d{{4}}[/\\s]\\d{{5}}[/\\s]\\d{{5}})\\b', 1), '') AS e1,
    nullif(regexp_extract(text, '(?i)\\bEID[:\\s]*(\\d{{14}})\\b', 1), '') AS e2,
    lower(nullif(regexp_extract(text, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}\\b'), '')) AS mail,
    nullif(regexp_extract(text, '(?i)(?:Year\\s*of\\s*Birth|YOB)[:\\s]+(\\d{{4}})', 1), '') AS yob,
    regexp_matches(text, '(?i)\\b(DOB|Date\\s*of\\s*Birth)\\b') AS has_dob,
    regexp_matches(text, '(?i)\\b(District|Dist|State|PIN|Pincode)\\b') AS has_address,
    regexp_matches(text, '(?i)Government\\s*of\\s*India') AS has_header
  FROM c)
SELECT o_orderkey, left(id, 4) || ' ' || substring(id, 5, 4) || ' ' || substring(id, 9, 4) AS id_number,
  left(v, 4) || ' ' || substring(v, 5, 4) || ' ' || substring(v, 9, 4) || ' ' || substring(v, 13, 4) AS vid,
  coalesce(replace(e1, ' ', '/'), left(e2, 4) || '/' || substring(e2, 5, 5) || '/' || substring(e2, 10, 5)) AS enrolment,
  nullif(regexp_extract(text, '\\b([6-9]\\d{{9}})\\b', 1), '') AS mobile,
  CASE WHEN mail NOT IN ('help@uidai.gov.in', 'support@uidai.gov.in', 'info@uidai.gov.in') THEN mail END AS email,
  CASE WHEN CAST(yob AS INT) BETWEEN 1900 AND 2025 THEN yob END AS year_of_birth,
  nullif(regexp_extract(text, '(?i)Issue\\s*Date[:\\s]+(\\d{{1,2}}[/\\-]\\d{{1,2}}[/\\-]\\d{{4}})', 1), '') AS issue_date,
  CASE WHEN has_dob AND has_address THEN 'combined' WHEN has_dob AND has_header THEN 'front' WHEN has_address AND NOT has_dob THEN 'back' ELSE 'unknown' END AS side
FROM r"""


_HINDI = "सुनीता देवी"
#: The same texts with a last line in Devanagari: a name, a header, or none.
_WHOLE_CARDS = _CARDS | {"text": f"{CARD_TEXT} || chr(10) || CASE o_orderkey % 5 WHEN 1 THEN ' {_HINDI}' WHEN 2 THEN 'भारत सरकार' ELSE '' END"}


def card_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole record of every card text."""
    return X.with_card_record(spread(view(spark, sf_dir, "orders", _WHOLE_CARDS)), "text").drop("text")


def card_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = X.with_card_record(spread(view(spark, sf_dir, "orders", _CARDS)), "text")
    return records.select("o_orderkey", completeness({k: F.col(k) for k in ("name", "dob", "gender", "id_number")}).alias("completeness"))


def card_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, date of birth, gender and guardian of every card text."""
    records = X.with_card_record(spread(view(spark, sf_dir, "orders", _CARDS)), "text")
    return records.select("o_orderkey", "name", "dob", "gender", F.col("father_husband_name").alias("care_of"))


#: What the lines of CARD_TEXT say of a person, by how they were made; no pattern is applied again.
_PERSONS = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ANIL KUMAR SHARMA' WHEN 1 THEN 'Sunita Patel' WHEN 2 THEN 'Rakesh Nair' END AS name,
  CASE WHEN o_orderkey % 6 = 0 THEN '10/11/' || CAST(1950 + o_orderkey % 60 AS VARCHAR) WHEN o_orderkey % 6 = 3 THEN '25/12/' || CAST(1950 + o_orderkey % 60 AS VARCHAR)
    WHEN o_orderkey % 6 > 3 THEN '30/12/1988' WHEN o_orderkey % 4 = 0 THEN '01/02/2013'
    WHEN o_orderkey % 6 = 1 THEN '10/01/' || CAST(1990 + o_orderkey % 20 AS VARCHAR) END AS dob,
  CASE o_orderkey % 7 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' WHEN 3 THEN CASE WHEN o_orderkey % 6 <> 2 THEN 'Female' END END AS gender,
  CASE o_orderkey % 3 WHEN 0 THEN 'Mohan Lal' || chr(10) || 'near temple road' WHEN 1 THEN 'Ram Das' END AS care_of FROM orders"""
#: The whole record. An address is what stands from its first line to the line of a spaced number, a VID or an issue date.
CARD_RECORDS = f"""
SELECT o.o_orderkey, name, CASE o.o_orderkey % 5 WHEN 1 THEN '{_HINDI}' END AS name_hindi, dob, year_of_birth, gender, id_number, vid, enrolment AS enrollment_number,
  care_of AS father_husband_name, mobile, email,
  concat_ws(' ', CASE o.o_orderkey % 3 WHEN 0 THEN 'S/O: Mohan Lal' WHEN 1 THEN 'C/O Ram Das, House No: 12/B' ELSE 'Village: Rampur' END,
    'near temple road, District: Thane, Maharashtra ' || pin,
    CASE o.o_orderkey % 4 WHEN 1 THEN u WHEN 2 THEN left(u, 4) || '-' || substring(u, 5, 4) || '. ' || right(u, 4) WHEN 3 THEN 'none' END,
    CASE WHEN o.o_orderkey % 4 <> 0 THEN CASE o.o_orderkey % 5 WHEN 1 THEN 'EID: 12341234512345' WHEN 2 THEN '1234/12345/54321' END END,
    CASE WHEN o.o_orderkey % 4 <> 0 AND o.o_orderkey % 5 <> 0 THEN
      CASE o.o_orderkey % 3 WHEN 0 THEN '9' || right(u, 9) WHEN 1 THEN 'User.' || CAST(o_custkey AS VARCHAR) || '@Example.COM' ELSE 'help@uidai.gov.in' END END) AS address_raw,
  CASE o.o_orderkey % 3 WHEN 1 THEN 'Ram Das' END AS address_house, NULL::VARCHAR AS address_street, 'temple road, District' AS address_landmark,
  CASE o.o_orderkey % 3 WHEN 2 THEN 'Rampur near temple road' END AS address_locality, NULL::VARCHAR AS address_subdistrict, 'Thane' AS address_district,
  'Maharashtra' AS address_state, pin AS address_pin, issue_date, side AS card_type, '{X.ISSUED_BY}' AS issued_by
FROM (SELECT o_orderkey, o_custkey, {UID12} AS u, CAST(100000 + o_custkey * 613 % 900000 AS VARCHAR) AS pin FROM orders) o
JOIN ({_PERSONS}) p ON p.o_orderkey = o.o_orderkey JOIN ({CARD_IDENTIFIERS}) i ON i.o_orderkey = o.o_orderkey"""
CARD_COMPLETENESS = f"""
SELECT o_orderkey, round(((name IS NOT NULL)::INT * 2 + (dob IS NOT NULL)::INT + (gender IS NOT NULL)::INT + (id_number IS NOT NULL)::INT * 3) / 11.0::DOUBLE, 3) AS completeness
FROM ({_PERSONS}) JOIN ({CARD_IDENTIFIERS}) USING (o_orderkey)"""


def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", X.email(F.col("text")).alias("email")).where("email IS NOT NULL")


DOCUMENT_EMAILS = """
SELECT * FROM (SELECT doc_id, lower(nullif(regexp_extract(text, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b'), '')) AS email FROM documents)
WHERE email NOT IN ('help@uidai.gov.in', 'support@uidai.gov.in', 'info@uidai.gov.in')"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned lines of every document and how many of them are distinct."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    unique = X.unique_lines(F.col("text"))
    return docs.select("doc_id", F.size(X.lines(F.col("text"))).alias("n_lines"), F.size(unique).alias("n_unique"))


DOCUMENT_LINES = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM l)
SELECT doc_id, CAST(len(ls) AS INTEGER) AS n_lines, CAST(len(list_distinct(list_filter(list_transform(ls, lambda x:
  trim(regexp_replace(regexp_replace(x, '^[\\s|''`~.\\-_\\\\/(]+', ''), '[\\s|''`~.\\-_\\\\/)]+$', ''))), lambda x: x <> ''))) AS INTEGER) AS n_unique FROM k"""


def regrouped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misread digits of the order ids as OCR would spell them, put right and grouped."""
    spoiled = "translate(" + UID12 + ", '0156', 'OISG')"
    o = view(spark, sf_dir, "orders", {"o_orderkey": "o_orderkey", "spoiled": spoiled})
    return o.select("o_orderkey", X.regrouped_id(F.col("spoiled")).alias("id_number"))


REGROUPED_IDS = f"""SELECT o_orderkey, left(u, 4) || ' ' || substring(u, 5, 4) || ' ' || right(u, 4) AS id_number
FROM (SELECT o_orderkey, {UID12} AS u FROM orders)"""

_WORDS = {
    "p_partkey": "p_partkey",
    "word": "CASE p_partkey % 8 WHEN 0 THEN 'GHANSHVAN' WHEN 1 THEN 'jetharan' WHEN 2 THEN '5HARMA' WHEN 3 THEN 'KUMAWAT RAN' WHEN 4 THEN ' Lal ' WHEN 5 THEN 'DEVAN $INGH' WHEN 6 THEN '' ELSE 'KARN' END",
}


def corrected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part", _WORDS).select("p_partkey", X.corrected_name(F.col("word")).alias("name"))


CORRECTED_NAMES = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'GHANSHYAM' WHEN 1 THEN 'jetharan' WHEN 2 THEN 'SHARMA'
WHEN 3 THEN 'KUMAVAT RAM' WHEN 4 THEN 'LAL' WHEN 5 THEN 'DEVAM SINGH' WHEN 6 THEN '' ELSE 'KARM' END AS name FROM part"""

QUERIES = {
    "card_identifiers": (card_identifiers, CARD_IDENTIFIERS),
    "card_records": (card_records, CARD_RECORDS),
    "card_persons": (card_persons, _PERSONS),
    "card_completeness": (card_completeness, CARD_COMPLETENESS),
    "document_emails": (document_emails, DOCUMENT_EMAILS),
    "document_lines": (document_lines, DOCUMENT_LINES),
    "regrouped_ids": (regrouped_ids, REGROUPED_IDS),
    "corrected_names": (corrected_names, CORRECTED_NAMES),
}
