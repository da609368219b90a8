"""Inputs derived from the given tables by SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docassay.sources import read_table

UID12 = "CAST(200000000000 + (o_orderkey * 104729 + 31337) % 800000000000 AS VARCHAR(12))"
PIN = "CAST(100000 + (c_custkey * 7919) % 900000 AS VARCHAR(6))"
STATE = (
    "CASE c_nationkey % 8 WHEN 0 THEN 'mp' WHEN 1 THEN 'Karnataka' WHEN 2 THEN ' tn ' WHEN 3 THEN 'Goa' "
    "WHEN 4 THEN 'UP' WHEN 5 THEN 'Telangana' WHEN 6 THEN 'Atlantis' ELSE NULL END"
)
#: Names as an OCR engine and a QR payload would have them, for customers.
FIRST = "CASE c_custkey % 5 WHEN 0 THEN 'Anil' WHEN 1 THEN 'Sunita' WHEN 2 THEN 'Rakesh' WHEN 3 THEN 'Meena' ELSE 'Joseph' END"
LAST = "CASE (c_custkey * 7) % 6 WHEN 0 THEN 'Sharma' WHEN 1 THEN 'Patel' WHEN 2 THEN 'Reddy' WHEN 3 THEN 'Nair' WHEN 4 THEN 'Khan' ELSE 'Dsouza' END"
OCR_NAME = f"{FIRST} || ' ' || {LAST}"
QR_NAME = (
    f"CASE c_custkey % 7 WHEN 0 THEN upper({FIRST} || '  ' || {LAST}) WHEN 1 THEN {FIRST} || ' Kumar ' || {LAST} "
    f"WHEN 2 THEN {FIRST} || 's ' || {LAST} WHEN 3 THEN 'X' WHEN 4 THEN '' WHEN 5 THEN {LAST} ELSE {OCR_NAME} END"
)
DOB = (
    "CAST(10 + c_custkey % 18 AS VARCHAR(4)) || '/0' || CAST(1 + c_nationkey % 9 AS VARCHAR(4)) || '/' || "
    "CAST(1950 + c_custkey % 60 AS VARCHAR(4))"
)
QR_DOB = (
    f"CASE c_custkey % 4 WHEN 0 THEN replace({DOB}, '/', '-') WHEN 1 THEN '0' || CAST(1 + c_nationkey % 9 AS VARCHAR(4)) || '.' || "
    "CAST(10 + c_custkey % 18 AS VARCHAR(4)) || '.' || CAST(1950 + c_custkey % 60 AS VARCHAR(4)) "
    f"WHEN 2 THEN '01/01/1990' ELSE {DOB} END"
)
GENDER = "CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE NULL END"
QR_GENDER = "CASE c_custkey % 6 WHEN 0 THEN 'MALE' WHEN 1 THEN 'female' WHEN 3 THEN 'Female' WHEN 4 THEN '' ELSE 'Transgender' END"
QR_PIN = f"CASE c_custkey % 5 WHEN 0 THEN '100000' WHEN 1 THEN NULL ELSE {PIN} END"
DISTRICT = "'district ' || CAST(c_nationkey AS VARCHAR(4))"
QR_DISTRICT = "CASE c_custkey % 4 WHEN 0 THEN 'DISTRICT ' || CAST(c_nationkey AS VARCHAR(4)) WHEN 1 THEN '' WHEN 2 THEN 'district' ELSE 'elsewhere' END"
QR_STATE = "CASE c_nationkey % 8 WHEN 1 THEN 'karnataka' WHEN 3 THEN 'Goa State' WHEN 4 THEN 'Bihar' ELSE 'Telangana' END"
CUSTOMER_UID = "CAST(200000000000 + (c_custkey * 104729 + 31337) % 800000000000 AS VARCHAR(12))"
QR_UID = f"CASE c_custkey % 4 WHEN 0 THEN {CUSTOMER_UID} WHEN 1 THEN left({CUSTOMER_UID}, 11) || '0' WHEN 2 THEN reverse({CUSTOMER_UID}) ELSE NULL END"
QR_LAST4 = f"CASE c_custkey % 8 WHEN 3 THEN right({CUSTOMER_UID}, 4) ELSE NULL END"

#: One OCR and one QR record of every customer.
CUSTOMER_CARDS = {
    "c_custkey": "c_custkey", "name": OCR_NAME, "dob": DOB, "gender": GENDER, "id_number": CUSTOMER_UID, "pin": PIN,
    "district": DISTRICT, "state": STATE, "qr_name": QR_NAME, "qr_dob": QR_DOB, "qr_gender": QR_GENDER, "qr_pin": QR_PIN,
    "qr_district": QR_DISTRICT, "qr_state": QR_STATE, "qr_id_number": QR_UID, "qr_last4": QR_LAST4,
    "qr_secure": "c_custkey % 8 = 7",
}

_NL = "chr(10)"
#: Text of a card for every order, with readings that OCR would spoil.
CARD_TEXT = f"""concat_ws({_NL},
  CASE o_orderkey % 5 WHEN 0 THEN 'xx' ELSE '|Government of India' END,
  CASE o_orderkey % 4 WHEN 0 THEN '~ ANIL KUMAR SHARMA' WHEN 1 THEN 'Name: Sunita Patel' WHEN 2 THEN 'Rakesh Nair.' ELSE 'ee 12' END,
  CASE o_orderkey % 6 WHEN 0 THEN 'DOB: 10/11/' || CAST(1950 + o_orderkey % 60 AS VARCHAR(4)) WHEN 1 THEN 'DOR 10 1' || CAST(1990 + o_orderkey % 20 AS VARCHAR(4))
    WHEN 2 THEN 'Year of Birth: ' || CAST(1890 + o_orderkey % 100 AS VARCHAR(4)) WHEN 3 THEN 'D0B 25-12-' || CAST(1950 + o_orderkey % 60 AS VARCHAR(4)) ELSE 'DOB 12/30/1988' END,
  CASE o_orderkey % 7 WHEN 0 THEN 'MALE' WHEN 1 THEN 'Femle' WHEN 2 THEN 'Miso' WHEN 3 THEN 'Fxx' ELSE '---' END,
  CASE o_orderkey % 3 WHEN 0 THEN 'S/O: Mohan Lal' WHEN 1 THEN 'C/O Ram Das, House No: 12/B' ELSE 'Village: Rampur' END,
  'near temple road, District: Thane, Maharashtra ' || CAST(100000 + o_custkey * 613 % 900000 AS VARCHAR(6)),
  CASE o_orderkey % 4 WHEN 0 THEN left({UID12}, 4) || ' ' || substring({UID12}, 5, 4) || ' ' || right({UID12}, 4) WHEN 1 THEN {UID12}
    WHEN 2 THEN left({UID12}, 4) || '-' || substring({UID12}, 5, 4) || '. ' || right({UID12}, 4) ELSE 'none' END,
  CASE o_orderkey % 5 WHEN 0 THEN 'VID 9' || left({UID12}, 3) || ' 1234 ' || right({UID12}, 4) || ' 0007' WHEN 1 THEN 'EID: 12341234512345' WHEN 2 THEN '1234/12345/54321' ELSE '' END,
  CASE o_orderkey % 3 WHEN 0 THEN '9' || right({UID12}, 9) WHEN 1 THEN 'User.' || CAST(o_custkey AS VARCHAR(9)) || '@Example.COM' ELSE 'help@uidai.gov.in' END,
  CASE o_orderkey % 4 WHEN 0 THEN 'Issue Date: 1/2/2013' ELSE '' END)"""


def view(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    """`table` with the SQL expressions in `columns`, by name."""
    return read_table(spark, sf_dir, table).selectExpr(*(f"{sql} AS `{name}`" for name, sql in columns.items()))


def cte(table: str, columns: dict[str, str]) -> str:
    """The same as a DuckDB subquery."""
    return "(SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {table})"
