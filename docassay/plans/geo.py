"""Check digits, PINs, districts and names of persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions import checksum, geo, text
from docassay.functions.reference_data import (
    NAME_PARTS,
    NAME_SEQUENCES,
    PIN_PREFIXES,
    PIN_RANGES,
    STATE_ALIASES,
)
from docassay.operators.districts import state_of_district
from docassay.operators.ranges import first_of_ranges
from docassay.plans.derive import LAST, OCR_NAME, PIN, STATE, UID12, cte, view


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows)


def id_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = view(spark, sf_dir, "orders", {"o_orderkey": "o_orderkey", "uid12": UID12})
    return u.select(
        "o_orderkey",
        checksum.is_valid(F.col("uid12")).alias("valid"),
        checksum.score(F.col("uid12")).cast("int").alias("score"),
        text.masked(F.col("uid12")).alias("masked"),
    )


_D = "".join(map(str, checksum.product_table()))
_P = "".join(str(d) for p in checksum.permutations() for d in p)
def checksum_sql(numbers: str) -> str:
    """Check values of a subquery (o_orderkey, uid12)."""
    return f"""
WITH c AS (
  SELECT o_orderkey, uid12, list_reduce(list_prepend(0::BIGINT, range(0, 12)), lambda c, i:
    CAST(substr('{_D}', c * 10 + CAST(substr('{_P}', (i % 8) * 10 + CAST(substr(uid12, 12 - i, 1) AS BIGINT) + 1, 1) AS BIGINT) + 1, 1) AS BIGINT)) AS v
  FROM {numbers})
SELECT o_orderkey, v = 0 AS valid, CAST(CASE WHEN v = 0 THEN 100 ELSE 0 END AS INTEGER) AS score,
       'XXXX XXXX ' || right(uid12, 4) AS masked FROM c"""


ID_CHECKSUM = checksum_sql(cte("orders", {"o_orderkey": "o_orderkey", "uid12": UID12}))


def pin_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "customer", {"c_custkey": "c_custkey", "pin": PIN, "state": STATE})
    # expected state, match and score build on each other: each is a column first
    checked = geo.with_state_of_pin(c, "pin", "expected_state").withColumn(
        "matched", geo.same_state(F.col("expected_state"), F.col("state"))
    )
    return checked.select("c_custkey", "pin", "expected_state", "matched", geo.three_way_score(F.col("matched"), 60).cast("int").alias("score"))


_ALIASES = _rows(STATE_ALIASES.items())
PIN_STATE = f"""
WITH c AS {cte("customer", {"c_custkey": "c_custkey", "pin": PIN, "state": STATE})},
ranges(ord, lo, hi, state) AS (VALUES {_rows((k, *r) for k, r in enumerate(PIN_RANGES))}),
prefixes(prefix, state) AS (VALUES {_rows(PIN_PREFIXES.items())}),
aliases(alias, state) AS (VALUES {_ALIASES}),
by_range AS (SELECT c_custkey, min_by(r.state, ord) AS state FROM c JOIN ranges r ON CAST(pin AS INT) BETWEEN lo AND hi GROUP BY c_custkey),
e AS (
  SELECT c.c_custkey, c.pin, c.state AS stated, coalesce(a.state, trim(c.state)) AS canonical,
    CASE WHEN b.state IS NOT NULL AND CAST(pin AS INT) BETWEEN 403001 AND 403812 THEN 'Goa'
         WHEN b.state IS NOT NULL AND CAST(pin AS INT) BETWEEN 500001 AND 509412 THEN 'Telangana'
         ELSE coalesce(b.state, p.state) END AS expected_state
  FROM c LEFT JOIN by_range b USING (c_custkey) LEFT JOIN prefixes p ON p.prefix = left(c.pin, 2)
  LEFT JOIN aliases a ON a.alias = lower(trim(c.state))
), m AS (
  SELECT *, CASE WHEN stated IS NULL OR expected_state IS NULL THEN NULL ELSE
    contains(lower(expected_state), lower(canonical)) OR contains(lower(canonical), lower(expected_state)) END AS matched FROM e)
SELECT c_custkey, pin, expected_state, matched,
  CAST(CASE WHEN matched THEN 100 WHEN NOT matched THEN 0 ELSE 60 END AS INTEGER) AS score FROM m"""

_DISTRICTS = {"ord": "n_nationkey", "district": "'dist ' || CAST(n_nationkey AS VARCHAR(4))", "state": "'State ' || CAST(n_regionkey AS VARCHAR(4))"}
_CLAIMS = {
    "c_custkey": "c_custkey",
    "district": "CASE c_custkey % 4 WHEN 0 THEN 'Dist ' || CAST(c_nationkey AS VARCHAR(4)) WHEN 1 THEN 'dist ' || CAST(c_nationkey AS VARCHAR(4)) || ' District' WHEN 2 THEN 'ist' ELSE 'nowhere' END",
    "state": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'state ' || CAST(c_nationkey % 5 AS VARCHAR(4)) END",
}


def district_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    districts = view(spark, sf_dir, "nation", _DISTRICTS)
    claims = view(spark, sf_dir, "customer", _CLAIMS)
    found = state_of_district(claims, districts)
    checked = found.withColumn("matched", geo.same_state(F.col("expected_state"), F.col("state")))
    return checked.select("c_custkey", "expected_state", "matched", geo.three_way_score(F.col("matched"), 70).cast("int").alias("score"))


def _district_sql(table: str, districts: dict[str, str], claims: dict[str, str]) -> str:
    """By a loop over all names."""
    return f"""
WITH d AS {cte(table, districts)}, c AS {cte("customer", claims)},
e AS (
  SELECT c.c_custkey, c.state, coalesce(any_value(x.state), min_by(p.state, p.ord)) AS expected_state
  FROM c LEFT JOIN d x ON x.district = lower(trim(c.district))
  LEFT JOIN d p ON contains(lower(trim(c.district)), p.district) OR contains(p.district, lower(trim(c.district)))
  GROUP BY c.c_custkey, c.state
), m AS (
  SELECT *, CASE WHEN state IS NULL OR expected_state IS NULL THEN NULL ELSE
    contains(lower(expected_state), lower(trim(state))) OR contains(lower(trim(state)), lower(expected_state)) END AS matched FROM e)
SELECT c_custkey, expected_state, matched, CAST(CASE WHEN matched THEN 100 WHEN NOT matched THEN 0 ELSE 70 END AS INTEGER) AS score FROM m"""


DISTRICT_STATE = _district_sql("nation", _DISTRICTS, _CLAIMS)

#: A name for every order, and claims that hold one, are a part of one (also of two letters), equal one, or nothing.
_NAME_OF = "substr(md5(CAST({0} AS VARCHAR(20))), 1, 7)"
_MANY_DISTRICTS = {"ord": "(o_orderkey * 7919) % 1000003", "district": _NAME_OF.format("o_orderkey"), "state": "'State ' || CAST(o_custkey % 9 AS VARCHAR(4))"}
_OTHER = _NAME_OF.format("c_custkey * 4")
_PART_CLAIMS = {
    "c_custkey": "c_custkey",
    "district": f"CASE c_custkey % 5 WHEN 0 THEN ' ' || upper(substr({_OTHER}, 2, 5)) WHEN 1 THEN 'Zila ' || {_OTHER} || ' x' WHEN 2 THEN {_OTHER} WHEN 3 THEN substr({_OTHER}, 3, 2) ELSE NULL END",
    "state": "'state ' || CAST(c_nationkey % 9 AS VARCHAR(4))",
}


def district_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims against as many district names as there are orders."""
    found = state_of_district(view(spark, sf_dir, "customer", _PART_CLAIMS), view(spark, sf_dir, "orders", _MANY_DISTRICTS))
    checked = found.withColumn("matched", geo.same_state(F.col("expected_state"), F.col("state")))
    return checked.select("c_custkey", "expected_state", "matched", geo.three_way_score(F.col("matched"), 70).cast("int").alias("score"))


DISTRICT_PARTS = _district_sql("orders", _MANY_DISTRICTS, _PART_CLAIMS)

#: Overlapping ranges of PINs, one for every order.
_PIN_SPANS = {
    "ord": "(o_orderkey * 104729) % 1000003", "low": "100000 + (o_orderkey * 7919) % 900000",
    "high": "100000 + (o_orderkey * 7919) % 900000 + (o_custkey * 31) % 3000 - 5", "value": "'R' || CAST(o_custkey % 97 AS VARCHAR(4))",
}


def pin_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first range in order that holds each customer's PIN."""
    found = first_of_ranges(view(spark, sf_dir, "customer", {"c_custkey": "c_custkey", "pin": PIN}), view(spark, sf_dir, "orders", _PIN_SPANS), "pin", "region")
    return found.select("c_custkey", "region")


PIN_SPANS = f"""
SELECT c_custkey, min_by(value, ord) AS region FROM {cte("customer", {"c_custkey": "c_custkey", "pin": PIN})} c
LEFT JOIN {cte("orders", _PIN_SPANS)} r ON CAST(pin AS BIGINT) BETWEEN low AND high GROUP BY 1"""

_PERSONS = {
    "c_custkey": "c_custkey",
    "person": f"CASE c_custkey % 10 WHEN 0 THEN {LAST} WHEN 1 THEN 'TEST ' || {LAST} WHEN 2 THEN 'AAAA ' || {LAST} WHEN 3 THEN 'same same' "
    f"WHEN 4 THEN 'x1 y2' WHEN 5 THEN NULL WHEN 6 THEN 'a b c d e f' WHEN 7 THEN 'Brrst Krst' WHEN 8 THEN 'Aia Oue' ELSE {OCR_NAME} END",
}


def name_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geo.with_name_plausibility(view(spark, sf_dir, "customer", _PERSONS), "person", "x")
    return p.select("c_custkey", "x.score", "x.passed")


def name_plausibility_sql(persons: str) -> str:
    """Scores of a subquery (c_custkey, person)."""
    return f"""
WITH p AS (SELECT c_custkey, upper(trim(coalesce(person, ''))) AS n FROM {persons}),
w AS (SELECT *, list_filter(string_split(n, ' '), lambda x: x <> '') AS words FROM p),
f AS (
  SELECT *, len(list_filter(words, lambda x: length(x) >= 3 AND len(list_distinct(string_split(x, ''))) = 1)) AS rep,
    len(words) > 1 AND len(list_distinct(words)) = 1 AS ident,
    len(list_filter({list(NAME_SEQUENCES)}, lambda s: contains(n, s))) AS seqs,
    len(list_filter({list(NAME_PARTS)}, lambda s: contains(lower(n), s))) AS parts,
    length(regexp_replace(n, '[^AEIOU]', '', 'g')) / greatest(length(replace(n, ' ', '')), 1) AS ratio FROM w),
s AS (
  SELECT *, greatest(0, least(100, 60 - 30 * rep - CASE WHEN ident THEN 40 ELSE 0 END - 35 * seqs
    + CASE WHEN parts > 0 THEN least(25, 10 * parts) ELSE -5 END - CASE WHEN ratio < 0.15 THEN 15 WHEN ratio > 0.65 THEN 10 ELSE 0 END)) AS whole,
    n <> '' AND regexp_matches(n, '^[A-Z\\s.''-]+$') AS clean FROM f)
SELECT c_custkey, CAST(CASE WHEN n = '' THEN 0 WHEN NOT clean THEN 20 WHEN len(words) < 2 THEN 30 WHEN len(words) > 5 THEN 40 ELSE whole END AS INTEGER) AS score,
  clean AND len(words) BETWEEN 2 AND 5 AND whole >= 45 AND rep = 0 AND NOT ident AND seqs = 0 AS passed FROM s"""


NAME_PLAUSIBILITY = name_plausibility_sql(cte("customer", _PERSONS))


def states_of_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per canonical stated state, with null for none."""
    c = view(spark, sf_dir, "customer", {"state": STATE})
    return c.groupBy(geo.canonical_state(F.col("state")).alias("state")).agg(F.count("*").alias("n"))


STATES = f"""WITH aliases(alias, state) AS (VALUES {_ALIASES})
SELECT coalesce(a.state, trim(c.state)) AS state, count(*) AS n FROM {cte("customer", {"state": STATE})} c
LEFT JOIN aliases a ON a.alias = lower(trim(c.state)) GROUP BY 1"""

QUERIES = {
    "id_checksum": (id_checksum, ID_CHECKSUM),
    "pin_state": (pin_state, PIN_STATE),
    "district_state": (district_state, DISTRICT_STATE),
    "district_parts": (district_parts, DISTRICT_PARTS),
    "pin_spans": (pin_spans, PIN_SPANS),
    "name_plausibility": (name_plausibility, NAME_PLAUSIBILITY),
    "canonical_states": (states_of_addresses, STATES),
}
