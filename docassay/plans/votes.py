"""Majority votes: lines of an order stand for the OCR passes of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.operators import voting as V
from docassay.plans.derive import cte, view

_LINES = {
    "l_orderkey": "l_orderkey",
    "ordinal": "CAST(l_linenumber AS BIGINT) * 1000000000000 + CAST(l_partkey AS BIGINT) * 100000 + CAST(l_suppkey AS BIGINT)",
    "d": "CAST(day(l_shipdate) AS INT)", "m": "CAST(month(l_shipdate) AS INT)", "y": "CAST(year(l_shipdate) AS INT)",
    "reading": "CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag || l_linestatus ELSE l_returnflag || CAST(l_linenumber AS VARCHAR(4)) || l_linestatus END",
}


def date_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vote_components(view(spark, sf_dir, "lineitem", _LINES), "l_orderkey", ["d", "m", "y"], "ordinal")


_VOTE = "(SELECT l_orderkey, arg_max({0}, (n, -first)) AS {0} FROM (SELECT l_orderkey, {0}, count(*) AS n, min(ordinal) AS first FROM l GROUP BY 1, 2) GROUP BY 1)"
DATE_VOTE = f"""WITH l AS {cte("lineitem", _LINES)}
SELECT l_orderkey, d, m, y FROM {_VOTE.format("d")} JOIN {_VOTE.format("m")} USING (l_orderkey) JOIN {_VOTE.format("y")} USING (l_orderkey)"""


def string_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vote_string(view(spark, sf_dir, "lineitem", _LINES), "l_orderkey", "reading", "ordinal")


STRING_VOTE = f"""
WITH l AS {cte("lineitem", _LINES)},
w AS (SELECT l_orderkey, reading, count(*) AS n, min(ordinal) AS first FROM l GROUP BY 1, 2),
s AS (SELECT l_orderkey, arg_max(reading, (n, -first)) AS modal, max(n) AS most, length(arg_min(reading, first)) AS len,
        arg_max(reading, (length(reading), -first)) AS longest FROM w GROUP BY 1),
p AS (SELECT l.l_orderkey, k, substr(reading, k, 1) AS letter, count(*) AS n, min(ordinal) AS first
      FROM l JOIN s USING (l_orderkey), unnest(range(1, s.len + 1)) t(k) WHERE length(reading) = s.len GROUP BY 1, 2, 3),
b AS (SELECT l_orderkey, k, arg_max(letter, (n, -first)) AS letter FROM p GROUP BY 1, 2),
v AS (SELECT l_orderkey, string_agg(letter, '' ORDER BY k) AS spelled FROM b GROUP BY 1),
c AS (SELECT l.l_orderkey, count(*) AS voters FROM l JOIN s USING (l_orderkey) WHERE length(reading) = s.len GROUP BY 1)
SELECT l_orderkey, CASE WHEN most > 1 THEN modal WHEN voters >= 2 THEN spelled ELSE longest END AS winner
FROM s JOIN v USING (l_orderkey) JOIN c USING (l_orderkey)"""

#: Texts of OCR passes; every line has a number of its own.
PASSES = {
    "doc_id": "l_orderkey",
    "pass_no": _LINES["ordinal"],
    "text": "CASE l_linenumber % 3 WHEN 0 THEN 'DOB: ' || CAST(day(l_shipdate) AS VARCHAR(4)) || '/' || CAST(month(l_shipdate) AS VARCHAR(4)) || '/1988' "
    "WHEN 1 THEN 'DOR 10 1' || CAST(1980 + month(l_shipdate) AS VARCHAR(4)) ELSE 'nothing' END",
}


def readings_sql(table: str) -> str:
    """The date that each pass's text stands for, as it was made."""
    return f"""SELECT l_orderkey AS doc_id, {_LINES["ordinal"]} AS pass_no,
  CASE l_linenumber % 3 WHEN 0 THEN day(l_shipdate) ELSE 10 END AS d, CASE l_linenumber % 3 WHEN 0 THEN month(l_shipdate) ELSE 1 END AS m,
  CASE l_linenumber % 3 WHEN 0 THEN 1988 ELSE 1980 + month(l_shipdate) END AS y FROM {table} WHERE l_linenumber % 3 < 2"""


def date_of_birth_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates read out of every pass, then voted on."""
    return V.date_votes(view(spark, sf_dir, "lineitem", PASSES))


_PART = "(SELECT doc_id, arg_max({0}, (n, -first)) AS {0} FROM (SELECT doc_id, {0}, count(*) AS n, min(pass_no) AS first FROM r GROUP BY 1, 2) GROUP BY 1)"
DATE_OF_BIRTH_VOTE = f"""WITH r AS ({readings_sql("lineitem")})
SELECT doc_id, format('{{:02d}}/{{:02d}}/{{:d}}', d, m, y) AS dob FROM {_PART.format("d")} JOIN {_PART.format("m")} USING (doc_id) JOIN {_PART.format("y")} USING (doc_id)"""


def pass_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters over all passes of a document and whether they are too few, so that another engine is asked."""
    passes = view(spark, sf_dir, "lineitem", PASSES)
    chars = F.sum(F.length(F.trim(F.replace("text", F.lit("\n"), F.lit("")))))
    return passes.groupBy("doc_id").agg(chars.alias("chars"), (chars < 80).alias("ask_again"))


PASS_LENGTHS = f"SELECT doc_id, CAST(sum(length(trim(text))) AS BIGINT) AS chars, sum(length(trim(text))) < 80 AS ask_again FROM {cte('lineitem', PASSES)} GROUP BY 1"

QUERIES = {
    "date_vote": (date_vote, DATE_VOTE),
    "string_vote": (string_vote, STRING_VOTE),
    "date_of_birth_vote": (date_of_birth_vote, DATE_OF_BIRTH_VOTE),
    "pass_lengths": (pass_lengths, PASS_LENGTHS),
}
