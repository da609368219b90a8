"""op4: Merkle fingerprints of all documents, of their edited texts, and their likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm.merkle import compare_with_next, edited_branches, likeness
from docassay.sources import read_table

NAME = "op4_merkle_fingerprint"
_FINGERPRINT = """
SELECT doc_id, concat_ws('|', sha256(array_to_string(s, '')),
         array_to_string(list_transform(s, lambda d: d[1:8]), ''),
         array_to_string(list_transform(p, lambda x: array_to_string(list_transform(x, lambda d: d[1:8]), '')), '/'),
         array_to_string(list_transform(l, lambda x: array_to_string(list_transform(x, lambda y:
           array_to_string(list_transform(y, lambda d: d[1:8]), '')), '.')), '/')) AS fp
FROM (SELECT *, list_transform(p, lambda x: md5(array_to_string(x, ''))) AS s
 FROM (SELECT *, list_transform(l, lambda x: list_transform(x, lambda y: md5(array_to_string(y, '')))) AS p
  FROM (SELECT doc_id, list_transform(string_split({text}, chr(10) || chr(10)), lambda x:
          list_transform(string_split(x, chr(10)), lambda y:
            list_transform(regexp_extract_all(y, '(?s).{{1,48}}'), lambda z: md5(z)))) AS l
    FROM base)))
"""
_LIKE = """
CASE WHEN split_part({a}, '|', 1) = split_part({b}, '|', 1) THEN 1.0::DOUBLE ELSE
  coalesce(2.0::DOUBLE * len(list_intersect(list_distinct({la}), list_distinct({lb})))
    / nullif(len(list_distinct({la})) + len(list_distinct({lb})), 0), 0) END
"""


def _like(a: str, b: str) -> str:
    leaves = "regexp_extract_all(split_part({}, '|', 4), '[0-9a-f]{{8}}')"
    return _LIKE.format(a=a, b=b, la=leaves.format(a), lb=leaves.format(b))


#: Positions "section/paragraph" whose digests differ between own.fp and edit.fp.
_BRANCHES = """
CASE WHEN split_part(own.fp, '|', 1) = split_part(edit.fp, '|', 1) THEN [] ELSE flatten(list_transform(
  range(1, greatest(len(string_split(split_part(own.fp, '|', 3), '/')), len(string_split(split_part(edit.fp, '|', 3), '/'))) + 1),
  lambda k: CASE WHEN string_split(split_part(own.fp, '|', 3), '/')[k] IS NOT DISTINCT FROM string_split(split_part(edit.fp, '|', 3), '/')[k] THEN []
    ELSE list_transform(list_filter(
      range(1, greatest(length(coalesce(string_split(split_part(own.fp, '|', 3), '/')[k], '')), length(coalesce(string_split(split_part(edit.fp, '|', 3), '/')[k], ''))) // 8 + 1),
      lambda n: nullif(substring(coalesce(string_split(split_part(own.fp, '|', 3), '/')[k], ''), n * 8 - 7, 8), '')
        IS DISTINCT FROM nullif(substring(coalesce(string_split(split_part(edit.fp, '|', 3), '/')[k], ''), n * 8 - 7, 8), '')),
      lambda n: CAST(k - 1 AS VARCHAR) || '/' || CAST(n - 1 AS VARCHAR)) END)) END
"""
SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (
  SELECT doc_id, text, length(text) AS n,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
         coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM texts WINDOW w AS (ORDER BY doc_id)
), base AS (
  SELECT *, left(text, n - n // 4) || left(next_text, n // 4) AS edited FROM following
), own AS ({_FINGERPRINT.format(text="text")}), edit AS ({_FINGERPRINT.format(text="edited")})
SELECT base.doc_id, base.n AS n_chars, sha256(edited) AS edited_sha256, own.fp AS fingerprint,
       edit.fp AS edited_fingerprint, {_like("own.fp", "edit.fp")} AS near_edited,
       {_like("own.fp", "nx.fp")} AS near_next, CAST(len({_BRANCHES}) AS INTEGER) AS n_branches, ({_BRANCHES})[1] AS first_branch
FROM base JOIN own ON own.doc_id = base.doc_id JOIN edit ON edit.doc_id = base.doc_id
JOIN own nx ON nx.doc_id = base.next_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_with_next(read_table(spark, sf_dir, "documents")).withColumn("at", edited_branches("fingerprint", "edited_fingerprint"))
    first = F.get("at", 0)
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
        F.size("at").alias("n_branches"),
        F.when(first.isNotNull(), F.concat_ws("/", first["section"].cast("string"), first["paragraph"].cast("string"))).alias("first_branch"),
    )
