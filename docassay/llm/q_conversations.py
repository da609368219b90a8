"""op11: damaged conversations and their cheapest repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm.conversations import repaired_digests
from docassay.sources import read_table

NAME = "op11_conversation_repair"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

_STATES = {"n": "u", "o": "u", "q": "a", "r": "u"}  # nothing, opened, asked, answered: who speaks next
_NEXT = {"n": "q", "o": "q", "q": "r", "r": "q"}


def _least(state: str, best: str) -> str:
    """SQL: the least of what stands in `best` for the state and one or two insertions before it."""
    one, two = _NEXT[state], _NEXT[_NEXT[state]]
    put = lambda text, times: f"lpad((left({text}, 8)::INT + {2 * times})::VARCHAR, 8, '0') || '{'I' * times}' || substr({text}, 9)"
    return f"least({best}.{state}, {put(f'{best}.{one}', 1)}, {put(f'{best}.{two}', 2)})"


def _edits(state: str) -> str:
    """SQL: the least of the edits of row d before the state; r has what comes after it."""
    put = lambda to, letter, cost: f"lpad((left(r.{to}, 8)::INT + {cost})::VARCHAR, 8, '0') || '{letter}' || substr(r.{to}, 9)"
    keep = {"n": "CASE d.i WHEN 's' THEN {s} WHEN 'u' THEN {u} END", "o": "CASE d.i WHEN 'u' THEN {u} END", "q": "CASE d.i WHEN 'a' THEN {a} END", "r": "CASE d.i WHEN 'u' THEN {u} END"}[state]
    more = "(d.fault = 'truncated')::INT"
    keep = keep.format(s=put("o", "K", more), u=put("q", "K", more), a=put("r", "K", more))
    stays = f"CASE WHEN d.fault IN ('blank', 'duplicate') THEN NULL ELSE least({keep}, {put(_NEXT[state], 'R', '2 + ' + more)}) END"
    return f"least({put(state, 'D', 3)}, {stays})"


#: The same programme as text: eight digits of cost before the audit, so that strings compare as the weights do. CRC-32 bit
#: by bit, since DuckDB has none. What is said is followed from the audit for the repaired rows.
SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), drawn AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS k
  FROM named
), damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM drawn WHERE k <> 0
), placed AS (
  SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM damaged
), d AS (
  SELECT *, CASE WHEN said = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier
  FROM placed
), facts AS (
  SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pos > 1 AND earlier || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM d GROUP BY conv_id
), solved AS (
  SELECT conv_id, n_rows + 1 AS pos, {", ".join(f"{_least(s, 'e')} AS {s}" for s in _STATES)}
  FROM facts, (SELECT '00000000' AS n, '90000000' AS o, '90000000' AS q, '00000000' AS r) e(n, o, q, r)
  UNION ALL
  SELECT conv_id, pos, {", ".join(f"{_least(s, 'x')} AS {s}" for s in _STATES)}
  FROM (SELECT r.conv_id, d.pos, {", ".join(f"{_edits(s)} AS {s}" for s in _STATES)}
        FROM solved r JOIN d ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.pos = r.pos - 1) x
), best AS (
  SELECT conv_id, left(n, 8)::BIGINT AS cost, substr(n, 9) AS audit FROM solved WHERE pos = 1
), letters AS (
  SELECT conv_id, k, substr(audit, k, 1) AS letter,
         count(*) FILTER (WHERE substr(audit, k, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS pos
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)
), staying AS (
  SELECT l.conv_id, l.k, l.letter, d.role, d.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k) AS place,
         first_value(l.letter = 'K' AND d.i = 's') OVER (PARTITION BY l.conv_id ORDER BY l.k) AS opened
  FROM letters l LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM l.conv_id AND d.pos = l.pos AND l.letter <> 'I'
  WHERE l.letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - opened::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS repaired
  FROM staying GROUP BY conv_id
)
SELECT c.conv_id, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in COUNTS)}, coalesce(audit, '') AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a row's own key decides; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(blank("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("__copy")
    return conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("__copy")


def repaired(conversations: DataFrame) -> DataFrame:
    """The contract's row for every conv_id of `conversations`, also of those that the damage leaves without rows."""
    found = repaired_digests(damaged(conversations)).withColumnRenamed("conv_id", "__conv")
    every = conversations.select("conv_id").distinct()
    counts = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in COUNTS]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(read_table(spark, sf_dir, "conversations"))
