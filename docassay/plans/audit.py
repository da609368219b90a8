"""The audit log, duplicates, rate limits and admission, with `events` as the log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.operators import audit as A
from docassay.operators.dedup import duplicates, first_similar, first_similar_in_log
from docassay.operators.limits import rate_limited
from docassay.plans.derive import CUSTOMER_UID, OCR_NAME, cte, view
from docassay.sources import read_table, stream_table
from docassay.sources.scratch import scratch_folder
from docassay.streaming.drain import drained
from docassay.streaming.limits import rate_limited_stream

_LOG = {
    "seq": "event_id",
    "ts": "ts",
    "verdict": "CASE event_type WHEN 'purchase' THEN 'VERIFIED' WHEN 'error' THEN 'GEO INVALID' WHEN 'click' THEN 'REVIEW REQUIRED' WHEN 'view' THEN 'VALID' ELSE NULL END",
    "overall": "CAST(floor(value) AS INT)",
    "is_duplicate": "user_id % 7 = 0",
}


def audit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.statistics(view(spark, sf_dir, "events", _LOG))


AUDIT_STATISTICS = f"""SELECT count(*) AS total, CAST(count_if(contains(coalesce(verdict, ''), 'VERIFIED')) AS BIGINT) AS verified, CAST(count_if(contains(coalesce(verdict, ''), 'REVIEW')) AS BIGINT) AS review,
  CAST(count_if(contains(coalesce(verdict, ''), 'TAMPERED') OR contains(coalesce(verdict, ''), 'INVALID')) AS BIGINT) AS rejected, CAST(count_if(is_duplicate) AS BIGINT) AS duplicates,
  CAST(floor(sum(coalesce(overall, 0)) / greatest(count(*), 1)) AS INTEGER) AS avg_score FROM {cte("events", _LOG)}"""


def recent_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recent(view(spark, sf_dir, "events", _LOG), ["ts", "seq"], 10).select("seq", "verdict", "overall")


RECENT_ENTRIES = f"SELECT seq, verdict, overall FROM {cte('events', _LOG)} ORDER BY ts DESC, seq DESC LIMIT 10"

_SIGNALS = {
    "event_id": "event_id",
    "signal": "CASE event_id % 11 WHEN 0 THEN 'Verhoeff failed' WHEN 1 THEN 'ELA: re-compression' WHEN 2 THEN 'Moire on screen' WHEN 3 THEN 'PIN 411001 belongs to Maharashtra' "
    "WHEN 4 THEN 'District-state mismatch' WHEN 5 THEN 'age mismatch' WHEN 6 THEN 'noise' WHEN 7 THEN 'AI-generated image' WHEN 8 THEN 'QR not detected' WHEN 9 THEN event_type ELSE NULL END",
}


def explained_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.explained(view(spark, sf_dir, "events", _SIGNALS)).select("event_id", "reason", "severity")


EXPLAINED_SIGNALS = f"""
WITH x AS (SELECT event_id, lower(coalesce(signal, '')) AS s FROM {cte("events", _SIGNALS)}),
r AS (SELECT event_id, CASE WHEN contains(s, 'verhoeff') OR contains(s, 'checksum') THEN 'checksum' WHEN contains(s, 'ela') OR contains(s, 're-compression') THEN 'edited_region'
  WHEN contains(s, 'moire') OR contains(s, 'screen') THEN 'screen_or_copy' WHEN contains(s, 'pin') AND contains(s, 'belongs to') THEN 'pin_of_other_state'
  WHEN contains(s, 'district') AND contains(s, 'mismatch') THEN 'district_of_other_state' WHEN contains(s, 'age') AND contains(s, 'mismatch') THEN 'age'
  WHEN contains(s, 'noise') OR contains(s, 'clone') THEN 'pasted_region' WHEN contains(s, 'ai') AND contains(s, 'generat') THEN 'generated_image'
  WHEN contains(s, 'qr not detected') THEN 'qr_missing' ELSE 'other' END AS reason FROM x)
SELECT event_id, reason, CASE WHEN reason IN ('age', 'pasted_region', 'qr_missing', 'other') THEN 'warning' ELSE 'critical' END AS severity FROM r"""

#: Every embedding as a 64-bit hash: a bit for each of its 64 values, set above the mean of all but the first.
_HASH_SQL = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN e[i] > m THEN (1::HUGEINT << (64 - i)::INT) ELSE 0 END))"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    rest = F.slice(F.col("embedding"), 2, 63)
    mean = F.aggregate(rest, F.lit(0.0), lambda s, x: s + x.cast("double")) / 63.0
    bits = F.transform("embedding", lambda x: (x.cast("double") > mean).cast("long"))
    phash = F.aggregate(bits, F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b))
    # other vectors have no hash; they can still be equal to others by their digest
    return e.select(F.col("vec_id").alias("seq"), F.when(F.size("embedding") == 64, phash).alias("phash"), F.sha2(F.col("label").cast("string"), 256).alias("digest"))


NEAR_BITS = 16


def similar_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_similar(_hashed(spark, sf_dir), NEAR_BITS)


SIMILAR_HASHES = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_sum(embedding[2:64]::DOUBLE[]) / 63.0 AS m FROM embeddings WHERE len(embedding) = 64),
h AS (SELECT vec_id AS seq, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS h FROM (SELECT vec_id, {_HASH_SQL} AS h FROM e))
SELECT b.seq, min(a.seq) AS similar_seq FROM h a JOIN h b ON a.seq < b.seq AND bit_count(xor(a.h, b.h)) <= {NEAR_BITS} GROUP BY 1"""


BATCHES = 3


def similar_hashes_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, batch after batch, against an index of all batches before: a table under spark.checkpoint.dir."""
    entries, folder = _hashed(spark, sf_dir), scratch_folder(spark, "band-index")
    last = (entries.agg(F.max("seq")).first()[0] or 0) + 1
    answers = [
        first_similar_in_log(entries.where((F.col("seq") >= last * k // BATCHES) & (F.col("seq") < last * (k + 1) // BATCHES)), f"{folder}/index", str(k), NEAR_BITS)
        for k in range(BATCHES)
    ]
    return reduce(DataFrame.unionByName, answers)


def duplicate_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(_hashed(spark, sf_dir), NEAR_BITS).select("seq", "is_duplicate", "duplicate_of")


DUPLICATE_SUBMISSIONS = f"""
WITH n AS ({SIMILAR_HASHES}), f AS (SELECT label, min(vec_id) AS first FROM embeddings WHERE label IS NOT NULL GROUP BY 1),
d AS (SELECT e.vec_id AS seq, least(CASE WHEN f.first < e.vec_id THEN f.first END, n.similar_seq) AS duplicate_of
  FROM embeddings e LEFT JOIN f ON f.label = e.label LEFT JOIN n ON n.seq = e.vec_id)
SELECT seq, duplicate_of IS NOT NULL AS is_duplicate, duplicate_of FROM d"""

LIMITS = ((3600, 1), (86400, 3))
_REQUESTS = {"key": "user_id", "ts": "ts", "seq": "event_id"}


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limited(view(spark, sf_dir, "events", _REQUESTS), LIMITS).select("key", "seq", "accepted")


RATE_LIMIT = f"""
WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w(key, n, seq, accepted, log) AS (
  SELECT key, n, seq, TRUE, [t] FROM r WHERE n = 1
  UNION ALL
  SELECT r.key, r.n, r.seq,
    len(list_filter(w.log, lambda x: r.t - x < {LIMITS[0][0]}000000)) < {LIMITS[0][1]} AND len(list_filter(w.log, lambda x: r.t - x < {LIMITS[1][0]}000000)) < {LIMITS[1][1]},
    CASE WHEN len(list_filter(w.log, lambda x: r.t - x < {LIMITS[0][0]}000000)) < {LIMITS[0][1]} AND len(list_filter(w.log, lambda x: r.t - x < {LIMITS[1][0]}000000)) < {LIMITS[1][1]}
      THEN list_append(list_filter(w.log, lambda x: r.t - x < {LIMITS[1][0]}000000), r.t) ELSE list_filter(w.log, lambda x: r.t - x < {LIMITS[1][0]}000000) END
  FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1)
SELECT key, seq, accepted FROM w"""

LATENESS_S = 3600


def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the events as a stream, drained: what its watermark has passed is answered.

    Its answers stay in a folder under spark.checkpoint.dir, as the result is read from it.
    """
    events = stream_table(spark, sf_dir, "events").selectExpr(*(f"{sql} AS {k}" for k, sql in _REQUESTS.items()))
    answered = drained(spark, lambda: rate_limited_stream(events, LIMITS, f"{LATENESS_S} seconds"), "rate-limit")
    return answered.select("key", "seq", "accepted")


RATE_LIMIT_STREAM = f"""SELECT x.* FROM ({RATE_LIMIT}) x JOIN events ON event_id = x.seq
WHERE epoch_us(ts) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - {LATENESS_S}000 FROM events)"""

_GATES = {
    "event_id": "event_id",
    "api_key": "CASE user_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'stale' ELSE 'key' || CAST(user_id % 5 AS VARCHAR(4)) END",
    "rate_ok": "event_id % 13 <> 0",
    "has_file": "event_type <> 'view'",
    "width": "CAST(event_id % 900 AS INT)", "height": "CAST(100 + event_id % 500 AS INT)",
    "brightness": "value", "sharpness": "CAST(event_id % 50 AS DOUBLE)",
    "duplicate": "user_id % 7 = 0",
}


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = view(spark, sf_dir, "events", _GATES)
    keys = view(spark, sf_dir, "nation", {"api_key": "'key' || CAST(n_nationkey % 4 AS VARCHAR(4))"})
    asked = A.authorised(gates, keys)
    quality = A.quality_gate(*(F.col(k) for k in ("width", "height", "brightness", "sharpness")))
    status = A.admission(F.col("auth_status"), F.col("rate_ok"), F.col("has_file"), quality, F.col("duplicate"))
    return asked.select("event_id", quality.alias("quality"), status.cast("int").alias("status"))


ADMISSIONS = f"""
WITH g AS {cte("events", _GATES)},
q AS (SELECT *, CASE WHEN width < 300 OR height < 200 THEN 'too_small' WHEN brightness < 30 THEN 'too_dark' WHEN brightness > 248 THEN 'blank' WHEN sharpness < 5 THEN 'blurred'
  WHEN NOT (width / height BETWEEN 0.4 AND 3.5) THEN 'aspect' ELSE 'ok' END AS quality,
  CASE WHEN trim(api_key) = '' THEN 401 WHEN api_key NOT IN (SELECT 'key' || CAST(n_nationkey % 4 AS VARCHAR(4)) FROM nation) THEN 403 ELSE 200 END AS auth FROM g)
SELECT event_id, quality, CAST(CASE WHEN auth <> 200 THEN auth WHEN NOT rate_ok THEN 429 WHEN NOT has_file OR quality <> 'ok' THEN 400 WHEN duplicate THEN 409 ELSE 200 END AS INTEGER) AS status FROM q"""

_REPORTS = {"c_custkey": "c_custkey", "name": OCR_NAME, "uid": CUSTOMER_UID}


def report_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "customer", _REPORTS)
    digest = A.report_digest(F.lit("R"), F.col("c_custkey"), F.col("name"), F.col("uid"), F.lit(None))
    return c.select("c_custkey", digest.alias("digest"), A.pixel_digest(F.col("name").cast("binary")).alias("pixels"))


REPORT_DIGESTS = f"""SELECT c_custkey, upper(left(sha256('R' || CAST(c_custkey AS VARCHAR) || name || uid), 16)) AS digest, left(sha256(name), 16) AS pixels
FROM {cte("customer", _REPORTS)}"""

QUERIES = {
    "audit_statistics": (audit_statistics, AUDIT_STATISTICS),
    "recent_entries": (recent_entries, RECENT_ENTRIES),
    "explained_signals": (explained_signals, EXPLAINED_SIGNALS),
    "similar_hashes": (similar_hashes, SIMILAR_HASHES),
    "similar_hashes_in_batches": (similar_hashes_in_batches, SIMILAR_HASHES),
    "duplicate_submissions": (duplicate_submissions, DUPLICATE_SUBMISSIONS),
    "rate_limit": (rate_limit, RATE_LIMIT),
    "rate_limit_stream": (rate_limit_stream, RATE_LIMIT_STREAM),
    "admissions": (admissions, ADMISSIONS),
    "report_digests": (report_digests, REPORT_DIGESTS),
}
