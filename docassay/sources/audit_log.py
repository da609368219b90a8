"""The audit log as JSON lines: reader that skips bad lines, appending writer."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SCHEMA = """log_id string, timestamp string, verdict string, report_id string,
scores struct<qr_trust:int, tampering:int, geo:int, face:int, overall:int>,
fields_masked struct<name:string, id:string, dob:string, gender:string, pin:string, district:string, state:string>,
fraud_signals array<string>, phash string, img_sha256 string, is_duplicate boolean, duplicate_of string"""


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed entries, of folders of batches too; blank and malformed lines are left out. A log that is not there yet has none."""
    try:
        log = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
        return log.select(*(c for c in log.columns if c not in ("source", "batch")))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def append_audit_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)
