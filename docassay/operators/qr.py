"""QR payloads: format, legacy texts (XML, pipes, JSON, anything) and the secure record."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docassay.functions.text import found

# Place of each field in the secure record.
SECURE_LAYOUT = {
    "qr_version": 0, "reference_id": 2, "name": 3, "dob": 4, "gender": 5, "care_of": 6, "district": 7,
    "landmark": 8, "building": 9, "locality": 10, "pin": 11, "vtc": 12, "state": 13, "street": 14,
    "subdistrict": 15, "district2": 16, "mobile_masked": 17, "email_flag": 19,
}
FIELDS = (
    "qr_version", "reference_id", "name", "dob", "gender", "care_of", "district", "landmark", "building",
    "locality", "pin", "vtc", "state", "street", "subdistrict", "district2", "mobile_masked", "mobile_last4",
    "email_registered", "id_number", "id_last4",
)
LEAST_SECURE_DIGITS = 100
# Patterns of payloads without a format, and of the parts of a pipe text.
MINED_NUMBER = r"\b([2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4})\b"
MINED_NAME = r"\b([A-Z]{2,}\s[A-Z]{2,}(?:\s[A-Z]{2,})?)\b"
MINED_DATE = r"\b(\d{2}[/\-]\d{2}[/\-]\d{4})\b"
PIPE_NUMBER, PIPE_NAME, PIPE_DATE, PIPE_PIN = r"^\d{4,12}$", r"^[A-Za-z\s.\-]+$", r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{4}", r"^\d{6}$"
# Attributes of an XML payload.
XML_ATTRIBUTES = ("uid", "name", "dob", "gender", "dist", "state", "pc", "vtc", "loc", "lm", "house", "street", "co", "mobile")
_RECORD = T.StructType([T.StructField(k, T.StringType()) for k in SECURE_LAYOUT])


def packed_number(digits: str) -> bytes:
    """The bytes of a decimal number of any length; `int` takes a few thousand digits at once."""
    value = 0
    for i in range(0, len(digits), 4000):
        part = digits[i : i + 4000]
        value = value * 10 ** len(part) + int(part)
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


def inflated(digits: str) -> bytes | None:
    """The record packed in a decimal number, inflated from one of the first 15 offsets; broken streams give none."""
    data = packed_number(digits)
    for start in range(min(15, len(data))):
        for bits in (47, 15, -15):
            try:
                out = zlib.decompress(data[start:], bits)
            except zlib.error:
                continue
            if len(out) > 10:
                return out
    return None


def _printed(part: bytes) -> str:
    """The part as text, empty if it holds a control character other than tab and line ends."""
    text = part.decode("utf-8", "replace").strip()
    return "" if any(c < " " and c not in "\t\n\r" for c in text) else text


@F.pandas_udf(_RECORD)
def secure_record(payload: pd.Series) -> pd.DataFrame:
    """Fields of secure payloads of any length; all null for others and for those that do not open."""
    rows = []
    for text in payload:
        row = dict.fromkeys(SECURE_LAYOUT)
        digits = (text or "").strip()
        if digits.isascii() and digits.isdigit() and len(digits) >= LEAST_SECURE_DIGITS:
            data = inflated(digits)
            if data is not None:
                parts = list(map(_printed, data.split(b"\xff")))
                row = {name: parts[k] if k < len(parts) else "" for name, k in SECURE_LAYOUT.items()}
        rows.append(row)
    return pd.DataFrame(rows, columns=list(SECURE_LAYOUT))


def payload_format(raw: Column) -> Column:
    """secure, xml, pipe, json or text by how a payload begins; null for no payload."""
    text = F.trim(raw)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", None)
        .when(text.rlike(rf"^[0-9]{{{LEAST_SECURE_DIGITS},}}$"), "secure")
        .when(text.startswith("<") | F.contains(text, F.lit("PrintLetterBarcodeData")), "xml")
        .when(F.contains(text, F.lit("|")) & ~text.startswith("{"), "pipe")
        .when(text.startswith("{"), "json")
        .otherwise("text")
    )


def _slashed(dob: Column) -> Column:
    return F.regexp_replace(F.trim(dob), r"[-.]", "/")


def _last4(number: Column) -> Column:
    digits = F.regexp_replace(number, r"[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4)))


def gender_word(value: Column, codes: int = 2, other: Column | None = None) -> Column:
    """The gender that a letter or word means (with 3 codes: or a number); `other`, or null, for anything else."""
    # Codes of each gender.
    words = {"Male": ["M", "MALE", "1"], "Female": ["F", "FEMALE", "2"], "Transgender": ["T", "TRANSGENDER", "3"]}
    out = F.lit(None).cast("string") if other is None else other
    for word, names in reversed(words.items()):
        out = F.when(F.upper(F.trim(value)).isin(*names[:codes]), word).otherwise(out)
    return out


def _record(**known: Column) -> Column:
    return F.struct(*(known.get(k, F.lit(None)).cast("boolean" if k == "email_registered" else "string").alias(k) for k in FIELDS))


def _xml(attributes: Column) -> Column:
    at = lambda *names: F.coalesce(*(F.nullif(attributes[f"_{n}"], F.lit("")) for n in names))
    uid, gender = at("uid"), at("gender")
    return _record(
        id_number=F.replace(uid, F.lit("-"), F.lit(" ")), id_last4=_last4(uid), name=F.upper(F.trim(at("name"))),
        dob=_slashed(at("dob")), gender=gender_word(gender, other=F.upper(gender)), district=at("dist"), state=at("state"),
        pin=at("pc"), locality=at("vtc", "loc"), landmark=at("lm"), building=at("house"), street=at("street"),
        care_of=at("co"), mobile_last4=_last4(at("mobile")),
    )


def _pipe(parts: Column) -> Column:
    part = lambda k: F.trim(F.get(parts, k))
    rest = F.filter(F.transform(F.slice(parts, F.lit(6), F.size(parts)), lambda x: F.trim(x)), lambda p: p != "")
    only = lambda c, pattern: F.when(c.rlike(pattern), c)
    return _record(
        id_last4=F.right(only(part(1), PIPE_NUMBER), F.lit(4)), name=F.upper(only(part(2), PIPE_NAME)),
        dob=_slashed(only(part(3), PIPE_DATE)), gender=gender_word(part(4), codes=3),
        pin=F.get(F.filter(rest, lambda p: p.rlike(PIPE_PIN)), 0), state=F.when(F.size(rest) >= 2, F.get(rest, F.size(rest) - 2)),
    )


def _json(values: Column) -> Column:
    at = lambda *names: F.coalesce(*(F.try_element_at(values, F.lit(n)) for n in names))
    uid, gender = at("uid", "UID"), at("gender", "Gender")
    return _record(
        name=F.upper(F.trim(at("name", "Name"))), dob=_slashed(at("dob", "DOB")), gender=gender_word(gender, other=F.upper(gender)),
        id_number=F.replace(uid, F.lit("-"), F.lit(" ")), id_last4=_last4(uid), pin=at("pc", "pin"), state=at("state", "State"),
    )


def _mined(raw: Column) -> Column:
    return _record(
        id_number=F.replace(found(raw, MINED_NUMBER), F.lit("-"), F.lit(" ")),
        name=found(raw, MINED_NAME),
        dob=_slashed(found(raw, MINED_DATE)),
    )


def _whole_json(text: Column) -> Column:
    """The object's values where nothing follows it, else null.

    A parser stops after the first object, so the text is put between a list's
    and an object's ends: what follows an object can break out of one of them only.
    """
    strict = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "__broken"}
    listed = F.from_json(F.concat(F.lit('{"x":['), text, F.lit("]}")), "x array<map<string,string>>, __broken string", strict)
    held = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x map<string,string>, __broken string", strict)
    whole = listed["__broken"].isNull() & held["__broken"].isNull() & (F.size(listed["x"]) == 1)
    return F.when(text.endswith("}") & whole, held["x"])


def _single_root(text: Column) -> Column:
    """Whether well-formed XML has one root and no text beside it: a parser stops after the first."""
    opened, empty, closed, words = "\x01", "\x02", "\x03", "\x04"
    value = r""""[^"]*"|'[^']*'"""
    marks = text
    for pattern, mark in (
        (r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>", ""),
        (r"(?s)<!\[CDATA\[.*?\]\]>", words),
        (r"</[^>]*>", closed),
        (rf"<(?:{value}|[^'\">/]|/(?!>))*/>", empty),
        (rf"<(?:{value}|[^'\">])*>", opened),
        (r"\s+", ""),
        (r"[^\x01-\x04]+", words),
    ):
        marks = F.regexp_replace(marks, pattern, mark)

    def after(s: Column, mark: Column) -> Column:
        outside = s["depth"] == 0
        return F.struct(
            (s["depth"] + F.when(mark == opened, 1).when(mark == closed, -1).otherwise(0)).alias("depth"),
            (s["roots"] + F.when(outside & mark.isin(opened, empty), 1).otherwise(0)).alias("roots"),
            (s["stray"] | (outside & (mark == words))).alias("stray"),
        )

    begun = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("roots"), F.lit(False).alias("stray"))
    return F.aggregate(F.split(marks, ""), begun, after, lambda s: (s["depth"] == 0) & (s["roots"] == 1) & ~s["stray"])


def _legacy(df: DataFrame) -> DataFrame:
    """`df` (__text, __kind) with format and qr: the record of whole XML or JSON or of five pipe parts, else what any text tells."""
    text, kind = F.col("__text"), F.col("__kind")
    attributes = ", ".join(f"_{k} string" for k in XML_ATTRIBUTES)
    opened = df.withColumns(
        {
            # attributes by name whatever its case; not well-formed: the whole text is in __broken, which must come last
            "__xml": F.when(kind == "xml", F.from_xml(text, f"{attributes}, __broken string", {"columnNameOfCorruptRecord": "__broken"})),
            "__one": F.when(kind == "xml", _single_root(text)),
            "__json": F.when(kind == "json", _whole_json(text)),
            "__parts": F.when(kind == "pipe", F.split(text, r"\|", -1)),
        }
    )
    found_as = (
        F.when((kind == "xml") & F.col("__xml.__broken").isNull() & F.col("__one"), "xml")
        .when(F.col("__json").isNotNull(), "json")
        .when(F.size("__parts") >= 5, "pipe")
        .when(kind.isNotNull(), "text")
    )
    return opened.withColumn("format", found_as).withColumn(
        "qr",
        F.when(F.col("format") == "xml", _xml(F.col("__xml")))
        .when(F.col("format") == "json", _json(F.col("__json")))
        .when(F.col("format") == "pipe", _pipe(F.col("__parts")))
        .when(F.col("format") == "text", _mined(text)),
    )


def parsed_payloads(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """`payloads` with format and qr (a record), in place of columns of that name; null for no payload.

    Only payloads of digits go through Python. A secure payload that does not
    open, XML or JSON that is not well-formed or that something follows, and fewer
    than five parts between pipes are read like any other text: for a number, a
    name and a date.
    """
    columns = [c for c in payloads.columns if c not in ("format", "qr")]
    base = payloads.withColumns({"__text": F.trim(raw), "__kind": payload_format(F.col(raw))})
    secure_kind = F.coalesce(F.col("__kind") == "secure", F.lit(False))
    legacy = _legacy(base.where(~secure_kind)).select(*columns, "format", "qr")
    opened = base.where(secure_kind).withColumn("__s", secure_record("__text"))
    s = lambda k: F.nullif(F.col(f"__s.{k}"), F.lit(""))
    mobile = F.regexp_replace(s("mobile_masked"), r"[^0-9]", "")
    same = {k: s(k) for k in FIELDS if k in SECURE_LAYOUT and k not in ("name", "dob", "gender")}
    record = _record(
        **same, name=F.upper(s("name")), dob=_slashed(s("dob")), gender=gender_word(s("gender"), other=F.initcap(s("gender"))),
        mobile_last4=F.nullif(F.right(mobile, F.lit(4)), F.lit("")), email_registered=F.upper(F.coalesce(s("email_flag"), F.lit(""))) == "Y",
    )
    readable = F.col("__s.qr_version").isNotNull()
    secure = opened.select(
        *columns,
        F.when(readable, "secure").otherwise("text").alias("format"),
        F.when(readable, record).otherwise(_mined(F.col("__text"))).alias("qr"),
    )
    return legacy.unionByName(secure)
