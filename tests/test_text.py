import pytest
from pyspark.sql import functions as F

from docassay.functions import text as X

CASES = {
    "id_number": [
        ("no 2345 6789 0123 x", "2345 6789 0123"), ("2345-6789. 0123", "2345 6789 0123"), ("234567890123", "2345 6789 0123"),
        ("1234 5678 9012", None), ("2345 6789 0123 4567", "2345 6789 0123"), ("", None), (None, None),
    ],
    "virtual_id": [("9345 6789 0123 4567", "9345 6789 0123 4567"), ("9345678901234567", "9345 6789 0123 4567"), ("2345 6789 0123", None)],
    "enrolment_number": [("1234/12345/54321", "1234/12345/54321"), ("1234 12345 54321", "1234/12345/54321"), ("EID:12341234512345", "1234/12345/12345"), ("x", None)],
    "mobile": [("call 9876543210 now", "9876543210"), ("5876543210", None), ("98765432101", None)],
    "email": [("A.B@Example.com c@d.org", "a.b@example.com"), ("help@uidai.gov.in x@y.com", None), ("none", None)],
    "year_of_birth": [("Year of Birth: 1985", "1985"), ("YOB 1899", None), ("yob: 2026", None)],
    "issue_date": [("Issue Date: 1/2/2013", "1/2/2013"), ("1/2/2013", None)],
    "date_of_birth": [
        ("DOB: 10/11/2005", "10/11/2005"), ("DOR 10 12006", "10/01/2006"), ("DOB 10 112005", "10/11/2005"), ("12-30-1988", "30/12/1988"),
        ("31.02.1990", "31/02/1990"), ("01/01/1899", None), ("01/01/2026", None), ("DOB: lor", None),
    ],
    "gender": [
        ("a FEMALE b", "Female"), ("Male", "Male"), ("x\nMiso\n", "Male"), ("x\nFemle", "Female"), ("DOB 1\nfrrr zz", "Female"),
        ("DOB 1\n\nMXXYY", "Male"), ("M", None), ("DOB\nMMMMMMMMMMMMM", None), ("none of it here at all", None),
    ],
    "name": [
        ("Government of India\nANIL SHARMA\nDOB: 1/1/2000", "ANIL SHARMA"), ("junk\nGovt. of India\nee 1\n~Sunita Patel|\n", "Sunita Patel"),
        ("Full Name: Rakesh Nair", "Rakesh Nair"), ("abc def\nMEENA DEVI LAL\nDOB 1/1/2000", "MEENA DEVI LAL"), ("GOVERNMENT OF INDIA\nMALE CARD\nXX", None), ("", None),
    ],
    "hindi_name": [("भारत सरकार\nअनिल शर्मा\n", "अनिल शर्मा"), ("abc", None), ("अनिल 12", None)],
    "care_of": [("S/O: Mohan Lal\n12", "Mohan Lal"), ("C/O Ram\n", "Ram"), ("Father: Ram Das Gupta, x", "Ram Das Gupta"), ("x", None)],
    "card_side": [("DOB District", "combined"), ("DOB Government of India", "front"), ("PIN 1", "back"), ("DOB", "unknown"), (None, None)],
    "clean_line": [(" |'~a b.-)", "a b"), ("...", ""), ("x", "x")],
    "fixed_digits": [("OoDQIli|ZzSsGbTBgq", "000011112255667899"), ("7", "7")],
    "repaired_date": [("1O/ll/2OO5", "10/11/2005"), ("05-13-1999", "13/05/1999"), ("x", "x"), ("1/1/1800", "1/1/1800")],
    "corrected_name": [("ghanshvan", "ghanshvan"), ("GHANSHVAN", "GHANSHYAM"), ("  ", "  "), ("R4M L@L", "RAM LAL"), (None, None)],
    "regrouped_id": [("2345 6789 O12S", "2345 6789 0125"), ("12", "12")],
    "masked": [("2345 6789 0123", "XXXX XXXX 0123"), ("12", "12"), ("", "—"), (None, "—")],
    "masked_or_null": [("2345 6789 0123", "XXXX-XXXX-0123"), ("12", None)],
    "unique_lines": [("a\n|b\na\n\n", ["a", "b"])],
    "lines": [("a\r\nb\n", ["a", "b"]), ("a b c\n\nd", ["a b c", "", "d"]), ("", [])],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_expression(spark, name):
    kind = "string"
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES[name])], f"k int, t {kind}")
    got = df.select("k", getattr(X, name)(F.col("t")).alias("v")).orderBy("k").collect()
    assert [r.v for r in got] == [want for _, want in CASES[name]]


def test_address(spark):
    text = "Government of India\nMale\nS/O Mohan Lal, House No: 12/B\nnear kamla niwas, eae eas eee\nVillage: Rampur, Dist: Thane\nMaharashtra 421306\n2345 6789 0123\nignored"
    df = spark.createDataFrame([(text,), ("nothing",), (None,)], "t string").withColumn("b", X.address_block(F.col("t")))
    rows = df.select("b", X.address_parts(F.col("b")).alias("p")).collect()
    assert rows[0].p.pin == "421306" and rows[0].p.state == "Maharashtra" and rows[0].p.house == "12/B"
    assert rows[0].p.locality == "Rampur" and rows[0].p.district.startswith("Thane") and "ignored" not in rows[0].b
    assert rows[1].b is None and rows[2].b is None and rows[1].p.full is None


def test_record_has_all_fields(spark):
    df = spark.createDataFrame([("Government of India\nANIL SHARMA\nDOB: 1/1/2000\nMale", 1), (None, 2)], "text string, k int")
    out = X.with_card_record(df, "text")
    assert len(out.columns) == 25 and out.columns[:2] == ["text", "k"]
    first, none = out.orderBy("k").collect()
    assert (first.name, first.dob, first.gender, first.card_type) == ("ANIL SHARMA", "01/01/2000", "Male", "front")
    assert none.name is None and none.id_number is None


def test_date_candidates_keep_order_and_drop_repeats(spark):
    df = spark.createDataFrame([("DOB: 10/11/2005 and 10-11-2005, 31/12/1999",)], "t string")
    got = df.select(X.date_candidates(F.col("t"), False).alias("c")).first().c
    assert [tuple(x) for x in got] == [(10, 11, 2005), (31, 12, 1999)]


def test_each_pattern_is_searched_once(spark):
    """A field that uses what it finds more than once names it; nested uses would search the text again for each."""
    df = spark.createDataFrame([("x",)], "t string")
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    for field, pattern in (("id_number", X.ID_LOOSE), ("virtual_id", X.VID_TIGHT), ("enrolment_number", X.ENROLMENT_LABELLED), ("email", X.EMAIL), ("care_of", X.CARE_OF)):
        assert plan(df.select(getattr(X, field)(F.col("t")).alias("v"))).count(f" {pattern}, ") == 1, field
    record = plan(X.with_card_record(df, "t"))
    assert all(record.count(f" {p}, ") == 1 for p in (X.HOUSE, X.LOCALITY, X.DISTRICT, X.ADDRESS_PIN, X.CARE_OF, X.EMAIL))


def test_identifiers_in_odd_texts(spark):
    rows = [("2345   6789    0123", "2345 6789 0123"), ("a234567890123b", "2345 6789 0123"), ("1 2345.-.6789 0123 and 3456 7890 1234", "3456 7890 1234")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string")
    assert [x.v for x in df.orderBy("k").select(X.id_number(F.col("t")).alias("v")).collect()] == [want for _, want in rows]
    ends = spark.createDataFrame([("a\r\nb\rc d\n",), ("\n",), ("\r\n\r\n",)], "t string")
    assert [x.v for x in ends.select(X.lines(F.col("t")).alias("v")).collect()] == [["a", "b", "c", "d"], [""], ["", ""]]


def test_packed_dates_are_the_candidates(spark):
    texts = ["DOB: 10/11/2005 and 10-11-2005, 31/12/1999", "DOR 10 11985", "DOB 5 101985", "DOB 010 0001 001988", "DOB: 12/30/1988", "1.2.1990 DOB 99999999999 1 1999", "DOB", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("near", X.from_label(F.col("t"))).withColumn("digits", X.digits_behind(F.col("near")))
    kept = F.array_distinct(F.filter(X.date_codes(F.col("t"), F.col("near"), F.col("digits")), lambda x: X.is_date(x)))
    packed = F.transform(kept, lambda x: F.struct(*X.unpacked_date(x)))
    rows = df.select(packed.alias("a"), X.date_candidates(F.col("t"), False).alias("b")).collect()
    as_tuples = lambda x: x and [tuple(y) for y in x]
    assert [as_tuples(x.a) for x in rows] == [as_tuples(x.b) for x in rows] and sum(bool(x.a) for x in rows) >= 4
