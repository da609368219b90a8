"""From uploads to responses."""

import hashlib
import zlib
from pathlib import Path

from pyspark.sql import functions as F

from docassay.functions.text import shortened
from docassay.operators import audit, images, ocr, qr
from docassay.operators import submissions as U
from docassay.sources.submissions import complete, read_submissions, stream_submissions


def test_drop_folder(spark, tmp_path):
    for name in ("a1_front.jpg", "a1_BACK.png", "b_2_selfie.jpeg", "c_front.txt", "front.jpg", "d_side.png"):
        (tmp_path / name).write_bytes(name.encode())
    got = {(x.submission_id, x.side): bytes(x.data) for x in read_submissions(spark, str(tmp_path)).collect()}
    assert got == {("a1", "front"): b"a1_front.jpg", ("a1", "back"): b"a1_BACK.png", ("b_2", "selfie"): b"b_2_selfie.jpeg"}
    whole = {x.submission_id: (x.has_front, x.has_back, x.has_selfie) for x in complete(read_submissions(spark, str(tmp_path))).collect()}
    assert whole == {"a1": (True, True, False), "b_2": (False, False, True)}
    stream = stream_submissions(spark, str(tmp_path)).select("submission_id", "side").writeStream.format("memory").queryName("sides")
    stream.option("checkpointLocation", str(tmp_path.parent / "stream")).trigger(availableNow=True).start().awaitTermination(60)
    assert {tuple(x) for x in spark.table("sides").collect()} == set(got)


def test_signals(spark):
    df = spark.createDataFrame([(1, False, True, True, False), (2, True, False, True, True), (3, True, True, False, None), (4, True, True, None, True)], "doc_id int, found boolean, readable boolean, name boolean, dob boolean")
    signals = U.qr_signals(F.col("found"), F.col("readable"), {"name": F.col("name"), "dob": F.col("dob")})
    checks = spark.createDataFrame(
        [(1, "geo", "pin", False), (1, "tamper", "verhoeff", False), (1, "tamper", "verhoeff", False), (2, "geo", "name", True), (3, "geo", "other", False), (3, "tamper", "noise", None)],
        "doc_id int, module string, check string, passed boolean",
    )
    got = {x.doc_id: x for x in U.with_all_signals(df.withColumn("qr_signals", signals), checks).withColumn("t", U.signal_totals(F.col("signals"))).collect()}
    assert got[1].signals == [U.NO_QR, U.CHECK_SIGNALS["tamper", "verhoeff"], U.CHECK_SIGNALS["geo", "pin"]] and tuple(got[1].t) == (3, 2)
    assert got[2].signals == [U.BROKEN_QR] and got[3].signals == ["name mismatch"] and got[4].signals == [] and tuple(got[4].t) == (0, 0)
    none = spark.range(1).select(U.signal_totals(F.lit(None).cast("array<string>")).alias("t")).first().t
    assert tuple(none) == (0, 0)


def test_every_check_has_a_signal_with_its_reason(spark):
    df = spark.createDataFrame([(k[1], v) for k, v in U.CHECK_SIGNALS.items()], "check string, signal string")
    got = {x.check: x.reason for x in audit.explained(df).collect()}
    assert got == {
        "ela": "edited_region", "noise": "pasted_region", "font": "other", "moire": "screen_or_copy", "hologram": "other", "verhoeff": "checksum",
        "pin": "pin_of_other_state", "district": "district_of_other_state", "ai_image": "generated_image", "name": "other",
    }


def test_trust_without_a_readable_code(spark):
    m = {k: F.lit(True) for k in ("name", "dob", "gender", "pin", "district", "state")}
    v = lambda found, readable: spark.range(1).select(U.qr_trust(F.lit(found), F.lit(readable), m, F.lit(55)).alias("t")).first().t
    assert (v(False, False), v(True, False), v(True, True)) == (55, 40, 100)


def test_corrected_cards(spark):
    cards = spark.createDataFrame([(1, "5UNITA DEVI", "01/01/1990", "2345 678O 1234", "x"), (2, None, None, None, None), (3, "ANIL", "odd", "12", "y")], "doc_id long, name string, dob string, id_number string, other string")
    passes = spark.createDataFrame([(1, 0, "DOB: 02/01/1990"), (1, 1, "DOB 02/01/1991"), (1, 2, None), (3, 0, "none")], "doc_id long, pass_no int, text string")
    got = {x.doc_id: tuple(x)[1:] for x in U.corrected_cards(cards, passes).collect()}
    assert got == {1: ("SUNITA DEVI", "02/01/1990", "2345 6780 1234", "x"), 2: (None, None, None, None), 3: ("ANIL", "odd", "12", "y")}


def test_votes_of_corrected_cards_lie_as_the_join_needs_them(spark):
    """Equal dates are counted, then a document's meet; only the cards themselves are dealt once more."""
    cards = spark.createDataFrame([(1, "ANIL", "01/01/1990", "12"), (2, "ANIL", "x", "12")], "doc_id long, name string, dob string, id_number string")
    passes = spark.createDataFrame([(1, 4, "02/01/1990 and 1-1-1990"), (1, 7, "DOR 3 11991"), (2, 0, "13/13/1990")], "doc_id long, pass_no int, text string")
    out = U.corrected_cards(cards, passes)
    assert {x.doc_id: x.dob for x in out.collect()} == {1: "01/01/1990", 2: "x"}
    plan = U.corrected_cards(cards, passes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 3


def test_entry_and_response(spark, tmp_path):
    from docassay.sources.audit_log import append_audit_log, read_audit_log

    fields = {k: F.lit(k) for k in ("name", "dob", "gender", "pin", "district", "state")} | {"id_number": F.lit("2345 6789 0123")}
    signals = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda n: n.cast("string"))
    none = F.lit(None).cast("int")
    entry = audit.entry(fields, signals, {"qr_trust": F.lit(29), "tampering": none, "geo": F.lit(100), "face": none})
    df = spark.range(2).select(*(c.alias(k) for k, c in entry.items()), F.lit("VALID").alias("verdict"))
    append_audit_log(df, str(tmp_path / "log"))
    rows = read_audit_log(spark, str(tmp_path / "log")).collect()
    assert len({x.log_id for x in rows}) == 2 and all(len(x.fraud_signals) == 10 and x.fields_masked.id == "XXXX-XXXX-0123" for x in rows)
    assert all((x.scores.tampering, x.scores.face, x.scores.overall) == (100, 0, 60) and x.timestamp[4] == "-" for x in rows)
    body = spark.range(1).select(U.response_body({"a": F.lit(1), "b": none, "c": F.lit("é")}).alias("b")).first().b
    assert body == '{"a":1,"b":null,"c":"é"}'


def test_downloads_and_failures(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "k int, report_id string")
    reports = spark.createDataFrame([("a", "/1"), ("a", "/2"), ("b", None), (None, "/x")], "report_id string, path string")
    assert sorted((x.k, x.status, x.path) for x in U.downloads(asked, reports).collect()) == [(1, 200, "/2"), (2, 404, None), (3, 404, None), (4, 404, None)]
    status = lambda failed: spark.range(1).select(audit.admission(F.lit(200), F.lit(True), F.lit(True), F.lit("ok"), F.lit(False), F.lit(failed)).alias("s")).first().s
    assert (status(True), status(False), status(None)) == (500, 200, 200)


def packed(fields, level=9):
    data = fields if isinstance(fields, bytes) else b"\xff".join(f.encode() for f in fields)
    return zlib.compress(data, level)


def as_digits(data):
    value, out = int.from_bytes(data, "big"), []
    while value:
        value, part = divmod(value, 10**4000)
        out.append(str(part).zfill(4000))
    return "".join(reversed(out)).lstrip("0")


FIELDS = ["V2", "x", "ref1", "anil‍ sharma", "01-02-1990", "other", "C/O R", "Pu\x01ne", "a\tb", "12", "Rd", "411001", "Vtc", "Maharashtra", "St", "Sub", "D2", "XXXXXX1234", "y", "N"]


def test_secure_payloads(spark):
    import random

    r = random.Random(1)
    long = [*FIELDS[:9], "".join(chr(r.randrange(33, 0x500)) for _ in range(2500)), *FIELDS[10:]]
    whole = packed(FIELDS)
    payloads = {"whole": as_digits(whole), "long": as_digits(packed(long)), "late": as_digits(b"\x01\x02\x03" + whole), "stored": as_digits(packed(FIELDS, 0))}
    assert len(payloads["long"]) > 6000
    for k in range(20):
        payloads[f"cut {k}"] = as_digits(whole[: len(whole) * (30 + 3 * k) // 100])
    payloads["short"] = as_digits(packed(b"tiny") + b"\0" * 60)
    df = spark.createDataFrame(list(payloads.items()), "k string, raw string")
    got = {x.k: (x.format, x.qr) for x in qr.parsed_payloads(df).collect()}
    for k in ("whole", "long", "late", "stored"):
        kind, q = got[k]
        assert kind == "secure" and (q.name, q.dob, q.gender, q.care_of, q.pin, q.email_registered) == ("ANIL‍ SHARMA", "01/02/1990", "Other", "C/O R", "411001", False)
        assert q.district is None and q.landmark == "a\tb" and q.mobile_last4 == "1234"
    assert got["long"][1].building == long[9]
    for k in payloads:
        if k.startswith("cut") or k == "short":
            assert got[k][0] == "text" and got[k][1].name is None, k


def test_malformed_texts_are_mined(spark):
    payloads = {
        '{"name": "RAM LAL", 01/02/1990': ("text", "RAM LAL", "01/02/1990"),
        '<P name="RAM LAL" dob="01-02-1990"': ("text", "RAM LAL", "01/02/1990"),
        "<P><q></P> RAM LAL": ("text", "RAM LAL", None),
        "a|RAM LAL|01-02-1990": ("text", "RAM LAL", "01/02/1990"),
        '<P name="A &amp; B" Dob=\'1-2-1990\' gender="x"/>': ("xml", "A & B", "1/2/1990"),
        '<P name="O\'Neil &#233;"/>': ("xml", "O'NEIL É", None),
        '{"Name": "a &amp; b", "dob": "1.2.1990", "pin": 411001}': ("json", "A &AMP; B", "1/2/1990"),
        '{"name": null}': ("json", None, None),
        "{'name': 'RAM LAL'}": ("text", "RAM LAL", None),
    }
    df = spark.createDataFrame([(p,) for p in payloads], "raw string")
    got = {x.raw: (x.format, x.qr.name, x.qr.dob) for x in qr.parsed_payloads(df).collect()}
    assert got == payloads


def test_limits_at_the_edges_of_a_window(spark):
    from docassay.operators.limits import SlidingLog, rate_limited

    base = 1_700_000_000_000_000
    times = [base + k for k in (0, 1, 59_999_999, 60_000_000, 60_000_001, 119_999_999, 120_000_001)]
    df = spark.createDataFrame([("k", t, n) for n, t in enumerate(times)], "key string, us long, seq int").select("key", F.timestamp_micros("us").alias("ts"), "seq")
    got = [x.accepted for x in rate_limited(df, ((60, 2),)).orderBy("seq").collect()]
    log = SlidingLog(((60, 2),))
    assert got == [log.accept(t) for t in times] == [True, True, False, True, True, False, True]


def test_small_expressions(spark):
    row = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert row(shortened(lit("abcdef"), 4)) == "abc…" and row(shortened(lit(None).cast("string"), 4)) == "—" and row(shortened(lit("abcd"), 4)) == "abcd"
    assert row(ocr.retry_needed(lit(0.5), lit(100))) and not row(ocr.retry_needed(lit(0.5), lit(200)))
    assert tuple(row(images.passive_liveness(lit(100.0), lit(50.0), lit(20.0), lit(9.0)))) == (55.4, True)
    assert tuple(row(images.combined_liveness(lit(80), lit(54)))) == (54, False)
    assert row(images.occlusion_score(lit(1), lit(0.1), lit(300.0), lit(0.05))) == (40 * 65 + 30 * 70 + 20 * 60 + 10 * 75) // 100
    face = spark.createDataFrame([(100, 50)], "width int, height int")
    assert tuple(images.face_region(face).first().face) == (0, 6, 30, 38)
    boxes = spark.createDataFrame([("a", 0.3), ("b", 0.31), ("c", None)], "text string, confidence double")
    assert [x.text for x in ocr.confident_boxes(boxes).collect()] == ["b"]


def test_engine_adapter(spark):
    def engine(frames):
        for f in frames:
            yield f.assign(side="front", pass_no=1, engine="none", text=f["doc_id"].astype(str), confidence=0.9)[["doc_id", "side", "pass_no", "engine", "text", "confidence"]]

    got = ocr.run_engine(spark.createDataFrame([(5,), (6,)], "doc_id long"), engine).collect()
    assert sorted((x.doc_id, x.text, x.confidence) for x in got) == [(5, "5", 0.9), (6, "6", 0.9)]


def test_card_texts_in_runs(spark, monkeypatch):
    monkeypatch.setattr(ocr, "RUN", 4)
    rows = [(1, s, n, f"{s}{n}") for n in range(20) for s in ("back", "front", None)] + [(1, "front", None, "no number"), (2, "back", 1, None), (1, "front", 3, "again")]
    df = spark.createDataFrame(rows, "doc_id int, side string, pass_no int, text string").repartition(5)
    got = {x.doc_id: x for x in ocr.card_texts(df).collect()}
    rank = {"front": 1, "back": 2, None: 9}
    order = sorted((x for x in rows if x[0] == 1), key=lambda x: (rank[x[1]], -1 if x[2] is None else x[2], x[3]))
    assert got[1].text == "\n".join(x[3] for x in order) and got[1].n_passes == len(order) and not got[1].ask_again
    assert (got[2].text, got[2].n_passes, got[2].ask_again) == ("", 1, True)


def test_drop_folder_to_log_once_each(spark, tmp_path):
    """Files of a drop folder become entries; a job that dies after writing a batch, or is started again, repeats none."""
    from docassay.sources.audit_log import read_audit_log
    from docassay.sources.submissions import stream_submissions
    from docassay.streaming import intake

    drop, log, state = tmp_path / "drop", str(tmp_path / "log"), str(tmp_path / "state")
    drop.mkdir()

    def upload(*names):
        for n in names:
            (drop / n).write_bytes(n.encode())

    keys = spark.createDataFrame([("good",), ("other",)], "api_key string")

    def start(die_after_writing=False):
        sides = stream_submissions(spark, str(drop)).withColumns({"api_key": F.when(F.col("submission_id") == "s3", "bad").otherwise("good"), "has_front": F.col("side") == "front"})
        passed = intake.admitted(sides, keys, F.lit("ok")).where("status = 200")
        entries = passed.select(F.col("submission_id").alias("report_id"), F.sha2("data", 256).alias("img_sha256"), F.lit("VERIFIED").alias("verdict"))
        query = intake.log_stream(entries, log, state)
        query.awaitTermination()
        if die_after_writing:  # the checkpoint never hears of the last batch
            last = max(Path(state, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
            last.unlink()
            for crc in Path(state, "commits").glob(f".{last.name}*"):
                crc.unlink()

    found = lambda: sorted(x.report_id for x in read_audit_log(spark, log).collect())
    assert found() == []
    upload("s1_front.png", "s1_back.png", "s2_front.jpg", "s3_front.png", "notes.txt")
    start(die_after_writing=True)
    assert found() == ["s1", "s2"]
    start()
    assert found() == ["s1", "s2"]
    upload("s4_front.png", "s5_selfie.png")
    start(die_after_writing=True)
    upload("s6_front.png")
    start()
    start()
    assert found() == ["s1", "s2", "s4", "s6"]
    assert {x.img_sha256 for x in read_audit_log(spark, log).where("report_id = 's6'").collect()} == {hashlib.sha256(b"s6_front.png").hexdigest()}
