import re

from pyspark.sql import functions as F

from clerkwise.functions import codec, dates, rendering, scores, text
from clerkwise.functions.once import compute_once
from clerkwise.plans.process import extract_fields
from tests.helpers import column, docs, one, rows, ts

SAMPLE = ("Building Permit\nApplicant: John Doe\nAddress: 12 Main Street\nParcel Number: P-1234\nDate: 02/07/2026\n"
          "Case No: C-99887\nFee $1,250.50\nmail to clerk@city.gov")


def fields(spark, value):
    df = spark.createDataFrame([(value,)], "text string")
    return extract_fields(df).first().asDict()


def test_fields_of_a_permit(spark):
    got = fields(spark, SAMPLE)
    assert got["applicant_name"] == "John Doe"
    assert got["address"] == "12 Main Street"
    assert got["parcel_number"] == "P-1234"
    assert got["date"] == "02/07/2026"
    assert got["case_number"] == "C-99887"
    assert got["amount"] == "1,250.50"
    assert got["email"] == "clerk@city.gov"


def test_fields_absent_blank_and_unicode(spark):
    assert all(v is None for k, v in fields(spark, "nothing here").items() if k != "text")
    assert fields(spark, "Address:         \nx")["address"] == ""
    # No-break space after the label; dotted and dotless i, long s count as letters of the label.
    assert fields(spark, "applicant: Ann Lee")["applicant_name"] == "Ann Lee"
    assert fields(spark, "applıcant: Ann Lee")["applicant_name"] == "Ann Lee"
    assert fields(spark, "addreſs: 12 Main St")["address"] == "12 Main St"


def test_gated_fields_equal_plain_python(spark):
    texts = [SAMPLE, SAMPLE.upper(), "owner - Al B.\nfiled: March 3, 2024", "total 12", "caseid: ABCD", "name:x", "", "parcel:1234-5678"]
    for value in texts:
        got = fields(spark, value)
        for name, pattern in text.FIELD_PATTERNS.items():
            flags = re.I if pattern.startswith("(?iU)") else 0
            found = re.search(pattern.removeprefix("(?iU)"), value, flags)
            assert got[name] == (found.group(1).strip() if found else None), (name, value)


def test_mask_pii(spark):
    got = column(spark, ["to a.b@c.org or x@y.co", "key cs_ABCDEFGHIJK1 end", "cs_short", None], text.mask_pii)
    assert got == ["to ***@c.org or ***@y.co", "key cs_***redacted*** end", "cs_short", None]


def test_names(spark):
    assert column(spark, ["a/b/Doc.TXT", "noext", ".hidden", "x.tar.gz", "end."], text.extension) == ["txt", "", "", "gz", ""]
    assert column(spark, ["a/b/c.txt", "dir/sub/"], text.basename) == ["c.txt", "sub"]
    assert column(spark, ["a.pdf", "b.JPG", "c.zip"], text.mime_guess) == ["application/pdf", "image/jpeg", None]
    assert column(spark, ["  Permit / Type-A!! ", "__x__", " \t"], text.doc_type_key) == ["permit_type_a", "x", ""]
    assert column(spark, ["City Hall!", " A--b ", "!!!", None, "x" * 80], lambda c: text.slug_base(c, 64)) == ["city-hall", "a-b", "workspace", "workspace", "x" * 64]


def test_classification_confidence_equals_python(spark):
    cases = [(h, n) for n in range(1, 13) for h in range(0, n + 1)]
    df = spark.createDataFrame(cases, "h int, n int")
    for h, n, got in rows(df.select("h", "n", scores.classification_confidence(F.col("h"), F.col("n")))):
        if h == 0:
            want = 0.45
        elif h == 1:
            want = 0.65 + h / n * 0.08
        elif h == 2:
            want = 0.78 + h / n * 0.08
        else:
            want = 0.86 + min((h - 3) * 0.03, 0.1)
        assert got == round(min(want, 0.99), 4), (h, n)


def test_review_flag_at_the_threshold(spark):
    def flag(confidence, errors, doc_type="x", **options):
        return one(spark, y=scores.needs_review(F.lit(confidence), F.lit(errors), F.lit(doc_type), **options))["y"]

    assert not flag(0.82, 0)
    assert flag(0.8199, 0)
    assert flag(0.99, 1)
    assert flag(0.99, 0, "Secret", forced=["secret"])
    assert not flag(0.99, 0, "open", forced=["secret"])
    assert one(spark, y=scores.penalised_confidence(F.lit(0.9), F.lit(0.95), F.lit(9)))["y"] == 0.9 - 0.35


def test_urgency(spark):
    got = column(spark, ["emergency filing with an immediate deadline", "standard letter", "URGENT".lower()], scores.urgency)
    assert got == ["high", "normal", "high"]


def test_dates(spark):
    now = dates.instant("2024-03-10 12:00:00")

    def late(due):
        return one(spark, y=dates.days_overdue(F.lit(due).cast("timestamp"), now))["y"]

    assert late("2024-03-09 12:00:00") == 1
    assert late("2024-03-09 12:00:01") == 0
    assert late("2024-03-20 00:00:00") == 0
    assert late(None) == 0
    got = [one(spark, y=dates.age_label(F.lit(t).cast("timestamp"), now))["y"] for t in
           ("2024-03-10 11:59:01", "2024-03-10 11:59:00", "2024-03-10 10:59:59", "2024-03-08 12:00:00", None)]
    assert got == ["just now", "1m ago", "1h ago", "2d ago", ""]
    assert one(spark, y=dates.due_date(F.lit(None).cast("timestamp"), F.lit(2), now))["y"] == ts("2024-03-12 12:00:00")
    assert one(spark, y=dates.due_date(now, F.lit(None).cast("int"), now))["y"] is None
    assert one(spark, y=dates.iso_utc(dates.instant("2024-01-02 03:04:05.5")))["y"] == "2024-01-02T03:04:05.500000+00:00"
    assert one(spark, y=dates.money(F.lit(123456)))["y"] == "$1234.56"


def test_letter_replaces_in_order_and_fields_win(spark):
    df = docs(spark, {"doc_type": None, "filename": "{{status}}"}).withColumn("extracted_fields", F.create_map(*[
        F.lit(x) for x in ("urgency", "own", "extra", "{{later}}", "later", "L")]))
    body = F.lit("{{filename}}|{{doc_type}}|{{urgency}}|{{extra}}|{{unknown}}")
    got = df.select(rendering.render(body, rendering.letter_context(), F.col("extracted_fields"))).first()[0]
    # The file name spells a later placeholder, which is then replaced as well.
    assert got == "needs_review|None|own|L|{{unknown}}"


def test_event_text_prints_missing_and_zero_as_nothing(spark):
    df = docs(spark, {"confidence": 0.0}, {"confidence": 0.0005, "due_date": ts("2024-05-06 07:08:09")}, {"confidence": 0.5})
    body = F.lit("{{confidence}}|{{doc_type}}|{{due_date}}")
    got = rows(df.select("id", rendering.render(body, rendering.event_context(), F.col("extracted_fields"))), "id")
    assert [g[1] for g in got] == ["||", "0.0005||2024-05-06T07:08:09+00:00", "0.5||"]


def test_recipient_needs_a_shape_but_contact_only_some_text(spark):
    df = docs(spark, {"extracted_fields": {"applicant_email": "not an address", "email": " a@b.c "}}, {"extracted_fields": {"contact_email": "  "}},
              {"extracted_fields": {"sender_email": "call me"}})
    got = rows(df.select("id", rendering.recipient(F.col("extracted_fields")), rendering.has_contact(F.col("extracted_fields"))), "id")
    assert got == [("d0", "a@b.c", True), ("d1", None, False), ("d2", None, True)]


def test_codec_and_options(spark):
    assert column(spark, ['{"a": 1}', "{bad", "", None], lambda c: F.size(codec.json_object(c))) == [1, 0, 0, 0]
    wants = column(spark, [None, '{"doc_assigned": false}', '{"doc_assigned": true}', "nonsense"], lambda c: codec.wants_mail(c, "doc_assigned"))
    assert wants == [True, False, True, True]
    merged = column(spark, ['{"doc_digest": false}'], lambda c: codec.updated_mail_options(c, F.lit('{"doc_assigned": false, "zzz": true}')))[0]
    assert merged["doc_digest"] == "false" and merged["doc_assigned"] == "false" and "zzz" not in merged


def test_computed_once_is_not_crossed_by_a_filter(spark):
    df = compute_once(spark.range(5).withColumn("t", F.col("id").cast("string")), {"r": F.regexp_extract("t", "([0-3])", 1)})
    out = df.filter("r <> ''")
    assert out.count() == 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1


def test_decimal_text_matches_python(spark):
    values = [0.0001, 0.0007, 0.001, 0.25, 0.1234, 0.9, 0.0]
    got = column(spark, values, rendering.decimal_text, "double")
    assert got == [str(v) if v else None for v in values]
