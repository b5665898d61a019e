from clerkwise.operators.replies import flatten_ocr, normalise_enrichment, normalise_replies, with_payload
from clerkwise.operators.rules import literal_rules


def test_payload(spark):
    values = ['{"a": 1}', '```json\n{"a": 2}\n```', 'text {"a": {"b": 3}} more', "none", "[1]", '{"a": 1} {"b": 2}', "", None, "{bad"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    got = [r["y"] for r in with_payload(df, "x", "y").orderBy("i").collect()]
    assert got[0] == '{"a": 1}'
    assert got[1].strip() == '{"a": 2}'
    assert got[2] == '{"a": {"b": 3}}'
    assert got[3:] == [None] * 6


def replies(spark, *values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, reply string")
    return normalise_replies(df, literal_rules(), keywords=20).orderBy("i").collect()


def test_classifier_reply(spark):
    words = ", ".join(f'"w{i}"' for i in range(30))
    got = replies(spark, f'{{"doc_type": " COMPLAINT ", "confidence": 1.5, "urgency": "High", "matched_keywords": [{words}], "rationale": 7}}',
                  '{"doc_type": null, "confidence": "x", "urgency": "soon", "department": "Desk"}', '{"confidence": -1}', "{}")
    assert (got[0]["reply_doc_type"], got[0]["reply_confidence"], got[0]["reply_urgency"]) == ("complaint", 0.99, "high")
    assert len(got[0]["reply_keywords"]) == 20 and got[0]["reply_rationale"] == "7"
    assert (got[1]["reply_doc_type"], got[1]["reply_confidence"], got[1]["reply_urgency"], got[1]["reply_department"]) == ("other", 0.0, "normal", "Desk")
    assert got[2]["reply_confidence"] == 0.0 and got[2]["reply_department"] == "General Intake"
    assert got[3]["reply_doc_type"] == "other"


def test_enrichment(spark):
    df = spark.createDataFrame([
        (0, '{"fields": {" address ": " 1 Elm ", "date": "N/A", "zzz": "1", "contact_email": "a@b.c", "parcel_number": null}, "confidence": 2}', ["address", "date", "parcel_number"]),
        (1, '{"address": "%s", "confidence": 0.5}' % ("x" * 300), ["address"]), (2, '{"fields": null, "address": "y"}', ["address"]), (3, "?", ["address"]),
    ], "i int, reply string, required_fields array<string>")
    got = {r["i"]: r for r in normalise_enrichment(df, longest=240).collect()}
    assert normalise_enrichment(df).filter("i = 1").first()["enriched_fields"] == {"address": "x" * 300}
    assert got[0]["enriched_fields"]["contact_email"] == "a@b.c" and "zzz" not in got[0]["enriched_fields"]
    assert "date" not in got[0]["enriched_fields"] and "parcel_number" not in got[0]["enriched_fields"]
    assert got[0]["enriched_confidence"] == 0.99
    assert got[1]["enriched_fields"] == {"address": "x" * 240}
    assert got[2]["enriched_fields"] == {} and got[3]["enriched_fields"] == {}


def test_ocr(spark):
    df = spark.createDataFrame([
        (0, '{"content": " a ", "documents": [{"confidence": 0.5}, {"confidence": 0.8}]}'),
        (1, '{"pages": [{"lines": [{"content": "l1"}, {"content": null}]}, {"lines": [{"content": "l2"}]}]}'), (2, '{"content": ""}'), (3, "x"),
    ], "i int, reply string")
    got = [(r["ocr_text"], r["ocr_confidence"]) for r in flatten_ocr(df).orderBy("i").collect()]
    assert got == [("a", 0.65), ("l1\nl2", 0.92), (None, None), (None, None)]
