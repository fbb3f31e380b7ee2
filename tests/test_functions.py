import datetime

import pytest
from pyspark.sql import functions as F

from mnemora.functions import dates, lexicon, records, text


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(("word", "want"), [("policies", "policy"), ("committees", "committe"), ("approved", "approv"), ("approve", "approv"), ("planned", "plan"), ("planning", "plan"), ("class", "class"), ("status", "status"), ("speed", "speed"), ("the", "the"), ("a1s", "a1s"), ("boxes", "box")])
def test_stem(spark, word, want):
    assert one(spark, text.stem, word) == want


def test_tokens(spark):
    assert one(spark, text.tokenize, "The Board's plan_A, n° 7!") == ["the", "board", "plan", "a", "n", "7"]
    assert one(spark, text.content_tokens, "Why did the Council approve the plans?") == ["council", "approv", "plan"]
    assert one(spark, text.tokenize, None) == []


def test_names(spark):
    assert one(spark, lambda c: text.normalize_name(c, F.lit("PERSON")), " Prof. Dr. Asha  Rao. ") == "asha rao"
    assert one(spark, text.display_name, "The Academic Council.") == "Academic Council"
    assert one(spark, text.display_name, "John B.") == "John B."
    assert one(spark, lambda c: text.entity_id(F.lit("DATE"), c, F.lit("2024-03")), "March 2024") == "DATE:2024-03"


def test_support_and_quotes(spark):
    assert one(spark, lambda c: text.text_supports(F.lit("data science minor"), c), "a minor in data things")
    assert not one(spark, lambda c: text.text_supports(F.lit("the of"), c), "the of")
    assert one(spark, lambda c: text.quoted(F.lit("Data, Science"), c), "the data science minor")
    assert not one(spark, lambda c: text.quoted(F.lit("data"), c), "data")


def test_chunks(spark):
    assert one(spark, lambda c: text.word_chunks(c, 2), "a b  c\nd e") == ["a b", "c d", "e"]
    assert one(spark, text.word_chunks, "") == []
    with pytest.raises(ValueError):
        text.word_chunks(F.lit("a"), 0)
    long = "One two three. " * 30
    got = one(spark, lambda c: text.paragraph_chunks(c, 200), f"Head\n\n{long}\n\nTail")
    assert all(len(c) <= 200 for c in got) and got[0].startswith("Head") and got[-1].endswith("Tail")
    assert one(spark, lambda c: text.paragraph_chunks(c, 200), "x" * 450) == ["x" * 200, "x" * 200, "x" * 50]
    assert one(spark, text.sentences, "Dr. Rao met us. It went well! 'Yes.' ok") == ["Dr. Rao met us.", "It went well!", "'Yes.' ok"]


@pytest.mark.parametrize(("said", "want"), [("on 5 March 2024.", "2024-03-05"), ("Sept. 3rd, 2021", "2021-09-03"), ("March 2024", "2024-03"), ("2024-02-30", None), ("30 Feb 2024", None), ("february 2024", None), ("2024-03-05 and 2023-01-01", "2024-03-05"), ("", None), (None, None)])
def test_parse_date(spark, said, want):
    assert one(spark, dates.parse_date, said) == want


def test_spans(spark):
    d = datetime.date
    assert one(spark, dates.span_end, "2024-02") == d(2024, 2, 29) and one(spark, dates.span_end, "2023") == d(2023, 12, 31)
    assert one(spark, dates.span_start, "2024-13") is None
    assert not one(spark, lambda c: dates.within(c, F.lit(d(2024, 2, 3)), F.lit(d(2024, 2, 3))), "2024-02")
    assert one(spark, lambda c: dates.dates_conflict(c, F.array(F.lit("2024-03-05"))), ["2024-04"], "array<string>")
    assert not one(spark, lambda c: dates.dates_conflict(c, F.array(F.lit("2024-03-05"))), ["2024-03"], "array<string>")


def test_records(spark):
    assert one(spark, records.metadata, '{"k": 1}') == {"k": "1"} and one(spark, records.metadata, "{bad") == {}
    assert one(spark, records.optional, " N/A ") is None and one(spark, records.optional, " x  y ") == "x y"
    assert one(spark, records.entity_type, "action-item") == "ACTION" and one(spark, records.entity_type, "thing") is None
    assert one(spark, records.relation_type, "resulted in") == "LED_TO" and one(spark, records.relation_type, None) == "RELATED_TO"
    assert one(spark, lambda c: records.loose_json(c), 'Sure: {"a": [1,2,],} done') is not None
    assert one(spark, lambda c: records.loose_json(c), "no json") is None


def test_directions(spark):
    want = {("ATTENDED", "PERSON", "MEETING"): "ok", ("ATTENDED", "MEETING", "PERSON"): "flip", ("HELD_ON", "PERSON", "DATE"): "invalid", ("RELATED_TO", "DATE", "DATE"): "ok"}
    df = spark.createDataFrame(list(want), "r string, s string, t string").select("*", records.direction(F.col("r"), F.col("s"), F.col("t")).alias("d"))
    assert {(x.r, x.s, x.t): x.d for x in df.collect()} == want
    assert len(lexicon.RELATION_RULES) == 20 and len(lexicon.ENTITY_TYPES) == 11
