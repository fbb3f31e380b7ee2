import json

import pytest
from pyspark.sql import functions as F

from mnemora.config import Config
from mnemora.functions import text
from mnemora.operators import graph, grounding
from mnemora.sources import models

BODY = "The Library Committee met on January 9, 2023. The Library Committee approved longer opening hours on January 9, 2023 because students asked for them. Ms. Ida Holm was tasked with a new plan."
QUOTE = "The Library Committee approved longer opening hours on January 9, 2023 because students asked for them."
GOOD = {
    "entities": [
        {"name": "Library Committee", "type": "board", "evidence": "The Library Committee met on January 9, 2023."}, {"name": "the longer opening hours", "type": "DECISION", "date": "January 9, 2023", "evidence": QUOTE},
        {"name": "Space Program", "type": "DECISION"}, {"name": "January 9, 2023", "type": "DATE"}, {"name": "May 1, 1999", "type": "DATE"}, {"name": "soon", "type": "DATE"}, {"name": "null", "type": "PERSON"}, {"name": "X", "type": "planet"},
        {"name": "students asked for them", "type": "REASON", "date": "1 May 1999", "evidence": "a quote that nobody made"},
    ],
    "relations": [
        {"source": "longer opening hours", "relation": "approved", "target": "Library Committee", "date": "January 9, 2023", "evidence": QUOTE},
        {"source": "Library Committee", "relation": "REJECTED_BY", "target": "longer opening hours", "evidence": QUOTE[:70]},
        {"source": "longer opening hours", "relation": "DECIDED_ON", "target": "January 9, 2023", "evidence": QUOTE},
        {"source": "longer opening hours", "relation": "JUSTIFIED_BY", "target": "Library Committee", "evidence": QUOTE},
        {"source": "Library Committee", "relation": "RELATED_TO", "target": "Library Committee", "evidence": QUOTE},
        {"source": "longer opening hours", "relation": "LED_TO", "target": "nothing known", "evidence": QUOTE},
        {"source": "new plan", "source_type": "ACTION", "relation": "ASSIGNED_TO", "target": "Ms. Ida Holm", "target_type": "PERSON", "evidence": "Ms. Ida Holm was tasked with a new plan."},
        {"source": "new plan", "relation": "likes", "target": "Ida Holm", "evidence": "none of that"}, {"source": "n/a", "relation": "PART_OF", "target": "x"},
    ],
}
PAYLOADS = [json.dumps(GOOD), "no json", "[1]", '{"entities": 3, "relationships": "x"}', "{}", None]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    rows = [("D", "d.txt", 1, f"D-c{i}", BODY, p) for i, p in enumerate(PAYLOADS)] + [("E", "e.txt", None, "E-c1", "  ", PAYLOADS[0])]
    payloads = spark.createDataFrame(rows, "document_id string, filename string, page int, chunk_id string, text string, payload string")
    out, at = grounding.ground(payloads), str(tmp_path_factory.mktemp("g"))
    parts = []
    for name in ("entities", "relations", "errors", "warnings"):
        getattr(out, name).write.parquet(f"{at}/{name}")
        parts.append(spark.read.parquet(f"{at}/{name}"))
    return payloads, grounding.Grounded(*parts)


def test_ground(found):
    _, g = found
    assert [r.id for r in g.entities.orderBy("place").collect()] == ["COMMITTEE:library committee", "DECISION:longer opening hours", "DATE:2023-01-09", "REASON:students asked for them", "ACTION:new plan", "PERSON:ida holm"]
    e = {r.id: r for r in g.entities.collect()}
    assert e["DECISION:longer opening hours"].date_iso == "2023-01-09" and e["DATE:2023-01-09"].aliases == ["January 9, 2023"] and e["REASON:students asked for them"].evidence is None
    got = [(r.source_id, r.relation, r.target_id, r.date_iso) for r in g.relations.orderBy("place").collect()]
    d, c = "DECISION:longer opening hours", "COMMITTEE:library committee"
    assert got == [(d, "APPROVED_BY", c, "2023-01-09"), (d, "REJECTED_BY", c, None), (d, "DECIDED_ON", "DATE:2023-01-09", None), ("ACTION:new plan", "ASSIGNED_TO", "PERSON:ida holm", None)]


def test_errors_and_warnings(found):
    _, g = found
    errors = {(r.chunk_id, r.message) for r in g.errors.collect()}
    own = {m for c, m in errors if c == "D-c0"}
    assert own == {
        "entity 'Space Program': not supported by source text; dropped", "entity 'May 1, 1999': date not found in source text; dropped", "entity 'soon': unparseable date; dropped", "entities[6] invalid: name: name is required",
        "entities[7] invalid: type: unknown entity type", "relationship 'longer opening hours' -JUSTIFIED_BY-> 'Library Committee': incompatible entity types (DECISION -> COMMITTEE); dropped",
        "relationship 'Library Committee' -RELATED_TO-> 'Library Committee': self-loop; dropped", "relationship 'longer opening hours' -LED_TO-> 'nothing known': endpoint not found among extracted entities; dropped",
        "relationship 'new plan' -RELATED_TO-> 'Ida Holm': no verifiable evidence in source text; dropped", "relationships[8] invalid: source: endpoint name is required",
    }
    assert {(c, m) for c, m in errors if c != "D-c0"} == {("D-c1", "payload is not a JSON object"), ("D-c2", "payload is not a JSON object"), ("D-c3", "'entities' is not a list"), ("D-c3", "'relationships' is not a list"), ("D-c4", "payload has no 'entities' list"), ("D-c5", "payload is not a JSON object")}
    warned = {r.message for r in g.warnings.collect()}
    assert warned == {
        "entity 'students asked for them': date '1 May 1999' not found in source text; ignored", "entity 'students asked for them': evidence quote not found in source text; ignored", "empty chunk skipped",
        "relationship 'Library Committee' -REJECTED_BY-> 'longer opening hours': direction corrected", "relationship 'new plan' -RELATED_TO-> 'Ida Holm': evidence quote not found in source text; ignored",
    }


def test_merge_and_summary(spark, found):
    payloads, g = found
    nodes, facts = graph.build(*grounding.merged(g))
    assert nodes.where("type = 'DOCUMENT'").count() == 1 and facts.where("relation <> 'MENTIONED_IN'").count() == 4
    failed = spark.createDataFrame([("E", "E-c1", "model unavailable: x", True)], "document_id string, chunk_id string, message string, unavailable boolean")
    got = {r.document_id: r for r in grounding.summaries(payloads, g, failed).collect()}
    assert got["D"].ok and got["D"].chunks_processed == 6 and len(got["D"].errors) == 16 and got["D"].mode == "real"
    assert not got["E"].ok and got["E"].errors == ["model unavailable: x"] and got["E"].warnings == ["empty chunk skipped"]


def test_near_verbatim(spark):
    from difflib import SequenceMatcher

    said = "the quick brown fox jumps over the lazy dog near the old mill"
    quotes = ["fox", "", None, "Quick, brown FOX", "quick brown fox leaps over the lazy dog", "brown fox jumps over the lazy cat", "a brown fox jumps over the lazy dog", "quick brown fox jumps over the lazy dog nearby"]

    def near(q):
        e = text_normal(q or "")
        if len(e.split()) < 2:
            return False
        return e in said or SequenceMatcher(None, e, said, autojunk=False).find_longest_match(0, len(e), 0, len(said)).size / len(e) >= 0.85

    def text_normal(q):
        import re

        return re.sub(r"[\W_]+", " ", q.lower()).strip()

    rows = spark.createDataFrame([(i, q) for i, q in enumerate(quotes)], "i int, q string").select("i", text.quoted(F.col("q"), F.lit(said)).alias("ok")).collect()
    assert {r.i: r.ok for r in rows} == {i: near(q) for i, q in enumerate(quotes)}


def test_model_payloads(spark):
    def make(config):
        def send(path, body):
            if "second" in body["messages"][-1]["content"]:
                raise models.Unavailable("gone")
            return {"message": {"content": 'Sure: ```json\n{"entities": [],}\n```'}}

        return models.Model(config, send)

    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(["first", "second", "third"])], "chunk_id string, text string").coalesce(1)
    got = models.payloads(chunks, Config(), make).orderBy("chunk_id").collect()
    assert [r.payload for r in got] == ['{"entities": []}', None, None] and [r.unavailable for r in got] == [False, True, True] and "gone" in got[2].failure
