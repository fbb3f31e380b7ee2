import datetime

import pytest
from corpus import DOCS, SCHEMA
from pyspark.sql import functions as F

from mnemora.operators import decisions, extraction, graph, trails
from mnemora.plans import answers, question
from mnemora.sources import files

FACTS = f"source_id string, target_id string, relation string, date_iso string, provenance array<{extraction.PROVENANCE}>"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    n, f = graph.build(*extraction.extract(spark.createDataFrame(DOCS, SCHEMA)))
    at = str(tmp_path_factory.mktemp("g"))
    files.save_graph(n, f, at, "parquet")
    return files.load_graph(spark, at, (n, f), "parquet")


@pytest.fixture(scope="module")
def ready(built, tmp_path_factory):
    return question.prepare(*built, str(tmp_path_factory.mktemp("ready")))


@pytest.fixture(scope="module")
def own(ready):
    return ready.steps


def names(found):
    return [] if found.decisions is None else [r.decision for r in found.decisions.orderBy("rank").collect()]


def test_parse():
    day = datetime.date
    assert question.parse("What was decided on 5th March 2024?").spans == [(day(2024, 3, 5), day(2024, 3, 5))]
    assert question.parse("between march 2024 and April 2, 2024").spans == [(day(2024, 3, 1), day(2024, 4, 2))]
    assert question.parse("from 2024-03-01 to sept 2024").spans == [(day(2024, 3, 1), day(2024, 9, 30))]
    assert "ends before" in question.parse("between April 2024 and March 2024").error
    assert question.parse("on 30 February 2024").error == "'30 February 2024' is not a valid date."
    assert question.parse("Vision 2030 plan").years == ["2030"] and question.parse("x").error is None
    assert question.parse("which decisions were proposed").kinds == ("PROPOSED",)
    assert question.parse("what is due").kinds == ("DUE",) and "MEETING" in question.parse("decisions").kinds and "PROPOSED" in question.parse("bus").kinds


@pytest.mark.parametrize(
    ("asked", "found"),
    [
        ("Why was the data science minor approved?", ["data science minor"]), ("What was decided on 20 March 2024?", ["purchase of a bus"]), ("Why did the Finance Committee reject the bus?", ["purchase of a bus"]),
        ("List all decisions between March 2024 and April 2024", ["data science minor", "purchase of a bus"]), ("Which decisions were rejected?", ["purchase of a bus"]), ("What is the deadline for the data science syllabus?", ["data science minor"]),
    ],
)
def test_answered(built, ready, asked, found):
    got = question.retrieve(*built, asked, prepared=ready)
    assert got.sufficient and got.reason is None and names(got) == found, got.reason
    assert not got.evidence.isEmpty() and got.entities.first().type == "DECISION"


@pytest.mark.parametrize(
    ("asked", "why"),
    [
        ("", "The question is empty."), ("???", "The question contains no searchable words."), ("What about the swimming pool in 2024?", "Question terms not found in the knowledge graph: swim, pool."),
        ("What was decided on 30 February 2024?", "'30 February 2024' is not a valid date."), ("What was decided between April 2024 and March 2024?", "The date range 'between April 2024 and March 2024' ends before it starts."),
        ("What happened?", "The question does not name a topic, an entity or a date to search for."), ("Did the Finance Committee approve the hostel?", "No decision matching the question is linked to Finance Committee."),
        ("What was decided on 1 January 2020?", "No decision with a matching dated event was found for 2020-01-01."), ("Who proposed the bus?", "No proposal is recorded for the matching decision."),
        ("What is the deadline for the bus?", "No action deadline is recorded for the matching decision."), ("Was the hostel approved on 5 March 2024?", "No decision with a matching dated event was found for 2024-03-05."),
        ("syllabus attendance minutes", None),
    ],
)
def test_not_answered(built, ready, asked, why):
    got = question.retrieve(*built, asked, prepared=ready)
    assert not got.sufficient and got.decisions is None
    assert why is None or got.reason == why


def test_limits(built, ready):
    for bad in ({"top_k": 0}, {"max_decisions": True}, {"min_coverage": 2}):
        with pytest.raises(ValueError):
            question.retrieve(*built, "bus", prepared=ready, **bad)
    with pytest.raises(TypeError):
        question.retrieve(*built, None)
    assert question.retrieve(built[0].limit(0), built[1].limit(0), "bus").reason == "The knowledge graph is empty."


def test_date_alone(built, ready):
    """No decision was made on that day, but a meeting was held."""
    got = question.retrieve(*built, "What happened on 7 May 2024?", prepared=ready)
    assert got.sufficient and names(got) == [] and got.matched_dates == ["2024-05-07"]
    assert {r.document_id for r in got.evidence.collect()} == {"D5"}
    assert [(r.type, r.name) for r in got.entities.collect()] == [("MEETING", "Library Committee meeting on 7 May 2024"), ("DATE", "2024-05-07")]
    said = answers.answer(*built, "What happened on 7 May 2024?", prepared=ready)
    assert said.sufficient and said.text.splitlines()[1].startswith("- ") and said.text.endswith("[S1]")


def test_evidence_order(built, ready):
    rows = question.retrieve(*built, prepared=ready, question="Why was the data science minor approved?").evidence.collect()
    assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 12
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True) and "because" in rows[0].evidence


def test_answers(built, ready):
    got = answers.answer(*built, "Why was the data science minor approved?", prepared=ready)
    lines = got.text.splitlines()
    assert lines[0] == answers.RULES_NOTICE and lines[1] == "Decision: data science minor (status: approved)" and lines[2].startswith("  1. 2024-03-05 | APPROVED | ") and lines[2].endswith("]")
    assert got.sufficient and got.mode == "rules" and not got.model_used and got.steps.count() == 6
    labels = [r.label for r in got.sources.collect()]
    assert labels == [f"S{i + 1}" for i in range(len(labels))]
    no = answers.answer(*built, "What about the swimming pool?", prepared=ready)
    assert not no.sufficient and no.text.startswith(answers.INSUFFICIENT) and "pool" in no.text
    assert answers.answer(*built, " ").text.endswith("(empty question)")


def test_answers_by_a_model(built, ready):
    class Model:
        name = "m"

        def __init__(self, said):
            self.said = said

        def generate_json(self, prompt, system=None):
            assert "QUESTION" in prompt and "[S1]" in prompt
            if isinstance(self.said, Exception):
                raise self.said
            return self.said

    ask = lambda said: answers.answer(*built, "Why was the bus rejected?", model=Model(said), prepared=ready)
    good = ask({"answer": "Costs [S1].", "used_sources": "[s1]"})
    assert good.model_used and good.text == "Costs [S1]." and [r.label for r in good.sources.collect()] == ["S1"]
    loose = ask({"answer": "Costs.", "used_sources": ["S99"]})
    assert loose.model_used and any("cite" in w for w in loose.warnings) and loose.sources.count() >= 1
    none = ask({"answer": "Unclear.", "sufficient_evidence": False})
    assert not none.sufficient and none.model_used
    for bad in (RuntimeError("down"), {"answer": " "}, {"answer": ["x"]}):
        failed = ask(bad)
        assert failed.error and failed.text.startswith(answers.RETRIEVED_NOTICE) and not failed.model_used


def test_events_links_related(spark, built, own):
    n, f = built
    got = {tuple(r) for r in decisions.events(n, f, own).collect()}
    assert ("DECISION:data science minor", "DUE", "2024-04-30") in got and ("DECISION:data science minor", "MEETING", "2024-03-05") in got and ("DECISION:purchase of a bus", "REJECTED", "2024-03-20") in got
    linked = {tuple(r) for r in decisions.links(n, f).collect()}
    assert {("DECISION:data science minor", e) for e in ("PERSON:ben cole", "COMMITTEE:academic council", "ORGANIZATION:green valley college", "DEPARTMENT:registrar department", "MEETING:academic council meeting on 5 march 2024")} <= linked
    more = spark.createDataFrame([("DECISION:a", "DECISION:b", "FOLLOWS_UP", None, []), ("DECISION:a", "ACTION:x", "LED_TO", None, []), ("DECISION:c", "ACTION:x", "LED_TO", None, [])], FACTS)
    nodes = spark.createDataFrame([(f"DECISION:{x}", x, "DECISION", False) for x in "abc"], "id string, name string, type string, source_document boolean")
    some = spark.createDataFrame([("DECISION:a",), ("DECISION:b",)], "decision_id string")
    assert {tuple(r) for r in decisions.related(nodes, more, some).collect()} == {("DECISION:a", "DECISION:b"), ("DECISION:a", "DECISION:c"), ("DECISION:b", "DECISION:a")}


def test_decisions_by_date(built, own):
    n, f = built
    all_, dated = trails.trails(n, f, own), decisions.events(n, f, own)
    on = lambda *a: [r.decision for r in decisions.on_date(all_, dated, *a).collect()]
    assert on("2024-03-05") == ["data science minor"] and on("2024-04-30") == [] and on("2024-04-30", "due") == ["data science minor"] and on("2024") == ["data science minor", "purchase of a bus"]
    rng = lambda *a: [r.decision for r in decisions.in_range(all_, dated, *a).collect()]
    assert rng("2024-03-15", "2024-03") == ["purchase of a bus"] and rng() == ["data science minor", "purchase of a bus", "new hostel plan"] and rng(None, "2024-03-10") == ["data science minor"]
    for bad in (lambda: on("2024-3-5"), lambda: on("2024-02-30"), lambda: on("2024", "x"), lambda: rng("2024-05", "2024-04")):
        with pytest.raises(ValueError):
            bad()
    near = {(r.type, r.relation) for r in decisions.entities_on(n, f, "2024-03-05").collect()}
    assert near == {("MEETING", "HELD_ON"), ("DECISION", "DECIDED_ON")}
    assert decisions.entities_on(n, f, "2024-04").where(F.col("type") == "ACTION").count() == 1


def test_history(spark, built):
    """A decision that follows another up is shown with it if the history is asked for."""
    n, f = built
    more = f.unionByName(spark.createDataFrame([("DECISION:new hostel plan", "DECISION:purchase of a bus", "FOLLOWS_UP", None, [])], FACTS))
    both = question.prepare(n, more)
    assert names(question.retrieve(n, more, "What is the history of the bus?", prepared=both)) == ["purchase of a bus", "new hostel plan"]
    assert names(question.retrieve(n, more, "What about the bus?", prepared=both)) == ["purchase of a bus"]
