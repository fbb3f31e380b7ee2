import json
import os

import pytest
from pyspark.sql import functions as F

from mnemora.operators import extraction, graph, search, trails
from mnemora.plans import question
from mnemora.sources import files
from mnemora.sources.store import Store
from mnemora.streaming import ingest

DOCS = [
    ("D1", "a.txt", ["Minutes.\n\nThe Academic Council of Green Valley College met on 5 March 2024. The meeting was chaired by Dr. Asha Rao. Prof. Ben Cole and Dr. Lina Das attended. Prof. Ben Cole proposed the introduction of a data science minor. The Academic Council approved the introduction of a data science minor on 5 March 2024 because industry demand is rising. The Registrar Department was tasked with publishing the syllabus to implement the decision by 30 April 2024.", "The Academic Council deferred the new hostel plan because funds were short."], None),
    ("D2", "b.txt", None, "The Board of Governors met on April 2, 2024. The Board of Governors approved the data science minor on April 2, 2024 because the budget allows it."),
    ("D3", "c.txt", None, "The Finance Committee met on 2024-03-20. The Finance Committee rejected the purchase of a bus because costs exceed the budget."),
    ("D4", "d.txt", None, None),
]
SCHEMA = "document_id string, filename string, pages array<string>, text string"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    n, f = graph.build(*extraction.extract(spark.createDataFrame(DOCS, SCHEMA)))
    at = str(tmp_path_factory.mktemp("g"))
    files.save_graph(n, f, at)
    return files.load_graph(spark, at, (n, f))


def test_extraction(built):
    n, f = built
    assert {r.type: r.n for r in n.groupBy("type").agg(F.count("*").alias("n")).collect()} == {"PERSON": 3, "ORGANIZATION": 1, "COMMITTEE": 3, "DEPARTMENT": 1, "MEETING": 3, "DECISION": 3, "REASON": 4, "ACTION": 1, "DATE": 4, "DOCUMENT": 3}
    got = {(r.source_id, r.relation, r.target_id) for r in f.collect()}
    assert ("COMMITTEE:academic council", "PART_OF", "ORGANIZATION:green valley college") in got
    assert ("DECISION:data science minor", "LED_TO", "ACTION:publishing the syllabus to implement the decision") in got
    assert ("ACTION:publishing the syllabus to implement the decision", "DUE_ON", "DATE:2024-04-30") in got
    assert all(p.evidence for r in f.collect() for p in r.provenance)


def test_trails(built):
    status = {r.decision: (r.status, r.first_date) for r in trails.trails(*built).collect()}
    assert status == {"data science minor": ("approved", "2024-03-05"), "new hostel plan": ("deferred", None), "purchase of a bus": ("rejected", "2024-03-20")}
    own = trails.steps(*built).where("decision = 'data science minor'").orderBy("step_no").collect()
    assert [(r.kind, r.date_iso) for r in own] == [("APPROVED", "2024-03-05"), ("APPROVED", "2024-04-02"), ("PROPOSED", None), ("REASON", None), ("REASON", None), ("ACTION", None)]
    assert own[0].meeting == "Academic Council meeting on 5 March 2024" and "due 2024-04-30" in own[-1].description
    assert [r.decision for r in trails.between(trails.steps(*built), "2024-03-15", "2024-03").collect()] == ["purchase of a bus"]


def test_paths_and_neighbors(built):
    e = graph.structural(*built)
    assert graph.find_path(e, "PERSON:ben cole", "PERSON:lina das") == ["PERSON:ben cole", "MEETING:academic council meeting on 5 march 2024", "PERSON:lina das"]
    assert graph.find_path(e, "PERSON:ben cole", "nobody") is None and graph.find_path(e, "x", "x") == ["x"]
    near = graph.neighbors(*built, "PERSON:lina das", direction="out", relation="ATTENDED").collect()
    assert [r.type for r in near] == ["MEETING"]
    with pytest.raises(KeyError):
        graph.neighbors(*built, "nobody")
    assert graph.find_entities(built[0], "data science minor").first().id == "DECISION:data science minor"
    assert graph.find_entities(built[0], "").count() == 0


def test_questions(built):
    why = question.answer(*built, "Why was the data science minor approved?").collect()
    assert {r.decision for r in why} == {"data science minor"} and all(r.sufficient for r in why) and any("because" in e for r in why for e in r.evidence)
    assert question.answer(*built, "What happened on 30 February 2024?").count() == 0


def test_empty_graph(spark, built):
    n, f = (x.limit(0) for x in built)
    assert trails.trails(n, f).count() == 0 and question.answer(n, f, "why?").count() == 0


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.initialize()
    rows = spark.createDataFrame([(" a.txt ", "100% License"), ("b.txt", "other"), ("  ", "x")], "filename string, content string")
    assert sorted(r.id for r in s.append("documents", rows).collect()) == [1, 2]
    assert s.update_document(1, title="T") and not s.update_document(9, title="T") and not s.update_document(1)
    assert [r.filename for r in search.search_documents(s.read("documents"), "license").collect()] == ["a.txt"]
    assert search.search_documents(s.read("documents"), "1_0%lic").count() == 1 and search.search_documents(s.read("documents"), " ").count() == 0
    s.append("entities", spark.createDataFrame([("E", "PERSON", 1)], "name string, entity_type string, document_id bigint"))
    s.append("decisions", spark.createDataFrame([("D", 1)], "title string, document_id bigint"))
    assert s.delete_document(1) and not s.delete_document(1)
    assert s.read("entities").count() == 0 and s.read("decisions").first().document_id is None
    assert [r.id for r in s.append("documents", rows.limit(1)).collect()] == [3]
    with pytest.raises(ValueError):
        s.append("entities", rows.select(F.col("filename").alias("name")))


def test_stream_and_files(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "d.json").write_text(json.dumps({"document_id": "D3", "filename": "c", "text": DOCS[2][3]}))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "e.json").write_text(json.dumps({"document_id": "D9", "filename": "e", "text": DOCS[2][3]}))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/nodes")).where("type = 'DECISION'").count() == 2
    nodes, facts = ingest.graph(spark, str(tmp_path / "out"))
    one = nodes.where("type = 'DECISION'").collect()
    assert len(one) == 1 and one[0].aliases == [] and {p.document_id for p in one[0].provenance} == {"D3", "D9"} and facts.where("relation = 'REJECTED_BY'").count() == 1
    os.makedirs(tmp_path / "f")
    (tmp_path / "f" / "x.txt").write_bytes("né\xff".encode("latin-1") + b"ok")
    (tmp_path / "f" / "y.bin").write_bytes(b"no")
    assert {r.filename: r.text for r in files.load(spark, str(tmp_path / "f")).collect()} == {"x.txt": "nok", "y.bin": None}


def test_graph_from_documents(spark):
    body = "The Finance Committee met on 2024-03-20. The Finance Committee rejected the purchase of a large green bus because costs exceed the budget."
    docs = [("A", "a.txt", None, body), ("B", "b.txt", None, body.replace("large green bus", "large greens bus"))]
    n, f = graph.from_documents(spark.createDataFrame(docs, SCHEMA))
    one = n.where("type = 'DECISION'").collect()
    assert [x.name for x in one] == ["purchase of a large green bus"] and one[0].aliases == ["purchase of a large greens bus"]
    assert {p.document_id for p in one[0].provenance} == {"A", "B"}
    assert f.where("relation = 'REJECTED_BY'").count() == 1
