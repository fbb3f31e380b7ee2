import json

import pytest
from corpus import DOCS
from pyspark.sql import functions as F

from mnemora import config, service
from mnemora.operators import client, extraction, graph, search
from mnemora.plans import prompts
from mnemora.sources import files, models, pipeline
from mnemora.sources.store import Store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    s.initialize()
    return s


def test_documents(store):
    for bad in (None, [], {"title": "x"}, {"filename": "  "}):
        assert service.create(store, bad)[0] == 400
    assert [service.create(store, {"filename": f" f{i}.txt ", "content": f"budget {i}", "metadata": {"k": i} if i else [1]})[1]["document_id"] for i in range(3)] == [1, 2, 3]
    assert [d["id"] for d in service.documents(store, 2)[1]["documents"]] == [3, 2] and service.documents(store, 0)[1]["count"] == 3
    assert service.document(store, 1)[1]["document"]["metadata"] == {} and service.document(store, 2)[1]["document"]["metadata"] == {"k": 1} and service.document(store, 9)[0] == 404
    assert [service.update(store, 1, b)[0] for b in (None, {}, {"filename": " "}, {"metadata": 3}, {"title": "T"})] == [400, 400, 400, 400, 200] and service.update(store, 9, {"title": "T"})[0] == 404
    assert service.document(store, 1)[1]["document"]["title"] == "T"
    assert service.find(store, " ")[0] == 400 and service.find(store, "BUDGET 1")[1]["count"] == 1
    assert service.delete(store, 3)[0] == 200 and service.delete(store, 3)[0] == 404
    assert service.create(store, {"filename": "again.txt"})[1]["document_id"] == 4  # the deleted 3 isn't given again
    assert [n["id"] for n in service.notifications(store)[1]["notifications"]] == ["doc-4", "doc-2", "doc-1"]


def test_commits(spark, tmp_path):
    """Appends leave the folders that are there alone; of two writers at once the second works on the first one's state."""
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("x",)], "filename string")
    a.append("documents", rows)
    before = a._state()[1]["documents"]["folders"]
    stale = a._state()
    b.append("documents", rows)
    assert a._state()[1]["documents"]["folders"][:1] == before and not a._commit(stale[0] + 1, stale[1])
    assert sorted(r.id for r in a.read("documents").collect()) == [1, 2]
    a.append("entities", spark.createDataFrame([("E", "T", 1), ("F", "T", 2)], "name string, entity_type string, document_id bigint"))
    number = a._state()[0]
    assert a.delete_document(1) and a._state()[0] == number + 1 and [r.name for r in b.read("entities").collect()] == ["F"]


def test_queries(spark, store):
    store.append("entities", spark.createDataFrame([("Budget Office", "DEPARTMENT", 1), ("Ida", "PERSON", 1)], "name string, entity_type string, document_id bigint"))
    store.append("relationships", spark.createDataFrame([("Ida", "MEMBER_OF", "Budget Office")], "source_entity string, relation string, target_entity string"))
    store.append("decisions", spark.createDataFrame([("Budget 2024", "more money")], "title string, description string"))
    store.append("sources", spark.createDataFrame([(1, "f0.txt"), (7, "other")], "document_id bigint, filename string"))
    for bad in ("x", {}, {"query": 3}, {"query": " "}):
        assert service.query(store, bad)[0] == 400
    code, out = service.query(store, {"query": "budget", "top_k": "many"})
    assert code == 200 and out["top_k"] == 5 and [r["name"] for r in out["entities"]] == ["Budget Office"] and len(out["relationships"]) == 1 and [r["filename"] for r in out["sources"]] == ["f0.txt"]
    assert out["graph_context"]["stats"]["nodes"] == 2 and out["graph_context"]["related_entities"] == [{"name": "Ida", "type": "PERSON", "relation": "MEMBER_OF", "direction": "incoming"}]
    assert out["context"].startswith("RELEVANT DOCUMENTS:\n- ") and "\nSOURCES:\n- f0.txt | Page: N/A" in out["context"] and "- Ida --[MEMBER_OF]--> Budget Office" in out["context"]
    none = service.query(store, {"query": "zebra", "top_k": 99})[1]
    assert none["answer"] == "Information was not found." and none["top_k"] == 20 and none["documents"] == [] and len(none["sources"]) == 2
    found = search.retrieve({t: store.read(t) for t in ("documents", "entities", "relationships", "decisions", "sources")}, "budget")
    assert search.model_context(found).split("\n\n")[-1].startswith("DECISIONS:") or "DECISIONS:\n\nDecision: Budget 2024" in search.model_context(found)
    top = service.topology(store)[1]
    assert {n["id"] for n in top["nodes"]} == {"Ida", "Budget Office"} and top["links"] == top["edges"] and top["stats"]["density"] == 0.5
    assert service.health(store)[1]["database"] == "connected" and service.part_health("query")[1]["service"] == "query" and service.guarded(lambda: 1 / 0)[0] == 500 and service.profile("N")[1]["name"] == "N"


def test_named_graph(spark, store):
    nodes, edges = graph.named_graph(store.read("entities"), store.read("relationships"))
    assert graph.node(nodes, " Ida ") == {"name": "Ida", "type": "PERSON"} and graph.node(nodes, "nobody") is None
    n, e = graph.with_edge(graph.with_node(nodes, "Ida", "DEAN"), edges, "Ida", "KNOWS", "Bo")
    assert {tuple(r) for r in n.collect()} == {("Ida", "DEAN"), ("Budget Office", "DEPARTMENT"), ("Bo", "unknown")} and e.count() == 2
    assert graph.with_edge(nodes, edges, " ", "x", "y") == (nodes, edges) and graph.with_node(nodes, " ") is nodes


def test_upload(store):
    jobs = service.Jobs()
    extract = lambda d: graph.build(*extraction.extract(d))
    assert [service.upload(store, jobs, *a, extract)[0] for a in (("", b""), ("x.exe", b""), ("x.txt", b"x" * (service.UPLOAD_BYTES + 1)))] == [400, 400, 413]
    job = service.upload(store, jobs, "minutes.txt", DOCS[2][3].encode() + b"\xff", extract, True)[1]["documentId"]
    state = jobs.status(job)[1]
    assert state["status"] == "complete" and state["progress"] == 100, state
    d = state["documentId"]
    assert {"purchase of a bus"} == {r.title for r in store.newest("decisions", d).collect()} and store.newest("relationships", d).count() > 3 and store.newest("sources", d).count() == 2
    empty = service.upload(store, jobs, "empty.md", b" ", extract, True)[1]["documentId"]
    assert jobs.get(empty)["status"] == "failed" and jobs.status("none")[0] == 404


def test_processed(spark, tmp_path):
    body = "Dr. Ida Holm met  the Oslo College in Oslo on 5 March 2024 at 10:30. " + "word " * 600
    (tmp_path / "a.txt").write_text(body + "�")
    (tmp_path / "b.bin").write_bytes(b"x")
    (tmp_path / "c.pdf").write_bytes(b"one|")
    (tmp_path / "d.md").write_bytes(" �".encode() + b"\xff ok")
    parse = pipeline.paged(lambda content: content.decode().split("|"), lambda content, page: f"seen on {page}")
    read = {r.filename: r for r in files.load(spark, str(tmp_path), {"pdf": parse}).collect()}
    assert read["a.txt"].text.endswith("�") and read["b.bin"].error == "unsupported file type: .bin" and read["c.pdf"].pages == ["one", "seen on 2"] and read["d.md"].text == " � ok"
    assert files.load(spark, str(tmp_path)).where("filename = 'c.pdf'").first().error == "no parser was given for file type: .pdf"
    rows = spark.createDataFrame([("1", "a.txt", "p", body), ("2", "e.txt", "p", " ")], "document_id string, filename string, path string, text string")
    got = {r.document_id: r for r in pipeline.processed(rows).collect()}
    one = got["1"].structured_data
    assert got["1"].chunk_count == 2 and one.people == ["Dr. Ida Holm"] and one.dates == ["5 March 2024", "10:30"] and one.organizations == ["Oslo College"] and one.locations == ["Oslo"] and got["2"].error
    assert pipeline.main([str(tmp_path / "missing"), "-o", str(tmp_path / "out")]) == 1
    assert pipeline.find_ocr(("no-such-program",)) is None


def test_client(spark):
    rows = [(1, "a.txt", "", "c" * 300, "p", ".txt", "2024-03-05 10:00:00", '{"entities": ["CFO", {"name": "5 %"}, {"text": "x y"}], "category": "Finance"}'), (2, "", "", None, "p", "", None, "no json")]
    docs = spark.createDataFrame(rows, "id bigint, filename string, title string, content string, file_path string, file_type string, created_at string, metadata string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    records = client.normalized(docs)
    got = {r.id: r for r in records.collect()}
    assert got["1"].entities == ["CFO", "5 %", "x y"] and got["1"].summary == "c" * 240 + "…" and got["1"].type == "txt" and got["1"].category == "Finance" and got["1"].size == "—"
    assert got["2"].name == "Untitled document" and got["2"].category == "Operations" and got["2"].entities == [] and records.columns == client.RECORD
    assert client.filtered(records, "cfo", "finance", "all").count() == 1 and client.filtered(records, "cfo", "Law").count() == 0 and client.filtered(records).count() == 2
    nodes, links = client.topology(records)
    assert {(r.id, r.type) for r in nodes.collect()} == {("1", "document"), ("2", "document"), ("entity_CFO", "org"), ("entity_5_%", "metric"), ("entity_x_y", "entity")} and links.count() == 3
    made = client.synthesized(spark.createDataFrame([("9", "N.PDF", 3 * 2**20), ("8", "m", 0)], "id string, name string, size bigint").withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")))
    assert {(r.id, r.type, r.size, r.date) for r in made.collect()} == {("doc_9", "pdf", "3.0 MB", "2024-01-02 03:04"), ("doc_8", "m", "1.5 MB", "2024-01-02 03:04")}
    feed = client.notifications(docs.withColumn("filename", F.lit("f")))
    more, feed = client.added(records, feed, made.limit(1))
    assert more.count() == 3 and client.unread(feed).first().unread == 3 and client.unread(client.all_read(feed)).first().unread == 0
    assert client.removed(more, "1").count() == 2 and client.counters(records, nodes).first()[:] == (2, 3, 5)
    assert client.timeline(made).first().title.startswith("Uploaded document") and client.results(records).columns == ["name", "summary", "date", "size"] and "status" in client.repository(records).columns


def test_config(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# c\nMNEMORA_TOP_K = 4 # four\nMNEMORA_MODEL='a b'\nnot a line\nMNEMORA_RULES_ONLY=yes\n")
    got = config.load(str(env), {"MNEMORA_TOP_K": "6", "MNEMORA_MIN_COVERAGE": " "}, max_decisions=2)
    assert (got.top_k, got.model, got.rules_only, got.max_decisions, got.min_coverage) == (6, "a b", True, 2, 0.6)
    assert config.read_env(str(tmp_path / "none")) == {}
    for bad in ({"MNEMORA_TOP_K": "x"}, {"MNEMORA_RULES_ONLY": "maybe"}, {"MNEMORA_TOP_K": "0"}, {"MNEMORA_BASE_URL": "http://example.com"}, {"MNEMORA_BASE_URL": "ftp://localhost"}, {"MNEMORA_CHUNK_MAX_CHARS": "10"}):
        with pytest.raises(config.ConfigError):
            config.load(None, bad)
    assert config.load(None, {"MNEMORA_BASE_URL": "http://example.com", "MNEMORA_ALLOW_NON_LOCAL": "on"}).allow_non_local


def test_models():
    asked = []

    def send(path, body):
        asked.append(path)
        if path == "/api/tags":
            return {"models": [{"name": "gemma3:4b"}]}
        return {"message": {"content": "no"}, "response": '[{"name": "A"}, 3]'}

    m = models.Model(config.Config(max_retries=1), send)
    with pytest.raises(models.ModelError):
        m.generate_json("p", "s")
    assert asked == ["/api/chat"] * 2 and m.status()["available"] and m.served()
    assert models.items_from(m, "body", "entities") == [{"name": "A"}] and models.summary(m, " ").startswith("No content") and models.answer_from(m, "", "c").startswith("Please")

    def gone(path, body):
        raise models.Unavailable("down")

    off = models.Model(send=gone)
    assert not off.status()["available"] and not off.served() and "unavailable" in models.text_of(off, "p") and models.items_from(off, "b", "decisions") == []
    assert models.loose_object('x {"a": [1,],} y') == {"a": [1]} and models.loose_object("[1]") is None and models.loose_list("see [1, 2] there") == [1, 2] and models.loose_list("[") == []
    assert "- HELD_ON: EVENT/MEETING -> DATE" in prompts.relations() and "- RELATED_TO: ANY -> ANY" in prompts.relations()
    assert json.loads("{}") == {}


def test_rebuild(spark, tmp_path):
    body = spark.createDataFrame([DOCS[2]], "document_id string, filename string, pages array<string>, text string")
    make = lambda: extraction.extract(body)
    at = str(tmp_path / "g")
    nodes, facts = files.load_or_rebuild(spark, at, make)
    n = nodes.count()
    assert n > 3 and graph.modes(facts).first().rules
    (tmp_path / "g" / "nodes" / "broken.parquet").write_bytes(b"not parquet")
    assert files.load_or_rebuild(spark, at, make)[0].count() == n
