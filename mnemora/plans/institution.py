"""Further queries: what surrounds decisions, questions' scores, client records, the store, and records read leniently."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import records, text
from ..operators import client, decisions, graph, search, trails
from ..sources import pipeline
from ..sources.store import Store, scratch
from . import question
from .catalog import query
from .views import record, table

_DATED = "strftime(o_orderdate, '%Y-%m-%d')"
_EVENTS = f"""
SELECT 'DECISION:' || o_orderkey AS decision_id, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PROPOSED' ELSE 'DEFERRED' END AS kind, {_DATED} AS date_iso FROM orders
UNION SELECT 'DECISION:' || l_orderkey, 'DUE', strftime(l_shipdate, '%Y-%m-%d') FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""


def _events(spark, sf_dir):
    nodes, facts = record(spark, sf_dir)
    return decisions.events(nodes, facts, trails.steps(nodes, facts))


@query(_EVENTS)
def decision_events(spark, sf_dir):
    """Every dated event of every decision, deadlines of its actions included."""
    return _events(spark, sf_dir)


@query("""
SELECT DISTINCT 'DECISION:' || o_orderkey AS decision_id, 'PERSON:' || o_custkey AS entity_id FROM orders
UNION SELECT 'DECISION:' || l_orderkey, 'DEPARTMENT:' || l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def decision_links(spark, sf_dir):
    """Actors of decisions and those that their actions are assigned to."""
    return decisions.links(*record(spark, sf_dir))


@query("""
WITH f AS (SELECT o_orderkey AS a, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders), e AS (SELECT a, b FROM f WHERE b IS NOT NULL), p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT 'DECISION:' || a AS decision_id, 'DECISION:' || b AS other_id FROM e JOIN p ON k = a UNION SELECT 'DECISION:' || b, 'DECISION:' || a FROM e JOIN p ON k = b""")
def related_decisions(spark, sf_dir):
    """Each order follows up the customer's one before: what is related to the partial ones, either way."""
    from pyspark.sql import Window

    nodes, facts = record(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    ids = lambda c: F.concat(F.lit("DECISION:"), c.cast("string"))
    chain = o.withColumn("b", before).where("b is not null").select(ids(F.col("o_orderkey")).alias("source_id"), ids(F.col("b")).alias("target_id"), F.lit("FOLLOWS_UP").alias("relation"))
    some = o.where("o_orderstatus = 'P'").select(ids(F.col("o_orderkey")).alias("decision_id"))
    return decisions.related(nodes, facts.select("source_id", "target_id", "relation").unionByName(chain), some)


@query("""
SELECT 'DECISION:' || o_orderkey AS id, 'order ' || o_orderkey AS name, 'DECISION' AS type, 'DECIDED_ON' AS relation FROM orders WHERE o_orderstatus <> 'O' AND strftime(o_orderdate, '%Y-%m') = '1995-03'
UNION SELECT 'ACTION:' || l_orderkey || '.' || l_linenumber, 'ship ' || l_orderkey || '.' || l_linenumber, 'ACTION', 'DUE_ON' FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1995-03'""")
def entities_on_date(spark, sf_dir):
    """All that a fact ties to a day of one month."""
    return decisions.entities_on(*record(spark, sf_dir), "1995-03")


@query("SELECT DISTINCT 'DECISION:' || l_orderkey AS decision_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_shipdate >= '1995-03-01' AND l_shipdate < '1995-07-01'")
def decisions_due(spark, sf_dir):
    """Decisions with a deadline in a range of months."""
    return decisions.dated_within(_events(spark, sf_dir), "1995-03", "1995-06", ("DUE",))


@query("""
SELECT 'DECISION:' || o_orderkey AS decision_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'proposed' ELSE 'deferred' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS first_date
FROM orders WHERE strftime(o_orderdate, '%Y') = '1996' AND o_orderstatus <> 'O'""")
def decided_in_year(spark, sf_dir):
    """Trails of the decisions made in a year, proposals aside."""
    nodes, facts = record(spark, sf_dir)
    own = trails.steps(nodes, facts)
    return decisions.on_date(trails.trails(nodes, facts, own), decisions.events(nodes, facts, own), "1996", "decide").select("decision_id", "status", "first_date")


@query("SELECT 'DECISION:' || o_orderkey AS decision_id, round(1 / 3.0, 6) AS direct, 1.0::DOUBLE AS support, 1.0::DOUBLE AS coverage, 3.5::DOUBLE AS score FROM orders WHERE o_orderpriority = '1-URGENT'")
def topic_matches(spark, sf_dir):
    """Decisions scored by a topic of two weighted terms."""
    nodes, facts = record(spark, sf_dir)
    found = question.evaluated(decisions.ids(nodes), question.profiles(nodes, facts), {"order": 1.0, "urgent": 2.0}, "urgent order")
    return found.select("decision_id", F.round("direct", 6).alias("direct"), "support", "coverage", F.round("score", 6).alias("score"))


@query("SELECT 'PERSON:' || c_custkey AS id, c_name AS name FROM customer WHERE regexp_extract_all(lower(c_name), '[\\p{L}\\p{N}]+') <@ ['customer', '000000007', '000000011']")
def named_in_question(spark, sf_dir):
    """Entities whose whole names are among a question's words."""
    nodes = record(spark, sf_dir)[0]
    words = F.transform(F.concat(F.array("name"), "aliases"), lambda n: text.content_tokens(text.normalize_name(n, F.col("type"))))
    return question.mentions(nodes.withColumn("words", words), ["customer", "000000007", "000000011", "plan"]).select("id", "name")


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s.,!?;:()@/\-]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH c AS (SELECT doc_id, {_CLEAN} AS t FROM documents) SELECT doc_id, md5(t) AS cleaned, CASE WHEN t = '' THEN 0 ELSE ceil(len(string_split(t, ' ')) / 200) END::INT AS chunk_count, t = '' AS failed FROM c")
def processed_documents(spark, sf_dir):
    """Documents cleaned and cut into chunks of 200 words."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("filename"), F.col("source").alias("path"), "text")
    out = pipeline.processed(d, 200)
    return out.select(F.col("document_id").cast("bigint").alias("doc_id"), F.md5("cleaned_text").alias("cleaned"), "chunk_count", (F.col("cleaned_text") == "").alias("failed"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def loose_records(spark, sf_dir):
    """JSON objects read from answers that wrap them in talk and fences, with a comma too many."""
    said = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}\s*$", ",}"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(records.loose_json(said), "$.k").alias("k"))


def _stored(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    meta = F.to_json(F.struct(F.col("lang").alias("category"), F.array("lang", "source").alias("entities")))
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.lit("").alias("title"), F.col("text").alias("content"), F.lit("").alias("file_path"), F.lit(".txt").alias("file_type"), F.lit("2024-03-05 00:00:00").cast("timestamp_ntz").alias("created_at"), meta.alias("metadata"))


@query("""SELECT doc_id::VARCHAR AS id, source AS name, 'txt' AS type, lang AS category, left(coalesce(text, ''), 240) || CASE WHEN length(text) > 240 THEN '…' ELSE '' END AS summary, '—' AS size, 'Indexed & Processed' AS status,
lang || ',' || source AS entities FROM documents""")
def client_records(spark, sf_dir):
    """Stored documents as a client shows them."""
    return client.normalized(_stored(spark, sf_dir)).select("id", "name", "type", "category", "summary", "size", "status", F.array_join("entities", ",").alias("entities"))


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE lang = 'fr' AND (contains(lower(source), 'src1') OR contains(lower(left(text, 240)), 'src1'))")
def client_filter(spark, sf_dir):
    """Client records of a category with a word in name, summary or an entity."""
    return client.filtered(client.normalized(_stored(spark, sf_dir)), "SRC1", "FR").select("id")


@query("SELECT 'doc-' || doc_id AS id, source || ' is available in institutional memory.' AS message, FALSE AS read FROM documents ORDER BY doc_id DESC LIMIT 10")
def client_notifications(spark, sf_dir):
    """The feed of the ten newest documents."""
    return client.notifications(_stored(spark, sf_dir)).select("id", "message", "read")


@query("SELECT (SELECT count(*) FROM documents)::BIGINT AS uploads, (SELECT 2 * count(*) FROM documents)::BIGINT AS entities, (SELECT count(*) FROM (SELECT doc_id::VARCHAR FROM documents UNION SELECT lang FROM documents UNION SELECT source FROM documents))::BIGINT AS nodes")
def client_counters(spark, sf_dir):
    """Uploads, entities and the nodes of the topology."""
    own = client.normalized(_stored(spark, sf_dir))
    return client.counters(own, client.topology(own)[0])


@query("""
WITH g AS (SELECT min(doc_id) AS gone FROM documents), n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS id FROM documents)
SELECT 'documents' AS kept, count(*)::BIGINT AS n, count(*)::BIGINT AS owned FROM n, g WHERE doc_id <> gone UNION ALL SELECT 'entities', count(*)::BIGINT, count(*)::BIGINT FROM n, g WHERE doc_id <> gone
UNION ALL SELECT 'decisions', count(*)::BIGINT, count(*) FILTER (doc_id <> gone)::BIGINT FROM n, g""")
def store_cascade(spark, sf_dir):
    """Documents, an entity and a decision of each stored, and one document deleted: rows left, and those that name a document."""
    store = Store(spark, scratch(spark, "store"))
    docs = store.append("documents", table(spark, sf_dir, "documents").select(F.col("source").alias("filename"), F.col("doc_id").cast("string").alias("title")))
    store.append("entities", docs.select(F.col("title").alias("name"), F.lit("DOC").alias("entity_type"), F.col("id").alias("document_id")))
    store.append("decisions", docs.select("title", F.col("id").alias("document_id")))
    store.delete_document(docs.agg(F.min_by("id", F.col("title").cast("bigint"))).first()[0])
    count = lambda t, owner: store.read(t).agg(F.count("*").alias("n"), F.count(owner).alias("owned")).select(F.lit(t).alias("kept"), "n", "owned")
    return count("documents", "id").unionByName(count("entities", "document_id")).unionByName(count("decisions", "document_id"))


@query("SELECT doc_id AS id FROM documents ORDER BY doc_id DESC LIMIT 50")
def document_listing(spark, sf_dir):
    """The newest documents, 50 where the limit is below 1."""
    return _stored(spark, sf_dir).orderBy(F.desc("id")).limit(search.clamp(0, 50, 500)).select("id")


@query("""
WITH w AS (SELECT item_id, regexp_split_to_array(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark)
SELECT item_id, len(w) >= 2 AS whole, len(w) - 2 >= 2 AS middle FROM w""")
def quoted_items(spark, sf_dir):
    """Texts as quotes of themselves: whole, and in other case and punctuation without their first and last word."""
    t = text.normalize_text(F.col("text"))
    words = F.split(t, " ")
    inner = F.upper(F.array_join(F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 2)), "; "))
    return table(spark, sf_dir, "benchmark").select("item_id", text.quoted(F.col("text"), F.col("text")).alias("whole"), text.quoted(inner, F.col("text")).alias("middle"))


@query("SELECT 's' || s_suppkey AS id, s_name AS label, 'unit' AS type FROM supplier UNION ALL SELECT 'x', 'x', 'unknown'")
def graph_upsert(spark, sf_dir):
    """The suppliers' named graph with one edge more, to a node that isn't there yet."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("k"), "s_name")
    nodes = s.select(F.col("k").alias("name"), F.lit("unit").alias("type"))
    edges = spark.createDataFrame([], "source string, target string, relation string")
    nodes, edges = graph.with_edge(nodes, edges, "s1", "KNOWS", " x ")
    out = graph.exported(nodes, edges)["nodes"].join(s, F.col("id") == F.col("k"), "left")
    return out.select("id", F.coalesce("s_name", "label").alias("label"), "type")


