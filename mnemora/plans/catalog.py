"""Queries by name, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, records, text
from ..operators import graph, merging, search, trails
from .views import record, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.col("lang").alias("title"), F.col("text").alias("content"))


_TOKENS = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[''’]s\b', '', 'g'), '[\p{L}\p{N}]+')"
_STOP = "'" + "','".join(text.STOPWORDS) + "'"
_UNDOUBLE = "CASE WHEN length({x}) > 3 AND right({x}, 1) = left(right({x}, 2), 1) AND right({x}, 1) IN ('b','g','m','n','p','r','t') THEN left({x}, length({x}) - 1) ELSE {x} END"


def _stem_sql(t: str) -> str:
    cut = lambda k: f"left({t}, length({t}) - {k})"
    return (
        f"CASE WHEN length({t}) <= 3 OR NOT regexp_full_match({t}, '\\p{{L}}+') THEN {t} WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN {cut(3)} || 'y' WHEN {t} LIKE '%ing' AND length({t}) >= 7 THEN {_UNDOUBLE.format(x=cut(3))} "
        f"WHEN {t} LIKE '%ed' AND length({t}) >= 5 AND {t} NOT LIKE '%eed' THEN {_UNDOUBLE.format(x=cut(2))} WHEN {t} LIKE '%es' AND length({t}) >= 5 THEN {cut(2)} "
        f"WHEN {t} LIKE '%s' AND length({t}) >= 5 AND right({t}, 2) NOT IN ('ss','us','is') THEN {cut(1)} WHEN {t} LIKE '%e' THEN {cut(1)} ELSE {t} END"
    )


@query("SELECT doc_id AS id, source AS filename, left(text, 300) || CASE WHEN length(text) > 300 THEN '...' ELSE '' END AS preview FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') OR contains(lower(lang), 'license') ORDER BY doc_id DESC LIMIT 100")
def document_search(spark, sf_dir):
    """Keyword search, newest first, with previews."""
    return search.shown(search.search_documents(_docs(spark, sf_dir), "License", 100)).select("id", "filename", "preview")


@query("SELECT doc_id AS id FROM documents WHERE text ILIKE '%version_3%' OR source ILIKE '%version_3%' OR lang ILIKE '%version_3%' ORDER BY doc_id DESC LIMIT 100")
def wildcard_search(spark, sf_dir):
    """The wildcards of a query are live."""
    return search.search_documents(_docs(spark, sf_dir), "version_3", 100).select("id")


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS k FROM documents), c AS (SELECT doc_id, k, list_transform(list_filter(k, lambda x: x NOT IN ({_STOP})), lambda x: {_stem_sql('x')}) AS s FROM t) SELECT doc_id, len(k)::INT AS n_tokens, len(s)::INT AS n_content, len(list_distinct(s))::INT AS n_stems FROM c")
def token_counts(spark, sf_dir):
    """Tokens, content tokens and distinct stems of each document."""
    k = text.tokenize(F.col("text"))
    s = text.content_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(k).alias("n_tokens"), F.size(s).alias("n_content"), F.size(F.array_distinct(s)).alias("n_stems"))


@query(f"WITH t AS (SELECT doc_id, unnest(list_distinct(list_transform(list_filter({_TOKENS}, lambda x: x NOT IN ({_STOP})), lambda x: {_stem_sql('x')}))) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*)::BIGINT AS df, round(1 + ln((n + 1) / (count(*) + 1)), 6) AS weight FROM t, n GROUP BY term, n")
def term_weights(spark, sf_dir):
    """Document frequency and weight of every stem."""
    d = table(spark, sf_dir, "documents")
    nodes = d.select(F.lit("").alias("name"), F.array().cast("array<string>").alias("aliases"), F.col("text").alias("description"), F.lit(False).alias("source_document"))
    return graph.term_weights(nodes).select("term", "df", F.round("weight", 6).alias("weight"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS normalized FROM documents")
def normalized_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("normalized"))


@query("WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, ceil(n / 100)::INT AS n_chunks, (n - 100 * (ceil(n / 100)::INT - 1))::INT AS last_words FROM w WHERE n > 0")
def word_chunks(spark, sf_dir):
    """Chunks of 100 words."""
    c = table(spark, sf_dir, "documents").select("doc_id", text.word_chunks(F.col("text"), 100).alias("c")).where(F.size("c") > 0)
    return c.select("doc_id", F.size("c").alias("n_chunks"), F.size(F.split(F.element_at("c", -1), " ")).alias("last_words"))


@query()
def paragraph_chunks(spark, sf_dir):
    """Chunks of at most 1500 characters with their sentences."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.paragraph_chunks(F.col("text"))).alias("at", "chunk"))
    return d.select("doc_id", "at", F.char_length("chunk").alias("n_chars"), F.size(text.sentences(F.col("chunk"))).alias("n_sentences"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, date_trunc('month', o_orderdate)::DATE AS first_day, last_day(o_orderdate) AS last_day, strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM orders")
def partial_dates(spark, sf_dir):
    """Month spans, and written dates read back."""
    m = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf_dir, "orders").select("o_orderkey", m.alias("month"), dates.span_start(m).alias("first_day"), dates.span_end(m).alias("last_day"), dates.parse_date(F.concat(F.lit("on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" the"))).alias("parsed"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def event_metadata(spark, sf_dir):
    """JSON metadata decoded."""
    e = table(spark, sf_dir, "events").select("event_type", F.try_element_at(records.metadata(F.col("props")), F.lit("k")).alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT s_name AS source, p_brand AS target, l_orderkey * 10 + l_linenumber AS id, 'supplies' || l_returnflag AS relation FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)
SELECT source, target, arg_min(relation, id) AS relation FROM e GROUP BY source, target""")
def named_edges(spark, sf_dir):
    """One relation per pair of names: that of the least id."""
    return _named(spark, sf_dir)[1]


@query("""
WITH e AS (SELECT DISTINCT s_name, p_brand FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey), n AS (SELECT s_name AS x FROM supplier UNION SELECT p_brand FROM e),
c AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges)
SELECT nodes::BIGINT AS nodes, edges::BIGINT AS edges, edges / (nodes * (nodes - 1.0)) AS density, nodes = 0 AS is_empty FROM c""")
def named_stats(spark, sf_dir):
    return graph.stats(*_named(spark, sf_dir))


def _named(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    e = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rel = e.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("s_name").alias("source_entity"), F.concat(F.lit("supplies"), "l_returnflag").alias("relation"), F.col("p_brand").alias("target_entity"))
    return graph.named_graph(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type")), rel)


@query("""
WITH a AS (SELECT 'node' AS what, 'DECISION' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'node', 'PERSON', count(*) FROM customer UNION ALL SELECT 'node', 'DEPARTMENT', count(*) FROM supplier UNION ALL SELECT 'node', 'ACTION', count(*) FROM lineitem
UNION ALL SELECT 'node', 'REASON', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'node', 'DATE', count(*) FROM (SELECT o_orderdate::DATE FROM orders UNION SELECT l_shipdate::DATE FROM lineitem)
UNION ALL SELECT 'fact', CASE o_orderstatus WHEN 'F' THEN 'APPROVED_BY' WHEN 'O' THEN 'PROPOSED_BY' ELSE 'DEFERRED_BY' END, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'fact', 'DECIDED_ON', count(*) FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT 'fact', 'JUSTIFIED_BY', count(*) FROM orders UNION ALL SELECT 'fact', r, count(*) FROM lineitem, (VALUES ('LED_TO'), ('ASSIGNED_TO'), ('DUE_ON')) v(r) GROUP BY r)
SELECT what, kind, n::BIGINT AS n FROM a""")
def graph_counts(spark, sf_dir):
    return graph.counts_by_kind(*record(spark, sf_dir))


_STEPS = """
WITH s AS (
SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS date_iso, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PROPOSED' ELSE 'DEFERRED' END AS kind, 0 AS ord,
  c_name || CASE o_orderstatus WHEN 'F' THEN ' approved ' WHEN 'O' THEN ' proposed ' ELSE ' deferred ' END || '''order ' || o_orderkey || '''' AS description, c_name AS actor FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT o_orderkey, NULL, 'REASON', 2, 'Reason: ' || o_orderpriority, NULL FROM orders
UNION ALL SELECT l_orderkey, NULL, 'ACTION', 3, 'Action: ship ' || l_orderkey || '.' || l_linenumber || ' (assigned to ' || string_agg(DISTINCT s_name, ', ' ORDER BY s_name) || ') (due ' || string_agg(DISTINCT strftime(l_shipdate, '%Y-%m-%d'), ', ' ORDER BY strftime(l_shipdate, '%Y-%m-%d')) || ')', min(s_name)
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey, l_linenumber)
"""


@query(_STEPS + "SELECT 'DECISION:' || k AS decision_id, row_number() OVER (PARTITION BY k ORDER BY date_iso NULLS LAST, ord, coalesce(actor, ''), description)::INT AS step_no, date_iso, kind, description, actor FROM s")
def decision_trails(spark, sf_dir):
    """All steps of all decisions, in order."""
    return trails.steps(*record(spark, sf_dir)).select("decision_id", "step_no", "date_iso", "kind", "description", "actor")


@query(_STEPS + "SELECT 'DECISION:' || o_orderkey AS decision_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'proposed' ELSE 'deferred' END AS status, min(date_iso) AS first_date, count(*)::BIGINT AS n_steps FROM orders JOIN s ON k = o_orderkey GROUP BY o_orderkey, o_orderstatus")
def decision_status(spark, sf_dir):
    return trails.trails(*record(spark, sf_dir)).select("decision_id", "status", "first_date", "n_steps")


@query("SELECT 'DECISION:' || o_orderkey AS decision_id, 'order ' || o_orderkey AS decision FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1995-04-01'")
def decisions_between(spark, sf_dir):
    """Decisions with a dated step between two months."""
    return trails.between(trails.steps(*record(spark, sf_dir)), "1995-01", "1995-03")


@query("""
WITH e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
d1 AS (SELECT 'r0' AS source, b AS node FROM u WHERE a = 'r0'), d2 AS (SELECT DISTINCT 'r0' AS source, b AS node FROM u JOIN d1 ON a = node WHERE b NOT IN (SELECT node FROM d1) AND b <> 'r0')
SELECT 'r0' AS source, 'r0' AS node, 0 AS distance UNION ALL SELECT source, node, 1 FROM d1 UNION ALL SELECT source, node, 2 FROM d2""")
def within_two_steps(spark, sf_dir):
    """All nodes within two steps of a region."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    e = c.select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    e = e.union(e.select("b", "a")).distinct()
    return graph.reach(e, spark.createDataFrame([("r0",)], "node string"), 2)


@query("""SELECT p_partkey AS id, p_name AS name, (2 * (contains(lower(p_name), 'ring')::INT + contains(lower(p_name), 'small')::INT) + contains(lower(p_type), 'ring')::INT + contains(lower(p_type), 'small')::INT + 2 * contains(lower(p_name), 'economy')::INT + contains(lower(p_type), 'economy')::INT)::INT AS score
FROM part WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 50""")
def entity_relevance(spark, sf_dir):
    """Entities by words in name and type."""
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"))
    return search.score_entities(e, "ring small economy", 50).select("id", "name", "score")


def _entities(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"))


def _decisions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("description"), F.lit(None).cast("string").alias("reason"), F.date_format("o_orderdate", "yyyy-MM").alias("meeting"))


@query("""
WITH d AS (SELECT 'document' AS kind, doc_id AS id, source AS label FROM documents WHERE contains(lower(text), 'ring') OR contains(lower(source), 'ring') OR contains(lower(lang), 'ring') ORDER BY id DESC LIMIT 50),
e AS (SELECT 'entity' AS kind, p_partkey AS id, p_name AS label FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') ORDER BY id DESC LIMIT 50),
o AS (SELECT 'decision' AS kind, o_orderkey AS id, o_orderpriority AS label FROM orders WHERE contains(lower(o_orderpriority), 'ring') ORDER BY id DESC LIMIT 50)
SELECT * FROM d UNION ALL SELECT * FROM e UNION ALL SELECT * FROM o""")
def all_search(spark, sf_dir):
    """Keyword search over documents, entities and decisions, each with its limit."""
    return search.search_all(_docs(spark, sf_dir), _entities(spark, sf_dir), _decisions(spark, sf_dir), "ring", 50)


@query("SELECT o_orderkey AS id, (2 * contains(lower(o_orderpriority), 'urgent')::INT + contains(strftime(o_orderdate, '%Y-%m'), '1995')::INT)::INT AS score FROM orders WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 50")
def decision_relevance(spark, sf_dir):
    """Decisions by words in title, description, reason and meeting; repeated words count twice."""
    return search.score_decisions(_decisions(spark, sf_dir).withColumn("description", F.lit("")), "Urgent urgent 1995", 50).select("id", "score")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, s_name AS source_entity, p_brand AS target_entity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE contains(lower(p_brand), '#12') OR contains(lower(s_name), '#12') ORDER BY id DESC LIMIT 200")
def relationships_by_name(spark, sf_dir):
    """Relationships with a substring within either end."""
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    rel = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    rel = rel.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("s_name").alias("source_entity"), F.col("p_brand").alias("target_entity"))
    return search.relationships_of(rel, "#12", 200)


@query("SELECT DISTINCT conv_id::VARCHAR AS source, regexp_replace(role, '\\s+', '_', 'g') AS target FROM conversations")
def document_topology(spark, sf_dir):
    """Documents and the entities in them as a bipartite graph."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("name")).agg(F.collect_set("role").alias("entities"))
    return graph.topology(c)


@query("SELECT 'in' AS direction, 'JUSTIFIED_BY' AS relation, 'DECISION:' || o_orderkey AS neighbor_id, 'DECISION' AS type FROM orders WHERE o_orderpriority = '1-URGENT'")
def reason_neighbors(spark, sf_dir):
    """All decisions that one reason justifies."""
    return graph.neighbors(*record(spark, sf_dir), "REASON:1-URGENT", "JUSTIFIED_BY").select("direction", "relation", "neighbor_id", "type")


@query("""
WITH e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT min([x.a, x.b, y.b, z.b, w.b]) AS path FROM u x JOIN u y ON x.b = y.a JOIN u z ON y.b = z.a JOIN u w ON z.b = w.a
WHERE x.a = 'c1' AND w.b = (SELECT 'c' || min(c_custkey) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = (SELECT n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1) AND c_nationkey <> (SELECT c_nationkey FROM customer WHERE c_custkey = 1))""")
def shortest_path(spark, sf_dir):
    """The least shortest path from a customer to the first customer of another nation in the same region."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    own = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    one = own.where("c_custkey = 1").select(F.col("c_nationkey").alias("n1"), F.col("n_regionkey").alias("r1"))
    to = own.join(F.broadcast(one), F.col("n_regionkey") == F.col("r1")).where("c_nationkey <> n1").agg(F.min("c_custkey")).first()[0]
    e = c.select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    e = e.union(e.select("b", "a")).distinct()
    return spark.createDataFrame([(graph.find_path(e, "c1", f"c{to}"),)], "path array<string>")


@query()
def close_names(spark, sf_dir):
    """Parts whose names are nearly those of earlier ones of the same type."""
    p = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    return merging.remap(p.select(F.format_string("PART:%010d", "k").alias("id"), F.lit("PART").alias("type"), "name", F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("date_iso")))


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*)::BIGINT AS n_turns, max(length(text))::INT AS longest FROM conversations GROUP BY conv_id")
def conversation_pages(spark, sf_dir):
    """Turns gathered as the pages of a document."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("n_turns"), F.max(F.char_length("text")).alias("longest"))


def flagship(spark, sf_dir):
    return decision_trails(spark, sf_dir)


from . import institution  # noqa: E402, F401  registers its queries
