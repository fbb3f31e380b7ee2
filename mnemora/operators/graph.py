"""The knowledge graph as two DataFrames.

nodes: id, name, type, aliases, date_iso, description, source_document, provenance
facts: source_id, target_id, relation, date_iso, provenance
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text
from . import extraction, merging


def with_meeting_dates(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Nodes, where a meeting or event without a date takes the date that it was held on."""
    held = facts.where("relation = 'HELD_ON'").join(nodes.where("date_iso is not null").select(F.col("id").alias("target_id"), F.col("date_iso").alias("held")), "target_id")
    held = held.groupBy(F.col("source_id").alias("id")).agg(F.min("held").alias("held"))
    date = F.coalesce("date_iso", F.when(F.col("type").isin("MEETING", "EVENT"), F.col("held")))
    return nodes.join(held, "id", "left").withColumn("date_iso", date).select(nodes.columns)


def with_documents(nodes: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds a node per source document, and MENTIONED_IN facts of all but dates and documents."""
    where = nodes.where(~F.col("type").isin("DATE", "DOCUMENT")).select("id", F.explode("provenance").alias("p")).where("p.document_id is not null")
    target = F.concat(F.lit("DOCUMENT:source:"), F.col("p.document_id"))
    said = where.groupBy(F.col("id").alias("source_id"), target.alias("target_id")).agg(F.array_sort(F.collect_set("p")).alias("provenance"))
    said = said.select("source_id", "target_id", F.lit("MENTIONED_IN").alias("relation"), F.lit(None).cast("string").alias("date_iso"), "provenance")
    docs = nodes.select(F.explode("provenance").alias("p")).where("p.document_id is not null").groupBy(target.alias("id")).agg(F.coalesce(F.min("p.filename"), F.min("p.document_id")).alias("name"))
    docs = docs.select("id", "name", F.lit("DOCUMENT").alias("type"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("date_iso"), F.lit(None).cast("string").alias("description"), F.lit(True).alias("source_document"), F.array().cast(nodes.schema["provenance"].dataType).alias("provenance"))
    return nodes.unionByName(docs), facts.unionByName(said)


def build(nodes: DataFrame, facts: DataFrame, documents: bool = True) -> tuple[DataFrame, DataFrame]:
    nodes = with_meeting_dates(nodes, facts)
    return with_documents(nodes, facts) if documents else (nodes, facts)


def from_documents(documents: DataFrame, limit: int = 1500) -> tuple[DataFrame, DataFrame]:
    """The graph of documents(document_id, filename, pages, text): extracted, entities of close names merged, dates and documents
    added."""
    return build(*merging.merge_close(*extraction.extract(documents, limit)))


def named_graph(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph keyed by names: per name, and per pair of ends, the row with the least id wins; ends that aren't entities are
    ``unknown`` nodes. entities(id, name, entity_type), relationships(id, source_entity, relation, target_entity)."""
    keep = lambda df, *k: df.withColumn("_n", F.row_number().over(Window.partitionBy(*k).orderBy("id"))).where("_n = 1").drop("_n")
    own = keep(entities.where(F.trim("name") != ""), "name").select("name", F.col("entity_type").alias("type"))
    edges = keep(relationships.where((F.trim("source_entity") != "") & (F.trim("target_entity") != "")), "source_entity", "target_entity").select(F.col("source_entity").alias("source"), F.col("target_entity").alias("target"), "relation")
    ends = edges.select(F.col("source").alias("name")).union(edges.select("target")).distinct().join(own, "name", "left_anti")
    return own.unionByName(ends.withColumn("type", F.lit("unknown"))), edges


def with_node(nodes: DataFrame, name: str, kind: str = "unknown") -> DataFrame:
    """The named nodes with one more, or that one's type replaced; a blank name changes nothing."""
    if not name.strip():
        return nodes
    new = nodes.sparkSession.createDataFrame([(name.strip(), kind)], "name string, type string")
    return nodes.join(new, "name", "left_anti").select("name", "type").unionByName(new)


def with_edge(nodes: DataFrame, edges: DataFrame, source: str, relation: str, target: str) -> tuple[DataFrame, DataFrame]:
    """The named graph with one more edge, or that edge's relation replaced; ends that aren't there come as unknown nodes, and a
    blank end changes nothing."""
    if not source.strip() or not target.strip():
        return nodes, edges
    new = nodes.sparkSession.createDataFrame([(source.strip(), target.strip(), relation.strip())], "source string, target string, relation string")
    ends = new.select(F.col("source").alias("name")).union(new.select("target")).distinct().join(nodes, "name", "left_anti")
    kept = edges.join(new, ["source", "target"], "left_anti").select("source", "target", "relation")
    return nodes.unionByName(ends.withColumn("type", F.lit("unknown"))), kept.unionByName(new)


def node(nodes: DataFrame, name: str) -> dict | None:
    """A named node, or None."""
    row = nodes.where(F.col("name") == name.strip()).first()
    return None if row is None else row.asDict()


def related(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """name, type, relation, direction of a named node's neighbours, those that it points to first."""
    name = name.strip()
    out = edges.where(F.col("source") == name).select(F.col("target").alias("name"), "relation", F.lit("outgoing").alias("direction"))
    in_ = edges.where(F.col("target") == name).select(F.col("source").alias("name"), "relation", F.lit("incoming").alias("direction"))
    return nodes.select("name", "type").join(out.unionByName(in_), "name").select("name", "type", "relation", "direction").orderBy(F.desc("direction"), "name", "relation")


def exported(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """nodes (id, label, type), edges and links (source, target, relation), stats."""
    links = edges.select("source", "target", "relation")
    return {"nodes": nodes.select(F.col("name").alias("id"), F.col("name").alias("label"), "type"), "edges": links, "links": links, "stats": stats(nodes, edges)}


def modes(facts: DataFrame) -> DataFrame:
    """modes: how the facts were extracted, sorted; rules: whether some were by rules."""
    found = facts.select(F.explode("provenance.mode").alias("m")).agg(F.array_sort(F.collect_set("m")).alias("modes"))
    return found.select("modes", F.array_contains("modes", "rules").alias("rules"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, density (directed), is_empty."""
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))
    n, m = F.col("nodes"), F.col("edges")
    return counts.select("nodes", "edges", F.when((n <= 1) | (m == 0), 0.0).otherwise(m / (n * (n - 1))).alias("density"), (n == 0).alias("is_empty"))


def counts_by_kind(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """what, kind, n: nodes by type and facts by relation."""
    return nodes.groupBy(F.lit("node").alias("what"), F.col("type").alias("kind")).agg(F.count("*").alias("n")).unionByName(facts.groupBy(F.lit("fact").alias("what"), F.col("relation").alias("kind")).agg(F.count("*").alias("n")))


def neighbors(nodes: DataFrame, facts: DataFrame, node_id: str, relation: str | None = None, direction: str = "both") -> DataFrame:
    """direction, relation, date_iso, neighbor_id, name, type of all facts of one node, in a fixed order."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction: {direction!r}")
    if nodes.where(F.col("id") == node_id).isEmpty():
        raise KeyError(f"unknown node: {node_id}")
    some = facts if relation is None else facts.where(F.col("relation") == relation)
    side = lambda own, other, name: some.where(F.col(own) == node_id).select(F.lit(name).alias("direction"), "relation", "date_iso", F.col(other).alias("neighbor_id"))
    parts = {"out": side("source_id", "target_id", "out"), "in": side("target_id", "source_id", "in")}
    both = parts["out"].unionByName(parts["in"]) if direction == "both" else parts[direction]
    return both.join(nodes.select(F.col("id").alias("neighbor_id"), "name", "type"), "neighbor_id").select("direction", "relation", "date_iso", "neighbor_id", "name", "type").orderBy("direction", "relation", F.coalesce("date_iso", F.lit("")), "name", "neighbor_id")


def structural(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """a, b: neighbours in either direction, without documents and mere mentions."""
    real = nodes.where("not source_document").select("id")
    e = facts.where("relation <> 'MENTIONED_IN'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).where("a <> b")
    e = e.join(real.withColumnRenamed("id", "a"), "a", "left_semi").join(real.withColumnRenamed("id", "b"), "b", "left_semi")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def find_path(edges: DataFrame, source: str, target: str, max_length: int = 6) -> list[str] | None:
    """The shortest path over edges(a, b) of at most ``max_length`` steps, the least of equals; None if there is none. Each step
    is one join of the frontier; only the path itself comes to the driver."""
    if source == target:
        return [source]
    spark = edges.sparkSession
    front = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    seen = front.select("node")
    for _ in range(max_length):
        step = front.join(edges, front["node"] == edges["a"]).select(F.col("b").alias("node"), F.array_append("path", F.col("b")).alias("path"))
        front = step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")).persist()  # each hop is worked out once
        if found := front.where(F.col("node") == target).select("path").take(1):
            return list(found[0][0])
        seen = seen.unionByName(front.select("node"))
    return None


def reach(edges: DataFrame, sources: DataFrame, max_length: int) -> DataFrame:
    """source, node, distance: all nodes within ``max_length`` steps over edges(a, b) of each source(node), as so many joins."""
    front = sources.select(F.col("node").alias("source"), "node").withColumn("distance", F.lit(0))
    out = front
    for d in range(1, max_length + 1):
        step = front.join(edges, front["node"] == edges["a"]).select("source", F.col("b").alias("node")).distinct()
        front = step.join(out.select("source", "node"), ["source", "node"], "left_anti").withColumn("distance", F.lit(d))
        out = out.unionByName(front)
    return out


def name_tokens(nodes: DataFrame) -> Column:
    """Stems of a node's name and aliases, distinct."""
    return F.array_distinct(F.flatten(F.transform(F.concat(F.array(nodes["name"]), nodes["aliases"]), text.content_tokens)))


def term_weights(nodes: DataFrame) -> DataFrame:
    """term, df, weight = 1 + ln((N + 1) / (df + 1)) over all nodes that aren't source documents."""
    real = nodes.where("not source_document")
    toks = F.array_distinct(F.concat(name_tokens(nodes), text.content_tokens(F.coalesce(nodes["description"], F.lit("")))))
    df = real.select(F.explode(toks).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = real.agg(F.count("*").alias("total"))
    return df.crossJoin(F.broadcast(total)).select("term", "df", (1 + F.log((F.col("total") + 1) / (F.col("df") + 1))).alias("weight"))


def find_entities(nodes: DataFrame, query: str, types: list[str] | None = None, limit: int = 10) -> DataFrame:
    """id, name, type, score by weighted keyword overlap: names and aliases count fully, descriptions 0.3, a whole name of four
    letters or more in the query 2 more; best first, then by name and id."""
    if isinstance(limit, bool) or limit < 1:
        raise ValueError("limit must be 1 or more")
    known = [t.upper() for t in types or []]
    if wrong := [t for t in known if t not in lexicon.ENTITY_TYPES]:
        raise ValueError(f"unknown entity type: {wrong[0]!r}")
    spark, real = nodes.sparkSession, nodes.where("not source_document")
    asked, generic, phrase = spark.range(1).select(text.content_tokens(F.lit(query)), text.content_tokens(F.lit(" ".join(lexicon.GENERIC))), text.normalize_text(F.lit(query))).first()
    terms = [t for t in dict.fromkeys(asked) if t not in generic]
    own = real.select("id", "name", "type", name_tokens(real).alias("own"), text.content_tokens(F.coalesce("description", F.lit(""))).alias("desc"))
    # The question's few words are counted in one row; the plan over the nodes has them as literals.
    counts = own.agg(F.count("*"), *[F.count_if((F.col("type") != "DATE") & F.array_contains("own", t)) for t in terms]).first()
    weights = {t: 1.0 + log((counts[0] + 1) / (n + 1)) for t, n in zip(terms, counts[1:], strict=True)}
    part = lambda t, w: F.when(text.term_in(F.lit(t), F.col("own")), w).when(text.term_in(F.lit(t), F.col("desc")), 0.3 * w).otherwise(0.0)
    score = reduce(lambda a, b: a + b, [part(t, w) for t, w in weights.items()], F.lit(0.0))
    key = text.normalize_text(F.col("name"))
    bonus = F.when((F.char_length(key) >= 4) & F.contains(F.lit(phrase), key), 2.0).otherwise(0.0)
    scored = own.withColumn("s", score).where("s > 0").select("id", "name", "type", F.round(F.col("s") + bonus, 3).alias("score"))
    if known:
        scored = scored.where(F.col("type").isin(known))
    return scored.orderBy(F.desc("score"), "name", "id").limit(limit)


def topology(documents: DataFrame) -> DataFrame:
    """source, target: documents(name, entities) as a bipartite graph; ids are names with white space as underscores."""
    e = documents.select(F.col("name").alias("source"), F.explode("entities").alias("e"))
    return e.select("source", F.regexp_replace("e", r"\s+", "_").alias("target")).distinct()
