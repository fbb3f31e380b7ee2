"""Substring search, relevance scores and the composed retrieval over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, preview
from . import graph


def clamp(value: int | None, default: int, most: int) -> int:
    return default if value is None or value < 1 else min(value, most)


def like(column: Column, query: str) -> Column:
    """SQL's LIKE on a column around the query, folding A to Z only; % and _ of the query are wildcards, a backslash is itself."""
    folded = query.translate({c: c + 32 for c in range(65, 91)})
    if "%" not in folded and "_" not in folded:
        return F.contains(ascii_lower(column), F.lit(folded))
    return F.like(ascii_lower(column), F.lit(f"%{folded}%"), F.lit("\x01"))


def search(table: DataFrame, query: str, columns: list[str], limit: int | None = 20, most: int = 100) -> DataFrame:
    """Rows with the query in any of the columns, largest id first."""
    if not query.strip():
        return table.limit(0)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(like(F.col(c), query.strip()), F.lit(False))
    return table.where(hit).orderBy(F.desc("id")).limit(clamp(limit, 20, most))


def search_documents(documents: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return search(documents, query, ["filename", "title", "content"], limit)


def search_all(documents: DataFrame, entities: DataFrame, decisions: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """kind, id, label of all three tables, each with its own limit."""
    parts = [("document", search_documents(documents, query, limit), "filename"), ("entity", search(entities, query, ["name", "entity_type"], limit), "name"), ("decision", search(decisions, query, ["title", "description", "reason", "meeting"], limit), "title")]
    out = [df.select(F.lit(k).alias("kind"), "id", F.col(c).alias("label")) for k, df, c in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def shown(documents: DataFrame) -> DataFrame:
    """Search results with a preview of 300 characters."""
    return documents.withColumn("preview", preview(F.col("content")))


def score_entities(entities: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Two points for each word of the query in the name, one in the type; positive scores, best first, then the larger id."""
    words = query.lower().split()
    score = F.lit(0)
    for w in words:
        score = score + F.when(F.contains(F.lower("name"), F.lit(w)), 2).otherwise(0) + F.when(F.contains(F.lower("entity_type"), F.lit(w)), 1).otherwise(0)
    return entities.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("id")).limit(k)


def score_decisions(decisions: DataFrame, query: str, k: int = 10) -> DataFrame:
    """One point for each word of the query (repeats count) in title, description, reason or meeting; without words, the first."""
    words = query.lower().split()
    if not words:
        return decisions.withColumn("score", F.lit(0)).orderBy(F.desc("id")).limit(k)
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "description", "reason", "meeting")]))
    score = sum((F.when(F.contains(whole, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    return decisions.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("id")).limit(k)


def relationships_of(relationships: DataFrame, name: str, k: int = 20) -> DataFrame:
    """Those with the name within either end; the newest for no name."""
    n = name.strip().lower()
    if not n:
        return relationships.orderBy(F.desc("id")).limit(k)
    return relationships.where(F.contains(F.lower("source_entity"), F.lit(n)) | F.contains(F.lower("target_entity"), F.lit(n))).orderBy(F.desc("id")).limit(k)


def sources_of(sources: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Evidence rows of the given documents(id); of all if none are given."""
    if documents.isEmpty():
        return sources.orderBy(F.desc("id")).limit(k)
    return sources.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").orderBy(F.desc("id")).limit(k)


def graph_context(nodes: DataFrame, edges: DataFrame, name: str, k: int) -> dict:
    """stats of the named graph (name, type; source, target, relation), and the k first neighbours of a name."""
    near = graph.related(nodes, edges, name).limit(k) if name.strip() else None
    return {"stats": graph.stats(nodes, edges), "entity": name, "related_entities": near}


def retrieve(tables: dict[str, DataFrame], query: str, k: int = 5) -> dict:
    """documents, entities, decisions, sources of the documents, and around the best entity its relationships and graph_context."""
    docs, ents, decs = search_documents(tables["documents"], query, k).persist(), score_entities(tables["entities"], query, k), score_decisions(tables["decisions"], query, k)
    best = ents.first()
    out = {"query": query, "documents": docs, "entities": ents, "decisions": decs, "sources": sources_of(tables["sources"], docs.select("id"), 20), "relationships": tables["relationships"].limit(0), "graph_context": {"stats": None, "entity": "", "related_entities": None}}
    if best is not None:
        out["relationships"] = relationships_of(tables["relationships"], best["name"], 20)
        out["graph_context"] = graph_context(*graph.named_graph(tables["entities"], tables["relationships"]), best["name"], k)
    return out


_SECTIONS = {
    "documents": ("RELEVANT DOCUMENTS:", lambda r: f"- {r['title'] or r['filename']}: {r['content'] or ''}"), "entities": ("\nENTITIES:", lambda r: f"- {r['name']} ({r['entity_type']})"),
    "relationships": ("\nRELATIONSHIPS:", lambda r: f"- {r['source_entity']} --[{r['relation']}]--> {r['target_entity']}"), "decisions": ("\nDECISIONS:", lambda r: f"- {r['title']}: {r['description'] or ''}"),
    "sources": ("\nSOURCES:", lambda r: f"- {r['filename'] or ''} | Page: {'N/A' if r['page_number'] is None else r['page_number']}"),
}


def context_text(found: dict) -> str:
    """What ``retrieve`` found as text; its tables have a bounded number of rows each."""
    parts = []
    for name, (head, line) in _SECTIONS.items():
        if rows := found[name].collect():
            parts += [head, *map(line, rows)]
    return "\n".join(parts)


def model_context(found: dict) -> str:
    """The same in sections, as a model is given it."""
    each = {
        "documents": ("DOCUMENTS:", lambda i, r: f"\nDocument {i}:\nFilename: {r['filename'] or ''}\nTitle: {r['title'] or ''}\nContent: {r['content'] or ''}"),
        "entities": ("ENTITIES:", lambda i, r: _SECTIONS["entities"][1](r)), "relationships": ("RELATIONSHIPS:", lambda i, r: _SECTIONS["relationships"][1](r)),
        "decisions": ("DECISIONS:", lambda i, r: "".join(f"\n{label}: {r[c] or ''}" for label, c in (("Decision", "title"), ("Description", "description"), ("Reason", "reason"), ("Date", "date"), ("Meeting", "meeting")))),
    }
    sections = ["\n".join([head, *(line(i, r) for i, r in enumerate(rows, 1))]) for name, (head, line) in each.items() if (rows := found[name].collect())]
    return "\n\n".join(sections) or "No relevant institutional context was retrieved."
