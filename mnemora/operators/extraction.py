"""Rule-based extraction: documents to chunks, sentences, entities and typed relationships, all as expressions and windows.

Everything up to the merge is row-parallel; what a sentence inherits from earlier ones (the last meeting, the last decision)
is a window over its own chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, lexicon, text

PROVENANCE = "struct<document_id:string,filename:string,page:int,chunk_id:string,evidence:string,mode:string>"


def chunks(documents: DataFrame, limit: int = 1500) -> DataFrame:
    """document_id, filename, page, chunk_no, chunk_id, text of documents(document_id, filename, pages, text). Pages are numbered
    only if given; a document without pages and text has no chunk."""
    if limit < 200:
        raise ValueError("chunks need at least 200 characters")
    paged = F.size(F.coalesce("pages", F.array().cast("array<string>"))) > 0
    parts = F.when(paged, F.transform("pages", lambda p, i: F.struct((i + 1).alias("page"), p.alias("body")))).otherwise(F.array(F.struct(F.lit(None).cast("int").alias("page"), F.col("text").alias("body"))))
    rows = documents.select("document_id", "filename", F.explode(parts).alias("p"))
    rows = rows.select("document_id", "filename", "p.page", F.posexplode(text.paragraph_chunks(F.col("p.body"), limit)).alias("at", "text"))
    chunk_id = F.concat(F.col("document_id"), F.coalesce(F.concat(F.lit("-p"), F.col("page").cast("string")), F.lit("")), F.lit("-c"), (F.col("at") + 1).cast("string"))
    return rows.select("document_id", "filename", "page", (F.col("at") + 1).alias("chunk_no"), chunk_id.alias("chunk_id"), "text")


def _all(pattern: str) -> Column:
    return F.regexp_extract_all("sent", F.lit(pattern), F.lit(0))


def _before(pattern: str) -> Column:
    """What stands in the sentence before a pattern's first match."""
    return F.regexp_extract("sent", f"(?s)^(.*?){pattern}", 1)


def _body_type(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("Department")), "DEPARTMENT").otherwise("COMMITTEE")


def _actor(prefix: Column) -> Column:
    """The person or body named last in a prefix, with its type; null if none."""
    named = F.regexp_extract_all(prefix, F.lit(f"{lexicon.PERSON}|{lexicon.BODY}"), F.lit(0))
    last = F.try_element_at(named, F.lit(-1))
    kind = F.when(last.rlike(f"^(?:{lexicon.PERSON})$"), "PERSON").otherwise(_body_type(last))
    return F.when(last.isNotNull(), F.struct(last.alias("name"), kind.alias("type")))


def _object(found: Column) -> Column:
    """The object of a decision without what only introduces it."""
    s = F.regexp_replace(found, "^[ ,.;]+|[ ,.;]+$", "")
    for _ in range(3):
        for lead in lexicon.OBJECT_LEADS:
            s = F.regexp_replace(s, lead, "")
    return F.trim(s)


def sentences(chunked: DataFrame) -> DataFrame:
    """One row per sentence with all that it says and what it inherits."""
    s = chunked.select("*", F.posexplode(text.sentences(F.col("text"))).alias("sent_no", "sent"))
    s = s.select("*", F.lower("sent").alias("low"), _all(lexicon.PERSON).alias("persons"), _all(lexicon.BODY).alias("bodies"), _all(lexicon.ORGANIZATION).alias("orgs"), F.filter(F.transform(_all(lexicon.DATE), lambda d: F.struct(d.alias("said"), dates.parse_date(d).alias("iso"))), lambda d: d["iso"].isNotNull()).alias("dates"))
    body, date = F.get("bodies", F.lit(0)), F.get("dates", F.lit(0))
    meets = (F.size("bodies") > 0) & (F.size("dates") > 0) & F.col("sent").rlike(lexicon.MEETING)
    meeting = F.struct(F.concat(text.display_name(body), F.lit(" meeting on "), date["said"]).alias("name"), text.normalize_name(body).alias("key"), date["iso"].alias("iso"), body.alias("body"))
    s = s.withColumn("meeting", F.when(meets, meeting))
    # Each part is a column of its own first, so that no pattern is matched twice.
    s = s.withColumns({"_verb": F.lower(F.regexp_extract("sent", lexicon.DECISION, 1)), "_found": F.regexp_extract("sent", lexicon.DECISION, 2), "_ahead": _before(lexicon.DECISION), "_why": F.regexp_extract("sent", lexicon.REASON, 1), "_act": F.regexp_replace(F.regexp_extract("sent", f"(?s){lexicon.ACTION}(.*)$", 1), "[ .;]+$", ""), "_lead": _before(lexicon.ACTION)})
    s = s.withColumns({"_obj": _object(F.col("_found")), "_actor": _actor(F.col("_ahead")), "_doer": _actor(F.col("_lead")), "_due": F.regexp_extract("_act", rf"\s+by\s+({lexicon.DATE})\s*$", 1)})
    fine = (F.col("_verb") != "") & F.char_length("_obj").between(3, 120) & ~F.lower("_obj").isin(lexicon.VAGUE) & F.col("_actor").isNotNull()
    reason = F.when(F.char_length("_why").between(3, 250), F.regexp_replace("_why", "^[ .;]+|[ .;]+$", ""))
    s = s.withColumn("decision", F.when(fine, F.struct(F.col("_obj").alias("name"), F.col("_verb").alias("verb"), F.col("_actor").alias("actor"), date["iso"].alias("date"), reason.alias("reason"))))
    act = F.when(F.col("_due") != "", F.regexp_replace("_act", rf"\s+by\s+{lexicon.DATE}\s*$", "")).otherwise(F.col("_act"))
    fine = F.col("_doer").isNotNull() & F.char_length(act).between(3, 200)
    s = s.withColumn("action", F.when(fine, F.struct(act.alias("name"), F.col("_doer").alias("actor"), F.get(F.transform(F.filter(F.array("_due"), lambda d: d != ""), dates.parse_date), F.lit(0)).alias("due"), F.col("low").rlike(lexicon.FOLLOWS).alias("follows"))))
    s = s.drop("_verb", "_found", "_ahead", "_why", "_act", "_lead", "_obj", "_actor", "_doer", "_due")
    w = Window.partitionBy("document_id", "chunk_id").orderBy("sent_no").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("*", F.last("meeting", True).over(w).alias("last_meeting"), F.collect_list("meeting").over(w).alias("meetings"), F.last("decision.name", True).over(w).alias("last_decision"))


def _entity(name: Column, kind: Column | str) -> Column:
    return F.struct(name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"))


def _relation(src: Column, relation: Column | str, dst: Column, when: Column, date: Column | None = None) -> Column:
    """An array of one relationship where ``when`` holds, else of none."""
    one = F.struct(src.alias("src"), (F.lit(relation) if isinstance(relation, str) else relation).alias("relation"), dst.alias("dst"), (F.lit(None).cast("string") if date is None else date).alias("date"))
    return F.when(F.coalesce(when, F.lit(False)), F.array(one)).otherwise(F.array().cast("array<struct<src:struct<name:string,type:string>,relation:string,dst:struct<name:string,type:string>,date:string>>"))


def statements(said: DataFrame) -> DataFrame:
    """One row per relationship of a sentence: provenance, src(name, type), relation, dst(name, type), date."""
    c = F.col
    last = c("last_meeting")
    meeting, body0, person0 = _entity(c("meeting.name"), "MEETING"), F.get("bodies", F.lit(0)), F.get("persons", F.lit(0))
    decided, actor = _entity(c("decision.name"), "DECISION"), c("decision.actor")
    relation = F.try_element_at(F.create_map(*[F.lit(x) for kv in lexicon.VERB_RELATION.items() for x in kv]), c("decision.verb"))
    outcome = c("decision").isNotNull() & (c("decision.verb") != "proposed")
    own = text.normalize_name(c("decision.actor.name"))
    at = F.when(c("decision.date").isNotNull(), F.try_element_at(F.filter("meetings", lambda m: (m["key"] == own) & (m["iso"] == c("decision.date"))), F.lit(-1))["name"]).when(last["key"] == own, last["name"])
    action = _entity(c("action.name"), "ACTION")
    none = "array<struct<src:struct<name:string,type:string>,relation:string,dst:struct<name:string,type:string>,date:string>>"
    part = F.flatten(F.transform("bodies", lambda b: F.transform(F.filter("orgs", lambda o: F.regexp(F.regexp_replace(c("sent"), r"\s+", " "), F.concat(F.lit(r"\Q"), b, F.lit(r"\E of \Q"), o, F.lit(r"\E")))), lambda o: F.struct(F.struct(b.alias("name"), _body_type(b).alias("type")).alias("src"), F.lit("PART_OF").alias("relation"), F.struct(o.alias("name"), F.lit("ORGANIZATION").alias("type")).alias("dst"), F.lit(None).cast("string").alias("date")))))
    attended = F.when(last.isNotNull() & c("low").rlike(lexicon.ATTENDED), F.transform("persons", lambda p: F.struct(F.struct(p.alias("name"), F.lit("PERSON").alias("type")).alias("src"), F.lit("ATTENDED").alias("relation"), F.struct(last["name"].alias("name"), F.lit("MEETING").alias("type")).alias("dst"), F.lit(None).cast("string").alias("date")))).otherwise(F.array().cast(none))
    found = F.concat(
        part.cast(none),
        _relation(meeting, "HELD_ON", _entity(c("meeting.iso"), "DATE"), c("meeting").isNotNull()),
        _relation(_entity(c("meeting.body"), _body_type(c("meeting.body"))), "CONVENED", meeting, c("meeting").isNotNull()),
        _relation(_entity(person0, "PERSON"), "CHAIRED", _entity(last["name"], "MEETING"), last.isNotNull() & person0.isNotNull() & F.contains("low", F.lit("chaired"))),
        attended.cast(none),
        _relation(_entity(person0, "PERSON"), "MEMBER_OF", _entity(body0, _body_type(body0)), person0.isNotNull() & body0.isNotNull() & c("low").rlike(lexicon.MEMBERS)),
        _relation(decided, relation, actor, c("decision").isNotNull(), c("decision.date")),
        _relation(decided, "DECIDED_ON", _entity(c("decision.date"), "DATE"), outcome & c("decision.date").isNotNull(), c("decision.date")),
        _relation(decided, "DECIDED_AT", _entity(at, "MEETING"), outcome & (actor["type"] != "PERSON") & at.isNotNull()),
        _relation(decided, "JUSTIFIED_BY", _entity(c("decision.reason"), "REASON"), c("decision.reason").isNotNull()),
        _relation(action, "ASSIGNED_TO", c("action.actor"), c("action").isNotNull()),
        _relation(action, "DUE_ON", _entity(c("action.due"), "DATE"), c("action.due").isNotNull()),
        _relation(_entity(c("last_decision"), "DECISION"), "LED_TO", action, c("last_decision").isNotNull() & c("action.follows")),
    )
    return said.select(_provenance().alias("prov"), F.explode(found).alias("r")).select("prov", "r.*")


def _provenance() -> Column:
    return F.struct("document_id", "filename", "page", "chunk_id", F.col("sent").alias("evidence"), F.lit("rules").alias("mode"))


def _id(kind: Column, name: Column) -> Column:
    """A node's id; dates are named by their ISO form here."""
    return F.when(kind == "DATE", F.concat(F.lit("DATE:"), name)).otherwise(F.concat(kind, F.lit(":"), text.normalize_name(name, kind)))


def mentions(said: DataFrame) -> DataFrame:
    """One row per entity that a sentence names: prov, name, type, grounded in its chunk."""
    each = lambda col, kind: F.transform(col, lambda x: F.struct(x.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind(x)).alias("type")))
    some = lambda x, kind: F.when(x.isNotNull(), F.array(F.struct(x.alias("name"), F.lit(kind).alias("type")))).otherwise(F.array().cast("array<struct<name:string,type:string>>"))
    found = F.concat(each("persons", "PERSON"), each("bodies", _body_type), each("orgs", "ORGANIZATION"), each(F.transform("dates", lambda d: d["iso"]), "DATE"), each(F.array_compact(F.array("action.due")), "DATE"), some(F.col("meeting.name"), "MEETING"), some(F.col("decision.name"), "DECISION"), some(F.col("decision.reason"), "REASON"), some(F.col("action.name"), "ACTION"))
    rows = said.select(_provenance().alias("prov"), "text", "sent_no", F.posexplode(found).alias("at", "e")).select("prov", "text", "sent_no", "at", "e.name", "e.type")
    grounded = (F.col("type") == "DATE") | text.text_supports(F.col("name"), F.col("text"))
    return rows.where(grounded).withColumn("date_iso", F.when(F.col("type") == "DATE", F.col("name"))).withColumn("id", _id(F.col("type"), F.col("name")))


def extract(documents: DataFrame, limit: int = 1500) -> tuple[DataFrame, DataFrame]:
    """(nodes, facts) merged over all documents; see ``graph`` for their columns. The merge by id is the only shuffle of each."""
    said = sentences(chunks(documents, limit))
    named = mentions(said)
    # A chunk states an entity once, where it first appears.
    w = Window.partitionBy("id", "prov.document_id", "prov.chunk_id").orderBy("sent_no", "at")
    named = named.withColumn("k", F.row_number().over(w)).where("k = 1")
    display = F.when(F.col("type") == "DATE", F.col("date_iso")).otherwise(text.display_name(F.col("name")))
    nodes = named.withColumn("shown", display).groupBy("id", "type").agg(
        F.max_by("shown", F.struct(F.char_length("shown"), "shown")).alias("name"), F.array_sort(F.collect_set("shown")).alias("aliases"), F.max("date_iso").alias("date_iso"), F.lit(None).cast("string").alias("description"),
        F.lit(False).alias("source_document"), F.array_sort(F.collect_set("prov")).alias("provenance"),
    )
    end = lambda x: _id(F.col(f"{x}.type"), F.col(f"{x}.name"))
    facts = statements(said).select(end("src").alias("source_id"), end("dst").alias("target_id"), "relation", F.col("date").alias("date_iso"), "prov").where("source_id <> target_id")
    facts = facts.groupBy("source_id", "target_id", "relation", "date_iso").agg(F.array_sort(F.collect_set("prov")).alias("provenance"))
    known = nodes.select("id")
    facts = facts.join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes.withColumn("aliases", F.array_except("aliases", F.array("name"))), facts


def union(nodes: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs that were extracted apart, laid together (``nodes`` and ``facts`` of all of them), as one: an entity of several is one
    node with the longest name, all others as aliases and every sentence once."""
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    one = nodes.groupBy("id", "type").agg(
        F.max_by("name", F.struct(F.char_length("name"), "name")).alias("name"), F.array_distinct(F.concat(every("aliases"), F.array_sort(F.collect_set("name")))).alias("aliases"), F.max("date_iso").alias("date_iso"),
        F.max("description").alias("description"), F.bool_and("source_document").alias("source_document"), every("provenance").alias("provenance"),
    )
    facts = facts.groupBy("source_id", "target_id", "relation", "date_iso").agg(every("provenance").alias("provenance"))
    return one.withColumn("aliases", F.array_except("aliases", F.array("name"))), facts
