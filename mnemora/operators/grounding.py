"""What a model says about chunks, checked against their text: payloads to grounded entities and relationships, errors and warnings.

A payload is JSON text beside its chunk (document_id, filename, page, chunk_id, text, payload). Each list item becomes a row with its
place, so that everything is a projection or a join within a chunk; the order of places stands for the order in which a reader would
add the items. Bad items are dropped and reported, never raised.

Defined cases: a null payload isn't a JSON object; a blank chunk is skipped with a warning; a chunk given twice counts twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, lexicon, records, text

CHUNK = ["document_id", "filename", "page", "chunk_id"]


@dataclass
class Grounded:
    """entities: the chunk's columns, place, id, name, type, aliases, date_iso, description, evidence. relations: the chunk's columns,
    place, source_id, target_id, relation, date_iso, evidence. errors and warnings: the chunk's columns, place, message."""

    entities: DataFrame
    relations: DataFrame
    errors: DataFrame
    warnings: DataFrame


def _texted(item: Column, field: str) -> Column:
    return records.optional(F.coalesce(F.try_variant_get(item, f"$.{field}", "string"), F.lit("")))


def items(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, errors) as the payloads have them: cleaned fields with the item's place, and what is wrong with the
    rest. ``relations`` is read where there is no ``relationships``."""
    read = payloads.where(F.trim("text") != "").select(*CHUNK, "text", F.try_parse_json(records.loose_json(F.col("payload"))).alias("v"))
    read = read.withColumn("object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    of = lambda name: F.try_variant_get("v", f"$.{name}", "array<variant>")
    there = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    present = lambda x: x.isNotNull() & (F.schema_of_variant(x) != "VOID")
    relations = F.when(present(there("relationships")), there("relationships")).otherwise(there("relations"))
    read = read.withColumns({"es": of("entities"), "rs": F.coalesce(of("relationships"), F.when(~present(there("relationships")), of("relations"))), "has_es": present(there("entities")), "has_rs": present(relations)})
    whole = F.array_compact(F.array(
        F.when(~F.col("object"), F.lit("payload is not a JSON object")), F.when(F.col("object") & ~F.col("has_es"), F.lit("payload has no 'entities' list")),
        F.when(F.col("object") & F.col("has_es") & F.col("es").isNull(), F.lit("'entities' is not a list")), F.when(F.col("object") & F.col("has_rs") & F.col("rs").isNull(), F.lit("'relationships' is not a list")),
    ))
    errors = read.select(*CHUNK, F.lit(-1).alias("place"), F.explode(whole).alias("message"))

    e = read.where("object").select(*CHUNK, "text", F.posexplode("es").alias("place", "x"))
    e = e.withColumns({"name": _texted(F.col("x"), "name"), "type": records.entity_type(F.try_variant_get("x", "$.type", "string")), "date": _texted(F.col("x"), "date"), "description": _texted(F.col("x"), "description"), "evidence": _texted(F.col("x"), "evidence")})
    wrong_e = F.array_compact(F.array(F.when(F.col("name").isNull(), F.lit("name: name is required")), F.when(F.col("type").isNull(), F.lit("type: unknown entity type"))))
    r = read.where("object").select(*CHUNK, "text", F.posexplode("rs").alias("place", "x"))
    hint = lambda f: records.entity_type(F.try_variant_get("x", f"$.{f}", "string"))
    r = r.withColumns({"source": _texted(F.col("x"), "source"), "target": _texted(F.col("x"), "target"), "relation": records.relation_type(F.try_variant_get("x", "$.relation", "string")), "source_type": hint("source_type"), "target_type": hint("target_type"), "date": _texted(F.col("x"), "date"), "evidence": _texted(F.col("x"), "evidence")})
    wrong_r = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c}: endpoint name is required")) for c in ("source", "target")]))
    for df, wrong, name in ((e, wrong_e, "entities"), (r, wrong_r, "relationships")):
        bad = df.withColumn("wrong", wrong).where(F.size("wrong") > 0)
        errors = errors.unionByName(bad.select(*CHUNK, "place", F.concat(F.lit(f"{name}["), "place", F.lit("] invalid: "), short_error(F.col("wrong"))).alias("message")))
    return e.where(F.size(wrong_e) == 0).drop("x"), r.where(F.size(wrong_r) == 0).drop("x"), errors


def short_error(messages: Column) -> Column:
    """The first three messages as one."""
    return F.array_join(F.slice(messages, 1, 3), "; ")


def verified_quote(evidence: Column, body: Column) -> Column:
    """The quote if the chunk has it, else null."""
    return F.when(evidence.isNotNull() & text.quoted(evidence, body), evidence)


def verified_date(said: Column, body: Column) -> Column:
    """The date if it is one and the chunk has it, else null."""
    iso = dates.parse_date(said)
    return F.when(said.isNotNull() & F.array_contains(dates.dates_in_text(body), iso), iso)


def _checked(rows: DataFrame, label: Column) -> DataFrame:
    """Entities with their id and display form, and ``error`` and ``notes`` where something doesn't hold."""
    is_date = F.col("type") == "DATE"
    rows = rows.withColumns({"label": label, "own": F.when(is_date, dates.parse_date(F.col("name"))), "iso": F.when(~is_date, verified_date(F.col("date"), F.col("text"))), "quote": verified_quote(F.col("evidence"), F.col("text"))})
    error = F.when(is_date & F.col("own").isNull(), "unparseable date; dropped").when(is_date & ~F.array_contains(dates.dates_in_text(F.col("text")), F.col("own")), "date not found in source text; dropped")
    error = error.when(~is_date & ~text.text_supports(F.col("name"), F.col("text")), "not supported by source text; dropped")
    notes = F.array_compact(F.array(
        F.when(~is_date & F.col("date").isNotNull() & F.col("iso").isNull(), F.concat("label", F.lit(": date '"), "date", F.lit("' not found in source text; ignored"))),
        F.when(F.col("evidence").isNotNull() & F.col("quote").isNull(), F.concat("label", F.lit(": evidence quote not found in source text; ignored"))),
    ))
    shown = F.when(is_date, F.col("own")).otherwise(text.display_name(F.col("name")))
    rows = rows.withColumns({"error": error, "notes": notes, "shown": shown, "date_iso": F.coalesce("own", "iso"), "aliases": F.when(is_date & (F.col("name") != F.col("own")), F.array("name")).otherwise(F.array().cast("array<string>"))})
    return rows.withColumn("id", text.entity_id(F.col("type"), F.col("shown"), F.col("own")))


def ground(payloads: DataFrame, require_evidence: bool = True) -> Grounded:
    """What of the payloads the chunks' texts bear out."""
    said, related, errors = items(payloads)
    checked = _checked(said, F.concat(F.lit("entity '"), "name", F.lit("'")))
    columns = [*CHUNK, "place", "id", F.col("shown").alias("name"), "type", "aliases", "date_iso", "description", F.col("quote").alias("evidence")]
    entities = checked.where("error is null").select(*columns)
    complained = checked.where("error is not null").select(*CHUNK, "place", F.concat("label", F.lit(": "), "error").alias("message"))
    warned = checked.where("error is null").select(*CHUNK, "place", F.explode("notes").alias("message"))

    # Endpoints, two to a relationship. Dates stand for themselves; others are the first entity of that name; with a type that the
    # text bears out, an endpoint that is no entity yet becomes one.
    label = F.concat(F.lit("relationship '"), "source", F.lit("' -"), "relation", F.lit("-> '"), "target", F.lit("'"))
    related = related.withColumn("label", label).withColumn("rel", F.struct(*CHUNK, "place"))
    ends = related.select(*CHUNK, "text", "place", "rel", "label", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("name"), F.col("source_type").alias("hint")), F.struct(F.lit(1).alias("side"), F.col("target").alias("name"), F.col("target_type").alias("hint")))).alias("end"))
    ends = ends.select(*CHUNK, "text", "place", "rel", "label", "end.*").withColumn("step", 2 * F.col("place") + F.col("side"))
    is_date = F.trim("name").rlike(f"^(?:{lexicon.DATE})$")
    made = ends.withColumn("type", F.when(is_date, "DATE").otherwise(F.when(F.col("hint") != "DATE", F.col("hint")))).where("type is not null")
    none = F.lit(None).cast("string")
    made = _checked(made.withColumns({"date": none, "description": none, "evidence": none}), F.concat(F.lit("entity '"), "name", F.lit("'")))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in CHUNK]
    on = same[0] & same[1] & same[2] & same[3]
    names = lambda df: df.select(*CHUNK, "id", "type", "at", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), lambda n: text.normalize_name(n, F.col("type"))))).alias("key")).where("key <> ''")
    listed = names(entities.withColumn("at", F.col("place") - (1 << 30)))
    added = made.where("error is null").select(*CHUNK, "id", "type", F.col("step").alias("at"), F.col("shown").alias("name"), "aliases")
    known = listed.unionByName(names(added)).groupBy(*CHUNK, "id", "type", "key").agg(F.min("at").alias("at"))
    wanted = ends.withColumn("is_date", is_date).withColumn("iso", F.when(F.col("is_date"), dates.parse_date(F.col("name"))))
    keyed = wanted.alias("l").join(known.alias("r"), on & (F.col("l.name").isNotNull()) & (F.col("r.at") <= F.col("l.step")) & F.when(F.col("l.is_date"), F.col("r.id") == F.concat(F.lit("DATE:"), F.col("l.iso"))).otherwise((F.col("l.hint").isNull() | (F.col("r.type") == F.col("l.hint"))) & (F.col("r.key") == text.normalize_name(F.col("l.name"), F.col("r.type")))))
    found = keyed.groupBy("l.rel", "l.side").agg(F.min(F.struct("r.at", "r.id", "r.type")).alias("hit"))
    src, dst = (found.where(F.col("side") == k).select("rel", F.col("hit.id").alias(f"{p}_id"), F.col("hit.type").alias(f"{p}_type_found")) for k, p in ((0, "s"), (1, "t")))
    joined = related.alias("q").join(src.alias("a"), F.col("q.rel").eqNullSafe(F.col("a.rel")), "left").join(dst.alias("b"), F.col("q.rel").eqNullSafe(F.col("b.rel")), "left").select("q.*", "s_id", "s_type_found", "t_id", "t_type_found")
    way = records.direction(F.col("relation"), F.col("s_type_found"), F.col("t_type_found"))
    joined = joined.withColumns({"way": way, "quote": verified_quote(F.col("evidence"), F.col("text")), "iso": verified_date(F.col("date"), F.col("text"))})
    error = F.when(F.col("s_id").isNull() | F.col("t_id").isNull(), "endpoint not found among extracted entities; dropped").when(F.col("s_id") == F.col("t_id"), "self-loop; dropped")
    error = error.when(F.col("way") == "invalid", F.concat(F.lit("incompatible entity types ("), "s_type_found", F.lit(" -> "), "t_type_found", F.lit("); dropped")))
    if require_evidence:
        error = error.when(F.col("quote").isNull(), "no verifiable evidence in source text; dropped")
    joined = joined.withColumn("error", error)
    typed = ~F.coalesce(F.col("error").rlike("^(?:endpoint|self|incompatible)"), F.lit(False))
    notes = F.array_compact(F.array(
        F.when(typed & (F.col("way") == "flip"), F.concat("label", F.lit(": direction corrected"))), F.when(typed & F.col("evidence").isNotNull() & F.col("quote").isNull(), F.concat("label", F.lit(": evidence quote not found in source text; ignored"))),
        F.when(F.col("error").isNull() & F.col("date").isNotNull() & F.col("iso").isNull(), F.concat("label", F.lit(": date '"), "date", F.lit("' not found in source text; ignored"))),
    ))
    flip = F.col("way") == "flip"
    good = joined.where("error is null")
    relations = good.select(*CHUNK, "place", F.when(flip, F.col("t_id")).otherwise(F.col("s_id")).alias("source_id"), F.when(flip, F.col("s_id")).otherwise(F.col("t_id")).alias("target_id"), "relation", F.col("iso").alias("date_iso"), F.col("quote").alias("evidence"))
    # Of the endpoints only those that no entity before them had are new.
    first = Window.partitionBy(*CHUNK, "id").orderBy("step")
    fresh = made.where("error is null").withColumn("k", F.row_number().over(first)).where("k = 1").alias("l").join(listed.alias("r"), on & (F.col("l.id") == F.col("r.id")), "left_anti")
    resolved = keyed.where("r.at < l.step").select(F.col("l.rel").alias("rel"), F.col("l.side").alias("side")).distinct().alias("d")
    fresh = fresh.join(resolved, (F.col("l.rel") == F.col("d.rel")) & (F.col("l.side") == F.col("d.side")), "left_anti")
    unfit = made.where("type = 'DATE' and error is not null").select(*CHUNK, F.col("place"), F.concat("label", F.lit(": "), "error").alias("message"))
    entities = entities.unionByName(fresh.select(*[F.col(c) for c in CHUNK], (F.col("step") + (1 << 30)).cast("int").alias("place"), "id", F.col("shown").alias("name"), "type", "aliases", "date_iso", F.col("description"), F.col("quote").alias("evidence")))
    errors = errors.unionByName(complained).unionByName(unfit).unionByName(joined.where("error is not null").select(*CHUNK, "place", F.concat("label", F.lit(": "), "error").alias("message")))
    blank = payloads.where(F.coalesce(F.trim("text"), F.lit("")) == "").select(*CHUNK, F.lit(-1).alias("place"), F.lit("empty chunk skipped").alias("message"))
    warnings = warned.unionByName(joined.select(*CHUNK, "place", F.explode(notes).alias("message"))).unionByName(blank)
    return Grounded(entities, relations, errors, warnings)


def merged(found: Grounded, mode: str = "real") -> tuple[DataFrame, DataFrame]:
    """(nodes, facts) of all chunks, merged by id as ``extraction.extract`` gives them: the longest name, all others as aliases, the
    first description and date, every sentence once."""
    prov = F.struct(*CHUNK, "evidence", F.lit(mode).alias("mode"))
    place = F.struct("document_id", "chunk_id", "place")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), place))
    e = found.entities.withColumn("prov", prov)
    nodes = e.groupBy("id", "type").agg(
        F.max_by("name", F.struct(F.char_length("name"), "name")).alias("name"), F.array_sort(F.array_distinct(F.concat(F.collect_set("name"), F.flatten(F.collect_set("aliases"))))).alias("aliases"),
        first("date_iso").alias("date_iso"), first("description").alias("description"), F.lit(False).alias("source_document"), F.array_sort(F.collect_set("prov")).alias("provenance"),
    )
    facts = found.relations.withColumn("prov", prov).groupBy("source_id", "target_id", "relation", "date_iso").agg(F.array_sort(F.collect_set("prov")).alias("provenance"))
    return nodes.withColumn("aliases", F.array_except("aliases", F.array("name"))), facts


def summaries(payloads: DataFrame, found: Grounded, failed: DataFrame | None = None) -> DataFrame:
    """document_id, chunks_processed, chunks_failed, errors, warnings, mode, ok for each document. payloads may have a ``mode`` a
    chunk ('real' where it hasn't); ``failed`` has a row (document_id, chunk_id, message, unavailable) for each chunk without an answer."""
    mode = F.col("mode") if "mode" in payloads.columns else F.lit("real")
    chunks = payloads.groupBy("document_id").agg(F.count("*").alias("chunks_processed"), F.collect_set(mode).alias("modes"))
    lost = payloads.sparkSession.createDataFrame([], "document_id string, chunk_id string, message string, unavailable boolean") if failed is None else failed
    bad = lost.groupBy("document_id").agg(F.count("*").alias("chunks_failed"), F.bool_or("unavailable").alias("unavailable"), F.collect_list("message").alias("lost"))
    told = lambda df, name: df.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "place", "message"))), lambda x: x["message"]).alias(name))
    out = chunks.join(bad, "document_id", "left").join(told(found.errors, "errors"), "document_id", "left").join(told(found.warnings, "warnings"), "document_id", "left")
    none = F.array().cast("array<string>")
    n = F.coalesce("chunks_failed", F.lit(0))
    return out.select("document_id", "chunks_processed", n.alias("chunks_failed"), F.concat(F.coalesce("lost", none), F.coalesce("errors", none)).alias("errors"), F.coalesce("warnings", none).alias("warnings"), F.when(F.size("modes") == 1, F.get("modes", F.lit(0))).otherwise("mixed").alias("mode"), ((n == 0) & ~F.coalesce("unavailable", F.lit(False))).alias("ok"))
