"""Decision trails: for all decisions at once, their steps in order, with status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import DATED_ORDER, OUTCOMES, UNDATED_ORDER


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _keys(col: str) -> Column:
    """The sentences that something was said in."""
    return F.transform(col, lambda p: F.struct(p["document_id"], p["page"], p["chunk_id"], p["evidence"]))


def _outcomes(out: DataFrame, facts: DataFrame, meetings: DataFrame, decided: DataFrame) -> DataFrame:
    """Proposals and outcomes with the meeting and date that the sources support."""
    raw = out.where(F.col("relation").isin(list(OUTCOMES))).select("decision_id", F.col("target_id").alias("actor_id"), F.col("target_name").alias("actor"), F.try_element_at(_map({r: k for r, (k, _) in OUTCOMES.items()}), "relation").alias("kind"), F.try_element_at(_map({r: v for r, (_, v) in OUTCOMES.items()}), "relation").alias("verb"), F.col("fact_date").alias("stated"), "provenance", _keys("provenance").alias("keys"))
    rid = ["decision_id", "actor_id", "kind", "stated"]
    convened = facts.where("relation = 'CONVENED'").select(F.col("source_id").alias("actor_id"), F.col("target_id").alias("meeting_id")).distinct()
    cands = raw.where("kind <> 'PROPOSED'").join(meetings, "decision_id").join(convened, ["actor_id", "meeting_id"], "left_semi").where("stated is null or held is null or held = stated")
    m = F.struct(F.col("meeting_id").alias("id"), F.col("meeting").alias("name"), F.col("held").alias("date"))
    shared, same = F.arrays_overlap("keys", "mkeys"), F.col("held") == F.col("stated")
    tiers = cands.groupBy(rid).agg(F.count_if(shared).alias("n1"), F.max(F.when(shared, m)).alias("m1"), F.count_if(same).alias("n2"), F.max(F.when(same, m)).alias("m2"), F.count("*").alias("n3"), F.max(m).alias("m3"))
    pick = F.when(F.col("n1") == 1, F.col("m1")).when(F.col("stated").isNotNull(), F.when(F.col("n2") == 1, F.col("m2"))).when(F.col("n3") == 1, F.col("m3"))
    picked = tiers.select(*[F.col(c).alias(f"_{c}") for c in rid], pick.alias("meet"))
    on = (F.col("decision_id") == F.col("_decision_id")) & (F.col("actor_id") == F.col("_actor_id")) & (F.col("kind") == F.col("_kind")) & F.col("stated").eqNullSafe(F.col("_stated"))
    raw = raw.join(picked, on, "left").drop(*[f"_{c}" for c in rid])
    said = decided.groupBy("decision_id").agg(F.collect_list(F.struct("date", "dkeys")).alias("said"))
    raw = raw.join(said, "decision_id", "left")
    near = F.array_distinct(F.transform(F.filter("said", lambda d: F.arrays_overlap(d["dkeys"], F.col("keys"))), lambda d: d["date"]))
    near = F.when((F.col("kind") != "PROPOSED") & (F.size(near) == 1), F.get(near, F.lit(0)))
    raw = raw.withColumn("date", F.coalesce("stated", "meet.date", near))
    desc = F.concat("actor", F.lit(" "), "verb", F.lit(" '"), "decision", F.lit("'"), F.coalesce(F.concat(F.lit(" at "), "meet.name"), F.lit("")))
    raw = raw.join(out.select("decision_id", "decision").distinct(), "decision_id").withColumn("description", desc)
    # Undated steps said in a sentence with a dated one of the same kind and actor are that step.
    by = Window.partitionBy("decision_id", "kind", "actor_id")
    raw = raw.withColumn("dated", F.collect_list(F.when(F.col("date").isNotNull(), F.struct("date", "keys"))).over(by))
    into = F.array_min(F.transform(F.filter("dated", lambda d: F.arrays_overlap(d["keys"], F.col("keys"))), lambda d: d["date"]))
    raw = raw.withColumn("date", F.coalesce("date", into))
    return raw.groupBy("decision_id", "kind", "actor_id", "actor", "date").agg(F.min("description").alias("description"), F.max("meet").alias("meet"), F.array_distinct(F.flatten(F.collect_list("provenance"))).alias("provenance"))


def steps(nodes: DataFrame, facts: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """decision_id, decision, step_no, date_iso, kind, description, actor, meeting, provenance; of all decisions, or those in ``only``
    (decision_id)."""
    every = decisions = nodes.where("type = 'DECISION' and not source_document").select(F.col("id").alias("decision_id"), F.col("name").alias("decision"))
    if only is not None:
        decisions = every.join(only, "decision_id", "left_semi")
    ends = nodes.where("not source_document").select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("date_iso").alias("target_date"))
    out = facts.where("relation <> 'MENTIONED_IN'").select(F.col("source_id").alias("decision_id"), "target_id", "relation", F.col("date_iso").alias("fact_date"), "provenance").join(decisions, "decision_id").join(ends, "target_id")
    out = out.persist()  # a dozen branches read it
    meetings = out.where("relation = 'DECIDED_AT'").select("decision_id", F.col("target_id").alias("meeting_id"), F.col("target_name").alias("meeting"), F.col("target_date").alias("held"), F.col("provenance").alias("mprov"), _keys("provenance").alias("mkeys"))
    decided = out.where("relation = 'DECIDED_ON' and target_date is not null").select("decision_id", F.col("target_date").alias("date"), F.col("provenance").alias("dprov"), _keys("provenance").alias("dkeys"))
    acts = _outcomes(out, facts, meetings, decided).persist()
    text = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: str, description: Column, provenance: Column, date: Column = text, actor: Column = text, meeting: Column = text) -> DataFrame:
        return df.select("decision_id", date.alias("date_iso"), F.lit(kind).alias("kind"), description.alias("description"), actor.alias("actor"), meeting.alias("meeting"), provenance.alias("provenance"))

    done = acts.where("kind <> 'PROPOSED' and date is not null").select("decision_id", "date").distinct()
    plain = decided.join(done, ["decision_id", "date"], "left_anti").groupBy("decision_id", "date").agg(F.array_distinct(F.flatten(F.collect_list("dprov"))).alias("p"))
    used = acts.where("meet is not null").select("decision_id", F.col("meet.id").alias("meeting_id")).distinct()
    unused = meetings.join(used, ["decision_id", "meeting_id"], "left_anti")
    reasons = out.where("relation = 'JUSTIFIED_BY'").groupBy("decision_id", "target_id", "target_name").agg(F.array_distinct(F.flatten(F.collect_list("provenance"))).alias("p"))
    led = out.where("relation = 'LED_TO'").groupBy("decision_id", "target_id", "target_name").agg(F.flatten(F.collect_list("provenance")).alias("p"))
    more = facts.where("relation in ('ASSIGNED_TO', 'DUE_ON')").select(F.col("source_id").alias("action_id"), F.col("target_id"), "relation", F.col("provenance").alias("q")).join(ends, "target_id").where("relation = 'ASSIGNED_TO' or target_date is not null")
    more = more.groupBy(F.col("action_id").alias("target_id")).agg(F.array_sort(F.collect_set(F.when(F.col("relation") == "ASSIGNED_TO", F.col("target_name")))).alias("who"), F.array_sort(F.collect_set(F.when(F.col("relation") == "DUE_ON", F.col("target_date")))).alias("due"), F.flatten(F.collect_list("q")).alias("q"))
    led = led.join(more, "target_id", "left")
    listed = lambda lead, xs: F.when(F.size(xs) > 0, F.concat(F.lit(lead), F.array_join(xs, ", "), F.lit(")"))).otherwise("")
    spoken = lambda r: F.lower(F.replace(r, F.lit("_"), F.lit(" ")))
    ahead = out.where("relation in ('FOLLOWS_UP', 'SUPERSEDES')")
    back = facts.where("relation in ('FOLLOWS_UP', 'SUPERSEDES')").select(F.col("source_id").alias("other_id"), F.col("target_id").alias("decision_id"), "relation", "provenance")
    back = back.join(decisions.select("decision_id"), "decision_id", "left_semi").join(every.select(F.col("decision_id").alias("other_id"), F.col("decision").alias("other")), "other_id")
    all_steps = [
        acts.select("decision_id", F.col("date").alias("date_iso"), "kind", "description", "actor", F.col("meet.name").alias("meeting"), "provenance"),
        rows(plain, "DECIDED", F.concat(F.lit("Decision dated "), "date"), F.col("p"), F.col("date")),
        rows(unused, "MEETING", F.concat(F.lit("Considered at "), "meeting"), F.col("mprov"), F.col("held"), text, F.col("meeting")),
        rows(reasons, "REASON", F.concat(F.lit("Reason: "), "target_name"), F.col("p")),
        rows(led, "ACTION", F.concat(F.lit("Action: "), "target_name", listed(" (assigned to ", F.col("who")), listed(" (due ", F.col("due"))), F.array_distinct(F.concat("p", F.coalesce("q", F.array().cast(facts.schema["provenance"].dataType)))), text, F.get("who", F.lit(0))),
        rows(ahead, "RELATED_DECISION", F.concat(F.lit("This decision "), spoken(F.col("relation")), F.lit(" '"), "target_name", F.lit("'")), F.col("provenance")),
        rows(back, "RELATED_DECISION", F.concat(F.lit("Decision '"), "other", F.lit("' "), spoken(F.col("relation")), F.lit(" this decision")), F.col("provenance")),
    ]
    union = all_steps[0]
    for s in all_steps[1:]:
        union = union.unionByName(s)
    order = F.when(F.col("date_iso").isNotNull(), F.coalesce(F.try_element_at(_map(DATED_ORDER), "kind"), F.lit(9))).otherwise(F.coalesce(F.try_element_at(_map(UNDATED_ORDER), "kind"), F.lit(9)))
    w = Window.partitionBy("decision_id").orderBy(F.asc_nulls_last("date_iso"), order, F.coalesce("actor", F.lit("")), "description")
    return union.join(decisions, "decision_id").select("decision_id", "decision", F.row_number().over(w).alias("step_no"), "date_iso", "kind", "description", "actor", "meeting", "provenance")


def trails(nodes: DataFrame, facts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """decision_id, decision, status, first_date, n_steps, reasons: every decision, also those without steps. ``own``: the ``steps``, if
    they are there already."""
    own = steps(nodes, facts) if own is None else own
    outcome = F.col("kind").isin("APPROVED", "REJECTED", "DEFERRED")
    s = own.groupBy("decision_id").agg(
        F.min("date_iso").alias("first_date"), F.count("*").alias("n_steps"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "REASON", F.struct("step_no", "description")))), lambda r: F.substring(r["description"], F.lit(9), F.char_length(r["description"])))).alias("reasons"),
        F.max(F.when(outcome, F.col("date_iso"))).alias("last"), F.collect_set(F.when(outcome, F.struct("date_iso", "kind"))).alias("got"), F.bool_or(F.col("kind") == "PROPOSED").alias("proposed"),
    )
    kinds = lambda test: F.array_distinct(F.transform(F.filter("got", test), lambda o: o["kind"]))
    final = F.when(F.col("last").isNotNull(), kinds(lambda o: o["date_iso"] == F.col("last"))).otherwise(kinds(lambda o: F.lit(True)))
    open_ = kinds(lambda o: o["date_iso"].isNull())
    gone = facts.where("relation = 'SUPERSEDES'").select(F.col("target_id").alias("decision_id")).distinct().withColumn("gone", F.lit(True))
    base = nodes.where("type = 'DECISION' and not source_document").select(F.col("id").alias("decision_id"), F.col("name").alias("decision")).join(s, "decision_id", "left").join(gone, "decision_id", "left")
    conflict = (F.size(final) > 1) | (F.col("last").isNotNull() & (F.size(F.array_except(open_, final)) > 0))
    status = F.when(F.col("gone"), "superseded").when(F.size("got") > 0, F.when(conflict, "conflicting").otherwise(F.lower(F.get(final, F.lit(0))))).when(F.col("proposed"), "proposed").otherwise("unknown")
    return base.select("decision_id", "decision", status.alias("status"), "first_date", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def between(own: DataFrame, start: str, end: str, kinds: tuple[str, ...] = ("PROPOSED", "APPROVED", "REJECTED", "DEFERRED", "DECIDED", "MEETING")) -> DataFrame:
    """decision_id, decision of ``steps`` with a step of these kinds whose whole span lies between two partial dates."""
    from ..functions import dates

    if start > end and not start.startswith(end):
        raise ValueError("the range ends before it starts")
    return own.where(F.col("kind").isin(list(kinds)) & dates.within(F.col("date_iso"), dates.span_start(F.lit(start)), dates.span_end(F.lit(end)))).select("decision_id", "decision").distinct()
