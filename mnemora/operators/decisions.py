"""What surrounds decisions: dated events, linked entities and related decisions, for all decisions at once or for some."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.lexicon import DATED_ORDER, EVENT_KINDS, OUTCOMES

DEFAULT_KINDS = EVENT_KINDS["decide"] + EVENT_KINDS["propose"]
_PARTIAL = re.compile(r"\d{4}(-\d{2}(-\d{2})?)?")


def ids(nodes: DataFrame) -> DataFrame:
    """decision_id, decision."""
    return nodes.where("type = 'DECISION' and not source_document").select(F.col("id").alias("decision_id"), F.col("name").alias("decision"))


def _of(facts: DataFrame, *relations: str, source: str = "decision_id", target: str = "target_id") -> DataFrame:
    return facts.where(F.col("relation").isin(list(relations))).select(F.col("source_id").alias(source), F.col("target_id").alias(target))


def events(nodes: DataFrame, facts: DataFrame, own: DataFrame) -> DataFrame:
    """decision_id, kind, date_iso: each dated event of a decision once. ``own`` are the decisions' ``trails.steps``; the meetings that
    they were decided at and the deadlines of the actions that they led to come from the graph."""
    stepped = own.where(F.col("date_iso").isNotNull() & F.col("kind").isin(*[k for k in DATED_ORDER if k != "MEETING"])).select("decision_id", "kind", "date_iso")
    dated = nodes.where(F.col("date_iso").isNotNull()).select(F.col("id").alias("target_id"), "date_iso")
    some = ids(nodes).select("decision_id")
    met = _of(facts, "DECIDED_AT").join(dated, "target_id").select("decision_id", F.lit("MEETING").alias("kind"), "date_iso")
    due = _of(facts, "DUE_ON", source="action_id").join(dated, "target_id").select("action_id", "date_iso")
    due = _of(facts, "LED_TO", target="action_id").join(due, "action_id").select("decision_id", F.lit("DUE").alias("kind"), "date_iso")
    return stepped.unionByName(met.unionByName(due).join(some, "decision_id", "left_semi")).distinct()


def links(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """decision_id, entity_id: actors, meetings and who convened them, and those that actions are assigned to; with each of them the
    organisations that it is part of."""
    actors, met = _of(facts, *OUTCOMES, target="entity_id"), _of(facts, "DECIDED_AT", target="entity_id")
    convened = _of(facts, "CONVENED", source="convener", target="entity_id")
    conveners = met.join(convened, "entity_id").select("decision_id", F.col("convener").alias("entity_id"))
    assigned = _of(facts, "ASSIGNED_TO", source="action_id", target="entity_id")
    assignees = _of(facts, "LED_TO", target="action_id").join(assigned, "action_id").select("decision_id", "entity_id")
    near = actors.unionByName(met).unionByName(conveners).unionByName(assignees).join(ids(nodes), "decision_id", "left_semi").distinct()
    bodies = _of(facts, "PART_OF", source="entity_id", target="whole").join(nodes.where("type = 'ORGANIZATION'").select(F.col("id").alias("whole")), "whole", "left_semi")
    return near.unionByName(near.join(bodies, "entity_id").select("decision_id", F.col("whole").alias("entity_id"))).distinct()


def related(nodes: DataFrame, facts: DataFrame, some: DataFrame) -> DataFrame:
    """decision_id, other_id: to each decision in ``some`` (decision_id) those that follow up or supersede it or the other way round,
    and those that led to one of its actions."""
    every = ids(nodes).select("decision_id")
    explicit = _of(facts, "FOLLOWS_UP", "SUPERSEDES", source="a", target="b")
    both = explicit.unionByName(explicit.select(F.col("b").alias("a"), F.col("a").alias("b")))
    led = _of(facts, "LED_TO", source="a", target="action_id")
    own = led.join(some, led["a"] == some["decision_id"], "left_semi")
    shared = own.join(led.withColumnRenamed("a", "b"), "action_id").select("a", "b")
    pairs = both.join(some, both["a"] == some["decision_id"], "left_semi").unionByName(shared).where("a <> b").distinct()
    return pairs.join(every, pairs["b"] == every["decision_id"], "left_semi").select(F.col("a").alias("decision_id"), F.col("b").alias("other_id"))


def bound(value: str, name: str) -> Column:
    """A partial date as a column; ValueError if it isn't one or isn't in the calendar."""
    import datetime

    if not isinstance(value, str) or not _PARTIAL.fullmatch(value):
        raise ValueError(f"{name} must be YYYY, YYYY-MM or YYYY-MM-DD, not {value!r}")
    datetime.date.fromisoformat((value + "-01-01")[:10])
    return F.lit(value)


def dated_within(found: DataFrame, start: str | None, end: str | None, kinds: tuple[str, ...] = DEFAULT_KINDS) -> DataFrame:
    """decision_id of the ``events`` of these kinds that lie in [start, end]; either end may be open, a month's end is its last day."""
    lo = F.lit("0001-01-01").cast("date") if start is None else dates.span_start(bound(start, "start"))
    hi = F.lit("9999-12-31").cast("date") if end is None else dates.span_end(bound(end, "end"))
    if start is not None and end is not None and _last(end) < (start + "-01-01")[:10]:
        raise ValueError(f"start {start!r} is after end {end!r}")
    return found.where(F.col("kind").isin(list(kinds)) & dates.within(F.col("date_iso"), lo, hi)).select("decision_id").distinct()


def _last(partial: str) -> str:
    """No day of the partial date is later, as text."""
    return (partial + "-12-31")[:10] if len(partial) == 4 else (partial + "-31")[:10]


def chronological(found: DataFrame) -> DataFrame:
    """``trails.trails`` by first date, those without at the end, then by name and id."""
    return found.orderBy(F.asc_nulls_last("first_date"), "decision", "decision_id")


def on_date(found: DataFrame, dated: DataFrame, date_iso: str, intent: str | None = None) -> DataFrame:
    """The ``trails`` in ``found`` with an event on a date: outcomes and meetings ('decide'), proposals ('propose'), deadlines ('due'),
    or the first two (None). A month's event is on no single day."""
    if intent is not None and intent not in EVENT_KINDS:
        raise ValueError(f"intent must be one of {sorted(EVENT_KINDS)} or None, not {intent!r}")
    kinds = EVENT_KINDS[intent] if intent else DEFAULT_KINDS
    return chronological(found.join(dated_within(dated, date_iso, date_iso, kinds), "decision_id", "left_semi"))


def in_range(found: DataFrame, dated: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The ``trails`` in ``found`` with an event in a range, deadlines aside; all of them where both ends are open."""
    if start is None and end is None:
        return chronological(found)
    return chronological(found.join(dated_within(dated, start, end), "decision_id", "left_semi"))


def entities_on(nodes: DataFrame, facts: DataFrame, date_iso: str) -> DataFrame:
    """id, name, type, relation of all that a fact ties to a date in the period."""
    period = dates.span_start(bound(date_iso, "date_iso")), dates.span_end(F.lit(date_iso))
    days = nodes.where("type = 'DATE' and not source_document").where(dates.within(F.col("date_iso"), *period)).select(F.col("id").alias("target_id"))
    said = facts.join(days, "target_id", "left_semi").select(F.col("source_id").alias("id"), "relation").distinct()
    return nodes.select("id", "name", "type").join(said, "id").distinct().orderBy("id", "relation")
