"""Questions over the graph: parsed on the driver to a small plan, answered from trails, facts and their sentences.

A question's words are few, so they stand in the plans as literals: no index of the whole graph is built or kept. Each decision is
scored in one aggregation; a second one, grouped by which filters decisions pass, gives a table of a few rows from which the driver
follows the filters one after another and says why a question can't be answered.
"""

from __future__ import annotations

import calendar
import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, lexicon, text
from ..operators import decisions, graph, trails

_ANY_DATE = re.compile(lexicon.DATE, re.I)
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
_RANGES = (
    re.compile(rf"\bbetween\s+({lexicon.DATE})\s+and\s+({lexicon.DATE})", re.I),
    re.compile(rf"(?:\bfrom\s+)?({lexicon.DATE})\s*(?:\bto\b|\bthrough\b|\buntil\b|\btill\b|-|–|—)\s*({lexicon.DATE})", re.I),
)
_MONTH_NO = {name.lower()[:3]: i for i, name in enumerate(calendar.month_name) if name}
Span = tuple[datetime.date, datetime.date]


@dataclass
class Question:
    """What a question asks. ``rest`` is its text without dates; ``years`` are bare ones, which may belong to a name."""

    text: str
    rest: str = ""
    spans: list[Span] = field(default_factory=list)
    years: list[str] = field(default_factory=list)
    asks: set[str] = field(default_factory=set)
    error: str | None = None

    @property
    def kinds(self) -> tuple[str, ...]:
        """The kinds of dated events meant: by its verbs; by the bare word decision only for want of one; else all but deadlines."""
        named = [k for k in ("decide", "propose", "due") if k in self.asks]
        if not named:
            named = ["decide"] if "decision" in self.asks else ["decide", "propose"]
        return tuple(x for k in named for x in lexicon.EVENT_KINDS[k])


def span(said: str) -> Span | None:
    """The days of a date as it is said, in any case; None if it isn't in the calendar."""
    if m := re.fullmatch(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", said.strip()):
        year, month, day = (int(x) if x else None for x in m.groups())
    else:
        month = _MONTH_NO[re.search(r"[A-Za-z]{3,}", said)[0].lower()[:3]]
        numbers = [int(x) for x in re.findall(r"\d+", said)]
        year, day = numbers[-1], numbers[0] if len(numbers) > 1 else None
    try:
        first = datetime.date(year, month or 1, day or 1)
        return first, datetime.date(year, month or 12, day or calendar.monthrange(year, month or 12)[1])
    except ValueError:
        return None


def parse(question: str) -> Question:
    """Ranges first, then single dates, then bare years, and what the rest asks for. A date that isn't in the calendar and a range
    that ends before it starts are errors of the question."""
    q, rest = Question(question), question

    def take(m: re.Match) -> str:
        ends = [span(x) for x in m.groups()] if m.re in _RANGES else [span(m[0])] * 2
        if None in ends:
            q.error = f"'{m[0]}' is not a valid date{' range' if m.re in _RANGES else ''}."
        elif ends[0][0] > ends[1][1]:
            q.error = f"The date range '{m[0]}' ends before it starts."
        else:
            q.spans.append((ends[0][0], ends[1][1]))
        return " "

    for pattern in (*_RANGES, _ANY_DATE):
        rest = pattern.sub(take, rest)
    q.years = list(dict.fromkeys(_YEAR.findall(rest)))
    q.rest, q.spans = _YEAR.sub(" ", rest), list(dict.fromkeys(q.spans))
    q.asks = {k for k, p in lexicon.ASKS.items() if re.search(p, question, re.I)}
    return q


@dataclass
class Retrieval:
    """What the graph has for a question. decisions: rank, decision_id, decision, score, coverage, unmatched, status, first_date,
    reasons. steps: those of the decisions, with rank. evidence: place, document_id, filename, page, chunk_id, evidence, mode, rank,
    score. entities: place, id, name, type, score. The tables are None where there is a reason not to answer."""

    question: str
    sufficient: bool = False
    reason: str | None = None
    terms: list[str] = field(default_factory=list)
    matched_dates: list[str] = field(default_factory=list)
    coverage: float = 0.0
    decisions: DataFrame | None = None
    steps: DataFrame | None = None
    evidence: DataFrame | None = None
    entities: DataFrame | None = None


def check_limit(value, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be 1 or more, not {value!r}")
    return value


@dataclass
class Prepared:
    """What questions read, worked out once for a graph. nodes: its own columns, and ``words``, the stems of each name and alias.
    vocabulary: term, df (names that have it), named (in the name of a decision or event). The rest: see ``profiles``,
    ``trails.steps``, ``decisions.events`` and ``decisions.links``."""

    nodes: DataFrame
    facts: DataFrame
    vocabulary: DataFrame
    profiles: DataFrame
    steps: DataFrame
    events: DataFrame
    links: DataFrame


def prepare(nodes: DataFrame, facts: DataFrame, path: str | None = None) -> Prepared:
    """The tables for ``retrieve``: written below ``path`` and read from there, or kept by Spark while they are used."""

    def kept(name: str, df: DataFrame) -> DataFrame:
        if path is None:
            return df.persist()
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    words = F.transform(F.concat(F.array("name"), "aliases"), lambda n: text.content_tokens(text.normalize_name(n, F.col("type"))))
    nodes, facts = kept("nodes", nodes.withColumn("words", words)), kept("facts", facts)
    steps = kept("steps", trails.steps(nodes, facts))
    return Prepared(nodes, facts, kept("vocabulary", vocabulary(nodes, facts)), kept("profiles", profiles(nodes, facts)), steps, kept("events", decisions.events(nodes, facts, steps)), kept("links", decisions.links(nodes, facts)))


def _words(spark, rest: str) -> tuple[list[str], list[str], str]:
    """A question's stems, those of words that say what is asked, and its normal form, by the expressions that the graph's texts go
    through."""
    stems = lambda t: F.array_distinct(text.content_tokens(F.lit(t)))
    row = spark.range(1).select(stems(rest).alias("w"), stems(" ".join(lexicon.GENERIC + lexicon.ROLES)).alias("g"), text.normalize_text(F.lit(rest)).alias("n")).first()
    return list(row["w"]), list(row["g"]), row["n"]


def in_spans(iso: Column, spans: list[Span]) -> Column:
    return reduce(lambda a, b: a | b, [dates.within(iso, F.lit(a), F.lit(z)) for a, z in spans], F.lit(False))


def mentions(nodes: DataFrame, words: list[str]) -> DataFrame:
    """id, name, type, toks of the bodies, people and events of which a name or alias consists of the given stems only. nodes: as
    ``prepare`` keeps them."""
    asked = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    whole = F.exists("words", lambda t: (F.size(t) > 0) & (F.size(F.array_except(t, asked)) == 0))
    return nodes.where(F.col("type").isin(*lexicon.MENTIONED) & ~F.col("source_document") & whole).select("id", "name", "type", F.get("words", F.lit(0)).alias("toks"))


def vocabulary(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """term, df, named: every stem that names, descriptions and sentences have; dates' own names aside."""
    real = nodes.where("not source_document and type <> 'DATE'")
    names = real.select("type", F.explode(graph.name_tokens(real)).alias("term")).select("term", F.lit(1).alias("df"), F.col("type").isin("DECISION", "EVENT").alias("named"))
    sentences = lambda df: df.select(F.explode("provenance.evidence").alias("said"))
    said = real.select(F.col("description").alias("said")).unionByName(sentences(real)).unionByName(sentences(facts))
    said = said.select(F.explode(F.array_distinct(text.content_tokens(F.coalesce("said", F.lit(""))))).alias("term")).select("term", F.lit(0).alias("df"), F.lit(False).alias("named"))
    return names.unionByName(said).groupBy("term").agg(F.sum("df").alias("df"), F.bool_or("named").alias("named"))


def _known(ready: Prepared, asked: list[str]) -> dict[str, tuple[int, bool, bool]]:
    """Of each term how many names have it, whether it occurs, at least as a beginning, and whether it is in a name of a decision."""
    if not asked:
        return {}
    same = lambda t: F.col("term") == t
    begun = lambda t: same(t) | F.col("term").startswith(t) if len(t) >= 3 else same(t)
    row = ready.vocabulary.agg(*[c for i, t in enumerate(asked) for c in (F.sum(F.when(same(t), F.col("df")).otherwise(0)).alias(f"d{i}"), F.bool_or(begun(t)).alias(f"k{i}"), F.bool_or(same(t) & F.col("named")).alias(f"n{i}"))]).first()
    return {t: (row[f"d{i}"] or 0, bool(row[f"k{i}"]), bool(row[f"n{i}"])) for i, t in enumerate(asked)}


def profiles(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """decision_id, part, toks: what a question may find a decision by, a row for each text. part: 'name', 'support' (reasons and
    actions), 'context' (actors, meetings, assignees) or 'evidence' (its own sentences)."""
    own = nodes.where("type = 'DECISION' and not source_document")
    targets = nodes.where("not source_document").select(F.col("id").alias("target_id"), graph.name_tokens(nodes).alias("toks"))
    said = facts.select(F.col("source_id").alias("decision_id"), "target_id", "relation", "provenance").join(own.select(F.col("id").alias("decision_id")), "decision_id", "left_semi").join(targets, "target_id")
    part = F.when(F.col("relation").isin("JUSTIFIED_BY", "LED_TO"), "support").when(F.col("relation").isin("DECIDED_AT", *lexicon.OUTCOMES), "context")
    led = said.where("relation = 'LED_TO'").select("decision_id", F.col("target_id").alias("action_id"))
    assigned = facts.where("relation = 'ASSIGNED_TO'").select(F.col("source_id").alias("action_id"), "target_id").join(targets, "target_id")
    spoken = own.select(F.col("id").alias("decision_id"), "provenance").unionByName(said.select("decision_id", "provenance")).select("decision_id", F.explode("provenance.evidence").alias("e")).where("e <> ''")
    parts = [
        own.select(F.col("id").alias("decision_id"), F.lit("name").alias("part"), graph.name_tokens(own).alias("toks")),
        said.select("decision_id", part.alias("part"), "toks").where("part is not null"),
        led.join(assigned, "action_id").select("decision_id", F.lit("context").alias("part"), "toks"),
        spoken.select("decision_id", F.lit("evidence").alias("part"), text.content_tokens(F.col("e")).alias("toks")),
    ]
    return reduce(DataFrame.unionByName, parts)


def evaluated(names: DataFrame, rows: DataFrame, weights: dict[str, float], phrase: str) -> DataFrame:
    """decision_id, decision, direct, support, coverage, score, unmatched: which share of the terms' weight each decision has in its
    name, in its name, reasons and actions, and anywhere. A name of six letters or more that is in the question counts 2 more. names:
    ``decisions.ids``; rows: ``profiles``."""
    zero = F.lit(0.0)
    if not weights:
        return names.select("decision_id", "decision", zero.alias("direct"), zero.alias("support"), F.lit(1.0).alias("coverage"), zero.alias("score"), F.array().cast("array<string>").alias("unmatched"))
    places = {"d": ("name",), "s": ("name", "support"), "c": ("name", "support", "context", "evidence")}
    hits = [F.bool_or(F.col("part").isin(*parts) & text.term_in(F.lit(t), F.col("toks"))).alias(f"{p}{i}") for i, t in enumerate(weights) for p, parts in places.items()]
    found = rows.groupBy("decision_id").agg(*hits).join(names, "decision_id")
    total = sum(weights.values())
    share = lambda p: reduce(lambda a, b: a + b, [F.when(F.col(f"{p}{i}"), w).otherwise(0.0) for i, w in enumerate(weights.values())], zero) / total
    unmatched = F.array_compact(F.array(*[F.when(~F.col(f"c{i}"), F.lit(t)) for i, t in enumerate(weights)]))
    key = text.normalize_text(F.col("decision"))
    bonus = F.when((F.char_length(key) >= 6) & F.contains(F.lit(phrase), key), 2.0).otherwise(0.0)
    out = found.select("decision_id", "decision", share("d").alias("direct"), share("s").alias("support"), share("c").alias("coverage"), unmatched.alias("unmatched"), bonus.alias("bonus"))
    out = out.where((F.col("direct") >= lexicon.DIRECT) | (F.col("support") >= lexicon.SUPPORT))
    return out.select("decision_id", "decision", "direct", "support", "coverage", (3 * F.col("direct") + 1.5 * F.col("support") + F.col("coverage") + F.col("bonus")).alias("score"), "unmatched")


def _said(a: datetime.date, z: datetime.date) -> str:
    return str(a) if a == z else f"{a}..{z}"


def retrieve(nodes: DataFrame, facts: DataFrame, question: str, top_k: int = 8, max_decisions: int = 3, min_coverage: float = 0.6, prepared: Prepared | None = None) -> Retrieval:
    """The decisions, sentences and entities that answer a question, or the reason why there is no answer.

    Topic words are found in decisions first. Then come the filters: entities that the question names, dates, and the facts that it
    asks for. A filter that only worse matches of the topic pass answers nothing: the question isn't borne out by a lookalike.
    """
    if not isinstance(question, str):
        raise TypeError("a question must be text")
    check_limit(top_k, "top_k")
    check_limit(max_decisions, "max_decisions")
    if isinstance(min_coverage, bool) or not isinstance(min_coverage, (int, float)) or not 0 <= min_coverage <= 1:
        raise ValueError(f"min_coverage must be between 0 and 1, not {min_coverage!r}")
    out, spark = Retrieval(question), nodes.sparkSession

    def fail(reason: str) -> Retrieval:
        out.reason = reason
        return out

    if nodes.isEmpty():
        return fail("The knowledge graph is empty.")
    q = parse(question)
    words, generic, phrase = _words(spark, q.rest)
    if not phrase and not q.spans and not q.years:
        return fail("The question contains no searchable words." if question.strip() else "The question is empty.")
    if q.error:
        return fail(q.error)
    ready = prepared or prepare(nodes, facts)
    topic = [w for w in words if w not in generic]
    known = _known(ready, list(dict.fromkeys([*topic, *q.years])))
    named_years = [y for y in q.years if known[y][2]]
    topic += [y for y in named_years if y not in topic]
    spans = list(dict.fromkeys([*q.spans, *(span(y) for y in q.years if y not in named_years)]))

    named = mentions(ready.nodes, words).persist()
    names = named.agg(F.array_sort(F.collect_set(F.struct("id", "name"))).alias("n"), F.array_distinct(F.flatten(F.collect_set("toks"))).alias("t")).first()  # names of the question's own words
    terms = out.terms = [t for t in topic if t not in set(names["t"])]
    if foreign := [t for t in terms if not known[t][1]]:
        return fail(f"Question terms not found in the knowledge graph: {', '.join(foreign)}.")
    if not terms and not names["n"] and not spans and "listing" not in q.asks:
        return fail("The question does not name a topic, an entity or a date to search for.")
    n = ready.nodes.where("not source_document").count() if terms else 0
    weights = {t: 1.0 + log((n + 1) / (known[t][0] + 1)) for t in terms}
    matches = evaluated(decisions.ids(ready.nodes), ready.profiles, weights, phrase).persist()
    if terms and matches.isEmpty():
        return fail(f"No decision matches the topic terms: {', '.join(terms)}.")

    # The filters, each as the decisions that pass it.
    some = matches.select("decision_id")
    own = ready.steps.join(some, "decision_id", "left_semi") if terms else ready.steps
    dated = ready.events.join(some, "decision_id", "left_semi") if terms else ready.events
    shown = own.where(F.exists("provenance", lambda p: p["evidence"] != ""))
    having = lambda *kinds: shown.where(F.col("kind").isin(*kinds)).select("decision_id").distinct()
    outcomes = lexicon.EVENT_KINDS["decide"][:3]
    tests: list[tuple[Callable[[], DataFrame], str]] = []
    if names["n"]:
        linked = lambda: ready.links.join(named.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("decision_id").distinct()
        tests.append((linked, f"No decision matching the question is linked to {', '.join(x['name'] for x in names['n'])}."))
    dates_at = len(tests)
    if spans:
        inside = lambda: dated.where(F.col("kind").isin(*q.kinds) & in_spans(F.col("date_iso"), spans)).select("decision_id").distinct()
        tests.append((inside, f"No decision with a matching dated event was found for {', '.join(_said(*s) for s in spans)}."))
    if "why" in q.asks:
        tests.append((lambda: having("REASON"), "The matching decision has no stated reason in the graph."))
    if not spans:
        if "propose" in q.asks:
            tests.append((lambda: having("PROPOSED"), "No proposal is recorded for the matching decision."))
        if "decide" in q.asks:
            tests.append((lambda: having(*outcomes), "No approval, rejection or deferral is recorded for the matching decision."))
        if "due" in q.asks:
            tests.append((lambda: dated.where("kind = 'DUE'").select("decision_id").distinct(), "No action deadline is recorded for the matching decision."))
        if not terms and not names["n"] and q.asks.intersection(outcomes):
            tests.append((lambda: having(*q.asks.intersection(outcomes)), "No decision with that outcome is recorded."))
    flags = [f"passes{i}" for i in range(len(tests))]
    flagged = matches
    for f, (make, _) in zip(flags, tests, strict=True):
        flagged = flagged.join(make().withColumn(f, F.lit(True)), "decision_id", "left").withColumn(f, F.coalesce(f, F.lit(False)))
    table = flagged.groupBy(*flags).agg(F.max("direct").alias("direct")).collect() if flags else []  # a row for each combination
    fallback = None
    for i, (f, (_, reason)) in enumerate(zip(flags, tests, strict=True)):
        kept = [r for r in table if r[f]]
        if not kept or terms and max(r["direct"] for r in kept) < max(r["direct"] for r in table) - 1e-9:
            if spans and i == dates_at and not q.asks.intersection(("decide", "propose", "due", "decision")) and not terms and not names["n"]:
                held = ready.nodes.where(F.col("type").isin("MEETING", "EVENT") & ~F.col("source_document")).where(in_spans(F.col("date_iso"), spans))
                if not held.isEmpty():
                    fallback = held
                    break
            return fail(reason)
        table = kept
    passed = reduce(lambda a, b: a & b, [F.col(f) for f in flags], F.lit(fallback is None))
    return _filled(out, ready, q, spans, weights, flagged.where(passed).drop(*flags), own, named, fallback, top_k, max_decisions, min_coverage)


def _filled(out: Retrieval, ready: Prepared, q: Question, spans: list[Span], weights: dict[str, float], kept: DataFrame, own: DataFrame, named: DataFrame, fallback: DataFrame | None, top_k: int, max_decisions: int, min_coverage: float) -> Retrieval:
    """Ranks and cuts the decisions that are left, and adds their sentences and entities."""
    nodes, facts, spark = ready.nodes, ready.facts, ready.nodes.sparkSession
    firsts = own.groupBy("decision_id").agg(F.min("date_iso").alias("first_date"))
    best = kept.join(firsts, "decision_id", "left").orderBy(F.desc("score"), F.asc_nulls_last("first_date"), "decision", "decision_id").limit(max_decisions).collect()
    chosen = [(r["decision_id"], float(r["score"]), float(r["coverage"]), list(r["unmatched"])) for r in best if not weights or r["score"] >= lexicon.KEEP * best[0]["score"]]
    if "history" in q.asks and chosen:  # explicit links only
        first = spark.createDataFrame([(c[0], i) for i, c in enumerate(chosen)], "decision_id string, at int")
        others = decisions.related(nodes, facts, first.select("decision_id")).join(first, "decision_id").groupBy("other_id").agg(F.min("at").alias("at"))
        others = others.join(first, others["other_id"] == first["decision_id"], "left_anti").orderBy("at", "other_id").limit(max_decisions).collect()
        chosen += [(r["other_id"], 0.5, 0.0, []) for r in others][: max_decisions - len(chosen)]
    picked = spark.createDataFrame([(i, *c) for i, c in enumerate(chosen)], "rank int, decision_id string, score double, coverage double, unmatched array<string>")
    steps = ready.steps.join(F.broadcast(picked.select("decision_id", "rank")), "decision_id").persist()
    status = trails.trails(nodes, facts, steps.drop("rank"))
    out.steps, out.decisions = steps.orderBy("rank", "step_no"), picked.join(status, "decision_id").orderBy("rank")
    out.evidence = _evidence(nodes, facts, picked, steps, spans, weights, q, fallback, len(chosen)).persist()

    days = nodes.where("type = 'DATE' and not source_document").where(in_spans(F.col("date_iso"), spans))
    out.matched_dates = sorted(days.agg(F.collect_set("date_iso")).first()[0])  # no more than the spans have days
    scored = picked.select(F.col("decision_id").alias("id"), F.round(F.col("score") + 1.0 / (1 + F.col("rank")), 3).alias("score"))
    near = ready.links.join(F.broadcast(picked), "decision_id", "left_semi").select(F.col("entity_id").alias("id"))
    scored = scored.unionByName(named.join(near, "id", "left_semi").select("id", F.lit(2.0).alias("score")))
    if fallback is not None:
        scored = scored.unionByName(fallback.select("id", F.lit(1.0).alias("score")))
    scored = scored.groupBy("id").agg(F.max("score").alias("score")).join(nodes.select("id", "name", "type"), "id")
    slots = min(len(out.matched_dates), max(1, top_k // 4)) if out.matched_dates else 0
    topics = scored.orderBy(F.desc("score"), "name", "id").limit(max(top_k - slots, 0)).collect()
    rows = [(r["id"], r["name"], r["type"], float(r["score"])) for r in topics]
    rows += [(r["id"], r["name"], r["type"], 1.0) for r in days.orderBy("id").limit(top_k - len(rows)).collect()]
    out.entities = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "place int, id string, name string, type string, score double")

    top = chosen[0] if chosen else None
    coverage, missing = (top[2], top[3]) if top else (1.0 if fallback is not None else 0.0, [])
    shown = not out.evidence.isEmpty()
    out.coverage, out.sufficient = round(coverage, 3), shown and bool(top or fallback is not None) and coverage >= min_coverage
    if not shown:
        out.reason = "The matching decision has no source evidence in the graph."
    elif coverage < min_coverage:
        out.reason = f"Only {coverage:.0%} of the question's key terms were found in the best matching decision" + (f" (missing: {', '.join(missing)})." if missing else ".")
    elif missing:
        out.reason = f"Some question terms were not found in the evidence: {', '.join(missing)}."
    return out


def _evidence(nodes: DataFrame, facts: DataFrame, picked: DataFrame, steps: DataFrame, spans: list[Span], weights: dict[str, float], q: Question, fallback: DataFrame | None, most: int) -> DataFrame:
    """The sentences of the chosen decisions by relevance, at most as many as are shown, but the best of each decision always."""
    if fallback is not None:
        held = facts.where("relation = 'HELD_ON'").join(fallback.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        said = fallback.select("provenance").unionByName(held.select("provenance")).select(F.explode("provenance").alias("p"), F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
        order = [F.coalesce("p.document_id", F.lit("None")), F.coalesce("p.page", F.lit(0)), F.coalesce("p.chunk_id", F.lit("")), F.col("p.evidence")]
    else:
        base, kind = 1.0 / (1 + F.col("rank")), F.col("kind")
        bonus = F.when(kind.isin("PROPOSED", "APPROVED", "REJECTED", "DEFERRED"), 0.4).when((kind == "REASON") & F.lit("why" in q.asks), 0.6).when((kind == "ACTION") & F.lit("due" in q.asks), 0.6).otherwise(0.0)
        bonus = bonus + F.when(F.coalesce(in_spans(F.col("date_iso"), spans), F.lit(False)), 0.8).otherwise(0.0)
        own = nodes.select(F.col("id").alias("decision_id"), "provenance").join(F.broadcast(picked), "decision_id")
        said = own.select(F.explode("provenance").alias("p"), "rank", base.alias("score")).unionByName(steps.select(F.explode("provenance").alias("p"), "rank", (base + bonus).alias("score")))
        toks = text.content_tokens(F.col("p.evidence"))
        overlap = lambda t: reduce(lambda a, b: a + b, [F.when(text.term_in(F.lit(x), t), w).otherwise(0.0) for x, w in weights.items()]) / sum(weights.values())
        if weights:
            said = said.withColumn("score", F.col("score") + 0.8 * F.get(F.transform(F.array(toks), overlap), F.lit(0)))
        order = [F.desc("score"), F.col("rank"), F.coalesce("p.document_id", F.lit("None")), F.coalesce("p.page", F.lit(0)), F.coalesce("p.chunk_id", F.lit("")), F.col("p.evidence")]
    key = ["p.document_id", "p.page", "p.chunk_id", "p.evidence", "p.mode"]
    said = said.where("p.evidence <> ''").groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)]).agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), F.col("p.filename").alias("filename"))).alias("m"))
    said = said.select(F.struct(F.col("k0").alias("document_id"), F.col("m.filename"), F.col("k1").alias("page"), F.col("k2").alias("chunk_id"), F.col("k3").alias("evidence"), F.col("k4").alias("mode")).alias("p"), (-F.col("m.r")).alias("rank"), F.col("m.score").alias("score"))
    least = F.struct((-F.col("score")).alias("s"), F.coalesce("p.document_id", F.lit("None")).alias("d"), F.coalesce("p.page", F.lit(0)).alias("n"), F.coalesce("p.chunk_id", F.lit("")).alias("c"), F.col("p.evidence").alias("e"), F.coalesce("p.mode", F.lit("")).alias("m"))
    said = said.withColumn("key", least)
    firsts = said.groupBy("rank").agg(F.min("key").alias("first"))
    said = said.join(F.broadcast(firsts), "rank").withColumn("first", F.col("key") == F.col("first"))  # a row for each chosen decision
    few = said.orderBy(F.desc("first"), *order).limit(max(lexicon.SENTENCES, most))
    placed = few.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*order)))  # of the few sentences shown
    return placed.select("place", "p.*", "rank", "score").orderBy("place")


def answer(nodes: DataFrame, facts: DataFrame, question: str, max_decisions: int = 3, coverage: float = 0.6, prepared: Prepared | None = None) -> DataFrame:
    """decision_id, decision, score, coverage, sufficient, step_no, date_iso, kind, description, evidence: the steps of the decisions
    that answer a question; no rows where nothing does."""
    found = retrieve(nodes, facts, question, max_decisions=max_decisions, min_coverage=coverage, prepared=prepared)
    if found.steps is None:
        empty = "decision_id string, decision string, score double, coverage double, sufficient boolean, step_no int, date_iso string, kind string, description string, evidence array<string>"
        return nodes.sparkSession.createDataFrame([], empty)
    scores = found.decisions.select("decision_id", "score", "coverage")
    own = found.steps.join(F.broadcast(scores), "decision_id")
    return own.select("decision_id", "decision", "score", "coverage", F.lit(found.sufficient).alias("sufficient"), "step_no", "date_iso", "kind", "description", F.array_distinct(F.transform("provenance", lambda p: p["evidence"])).alias("evidence")).orderBy(F.desc("coverage"), "decision_id", "step_no")
