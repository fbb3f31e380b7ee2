"""Answers with cited sentences, from what ``question.retrieve`` finds; a model may word them, but adds nothing of its own."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prompts, question

INSUFFICIENT = "Insufficient evidence in the knowledge graph to answer this question."
RULES_NOTICE = "[RULES: a summary of facts found in the graph; no language model took part.]"
RETRIEVED_NOTICE = "[RETRIEVAL ONLY: the language model gave no usable answer; these are the facts found.]"
_KEY = ["document_id", "page", "chunk_id", "evidence", "mode"]


@dataclass
class Answer:
    question: str
    text: str
    sufficient: bool = False
    steps: DataFrame | None = None
    sources: DataFrame | None = None
    mode: str = "rules"
    model: str | None = None
    model_used: bool = False
    warnings: list[str] = field(default_factory=list)
    error: str | None = None


def _key() -> Column:
    return F.struct(*[F.col(f"p.{k}").alias(k) for k in _KEY])


def source_index(found: question.Retrieval) -> DataFrame:
    """no, label, document_id, filename, page, chunk_id, evidence, mode: every sentence once, those of the trails in their order
    first, then the ranked ones. They are the sentences of the few decisions of one answer."""
    trail = found.steps.select(F.lit(0).alias("part"), "rank", "step_no", F.posexplode("provenance").alias("at", "p"))
    ranked = found.evidence.select(F.lit(1).alias("part"), "rank", F.col("place").alias("step_no"), F.lit(0).alias("at"), F.struct("document_id", "filename", "page", "chunk_id", "evidence", "mode").alias("p"))
    seen = trail.unionByName(ranked).where("p.evidence <> ''").groupBy(_key().alias("key")).agg(F.min(F.struct("part", "rank", "step_no", "at", F.col("p.filename").alias("filename"))).alias("m"))
    out = seen.select(F.row_number().over(Window.partitionBy().orderBy("m", "key")).alias("no"), F.col("m.filename").alias("filename"), "key.*")
    return out.select("no", F.concat(F.lit("S"), "no").alias("label"), "document_id", "filename", "page", "chunk_id", "evidence", "mode")


def trail_text(found: question.Retrieval, index: DataFrame) -> DataFrame:
    """rank, decision_id, text: each trail, a line for a step with the labels of its sentences."""
    keyed = index.select(F.struct(*_KEY).alias("key"), "no")
    said = found.steps.select("rank", "step_no", F.explode("provenance").alias("p")).where("p.evidence <> ''").select("rank", "step_no", _key().alias("key")).join(keyed, "key")
    refs = said.groupBy("rank", "step_no").agg(F.array_sort(F.collect_set("no")).alias("refs"))
    shown = F.concat(F.lit(" ["), F.array_join(F.transform("refs", lambda r: F.concat(F.lit("S"), r)), ","), F.lit("]"))
    line = F.concat(F.lit("  "), "step_no", F.lit(". "), F.coalesce("date_iso", F.lit("undated")), F.lit(" | "), "kind", F.lit(" | "), "description", F.coalesce(shown, F.lit("")))
    lines = found.steps.join(refs, ["rank", "step_no"], "left").groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("step_no", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("Decision: "), "decision", F.lit(" (status: "), "status", F.lit(")"))
    whole = F.concat(F.array(head), F.coalesce(F.transform("lines", lambda x: x["line"]), F.array().cast("array<string>")))
    return found.decisions.join(lines, "rank", "left").select("rank", "decision_id", F.array_join(whole, "\n").alias("text"))


def evidence_text(index: DataFrame) -> DataFrame:
    """no, text: each source with where it is."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return index.select("no", F.concat(F.lit("["), "label", F.lit("] (doc="), shown("document_id"), F.lit(", file="), shown("filename"), F.lit(", page="), shown("page"), F.lit(", chunk="), shown("chunk_id"), F.lit(') "'), "evidence", F.lit('"')).alias("text"))


def _lines(df: DataFrame, by: str) -> str:
    return "\n".join(r["text"] for r in df.orderBy(by).collect())


def labels(used) -> list[str]:
    """The labels that a model names: one or many, in brackets or not, in any case."""
    many = [] if used is None else [used] if isinstance(used, str) else list(used)
    return [str(x).strip().strip("[]").upper() for x in many]


def insufficient(asked: str, reason: str | None, mode: str = "rules", model: str | None = None, warnings: list[str] | None = None) -> Answer:
    return Answer(asked, INSUFFICIENT + (f" ({reason})" if reason else ""), mode=mode, model=model, warnings=warnings or [])


def modes(facts: DataFrame) -> list[str]:
    """How the graph's facts were extracted."""
    return sorted(x for x in facts.select(F.explode("provenance.mode").alias("m")).agg(F.collect_set("m")).first()[0])


def answer(nodes: DataFrame, facts: DataFrame, asked: str, model=None, **limits) -> Answer:
    """The answer to a question. ``model``: an object with ``generate_json(prompt, system)`` and a ``name``; without one the facts
    themselves are the answer. What a model says counts only with an answer text, and cites only sentences that were found."""
    asked, mode, name, warnings = (asked or "").strip(), "rules" if model is None else "real", getattr(model, "name", None), []
    if not asked:
        return insufficient(asked, "empty question", mode, name)
    if nodes.isEmpty():
        return insufficient(asked, "the knowledge graph is empty", mode, name)
    if model is not None and (other := [m for m in modes(facts) if m != "real"]):
        warnings.append(f"Some facts were extracted in other mode(s) than real ({', '.join(other)}) and weren't verified by a model.")
    found = question.retrieve(nodes, facts, asked, **limits)
    if not found.sufficient:
        return insufficient(asked, found.reason, mode, name, warnings)
    index = source_index(found).persist()
    trail = _lines(trail_text(found, index), "rank")
    summary = trail or "\n".join(f"- {r['evidence']} [{r['label']}]" for r in index.orderBy("no").limit(5).collect())
    if model is None:
        return Answer(asked, f"{RULES_NOTICE}\n{summary}", True, found.steps, index, warnings=["The answer was put together by rules, not by a model."])
    plain = Answer(asked, f"{RETRIEVED_NOTICE}\n{summary}", True, found.steps, index, mode, name, warnings=warnings)
    try:
        said = model.generate_json(prompts.answer_prompt(asked, trail, _lines(evidence_text(index), "no")), system=prompts.ANSWER_RULES)
    except Exception as e:  # whatever a connector raises, the facts still answer
        plain.error = f"the model failed: {e}"
        return plain
    words = said.get("answer", "") if isinstance(said, dict) else None
    if not isinstance(words, str) or not words.strip():
        plain.error = "the model's answer is empty" if isinstance(words, str) else "the model's answer has another structure"
        return plain
    if said.get("sufficient_evidence", True) is False:
        return Answer(asked, words.strip(), False, mode=mode, model=name, model_used=True, warnings=warnings)
    cited = index.where(F.col("label").isin(labels(said.get("used_sources"))))
    if cited.isEmpty():
        cited = index
        warnings.append("The model did not cite any of the sources; all that were found are listed.")
    return Answer(asked, words.strip(), True, found.steps, cited, mode, name, True, warnings)
