"""What a language model is told, if one is used."""

from __future__ import annotations

from ..functions.lexicon import ENTITY_TYPES, RELATION_RULES


def relations() -> str:
    """A line for each relation with the types at its ends."""
    ends = lambda types: "/".join(sorted(types.split())) or "ANY"
    return "\n".join(f"- {name}: {ends(source)} -> {ends(target)}" for name, (source, target) in RELATION_RULES.items())


EXTRACTION_RULES = f"""From the text of an official document, list what it states as a single JSON object:
{{"entities": [{{"name", "type", "date", "description", "evidence"}}], "relationships": [{{"source", "relation", "target", "date", "evidence"}}]}}

Types: {", ".join(ENTITY_TYPES)}
Relations, from source to target:
{relations()}

Take names and dates as they are written. "evidence" is a sentence of the text, word for word. A "date" that isn't written is null. Both ends
of a relationship are among the entities. Add nothing that the text doesn't state; two empty lists are a good answer."""

ANSWER_RULES = """Answer from the decision trail and the numbered sentences alone, as a single JSON object:
{"answer": text, "sufficient_evidence": true or false, "used_sources": [labels]}
Put the label of a sentence, such as [S1], behind each claim. Where the sentences don't answer, say what is missing and set
"sufficient_evidence" to false. At most five sentences."""


def extraction_prompt(chunk: dict) -> str:
    where = "\n".join(f"{k}: {chunk.get(k)}" for k in ("document_id", "filename", "page", "chunk_id"))
    return f"{where}\n\nTEXT\n{chunk.get('text', '')}\n\nOnly the JSON object."


def answer_prompt(question: str, trail: str, evidence: str) -> str:
    return f"QUESTION\n{question}\n\nTRAIL\n{trail or '(none)'}\n\nSENTENCES\n{evidence or '(none)'}\n\nOnly the JSON object."
