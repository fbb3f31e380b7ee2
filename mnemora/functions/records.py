"""Lenient records: JSON, null-like strings, enumerations and relation rules."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ENTITY_ALIASES, ENTITY_TYPES, RELATION_ALIASES, RELATION_RULES
from .text import squeezed


def metadata(text: Column) -> Column:
    """A JSON object as a map of strings; what can't be read is the empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def optional(text: Column) -> Column:
    """Null for the strings that mean nothing."""
    s = squeezed(text)
    return F.when(~F.lower(s).isin("", "null", "none", "n/a", "unknown"), s)


def _key(text: Column) -> Column:
    return F.translate(F.upper(F.trim(F.coalesce(text, F.lit("")))), " -", "__")


def _aliased(key: Column, aliases: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*aliases.items())]), key), key)


def entity_type(text: Column) -> Column:
    """The entity type meant; null if unknown."""
    k = _aliased(_key(text), ENTITY_ALIASES)
    return F.when(k.isin(ENTITY_TYPES), k)


def relation_type(text: Column) -> Column:
    """The relation meant; RELATED_TO if unknown."""
    k = _aliased(_key(text), RELATION_ALIASES)
    return F.when(k.isin(list(RELATION_RULES)), k).otherwise("RELATED_TO")


def direction(relation: Column, source: Column, target: Column) -> Column:
    """'ok', 'flip' (the other way round is allowed) or 'invalid'."""

    def allowed(side: int, kind: Column) -> Column:
        rule = F.try_element_at(F.create_map(*[F.lit(x) for r, t in RELATION_RULES.items() for x in (r, t[side])]), relation)
        return (rule == "") | F.array_contains(F.split(rule, " "), kind)

    return F.when(allowed(0, source) & allowed(1, target), "ok").when(allowed(0, target) & allowed(1, source), "flip").otherwise("invalid")


def loose_json(text: Column, opening: str = "{", closing: str = "}") -> Column:
    """The JSON text of a model's answer: as it is, fenced, or between the outermost brackets, also with trailing commas; null if none parses."""
    t = F.trim(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    outer = F.regexp_extract(t, rf"(?s)(\{opening}.*\{closing})", 1)
    tidy = lambda s: F.regexp_replace(s, r",\s*([}\]])", "$1")
    good = lambda s: F.when((s != "") & F.try_parse_json(s).isNotNull(), s)
    return F.coalesce(*[good(f(x)) for f in (lambda s: s, tidy) for x in (t, fenced, outer)])
