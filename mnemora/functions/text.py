"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ABBREVIATIONS, STOPWORDS

_SPACE = r"(?U)\s+"


def _empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def squeezed(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(_empty(text), _SPACE, " "))


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits, without possessive endings."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(_empty(text)), "['’]s\\b", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def stem(t: Column) -> Column:
    """Conservative suffix stripping of one lower-case token; up to three letters, or anything with a digit, stays."""
    n, cut = F.char_length(t), lambda k: F.substring(t, F.lit(1), F.char_length(t) - k)
    undoubled = lambda x: F.when((F.char_length(x) > 3) & x.rlike(r"([bgmnprt])\1$"), F.substring(x, F.lit(1), F.char_length(x) - 1)).otherwise(x)
    return (
        F.when((n <= 3) | ~t.rlike(r"^\p{L}+$"), t)
        .when(t.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("ing") & (n >= 7), undoubled(cut(3)))
        .when(t.endswith("ed") & (n >= 5) & ~t.endswith("eed"), undoubled(cut(2)))
        .when(t.endswith("es") & (n >= 5), cut(2))
        .when(t.endswith("s") & (n >= 5) & ~t.rlike("(ss|us|is)$"), cut(1))
        .when(t.endswith("e"), cut(1))
        .otherwise(t)
    )


def content_tokens(text: Column) -> Column:
    """Stems of the tokens that aren't stopwords, in order, repeats kept."""
    return F.transform(F.filter(tokenize(text), lambda t: ~t.isin(STOPWORDS)), stem)


def normalize_text(text: Column) -> Column:
    """Lower case, all else than letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(_empty(text)), r"[^\p{L}\p{N}]+", " "))


def _without_article(s: Column) -> Column:
    return F.regexp_replace(s, r"(?i)^(?:the|a|an)\s+", "")


def normalize_name(name: Column, kind: Column | None = None) -> Column:
    """The key that names are compared by: no leading article, for persons no titles."""
    s = _without_article(F.regexp_replace(squeezed(name), r"""^[ .,:;"']+|[ .,:;"']+$""", ""))
    if kind is not None:
        s = F.when(kind == "PERSON", F.regexp_replace(s, r"(?i)^(?:(?:dr|prof|professor|mr|mrs|ms|shri|smt)\.?\s+)+", "")).otherwise(s)
    return normalize_text(s)


def display_name(name: Column) -> Column:
    """For showing: no article, no closing dot unless it ends an initial."""
    s = F.regexp_replace(squeezed(name), r"""^[ ,:;"']+|[ ,:;"']+$""", "")
    s = F.when(s.rlike(r"\b[A-Z]\.$"), s).otherwise(F.regexp_replace(s, r"\.+$", ""))
    return F.when(_without_article(s) == "", s).otherwise(_without_article(s))


def entity_id(kind: Column, name: Column, date_iso: Column) -> Column:
    return F.when((kind == "DATE") & (_empty(date_iso) != ""), F.concat(F.lit("DATE:"), date_iso)).otherwise(F.concat(kind, F.lit(":"), normalize_name(name, kind)))


def text_supports(name: Column, text: Column, threshold: float = 0.6) -> Column:
    """Whether enough of the name's content words (repeats count) occur in the text."""
    own = F.filter(F.split(normalize_text(name), " "), lambda t: (t != "") & ~t.isin(STOPWORDS))
    there = F.split(normalize_text(text), " ")
    return (F.size(own) > 0) & (F.size(F.filter(own, lambda t: F.array_contains(there, t))) >= F.lit(threshold) * F.size(own))


def quoted(evidence: Column, text: Column, percent: int = 85) -> Column:
    """Whether a quote of two words or more is in the text, up to case and punctuation, or a stretch of ``percent`` of it is. Some
    stretch of that length is there only if one of the few that begin in the quote's first letters is."""

    def near(x: Column) -> Column:
        size = F.char_length(x["e"])
        least = F.floor((size * percent + 99) / 100).cast("int")
        begins = F.sequence(F.lit(1), size - least + 1)
        whole = F.contains(x["t"], x["e"])
        return (F.size(F.split(x["e"], " ")) >= 2) & (whole | F.exists(begins, lambda at: F.contains(x["t"], F.substring(x["e"], at, least))))

    return F.exists(F.array(F.struct(normalize_text(evidence).alias("e"), normalize_text(text).alias("t"))), near)


def term_in(term: Column, tokens: Column) -> Column:
    """A term is among the tokens, or from three letters on begins one."""
    return F.array_contains(tokens, term) | ((F.char_length(term) >= 3) & F.exists(tokens, lambda x: x.startswith(term)))


def clean_text(text: Column) -> Column:
    """Keeps word characters, spaces and .,!?;:()@/- ; single spaces."""
    return squeezed(F.regexp_replace(squeezed(text), r"[^\p{L}\p{N}_\s.,!?;:()@/\-]", ""))


def word_chunks(text: Column, size: int = 500) -> Column:
    """The words in runs of ``size``; an empty text has none."""
    if size <= 0:
        raise ValueError("the chunk size must be above zero")
    words = F.filter(F.split(squeezed(text), " "), lambda w: w != "")
    n = F.ceil(F.size(words) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * size + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def packed(parts: Column, limit: int, glue: str) -> Column:
    """Neighbouring parts joined greedily while the result has at most ``limit`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, p):
        fits = (acc["open"] == "") | (F.char_length(acc["open"]) + len(glue) + F.char_length(p) <= limit)
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit(glue), p))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(fits, joined).otherwise(p).alias("open"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def _pieces(paragraph: Column, limit: int) -> Column:
    """A paragraph that is too long, at sentence ends; sentences that are too long, cut hard."""
    hard = lambda s: F.transform(F.sequence(F.lit(0), F.ceil(F.char_length(s) / limit).cast("int") - 1), lambda i: F.substring(s, i * limit + 1, F.lit(limit)))
    return packed(F.flatten(F.transform(F.split(paragraph, r"(?<=[.!?])\s+"), hard)), limit, " ")


def paragraph_chunks(text: Column, limit: int = 1500) -> Column:
    """Paragraphs packed to chunks of at most ``limit`` characters, separated by a blank line."""
    paragraphs = F.filter(F.transform(F.split(_empty(text), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return packed(F.flatten(F.transform(paragraphs, lambda p: F.when(F.char_length(p) <= limit, F.array(p)).otherwise(_pieces(p, limit)))), limit, "\n\n")


def sentences(text: Column) -> Column:
    """Sentences of all paragraphs; a title's dot doesn't end one."""
    paragraphs = F.filter(F.transform(F.split(_empty(text), r"\n\s*\n"), squeezed), lambda p: p != "")
    cut = lambda p: F.split(F.regexp_replace(p, ABBREVIATIONS, "$1\x01"), r"(?<=[.!?])\s+(?=[A-Z0-9\"'])")
    whole = F.flatten(F.transform(paragraphs, cut))
    return F.filter(F.transform(whole, lambda s: F.trim(F.replace(s, F.lit("\x01"), F.lit(".")))), lambda s: s != "")


def preview(text: Column, size: int = 300, mark: str = "...") -> Column:
    t = _empty(text)
    return F.concat(F.left(t, F.lit(size)), F.when(F.char_length(t) > size, F.lit(mark)).otherwise(""))


def ascii_lower(text: Column) -> Column:
    """Folds A to Z only, as the search operators compare."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
