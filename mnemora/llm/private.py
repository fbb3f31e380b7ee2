"""Personal data by candidate gradient boosting, in SQL functions only.

Generators propose overlapping spans with high recall: the four base kinds, whose valid matches always stay, and looser forms
(phones without a plus, spelled-out addresses; cards with other separators or inside a longer run of digit groups; IPs with
bracketed or spelled-out dots or inside a longer dotted run, IPv6). Boosted trees, one set for emails and phones and one for IPs
and cards, judge the looser ones by features of their form and context; those over the calibrated threshold are added, of
overlapping ones the best. Runs are cut between groups of digits only: a card glued to further digits isn't proposed. Trees are trained here, in numpy, on generated
examples, and run as one SQL expression. Everything happens within a row: no shuffle.

Positions come from the lengths of what lies between the matches. Defined cases: null text is empty; very long texts are
searched whole; spans are code points, end exclusive, ordered by start and then kind as listed in ``KINDS``; null and repeated ids
have their rows each; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, with guards that keep a failing start from being tried again further on.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)\b[a-z0-9._%+-]{1,64} ?[\[(]? ?\bat\b ?[\])]? ?[a-z0-9-]{1,63}(?: ?[\[(]? ?\bdot\b ?[\])]? ?[a-z0-9-]{2,63}){1,3}\b",
    "phone": r"(?<![0-9.+-])\(?[0-9]{2,4}\)?(?:[\x20.-]\(?[0-9]{2,4}\)?){2,4}(?![0-9.-])",
}
# Runs of digit groups, of which every part of so many groups is a candidate.
RUNS = {
    "ip": (r"(?<![0-9])[0-9]{1,3}+(?![0-9])(?:(?:\x20?[\[({]\x20?(?:\.|(?i:dot))\x20?[\])}]\x20?|\.|\x20(?i:dot)\x20)[0-9]{1,3}+(?![0-9])){3,}+", 4, 4),
    "card": (r"(?<![0-9])(?<![0-9][\x20._/\u00a0\u2010-\u2013-])[0-9](?:[\x20._/\u00a0\u2010-\u2013-]{0,3}+[0-9]){11,}+", 1, 19),
}
IPV6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+)?)(?![0-9A-Za-z:]|\.[0-9])"
_ISSUER = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|35[0-9]{14}|6[0-9]{11,18})$"
_LAYOUT = r"^(?:[0-9]{12,19}|[0-9]{4}(?:[^0-9]+[0-9]{4}){2,3}(?:[^0-9]+[0-9]{1,3})?|[0-9]{4}[^0-9]+[0-9]{6}[^0-9]+[0-9]{4,5})$"
_PAYS = r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay|paid|payment|charge)\b"
_NETS = r"(?i)\b(?:ip|ipv6|host|server|address|addr|login|client|from|ping|dns|gateway)\b"
_AROUND = 24
_CALLS = r"(?i)\b(?:tel|phone|call|fax|mobile|cell|whatsapp|contact|sms)\b"
_COUNTS = r"(?i)\b(?:id|order|invoice|version|isbn|page|no|token|total|date|ref)\b"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m, start, end>> of all non-overlapping matches, left to right. Positions add up what lies between the matches, in
    blocks of about as many matches as there are blocks, as adding to an array copies it."""
    span = "struct<m:string,start:int,end:int>"
    empty = F.array().cast(f"array<{span}>")

    def step(acc, x):
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["m"])
        return F.struct(F.array_append(acc["out"], F.struct(x["m"].alias("m"), start.alias("start"), end.alias("end"))).alias("out"), end.alias("at"))

    def walked(pairs: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(pairs) / side).cast("int") - 1), lambda i: F.slice(pairs, i * side + 1, side))
        blocks = F.transform(parts, lambda own: F.aggregate(own, F.struct(empty.alias("out"), F.lit(0).alias("at")), step))
        return F.get(F.transform(F.array(blocks), placed), F.lit(0))

    def placed(blocks: Column) -> Column:
        sums = F.aggregate(blocks, F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at")), lambda acc, x: F.struct(F.array_append(acc["out"], acc["at"]).alias("out"), (acc["at"] + x["at"]).alias("at")), lambda acc: acc["out"])
        moved = lambda x, by: F.transform(x["out"], lambda m: F.struct(m["m"].alias("m"), (m["start"] + by).alias("start"), (m["end"] + by).alias("end")))
        return F.flatten(F.zip_with(blocks, sums, moved))

    def paired(found: Column) -> Column:
        pairs = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
        return F.filter(pairs, lambda x: x["m"].isNotNull())  # what follows the last match has none

    # Arrays of one bind what is used several times; a text without matches, as most are, is searched once and split never.
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, once(paired(found), walked)).otherwise(empty))


def candidates(text: Column, kind: str) -> Column:
    """array<struct<m, start, end>> of the looser forms of a kind; those of IPs and cards overlap."""
    if kind in LOOSE:
        return matches(text, LOOSE[kind])
    pattern, least, most = RUNS[kind]

    def parts(run: Column) -> Column:
        def from_group(groups: Column, i: Column) -> Column:
            first, last = i + (least - 1), F.least(i + (most - 1), F.size(groups) - 1)

            def upto(j: Column) -> Column:
                start, end = F.get(groups, i)["start"], F.get(groups, j)["end"]
                return F.struct(F.substring(run["m"], start + 1, end - start).alias("m"), (run["start"] + start).alias("start"), (run["start"] + end).alias("end"))

            return F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), upto)

        each = lambda groups: F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: from_group(groups, i)))
        return F.flatten(F.transform(F.array(matches(run["m"], "[0-9]+")), each))  # an array of one: the groups are found once

    found = F.flatten(F.transform(matches(text, pattern), parts))
    if kind == "card":
        return F.filter(found, lambda x: F.char_length(_digits(x["m"])).between(12, 19) & luhn(_digits(x["m"])))
    found = F.filter(found, lambda x: F.forall(F.regexp_extract_all(x["m"], F.lit("[0-9]+"), F.lit(0)), lambda p: p.cast("int") <= 255))
    groups = lambda x: F.size(F.filter(F.split(x["m"], ":"), lambda p: p != ""))
    return F.concat(found, F.filter(matches(text, IPV6), lambda x: ~x["m"].contains("::") | groups(x).between(2, 7)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (c.cast("int") * (1 + i % 2)).cast("int"))
    return F.aggregate(F.filter(each, lambda v: v.isNotNull()), F.lit(0), lambda a, v: (a + v - F.when(v > 9, 9).otherwise(0)).cast("int")) % 10 == 0


def base_spans(text: Column, kind: str) -> Column:
    """The base matches of a kind that are valid."""
    found = matches(text, BASE[kind])
    if kind == "ip":
        return F.filter(found, lambda x: F.forall(F.split(x["m"], r"\."), lambda p: (F.char_length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.right(F.concat(F.lit("00"), p), F.lit(3)).cast("int") <= 255)))
    if kind == "card":
        return F.filter(found, lambda x: luhn(_digits(x["m"])))
    if kind == "phone":
        return F.filter(found, lambda x: F.char_length(_digits(x["m"])).between(9, 15))
    return found


#: What the trees see of a candidate.
FEATURES = ("digits", "length", "gaps", "brackets", "dots", "calls", "counts", "groups", "longest", "is_email", "known_end")


NUMBER_FEATURES = ("digits", "length", "gaps", "brackets", "dots", "colons", "pays", "nets", "counts", "groups", "longest", "is_card", "issuer", "layout")


def features(m: Column, around: Column, kind: str) -> dict[str, Column]:
    if kind in RUNS:
        parts = F.split(m, "[^0-9A-Fa-f]+")
        return {
            "digits": F.char_length(_digits(m)), "length": F.char_length(m), "gaps": F.char_length(F.regexp_replace(m, r"[^\x20-]", "")), "brackets": F.char_length(F.regexp_replace(m, r"[^()\[\]{}]", "")),
            "dots": F.char_length(F.regexp_replace(m, "[^.]", "")), "colons": F.char_length(F.regexp_replace(m, "[^:]", "")), "pays": around.rlike(_PAYS).cast("int"), "nets": around.rlike(_NETS).cast("int"),
            "counts": around.rlike(_COUNTS).cast("int"), "groups": F.size(parts), "longest": F.array_max(F.transform(parts, lambda x: F.char_length(x))), "is_card": F.lit(int(kind == "card")),
            "issuer": _digits(m).rlike(_ISSUER).cast("int"), "layout": m.rlike(_LAYOUT).cast("int"),
        }
    return {
        "digits": F.char_length(_digits(m)), "length": F.char_length(m), "gaps": F.char_length(F.regexp_replace(m, r"[^\x20-]", "")), "brackets": F.char_length(F.regexp_replace(m, r"[^()\[\]]", "")),
        "dots": F.char_length(F.regexp_replace(m, "[^.]", "")), "calls": around.rlike(_CALLS).cast("int"), "counts": around.rlike(_COUNTS).cast("int"), "groups": F.size(F.split(m, "[^0-9]+")),
        "longest": F.array_max(F.transform(F.split(m, "[^0-9]+"), lambda x: F.char_length(x))), "is_email": F.lit(int(kind == "email")), "known_end": m.rlike(r"(?i)\b(?:com|org|net|edu|gov|io|de|fr|es|uk)$").cast("int"),
    }


def _example(r: np.random.Generator) -> tuple[list[int], int]:
    """Features and truth of one generated candidate: phones and addresses with and without their usual company, and numbers that only look like them."""
    import re

    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: "".join(r.choice(list("abcdefghilmnoprstu"), r.integers(3, 9)))
    pick = lambda *x: x[r.integers(len(x))]
    sep, email, truth = pick(" ", "-", "."), 0, 1
    kind = r.integers(8)
    ahead = pick("call", "phone", "tel", "fax", "mobile", word(), word(), "contact")
    if kind == 0:
        m = f"({d(3)}) {d(3)}{pick('-', ' ')}{d(4)}"
    elif kind == 1:
        m = f"{d(3)}{sep}{d(3)}{sep}{d(4)}"
    elif kind == 2:
        m = sep.join(["0" + d(2), d(3), d(2), d(2)])
        ahead = pick("call", "tel", "phone", "fax")
    elif kind == 3:
        email, m = 1, f"{word()}{pick(' at ', ' [at] ', '(at)', ' (at) ')}{word()}{pick(' dot ', ' [dot] ', '(dot)')}{pick('com', 'org', 'net', 'de')}"
    elif kind == 4:
        email, truth, m = 1, 0, f"{word()} at {word()} dot {word()}"
    elif kind == 5:
        truth, m = 0, sep.join(d(pick(2, 3, 4)) for _ in range(pick(3, 4, 5)))
        ahead = pick("id", "order", "invoice", "page", "version", word())
    elif kind == 6:
        truth, m = 0, f"{d(4)}-{d(2)}-{d(2)}"
        ahead = pick("date", word(), word())
    else:
        truth, m = 0, f"{d(2)}.{d(2)}.{d(4)}"
    around = f"{word()} {ahead} {m} {word()}"
    parts = re.split("[^0-9]+", m)
    x = [sum(c.isdigit() for c in m), len(m), sum(c in " -" for c in m), sum(c in "()[]" for c in m), m.count("."), int(bool(re.search(_CALLS, around))), int(bool(re.search(_COUNTS, around))), len(parts), max(map(len, parts)), email, int(bool(re.search(r"(?i)\b(?:com|org|net|edu|gov|io|de|fr|es|uk)$", m)))]
    return x, truth


def _number_example(r: np.random.Generator) -> tuple[list[int], int]:
    """The same for IPs and cards: other ways to write them, parts of longer runs, and numbers and code that only look like them."""
    import re

    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: "".join(r.choice(list("abcdefghilmnoprstu"), r.integers(3, 9)))
    pick = lambda *x: x[r.integers(len(x))]
    hexes = lambda: f"{r.integers(0, 65536):x}"
    octets = lambda: [str(x) for x in r.integers(0, 256, 4)]

    def checked(body: str) -> str:
        total = sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def grouped(digits: str, sizes) -> str:
        sep, out = pick(" ", "-", ".", "/", " - ", "\u00a0"), []
        for n in sizes:
            out, digits = [*out, digits[:n]], digits[n:]
        return sep.join(out)

    card, truth, kind = 0, 1, r.integers(9)
    ahead, behind = pick("ip", "host", "server", "address", "client", word(), word()), word()
    if kind < 3:  # a card, perhaps after some other number
        card, ahead = 1, pick("card", "visa", "pay", "order", "id", "", word(), word())
        if r.random() < 0.75:
            m = grouped(checked(pick("4", "51", "52", "54", "55", "22", "27", "60", "65").ljust(2, d(1)) + d(13)), (4, 4, 4, 4))
        else:
            m = grouped(checked(pick("34", "37") + d(12)), (4, 6, 5))
        ahead += pick("", "", f" {d(pick(1, 2, 3))}")
    elif kind < 5:  # digit groups that pass by chance
        card, truth, sizes = 1, 0, []
        while sum(sizes) < 12:
            sizes.append(pick(1, 2, 3, 4, 5, 6, 7, 8))
        m = grouped(checked(d(min(19, sum(sizes)) - 1)), sizes)
        ahead = pick("order", "date", "id", "total", "", word(), word(), "card")
    elif kind == 5:
        m = pick("[.]", "(.)", "[dot]", " [.] ", " dot ", "(dot)", "{.}").join(octets())
    elif kind == 6:  # part of a longer dotted run
        m, ahead = ".".join(octets()), f"{pick('version', 'section', 'ip', 'host', word())} {r.integers(256, 999)}."
        truth = int(bool(re.search(_NETS, ahead)))
    elif kind == 7:
        m = ":".join(hexes() for _ in range(8)) if r.random() < 0.5 else f"{':'.join(hexes() for _ in range(r.integers(2, 5)))}::{hexes()}"
    else:
        truth, m = 0, f"{pick('add', 'a', 'b', 'face', 'dead', 'fade', 'c')}::{pick('add', 'be', 'c', 'ad', 'face', 'feed')}"
        ahead = pick("call", word(), word())
    around = f"{word()} {ahead} {m} {behind}"
    parts = re.split("[^0-9A-Fa-f]+", m)
    digits = re.sub("[^0-9]", "", m)
    x = [len(digits), len(m), sum(c in " -" for c in m), sum(c in "()[]{}" for c in m), m.count("."), m.count(":"), int(bool(re.search(_PAYS, around))), int(bool(re.search(_NETS, around))), int(bool(re.search(_COUNTS, around))), len(parts), max(map(len, parts)), card, int(bool(re.search(_ISSUER, digits))), int(bool(re.search(_LAYOUT, m)))]
    return x, truth


def _stump_pair(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
    """The split (feature, limit) of these rows with the largest gain."""
    best, split = 1e-6, None
    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for f in range(x.shape[1]):
        for limit in np.unique(x[rows, f])[:-1]:
            left = rows[x[rows, f] <= limit]
            right = rows[x[rows, f] > limit]
            gain = sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in (left, right)) - whole
            if gain > best:
                best, split = gain, (f, float(limit))
    return split


@lru_cache
def trained(examples: int = 1600, trees: int = 24, rate: float = 0.3, seed: int = 3, example: Callable = _example) -> tuple[tuple, float]:
    """Trees of depth 2, as ((feature, limit), left, right) with leaves as numbers, and the threshold: the least score at which
    98 % of the held-out half's candidates above it are true."""
    r = np.random.default_rng(seed)
    data = [example(r) for _ in range(examples)]
    x, y = np.array([a for a, _ in data], float), np.array([b for _, b in data], float)
    half, score, out = examples // 2, np.zeros(examples), []
    train = np.arange(half)

    def grow(rows: np.ndarray, depth: int, g: np.ndarray, h: np.ndarray):
        split = _stump_pair(x, g, h, rows) if depth and len(rows) > 20 else None
        if split is None:
            return float(rate * g[rows].sum() / (h[rows].sum() + 1))
        f, limit = split
        return split, grow(rows[x[rows, f] <= limit], depth - 1, g, h), grow(rows[x[rows, f] > limit], depth - 1, g, h)

    def value(tree, row: np.ndarray) -> float:
        while isinstance(tree, tuple):
            (f, limit), low, high = tree
            tree = low if row[f] <= limit else high
        return tree

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(train, 2, y - p, p * (1 - p))
        out.append(tree)
        score += np.array([value(tree, row) for row in x])
    held = np.arange(half, examples)
    order = held[np.argsort(-score[held])]
    right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= 0.98)
    return tuple(out), float(score[order[good[-1]]]) if len(good) else float("inf")


def _trained(kind: str) -> tuple[tuple, float]:
    return trained(example=_number_example) if kind in RUNS else trained()


def boosted(f: dict[str, Column], kind: str) -> Column:
    """The score of the kind's trees as a SQL expression."""
    names = NUMBER_FEATURES if kind in RUNS else FEATURES

    def case(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        (k, limit), low, high = tree
        return F.when(f[names[k]] <= limit, case(low)).otherwise(case(high))

    total = F.lit(0.0)
    for tree in _trained(kind)[0]:
        total = total + case(tree)
    return total


def _as_base(n: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind_no"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.lit(True).alias("base"), F.lit(None).cast("double").alias("score"))


def _scored(n: int, kind: str):
    def one(x):
        around = F.substring(F.col("text"), F.greatest(F.lit(1), x["start"] + 1 - _AROUND), x["end"] - x["start"] + 2 * _AROUND)
        return F.struct(x["start"].alias("start"), F.lit(n).alias("kind_no"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.lit(False).alias("base"), boosted(features(x["m"], around, kind), kind).alias("score"))

    return one


def _over(threshold: float):
    return lambda x: x["score"] >= threshold


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and spans: array<struct<start, kind_no, kind, end, base, score>>, all selected spans in order."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumns({f"base_{k}": base_spans(F.col("text"), k) for k in KINDS})
    rows = rows.withColumn("base", F.concat(*[F.transform(f"base_{k}", _as_base(n, k)) for n, k in enumerate(KINDS)]))
    apart = lambda x, spans: ~F.exists(spans, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    worth = lambda x: F.struct(x["score"], x["end"] - x["start"], -x["start"])
    for kinds in (RUNS, LOOSE):  # a phone that is part of a card or an IP isn't one
        some = [F.filter(F.transform(candidates(F.col("text"), k), _scored(KINDS.index(k), k)), _over(_trained(k)[1])) for k in kinds]
        rows = rows.withColumn("some", F.filter(F.concat(*some), lambda x: apart(x, F.col("base"))))
        if kinds is RUNS:
            rows = rows.withColumn("some", F.filter("some", lambda x: ~F.exists(F.col("some"), lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"]) & (worth(y) > worth(x)))))
        rows = rows.withColumn("base", F.concat("base", "some"))
    return rows.select("doc_id", "text", F.array_sort("base").alias("spans"))


def redacted(found: DataFrame) -> DataFrame:
    """doc_id and the text with each selected span replaced by its kind in brackets; overlapping spans count as one."""

    def step(acc, s):
        new = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"])), F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
        return F.struct(new.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    whole = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    return found.select("doc_id", whole.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of ``find``."""
    base = F.filter("spans", lambda s: s["base"])
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
