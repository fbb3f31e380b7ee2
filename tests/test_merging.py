"""Merging of close names against the plain pairwise rule."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from mnemora.functions import text
from mnemora.operators import merging

SCHEMA = "id string, name string, type string, aliases array<string>, date_iso string, description string, source_document boolean, provenance array<string>"
FACTS = "source_id string, target_id string, relation string, date_iso string, provenance array<string>"


def node(i, name, kind="COMMITTEE", date=None):
    return (i, name, kind, [], date, None, False, [i])


def test_pieces_have_known_lengths():
    for n in range(8, 3000):
        off = int((1 - merging.RATIO) * (n + int(n * (2 / merging.RATIO - 1))) + 1e-9)
        assert {(j + 1) * n // (off + 1) - j * n // (off + 1) for j in range(off + 1)} <= set(merging.PIECES)


def test_remap_against_all_pairs(spark):
    r = random.Random(4)
    base = ["finance review committee", "board of governors", "student welfare and housing council", "library", "academic council of green valley college", "x" * 30]
    rows = []
    for i in range(150):
        s = list(r.choice(base))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(s))
            s[at : at + r.randrange(2)] = r.choice("abcdefgh")
        rows.append(node(f"N{i:03}", "".join(s), r.choice(["COMMITTEE", "MEETING", "DATE"]), r.choice([None, None, "2024-06", "2024-06-01", "2024-07-15"])))
    want, rows = {}, [*rows, node("N900", None), node("N901", "")]
    key = text.normalize_name(F.col("name"), F.col("type"))
    keys = dict(spark.createDataFrame(rows, SCHEMA).select("id", key).collect())
    live = [x for x in rows if x[1]]
    for a in live:
        if a[0] in want or a[2] == "DATE":
            continue
        for b in live:
            if b[0] <= a[0] or b[0] in want or a[2] != b[2] or min(len(keys[a[0]]), len(keys[b[0]])) < 8 or SequenceMatcher(None, keys[a[0]], keys[b[0]]).ratio() < 0.92:
                continue
            apart = not (a[4].startswith(b[4]) or b[4].startswith(a[4])) if a[4] and b[4] else bool(a[4] or b[4]) and a[2] == "MEETING"
            if not apart:
                want[b[0]] = a[0]
    got = {x.id: x.into for x in merging.remap(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(want) > 20
    assert got == want


def test_merge_moves_facts(spark):
    n = spark.createDataFrame([node("C:a", "Finance Committee"), node("C:b", "Finance Comittee", date="2024-06"), node("C:c", "Library Board")], SCHEMA)
    f = spark.createDataFrame([("C:b", "C:c", "MEMBER_OF", None, ["q"]), ("C:a", "C:c", "MEMBER_OF", None, ["p"]), ("C:a", "C:b", "RELATED_TO", None, ["r"])], FACTS)
    nodes, facts = merging.merge_close(n, f)
    got = {x.id: x for x in nodes.collect()}
    assert sorted(got) == ["C:a", "C:c"] and got["C:a"].name == "Finance Committee"
    assert got["C:a"].aliases == ["Finance Comittee"] and got["C:a"].date_iso == "2024-06" and got["C:a"].provenance == ["C:a", "C:b"]
    assert [tuple(x) for x in facts.collect()] == [("C:a", "C:c", "MEMBER_OF", None, ["p", "q"])]
    assert merging.remap(n.limit(0)).count() == 0
