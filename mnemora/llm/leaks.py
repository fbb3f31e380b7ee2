"""Benchmark decontamination by pigeonhole edit matching, over words.

An item of n words may differ in e = n * ``percent`` // 100 words (inserted, deleted or replaced). Cut in e + 1 pieces, a text
with at most e errors holds one piece unchanged; an Aho-Corasick automaton finds pieces, and Myers' bit-parallel distance
verifies the words around a hit. Words are runs of letters, digits and underscores, in lower case.

The benchmark is cut in blocks of bounded size (``block_chars``); each block's automaton is built by the tasks, which read
all documents once per block. Documents are never shuffled.

Defined cases: null texts are empty; an item without words matches nothing; items with the same words all match; an item of
few words (e = 0) matches only where all its words follow each other; null and repeated ids have their rows each; an empty table
on either side gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, texts

WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def nearest(pattern: list[str], text: list[str], most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place where ``pattern`` ends in ``text``, the first of equals; None if it's over ``most``."""
    m = len(pattern)
    eq: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        eq[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, d, best = full, 0, m, None
    for j, w in enumerate(text):
        e = eq.get(w, 0)
        x = e | minus
        flat = (((x & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(flat | plus)), plus & flat
        d += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(flat | up)), up & flat
        if d <= most and (best is None or d < best[0]):
            best = d, j + 1
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.items, self.places = [], defaultdict(list)
        for item, text in items:
            w = words(text or "")
            if not w:
                continue
            e, at = len(w) * percent // 100, len(self.items)
            self.items.append((item, w, e))
            for k in range(e + 1):
                a, z = len(w) * k // (e + 1), len(w) * (k + 1) // (e + 1)
                self.places[f" {' '.join(w[a:z])} "].append((at, a))
        self.automaton = ahocorasick.Automaton()
        for p in self.places:
            self.automaton.add_word(p, p)
        if self.places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end word) of the nearest occurrence of each item that is near enough."""
        if not self.places or not (w := words(text)):
            return []
        line, best, tried = f" {' '.join(w)} ", {}, set()
        for end, p in self.automaton.iter(line):
            at = None
            for i, a in self.places[p]:
                if best.get(i, (1,))[0] == 0:
                    continue
                if at is None:
                    at = line.count(" ", 0, end - len(p) + 2) - 1  # words before the hit
                item, pattern, e = self.items[i]
                if (i, at - a) in tried:  # both ends of the window follow from it; its clamped start alone doesn't say where it ends
                    continue
                tried.add((i, at - a))
                lo = max(0, at - a - e)
                found = nearest(pattern, w[lo : at - a + len(pattern) + e], e)
                if found and (i not in best or found[0] < best[i][0]):
                    best[i] = found[0], lo + found[1]
        return [(self.items[i][0], d, end) for i, (d, end) in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 15, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1 << 23) -> DataFrame:
    """doc_id, item_id, distance, end_word: each document with each item that it holds, nearly or exactly."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.coalesce(benchmark["text"], F.lit("")).alias("text"))
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = 1 + total // block_chars
    docs = texts(docs, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = []
    for k in range(n):  # one block is all there is unless the benchmark outgrows it
        block = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, percent)
            for b in batches:
                at, found = [], []
                for i, t in enumerate(b.column("text")):
                    own = matcher.find(t.as_py())
                    at += [i] * len(own)
                    found += own
                if found:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32())], names=["doc_id", "item_id", "distance", "end_word"])

        found = docs.mapInArrow(run, f"doc_id {id_type}, item_id bigint, distance int, end_word int")
        out.append(found if n == 1 else staged(found, "leaks"))  # so that the driver holds one block at a time
        del block, run
    return reduce(DataFrame.unionByName, out)
