"""Exact removal of long repeated byte strings, with a logarithmic family of suffix arrays.

A byte goes if a string of ``length`` bytes over it also starts elsewhere. Every string of that length has an anchor in it:
the place whose ``gram`` bytes hash least; equal strings have it at the same distance. So only anchors whose gram occurs
twice matter, and of those only the surroundings that hold all strings with that anchor. Equal surroundings are counted
before any text moves; the text of one example of each goes to the task of its gram.

There, batches arrive sorted by gram. A batch gets suffix arrays over what follows and (read backwards) what precedes its
anchors, is merge-scanned against the levels present for matches of the full length, and becomes a level itself; levels of
equal rank merge. From the common-prefix lengths of both arrays come, for every split of ``length`` before and after an
anchor, classes of equal strings, without comparing pairs.

Defined cases: null text is empty; matches never cross rows; repeated rows count as places of their own, with one result
each; texts shorter than ``length`` keep everything; null ids are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, mix64, staged, texts

GRAM = 100
#: Bytes hashed at once; a longer text is hashed alone.
BUFFER = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, BUFFER + 4096)
            step = np.full(self.n, BASE, np.uint64)
            back = np.full(self.n, pow(BASE, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)
        return self.up[:n], self.down[:n]


def gram_hashes(data: np.ndarray, gram: int, powers: Powers) -> np.ndarray:
    """A scrambled polynomial hash of each run of ``gram`` bytes."""
    up, down = powers.upto(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    return mix64((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """The least (or greatest) of each run of ``w`` values, from running extremes of blocks of ``w`` in both directions."""
    f, fill = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    n = len(x) - w + 1
    rows = np.full(-(-len(x) // w) * w, fill, np.uint64)
    rows[: len(x)] = x
    rows = rows.reshape(-1, w)
    ahead = f.accumulate(rows, 1).ravel()
    behind = f.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return f(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(many: list[bytes], length: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts laid end to end: the anchors' places, gram hashes, and the text each is in."""
    data = np.frombuffer(b"".join(many), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none
    h, w = gram_hashes(data, gram, powers), length - gram + 1
    low = sliding(h, w, True)  # of each string of ``length`` bytes
    ends = np.cumsum([len(x) for x in many])
    owner = np.repeat(np.arange(len(many)), [len(x) for x in many])
    inside = np.arange(len(low)) + length <= ends[owner[: len(low)]]
    # A place is an anchor if some string over it, within one text, has its hash as the least. None has 0 but by chance.
    marked = np.where(inside, low, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), marked, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(sliding(padded, w, False)[: len(h)] == h)
    return at, h[at].view(np.int64), owner[at]


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of a batch in runs of about ``BUFFER`` bytes: (first row, texts)."""
    col, start, held, size = batch.column("text"), 0, [], 0
    for i in range(batch.num_rows):
        raw = col[i].as_py().encode()
        if held and size + len(raw) > BUFFER:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def _anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """key, snip, doc_id, mark, pos: every anchor with a hash of its surroundings."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, reach = Powers(), length - gram
        for b in batches:
            for first, many in _grouped(b):
                at, key, owner = anchors(many, length, gram, powers)
                starts = np.concatenate([[0], np.cumsum([len(x) for x in many])])
                pos = at - starts[owner] if len(at) else at
                snip = [_surroundings(many[o], p, reach, length) for o, p in zip(owner.tolist(), pos.tolist(), strict=True)]
                rows = pa.array(owner + first)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.array(snip, np.uint64).view(np.int64), pa.int64()), b.column("doc_id").take(rows), b.column("mark").take(rows), pa.array(pos, pa.int32())], names=["key", "snip", "doc_id", "mark", "pos"])

    return docs.mapInArrow(run, f"key bigint, snip bigint, doc_id {id_type}, mark bigint, pos int")


def _surroundings(raw: bytes, p: int, reach: int, length: int) -> int:
    return xxhash.xxh64_intdigest(raw[max(0, p - reach) : p + length], min(p, reach))


class Level:
    """Anchors with both suffix arrays: ``after`` (from the anchor on) and ``before`` (backwards from it), padded with zero bytes
    and ending in their own length, so that a text's end sorts first. lo and hi: how far matches were found to reach."""

    FIELDS = ("key", "snip", "after", "before", "na", "nb", "lo", "hi")

    def __init__(self, **fields):
        self.__dict__.update(fields)

    @classmethod
    def build(cls, key, snip, n, before: list[bytes], after: list[bytes], length: int, gram: int) -> Level:
        reach = length - gram
        na, nb = np.array([len(x) for x in after], np.int64), np.array([len(x) for x in before], np.int64)
        pad = lambda xs, w: np.array([x.ljust(w, b"\0") + len(x).to_bytes(2, "big") for x in xs], f"S{w + 2}")
        lo, hi = np.full(len(key), -1), np.full(len(key), -1)
        twice = (n > 1) & (na + nb >= length)
        lo[twice], hi[twice] = nb[twice], na[twice]
        out = cls(key=key, snip=snip, after=pad(after, length), before=pad([x[::-1] for x in before], reach), na=na, nb=nb, lo=lo, hi=hi)
        return out.take(np.argsort(out.after, kind="stable"))

    def take(self, at) -> Level:
        return Level(**{f: getattr(self, f)[at] for f in self.FIELDS})

    def merged(self, other: Level) -> Level:
        """Both as one level, again in suffix order (a stable sort of two sorted runs merges them)."""
        both = Level(**{f: np.concatenate([getattr(self, f), getattr(other, f)]) for f in self.FIELDS})
        return both.take(np.argsort(both.after, kind="stable"))

    def __len__(self) -> int:
        return len(self.key)


def common(ordered: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common-prefix lengths of neighbours in a suffix array; the first has none."""
    width = ordered.dtype.itemsize - 2
    out = np.zeros(len(ordered), np.int64)
    raw = np.frombuffer(ordered.tobytes(), np.uint8).reshape(len(ordered), -1)[:, :width]
    for at in range(1, len(ordered), 20000):
        to = min(at + 20000, len(ordered))
        differ = raw[at:to] != raw[at - 1 : to - 1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        out[at:to] = np.minimum(first, np.minimum(sizes[at:to], sizes[at - 1 : to - 1]))
    return out


def scan(x: Level, length: int, gram: int) -> None:
    """Widens lo and hi of each anchor of a level (in suffix order) by the strings of ``length`` bytes that others in it share."""
    m = len(x)
    if m < 2:
        return
    back = np.argsort(x.before, kind="stable")
    rank = np.empty(m, np.int64)
    rank[back] = np.arange(m)
    la, lb = common(x.after, x.na), common(x.before[back], x.nb[back])
    for o in range(length - gram + 1):
        fit = np.flatnonzero((x.nb >= o) & (x.na >= length - o))
        if len(fit) < 2:
            continue
        code = np.cumsum(lb < o)[rank[fit]] * (m + 1) + np.cumsum(la < length - o)[fit]
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        shared = fit[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        x.lo[shared] = np.maximum(x.lo[shared], o)
        x.hi[shared] = np.maximum(x.hi[shared], length - o)


class Family:
    """Levels of geometrically growing size. ``add`` returns what is complete: grams that lie before the batch's, as batches come
    in the order of their grams."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.levels = length, gram, []

    def add(self, new: Level) -> list[Level]:
        done, least = [], new.key.min()
        for i, (r, x) in enumerate(self.levels):
            if (over := x.key < least).any():
                done.append(x.take(over))
                self.levels[i] = r, x.take(~over)
        self.levels = [(r, x) for r, x in self.levels if len(x)]
        scan(new, self.length, self.gram)
        for i, (r, old) in enumerate(self.levels):
            hit = np.isin(old.key, new.key)
            if not hit.any():
                continue
            mine = np.isin(new.key, old.key)
            a, b = old.take(hit), new.take(mine)
            n = len(a)
            both = Level(**{f: np.concatenate([getattr(a, f), getattr(b, f)]) for f in Level.FIELDS})
            order = np.argsort(both.after, kind="stable")
            both = both.take(order)
            scan(both, self.length, self.gram)
            back = np.argsort(order)
            both = both.take(back)
            old.lo[hit], old.hi[hit], new.lo[mine], new.hi[mine] = both.lo[:n], both.hi[:n], both.lo[n:], both.hi[n:]
        self.levels.append((0, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (r, b), (_, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((r + 1, a.merged(b)))
        return done

    def close(self) -> list[Level]:
        return [x for _, x in self.levels]


def _matched(snips: DataFrame, length: int, gram: int) -> DataFrame:
    """key, snip, lo, hi of the surroundings with repeated strings; ``snips`` sorted by key within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(length, gram)

        def out(levels: list[Level]) -> Iterator[pa.RecordBatch]:
            for x in levels:
                x = x.take(x.lo >= 0)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.key, pa.int64()), pa.array(x.snip, pa.int64()), pa.array(x.lo, pa.int32()), pa.array(x.hi, pa.int32())], names=["key", "snip", "lo", "hi"])

        for b in batches:
            if b.num_rows:
                get = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                yield from out(family.add(Level.build(get("key"), get("snip"), get("n"), b.column("before").to_pylist(), b.column("after").to_pylist(), length, gram)))
        yield from out(family.close())

    return snips.mapInArrow(run, "key bigint, snip bigint, lo int, hi int")


def repeated(docs: DataFrame, length: int = 400, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (doc_id, text, mark), and per row (doc_id, mark) its list of spans that are covered by repeats."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    reach = length - gram
    found = staged(_anchored(rows, length, gram), "anchors")
    twice = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    found = staged(found.join(apart(twice, "key"), "key"), "candidates")
    cells = found.groupBy("key", "snip").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "pos")).alias("at"))
    wanted = cells.groupBy("at.doc_id", "at.mark").agg(F.collect_list(F.struct("key", "snip", "n", "at.pos")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("snip", pa.int64()), ("n", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column("text")[i].as_py().encode()
                cuts = b.column("cuts")[i].as_py()
                for at in range(0, len(cuts), 4096):
                    yield pa.RecordBatch.from_pylist([{"key": c["key"], "snip": c["snip"], "n": c["n"], "before": raw[max(0, c["pos"] - reach) : c["pos"]], "after": raw[c["pos"] : c["pos"] + length]} for c in cuts[at : at + 4096]], schema=schema)

    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["mark"] == wanted["mark"])
    snips = rows.join(wanted, same).select("text", "cuts").mapInArrow(cut, "key bigint, snip bigint, n bigint, before binary, after binary")
    matched = _matched(snips.repartition("key").sortWithinPartitions("key"), length, gram)
    covered = found.join(apart(matched.dropDuplicates(["key", "snip"]), "key", "snip"), ["key", "snip"])
    spans = covered.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct((F.col("pos") - F.col("lo")).alias("start"), (F.col("pos") + F.col("hi")).alias("end")))).alias("spans"))
    return rows, spans


def _joined(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256."""
    rows, spans = repeated(texts(docs, id_col, text_col), length, gram)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raws = [t.encode() for t in part.column("text").to_pylist()]
                cuts = [_joined(s) for s in part.column("spans").to_pylist()]
                kept = []
                for raw, cut in zip(raws, cuts, strict=True):
                    edges = [0, *(e for c in cut for e in c), len(raw)]
                    kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array([len(r) - len(k) for r, k in zip(raws, kept, strict=True)], pa.int64()), pa.array([len(c) for c in cuts], pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    same = rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["mark"] == spans["mark"])
    return rows.join(spans, same, "left").select(rows["doc_id"], "text", "spans").mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
