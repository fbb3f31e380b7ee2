"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti, Kaushik 2006).

A document's set are its distinct shingles of ``words`` words. Sets are grouped in bands of nearly equal size; sets of a band
that are similar enough differ in at most k elements. The domain of shingles is cut in n1 parts, more than k/2 of them, so that
two such sets differ in at most one element in some part; each part is cut in n2 cells, and of the subsets that leave one cell
out, at least one is the same in both sets: its hash is their common signature. A set also visits the next band when its
partners may be there.

``n1`` has some parts more than are needed. If all but that many parts of a set have no subset of t elements or fewer, the
set leaves its subsets of up to t elements out: for any similar set there is still a part, with larger subsets only, that
agrees. So thin signatures, which unlike sets share by chance, go without any loss.

Equal sets are one node. In a group of nodes that share a signature, all are compared with the least one first; later only
nodes of one group that the links found so far don't connect are compared. Comparisons are exact, on 64-bit shingle hashes.

Defined cases: null and blank texts have the empty set and no links; texts of fewer words have one shingle, the whole
sequence; equal rows are copies, with a row each in the result; the component is the least id reachable, null ids counting for
nothing unless a group has no other; an empty table gives an empty result; further columns aren't read. Links are transitive, so a
component may hold texts that are unlike each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import apart, drop_staged, mix64, staged, texts
from .components import components

MEMO = 1 << 19
#: Sizes within a band differ at most by this factor.
SPREAD = 1.25
#: Groups of more members are screened by parity maps, in panels of this many members.
SMALL, PANEL = 8, 4096
#: Up to this band limit, parts have three cells and subsets of two; beyond, two cells and subsets of one.
FINE = 256


class Words(dict):
    """64-bit hashes of words, each worked out once as long as it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 11)
        return h


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int):
        self.words, self.memo = words, Words()

    def __call__(self, text: str) -> np.ndarray:
        found = text.encode().lower().split()
        h = np.fromiter(map(self.memo.__getitem__, found), np.uint64, len(found))
        if not len(h):
            return h
        n = min(self.words, len(h))
        acc = mix64(h[: len(h) - n + 1])
        for j in range(1, n):
            acc = mix64(acc * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : len(h) - n + 1 + j])
        acc = np.sort(mix64(acc + np.uint64(n)))
        return acc[np.append(True, acc[1:] != acc[:-1])]


def set_id(s: np.ndarray) -> int:
    """A 64-bit id of a whole set."""
    return xxhash.xxh64_intdigest(s.tobytes(), 17) - (1 << 63)


class Bands:
    """Bands of set sizes and the signatures of a set, for links of ``100 * shared >= percent * union``."""

    def __init__(self, percent: int):
        self.percent = percent
        assert SPREAD >= 100 / percent, "a set's partners would be more than one band away"
        self.starts = [1]

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(int(self.starts[-1] * SPREAD) + 1)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def shape(self, band: int) -> tuple[int, int, int, int]:
        """k, n1, n2 and the number of spare parts."""
        top = self.starts[band + 1] - 1
        k = 2 * top * (100 - self.percent) // (100 + self.percent)
        need = k // 2 + 1
        spare = (3 * need) // 10 + 1 if k else 0
        return k, need + spare, (1 if not k else 3 if top <= FINE else 2), spare

    def signatures(self, s: np.ndarray) -> np.ndarray:
        own = self.band(len(s))
        self.band(self.starts[own + 1])
        out = [self._in(s, own)]
        if 100 * len(s) >= self.percent * self.starts[own + 1]:
            out.append(self._in(s, own + 1))
        return np.concatenate(out)

    def _in(self, s: np.ndarray, band: int) -> np.ndarray:
        k, n1, n2, spare = self.shape(band)
        if not k:
            return np.zeros(0, np.uint64)  # only equal sets link here
        h = mix64(s + np.uint64(0x51ED270B))
        cell = ((h >> np.uint64(33)) % np.uint64(n1) * np.uint64(n2) + (h & np.uint64(0xFFFF)) % np.uint64(n2)).astype(np.int64)
        total, count = np.zeros(n1 * n2, np.uint64), np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        np.add.at(total, cell, mix64(h))
        total = total.reshape(n1, n2)
        subsets = list(combinations(range(n2), n2 - 1))
        sums = np.stack([total[:, c].sum(1, dtype=np.uint64) for c in subsets], 1)
        sizes = np.stack([count[:, c].sum(1) for c in subsets], 1)
        thin = np.sort(sizes.min(1))[spare] - 1  # all but ``spare`` parts have only subsets larger than this
        tag = np.arange(n1 * len(subsets), dtype=np.uint64).reshape(n1, -1) + np.uint64(band << 40)
        return mix64(sums + mix64(tag))[sizes > thin]


def _described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, set_id (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n", "set_id"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, set_id bigint")


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """sig, set_id, n. A task emits a set once (as far as it remembers), so copies don't pile up in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bands, seen = Shingles(words), Bands(percent), set()
        for b in batches:
            ids, sizes, sigs = [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t)
                if not len(s) or (i := set_id(s)) in seen:
                    continue
                if len(seen) >= MEMO:
                    seen.clear()
                seen.add(i)
                own = bands.signatures(s)
                ids.append(np.full(len(own), i, np.int64))
                sizes.append(np.full(len(own), len(s), np.int32))
                sigs.append(own.view(np.int64))
                if len(ids) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, ids, sizes)], names=["sig", "set_id", "n"])
                    ids, sizes, sigs = [], [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, ids, sizes)], names=["sig", "set_id", "n"])

    return docs.select("text").mapInArrow(run, "sig bigint, set_id bigint, n int")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """set_id, elements and parity map of the documents in ``wanted`` (doc_id, one per set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = [shingles(t) for t in b.column("text").slice(at, 512).to_pylist()]
                part = [s for s in part if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in part], pa.int64()), pa.array([s.view(np.int64) for s in part], pa.list_(pa.int64())), pa.array([_parity(s) for s in part], pa.binary())], names=["set_id", "elements", "parity"])

    return docs.join(wanted, "doc_id").select("text").mapInArrow(run, "set_id bigint, elements array<bigint>, parity binary")


def _screened(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of one group and different components that may be similar, by parity maps: a pair's maps differ in no more bits than
    its sets differ in elements. All pairs of a group are screened in numpy, and only those that pass leave the task. A group of
    more than ``PANEL`` members is dealt out by pairs of panels."""
    panels = F.ceil(F.col("size") / PANEL).cast("int")
    own = F.pmod(F.xxhash64("set_id"), panels).cast("int")
    rows = mixed.join(sets.select("set_id", "parity"), "set_id").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), panels - 1)))
    rows = rows.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_id", "n", "component", "parity")

    def pairs(ids, sizes, parts, own, maps, crossed):
        width = min(map(len, maps)) // 8
        bits = np.stack([_folded(np.frombuffer(x, np.uint64), width) for x in maps])
        for r in range(len(ids) - 1):
            rest = slice(r + 1, None)
            both = sizes[r] + sizes[rest]
            differ = np.bitwise_count(bits[rest] ^ bits[r]).sum(1, dtype=np.int64)
            good = (differ * (100 + percent) <= both * (100 - percent)) & (parts[rest] != parts[r])
            if crossed:
                good &= own[rest] != own[r]
            for x in ids[rest][good].tolist():
                yield min(x, int(ids[r])), max(x, int(ids[r]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, [], set()

        def done():  # of the group held
            if len(held) < 2:
                return
            ids, sizes, parts, own = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[:4])
            for p in pairs(ids, sizes, parts, own, [h[4] for h in held], key[1] != key[2]):
                if p not in seen:
                    seen.add(p)
                    yield p

        def out(found):
            u, v = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            found = []
            for k1, k2, k3, *rest in zip(*(b.column(c).to_pylist() for c in ("sig", "i", "j", "set_id", "n", "component", "own", "parity")), strict=True):
                if (k1, k2, k3) != key:
                    found += done()
                    key, held = (k1, k2, k3), []
                held.append(rest)
            if found:
                yield out(found)
            if len(seen) > MEMO:
                seen.clear()
        if found := list(done()):
            yield out(found)

    return rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(run, "u bigint, v bigint")


def _parity(s: np.ndarray) -> bytes:
    """Of each cell of a map with four to eight cells an element (512 at least), whether the set has an odd number of elements there."""
    bits = max(512, 1 << (4 * len(s) - 1).bit_length())
    count = np.bincount((mix64(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """The same map with fewer cells."""
    while len(words) > width:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (u, v) of ``pairs`` (u, v, nu, nv) that may be similar by their parity maps, which move in place of the elements."""
    one, two = (sets.select(F.col("set_id").alias(x), F.col("parity").alias(f"p{x}")) for x in "uv")
    both = pairs.join(one, "u").join(two, "v").select("u", "v", "nu", "nv", "pu", "pv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for nu, nv, pu, pv in zip(*(b.column(c).to_pylist() for c in ("nu", "nv", "pu", "pv")), strict=True):
                width = min(len(pu), len(pv)) // 8
                x, y = (_folded(np.frombuffer(p, np.uint64), width) for p in (pu, pv))
                good.append(int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) * (100 + percent) <= (nu + nv) * (100 - percent))
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "u bigint, v bigint")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (u, v) of ``pairs`` whose sets are similar enough, exactly."""
    one, two = sets.select(F.col("set_id").alias("u"), F.col("elements").alias("su")), sets.select(F.col("set_id").alias("v"), F.col("elements").alias("sv"))
    both = pairs.join(one, "u").join(two, "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.where(100 * shared >= percent * (F.size("su") + F.size("sv") - shared)).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs`` (u, v, nu, nv). Most pairs of a group are unlike, and their elements needn't move: the parity maps
    are read and compared first, and what passes is a small table before the elements are."""
    possible = staged(_possible(pairs, sets, percent), "possible")
    links = staged(_linked(possible, sets, percent), "links")
    drop_staged(possible)
    return links


def _fits(a: str, b: str, percent: int):
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _mixed(groups: DataFrame, links: DataFrame) -> DataFrame:
    """sig, set_id, n, component: the groups whose members ``links`` leave in several components."""
    labels = components(links).withColumnRenamed("node", "set_id")
    placed = groups.join(labels, "set_id", "left").select("sig", "set_id", "n", F.coalesce("component", "set_id").alias("component"))
    several = placed.groupBy("sig").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).where("a <> b").select("sig", "size")
    return staged(placed.join(apart(several, "sig"), "sig"), "mixed")


def _central_pairs(mixed: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """(u, v, nu, nv): each node with one centre: of the groups that it shares with nodes of other components, the member with most
    company over all its groups. A text that many others were made from shares more with each of them than they do."""
    company = mixed.groupBy("set_id").agg(F.sum("size").alias("company"))
    known = mixed.join(apart(company, "set_id"), "set_id")
    centre = known.groupBy("sig").agg(F.max(F.struct("company", "set_id", "component", "n")).alias("c"))
    pairs = mixed.join(apart(centre, "sig"), "sig").where("component <> c.component").where(_fits("n", "c.n", percent))
    pairs = pairs.groupBy("set_id", "n", F.col("c.set_id").alias("centre"), F.col("c.n").alias("centre_n")).agg(F.max("c.company").alias("company"))
    first = F.col("set_id") < F.col("centre")
    sizes = F.when(first, F.col("n")).otherwise(F.col("centre_n")).alias("nu"), F.when(first, F.col("centre_n")).otherwise(F.col("n")).alias("nv")
    pairs = pairs.select(F.least("set_id", "centre").alias("u"), F.greatest("set_id", "centre").alias("v"), *sizes, "set_id", "company").join(done, ["u", "v"], "left_anti")
    return pairs.groupBy("set_id").agg(F.max(F.struct("company", "u", "v", "nu", "nv")).alias("p")).select("p.u", "p.v", "p.nu", "p.nv").distinct()


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when ``100 * shared >= percent * union`` of their shingle sets.

    First each node is compared with the least node of its groups, then in ``rounds`` rounds with a central one, and what is then
    left in one group but in several components with each other. All pairs are screened by parity maps; what passes is compared in full.
    """
    docs = texts(docs, id_col, text_col)
    light = staged(_described(docs, words), "sets")
    w = Window.partitionBy("sig").orderBy("set_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ranked = _signed(docs, words, percent).select("sig", "set_id", "n", F.first("set_id").over(upto).alias("least"), F.first("n").over(upto).alias("least_n"), F.lag("set_id").over(w).alias("before"), F.lead("set_id").over(w).alias("after"))
    copy, alone = F.col("before").eqNullSafe(F.col("set_id")), F.col("before").isNull() & F.col("after").isNull()
    groups = staged(ranked.where(~copy & ~alone).select("sig", "set_id", "n", "least", "least_n"), "groups")
    stars = groups.where("least <> set_id").where(_fits("n", "least_n", percent)).groupBy("set_id", "n").agg(F.min(F.struct("least", "least_n")).alias("p"))
    stars = staged(stars.select(F.col("p.least").alias("u"), F.col("set_id").alias("v"), F.col("p.least_n").alias("nu"), F.col("n").alias("nv")), "pairs")
    done = stars.select("u", "v")
    least = light.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    first = least.join(groups.select("set_id").distinct(), "set_id").select(F.col("first").alias("doc_id")).distinct()
    sets = staged(_sets(docs, first, words), "elements")  # twice only for equal rows, which does no harm
    links = _verified(stars, sets, percent)
    mixed = _mixed(groups.select("sig", "set_id", "n"), links)
    drop_staged(groups)
    for _ in range(rounds):
        pairs = staged(_central_pairs(mixed, done, percent), "pairs")
        done = done.unionByName(pairs.select("u", "v"))
        links = links.unionByName(_verified(pairs, sets, percent))
        before, mixed = mixed, _mixed(mixed.select("sig", "set_id", "n"), links)
        drop_staged(before)
    small = mixed.where(F.col("size") <= SMALL)
    a, b = (small.select("sig", *[F.col(c).alias(f"{c}_{x}") for c in ("set_id", "n", "component")]) for x in "ab")
    cross = a.join(b, "sig").where("set_id_a < set_id_b and component_a <> component_b").where(_fits("n_a", "n_b", percent)).select(F.col("set_id_a").alias("u"), F.col("set_id_b").alias("v"), F.col("n_a").alias("nu"), F.col("n_b").alias("nv"))
    cross = _possible(cross.distinct(), sets, percent).unionByName(_screened(mixed.where(F.col("size") > SMALL), sets, percent)).distinct()
    cross = staged(cross.join(done, ["u", "v"], "left_anti"), "pairs")  # screening's shuffles go before the sets move
    drop_staged(mixed)
    links = staged(links.unionByName(_linked(cross, sets, percent)), "links")
    drop_staged(sets)
    labels = components(links)
    joined = labels.join(least, labels["node"] == least["set_id"]).select("set_id", "component", "first")
    roots = joined.groupBy("component").agg(F.min("first").alias("root"))
    roots = joined.join(apart(roots, "component"), "component").select("set_id", "root")
    known = least.join(roots, "set_id", "left").select("set_id", F.coalesce("root", "first").alias("component_id"))
    return light.join(apart(known, "set_id"), "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
