"""Toxicity by non-negative positive-unlabelled learning in numpy.

A linear classifier over hashed words and word beginnings is trained from confirmed toxic texts and unlabelled ones. A text is
toxic by what it contains, however much harmless text surrounds it, so weights are kept non-negative (and sparse, by an
l1 penalty): harmless words add nothing, and long texts aren't washed clean. The risk is that of Kiryo et al. (2017): prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), where ``prior`` is the share of toxic rows
among the labelled ones outside the held-out fold; where the second term goes below zero, its gradient is reversed.

Defined cases: null text is empty and scores as the bias alone; without toxic or unlabelled texts every score is the prior; null
and repeated ids are scored row by row; very long texts count each of their words once; an empty table gives an empty result;
further columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, texts
from .samples import labelled_rows, unlabelled_rows

BITS = 18
BEGINNINGS = (4, 5, 7)
WORD = re.compile(r"\w+")
#: Distinct words whose places a task keeps in mind.
MEMO = 1 << 18


def _place(x: str) -> int:
    return xxhash.xxh32_intdigest(x) >> (32 - BITS)


class Features:
    """The distinct hashed places of a text's words and of the first 4, 5 and 7 letters of longer ones."""

    def __init__(self):
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> list[int]:
        out: set[int] = set()
        memo = self.memo
        for w in set(WORD.findall(text.lower())):
            if (p := memo.get(w)) is None:
                if len(memo) >= MEMO:
                    memo.clear()
                p = memo[w] = (_place(w), *(_place(f"^{w[:n]}") for n in BEGINNINGS if len(w) >= n))
            out.update(p)
        return list(out)


class Linear:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, many: list[list[int]]) -> np.ndarray:
        z = np.array([self.weights[x].sum(dtype=np.float64) if x else 0.0 for x in many]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Rows:
    """The places of many texts as one sparse 0/1 matrix: its products with weights, and with derivatives of the rows."""

    def __init__(self, many: list[np.ndarray]):
        self.n = len(many)
        self.cols = np.concatenate([np.zeros(0, np.int32), *many])
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in many])

    @classmethod
    def of(cls, texts: list[str]) -> Rows:
        feats = Features()
        return cls([np.array(feats(t), np.int32) for t in texts])

    def logits(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n) + b

    def gradient(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, d[self.rows], 1 << BITS)


def train(pos: Rows, unl: Rows, prior: float, steps: int = 150, rate: float = 0.15, hits: float = 3.0) -> Linear:
    """Projected Adam on the whole sample's non-negative risk with the logistic loss. The l1 penalty is what ``hits`` toxic texts
    weigh in the risk: a place has to occur in more of them to get a weight."""
    w, b = np.zeros(1 << BITS), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    if not pos.n or not unl.n:
        return Linear(w, b)
    penalty = hits * prior / pos.n
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        zp, zu = pos.logits(w, b), unl.logits(w, b)
        # losses: log(1 + e^-z) for label +, log(1 + e^z) for label -
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = -prior / pos.n * np.ones(pos.n), sig(zu) / unl.n  # d/dz of the sum: -sig(-z) - sig(z) = -1
        if rest < 0:  # step back on the negative part alone
            gp, gu = prior * sig(zp) / pos.n, -gu
        g, gb = pos.gradient(gp) + unl.gradient(gu) + penalty, float(gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * (1 - (t - 1) / steps)
        w = np.maximum(w - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8), 0)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return Linear(w.astype(np.float32), b)


def _gathered(rows: DataFrame) -> Rows:
    """The matrix of a bounded sample (doc_id, text). The tasks work the places out; packed, they come to the driver, no text does."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                packed = [np.array(sorted(feats(t)), np.int32).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "places"])

    found = rows.mapInArrow(run, f"doc_id {id_type}, places binary").collect()
    return Rows([np.frombuffer(r["places"], np.int32) for r in sorted(found, key=lambda r: r["doc_id"])])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, positives: int = 2000, unlabeled: int = 6000) -> Linear:
    """Trains on at most ``positives`` confirmed toxic texts and ``unlabeled`` others, all outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & (crc_fold("doc_id", folds) != held)).agg(F.avg("toxic")).first()[0]
    prior = min(max(float(known or 0.01), 0.01), 0.9)
    pos = _gathered(labelled_rows(docs, labels, "toxic", 1, folds, held, positives))
    return train(pos, _gathered(unlabelled_rows(docs, folds, held, unlabeled)), prior)


def score(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text; one pass, no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kept = np.flatnonzero(model.weights)
    packed = kept, model.weights[kept], model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS, np.float32)
        w[packed[0]] = packed[1]
        own, feats = Linear(w, packed[2]), Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.score([feats(t) for t in part.column("text").to_pylist()]), pa.float64())], names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: trained outside fold ``held`` of crc32(doc_id) mod ``folds``."""
    return score(docs, fit(docs, labels, folds, held)).select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
