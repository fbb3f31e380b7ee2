"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over every byte of the document, cut into overlapping chunks; each chunk is max-pooled, and
the chunks' maxima and their mean are combined by a logistic layer into one probability. It is trained on the driver on a
bounded sample of labelled rows (``per_class`` of each class), and scores whole texts in one pass without a shuffle.

Defined cases: null text is empty; the empty text is scored as one chunk of zero bytes; without labelled rows of both classes
every score is the sample's share of label 1 (0.5 without any); null and repeated ids are scored row by row, and count as the empty
text for the fold; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, texts
from .samples import labelled

WIDTH, FILTERS, CHUNK, STRIDE = 5, 24, 512, 448
#: Bytes of text convolved at once.
BLOCK = 1 << 18


def pieces(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one padded byte array; where each chunk starts; to which text it belongs."""
    size = [max(len(x), WIDTH) for x in raw]
    data = np.frombuffer(b"".join(x.ljust(WIDTH, b"\0") for x in raw) + b"\0" * CHUNK, np.uint8)
    starts, owner, at = [], [], 0
    for i, n in enumerate(size):
        own = np.arange(0, max(n - (CHUNK - STRIDE), 1), STRIDE)
        starts.append(np.minimum(own, max(n - CHUNK, 0)) + at)
        owner.append(np.full(len(own), i))
        at += n
    return data, np.concatenate(starts), np.concatenate(owner)


class Network:
    """table[j, byte, f]: what a byte at place j adds to filter f; bias; then a logistic layer over maxima and means."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, 3 * FILTERS + 1).astype(np.float32)
        self.prior: float | None = None

    def pooled(self, raw: list[bytes], where: bool = False):
        """Per chunk and filter the largest response (and its place): positions past the text's end don't count."""
        data, starts, owner = pieces(raw)
        n = len(data) - WIDTH + 1
        pair = data[:-1].astype(np.int64) * 256 + data[1:]
        twin = (self.table[0][:, None, :] + self.table[1][None, :, :]).reshape(65536, FILTERS), (self.table[2][:, None, :] + self.table[3][None, :, :]).reshape(65536, FILTERS)
        resp = twin[0][pair[:n]]
        resp += twin[1][pair[2 : n + 2]]
        resp += self.table[4][data[4 : n + 4]]
        limits = np.cumsum([max(len(x), WIDTH) for x in raw])
        ends = np.minimum(starts + CHUNK, limits[owner]) - WIDTH + 1
        if where:
            at = np.stack([s + resp[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])
            return np.take_along_axis(resp, at, 0) + self.bias, owner, at, data
        # reduceat over (start, end) pairs: every other result is the chunk's
        cut = np.stack([starts, ends], 1).ravel()
        return np.maximum.reduceat(resp, cut, 0)[::2] + self.bias, owner

    def combined(self, top: np.ndarray, owner: np.ndarray, n: int):
        """Per text: the largest, the smallest and the mean of its chunks' maxima, squashed, and a constant."""
        act = np.tanh(top)
        first = np.searchsorted(owner, np.arange(n))
        count = np.diff(np.append(first, len(owner)))[:, None]
        high, low = np.maximum.reduceat(act, first, 0), np.minimum.reduceat(act, first, 0)
        return np.concatenate([high, low, np.add.reduceat(act, first, 0) / count, np.ones((n, 1), np.float32)], 1), act, first, count

    def score(self, raw: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(raw), self.prior)
        out = []
        at = 0
        while at < len(raw):
            to, size = at + 1, len(raw[at])
            while to < len(raw) and size + len(raw[to]) <= BLOCK:
                size += len(raw[to])
                to += 1
            x = self.combined(*self.pooled(raw[at:to]), to - at)[0]
            out.append(1 / (1 + np.exp(-(x @ self.out).astype(np.float64))))
            at = to
        return np.concatenate(out) if out else np.zeros(0)


def train(sample: list[tuple[str, int]], epochs: int = 8, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross-entropy, classes weighted to count alike by half; gradients reach the tables through the maxima."""
    net = Network(seed)
    y = np.array([v for _, v in sample], np.float32)
    if len(set(y.tolist())) < 2:
        net.prior = float(y.mean()) if len(y) else 0.5
        return net
    raw = [t.encode() for t, _ in sample]
    r = np.random.default_rng(seed)
    par = [net.table, net.bias, net.out]
    m, v, t = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    for epoch in range(epochs):
        order, at = r.permutation(len(raw)), 0
        step = rate * (1 - epoch / epochs) + 1e-4
        while at < len(order):
            to, size = at, 0
            while to < len(order) and to - at < 32 and (size == 0 or size + len(raw[order[to]]) <= BLOCK):
                size += len(raw[order[to]])
                to += 1
            pick, at = order[at:to], to
            top, owner, where, data = net.pooled([raw[i] for i in pick], True)
            x, act, first, count = net.combined(top, owner, len(pick))
            p = 1 / (1 + np.exp(-(x @ net.out)))
            d = ((p - y[pick]) / len(pick)).astype(np.float32)
            g_out = x.T @ d + 1e-4 * net.out
            dx = d[:, None] * net.out
            high, low = x[:, :FILTERS], x[:, FILTERS : 2 * FILTERS]
            da = dx[owner, :FILTERS] * (act == high[owner]) + dx[owner, FILTERS : 2 * FILTERS] * (act == low[owner]) + (dx[:, 2 * FILTERS : 3 * FILTERS] / count)[owner]
            dt = (da * (1 - act * act)).astype(np.float32)
            g_table = np.zeros_like(net.table)
            f = np.broadcast_to(np.arange(FILTERS), where.shape)
            for j in range(WIDTH):
                np.add.at(g_table[j], (data[where + j], f), dt)
            t += 1
            for i, g in enumerate((g_table, dt.sum(0), g_out)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                par[i] -= step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-7)
    return net


def score(docs: DataFrame, net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [x.encode() for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(net.score(raw), pa.float64())], names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, per_class: int = 1500, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: trained outside fold ``held`` of crc32(doc_id) mod ``folds``."""
    net = train(labelled(docs, labels, "quality", folds, held, per_class))
    return score(docs, net).select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
