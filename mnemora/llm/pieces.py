"""SentencePiece encoding that keeps offsets, and decoding, worked out here from a model's tables.

The model's compiled character map (a double-array trie over UTF-8, with the replacement strings behind it) is walked with
longest-prefix matches, and every normalised byte records the original byte it comes from. The normalised text is cut where no
piece of the vocabulary has the two neighbouring characters next to each other: no merge can cross such a place. Within a
stretch, the adjacent pair that is the best-scored piece merges first, the leftmost of equals. What is no piece in the end
becomes one piece for each byte. The pieces' lengths over the normalised bytes project each piece to its span of original bytes.
Words not met before are merged many at a time, as rows of numpy arrays.

Of models, those with byte-pair merges, byte pieces and otherwise only normal, unknown and control pieces are read; others raise
ValueError.

Defined cases: null text is empty and has no pieces; an empty table has no rows; null and repeated ids are kept row by row;
further columns are not read; very long texts are encoded whole; a piece that stands for nothing in the text (the dummy prefix)
has an empty span.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

SPACE = "▁".encode()
WORDS = re.compile("▁*[^▁]*(?<=.)", re.DOTALL)
#: Words that a task remembers with their pieces, about.
MEMO = 1 << 18
#: Words of up to so many characters are merged side by side and remembered; so many at a time.
SHORT, ROWS, NEVER = 40, 4096, float("-inf")


class CharacterMap:
    """The compiled map: ``longest(raw, at)`` gives (bytes matched, replacement) or None."""

    def __init__(self, blob: bytes):
        self.units, self.strings = [], b""
        if blob:
            n = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
            self.strings = blob[4 + n :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        units, best = self.units, None
        if not units:
            return None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = step(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            leaf, node = units[node] >> 8 & 1, node ^ step(units[node])
            if leaf:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])]


class Normalizer:
    """``(normalised bytes, source)``: source[i] is the original byte that normalised byte i comes from; one entry more ends it."""

    def __init__(self, blob: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.map, self.dummy, self.squeeze, self.space = CharacterMap(blob), dummy_prefix, squeeze, SPACE if escape else b" "

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        if not raw:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            return self._plain(raw)
        out, source, at = bytearray(), [], 0
        spaced = self.squeeze  # leading spaces go
        steps = []
        while at < len(raw):
            found = self.map.longest(raw, at)
            width = found[0] if found else 1 + sum(raw[at] >= x for x in (0xC0, 0xE0, 0xF0))
            steps.append((at, found[1] if found else raw[at : at + width]))
            at += width
        begun = False
        for at, new in steps:
            if self.squeeze and spaced:
                new = new.lstrip(b" ")
            if not new:
                continue
            if self.dummy and not begun:
                out += self.space
                source += [at] * len(self.space)
            begun = True
            for b in new:
                piece = self.space if b == 32 else bytes([b])
                out += piece
                source += [at] * len(piece)
            spaced = new.endswith(b" ")
        end = len(raw)
        while self.squeeze and out.endswith(self.space):
            del out[-len(self.space) :]
            end = source[-len(self.space)]
            del source[-len(self.space) :]
        return bytes(out), np.array([*source, end])

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        lead = self.space if self.dummy else b""
        width = np.where(np.frombuffer(raw, np.uint8) == 32, len(self.space), 1)
        source = np.repeat(np.arange(len(raw)), width)
        return lead + raw.replace(b" ", self.space), np.concatenate([np.zeros(len(lead), np.int64), source, [len(raw)]])


class Merger:
    """Byte-pair merges: ``pieces(texts)`` gives the ids of normalised texts."""

    def __init__(self, proto, kinds):
        used = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or kinds.BYTE not in used or not used <= {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}:
            raise ValueError("only byte-pair models with byte pieces and without user-defined and unused ones are read")
        plain = [(i, p) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        self.ids, self.scores = {p.piece: i for i, p in plain}, {p.piece: p.score for _, p in plain}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        #: Neighbouring characters in some piece. Elsewhere a text can be cut.
        self.joined = {x for p in self.ids for x in zip(p, p[1:], strict=False)}
        #: Whether a cut before each run of spaces holds good, which a pattern finds fastest.
        self.spaced = not any(y == SPACE.decode() != x for x, y in self.joined)
        self.memo: dict[str, list[int]] = {}
        self._tables()

    def _tables(self) -> None:
        """What characters are by code point (their piece, or for want of one a negative number), and the pairs of pieces that make
        a piece, sorted by a key."""
        self.first = -2 - np.arange(0x110000)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        self.base = max(self.ids.values(), default=0) + 1
        halves = [(self.ids[p[:k]] * self.base + self.ids[p[k:]], self.scores[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        halves.sort()
        self.keys = np.array([x[0] for x in halves] + [np.iinfo(np.int64).max], np.int64)
        self.score = np.array([x[1] for x in halves] + [NEVER], np.float32)
        self.made = np.array([x[2] for x in halves] + [-1], np.int64)
        #: Characters that are in pieces without being one; what they make isn't among the pairs.
        self.odd = frozenset(c for p in self.ids for c in p if c not in self.ids)

    def pieces(self, texts: list[str]) -> list[list[int]]:
        words = [WORDS.findall(t) if self.spaced else [t] for t in texts]
        memo = self.memo
        if len(memo) >= MEMO:
            memo.clear()
        new = {w for own in words for w in own if w not in memo}
        few = sorted((w for w in new if len(w) <= SHORT), key=len)
        for at in range(0, len(few), ROWS):
            part = few[at : at + ROWS]
            memo.update(zip(part, self._rows(part), strict=True))
        far = [w for w in new if len(w) > SHORT]
        for w in far:
            memo[w] = self._word(w)
        out = [[i for w in own for i in memo[w]] for own in words]
        for w in far:  # long ones aren't remembered
            del memo[w]
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, piece) that each pair makes; pairs with a negative half make none."""
        key = np.where((left < 0) | (right < 0), -1, left * self.base + right)
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return self.score[at], self.made[at]

    def _rows(self, words: list[str]) -> list[list[int]]:
        """The ids of short words, all merged side by side."""
        sizes = np.array([len(w) for w in words])
        wide = int(sizes.max()) + 1
        own = np.full((len(words), wide), -1, np.int64)
        own[np.arange(wide) < sizes[:, None]] = self.first[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        out: list[list[int]] = [[]] * len(words)
        rows = np.arange(len(words))
        score, made = self._pairs(own[:, :-1], own[:, 1:])
        cols = np.arange(wide)
        while len(rows):
            at = score.argmax(1)
            every = np.arange(len(rows))
            done = score[every, at] == NEVER
            if done.any():
                for r, ids in zip(rows[done].tolist(), own[done].tolist(), strict=True):
                    out[r] = ids[: ids.index(-1)]
                for r in rows[done][(own[done] < -1).any(1)].tolist():
                    out[r] = self._word(words[r]) if self.odd.intersection(words[r]) else [y for x in out[r] for y in ([x] if x >= 0 else [self.bytes[z] for z in chr(-2 - x).encode()])]
                rows, own, score, made, at = (x[~done] for x in (rows, own, score, made, at))
                every = np.arange(len(rows))
                if not len(rows):
                    break
            new = made[every, at]
            skip = np.minimum(cols + (cols > at[:, None]), wide - 1)
            own = np.take_along_axis(own, skip, 1)
            own[:, -1] = -1
            own[every, at] = new
            skip = np.minimum(skip[:, :-1], wide - 2)
            score, made = np.take_along_axis(score, skip, 1), np.take_along_axis(made, skip, 1)
            score[:, -1] = NEVER
            score[every, at], made[every, at] = self._pairs(new, own[every, at + 1])
            ahead = every[at > 0]
            score[ahead, at[ahead] - 1], made[ahead, at[ahead] - 1] = self._pairs(own[ahead, at[ahead] - 1], new[ahead])
        return out

    def _word(self, word: str) -> list[int]:
        """A word of any length and characters: cut where no piece can cross, and each stretch merged by a heap."""
        out, start = [], 0
        for end in range(1, len(word) + 1):
            if end == len(word) or (word[end - 1], word[end]) not in self.joined:
                for piece in self._merged(word[start:end]):
                    i = self.ids.get(piece)
                    out += [self.bytes[x] for x in piece.encode()] if i is None else [i]
                start = end
        return out

    def _merged(self, part: str) -> list[str]:
        """A heap holds the pairs that may merge; one of them is stale if either half has changed."""
        own, after, before, scores = list(part), list(range(1, len(part) + 1)), list(range(-1, len(part) - 1)), self.scores
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(own) and (score := scores.get(pair := own[left] + own[right])) is not None:
                heapq.heappush(heap, (-score, left, right, pair))

        for i in range(len(own) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, pair = heapq.heappop(heap)
            if not own[left] or not own[right] or after[left] != right or own[left] + own[right] != pair:
                continue
            own[left], own[right] = pair, ""
            after[left] = after[right]
            if after[left] < len(own):
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [x for x in own if x]


class Codec:
    """One model: ``encode`` texts to ids and byte spans, ``decode`` ids to texts."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.merger = Merger(proto, kinds)
        #: What each id says; None where it is a byte.
        says = {kinds.NORMAL: lambda p: p.piece.replace(SPACE.decode(), " "), kinds.UNKNOWN: lambda p: proto.trainer_spec.unk_surface, kinds.CONTROL: lambda p: "", kinds.BYTE: lambda p: None}
        self.says = [says[p.type](p) for p in proto.pieces]
        self.byte = {i: int(p.piece[3:5], 16) for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.width = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces])
        self.normal = {i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces

    def encode(self, many: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        normal = [self.normalize(t.encode()) for t in many]
        out = []
        for ids, (raw, source) in zip(self.merger.pieces([raw.decode() for raw, _ in normal]), normal, strict=True):
            width = self.width[ids] if ids else np.zeros(0, np.int64)
            ends = np.cumsum(width)
            if (int(ends[-1]) if ids else 0) != len(raw):
                raise ValueError("the pieces do not cover the normalised text")
            out.append((ids, source[ends - width], source[ends]))
        return out

    def decode(self, ids: list[int]) -> str:
        out, first, held = [], True, bytearray()
        says = self.says
        for i in ids:
            said = says[i]
            if said is None:
                held.append(self.byte[i])
                first = False
                continue
            if held:
                out.append(_characters(held))
                held = bytearray()
            if first:
                if i in self.normal and (self.dummy or self.squeeze) and said.startswith(" "):
                    said = said[1:]  # the dummy prefix; where leading spaces go, all of them do
                    first = self.squeeze and not said
                elif said:
                    first = False
            out.append(said)
        return "".join(out) + _characters(held)


def _characters(raw: bytearray) -> str:
    """Bytes as text; each byte that is no part of a character stands as a replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            width = 1 + sum(raw[at] >= x for x in (0xC0, 0xE0, 0xF0))
            try:
                out.append(raw[at : at + width].decode())
                at += width
            except UnicodeDecodeError:
                out.append("\ufffd")
                at += 1
        return "".join(out)


_ARROW = {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string()}
#: Texts encoded at once; their ids are Python objects meanwhile.
GROUP = 128


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", finish: Callable | None = None, schema: str = "ids array<int>, starts array<int>, ends array<int>, decoded string") -> DataFrame:
    """doc_id and, of every whole text, its ids, the byte span of each piece and the decoded text. No shuffle; the model's bytes
    travel with the task. ``finish(ids, starts, ends, decoded)`` may make other columns (``schema``) of these in the same pass."""
    with open(model_path, "rb") as f:
        model = f.read()
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = [_ARROW[x.split()[1]] for x in schema.split(", ")]
    finish = finish or (lambda ids, starts, ends, decoded: (ids, starts, ends, decoded))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                found = codec.encode(part.column("text").to_pylist())
                rows = [finish(*x, codec.decode(x[0])) for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True))], names=["doc_id", *names])

    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, {schema}")


def round_trip_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the covered bytes by the spans (n_bytes)."""
    memo: dict[int, str] = {}

    def finish(ids, starts, ends, decoded):
        for i in ids:
            if i not in memo:
                memo[i] = str(i)
        return len(ids), hashlib.sha256(",".join([memo[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), int((ends - starts).sum())

    return encode(docs, model_path, id_col, text_col, finish, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint")
