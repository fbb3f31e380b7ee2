"""WARC bundles in seekable Zstandard form.

Records are packed into bundles of independent Zstandard frames; each bundle ends with the seek table of the public
seekable format, and a directory maps record ids to (frame, offset inside the frame, length). A bundle is one binary cell of
a Parquet table in the shared folder, so that Spark alone does the input and output, wherever the folder is;
``export_bundle`` gives the bytes of an ordinary ``.warc.zst`` file.

Of records with equal payloads of at least ``least`` bytes, the one with the largest id is kept as ``response`` and the
others are ``revisit`` records that refer to it. Defined cases: a null payload is empty; a null id is allowed and sorts
below all others; repeated rows are records of their own, and all rows with the largest id of a group are responses; very long
payloads make a frame of their own; an empty table makes no bundle; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, staged

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

#: Bytes of records in a frame, and of frames in a bundle, before a new one is begun.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 23
DIRECTORY = "array<struct<page_id:bigint,frame:int,at:int,bytes:int>>"


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block, but names the payload's digest, length and the record that holds it."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {' '.join((url or '').split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"" if kind == "revisit" else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    return fields, rest[: int(fields["Content-Length"])]


class Bundle:
    """Collects records into frames; ``close`` gives the bytes with their seek table, and the directory."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.limit, self.z = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.body, self.open, self.directory = bytearray(), bytearray(), []

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.directory.append({"page_id": page_id, "frame": len(self.frames), "at": len(self.open), "bytes": len(raw)})
        self.open += raw
        if len(self.open) >= self.limit:
            self._frame()

    def _frame(self) -> None:
        packed = self.z.compress(bytes(self.open))
        self.frames.append((len(packed), len(self.open)))
        self.body += packed
        self.open.clear()

    def close(self) -> tuple[bytes, list[dict]]:
        if self.open:
            self._frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        table = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return bytes(self.body) + struct.pack("<II", SKIPPABLE, len(table)) + table, self.directory


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, packed bytes, plain bytes) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    out, at, start = [], 0, len(bundle) - 9 - n * width
    for i in range(n):
        packed, plain = struct.unpack_from("<II", bundle, start + i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def frame(bundle: bytes, table: list[tuple[int, int, int]], i: int) -> bytes:
    """One frame's records, without touching the others."""
    at, packed, plain = table[i]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


def export_bundle(bundle: bytes) -> bytes:
    """The bytes to write as a ``.warc.zst`` file: the cell as it is; decoders skip the footer."""
    return bytes(bundle)


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, kind, refers_to. Only groups of equal payloads are joined back; the hot ones are
    one row each there, and Spark may split their pages over tasks."""
    p = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    groups = p.where(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("kept")).where("n > 1").drop("n")
    p = p.join(apart(groups, "digest"), ["digest", "n_bytes"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return p.select("page_id", "url", "payload", "digest", "n_bytes", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("kept")).alias("refers_to"))


def write(plan: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """The bundles (bundle, directory) of ``planned`` rows, as a table in the shared folder. Each task packs its own rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bundle", pa.binary()), ("directory", pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("at", pa.int32()), ("bytes", pa.int32())])))])
        out, size = Bundle(frame_bytes), 0

        def closed(b: Bundle) -> pa.RecordBatch:
            data, directory = b.close()
            return pa.RecordBatch.from_pylist([{"bundle": data, "directory": directory}], schema=schema)

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "kind", "payload", "digest", "n_bytes", "refers_to")]
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in cols]
                raw = record(*row)
                out.add(row[0], raw)
                size += len(raw)
                if size >= bundle_bytes:
                    yield closed(out)
                    out, size = Bundle(frame_bytes), 0
        if out.directory:
            yield closed(out)

    return staged(plan.mapInArrow(pack, f"bundle binary, directory {DIRECTORY}"), "warc", "none")  # frames are compressed already


def read(bundles: DataFrame) -> DataFrame:
    """One row per archived record: page_id, url, kind, payload (null for revisits), digest, n_bytes, refers_to. A response's
    digest is computed anew from what the frame holds; one that differs from its header is an error."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("refers_to", pa.int64())])
        number = lambda s: int(s[len("<urn:page:") : -1]) if len(s) > len("<urn:page:>") else None
        for batch in batches:
            for i in range(batch.num_rows):
                bundle = batch.column("bundle")[i].as_py()
                table, rows, held, plain = seek_table(bundle), [], -1, b""
                for e in batch.column("directory")[i].as_py():
                    if e["frame"] != held:
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                        held, plain = e["frame"], frame(bundle, table, e["frame"])
                    fields, block = parse(plain[e["at"] : e["at"] + e["bytes"]])
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if number(fields["WARC-Record-ID"]) != e["page_id"]:
                        raise ValueError(f"the directory leads to another record than {e['page_id']}")
                    if kind == "response":
                        if (own := hashlib.sha1(block).hexdigest()) != digest:
                            raise ValueError(f"payload of {e['page_id']} has digest {own}, not {digest}")
                        n = len(block)
                    else:
                        block, n = None, int(fields["X-Payload-Length"])
                    rows.append({"page_id": e["page_id"], "url": fields["WARC-Target-URI"], "kind": kind, "payload": block, "digest": digest, "n_bytes": n, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return bundles.mapInArrow(unpack, "page_id bigint, url string, kind string, payload binary, digest string, n_bytes bigint, refers_to bigint")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """Writes every page and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    back = read(write(planned(pages, id_col, url_col, payload_col, least)))
    return back.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
