"""WARC archives: one gzip member for each record, written and read in sequence."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import query, table

#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 8_000_000
#: Tasks over which the pages of one digest are dealt.
SLOTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"  # fixed, so that a repeated task writes the same bytes


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pack_record(page: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """A record as a gzip member of its own. A revisit keeps the HTTP head, which tells the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {_DATE}",
             f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def members(content: bytes, step: int = 65_536) -> Iterator[bytes]:
    """The gzip members of an archive, each inflated piece by piece."""
    at, view = 0, memoryview(content)
    while at < len(view):
        unpacker, parts, start = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            if at >= len(view):
                raise ValueError(f"the member at byte {start} is cut off")
            piece = view[at:at + step]
            parts.append(unpacker.decompress(piece))
            at += len(piece)
        at -= len(unpacker.unused_data)
        yield b"".join(parts)


def headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_record(member: bytes) -> dict:
    """Frame a record by its content length and verify its digests.

    Raises on a cut or overlong record, a missing end mark and a wrong digest.
    """
    split = member.find(b"\r\n\r\n")
    if split < 0 or not member.startswith(b"WARC/"):
        raise ValueError("no record head")
    head = headers(member[:split])
    start, length = split + 4, int(head["content-length"])
    block = member[start:start + length]
    if len(block) != length or member[start + length:] != b"\r\n\r\n":
        raise ValueError(f"{head.get('warc-record-id')}: the length does not fit")
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError(f"{head.get('warc-record-id')}: wrong block digest")
    cut = block.find(b"\r\n\r\n")
    http, payload = headers(block[:cut]), block[cut + 4:]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (digest != payload_digest(payload) or int(http["content-length"]) != len(payload)):
        raise ValueError(f"{head.get('warc-record-id')}: wrong payload digest")
    return {"page_id": _page(head["warc-record-id"]), "url": head["warc-target-uri"],
            "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": head["warc-type"],
            "refers_to": _page(head["warc-refers-to"]) if "warc-refers-to" in head else None,
            "payload": payload if head["warc-type"] == "response" else None}


def with_revisits(pages: DataFrame, least: int) -> DataFrame:
    """Add `_payload`, `_kind` and `_refers`: equal payloads of `least` bytes or more point to the row with the largest id.

    Copies are counted by digest with partial sums. Pages look their digest up by (digest, slot): a payload that
    a third of all pages share is dealt to `SLOTS` tasks, and each repeated digest is copied to all slots.
    """
    rows = pages.withColumn("_payload", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")))
    rows = rows.withColumn("_sha", F.sha1("_payload"))
    large = rows.where(F.octet_length("_payload") >= least)
    copies = (large.groupBy("_sha").agg(F.count("*").alias("_n"), F.max("page_id").alias("_refers"))
              .where("_n > 1").drop("_n").withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long")))))
    joined = rows.withColumn("_slot", F.pmod(F.xxhash64("page_id", "url"), F.lit(SLOTS).cast("long"))).join(copies, ["_sha", "_slot"], "left")
    revisit = F.coalesce((F.octet_length("_payload") >= least) & F.col("_refers").isNotNull()
                         & ~F.col("page_id").eqNullSafe(F.col("_refers")), F.lit(False))
    return joined.select(*rows.columns, F.when(revisit, "revisit").otherwise("response").alias("_kind"),
                         F.when(revisit, F.col("_refers")).alias("_refers"))


def write_warc(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all rows of `pages` (page_id, url, html): (part, archive, n_records, content).

    `content` is a whole archive; the table in the shared folder holds the archives in
    any store that Spark reaches. Null html is an empty payload, null urls are empty;
    of rows that repeat the largest id all are responses; a null id is never referred to
    (rows that share a payload and have no id at all are responses); an empty table gives no archive.
    """
    rows = with_revisits(pages.select("page_id", "url", "html"), least).select("page_id", "url", "_payload", "_kind", "_refers")

    def run(batches):
        part, archive, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "archive": pa.array([archive], pa.int32()),
                                               "n_records": pa.array([len(held)], pa.int64()), "content": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for page, url, payload, kind, refers in zip(*(batch.column(c) for c in ("page_id", "url", "_payload", "_kind", "_refers"))):
                held.append(pack_record(page.as_py(), url.as_py(), payload.as_py(), kind.as_py(), refers.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, archive = [], 0, archive + 1
        if held:
            yield close()

    return written(rows.mapInArrow(run, "part int, archive int, n_records long, content binary"), "warc")


def read_warc(archives: DataFrame, payload: bool = False) -> DataFrame:
    """A row for each record of archives in a `content` column (as the binaryFile source gives them, too)."""
    fields = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
              "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payload else {})
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for member in members(content.as_buffer().to_pybytes()):
                    held.append(read_record(member))
                    size += held[-1]["payload_bytes"]
                    if size > 4_000_000 or len(held) >= 4_096:
                        yield pa.RecordBatch.from_pydict({n: pa.array([h[n] for h in held], t) for n, t in fields.items()})
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pydict({n: pa.array([h[n] for h in held], t) for n, t in fields.items()})

    return archives.select("content").mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in fields.items()))


@query("op7_warc")
def op7_warc(spark, folder):
    records = read_warc(write_warc(table(spark, folder, "pages"), least=0))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
