"""WARC archives: a writer with revisit records and a splittable reader (operator 6).

Writer: one gzip member a record, through Spark's own file writer, whose commit protocol keeps a
lost task from leaving half an archive.  That writer ends each row with a separator; the last
byte of a gzip member is the high byte of its size, zero for a record under 16 MB, so the
separator is that zero byte (a larger record is followed by an empty member, which ends so too).

Reader: files are dealt as byte ranges.  A task scans its range for the gzip magic, takes a
candidate for a record if the member's decoded head is that of a WARC record and the whole member
decodes with the right checksum, and owns the records that start inside its range, also where
they end beyond it.  It reads in pieces and holds one record.  A member that is stored inside
another record's payload looks the same to a task whose range starts within that record; such
members lie inside the outer record's bytes and are taken out by that, per file.

Defined results: null html is an empty payload; null url gives no target; a null page_id is
written as such, takes part as the largest id, and isn't referred to while another id has the
payload; rows that repeat page_id and payload are responses both; of an empty table nothing is
written and an empty result read; files without a record, and bytes between records, are passed
over; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustframe.llm.common import cut, folder, map_arrow, register, table

# Formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
BLANK = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID = "<urn:page:{}>"
RECORD = ("path string, offset long, length long, warc_type string, record_id string, refers_to string, target_uri string, "
          "payload_digest string, payload_bytes long, payload binary")


def _clean(text: str) -> bytes:
    """A header value: control characters and spaces as percent codes."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text).encode("utf-8", "replace")


def member(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str, level: int) -> bytes:
    """One WARC record as a gzip member."""
    block = HTTP if is_revisit else HTTP + payload
    head = [VERSION, b"WARC-Type: " + (b"revisit" if is_revisit else b"response"), b"WARC-Date: " + date.encode(),
            b"WARC-Record-ID: " + PAGE_ID.format("null" if page_id is None else page_id).encode(),
            b"WARC-Payload-Digest: sha256:" + digest.encode(), b"Content-Type: application/http; msgtype=response",
            b"Content-Length: %d" % len(block)]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _clean(url))
    if is_revisit:
        head += [b"WARC-Refers-To: " + PAGE_ID.format(refers_to).encode(), b"WARC-Profile: " + REVISIT_PROFILE]
    out = gzip.compress(b"\r\n".join(head) + BLANK + block + BLANK, level, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", level, mtime=0)


class RangeScan:
    """The records that start in bytes start .. end - 1 of an open file."""

    def __init__(self, file, start: int, end: int, piece: int = 1 << 20):
        self.file, self.end, self.piece = file, end, piece
        self.base, self.buf = start, b""
        file.seek(start)

    def _more(self) -> bool:
        new = self.file.read(self.piece)
        self.buf += new
        return bool(new)

    def _decode(self, at: int) -> tuple[bytes, int] | None:
        """The member at this place of the buffer and its length, if it is a record."""
        d, out, p, checked = zlib.decompressobj(31), [], at, False
        try:
            while not d.eof:
                if p >= len(self.buf) and not self._more():
                    return None
                new = d.decompress(self.buf[p:p + 65536])
                p = min(p + 65536, len(self.buf))
                out.append(new)
                if not checked and (head := b"".join(out)[:5]):
                    if not b"WARC/".startswith(head):
                        return None
                    checked = len(head) == 5
        except zlib.error:
            return None
        return (b"".join(out), p - len(d.unused_data) - at) if checked else None

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while True:
            i = self.buf.find(MAGIC, at)
            if i < 0:
                keep = max(at, len(self.buf) - len(MAGIC) + 1)
                self.base, self.buf, at = self.base + keep, self.buf[keep:], 0
                if self.base >= self.end or not self._more():
                    return
                continue
            if self.base + i >= self.end:
                return
            got = self._decode(i)
            if got:
                yield self.base + i, got[1], got[0]
                i += got[1] - 1
            at = i + 1
            if at > 4 * self.piece:
                self.base, self.buf, at = self.base + at, self.buf[at:], 0


def parse(record: bytes) -> dict | None:
    """Headers and payload of a decoded record; None if it has no head."""
    head, found, rest = record.partition(BLANK)
    if not found:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if colon:
            fields[k.strip().lower()] = v.strip().decode("utf-8", "replace")
    try:
        block = rest[:int(fields.get(b"content-length", len(rest)))]
    except ValueError:
        block = rest
    kind = fields.get(b"warc-type")
    payload = block.partition(BLANK)[2] if fields.get(b"content-type", "").startswith("application/http") else block
    revisit = kind == "revisit"
    digest = fields.get(b"warc-payload-digest", "").rpartition(":")[2] or None
    return {"warc_type": kind, "record_id": fields.get(b"warc-record-id"), "refers_to": fields.get(b"warc-refers-to"),
            "target_uri": fields.get(b"warc-target-uri"), "payload_digest": digest if revisit else hashlib.sha256(payload).hexdigest(),
            "payload_bytes": None if revisit else len(payload), "payload": None if revisit else payload}


@dataclass
class WarcStore:
    date: str = "1970-01-01T00:00:00Z"
    level: int = 4
    least_revisit: int = 100  # bytes of payload
    range_bytes: int = 16 << 20
    tasks: int = 20_000  # that the ranges are dealt to, at most

    def records(self, pages: DataFrame) -> DataFrame:
        """The pages with payload, digest, and the page they repeat."""
        x = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
        x = x.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
        first = (x.filter(F.col("size") >= self.least_revisit).groupBy(F.col("digest").alias("d"))
                 .agg(F.min("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c"))
        x = x.join(first, (F.col("digest") == F.col("d")) & (F.col("size") >= self.least_revisit), "left")
        return x.withColumn("is_revisit", F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).drop("d")

    def write(self, pages: DataFrame, path: str) -> None:
        date, level = self.date, self.level

        def run(batch):
            for i in range(0, batch.num_rows, 64):
                rows = batch.slice(i, 64).to_pylist()
                yield [pa.array([member(r["page_id"], r["url"], r["payload"], r["digest"], r["first"], r["is_revisit"], date, level)[:-1] for r in rows], pa.binary())]

        cols = ["page_id", "url", "payload", "digest", "first", "is_revisit"]
        members = map_arrow(self.records(pages), cols, run, "member binary")
        members.select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)

    def read(self, spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
        """The records of all files under the path, with or without their payloads."""
        names = ["path", "offset", "length", "warc_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload"]
        step = self.range_bytes
        files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")  # listed, not read
        ranges = (files.select("path", F.explode(F.expr(f"sequence(0L, length - 1, {step}L)")).alias("start"))
                  .withColumn("end", F.col("start") + step))
        # a fixed number, as the engine would take the few bytes of these rows for one task's work
        ranges = ranges.repartition(max(1, min(ranges.count(), self.tasks)))

        def run(batch):
            for r in batch.to_pylist():
                uri = r["path"].replace("file:/", "file:///", 1) if r["path"].startswith("file:/") and not r["path"].startswith("file://") else r["path"]
                fs, name = pa.fs.FileSystem.from_uri(uri)
                with fs.open_input_file(name) as f:
                    rows, held = [], 0
                    for offset, length, raw in RangeScan(f, r["start"], r["end"]):
                        if (x := parse(raw)) is None:
                            continue
                        if not payload:
                            x["payload"] = None
                        rows.append(x | {"path": r["path"], "offset": offset, "length": length})
                        held += len(x["payload"] or b"") + 500
                        if held > 4 << 20:
                            yield columns(rows)
                            rows, held = [], 0
                    if rows:
                        yield columns(rows)

        def columns(rows):
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
            return [pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)]

        found = map_arrow(ranges, ["path", "start", "end"], run, RECORD)
        before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
        outer = F.coalesce(F.max(F.col("offset") + F.col("length")).over(before), F.lit(0))
        return found.withColumn("outer_end", outer).filter("offset >= outer_end").drop("outer_end")


OP6_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (payload_digest)
"""


@register("op6_warc", OP6_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back by byte ranges."""
    store, path = WarcStore(), folder(spark, "warc")
    store.write(table(spark, sf_dir, "pages"), path)
    recs = cut(store.read(spark, path, payload=False).drop("payload"))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS long)")
    full = recs.filter("warc_type = 'response'").groupBy(F.col("record_id").alias("rid"), F.col("payload_digest").alias("dig")).agg(F.max("payload_bytes").alias("size"))
    back = recs.join(full, (F.col("refers_to") == F.col("rid")) & (F.col("payload_digest") == F.col("dig")), "left")
    return back.select(page("record_id").alias("page_id"), F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest",
                       F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))
