"""Legacy archive converter: ARC files in, WARC files out.

ARC 1 headers have five fields (URL, IP, date, type, length), ARC 2 headers ten (URL, IP, date, type, result code,
checksum, location, offset, file name, length); a file's first record, filedesc:, says which. Records are read by their
declared lengths. The converter makes up what WARC asks for: record ids (UUIDs of the record's place and content),
ISO dates from the 14-digit ones, block and payload digests (base32 SHA-1), types, and revisit records for payloads
that another record has.

Archives are rows (archive, content) of gzip members, in Parquet in the shared folder, of bounded size each; so they
lie in any store that Spark writes. Which record of equal payloads keeps it is decided on narrow rows (digest and key),
merged by digest and one of SALTS salts first, so that no digest gathers in one task. Records of payloads that stand once
go from their ARC file to the WARC file in one task; only the others are shuffled, to meet the record that keeps their
payload. A filter of bounded size tells them apart; what it lets pass needlessly is only shuffled.

Edge cases: null html is an empty payload, null urls are written as "-"; empty payloads are equal payloads; a repeated
page_id is written and returned once for each row; a null page_id has no key: its record comes back with a null
page_id, and it never is the one revisited while another has a key; lines and lengths may hold anything UTF-8 can; ARC
records whose header or length can't be read, or that are shorter than they declare, are left out and listed by
rejects(); an empty table gives no archives and no rows; other columns don't matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import id_filter, materialize, table

ARCHIVE_BYTES = 4 << 20
PIECE = 1 << 12
SALTS = 64
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
EPOCH = datetime(2008, 1, 1, tzinfo=timezone.utc)
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    result: str | None = None
    checksum: str | None = None
    offset: int = 0


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(text: str | None) -> str:
    """A header field may not hold white space."""
    return re.sub(r"[\s%]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text or "") or "-"


def write_arc(name: str, version: int, records: list[ArcRecord]) -> bytes:
    """An ARC file of gzip members."""
    about = f"{version} {1 if version == 2 else 0} example\n{ARC_FIELDS[version]}\n".encode()
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    head = f"filedesc://{name} 0.0.0.0 {EPOCH:%Y%m%d%H%M%S} text/plain{extra} {len(about)}\n".encode()
    out = [gzip.compress(head + about + b"\n", 1, mtime=0)]
    size = len(out[0])
    for r in records:
        more = "" if version == 1 else f" {r.result or 200} {r.checksum or '-'} - {size} {name}"
        line = f"{_field(r.url)} {_field(r.ip)} {r.date} {_field(r.content_type)}{more} {len(r.body)}\n".encode()
        out.append(gzip.compress(line + r.body + b"\n", 1, mtime=0))
        size += len(out[-1])
    return b"".join(out)


def _members(content: bytes, bad: list | None = None) -> Iterator[tuple[int, bytes]]:
    """Gzip members with their offsets, or a plain file as a whole."""
    if content[:2] != b"\x1f\x8b":
        yield 0, content
        return
    at, whole = 0, memoryview(content)
    while at < len(content):
        unzip, out, end = zlib.decompressobj(31), [], at
        try:
            # by pieces: what a call is given beyond the member's end is copied
            while not unzip.eof and end < len(content):
                out.append(unzip.decompress(whole[end : end + PIECE]))
                end += PIECE
            out.append(unzip.flush())
        except zlib.error as e:
            if bad is None:
                raise ValueError(f"gzip member at {at}: {e}") from e
            bad.append((at, 0, "damaged gzip member"))
            return
        yield at, b"".join(out)
        at = min(end, len(content)) - len(unzip.unused_data)


def _arc_fields(line: bytes, version: int) -> tuple[list[str], int] | None:
    """Fields and declared length of an ARC header line, or None if it is none."""
    fields = line.decode("utf-8", "replace").rstrip("\r").split(" ")
    about = fields[0].startswith("filedesc:")
    if not re.fullmatch(r"[0-9]+", fields[-1]) or len(fields) < (5 if about or version == 1 else 10):
        return None
    return fields, int(fields[-1])


def read_arc(content: bytes, bad: list | None = None) -> Iterator[ArcRecord]:
    """Records of an ARC file, its filedesc: left out.

    With `bad`, records that can't be read are added to it as (offset, place, reason), and reading goes on at the next
    line or gzip member; without, they raise ValueError."""
    version = 1
    for offset, data in _members(content, bad):
        at = 0
        while at < len(data):
            if data[at : at + 1] in b"\r\n":
                at += 1
                continue
            end = data.find(b"\n", at)
            found = _arc_fields(data[at:end], version) if end >= 0 else None
            reason = "no header line" if not found else "shorter than declared" if end + 1 + found[1] > len(data) else None
            if reason:
                if bad is None:
                    raise ValueError(f"ARC record at {offset}+{at}: {reason}")
                bad.append((offset, at, reason))
                at = end + 1 if end >= 0 else len(data)
                continue
            fields, length = found
            body = data[end + 1 : end + 1 + length]
            if fields[0].startswith("filedesc:"):
                version = 2 if body[:1] == b"2" else 1
            elif version == 1:
                # a type may have been written with spaces
                yield ArcRecord(fields[0], fields[1], fields[2], " ".join(fields[3:-1]), body, offset=offset + at)
            else:
                yield ArcRecord(fields[0], fields[1], fields[2], " ".join(fields[3:-6]), body, fields[-6], fields[-5], offset + at)
            at = end + 1 + length


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Header and payload of an HTTP message; all is payload if there is no header."""
    if body[:5] != b"HTTP/":
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body[: end + 4], body[end + 4 :]) if end >= 0 else (body, b"")


def http_field(header: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", header)
    return found[1].decode("utf-8", "replace").strip() if found else None


def iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10] or '00'}:{date[10:12] or '00'}:{date[12:14] or '00'}Z"


def record_id(archive: str, r: ArcRecord, digest: str) -> str:
    """From the record's place (archive and offset) and content."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive} {r.offset} {r.url} {r.date} {digest}')}>"


def warc_record(kind: str, own: str, r: ArcRecord, header: bytes, payload: bytes, digest: str, size: int, more: list[tuple[str, str]] = ()) -> bytes:
    """One WARC 1.0 record, whose id is own, as a gzip member; a revisit's block is the HTTP header alone, size that of its payload."""
    block = header + payload if kind == "response" else header
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own),
        ("WARC-Date", iso(r.date)),
        ("WARC-Target-URI", r.url),
        ("WARC-IP-Address", r.ip),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("X-Payload-Length", str(size)),
        *more,
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    for _, data in _members(content):
        at = 0
        while at < len(data):
            if data[at : at + 1] in b"\r\n":
                at += 1
                continue
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = int(fields["content-length"])
            yield fields, data[end + 4 : end + 4 + length]
            at = end + 4 + length


def _files(rows: Iterator[tuple[bytes | ArcRecord, int]], join, kind: str) -> Iterator[tuple[str, bytes]]:
    """Archives (name, content) of about ARCHIVE_BYTES each, named by the task and their place in it."""
    held, size, k = [], 0, 0
    for item, n in rows:
        held.append(item)
        size += n
        if size >= ARCHIVE_BYTES:
            yield (name := f"{kind}-{TaskContext.get().partitionId():06d}-{k:05d}.{kind}.gz"), join(name, held)
            held, size, k = [], 0, k + 1
    if held:
        yield (name := f"{kind}-{TaskContext.get().partitionId():06d}-{k:05d}.{kind}.gz"), join(name, held)


FILES = "archive string, content binary"


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """Pages as ARC archives: HTTP responses, versions 1 and 2 by turns, dates made from page_id."""

    def run(batches):
        def rows():
            for batch in batches:
                for key, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    payload = (html or "").encode()
                    own = "" if key is None else f"X-Record-Key: {key}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
                    date = EPOCH + timedelta(seconds=(key or 0) % (1 << 28))
                    yield ArcRecord(url or "-", "192.0.2.1", f"{date:%Y%m%d%H%M%S}", "text/html", head + payload), len(payload) + 200

        for name, content in _files(rows(), lambda name, held: write_arc(name, 1 + len(held) % 2, held), "arc"):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, FILES)


def _records(batches, bad: list | None = None) -> Iterator[list[tuple[ArcRecord, bytes, bytes, str, str]]]:
    """For each archive of batches (archive, content) its records with header, payload, digest and id."""
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            out = []
            for r in read_arc(content.as_py(), [] if bad is None else bad):
                header, payload = split_http(r.body)
                digest = sha1(payload)
                out.append((r, header, payload, digest, record_id(name, r, digest)))
            yield out


def _short(name: str) -> int:
    """64 bits of a digest or record id."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little", signed=True)


def _table(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def rejects(arcs: DataFrame) -> DataFrame:
    """(archive, offset, place, reason): what convert() leaves out of ARC archives (archive, content)."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                bad: list = []
                for _ in read_arc(content.as_py(), bad):
                    pass
                yield _table([(name, *b) for b in bad], (pa.string(), pa.int64(), pa.int64(), pa.string()), ["archive", "offset", "place", "reason"])

    return arcs.select("archive", "content").mapInArrow(run, "archive string, offset long, place long, reason string")


def convert(arcs: DataFrame) -> DataFrame:
    """WARC archives, written into the shared folder, of ARC archives (archive, content).

    Of records with equal payloads the one with the largest key is the response; without keys the last by id."""

    def digests(batches):
        for got in _records(batches):
            rows = [(digest, _short(digest), _key(header), own, r.url, iso(r.date)) for r, header, _, digest, own in got]
            yield _table(rows, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), ["digest", "short", "key", "id", "url", "date"])

    arcs = arcs.select("archive", "content")
    narrow = arcs.mapInArrow(digests, "digest string, short long, key long, id string, url string, date string")
    top = F.max(F.struct("key", "id", "url", "date")).alias("top")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    parts = narrow.groupBy("digest", "short", salt).agg(F.count("*").alias("n"), top)
    whole = parts.groupBy("digest", "short").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.collect_set("salt").alias("salts")).filter("n > 1")
    kept = materialize(whole.select("digest", "short", "salts", "top"), "kept")
    several = arcs.sparkSession.sparkContext.broadcast(id_filter(kept, F.col("short")))

    types = (pa.string(), pa.binary(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = ["archive", "content", "digest", "id", "member", "header", "url", "ip", "date", "offset", "size"]

    def split(batches):
        """Archives of the records whose payload stands once; the others as rows, each as it would be written as the response."""
        open_: list[tuple] = []

        def single():
            for got in _records(batches):
                hit = several.value.has(np.array([_short(x[3]) for x in got], np.int64))
                for (r, header, payload, digest, own), met in zip(got, hit.tolist()):
                    member = warc_record("response", own, r, header, payload, digest, len(payload))
                    if met:
                        open_.append((None, None, digest, own, member, header, r.url, r.ip, r.date, r.offset, len(payload)))
                    yield (b"" if met else member), len(member)

        for name, content in _files(single(), lambda name, got: b"".join(got), "warc"):
            yield _table([(name, content, *[None] * 9)] if content else [], types, names)
            yield _table(open_, types, names)
            open_.clear()

    rows = materialize(arcs.mapInArrow(split, f"{FILES}, digest string, id string, member binary, header binary, url string, ip string, date string, offset long, size long"), "warc")
    met = rows.filter("digest is not null").drop("archive", "content").withColumn("salt", salt)
    kept = kept.select(F.col("digest").alias("k_digest"), F.explode("salts").alias("k_salt"), *[F.col(f"top.{c}").alias(f"k_{c}") for c in ("key", "id", "url", "date")])
    met = met.join(kept, (F.col("digest") == F.col("k_digest")) & (F.col("salt") == F.col("k_salt")), "left")
    met = met.select("digest", "id", "member", "header", "url", "ip", "date", "offset", "size", "k_key", "k_id", "k_url", "k_date")

    def revisit(batches):
        def out():
            for batch in batches:
                for digest, own, member, header, url, ip, date, offset, size, key, kept_id, kept_url, kept_date in zip(*(c.to_pylist() for c in batch.columns)):
                    if kept_id is not None and kept_id != own:
                        more = [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", kept_id), ("WARC-Refers-To-Target-URI", kept_url), ("WARC-Refers-To-Date", kept_date)]
                        if key is not None:
                            more.append(("X-Refers-To-Key", str(key)))
                        member = warc_record("revisit", own, ArcRecord(url, ip, date, "text/html", b"", offset=offset), header, b"", digest, size, more)
                    yield member, len(member)

        for name, content in _files(out(), lambda name, got: b"".join(got), "warc"):
            yield _table([(f"met-{name}", content)], (pa.string(), pa.binary()), ["archive", "content"])

    return rows.filter("content is not null").select("archive", "content").unionByName(materialize(met.mapInArrow(revisit, FILES), "warc-met"))


def _key(header: bytes) -> int | None:
    found = http_field(header, "X-Record-Key")
    return int(found) if found else None


def read_pages(warcs: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, warc_date, target_uri of WARC archives.

    A response's payload is measured and hashed again and must agree with what its header says."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for fields, block in read_warc(content.as_py()):
                    header, payload = split_http(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(fields["x-payload-length"])
                    if fields["warc-type"] == "response" and (sha1(payload), len(payload)) != (digest, size):
                        raise ValueError(f"{fields['warc-record-id']} does not match its digest")
                    to = fields.get("x-refers-to-key")
                    out.append((_key(header), size, digest, fields["warc-type"], None if to is None else int(to), fields["warc-record-id"], fields["warc-date"], fields["warc-target-uri"]))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "target_uri"])

    return warcs.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string")


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(convert(materialize(pages_to_arc(table(spark, sf_dir, "pages")), "arc")))
