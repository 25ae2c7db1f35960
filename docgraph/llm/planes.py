"""Token ids in files of byte or bit planes.

A file holds the ids of whole documents, in ascending order of doc_id. Its ids stand in chunks of CHUNK; a chunk is
transposed into planes (the first bytes of all its ids, then the second ones; or the same by bits), and each plane is a
zstandard frame. Behind the chunks come two tables and their place: a chunk index (offset, ids, checksum, sizes of the
planes) by which any range of ids is read without the chunks before it, and the documents (doc_id, number of ids).

    "BPF1", plane kind (1 byte), bytes of an id (1), ids of a chunk (4) | chunks | tables | offset of the tables (8), their checksum (4), "BPF1"

Documents are encoded and dealt to ranges of doc_id in one step; the ranges come from quantiles of the ids, and an id
that more than one range begins with (a third of all rows may have it) is spread over these by its content. Each range is sorted by
Spark, which may spill, and written as files of about FILE_IDS ids one after the other, so a task holds one file and the
document at hand. Files are rows (part, file, content) in Parquet in the shared folder: they lie in any store that Spark
writes, and a task that is lost is written anew. Where a file's ids begin among all is the sum of those of the parts before,
one number a part.

Edge cases: a null or empty text has the end id alone; rows that repeat a doc_id are ordered by their content; a null
doc_id comes last; texts of any length are encoded whole, word by word, and those that go to the library as they are in pieces
of some WHOLE characters, cut where the tokenizer cuts in any case (before a single space between a sign and a letter); an empty
table gives no files and no rows; other columns don't matter; a damaged file raises ValueError.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.bpe import LETTER, NUMBER, classes, cuts
from docgraph.llm.common import materialize, mix, partitions, table

MAGIC = b"BPF1"
BITS, BYTES = 0, 1
CHUNK = 1 << 16
FILE_IDS = 1 << 21
LEVEL = 3
HEAD, TAIL, ENTRY = struct.Struct("<4sBBI"), struct.Struct("<QI4s"), struct.Struct("<QII")

VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Characters of the texts that are encoded together, and of a piece of a text that goes to the library as it is.
PIECE, WHOLE = 1 << 16, 1 << 18
#: Words that a task's worker knows the ids of, and words that are encoded in a row.
KNOWN, NEW = 1 << 20, 1 << 12
CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")


def width(most: int) -> int:
    """Bytes that hold ids up to `most`."""
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4


def to_planes(ids: np.ndarray, size: int, kind: int) -> list[bytes]:
    """Planes of a chunk of unsigned ids of `size` bytes, the lowest first."""
    rows = ids.astype(f"<u{size}").view(np.uint8).reshape(-1, size)
    if kind == BITS:
        return [p.tobytes() for p in np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")]
    return [p.tobytes() for p in rows.T]


def from_planes(planes: list[bytes], n: int, size: int, kind: int) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if kind == BITS:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view(f"<u{size}").reshape(-1).astype(np.uint32)


def pack(docs: list[tuple[int | None, np.ndarray]], kind: int = BYTES, chunk: int = CHUNK, level: int = LEVEL) -> bytes:
    """A file of documents (doc_id, ids), in the order given."""
    ids = np.concatenate([i for _, i in docs]) if docs else np.zeros(0, np.uint32)
    size = width(int(ids.max(initial=0)))
    squeeze = zstandard.ZstdCompressor(level=level)
    out, entries, at = [HEAD.pack(MAGIC, kind, size, chunk)], [], HEAD.size
    for lo in range(0, len(ids), chunk):
        own = ids[lo : lo + chunk]
        planes = [squeeze.compress(p) for p in to_planes(own, size, kind)]
        entries.append(ENTRY.pack(at, len(own), zlib.crc32(b"".join(planes))) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    known = np.array([d is not None for d, _ in docs], np.uint8)
    names = np.array([0 if d is None else d for d, _ in docs], "<i8")
    tables = squeeze.compress(struct.pack("<QQ", len(entries), len(docs)) + b"".join(entries) + known.tobytes() + names.tobytes() + np.array([len(i) for _, i in docs], "<u8").tobytes())
    return b"".join([*out, tables, TAIL.pack(at, zlib.crc32(tables), MAGIC)])


class File:
    """A file's tables, and its ids by range."""

    def __init__(self, content: bytes):
        self.content = content
        if len(content) < HEAD.size + TAIL.size:
            raise ValueError("not a file of planes: too short")
        magic, self.kind, self.size, self.chunk = HEAD.unpack_from(content)
        at, check, end = TAIL.unpack_from(content, len(content) - TAIL.size)
        tables = content[at : len(content) - TAIL.size]
        if magic != MAGIC or end != MAGIC or zlib.crc32(tables) != check:
            raise ValueError("not a file of planes: marks or tables are damaged")
        raw = zstandard.ZstdDecompressor().decompress(tables)
        chunks, docs = struct.unpack_from("<QQ", raw)
        planes = self.size * (8 if self.kind == BITS else 1)
        entry = ENTRY.size + 4 * planes
        self.index = [(*ENTRY.unpack_from(raw, 16 + k * entry), struct.unpack_from(f"<{planes}I", raw, 16 + k * entry + ENTRY.size)) for k in range(chunks)]
        at = 16 + chunks * entry
        known = np.frombuffer(raw, np.uint8, docs, at)
        names = np.frombuffer(raw, "<i8", docs, at + docs)
        self.doc_ids = [d if k else None for d, k in zip(names.tolist(), known.tolist())]
        self.counts = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)

    def chunk_ids(self, k: int) -> np.ndarray:
        at, n, check, sizes = self.index[k]
        data = self.content[at : at + sum(sizes)]
        if zlib.crc32(data) != check:
            raise ValueError(f"chunk {k} is damaged")
        expand, planes, lo = zstandard.ZstdDecompressor(), [], 0
        for size in sizes:
            planes.append(expand.decompress(data[lo : lo + size]))
            lo += size
        return from_planes(planes, n, self.size, self.kind)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi of the file, out of the chunks that hold them."""
        parts = [self.chunk_ids(k) for k in range(lo // self.chunk, -(-hi // self.chunk))] if hi > lo else []
        return np.concatenate(parts)[lo - lo // self.chunk * self.chunk :][: hi - lo] if parts else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in the file, ids), holding one chunk and one document."""
        held, held_k, at = np.zeros(0, np.uint32), -1, 0
        for doc, n in zip(self.doc_ids, self.counts.tolist()):
            parts, lo = [], at
            while lo < at + n:
                k = lo // self.chunk
                if k != held_k:
                    held, held_k = self.chunk_ids(k), k
                hi = min(at + n, (k + 1) * self.chunk)
                parts.append(held[lo - k * self.chunk : hi - k * self.chunk])
                lo = hi
            yield doc, at, parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            at += n


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's tokenizer; strings of special tokens in a text are text. Spark's tasks are the only threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def pieces(text: str, most: int = WHOLE) -> list[str]:
    """The text in pieces of about `most` characters, cut where the tokenizer cuts in any case."""
    out, lo = [], 0
    while len(text) - lo > most and (m := CUT.search(text, lo + most)):
        out.append(text[lo : m.start()])
        lo = m.start()
    return [*out, text[lo:]]


@lru_cache(maxsize=1 << 16)
def _settled(char: int) -> bool:
    """Whether every version of Unicode since 3.2 puts a code point into one class; the library's tables are older than ours."""
    return classes()[char] not in (LETTER, NUMBER) or unicodedata.ucd_3_2_0.category(chr(char))[0] in "LN"


def _starts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the texts joined, where the tokenizer's words start, contractions included, and where texts begin."""
    chars, start, at = cuts(texts)
    flag = np.zeros(len(chars) + 1, bool)
    flag[start] = True
    mark = np.flatnonzero((chars == ord("'")) & flag[:-1])
    if len(mark):
        end = at[np.searchsorted(at, mark, "right")]
        one, two = (np.where(mark + k < end, chars[np.minimum(mark + k, len(chars) - 1)], 0) for k in (1, 2))
        size = np.where(np.isin(one, list(map(ord, "stmd"))), 2, 0)
        for x, y in ("re", "ve", "ll"):
            size = np.where((one == ord(x)) & (two == ord(y)), 3, size)
        mark, size = mark[size > 0], size[size > 0]
        flag[mark + 1] = False
        flag[mark + size] = True
    return chars, np.flatnonzero(flag[:-1]), at


def _split(chars: np.ndarray, start: np.ndarray) -> list[str]:
    """The words that begin at `start`, by a mark between them that no text has, or one by one."""
    if not len(start):
        return []
    if not chars.all():
        joined = chars.tobytes().decode("utf-32-le", "surrogatepass")
        return [joined[a:b] for a, b in zip(start.tolist(), [*start[1:].tolist(), len(joined)])]
    return np.insert(chars, start[1:], 0).tobytes().decode("utf-32-le", "surrogatepass").split("\0")


class _Numbers(dict):
    """Words by number, in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Words:
    """Ids of the words met so far, each encoded once by the library; about KNOWN words at most are kept."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0
        self.first, self.counts, self.known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _learn(self, words: list[str]) -> None:
        """Words that begin with a space and go on otherwise are cut before it whatever comes before: they are encoded in a row."""
        spaced = np.fromiter((w[0] == " " and not w.isspace() for w in words), bool, len(words))
        in_row, alone = np.flatnonzero(spaced), np.flatnonzero(~spaced)
        counts, ids = np.zeros(len(words), np.int32), []
        for lo in range(0, len(in_row), NEW):
            own = in_row[lo : lo + NEW]
            got = self.tokenizer.encode("".join(map(words.__getitem__, own.tolist())), add_special_tokens=False)
            counts[own] = np.bincount(np.array(got.word_ids, np.int64), minlength=len(own))
            ids.append(np.array(got.ids, self.flat.dtype))
        if len(alone):
            each = [e.ids for e in self.tokenizer.encode_batch(list(map(words.__getitem__, alone.tolist())), add_special_tokens=False)]
            counts[alone] = list(map(len, each))
            ids.append(np.array(list(chain.from_iterable(each)), self.flat.dtype))
        while self.known + len(words) > len(self.first):
            self.first, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.counts))
        while self.used + int(counts.sum()) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        order = np.concatenate([in_row, alone])
        ends = self.used + np.cumsum(counts[order], dtype=np.int64)
        self.counts[self.known : self.known + len(words)] = counts
        self.first[self.known + order] = ends - counts[order]
        for part in ids:
            self.flat[self.used : self.used + len(part)] = part
            self.used += len(part)
        self.known += len(words)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in a row, and how many each has."""
        if self.known > KNOWN:
            self.forget()
        codes = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.new:
            new, self.number.new = self.number.new, []
            self._learn(new)
        sizes = self.counts[codes]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.flat[np.repeat(self.first[codes] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def encoded(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    """Ids of each text, as the library gives them.

    Words (the tokenizer's own, none of which depends on another) are told apart by array operations and encoded once
    each. Texts with a letter or digit that the library's tables may not know go to it whole."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= PIECE):
            size += len(texts[hi] or "")
            hi += 1
        own = [t or "" for t in texts[lo:hi]]
        odd = {} if all(map(str.isascii, own)) else _unsettled(own, path)
        chars, start, at = _starts(["" if k in odd else t for k, t in enumerate(own)])
        ids, sizes = _words(path).ids(_split(chars, start))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, at)].tolist()
        for k in range(len(own)):
            yield odd[k] if k in odd else ids[ends[k] : ends[k + 1]]
        lo = hi


def _unsettled(texts: list[str], path: str) -> dict[int, np.ndarray]:
    """Ids of the texts with a letter or digit that the library's tables may not know."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum([len(t) for t in texts])
    wrong = [c for c in np.unique(chars[chars > 127]).tolist() if not _settled(c)]
    odd = np.unique(np.searchsorted(at, np.flatnonzero(np.isin(chars, wrong)), "right")).tolist() if wrong else []
    return {k: np.concatenate([np.array(tokenizer(path).encode(p, add_special_tokens=False).ids, np.uint32) for p in pieces(texts[k])]) for k in odd}


def ranges(keys: DataFrame, parts: int) -> np.ndarray:
    """The `parts` - 1 doc_ids that part the rows evenly; an id with many rows may stand there more than once."""
    if parts < 2:
        return np.zeros(0, np.int64)
    found = keys.filter("doc_id is not null").agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / parts for k in range(1, parts)], 100 * parts).alias("q")).first()["q"]
    return np.array(found or [], np.int64)


def encode(docs: DataFrame, path: str, end: int | None = END, bounds: np.ndarray | None = None) -> DataFrame:
    """(part, doc_id, size, ids): each text's ids as little-endian integers of `size` bytes, with the end id, and the range of its doc_id."""
    bounds = np.zeros(0, np.int64) if bounds is None else bounds
    last = np.array([] if end is None else [end], np.uint32)

    def run(batches):
        for batch in batches:
            size = width(max(tokenizer(path).get_vocab_size() - 1, end or 0))
            ids = [np.concatenate([i, last]).astype(f"<u{size}").tobytes() for i in encoded(batch.column(1).to_pylist(), path)]
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            key = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            low, high = (np.where(known, np.searchsorted(bounds, key, side), len(bounds)) for side in ("left", "right"))
            part = low + (mix(np.array([zlib.crc32(i) for i in ids], np.uint64)) % (high - low + 1).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), pa.array([size] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["part", "doc_id", "size", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "part int, doc_id long, size int, ids binary")


def write_ids(tokens: DataFrame, kind: int = BYTES, chunk: int = CHUNK, level: int = LEVEL, file_ids: int = FILE_IDS) -> DataFrame:
    """The files (part, file, base, n_docs, n_ids, content) of tokens (part, doc_id, size, ids), parts being ranges of doc_id that ascend.

    base: ids of the part's files before; file: number within the part. They are written to the shared folder."""
    parts = partitions(tokens.sparkSession)

    def run(batches):
        held, size, part, number, base = [], 0, None, 0, 0

        def done():
            row = (part, number, base, len(held), size, pack(held, kind, chunk, level))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["part", "file", "base", "n_docs", "n_ids", "content"])

        for batch in batches:
            for own, doc, bytes_, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if held and (own != part or size >= file_ids):
                    yield done()
                    number, base = (0, 0) if own != part else (number + 1, base + size)
                    held, size = [], 0
                part = own
                held.append((doc, np.frombuffer(raw.as_buffer(), f"<u{bytes_}")))
                size += len(held[-1][1])
        if held:
            yield done()

    ordered = tokens.repartitionById(parts, "part").sortWithinPartitions("part", F.asc_nulls_last("doc_id"), "ids")
    return materialize(ordered.mapInArrow(run, "part int, file int, base long, n_docs long, n_ids long, content binary"), "planes")


def read_ids(files: DataFrame, whole: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents in the files; start: ids of all documents before.

    whole: with ids as an array; without, digests only."""
    totals = dict(files.groupBy("part").agg(F.sum("n_ids")).collect())  # a number for each part, of which there are as many as tasks
    before = dict(zip(sorted(totals), np.cumsum([0, *(totals[p] for p in sorted(totals))]).tolist()))

    def run(batches):
        for batch in batches:
            for part, base, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                got, start = [], before[part] + base
                for doc, at, ids in File(content).documents():
                    raw = ids.astype("<u4").tobytes()
                    got.append((doc, start + at, len(ids), zlib.crc32(raw), raw))
                columns = [pa.array([g[k] for g in got], pa.int64()) for k in range(4)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if whole:
                    columns.append(pa.ListArray.from_arrays(np.cumsum([0, *(g[2] for g in got)]), pa.array(np.frombuffer(b"".join([g[4] for g in got]), "<u4").astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return files.select("part", "base", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if whole else ""))


def documents_to_files(docs: DataFrame, path: str, end: int | None = END, kind: int = BYTES, chunk: int = CHUNK, file_ids: int = FILE_IDS) -> DataFrame:
    """The files of the ids of all texts of docs (doc_id, text)."""
    bounds = ranges(docs.select("doc_id"), partitions(docs.sparkSession))
    return write_ids(encode(docs, path, end, bounds), kind, chunk, file_ids=file_ids)


def op11_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(documents_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)), whole=False)
