"""Byte-level BPE encoding and decoding, each distinct word encoded once.

Texts are cut into pre-tokens. Each task numbers the distinct words among its documents, most frequent first, and writes
its documents as numbers, in order of position. The words themselves go, packed by bucket of their hash, to a global
shuffle, where each distinct word of a bucket is encoded once for all tasks that ask; ids go back to the askers,
join there by number, and the documents are put together again by position. Decoding joins ids with the
token-byte table, whose size the vocabulary fixes. Both runs over the documents must see the same batches: documents that
are not rows of files are written first.

Pre-tokens are cut with array operations on character classes, which follow the pattern exactly; texts in which a
contraction may stand ('s, 't, ...) are cut by the regular expression itself.

Edge cases: a null or empty text has no tokens, its ids and bytes are those of the empty string; repeated rows and
ids keep their rows; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import _BYTE, materialize, mix, partitions, powers, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters that are cut at once, and that a task's batch of documents has about.
CHARS = 1 << 19
BATCH = 1 << 23
#: A pattern that takes a word as it is.
WHOLE = r"(?s:.+)"
CONTRACTION = re.compile(r"'(?:[stmd]|re|ve|ll)")

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(maxsize=4)
def _regex(pattern: str):
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in _regex(name).finditer(every):
            kinds[m.start() : m.end()] = kind
    kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """The tiktoken library's encoder for a file of ranks, and the bytes of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table_ = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table_[rank] = token
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table_


def cuts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the texts joined, where pre-tokens start, and each text's first character; no contractions."""
    joined = "".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = len(chars)
    if not n:
        return chars, np.zeros(0, np.int64), at
    kind = classes()[chars]
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    begins = begins[:n]
    start = begins.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # of white space before something else in the same text, the last character stands apart ...
    space = kind == SPACE
    last = space.copy()
    last[:-1] &= ~space[1:] & ~begins[1:]
    last[-1] = False
    start |= last
    # ... and is joined to what follows if it is a plain space
    blank = np.flatnonzero(last & (chars == 32))
    start[blank + 1] = False
    return chars, np.flatnonzero(start), at


def pretokens(texts: list[str], pattern: str):
    """For runs of texts: hash of each pre-token, a function that gives the word at an index, and bounds by text."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHARS):
            size += len(texts[hi])
            hi += 1
        yield _cut(texts[lo:hi], pattern)
        lo = hi


def _cut(texts: list[str], pattern: str):
    odd = {k: _regex(pattern).findall(t) for k, t in enumerate(texts) if "'" in t and CONTRACTION.search(t)}
    chars, start, at = cuts(["" if k in odd else t for k, t in enumerate(texts)])
    end = np.append(start[1:], len(chars)) if len(start) else start
    up, down = powers(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    value = mix(chars.astype(np.uint64) + _BYTE[0])
    np.cumsum(value * up[: len(chars)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.searchsorted(start, at)
    joined = "".join("" if k in odd else t for k, t in enumerate(texts))
    words = [joined[a:b] for a, b in zip(start.tolist(), end.tolist())] if odd else None
    if odd:
        parts, rows, counts = [], [], []
        for k in range(len(texts)):
            if k in odd:
                own = odd[k]
                got = []
                for w in own:
                    c = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
                    got.append(mix(np.array([(mix(c.astype(np.uint64) + _BYTE[0]) * powers(len(c) + 1)[0][: len(c)]).sum(dtype=np.uint64) + np.uint64(len(c))]))[0])
                parts.append(np.array(got, np.uint64))
                rows.extend(own)
            else:
                parts.append(hashes[bounds[k] : bounds[k + 1]])
                rows.extend(words[bounds[k] : bounds[k + 1]])
            counts.append(len(parts[-1]))
        return np.concatenate(parts), rows.__getitem__, np.concatenate([[0], np.cumsum(counts)])
    return hashes, lambda i: joined[start[i] : end[i]], bounds


def _vocabulary(texts: list[str], pattern: str):
    """Numbers of the pre-tokens by text, and the distinct words, most frequent first."""
    parts, firsts, spans = [], [], []
    known: dict[int, str] = {}
    for hashes, word, bounds in pretokens(texts, pattern):
        distinct, first = np.unique(hashes, return_index=True)
        for h, i in zip(distinct.tolist(), first.tolist()):
            if h not in known:
                known[h] = word(i)
        parts.append(hashes)
        spans.append(np.diff(bounds))
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    distinct, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[inverse], np.concatenate(spans) if spans else np.zeros(0, np.int64), [known[h] for h in distinct[order].tolist()], distinct[order]


def _varint(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2**28 in 7-bit groups, and the number of bytes each takes."""
    size = 1 + (x >= 1 << 7).astype(np.int64) + (x >= 1 << 14) + (x >= 1 << 21)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    begin = end - size
    for k in range(4):
        has = size > k
        out[begin[has] + k] = ((x[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def _unvarint(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(4):
        has = begins + k <= ends
        out[has] |= (raw[begins[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _chunk(ids: list, texts: list[str]) -> int:
    """A name for a task's batch of documents that a second run over the same batch finds again."""
    h = hashlib.blake2b(digest_size=8)
    for i, t in zip(ids, texts):
        h.update(f"{i}:{len(t)};".encode())
        h.update(t.encode("utf-8", "surrogatepass"))
    return int.from_bytes(h.digest(), "little", signed=True)


def _batches(batches):
    """(name, ids, texts) of runs of documents with about BATCH characters; a longer one stands alone."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        lo = 0
        while lo < len(ids):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(ids) and size + len(texts[hi]) <= BATCH:
                size += len(texts[hi])
                hi += 1
            yield _chunk(ids[lo:hi], texts[lo:hi]), ids[lo:hi], texts[lo:hi]
            lo = hi


def encode(docs: DataFrame, path: str, pattern: str, settled: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_text, decoded): ids as an array, as decimals joined by a space, and decoded again.

    settled: docs are rows of files, which every reading finds in the same batches; others are written first."""
    return _encoded(docs, path, pattern, True, "doc_id long, n_tokens long, ids array<int>, ids_text string, decoded binary", settled)


def encode_digests(docs: DataFrame, path: str, pattern: str, settled: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); settled as in encode."""
    return _encoded(docs, path, pattern, False, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", settled)


@lru_cache(maxsize=4)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, where each id's begin, and how many there are (0: no such id)."""
    table_ = encoder(path, WHOLE)[1]
    size = np.array([len(b) for b in table_], np.int64)
    return np.frombuffer(b"".join(table_), np.uint8), np.cumsum(size) - size, size


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of tokens (doc_id, ids): ids joined with the token-byte table, in order.

    Null ids give null bytes; an id that the table doesn't have is a ValueError."""

    def run(batches):
        flat, first, size = byte_table(path)
        for batch in batches:
            out = []
            for ids in batch.column(1):
                ids = None if not ids.is_valid else ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
                if ids is not None and len(ids) and (ids.min() < 0 or ids.max() >= len(size) or not size[ids].all()):
                    raise ValueError("ids that the token-byte table doesn't have")
                out.append(None if ids is None else b"".join(_spelled(flat, first, size, ids[lo : lo + CHARS]) for lo in range(0, len(ids), CHARS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def _spelled(flat: np.ndarray, first: np.ndarray, size: np.ndarray, ids: np.ndarray) -> bytes:
    sizes = size[ids]
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1])) + np.repeat(first[ids] - (ends - sizes), sizes)].tobytes()


def _encoded(docs: DataFrame, path: str, pattern: str, whole: bool, schema: str, settled: bool) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not settled:
        docs = materialize(docs, "texts")
    buckets = 2 * partitions(docs.sparkSession)

    def asked(batches):
        """Words of each batch by bucket: their numbers in the batch, and the words."""
        for chunk, _, texts in _batches(batches):
            _, _, words, hashes = _vocabulary(texts, pattern)
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            rows = []
            for idx in np.split(order, cut) if len(order) else []:
                step, _ = _varint(np.diff(idx, prepend=0))
                rows.append((int(bucket[idx[0]]), chunk, step.tobytes(), [words[i].encode("utf-8", "surrogatepass") for i in idx.tolist()]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([_lengths(r[3]) for r in rows], pa.binary()), pa.array([b"".join(r[3]) for r in rows], pa.binary())],
                ["bucket", "chunk", "numbers", "lengths", "words"],
            )

    def encoded(batches):
        """Of each bucket, every distinct word once; answers by batch."""
        enc, bytes_ = encoder(path, WHOLE)
        raw, size = _varint(np.arange(len(bytes_)))
        ends = np.cumsum(size).tolist()
        raw = raw.tobytes()
        spelled = [raw[a:b] for a, b in zip([0, *ends], ends)]
        known: dict[int, dict[bytes, tuple[int, bytes]]] = {}
        for batch in batches:
            cols = [batch.column(i) for i in range(5)]
            counts, ids = [], []
            for k in range(batch.num_rows):
                cache = known.setdefault(cols[0][k].as_py(), {})
                lengths = _unvarint(np.frombuffer(cols[3][k].as_py(), np.uint8)).tolist()
                words, at, got = cols[4][k].as_py(), 0, []
                for n in lengths:
                    word = words[at : at + n]
                    at += n
                    if (x := cache.get(word)) is None:
                        own = enc.encode_ordinary(word.decode())
                        x = cache[word] = (len(own), b"".join([spelled[i] for i in own]))
                    got.append(x)
                counts.append(_varint(np.array([x[0] for x in got], np.int64))[0].tobytes())
                ids.append(b"".join([x[1] for x in got]))
            yield pa.RecordBatch.from_arrays([cols[1], cols[2], pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], ["chunk", "numbers", "counts", "ids"])

    def numbered(batches):
        """Documents as the numbers of their words."""
        for chunk, ids, texts in _batches(batches):
            numbers, spans, _, _ = _vocabulary(texts, pattern)
            raw, size = _varint(numbers)
            ends = np.concatenate([[0], np.cumsum(size)])
            at = ends[np.concatenate([[0], np.cumsum(spans)])].tolist()
            raw = raw.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary())], ["d_chunk", "doc_id", "words"])

    def joined(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Ids joined back by number, documents put together by position."""
        _, bytes_ = encoder(path, WHOLE)
        size = 1 + max((int(_unvarint(np.frombuffer(r, np.uint8)).sum()) for r in right["numbers"].to_pylist()), default=-1)
        text, plain, count = [b""] * size, [b""] * size, np.zeros(size, np.int64)
        lists = [None] * size
        for numbers, counts, ids in zip(*(right[c].to_pylist() for c in ("numbers", "counts", "ids"))):
            at = np.cumsum(_unvarint(np.frombuffer(numbers, np.uint8)))
            n = _unvarint(np.frombuffer(counts, np.uint8))
            ids = _unvarint(np.frombuffer(ids, np.uint8)).tolist()
            count[at] = n
            i = 0
            for a, k in zip(at.tolist(), n.tolist()):
                own = ids[i : i + k]
                i += k
                if whole:
                    lists[a] = own
                text[a] = str(own[0]).encode() if k == 1 else b" ".join([str(x).encode() for x in own])
                plain[a] = bytes_[own[0]] if k == 1 else b"".join([bytes_[x] for x in own])
        out = []
        for raw in left["words"].to_pylist():
            numbers = _unvarint(np.frombuffer(raw, np.uint8))
            if len(numbers) and (numbers.max() >= size or not count[numbers].all()):
                raise RuntimeError("a batch of documents was not the same on its second reading")
            n = int(count[numbers].sum()) if len(numbers) else 0
            numbers = numbers.tolist()
            ids_text, decoded = b" ".join([text[i] for i in numbers]), b"".join([plain[i] for i in numbers])
            if whole:
                out.append((n, [x for i in numbers for x in lists[i]], ids_text.decode(), decoded))
            else:
                out.append((n, hashlib.sha256(ids_text).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.string(), pa.binary()) if whole else (pa.int64(), pa.string(), pa.string())
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.table([left["doc_id"], *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], names=names)

    n = partitions(docs.sparkSession)
    answers = docs.mapInArrow(asked, "bucket int, chunk long, numbers binary, lengths binary, words binary").repartition(n, "bucket").mapInArrow(encoded, "chunk long, numbers binary, counts binary, ids binary")
    documents = docs.mapInArrow(numbered, "d_chunk long, doc_id long, words binary")
    return documents.groupBy("d_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(joined, schema)


def _lengths(words: list[bytes]) -> bytes:
    return _varint(np.array([len(w) for w in words], np.int64))[0].tobytes()


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, settled=True)
