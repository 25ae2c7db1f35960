"""Substring dedup: remove words covered by a run of WIDTH words that also starts in an earlier document.

Anchors are runs of 7 words, hashed only where the position modulo 7 is in the difference cover {0, 1, 3}: for any two
positions i and j some shift d < 7 puts both i + d and j + d on the cover, so equal runs of 13 = 7 + 7 - 1 words share
an anchor at the same place within. Anchors found in two documents are extended to the runs of 13 words around them,
whose hashes decide: the smallest doc_id of each run keeps it, others lose it.

Rows go to the shuffle packed by bucket of their hash, after each task has merged what it can: of each hash only the
smallest document of the task, the others being known to repeat. So a run in a third of all documents comes to one
document a task. A fixed-size filter of doc_ids keeps texts that can't be concerned out of the later shuffles.

Edge cases: a null text has no words; documents under WIDTH words lose nothing and take nothing; rows that repeat a
doc_id are each other's equals, neither earlier, so a run repeated only there or within one document stays; a null
doc_id has no place in the order: such rows lose nothing and nothing is lost to them; an empty table gives no rows; other
columns don't matter. Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import Words, free_name, materialize, mix, only, partitions, slices, table, text_buffers, windows

WIDTH = 13
PERIOD = 7
COVER = np.array([True, True, False, True, False, False, False])
ANCHOR = WIDTH - PERIOD + 1
GROUP = 1 << 19

PACKED = "bucket int, d_bucket int, h binary, doc binary, pos binary"
PACKED_NAMES = ["bucket", "d_bucket", "h", "doc", "pos"]


def _documents(batch: pa.RecordBatch, text: int):
    """Row number, word hashes of each document of a batch."""
    data, offsets = text_buffers(batch.column(text))
    for lo, hi in slices(offsets):
        words = Words(data, offsets, lo, hi, lower=False)
        hashes = words.hashes()
        for r in range(hi - lo):
            yield lo + r, hashes[words.bounds[r] : words.bounds[r + 1]]


def _pack(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int, locals_: list):
    """Of occurrences: those of each hash's smallest document, packed by bucket; the rest are repeats.

    locals_ gets (doc, positions) of occurrences that another document of this task shows to be shared."""
    order = np.lexsort((pos, doc, h))
    h, doc, pos = h[order], doc[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    head = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    first_doc = doc[head][run]
    shared = np.zeros(len(head), bool)
    shared[run[doc != first_doc]] = True
    locals_.append((h, doc, pos, first_doc, shared[run]))
    keep = doc == first_doc
    h, doc, pos = h[keep], doc[keep], pos[keep]
    flag = shared[run][keep]
    bucket = (h >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((pos, doc, bucket))
    h, doc, pos, bucket, flag = h[order], doc[order], pos[order], bucket[order], flag[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for idx in np.split(np.arange(len(h)), cut) if len(h) else []:
        base = doc[idx[0]]
        # differences of sorted documents are small and compress; the lowest bit of a place says "already known as shared"
        step = np.diff(doc[idx], prepend=base)
        yield int(bucket[idx[0]]), h[idx].tobytes(), np.int64(base).tobytes() + step.astype(np.int64).tobytes(), ((pos[idx] << 1) | flag[idx]).astype(np.uint64).tobytes()


def _unpack(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
    doc = np.concatenate([np.cumsum(np.frombuffer(r[1], np.int64)[1:]) + np.frombuffer(r[1], np.int64)[0] for r in rows])
    raw = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
    return h, doc, (raw >> np.uint64(1)).astype(np.int64), (raw & np.uint64(1)).astype(bool)


def _by_document(doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """doc_id and its sorted distinct positions, a row for each document."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    doc, pos = doc[fresh], pos[fresh]
    cut = np.flatnonzero(np.diff(doc)) + 1
    parts = np.split(pos.astype(np.uint64), cut) if len(doc) else []
    ids = doc[np.concatenate([[0], cut])] if len(doc) else doc
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "starts"])


def _to_documents(doc: np.ndarray, pos: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places packed by bucket of their document."""
    bucket = (mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((pos, doc, bucket))
    doc, pos, bucket = doc[order], pos[order].astype(np.int64), bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    idx = np.split(np.arange(len(doc)), cut) if len(doc) else []
    k = len(idx)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(k, pa.int32()), pa.array([int(bucket[i[0]]) for i in idx], pa.int32()), pa.nulls(k, pa.binary()), pa.array([np.diff(doc[i], prepend=0).tobytes() for i in idx], pa.binary()), pa.array([pos[i].tobytes() for i in idx], pa.binary())],
        PACKED_NAMES,
    )


def _packed_batch(rows: list) -> pa.RecordBatch:
    k = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.nulls(k, pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], PACKED_NAMES)


def _shared(rows: DataFrame, occurrences, all_documents: bool) -> DataFrame:
    """(doc_id, starts): places whose hash another document shows as well.

    occurrences(batch) gives (doc_id, positions, hashes) for each document of a batch of `rows`. With all_documents
    every occurrence of a shared hash is returned, else only those outside the hash's smallest document."""
    # one bucket to a partition: the number of packed rows is that of a shuffle's blocks
    buckets = partitions(rows.sparkSession)

    def emit(got: list):
        h, doc, pos = (np.concatenate([g[i] for g in got]) for i in (2, 0, 1))
        locals_: list = []
        packed = list(_pack(h, doc, pos, buckets, locals_))
        h, doc, pos, first, shared = locals_[0]
        mine = shared if all_documents else shared & (doc != first)
        yield _packed_batch(packed)
        yield _to_documents(doc[mine], pos[mine], buckets)

    def spread(batches):
        got, n = [], 0
        for batch in batches:
            for doc, pos, h in occurrences(batch):
                if not len(h):
                    continue
                got.append((np.full(len(h), doc, np.int64), pos, h))
                n += len(h)
                if n >= GROUP:
                    yield from emit(got)
                    got, n = [], 0
        if got:
            yield from emit(got)

    def meet(batches):
        held: dict[int, list] = {}
        for batch in batches:
            bucket = batch.column(0).to_pylist()
            cols = [batch.column(i) for i in (2, 3, 4)]
            passed = [k for k, b in enumerate(bucket) if b is None]
            if passed:
                yield batch.take(pa.array(passed, pa.int64()))
            for k, b in enumerate(bucket):
                if b is not None:
                    held.setdefault(b, []).append(tuple(c[k].as_py() for c in cols))
        for b in list(held):
            h, doc, pos, known = _unpack(held.pop(b))
            order = np.lexsort((pos, doc, h))
            h, doc, pos, known = h[order], doc[order], pos[order], known[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            head = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            first = doc[head][run]
            shared = np.zeros(len(head), bool)
            shared[run[(doc != first) | known]] = True
            mine = shared[run] if all_documents else doc != first
            yield _to_documents(doc[mine], pos[mine], buckets)

    def gather(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, doc, pos in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4))):
                held.setdefault(b, []).append((doc, pos))
        for b in list(held):
            got = held.pop(b)
            yield _by_document(np.concatenate([np.cumsum(np.frombuffer(d, np.int64)) for d, _ in got]), np.concatenate([np.frombuffer(p, np.int64) for _, p in got]))

    # what is known at once goes along, the rest meets by bucket of its hash; then all goes by bucket of its document
    met = rows.mapInArrow(spread, PACKED).repartitionById(buckets, F.coalesce("bucket", "d_bucket")).mapInArrow(meet, PACKED)
    return met.repartitionById(buckets, "d_bucket").mapInArrow(gather, "doc_id long, starts binary")


def _anchors(batch: pa.RecordBatch):
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for r, hashes in _documents(batch, 1):
        if len(hashes) >= WIDTH:
            at = np.flatnonzero(COVER[np.arange(len(hashes) - ANCHOR + 1) % PERIOD])
            yield ids[r], at, windows(hashes, ANCHOR)[at]


def _runs(batch: pa.RecordBatch):
    """Windows of WIDTH words that hold a shared anchor."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    tags, starts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    for r, hashes in _documents(batch, 1):
        n = len(hashes) - WIDTH + 1
        if n <= 0:
            continue
        touched = np.zeros(n + PERIOD, np.int64)
        anchors = np.frombuffer(starts[r], np.uint64).astype(np.int64)
        anchors = anchors[anchors < len(hashes)]
        np.add.at(touched, np.clip(anchors - (PERIOD - 1), 0, n), 1)
        np.add.at(touched, np.clip(anchors + 1, 0, n), -1)
        at = np.flatnonzero(np.cumsum(touched)[:n] > 0)
        yield ids[r], at | (int(tags[r]) << 32), windows(hashes, WIDTH)[at]


def _summaries(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and SHA-256 of the words joined, for each row."""

    def run(batches):
        for batch in batches:
            words = [_split(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(map(_sha, words), pa.string())], ["doc_id", "n_words", "sha"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, sha string")


def _split(text: str | None) -> list[bytes]:
    """Words as bytes; bytes.split() cuts at space and the controls 9 to 13, as asked."""
    return (text or "").encode().split()


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _removed(n: int, tag: int, starts: bytes | None) -> np.ndarray:
    """Which of n words are covered by the windows of this text."""
    gone = np.zeros(n + WIDTH + 1, np.int32)
    at = np.frombuffer(starts or b"", np.uint64)
    at = (at[at >> np.uint64(32) == np.uint64(tag)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[at + WIDTH <= n]
    gone[at] += 1
    gone[at + WIDTH] -= 1
    return np.cumsum(gone)[:n] > 0


def find_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, starts): for each document with windows to remove, where they start, marked with the text they are of.

    docs: doc_id, text and tag, as _tagged gives them."""
    docs = docs.filter("doc_id is not null")
    anchors = materialize(_shared(docs.select("doc_id", "text", "tag"), _anchors, all_documents=True), "anchors")
    touched = only(docs, anchors).join(anchors, "doc_id").select("doc_id", "text", "tag", "starts")
    return materialize(_shared(touched, _runs, all_documents=False), "windows")


def _tagged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    text_ = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_.alias("text"), F.shiftrightunsigned(F.xxhash64(text_), 40).alias("tag"))


def count_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row of docs (doc_id, text)."""
    docs = _tagged(docs)
    found = find_repeats(docs)

    def cut(batches):
        for batch in batches:
            out = []
            for text, tag, starts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                words = _split(text)
                gone = _removed(len(words), tag, starts)
                out.append((len(words), int(gone.sum()), _sha([w for w, g in zip(words, gone.tolist()) if not g])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    less = only(docs, found).join(found, "doc_id").select("doc_id", "text", "tag", "starts").mapInArrow(cut, schema)
    rest = _summaries(docs).join(found.select("doc_id"), "doc_id", "left_anti")
    return less.unionByName(rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs without the repeated words: what is left of a text is joined by one space, other texts stay as they are.

    Documents all of whose words are repeated go; texts without words stay. n_chars, if there is such a column, follows the text."""
    found = find_repeats(_tagged(docs))
    columns = docs.columns
    tag, id_, places = (free_name(columns, c) for c in ("tag", "id", "starts"))

    def cut(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            tags, starts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (tag, places))
            texts, keep = batch.column(at).to_pylist(), []
            for k, s in enumerate(starts):
                words = _split(texts[k]) if s else []
                gone = _removed(len(words), tags[k], s)
                if gone.any():
                    texts[k] = b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()
                if not len(gone) or not gone.all():
                    keep.append(k)
            batch = batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns([tag, places])
            yield batch.take(pa.array(keep, pa.int64()))

    keyed = docs.withColumn(tag, F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 40))
    starts = found.select(F.col("doc_id").alias(id_), F.col("starts").alias(places))
    less = only(keyed, found).join(starts, F.col("doc_id") == F.col(id_), "left").drop(id_).mapInArrow(cut, docs.schema)
    out = less.unionByName(only(docs, found, hit=False))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_repeats(table(spark, sf_dir, "documents"))


#: The same by plain counting of all windows.
ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, s, md5(array_to_string(w[s : s + 12], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 11)) as s from d where len(w) >= 13)),
dup as (select doc_id, s from (select *, min(doc_id) over (partition by h) as first from win) where first < doc_id),
gone as (select distinct doc_id, unnest(range(s, s + 13)) as i from dup),
k as (
  select d.doc_id, list(x.word order by x.i) filter (where g.i is null) as kept, count(g.i) as n_removed
  from d join (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d) x on d.doc_id = x.doc_id
  left join gone g on g.doc_id = x.doc_id and g.i = x.i group by all)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(array_to_string(k.kept, ' '), '')) as kept_sha256
from d left join k using (doc_id)
"""
