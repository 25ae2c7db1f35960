"""Helpers that the operators of this subpackage share: a shared folder for cut points, and words as arrays."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SUBBATCH = 1 << 20
#: Filters of ids: bytes of a block, bits set for each id, room for each id, and bytes of all blocks at most.
FILTER_BLOCK = 1 << 16
FILTER_PROBES = 3
FILTER_BITS_AN_ID = 12
FILTER_BYTES = 32 << 20


#: From this size on, memory goes back to the system as soon as it is free; Python's workers outlive their tasks.
RETURNED = 1 << 20


def _return_memory() -> None:
    """Ask the C library to map blocks of RETURNED bytes apart and to give back its heap's end; Arrow to use it as well."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, RETURNED)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, RETURNED)  # M_TRIM_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())


_return_memory()


#: Rows of a batch that goes to Python, at most: texts are long, and a batch is held by Spark and by Python.
BATCH_ROWS = 2_000


def bounded(spark: SparkSession) -> None:
    """Let this session's batches for Python have BATCH_ROWS rows at most; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one for a local master."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"cut-{spark.sparkContext.applicationId}")
    os.makedirs(made, exist_ok=True)
    return f"file://{made}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: its lineage ends there, whoever dies later."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class IdFilter:
    """A set of 64-bit hashes told by bits: it may let others pass (1 % at FILTER_BITS_AN_ID), it never loses one.

    It grows with the ids up to FILTER_BYTES; beyond some 20 million ids more others pass, which costs their shuffle only."""

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.data = np.zeros(blocks * FILTER_BLOCK, np.uint8)

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        h = h.astype(np.uint64)
        base = (h >> np.uint64(33)) % np.uint64(self.blocks) * np.uint64(8 * FILTER_BLOCK)
        bits = mix(h)
        return [base + ((bits >> np.uint64(19 * k)) & np.uint64(8 * FILTER_BLOCK - 1)) for k in range(FILTER_PROBES)]

    def add(self, h: np.ndarray) -> None:
        for at in self._places(h):
            np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self._places(h):
            out &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def id_filter(ids: DataFrame, key: Column) -> IdFilter:
    """The filter of the hashes `key` of the rows of ids, whose blocks are filled by the executors."""
    blocks = int(min(FILTER_BYTES // FILTER_BLOCK, 1 + ids.count() * FILTER_BITS_AN_ID // (8 * FILTER_BLOCK)))
    whole = IdFilter(blocks)

    def fill(batches):
        held: dict[int, IdFilter] = {}
        for batch in batches:
            block, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint64)
            for b in np.unique(block).tolist():
                if b not in held:
                    held[b] = IdFilter(1)
                held[b].add(h[block == b])
        for b, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([own.data.tobytes()], pa.binary())], ["block", "bits"])

    rows = ids.select(key.alias("h")).filter("h is not null").select(F.pmod(F.shiftrightunsigned("h", 33), F.lit(blocks)).cast("int").alias("block"), "h")
    for row in rows.repartition(min(blocks, 16), "block").mapInArrow(fill, "block int, bits binary").collect():  # FILTER_BYTES at most
        whole.data[row["block"] * FILTER_BLOCK : (row["block"] + 1) * FILTER_BLOCK] |= np.frombuffer(row["bits"], np.uint8)
    return whole


def free_name(columns: list[str], name: str) -> str:
    """`name`, or with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def only(docs: DataFrame, ids: DataFrame, hit: bool = True, also: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """docs whose doc_id may be in ids, which spares the shuffle the others; or, without hit, just the others.

    also: turns batches of these into ones of `schema`, in the same worker of Python."""
    held = docs.sparkSession.sparkContext.broadcast(id_filter(ids, F.xxhash64("doc_id")))
    key = free_name(docs.columns, "key")

    def run(batches):
        for batch in batches:
            found = held.value.has(batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False))
            batch = batch.take(pa.array(np.flatnonzero(found == hit))).drop_columns([key])
            yield also(batch) if also else batch

    return docs.withColumn(key, F.xxhash64("doc_id")).mapInArrow(run, schema or docs.schema)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SUBBATCH):
    """Ranges of rows whose bytes come to about `most`; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, _PI)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of the rows lo..hi of a batch: byte starts and ends in `data`, row of each word, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool):
        base = offsets[lo]
        self.data = data[base : offsets[hi]]
        at = offsets[lo : hi + 1] - base
        word = ~_SPACE[self.data]
        first, last = word.copy(), word.copy()
        if len(word):
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(word))]
            first[cut] = word[cut]
            last[cut - 1] = word[cut - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        # words of row r are bounds[r]..bounds[r + 1]
        self.bounds = np.searchsorted(self.starts, at)
        self.row = np.repeat(np.arange(hi - lo), np.diff(self.bounds))
        self.lower = lower

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        data = _LOWER[self.data] if self.lower else self.data
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


_MULT = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes, by where it starts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * _MULT[k]
    return mix(total)
