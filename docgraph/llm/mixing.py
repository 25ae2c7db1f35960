"""Mixing sources to target weights.

Each source's words form one stream, packed into blocks of a fixed number of words. Every output shard draws
multinomial counts of its slots by source, in proportion to what each source still has to give, so that the last shard's
draw leaves each source at its target. A slot's running number within its source goes through a pseudorandom
permutation of that source's blocks (a new one for each pass over the source), and blocks join by their index.
A source's last pass stops within a block, so that it gives its target to the word. What the draws decide is which
shard holds which words: mix_documents(by_shard=True) gives the shards, mix_counts each document's first one. A shard has
SHARD_SLOTS slots, and more of them where there would be more than MOST_SHARDS shards, as one task draws for all.

Edge cases: a null text has no words; documents without words take part in nothing and have taken 0; a null source
is a source of its own, last in order; rows that repeat a doc_id each count, and rows equal in doc_id, text and source
are told apart by their number; without any words all targets are 0; an empty table gives no rows. Other columns than
doc_id, text and source don't matter, whatever they are called; a text of any length is cut into as many blocks as it has.
One row for each source comes to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.llm.common import WORD, free_name, materialize, partitions, table, word_count

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
MOST_SHARDS = 100_000
ROWS_A_BUCKET = 2_000
SEED = 17


def targets(sizes: list[int], weights: list[float], repeats: float = REPEATS) -> list[float]:
    """Shares of all words by weight; none above `repeats` times its size, what is over going to the others by weight."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if rest * weights[i] / total > repeats * sizes[i]]
        for i in over or sorted(open_):
            out[i] = float(repeats * sizes[i]) if over else rest * weights[i] / total
        if not over:
            break
        rest -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def _round(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(n: int, key: int, index: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at `index`: four Feistel rounds on a square, walking back into range."""
    half = np.uint64(max(1, math.ceil(math.log2(max(n, 2)) / 2)))
    low = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64((key * 0x2545F4914F6CDD1D + k * 0x632BE59BD9B4E019) % 2**64) for k in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & low
        for k in reversed(keys) if inverse else keys:
            if inverse:
                a, b = b ^ (_round(a, k) & low), a
            else:
                a, b = b, a ^ (_round(b, k) & low)
        return (a << half) | b

    x = once(np.asarray(index, np.uint64))
    while (far := x >= n).any():
        x[far] = once(x[far])
    return x.astype(np.int64)


def _plan(rows: list, block: int, weights: tuple, repeats: int, seed: int) -> list[tuple]:
    """One line for each source: number, name, size, target, blocks, whole passes, words of the last pass, slots."""
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"] or 0) for r in rows]
    out = []
    for k, (row, size, target) in enumerate(zip(rows, sizes, targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], repeats))):
        blocks, words = -(-size // block), min(round(target), repeats * size)
        full, rest = divmod(words, size) if size else (0, 0)
        slots = full * blocks
        if rest:
            short = block - (size - (blocks - 1) * block)
            tail = int(permute(blocks, _key(seed, k, full), np.array([blocks - 1]), inverse=True)[0])
            slots += -(-rest // block) if tail >= -(-rest // block) else -(-(rest + short) // block)
        out.append((k, row["source"], size, target, blocks, full, rest, slots))
    return out


def _key(seed: int, source: int, epoch: int) -> int:
    return (seed * 1_000_003 + source) * 1_000_003 + epoch


def draws(quota: np.ndarray, each: int, seed: int):
    """For each shard of `each` slots (the last may have less) how many are each source's: multinomial counts by what is
    left of the quotas; what a draw has beyond a source's rest is drawn again among the others."""
    left, shard = quota.astype(np.int64).copy(), 0
    while (total := int(left.sum())) > 0:
        rng, want, got = np.random.default_rng((seed, shard)), min(each, total), np.zeros(len(left), np.int64)
        while want:
            rest = left - got
            drawn = np.minimum(rng.multinomial(want, rest / rest.sum()), rest)
            got += drawn
            want -= int(drawn.sum())
        left -= got
        yield shard, got
        shard += 1


def _slots(spark: SparkSession, plan: list[tuple], block: int, seed: int) -> DataFrame:
    """(shard, six, block, epoch, words): the blocks that the mix takes, each slot dealt to a shard."""
    total = sum(p[-1] for p in plan)
    each = max(SHARD_SLOTS, -(-total // MOST_SHARDS))
    quota = np.array([p[-1] for p in plan], np.int64)
    sixes = np.array([p[0] for p in plan], np.int32)

    def draw(batches):
        for _ in batches:
            hi, out = np.zeros(len(quota), np.int64), []
            for shard, got in draws(quota, each, seed):
                at = np.flatnonzero(got)
                out.append(pd.DataFrame({"shard": shard, "six": sixes[at], "lo": hi[at], "hi": hi[at] + got[at]}))
                hi += got
                if len(out) == 1000:
                    yield pd.concat(out)
                    out = []
            if out:
                yield pd.concat(out)

    # one task draws, as each shard depends on those before: a few numbers for each of at most MOST_SHARDS shards
    drawn = spark.range(0, 1, 1, 1).mapInPandas(draw, "shard long, six int, lo long, hi long").repartition(partitions(spark), "shard", "six")
    lines = {p[0]: p for p in plan}

    def fill(batches):
        for pdf in batches:
            for shard, six, lo, hi in zip(pdf["shard"], pdf["six"], pdf["lo"], pdf["hi"]):
                _, _, size, _, blocks, full, rest, _ = lines[six]
                i = np.arange(lo, hi)
                epoch, index = i // blocks, i % blocks
                at, words = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
                last = size - (blocks - 1) * block
                for e in np.unique(epoch):
                    mine = epoch == e
                    at[mine] = permute(blocks, _key(seed, int(six), int(e)), index[mine])
                    length = np.where(at[mine] == blocks - 1, last, block)
                    if e == full:
                        tail = int(permute(blocks, _key(seed, int(six), int(e)), np.array([blocks - 1]), inverse=True)[0])
                        before = index[mine] * block - (block - last) * (tail < index[mine])
                        length = np.clip(rest - before, 0, length)
                    words[mine] = length
                yield pd.DataFrame({"shard": shard, "six": np.int32(six), "block": at, "epoch": epoch.astype("int32"), "words": words})

    return drawn.mapInPandas(fill, "shard long, six int, block long, epoch int, words long")


def _placed(docs: DataFrame, doc_id: str, text: str, source: str, block: int, weights: tuple, repeats: int, seed: int) -> tuple[DataFrame, list, list[Column]]:
    """Documents with their place in their source's stream, and the plan."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("text_hash"))
    stats = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()  # a row for each source
    plan = _plan(stats, block, weights, repeats, seed)
    buckets = 1 + sum(r["docs"] for r in stats) // ROWS_A_BUCKET
    sources = spark.createDataFrame(
        [(p[0], p[1], p[2], p[3]) for p in plan], "six int, source string, source_size long, target double"
    )
    base = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    order = W.partitionBy("source", "bucket").orderBy("doc_id", "size", "text_hash")
    local = base.withColumn("rn", F.row_number().over(order)).withColumn("start", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    # of rows equal in doc_id, text and source the first, second, ...
    equal = W.partitionBy("source", "bucket", "doc_id", "size", "text_hash")
    local = local.withColumn("copy", F.col("rn") - F.min("rn").over(equal)).withColumn("copies", F.count("*").over(equal))
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    offsets = base.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("offset", F.sum("n").over(run) - F.col("n"))
    offsets = offsets.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "offset")
    placed = local.join(offsets, local["source"].eqNullSafe(offsets["o_source"]) & (local["bucket"] == offsets["o_bucket"])).withColumn("start", F.col("start") + F.col("offset"))
    # one row for each source, whose number the plan already holds on the driver
    placed = placed.join(F.broadcast(sources.withColumnRenamed("source", "s_source")), F.col("source").eqNullSafe(F.col("s_source")))
    return placed.drop("o_source", "o_bucket", "offset", "s_source"), plan, [F.col(c) for c in ("six", "bucket", "rn", "doc_id", "text_hash", "size", "source_size", "target")]


def _taken(placed: DataFrame, plan: list, block: int, seed: int) -> DataFrame:
    """A row for each document, pass and block that the mix takes words from: word_lo..word_hi of the document."""
    slots = _slots(placed.sparkSession, plan, block, seed)
    first, last = F.col("start"), F.col("start") + F.col("size") - 1
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(first / block), F.floor(last / block)))
    pieces = placed.withColumn("block", F.explode_outer(blocks))
    # slots grow with the corpus, though Spark takes what comes of one drawing task for small: never broadcast
    joined = pieces.join(slots.hint("merge"), ["six", "block"], "left")
    lo = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    hi = F.when(F.col("words").isNotNull(), F.least(F.col("size"), F.col("block") * block + F.col("words") - F.col("start"))).otherwise(lo)
    return joined.withColumn("word_lo", lo).withColumn("word_hi", F.greatest(lo, hi))


def mix_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK_WORDS, weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (how many of its words, repeats counted, the mix takes) and first_shard."""
    placed, plan, key = _placed(docs, doc_id, text, source, block, weights, repeats, seed)
    taken = _taken(placed, plan, block, seed)
    return (
        taken.groupBy(*key)
        .agg(F.coalesce(F.sum(F.col("word_hi") - F.col("word_lo")), F.lit(0)).alias("taken"), F.min(F.when(F.col("word_hi") > F.col("word_lo"), F.col("shard"))).alias("first_shard"))
        .select("doc_id", "size", "source_size", "target", "taken", "first_shard")
    )


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK_WORDS, weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, by_shard: bool = False) -> DataFrame:
    """The mix itself: documents, once for each pass that takes words of them, text holding the words taken.

    by_shard: once for each pass and shard instead, with the shard's number in a further column `shard`, which takes the
    place of one so called. A document taken whole keeps its text as it is; else its words are joined by one space.
    n_chars, if there is such a column, follows the text."""
    placed, plan, _ = _placed(docs, doc_id, text, source, block, weights, repeats, seed)
    columns = [c for c in docs.columns if not (by_shard and c == "shard")]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    names = ("k", "h", "s", "e", "copy", "copies", "n", "whole", "parts", "words", "shard", "size")
    own = {c: free_name(columns, f"mix_{c}") for c in names}
    by = ["doc_id", "text_hash", "source", "copy", "copies", "size", "epoch", *(["shard"] if by_shard else [])]
    none = F.lit(-(2**63))
    taken = _taken(placed, plan, block, seed).filter("word_hi > word_lo").groupBy("bucket", *by).agg(F.sort_array(F.collect_list(F.struct("word_lo", "word_hi"))).alias("parts"))
    taken = taken.select(
        F.coalesce(F.col("doc_id").cast("long"), none).alias(own["k"]), F.col("text_hash").alias(own["h"]), F.coalesce("source", F.lit("")).alias(own["s"]), F.col("source").isNull().alias(own["e"]),
        (F.col("copy") + 1).alias(own["copy"]), F.col("copies").alias(own["copies"]), F.col("size").alias(own["size"]), F.col("parts").alias(own["parts"]), *([F.col("shard").alias(own["shard"])] if by_shard else []),
    )
    keys = [own[c] for c in ("k", "h", "s", "e")]
    rows = docs.withColumns({own["k"]: F.coalesce(F.col(doc_id).cast("long"), none), own["h"]: F.xxhash64(F.col(text)), own["s"]: F.coalesce(F.col(source).cast("string"), F.lit("")), own["e"]: F.col(source).isNull()})
    # rows that no other equals in id, text and source, and the others, which are told apart by their number
    taken = materialize(taken, "taken")
    joined = rows.join(taken.filter(F.col(own["copies"]) == 1).drop(own["copies"], own["copy"]), keys)
    several = taken.filter(F.col(own["copies"]) > 1).drop(own["copies"]).withColumnRenamed(own["copy"], own["n"])
    if not several.isEmpty():
        plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        alike = rows.join(several.select(*keys).distinct(), keys, "left_semi")
        alike = alike.withColumn(own["n"], F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64(*plain))))
        joined = joined.unionByName(alike.join(several, [*keys, own["n"]]).drop(own["n"]))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    parts = F.flatten(F.transform(own["parts"], lambda p: F.slice(F.col(own["words"]), p["word_lo"] + 1, p["word_hi"] - p["word_lo"])))
    whole = F.aggregate(own["parts"], F.lit(0).cast("long"), lambda a, p: a + p["word_hi"] - p["word_lo"]) == F.col(own["size"])
    joined = joined.withColumn(own["whole"], whole).withColumn(own["words"], F.when(~F.col(own["whole"]), words)).withColumn(text, F.when(F.col(own["whole"]), F.col(text)).otherwise(F.array_join(parts, " ")))
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[F.col(f"`{c}`") for c in columns], *([F.col(own["shard"]).alias("shard")] if by_shard else []))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))
