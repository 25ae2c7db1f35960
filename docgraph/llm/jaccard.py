"""N-gram Jaccard join: which texts share at least three quarters of their word shingles.

Texts with equal shingle sets form one class, named by a 64-bit digest of the set; everything after works on classes.
Shingles are ordered by a count sketch of their frequency over all documents, rarest first, so that two linked
sets share one of their first |set| - ceil(0.75 |set|) + 1 shingles (prefix filter). Inverted lists of these prefixes
with two classes or more give candidates in rounds. First each list's center (the class nearest to its front there) is
searched against the rest; what that links becomes components. Then, of lists that still hold several components, pairs
across components are searched, so that pairs already joined are never listed. Pairs must be able to reach the
overlap from where they first meet (position filter).

Each search takes one query set against a block of candidates: T-occurrence search by DivideSkip. Lists of the query's
shingles over the block are split into long ones and short ones; short ones are merged with a heap, and classes seen
there often enough to reach the overlap are probed in the long ones by bisection.

Edge cases: words are runs of other characters than ASCII white space, A-Z in lower case; a text with one to four words
is one shingle; without words (null, empty, blank) a text has no shingles and links with nothing, not even its like;
repeated doc_ids keep their rows; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import Words, free_name, id_filter, materialize, mix, only, partitions, slices, table, text_buffers, windows
from docgraph.llm.components import components

WIDTH = 5
PERCENT = 75
SKETCH_BITS = 20
CHUNK = 1 << 12
BLOCK = 256
#: More rounds of single searches, at most, while pairs across components are more than so many for each list entry.
ROUNDS = 4
MANY = 32


def sets_of(texts: pa.Array, width: int = WIDTH):
    """Sorted distinct shingle hashes of each text."""
    data, offsets = text_buffers(texts)
    for lo, hi in slices(offsets):
        words = Words(data, offsets, lo, hi, lower=True)
        hashes = words.hashes()
        full = windows(hashes, width)
        for r in range(hi - lo):
            a, b = words.bounds[r], words.bounds[r + 1]
            if b - a >= width:
                yield np.unique(full[a : b - width + 1])
            elif b > a:
                yield windows(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def digest(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set; 0 for the empty one."""
    if not len(shingles):
        return 0
    total = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total]))[0].astype(np.int64)) or 1


def need(n: int, m: int, percent: int) -> int:
    """Least overlap of sets of n and m elements that link."""
    return -(-percent * (n + m) // (100 + percent))


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document, and rows with each task's counts by bucket of the sketch."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            n, cls, low = [], [], [np.zeros(0, np.uint32)]
            for s in sets_of(batch.column(1), width):
                n.append(len(s))
                cls.append(digest(s))
                low.append((s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.uint32))
            counts += np.bincount(np.concatenate(low), minlength=len(counts)).astype(np.int32)
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                ["doc_id", "n", "cls", "chunk", "counts"],
            )
        at = [c for c in range((1 << SKETCH_BITS) // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
        k = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(at, pa.int32()), pa.array([counts[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in at], pa.binary())],
            ["doc_id", "n", "cls", "chunk", "counts"],
        )

    return docs.mapInArrow(run, "doc_id long, n long, cls long, chunk int, counts binary")


def _sketch(rows: DataFrame) -> np.ndarray:
    """The tasks' counts summed: 2 ** SKETCH_BITS numbers, however much they count."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(b, np.int32).astype(np.int64)
                sums[c] = sums[c] + got if c in sums else got
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.keys(), pa.int32()), pa.array([np.minimum(s, 2**31 - 1).astype(np.int32).tobytes() for s in sums.values()], pa.binary())], ["chunk", "counts"]
        )

    total = np.zeros(1 << SKETCH_BITS, np.int32)
    for row in rows.repartition(8, "chunk").mapInArrow(add, "chunk int, counts binary").collect():  # 4 MB in all
        total[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.int32)
    return total


def _lists(docs: DataFrame, width: int, percent: int, sketch) -> DataFrame:
    """(h, center, c_size, c_pos, cls, size, pos): inverted lists of prefix shingles that hold two classes or more.

    center is the class that has the shingle nearest to its front, so the one with the fewest rare shingles of its
    own: of a text and its edited copies that is the text."""

    def prefixes(batches):
        order, seen = sketch.value, set()
        for batch in batches:
            out = []
            for s in sets_of(batch.column(0), width):
                n, name = len(s), digest(s)
                if not n or name in seen:
                    continue
                seen.add(name)
                keep = n - -(-percent * n // 100) + 1
                rank = np.argsort(order[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)], kind="stable")[:keep]
                out.append((s[rank].astype(np.int64), name, n))
            k = [len(x[0]) for x in out]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in k])), pa.array(np.repeat([x[1] for x in out], k)), pa.array(np.repeat(np.array([x[2] for x in out], np.int32), k))],
                    ["h", "pos", "cls", "size"],
                )

    def runs(batches):
        """Of rows sorted by h, pos and cls: drop repeats and what stands alone, and add each list's first row."""
        held = np.zeros((0, 4), np.int64)  # the last row, not yet known to be alone
        centre, alone = held, True
        for batch in batches:
            rows = np.concatenate([held, np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])])
            if not len(rows):
                continue
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])
            rows = rows[fresh]
            new = np.ones(len(rows), bool)
            new[1:] = rows[1:, 0] != rows[:-1, 0]
            heads = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
            if len(held):  # the held row goes on with its own list
                first = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(rows)
                heads[:first] = centre
            single = new.copy()
            single[:-1] &= new[1:]
            if len(held) and not alone:
                single[0] = False
            ready = np.flatnonzero(~single[:-1])
            held, centre, alone = rows[-1:], heads[-1:], bool(single[-1])
            if len(ready):
                yield _record(rows[ready], heads[ready])
        if len(held) and not alone:
            yield _record(held, centre)

    n = partitions(docs.sparkSession)
    rows = docs.select("text").mapInArrow(prefixes, "h long, pos int, cls long, size int")
    return rows.repartition(n, "h").sortWithinPartitions("h", "pos", "cls").mapInArrow(runs, "h long, center long, c_size int, c_pos int, cls long, size int, pos int")


def _record(rows: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
    columns = [rows[:, 0], heads[:, 2], heads[:, 3].astype(np.int32), heads[:, 1].astype(np.int32), rows[:, 2], rows[:, 3].astype(np.int32), rows[:, 1].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "center", "c_size", "c_pos", "cls", "size", "pos"])


def t_occurrence(lists: list[list[int]], least: int) -> dict[int, int]:
    """Ids that stand in at least `least` of the sorted lists, with how many: DivideSkip.

    The longest lists, as many as pay off, are only probed; ids must reach the rest of `least` in the short ones."""
    if least <= 0 or len(lists) < least:
        return {}
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    probed = min(least - 1, int(least / (0.0085 * np.log2(longest + 1) + 1)))
    short, long_ = lists[: len(lists) - probed], lists[len(lists) - probed :]
    floor = least - len(long_)
    heap = [(x[0], k) for k, x in enumerate(short) if x]
    heapq.heapify(heap)
    at = [0] * len(short)
    found = {}
    while len(heap) >= floor:
        low, popped = heap[0][0], []
        while heap and heap[0][0] == low:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= floor:
            count = len(popped)
            for x in long_:
                i = bisect_left(x, low)
                count += i < len(x) and x[i] == low
            if count >= least:
                found[low] = count
            ahead = low + 1
        else:  # skip: ids below the floor-th smallest head cannot reach the floor
            while heap and len(popped) < floor - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            ahead = heap[0][0]
        for k in popped:
            i = bisect_left(short[k], ahead, at[k])
            at[k] = i
            if i < len(short[k]):
                heapq.heappush(heap, (short[k][i], k))
    return found


def search(query: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Which of the sets link with the query."""
    n = len(query)
    fit = [k for k, s in enumerate(sets) if 100 * min(n, len(s)) >= percent * max(n, len(s))]
    if not n or not fit:
        return []
    fit.sort(key=lambda k: len(sets[k]))
    size = np.array([len(sets[k]) for k in fit])
    token = np.concatenate([sets[k] for k in fit])
    owner = np.repeat(np.arange(len(fit)), size)
    where = np.searchsorted(query, token)
    inside = np.flatnonzero(query[np.minimum(where, n - 1)] == token)
    where, owner = where[inside], owner[inside]
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    cut = np.flatnonzero(np.diff(where)) + 1
    lists = [x.tolist() for x in np.split(owner, cut)] if len(where) else []
    found = t_occurrence(lists, need(n, int(size[0]), percent))
    return [fit[k] for k, c in found.items() if 100 * c >= percent * (n + int(size[k]) - c)]


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) of classes, those that link."""
    spark = docs.sparkSession
    filter_ = spark.sparkContext.broadcast(id_filter(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), F.col("cls")))

    def named(batches):
        seen = set()
        for batch in batches:
            name = np.array([digest(s) for s in sets_of(batch.column(0), width)], np.int64)
            keep = []
            for k in np.flatnonzero(filter_.value.has(name)):
                if int(name[k]) not in seen:
                    seen.add(int(name[k]))
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(name[keep], pa.int64()), batch.column(0).take(pa.array(keep, pa.int64()))], ["cls", "text"])

    texts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(named, "cls long, text string").groupBy("cls").agg(F.min("text").alias("text"))
    blocks = pairs.groupBy("a").agg(F.count("*").alias("k"))
    pairs = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.expr(f"k div {BLOCK} + 1")).alias("block"))
    right = pairs.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "block", "b", "text")
    left = pairs.select("a", "block").distinct().join(texts.withColumnRenamed("cls", "a"), "a")
    left = left.select(F.col("a").alias("q"), F.col("block").alias("q_block"), F.col("text").alias("q_text"))

    def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        query = next(sets_of(left["q_text"].combine_chunks(), width))
        hits = search(query, list(sets_of(right["text"].combine_chunks(), width)), percent)
        b = right["b"].combine_chunks().take(pa.array(hits, pa.int64()))
        return pa.table({"a": pa.array(np.full(len(hits), key[0].as_py(), np.int64)), "b": b})

    return left.groupBy("q", "q_block").cogroup(right.groupBy("a", "block")).applyInArrow(one, "a long, b long")


def _pairs(rows: DataFrame, a: tuple, b: tuple, percent: int) -> DataFrame:
    """Distinct pairs of rows that can reach the overlap from where they meet; a, b: columns of class, size, position."""
    least = f"ceil({percent} * ({a[1]} + {b[1]}) / {100 + percent})"
    able = f"{a[0]} <> {b[0]} and {a[1]} - {a[2]} >= {least} and {b[1]} - {b[2]} >= {least} and 100 * least({a[1]}, {b[1]}) >= {percent} * greatest({a[1]}, {b[1]})"
    return rows.filter(able).select(F.col(a[0]).alias("a"), F.col(b[0]).alias("b")).distinct()


def _across(lists: DataFrame, found: DataFrame) -> DataFrame:
    """(h, cls, size, pos, comp) of lists that hold several components.

    Components are looked up for the distinct pairs of a list's center and member, far fewer than the entries; only
    lists with a pair that differs are then taken from the entries, which a fixed-size filter spares the shuffle."""
    known = found.select(F.col("node").alias("cls"), "comp")
    pairs = lists.filter("center <> cls").select("center", "cls").distinct()
    pairs = pairs.join(known, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    heads = known.select(F.col("cls").alias("center"), F.col("comp").alias("c_comp"))
    pairs = pairs.join(heads, "center", "left").filter(F.col("comp") != F.coalesce("c_comp", "center"))
    differ = materialize(pairs.select("center", "cls", F.xxhash64("center", "cls").alias("doc_id")), "differ")
    some = only(lists.withColumn("doc_id", F.xxhash64("center", "cls")), differ).join(differ.select("center", "cls"), ["center", "cls"], "left_semi")
    mixed = materialize(some.select(F.col("h").alias("doc_id")).distinct(), "mixed")
    members = only(lists.select(F.col("h").alias("doc_id"), "cls", "size", "pos"), mixed).join(mixed, "doc_id", "left_semi")
    members = members.join(known, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    return materialize(members.select(F.col("doc_id").alias("h"), "cls", "size", "pos", "comp"), "members")


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) of each document with the class of its shingle set, and (node, comp) of classes with links."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(_signatures(docs, width), "signatures")
    sketch = spark.sparkContext.broadcast(_sketch(signed.filter("chunk is not null").select("chunk", "counts")))
    names = signed.filter("n is not null").select("doc_id", "n", "cls")
    lists = materialize(_lists(docs, width, percent, sketch), "lists")

    # first round: each list's center against the rest of the list
    stars = materialize(_pairs(lists, ("center", "c_size", "c_pos"), ("cls", "size", "pos"), percent), "pairs")
    edges = materialize(_verified(docs, stars, width, percent), "edges")
    found = components(edges)

    # while lists still hold many pairs across components, another member of each is searched against the rest
    members, used = _across(lists, found), lists.select("h", F.col("center").alias("cls")).distinct()
    for _ in range(ROUNDS):
        # sets of like size must meet within the first seventh of both; those further back pair with few
        near = members.filter(f"pos <= size * {100 - percent} / {100 + percent} + 1")
        each = near.groupBy("h", "comp").agg(F.count("*").alias("k")).groupBy("h").agg((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("twice"))
        open_ = each.agg(F.coalesce(F.sum("twice") / 2, F.lit(0.0))).first()[0]
        if open_ <= MANY * max(members.count(), 10_000):
            break
        fresh = members.join(used, ["h", "cls"], "left_anti")
        heads = materialize(fresh.groupBy("h").agg(F.min(F.struct("pos", "cls", "size", "comp")).alias("c")).selectExpr("h", "c.pos as c_pos", "c.cls as center", "c.size as c_size", "c.comp as c_comp"), "heads")
        pairs = _pairs(members.join(heads, "h").filter("comp <> c_comp"), ("center", "c_size", "c_pos"), ("cls", "size", "pos"), percent)
        pairs = materialize(_unseen(pairs, stars), "pairs")
        stars, used = stars.unionByName(pairs), used.unionByName(heads.select("h", F.col("center").alias("cls")))
        if pairs.isEmpty():
            break
        edges = edges.unionByName(materialize(_verified(docs, pairs, width, percent), "edges"))
        found = components(edges)
        members = _across(lists, found)

    # last round: pairs across components, all that can reach the overlap
    other = members.select("h", *[F.col(c).alias(f"o_{c}") for c in ("cls", "size", "pos", "comp")])
    across = _pairs(members.join(other, "h").filter("comp < o_comp"), ("cls", "size", "pos"), ("o_cls", "o_size", "o_pos"), percent)
    across = materialize(_unseen(across, stars), "pairs")
    if not across.isEmpty():
        more = materialize(_verified(docs, across, width, percent), "edges")
        if not more.isEmpty():
            found = components(edges.unionByName(more))
    return names, found


def _unseen(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    both = seen.unionByName(seen.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")


def near_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    names, found = link(docs, width, percent)
    labels = names.select("doc_id", "n", "cls").join(found.select(F.col("node").alias("cls"), "comp"), "cls", "left")
    # without shingles a text is alone
    labels = labels.withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "cls")))
    # written, so that both sides of the join are plain shuffles and a component of many rows can be split
    least = materialize(labels.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    out = labels.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without near duplicates: of each component one row of the smallest doc_id stays.

    Rows of one doc_id are told apart by the class of their text; texts without shingles are alone, of those only rows equal in
    doc_id and text are one. Only rows that may have to go are shuffled. Rows without a doc_id stay."""
    names, found = link(docs, width, percent)
    labels = names.filter("doc_id is not null").join(found.select(F.col("node").alias("cls"), "comp"), "cls", "left")
    labels = labels.withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "cls"))).groupBy("doc_id", "cls", "comp").agg(F.count("*").alias("k"))
    labels = materialize(labels, "labels")
    least = materialize(labels.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    told = labels.join(least, "comp", "left").withColumn("goes", F.coalesce(F.col("doc_id") != F.col("least"), F.lit(False)))
    # doc_ids with a row that goes, or with several rows
    odd = told.groupBy("doc_id").agg(F.max("goes").alias("goes"), F.sum("k").alias("k")).filter("goes or k > 1").select("doc_id")
    odd = materialize(odd, "odd")

    cls, text = free_name(docs.columns, "cls"), free_name(docs.columns, "left")

    def name(batch):
        classes = [digest(s) for s in sets_of(batch.column(batch.schema.get_field_index("text")), width)]
        return batch.append_column(cls, pa.array(classes, pa.int64()))

    # one worker of Python for each task: workers stay for a while after their stage, with the memory of an executor
    known = docs.filter("doc_id is not null")
    here = only(known, odd, also=name, schema=f"{_ddl(docs)}, `{cls}` long")
    id_, comp = free_name(docs.columns, "id"), free_name(docs.columns, "comp")
    told = told.select(F.col("doc_id").alias(id_), F.col("cls").alias(f"{cls}_"), F.col("comp").alias(comp), "goes")
    same = [F.col("doc_id").cast("long") == F.col(id_), F.col(cls) == F.col(f"{cls}_")]
    here = here.join(told.filter("goes").select(id_, f"{cls}_"), same, "left_anti")
    here = here.join(told.filter("not goes").drop("goes"), same, "left")
    here = here.withColumn(text, F.when(F.col(comp).isNull(), F.coalesce("text", F.lit(""))))
    here = here.dropDuplicates(["doc_id", comp, text]).select(*docs.columns)
    return only(known, odd, hit=False).unionByName(docs.filter("doc_id is null")).unionByName(here)


def _ddl(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
