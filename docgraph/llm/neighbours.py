"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors is linked to a neighbour graph, which is cut into equal parts by recursive spectral
bisection. A small neural classifier learns from a vector in which parts its neighbours lie. It deals every row
of the table to its most probable part; a query goes to as many of its most probable parts as reached RECALL on sample
vectors that the classifier was not trained on, and is ranked there against all rows by the exact inner product.

Equal vectors are one entry that keeps its TOP + 1 smallest ids, which is all that a query can return of them; so a
vector that a third of all rows share costs one row. Rows go to cells: single parts where a query probes few of them, else
CELLS runs of parts that the bisection left side by side; so a query visits CELLS cells at most, and each answers with
its TOP + 1 best, however many parts there are. A cell is searched in blocks of rows and of queries: the queries of a
block stay in memory while its rows stream past, part by part.

The sample has SAMPLE_A_PART vectors a part, LEAST_SAMPLE at least and MOST_SAMPLE at most, from which it follows that
there are at most MOST_SAMPLE / SAMPLE_A_PART parts; parts of a larger table are larger. One task learns from it, HELD
numbers of a matrix at a time; the driver gets the classifier alone. A table of ROWS_A_PART entries
or less is one part. These are parameters; nothing else depends on the size of the table.

Edge cases: vectors that are null, empty, zero, of another length than most of the sample, or hold null or non-finite
components take no part, and neither does a null vec_id; a query whose parts hold less than TOP others is searched in all parts;
ties go to the smaller vec_id; repeated rows of a vec_id count once; an empty table gives no rows; other columns
don't matter.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.llm.common import materialize, table

TOP = 20
EVERY = 20
LEAST_SAMPLE = 4096
SAMPLE_A_PART = 64
MOST_SAMPLE = 1 << 16
ROWS_A_PART = 400
CELLS = 8
ROWS_A_BLOCK = 1 << 16
QUERIES_A_BLOCK = 4096
NEAR = 12
RECALL = 0.94
HIDDEN = 128
#: Numbers of a matrix of the sample against itself or against the parts that are held at a time while learning.
HELD = 1 << 21
SEED = 5


def knn(x: np.ndarray, queries: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Indexes of the k rows of x of largest inner product, for each query; own: queries are x itself."""
    out, step = [], min(256, max(1, HELD // max(1, len(x))))
    for lo in range(0, len(queries), step):
        s = queries[lo : lo + step] @ x.T
        if own:
            s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        # a copy: a slice would keep all columns in memory
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k].copy())
    return np.concatenate(out)


def bisect(graph: np.ndarray, depth: int, rng) -> np.ndarray:
    """Part of each node: the graph halved `depth` times at the median of its second spectral vector."""
    part = np.zeros(len(graph), np.int64)
    for _ in range(depth):
        nxt = part * 2
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            place = np.full(len(graph), -1)
            place[at] = np.arange(len(at))
            to = place[graph[at]]
            ok = to >= 0
            a, b = np.repeat(np.arange(len(at)), ok.sum(axis=1)), to[ok]
            degree = np.bincount(a, minlength=len(at)) + np.bincount(b, minlength=len(at)) + 1e-9
            x = rng.standard_normal(len(at))
            for _ in range(60):
                x -= (x * degree).sum() / degree.sum()
                y = np.bincount(a, x[b], len(at)) + np.bincount(b, x[a], len(at))
                x = y / degree + x
                x /= np.linalg.norm(x) + 1e-30
            order = np.argsort(x, kind="stable")
            nxt[at[order[len(at) // 2 :]]] += 1
        part = nxt
    return part


class Classifier:
    """One hidden layer, trained on soft targets by Adam."""

    def __init__(self, d: int, parts: int, rng):
        self.w = [rng.standard_normal((d, HIDDEN)) * (2 / d) ** 0.5, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * (1 / HIDDEN) ** 0.5, np.zeros(parts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.maximum(x @ a + b, 0) @ c + d

    def fit(self, x: np.ndarray, labels: np.ndarray, weights: np.ndarray, rng, epochs: int = 30, step: float = 3e-3) -> None:
        """The target of a row of x gives each of its labels (parts) that label's weight; repeated ones add up."""
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 256):
                own = order[lo : lo + 256]
                xb, yb = x[own], np.zeros((len(own), len(self.w[3])))
                np.add.at(yb, (np.arange(len(own))[:, None], labels[own]), weights)
                h = np.maximum(xb @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                g = (p / p.sum(axis=1, keepdims=True) - yb) / len(xb)
                back = (g @ self.w[2].T) * (h > 0)
                t += 1
                for i, grad in enumerate((xb.T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad**2
                    self.w[i] = self.w[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def depth_of(rows: int, rows_a_part: int = ROWS_A_PART) -> int:
    """How often the graph is halved for parts of about rows_a_part rows."""
    depth = 0
    while rows >> depth > rows_a_part and SAMPLE_A_PART << (depth + 1) <= MOST_SAMPLE:
        depth += 1
    return depth


def learn(sample: np.ndarray, rows: int, recall: float = RECALL, rows_a_part: int = ROWS_A_PART) -> tuple[Classifier | None, int, float]:
    """Classifier, how many parts to probe, and the recall that this reached on held-out sample vectors."""
    depth = depth_of(rows, rows_a_part)
    if not depth or len(sample) < 16:
        return None, 1, 1.0
    rng = np.random.default_rng(SEED)
    sample = sample[rng.permutation(len(sample))]
    test, known = sample[: len(sample) // 8], sample[len(sample) // 8 :]
    near = min(NEAR, len(known) - 1)
    graph = knn(known, known, near, own=True)
    part = bisect(graph, depth, rng)
    parts = 1 << depth
    weights = np.array([1.0] * near + [near / 2])
    model = Classifier(sample.shape[1], parts, rng)
    model.fit(known, np.column_stack([part[graph], part]), weights / weights.sum(), rng)
    # rows are dealt by the classifier, so recall is measured on such parts; near ones by the sample's own density
    step = max(1, HELD // parts)
    dealt = np.concatenate([model.logits(known[lo : lo + step]).argmax(axis=1) for lo in range(0, len(known), step)])
    near = dealt[knn(known, test, min(TOP, len(known)), own=False)]
    reach = []
    for lo in range(0, len(test), step):
        rank = np.argsort(np.argsort(-model.logits(test[lo : lo + step]), axis=1), axis=1)
        reach.append(np.take_along_axis(rank, near[lo : lo + step], axis=1))
    reach = np.concatenate(reach)
    for probes in range(1, parts + 1):
        got = float((reach < probes).mean())
        if got >= recall:
            break
    return model, probes, got


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of q with rows of x in double precision, summed in order of the components."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += q[:, k] * x[:, k]
    return total


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


class Best:
    """The `top` best (score, id) of each query, ties to smaller ids, while rows stream past."""

    def __init__(self, q: np.ndarray, top: int):
        self.q, self.top = q, top
        self.score = np.full((len(q), top), -np.inf)
        self.id = np.full((len(q), top), np.iinfo(np.int64).max)

    def see(self, some: np.ndarray, x: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Rank the queries `some` against rows x; row i stands for counts[i] of the ids."""
        first = np.cumsum(counts) - counts
        for lo in range(0, len(some), 256):
            own = some[lo : lo + 256]
            rough = self.q[own] @ x.T
            k = min(self.top, len(x))
            floor = np.maximum(np.partition(rough, len(x) - k, axis=1)[:, len(x) - k], self.score[own, -1])
            with np.errstate(invalid="ignore"):
                row, at = np.nonzero(rough >= (floor - 1e-9 * (1 + np.abs(floor)))[:, None])
            score = exact(self.q[own[row]], x[at])
            times = counts[at]
            which = np.repeat(first[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row = np.concatenate([np.repeat(row, times), np.repeat(np.arange(len(own)), self.top)])
            score = np.concatenate([np.repeat(score, times), self.score[own].ravel()])
            id_ = np.concatenate([ids[which], self.id[own].ravel()])
            order = np.lexsort((id_, -score, row))
            start = np.searchsorted(row[order], np.arange(len(own)))
            order = order[start[:, None] + np.arange(self.top)]
            self.score[own], self.id[own] = score[order], id_[order]

    def rows(self, qid: np.ndarray) -> pa.RecordBatch:
        row, col = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(self.id[row, col]), pa.array(self.score[row, col])], ["qid", "vec_id", "score"])


def entries(vectors: DataFrame, top: int) -> DataFrame:
    """(vid, v, ids): each distinct usable vector with its top + 1 smallest ids, vid being the least."""
    v = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda e: e + F.lit(0.0)).alias("v")).distinct()
    first = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    rows = rows.withColumn("rn", first).filter(F.col("rn") <= top + 1)
    return rows.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vid"), "v", "ids")


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP, rows_a_part: int = ROWS_A_PART, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: nearest found of each row whose vec_id is divisible by `every`, itself left out."""
    spark = vectors.sparkSession
    index = materialize(entries(vectors, top), "entries")
    n = index.count()
    depth = depth_of(n, rows_a_part)
    size = min(max(LEAST_SAMPLE, SAMPLE_A_PART << depth), MOST_SAMPLE)
    # the sample: the entries of least hash, a bounded number, of which those that can't be are left out first
    mark = F.pmod(F.xxhash64("vid"), F.lit(1 << 30))
    drawn = index.select(mark.alias("mark"), "vid", "v").filter(F.col("mark") < int((1 << 30) * min(1.0, 1.2 * size / max(n, 1) + 64 / max(n, 1))))

    def taught(batches):
        """In one task, which has room for the sample: the driver gets the classifier alone."""
        by: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            long_ = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for k in np.unique(long_).tolist():
                by.setdefault(k, []).append(_matrix(batch.column(0).filter(pa.array(long_ == k)), k))
        if by:
            d = max(by, key=lambda k: (sum(map(len, by[k])), -k))
            own = np.concatenate(by.pop(d))
            by.clear()
            model, probes, _ = learn(own, n, recall, rows_a_part)
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([probes], pa.int32()), pa.array([pickle.dumps(model)], pa.binary())], ["d", "probes", "model"])

    row = drawn.orderBy("mark", "vid").limit(size).select("v").mapInArrow(taught, "d int, probes int, model binary").collect()
    d, probes, model = (row[0]["d"], row[0]["probes"], pickle.loads(row[0]["model"])) if row else (1, 1, None)
    index = index.filter(F.size("v") == d)
    parts = 1 << depth if model else 1
    sent = spark.sparkContext.broadcast(model)

    def deal(batches):
        for batch in batches:
            x = _matrix(batch.column(1), d)
            part = sent.value.logits(x).argmax(axis=1) if sent.value else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], ["vid", "v", "ids", "part"])

    dealt = materialize(index.mapInArrow(deal, "vid long, v array<double>, ids array<long>, part int"), "dealt")
    # rows of `vectors` that are queries, by the entry of their vector
    v = F.transform(F.col("embedding").cast("array<double>"), lambda e: e + F.lit(0.0))
    asked = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("query_id"), v.alias("v")).distinct()
    asked = materialize(asked.join(index.select("v", F.col("vid").alias("qid")), "v").select("query_id", "qid"), "asked")
    order = [F.desc("score"), F.asc("vec_id")]

    def best(asked: DataFrame, probes: int) -> DataFrame:
        found = _probed(dealt, asked, sent, d, parts, probes, top + 1)
        found = found.withColumn("k", F.row_number().over(W.partitionBy("qid").orderBy(*order))).filter(F.col("k") <= top + 1).drop("k")
        found = asked.join(found, "qid").filter("vec_id <> query_id")
        return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

    if probes == parts:
        return best(asked, probes)
    found = materialize(best(asked, probes), "found")
    full = found.groupBy("query_id").agg(F.count("*").alias("k")).filter(F.col("k") >= top)
    short = materialize(asked.join(full.select("query_id"), "query_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(best(short, parts))


def _probed(dealt: DataFrame, asked: DataFrame, sent, d: int, parts: int, probes: int, top: int) -> DataFrame:
    """(qid, vec_id, score): the `top` best of each query in each cell that it visits."""
    spark = dealt.sparkSession
    wide = 1 if probes <= CELLS else -(-parts // CELLS)  # parts a cell

    def route(batches):
        for batch in batches:
            x = _matrix(batch.column(1), d)
            to = np.sort(np.argsort(-sent.value.logits(x), axis=1, kind="stable")[:, :probes], axis=1) if sent.value else np.zeros((len(x), 1), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(to.astype(np.int32)), pa.list_(pa.int32()))], ["qid", "q", "parts"])

    queries = dealt.join(asked.select(F.col("qid").alias("vid")).distinct(), "vid", "left_semi").select(F.col("vid").alias("qid"), F.col("v").alias("q"))
    cells = F.array_distinct(F.transform("parts", lambda p: F.floor(p / wide).cast("int")))
    routed = materialize(queries.mapInArrow(route, "qid long, q array<double>, parts array<int>").withColumn("cell", F.explode(cells)), "routed")
    dealt = dealt.withColumn("cell", F.floor(F.col("part") / wide).cast("int"))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("rows")).join(routed.groupBy("cell").agg(F.count("*").alias("asks")), "cell").orderBy("cell").collect()  # a row for each cell
    lines, groups = [], 0
    for r in sizes:
        nb, nq = r["rows"] // ROWS_A_BLOCK + 1, r["asks"] // QUERIES_A_BLOCK + 1
        lines.append((r["cell"], groups, nb, nq))
        groups += nb * nq
    plan = F.broadcast(spark.createDataFrame(lines, "cell int, base int, nb int, nq int"))  # a row for each cell
    none = F.lit(None)
    block = F.col("base") + F.pmod(F.xxhash64("vid"), F.col("nb")).cast("int") * F.col("nq")
    right = dealt.join(plan, "cell").select(F.explode(F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda k: block + k)).alias("g"), F.col("part").alias("part"), F.col("vid").alias("id"), "v", "ids", none.cast("array<int>").alias("parts"))
    first = F.col("base") + F.pmod(F.xxhash64("qid"), F.col("nq")).cast("int")
    left = routed.join(plan, "cell").select(F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: first + k * F.col("nq"))).alias("g"), F.lit(-1).alias("part"), F.col("qid").alias("id"), F.col("q").alias("v"), none.cast("array<long>").alias("ids"), "parts")

    def rank(batches):
        """Groups one after another: of each first its queries, then its rows by part."""
        now, held, qid, probed, best = None, [], None, None, None
        for batch in batches:
            g, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(g)]
            for lo, hi in zip(cut, cut[1:]):
                if hi == lo:
                    continue
                piece = batch.slice(lo, hi - lo)
                if g[lo] != now:
                    if best is not None:
                        yield best.rows(qid)
                    now, held, best = g[lo], [], None
                if part[lo] < 0:
                    held.append(piece)
                    continue
                if not held and best is None:
                    continue  # no queries come here
                if best is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    qid, held = rows["id"].to_numpy(), []
                    best = Best(_matrix(rows["v"], d), top)
                    probed = np.zeros((len(qid), parts), bool)
                    lists = rows["parts"].combine_chunks()
                    probed[np.repeat(np.arange(len(qid)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
                some = np.flatnonzero(probed[:, part[lo]])
                if len(some):
                    ids = piece.column(4)
                    best.see(some, _matrix(piece.column(3), d), ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()))
        if best is not None:
            yield best.rows(qid)

    rows = left.unionByName(right).select("g", "part", "id", "v", "ids", "parts").repartitionById(max(1, min(groups, 10_000)), F.expr(f"g % {max(1, min(groups, 10_000))}"))
    return rows.sortWithinPartitions("g", "part").mapInArrow(rank, "qid long, vec_id long, score double")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
