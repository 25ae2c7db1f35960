"""Links, mentions, ranks and walks on edge tables (src, dst).

Walks keep a frontier and what was seen as tables; each round is one join on the frontier and an anti-join. Rounds end
in a table in the shared folder, which survives lost executors.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docgraph.functions import text as T
from docgraph.operators.order import numbered, running_total
from docgraph.sources.shared import cut

DAMPING, ROUNDS, CUT = 0.85, 40, 4


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, rank): `rounds` rounds, dangling mass spread evenly. nodes: id; edges: src, dst, counted once.

    A round is r -> A r + s, A being the damped shares along edges and s one number, what is spread evenly. So the ranks
    are sums of 1, A 1, A A 1, ..., each of which is one join and one aggregate of the one before; the numbers s follow from
    their totals, as ranks add up to one. Rounds stop early where no edge is left to follow."""
    nodes = nodes.select("id").distinct()
    edges = edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    shares = cut(edges.join(out, "src").select("src", "dst", (DAMPING / F.col("out")).alias("share")))
    powers = []
    for _ in range(rounds):
        step = shares.withColumn("v", F.col("share")) if not powers else shares.join(powers[-1].select(F.col("id").alias("src"), F.col("v").alias("was")), "src").withColumn("v", F.col("share") * F.col("was"))
        powers.append(cut(step.groupBy(F.col("dst").alias("id")).agg(F.sum("v").alias("v"))))
        if powers[-1].isEmpty():
            break
    numbered_ = [p.withColumn("j", F.lit(j)) for j, p in enumerate(powers, 1)]
    terms = reduce(lambda a, b: a.unionByName(b), numbered_) if powers else nodes.select("id", F.lit(0.0).alias("v"), F.lit(1).alias("j")).limit(0)
    totals = dict(terms.groupBy("j").agg(F.sum("v")).collect())  # a number a round
    weights = [1.0 / n]
    for _ in range(rounds):
        weights = [(1 - sum(w * totals.get(j, 0.0) for j, w in enumerate(weights, 1))) / n, *weights]
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("j") + 1)
    got = terms.groupBy("id").agg(F.sum(weight * F.col("v")).alias("got"))
    return nodes.join(got, "id", "left").select("id", (F.coalesce("got", F.lit(0.0)) + weights[0]).alias("rank"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree_in, degree_out) of nodes with an edge; equal edges count once."""
    edges = edges.select("src", "dst").distinct()
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("degree_in"), F.sum("o").alias("degree_out"))


def walk(starts: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, level, via): nodes reached along src -> dst, at their first level, with the least node that leads there.

    depth: levels at most; None walks to the end."""
    seen = cut(starts.select("id").distinct().select("id", F.lit(0).alias("level"), F.lit(None).cast(starts.schema["id"].dataType).alias("via")))
    edges = cut(edges.select("src", "dst").distinct())
    frontier, level = seen, 0
    while depth is None or level < depth:
        level += 1
        step = edges.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("level"), "via"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % CUT == 0:
            seen = cut(seen)
    return seen


def walk_order(starts: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, level, via, place) of the nodes reached, in the order in which a queue would meet them, from 1.

    starts: id, nth; edges: src, dst, nth (the order of a node's edges, the least of equal ones counting). A node is known by
    the numbers on the way on which it is first met: at one level ways sort as the queue does, so that the order is one sort
    at the end. Cycles end where they meet what was seen."""
    ways = F.array(F.col("nth").cast("long"))
    kind = starts.schema["id"].dataType
    seen = cut(starts.groupBy("id").agg(F.min("nth").alias("nth")).select("id", F.lit(0).alias("level"), F.lit(None).cast(kind).alias("via"), ways.alias("way")))
    edges = cut(edges.groupBy("src", "dst").agg(F.min("nth").cast("long").alias("nth")))
    frontier, level = seen, 0
    while depth is None or level < depth:
        level += 1
        step = edges.join(frontier.select(F.col("id").alias("src"), "way"), "src").select(F.col("dst").alias("id"), F.col("src").alias("via"), F.concat("way", F.array("nth")).alias("way"))
        step = step.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("way", "via")).alias("x"))
        frontier = cut(step.select("id", F.lit(level).alias("level"), F.col("x.via").alias("via"), F.col("x.way").alias("way")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % CUT == 0:
            seen = cut(seen)
    reached = seen.filter("level > 0").withColumn("__all", F.lit(0))
    return numbered(reached, ["__all"], [F.col("level"), F.col("way")], "place").select("id", "level", "via", "place")


def neighbourhood(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, level, via) within `depth` steps along edges in either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return walk(starts, both, depth)


def callees(starts: DataFrame, calls: DataFrame, depth: int | None = None) -> DataFrame:
    return walk(starts, calls, depth).filter("level > 0")


def callers(starts: DataFrame, calls: DataFrame, depth: int | None = 1) -> DataFrame:
    return walk(starts, calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), depth).filter("level > 0")


def links(pages: DataFrame, body: str = "body", path: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, path, target): each relative link of a page and the path it means."""
    found = F.explode(F.regexp_extract_all(F.col(body), F.lit(r"\]\(([^)\s]+)"), F.lit(1)))
    return pages.select(*keep, path, found.alias("link")).select(*keep, path, T.resolve_link(F.col(path), F.col("link")).alias("target")).filter("target is not null").distinct()


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): links joined to the page at the path; of pages with one path the largest id."""
    at = pages.groupBy(F.col("path").alias("target")).agg(F.max("id").alias("dst"))
    found = links(pages, keep=("id",)).select(F.col("id").alias("src"), "target")
    return found.join(at, "target").filter("src <> dst").select("src", "dst").distinct()


def _twice(old: Column, k: int, seed: int):
    return lambda x, at: F.xxhash64(x, F.get(old, at + k), F.lit(seed))


def _run(k: int, other: str):
    return lambda x, at: F.struct(F.lit(k).alias("p"), at.alias("pos"), x.alias("a"), F.get(F.col(other), at).alias("b"))


def _grams(w: str, most: int) -> tuple[dict[int, tuple[str, str]], list[tuple[str, Column]]]:
    """Columns, made in turn, of two 64-bit hashes of each run of 1, 2, 4, ... `most` words of an array, by where it starts.

    A run of 2 k words is told by the runs of k words that it is made of."""
    names, made, k = {1: ("__a1", "__b1")}, [("__a1", F.transform(w, lambda x: F.xxhash64(x))), ("__b1", F.transform(w, lambda x: F.xxhash64(x, F.lit(1))))], 1
    while 2 * k <= most:
        for i, c in enumerate("ab"):
            old = F.col(names[k][i])
            starts = F.slice(old, 1, F.greatest(F.size(w) - 2 * k + 1, F.lit(0)))
            made.append((f"__{c}{2 * k}", F.transform(starts, _twice(old, k, i))))
        k *= 2
        names[k] = (f"__a{k}", f"__b{k}")
    return names, made


def _named(words: list[list[str]]) -> tuple[list[str], dict[int, np.ndarray], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """What names (their words) are matched by: the words, sorted by number; for each power of two p the keys of
    runs of p words, made of two runs of half the length; for each length the keys of names, made of their first and last
    p words, and which name each is. Runs are numbered by the place of their key, from 1."""
    vocabulary = sorted({w for name in words for w in name})
    number = {w: k for k, w in enumerate(vocabulary, 1)}
    size = np.array([len(w) for w in words])
    runs = np.array([number[w] for name in words for w in name], np.int64)
    first = np.cumsum(size) - size
    left = np.repeat(first + size, size) - np.arange(len(runs))  # words up to the end of the name
    levels, names, p = {}, {}, 1
    while True:
        for n in np.unique(size[(size >= p) & (size < 2 * p)]).tolist():
            own = np.flatnonzero(size == n)
            key = runs[first[own]] << 32 | runs[first[own] + n - p]
            order = np.argsort(key)
            names[n] = key[order], own[order]
        if 2 * p > size.max():
            return vocabulary, levels, names
        at = np.flatnonzero(left >= 2 * p)
        levels[2 * p], made = np.unique(runs[at] << 32 | runs[at + p], return_inverse=True)
        runs = np.zeros(len(runs), np.int64)
        runs[at] = made + 1
        p *= 2


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key stands in sorted keys, or -1."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _longest(runs: np.ndarray, left: np.ndarray, levels: dict[int, np.ndarray], names: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, name, length) of the longest name at each place; runs: the number of each word or 0, left: words up to the page's end."""
    best, length = np.full(len(runs), -1), np.zeros(len(runs), np.int64)
    at = np.flatnonzero(runs)
    p = 1
    while len(at):
        for n in sorted(n for n in names if p <= n < 2 * p):
            heads = at[left[at] >= n]
            tail = runs[heads + n - p]
            heads, tail = heads[tail > 0], tail[tail > 0]
            found = _find(names[n][0], runs[heads] << 32 | tail)
            heads, found = heads[found >= 0], found[found >= 0]
            best[heads], length[heads] = names[n][1][found], n  # longer ones come later
        if 2 * p not in levels:
            break
        at = at[left[at] >= 2 * p]
        at = at[runs[at + p] > 0]
        found = _find(levels[2 * p], runs[at] << 32 | runs[at + p])
        at, found = at[found >= 0], found[found >= 0]
        runs = np.zeros(len(runs), np.int64)
        runs[at] = found + 1
        p *= 2
    place = np.flatnonzero(best >= 0)
    return place, best[place], length[place]


#: Words of names that are sent to all tasks, and words of pages that are matched at once, at most (but for one page).
SENT, WORDS = 1_000_000, 1 << 20


def _matches(pages: DataFrame, names: DataFrame, places: bool) -> DataFrame:
    """(src, dst) of the names (w, dst; SENT words at most) that win a place in a page (src, w), each once a page; places: (src, pos, n, dst), the winner at each place."""
    rows = names.collect()
    vocabulary, levels, keys = _named([r["w"] for r in rows])
    kinds = {f.name: f.dataType.simpleString() for f in (pages.schema["src"], names.schema["dst"])}
    target = pa.array([r["dst"] for r in rows], to_arrow_type(names.schema["dst"].dataType))
    sent = pages.sparkSession.sparkContext.broadcast((pa.array(vocabulary), levels, keys, target))

    def match(batches):
        vocabulary, levels, keys, target = sent.value
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            flat, row, done = lists.flatten(), 0, 0
            while row < len(ends):
                to = max(row + 1, int(np.searchsorted(ends, done + WORDS, "right")))
                own, size = ends[row:to] - done, int(ends[to - 1] - done)
                runs = pc.fill_null(pc.index_in(flat.slice(done, size), vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                sizes = np.diff(own, prepend=0)
                left = np.repeat(own, sizes) - np.arange(size)
                place, name, n = _longest(runs, left, levels, keys)
                page = np.searchsorted(own, place, "right")
                if places:
                    columns = [pa.array(place - (own - sizes)[page]), pa.array(n)]
                else:
                    key = np.unique(page * len(target) + name)
                    page, name, columns = key // len(target), key % len(target), []
                out = [batch.column(0).take(pa.array(page + row)), *columns, target.take(pa.array(name))]
                yield pa.RecordBatch.from_arrays(out, ["src", "pos", "n", "dst"] if places else ["src", "dst"])
                done, row = done + size, to

    return pages.mapInArrow(match, f"src {kinds['src']}, {'pos long, n long, ' if places else ''}dst {kinds['dst']}")


def _joined(pages: DataFrame, phrase: DataFrame) -> DataFrame:
    """(src, dst): as _matches() gives them, for any number of names (w, n, dst) and by joins.

    Runs are hashed (128 bits) from the runs of half their length, those that no name begins or ends with go, and what is
    left is joined by place and hash. No pair of pages is listed; of names that begin alike one row a length is tried at a
    place."""
    most = phrase.agg(F.max("n").alias("n")).first()["n"]
    columns, made = _grams("w", most)
    for name, column in made:
        phrase = phrase.withColumn(name, column)
    at = lambda c, i: F.coalesce(*[F.when(F.col("p") == k, F.get(F.col(x[c]), i)) for k, x in columns.items()])
    p = F.greatest(*[F.when(F.col("n") >= k, k) for k in columns], F.lit(0))
    tail = F.col("n") - F.col("p")
    phrase = cut(phrase.withColumn("p", p).select("p", "n", "dst", *[at(c, i).alias(x) for x, c, i in (("ha", 0, F.lit(0)), ("hb", 1, F.lit(0)), ("ta", 0, tail), ("tb", 1, tail))]))
    sizes = {r["p"] for r in phrase.select("p").distinct().collect()}  # powers of two up to the longest name
    grams = pages
    for name, column in made:
        grams = grams.withColumn(name, column)
    runs = [F.transform(a, _run(k, b)) for k, (a, b) in columns.items() if k in sizes]
    rows = grams.select("src", F.inline(F.concat(*runs)))
    ends = phrase.select("p", F.col("ha").alias("a"), F.col("hb").alias("b")).union(phrase.select("p", "ta", "tb")).distinct()
    marks = cut(rows.join(ends, ["p", "a", "b"], "left_semi"))
    lengths = phrase.groupBy("p", F.col("ha").alias("a"), F.col("hb").alias("b")).agg(F.collect_set("n").alias("lengths"))  # at most p
    heads = marks.join(lengths, ["p", "a", "b"]).select("src", "p", "pos", F.col("a").alias("ha"), F.col("b").alias("hb"), F.explode("lengths").alias("n"))
    tails = marks.select("src", "p", F.col("pos").alias("end"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    whole = heads.withColumn("end", F.col("pos") + F.col("n") - F.col("p")).join(tails, ["src", "p", "end"]).join(phrase, ["p", "n", "ha", "hb", "ta", "tb"])
    best = whole.groupBy("src", "pos").agg(F.max_by("dst", "n").alias("dst"))
    return best.select("src", "dst")



def mentions(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst): names (id, name) of any length that bodies (id, body) mention.

    At each word the longest name that starts there wins, ties going to the least id; a page's own name wins its place
    but is no edge. A name of n words is told by its first and its last p words, p being the greatest power of two that
    n holds. Names of SENT words in all are sent to all tasks, and a page is matched where it lies; places of its words are
    dealt out only if several pages have one id, or if the names are more."""
    word = r"[\p{L}\p{M}0-9']+"
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(word), F.lit(0))
    phrase = names.select(words("name").alias("w"), F.col("id").alias("dst")).filter(F.size("w") > 0).groupBy("w").agg(F.min("dst").alias("dst")).withColumn("n", F.size("w"))
    phrase = cut(phrase)
    total = phrase.agg(F.sum("n").alias("n")).first()["n"]
    if total is None:
        return pages.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    rows = pages.filter("id is not null").select(F.col("id").alias("src"), words("body").alias("w"))
    if total > SENT:
        return _joined(rows, phrase).filter("src <> dst").distinct()
    several = cut(rows.groupBy("src").count().filter("count > 1").select("src"))
    if several.isEmpty():
        return _matches(rows, phrase, False).filter("src <> dst").distinct()
    won = _matches(rows.join(several, "src", "left_semi"), phrase, True).groupBy("src", "pos").agg(F.min(F.struct(-F.col("n"), "dst"))["dst"].alias("dst")).select("src", "dst")
    return _matches(rows.join(several, "src", "left_anti"), phrase, False).unionByName(won).filter("src <> dst").distinct()


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    return pages.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def sees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, seen): a page, what it imports, and what that imports."""
    e = edges.select("src", "dst").distinct()
    two = e.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("id"), F.col("b.dst").alias("seen"))
    one = e.select(F.col("src").alias("id"), F.col("dst").alias("seen"))
    return nodes.select("id", F.col("id").alias("seen")).unionByName(one).unionByName(two).distinct()


def median_split(rows: DataFrame, value: str) -> DataFrame:
    """rows with `upper`: at or above the upper median, found by counts of values in ranges and then in one range."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    counts = cut(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    totals = sorted((r["part"], r["k"]) for r in counts.groupBy("part").agg(F.sum("k").alias("k")).collect())  # a row for each range
    if not totals:
        return rows.withColumn("upper", F.lit(True))
    left = sum(k for _, k in totals) // 2
    for part, k in totals:
        if left < k:
            break
        left -= k
    run = F.sum("k").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    middle = counts.filter(F.col("part") == part).withColumn("upto", run).filter(F.col("upto") > left).agg(F.min("v").alias("v"))
    return rows.withColumn("upper", F.col(value) >= F.lit(middle.first()["v"]))


BLOCK = 64


def innermost(sites: DataFrame, spans: DataFrame) -> DataFrame:
    """Each call site (page_id, site, line) with the narrowest span (page_id, item, start, end) around its line.

    Spans go to the blocks of BLOCK lines that they touch, sites to their own, so that both meet by equi-join."""
    there = spans.filter("start <= end").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(F.col("end") / BLOCK))))
    inside = sites.withColumn("block", F.floor(F.col("line") / BLOCK)).join(there, ["page_id", "block"]).filter("line between start and end")
    return inside.groupBy("page_id", "site", "line").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("size"), F.col("start"), "item"))["item"].alias("item"))


def next_at_most(rows: DataFrame, group: list[str], at: str, level: str, last: str) -> DataFrame:
    """rows with `ends`: one before the next row of the group at the same level or above, else `last`.

    One running minimum over the rows that follow for each level, of which labels have eight."""
    levels = sorted(r[0] for r in rows.select(level).distinct().collect() if r[0] is not None)
    after = W.partitionBy(*group).orderBy(F.desc(at)).rangeBetween(W.unboundedPreceding, -1)
    later = F.lit(None).cast(rows.schema[at].dataType)
    for k in reversed(levels):
        later = F.when(F.col(level) == k, F.min(F.when(F.col(level) <= k, F.col(at))).over(after)).otherwise(later)
    return rows.withColumn("ends", F.coalesce(later - 1, F.col(last)))


def longest_prefix(rows: DataFrame, group: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """rows of each group in order while their sizes add up to the budget at most, with `used`: sizes so far.

    The totals run over ranges of rows, whatever a group holds; rows should be narrow, as they are written once."""
    return running_total(rows, group, order, size.cast("long"), "used").filter(F.col("used") <= budget)


def greedy(rows: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Rows (group, order) of each group that a scan in order admits: what does not fit is left out and the scan goes on.

    Of one size the rows admitted are the group's first ones, budget / size of them at most: once one doesn't fit, none
    after it does. So only these go to the scan, some budget * log(budget) rows a group, and rows without size are always
    admitted: how many rows a group has doesn't matter to any task."""
    rows = rows.select(*group, *order, F.col(size).cast("long").alias("__size")).filter(F.col("__size") <= budget)
    free = rows.filter("__size <= 0").drop("__size")
    sized = numbered(rows.filter("__size > 0"), [*group, "__size"], [F.col(c) for c in order], "__nth")
    rows = sized.filter(F.col("__nth") * F.col("__size") <= budget).drop("__nth")
    out = rows.drop("__size").schema
    key = F.struct(*group)
    rows = rows.withColumn("__group", F.sha2(F.to_json(key, {"ignoreNullFields": "false"}), 256))

    def scan(batches):
        now, left = None, budget
        for batch in batches:
            names = batch.column(batch.num_columns - 1).to_pylist()
            sizes = batch.column(batch.num_columns - 2).to_numpy()
            kept, lo = [], 0
            while lo < len(names):
                if names[lo] != now:
                    now, left = names[lo], budget
                hi = bisect_right(names, now, lo)
                while lo < hi:
                    fit = np.flatnonzero(sizes[lo:hi] <= left)
                    if not len(fit):
                        lo = hi
                        break
                    lo += int(fit[0])
                    run = int(np.searchsorted(np.cumsum(sizes[lo:hi]), left, "right"))
                    kept.extend(range(lo, lo + run))
                    left -= int(sizes[lo : lo + run].sum())
                    lo += run
            yield batch.take(pa.array(kept, pa.int64())).select(batch.schema.names[:-2])

    return rows.repartition("__group").sortWithinPartitions("__group", *order).mapInArrow(scan, out).unionByName(free)


def closure(edges: DataFrame) -> DataFrame:
    """(id, reached): what each node of edges reaches in one step or more, to the fixpoint, itself only over a loop.

    A round follows the edges from the pairs that the last one has found, and keeps those that are new."""
    edges = cut(edges.select("src", "dst").distinct())
    known = frontier = edges.select(F.col("src").alias("id"), F.col("dst").alias("reached"))
    level = 0
    while True:
        step = frontier.join(edges, F.col("reached") == F.col("src")).select("id", F.col("dst").alias("reached")).distinct()
        frontier = cut(step.join(known, ["id", "reached"], "left_anti"))
        if frontier.isEmpty():
            return known
        known, level = known.unionByName(frontier), level + 1
        if level % CUT == 0:
            known = cut(known)


def code_mentions(mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """mentions (src, dst) without those of a code page that the text does not mention the way code does.

    pages: id, kind, path, body."""
    to = pages.select(F.col("id").alias("dst"), "kind", T.module_stem("path").alias("stem"), T.extension("path").alias("ext"))
    said = mentions.join(to, "dst").join(pages.select(F.col("id").alias("src"), "body"), "src")
    return said.filter(~F.col("kind").startswith("code:") | T.refers_to_module(F.col("body"), F.col("stem"), F.col("ext"))).select("src", "dst")
