"""Periodic runs of words by Crochemore's partition refinement, and texts collapsed to a run's first period.

The positions of a text are kept in classes: at level k two positions are in one class when the k words from each are the
same. Going from one level to the next, a class is split by the classes of the positions that follow its members, and
only by those that were split off lately: of each class that falls apart the largest piece stays out, so that a position
is touched O(log n) times. Two neighbours of a class that lie k apart at level k are a square of period k (a closer member
would be between them if the period were not the smallest); squares of one period that start side by side are one run.

Texts of a batch are refined together, level by level, in arrays; a mark behind each text is a class of its own. The
arrays of a batch have WORDS entries, or those of one longer text. No text is compared with another: there is no shuffle,
and whatever a source or a group of copies holds, tasks are even.

Edge cases: a null text, or one without words, has no runs and an empty collapsed text; words are compared as bytes, not
by hashes; a text of any length is taken whole, in some 60 bytes a word; repeated rows and ids keep their rows and have
equal runs; a null doc_id is a row like any other; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import WORD, table

#: Words that are refined together, and the least length of a run.
WORDS = 1 << 20
LEAST = 12


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Classes:
    """Classes of positions with equal factors of `level` words.

    A class is named by where it begins in `perm`, in which its members lie side by side; `after` and `before` are a
    position's neighbours in its class (-1: none), `since` the level from which it has had the neighbour after it."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.level = 1
        self.perm = np.argsort(codes, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.perm] = np.arange(n)
        ordered = codes[self.perm]
        head = np.ones(n, bool)
        head[1:] = ordered[1:] != ordered[:-1]
        begins = np.flatnonzero(head)
        self.size = np.zeros(n, np.int64)
        self.size[begins] = np.diff(begins, append=n)
        self.cls = np.empty(n, np.int64)
        self.cls[self.perm] = np.repeat(begins, self.size[begins])
        self.after, self.before = np.full(n, -1), np.full(n, -1)
        a, b = self.perm[:-1][~head[1:]], self.perm[1:][~head[1:]]
        self.after[a], self.before[b] = b, a
        self.since = np.ones(n, np.int64)
        self.touched = np.zeros(n, bool)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def refine(self, small: np.ndarray) -> np.ndarray | None:
        """Split the classes before the positions `small`; gives the positions of the small pieces, or None at the end."""
        at = small - 1
        at = at[at >= 0]
        at = np.sort(at[self.size[self.cls[at]] > 1])
        if not len(at):
            return None
        self.level += 1
        cls, splitter = self.cls[at], self.cls[at + 1]
        self.touched[at] = True
        self._unlink(at[np.argsort(cls, kind="stable")])

        # pieces: what is in one class and precedes one class
        order = np.argsort(cls * len(self.cls) + splitter, kind="stable")
        moved, cls, splitter = at[order], cls[order], splitter[order]
        new_class = np.ones(len(at), bool)
        new_class[1:] = cls[1:] != cls[:-1]
        new_piece = new_class.copy()
        new_piece[1:] |= splitter[1:] != splitter[:-1]
        first, of = np.flatnonzero(new_piece), np.cumsum(new_class) - 1
        sizes = np.diff(first, append=len(at))
        begin_of_class = np.flatnonzero(new_class)
        parents = cls[begin_of_class]
        rest = self.size[parents] - np.diff(begin_of_class, append=len(at))

        # pieces move to the end of their class, in order; what lay there takes their places
        kept_to = parents + rest
        slots = kept_to[of] + np.arange(len(at)) - begin_of_class[of]
        there, was = self.perm[slots], self.place[moved]
        displaced, holes = there[~self.touched[there]], was[was < kept_to[of]]
        self.perm[holes], self.place[displaced] = displaced, holes
        self.perm[slots], self.place[moved] = moved, slots
        self.touched[moved] = False
        self.size[parents] = rest
        names = slots[first]
        self.size[names] = sizes
        self.cls[moved] = np.repeat(names, sizes)
        self._link(moved, new_piece)

        # the largest piece of a class, be it what did not move, need not split others at the next level
        owner = of[first]
        largest = np.maximum.reduceat(sizes, np.flatnonzero(new_class[first]))
        stays = rest >= largest
        out = np.flatnonzero((sizes == largest[owner]) & ~stays[owner])
        once = np.ones(len(out), bool)
        once[1:] = owner[out[1:]] != owner[out[:-1]]
        splits = np.ones(len(first), bool)
        splits[out[once]] = False
        others = ~stays & (rest > 0)
        return np.concatenate([moved[np.repeat(splits, sizes)], self.perm[_ranges(parents[others], rest[others])]])

    def _changed(self, at: np.ndarray) -> None:
        """The neighbours after `at` change at this level: squares are those that lay k apart at level k."""
        after = self.after[at]
        distance = after - at
        square = (after >= 0) & (self.since[at] <= distance) & (distance < self.level)
        if square.any():
            self.squares.append((at[square], distance[square]))
        self.since[at] = self.level

    def _unlink(self, at: np.ndarray) -> None:
        """Take positions, in order of class and place, out of their classes' chains."""
        before, after = self.before[at], self.after[at]
        left, right = before[(before < 0) | ~self.touched[before]], after[(after < 0) | ~self.touched[after]]
        has_left, has_right = left >= 0, right >= 0
        self._changed(np.concatenate([at, left[has_left]]))
        self.after[left[has_left]] = right[has_left]
        self.before[right[has_right]] = left[has_right]

    def _link(self, at: np.ndarray, head: np.ndarray) -> None:
        follows = ~head[1:]
        after, before = np.full(len(at), -1), np.full(len(at), -1)
        after[:-1][follows], before[1:][follows] = at[1:][follows], at[:-1][follows]
        self.after[at], self.before[at] = after, before


def runs_of(codes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs of at least `least` codes (and two periods), by start, then period.

    Texts may stand side by side if a code that occurs once follows each."""
    if not len(codes):
        return (np.zeros(0, np.int64),) * 3
    classes = Classes(codes)
    small = np.arange(len(codes))
    while (small := classes.refine(small)) is not None:
        pass
    if not classes.squares:
        return (np.zeros(0, np.int64),) * 3
    at, period = (np.concatenate([s[k] for s in classes.squares]) for k in (0, 1))
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    head = np.ones(len(at), bool)
    head[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(head)
    start, period = at[first], period[first]
    length = np.diff(first, append=len(at)) - 1 + 2 * period
    keep = np.flatnonzero(length >= least)
    keep = keep[np.lexsort((period[keep], start[keep]))]
    return start[keep], length[keep], period[keep]


def _codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, told apart by text, with one behind each text that occurs once; and where texts begin."""
    parts, base = [], 0
    for words in texts:
        number = defaultdict(itertools.count(base).__next__)
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        base += len(number) + 1
        parts.append(np.array([base - 1]))
    return np.concatenate(parts), np.cumsum([0, *(len(w) + 1 for w in texts)])


def _groups(texts: list[str | None], most: int):
    """The texts' words, in groups of `most` words; a longer text stands alone."""
    group, size = [], 0
    for text in texts:
        words = (text or "").encode().split()
        if group and size + len(words) > most:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    return b" ".join(list(itertools.compress(words, (np.cumsum(gone)[:-1] == 0).tolist())))


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs (doc_id, text).

    runs are all runs of at least `least` words as (start, length, period), by start, then period; collapsed are the words,
    joined by one space, that no run contains behind its first period."""

    def run(batches):
        for batch in batches:
            done = 0
            for texts in _groups(batch.column(1).to_pylist(), WORDS):
                codes, bounds = _codes(texts)
                start, length, period = runs_of(codes, least)
                cut = np.searchsorted(start, bounds)
                collapsed = []
                for k, words in enumerate(texts):
                    own = slice(cut[k], cut[k + 1])
                    collapsed.append(b" ".join(words) if cut[k] == cut[k + 1] else _collapsed(words, start[own] - bounds[k], length[own], period[own]))
                inside = start - np.repeat(bounds[:-1], np.diff(cut))
                found = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (inside, length, period)], fields=list(_RUN)))
                ids = batch.column(0).slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in texts], pa.int64()), found, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), of which every tenth by crc32 of doc_id ends in a period: from word a on, word i is word a + (i - a) % p.

    A null doc_id has no crc32 and keeps its text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    marked = docs.select("doc_id", "text", (h % 10 == 0).alias("ends"), F.floor(h / 10).alias("g"))
    marked = marked.withColumn("words", F.when(F.col("ends"), words)).withColumn("n", F.greatest(F.size("words"), F.lit(1)).cast("long"))
    marked = marked.withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.transform("words", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return marked.select("doc_id", F.when(F.col("ends") & (F.size("words") > 0), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_periods(table(spark, sf_dir, "documents")))
    # the longest; of those the first, then that of the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / (-F.col("best.period"))).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
