"""Language identification, words first: known words score by their log frequency in each language; words not seen in
training fall back to the longest character n-grams of theirs that were, from NGRAM letters down to one.

Counts cover all training documents, and all words and n-grams of theirs are scored. Words and n-grams are told by 64-bit
hashes. The WORDS most frequent words of each language and the GRAMS most frequent n-grams of each length (without those
tied with the first one left out) are sent to all tasks, with their log frequencies in all languages. All others stay in
a table: each distinct further word of the corpus is looked up there once, by a join, and each word in neither table
falls back there once. So what is sent is bounded by these parameters and the number of languages, and they don't change
results. What a text gets depends on the text alone; predictions are made for each distinct text and joined to the rows.

Edge cases: words are runs of letters and combining marks, in lower case; a text that is null or has no letter is `und`
with score 0, as is every text if nothing can be learned; a null doc_id is neither trained on nor held out; languages
tied for a text go to the first in order of code points; repeated rows count as often as they stand; a very long text is
read in pieces cut between words; an empty table gives no rows; other columns don't matter, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.llm.common import _BYTE, free_name, id_filter, materialize, mix, powers, table

WORDS = 200_000
GRAMS = 200_000
NGRAM = 4
SMOOTH = 0.5
FLUSH = 400_000
CHUNK = 1 << 20
UNKNOWN = "und"
RUN = regex.compile(r"[\p{L}\p{M}]+")
MARK, LETTER = 1, 2


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


# ---- words and n-grams


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: LETTER, MARK or 0."""
    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{M}+", MARK)):
        for m in regex.finditer(name, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Signed 64-bit hash of each stretch of characters."""
    up, down = powers(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix(chars.astype(np.uint64) + _BYTE[0]) * up[: len(chars)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


class Words:
    """Words of some texts: `text` of each word, its hash, and which texts have a letter."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        self.joined = "\n".join(low)
        chars = _codes(self.joined)
        kind = _kinds()[chars]
        edge = np.diff((kind > 0).astype(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        at = np.array(list(accumulate((len(t) + 1 for t in low), initial=0)))
        self.text = np.searchsorted(at, self.starts, "right") - 1
        letters = np.concatenate([[0], np.cumsum(kind == LETTER)])
        self.letter = letters[at[1:] - 1] > letters[at[:-1]] if len(low) else np.zeros(0, bool)
        self.hashes = _hashes(chars, self.starts, self.ends)

    def word(self, i: int) -> str:
        return self.joined[self.starts[i] : self.ends[i]]


def _chunks(texts: list[str | None]):
    """(first row, texts) of about CHUNK characters; a longer text stands alone, in pieces cut between words."""
    lo, n = 0, len(texts)
    while lo < n:
        own = texts[lo] or ""
        if len(own) > CHUNK:
            pieces, at = [], 0
            while at < len(own):
                end = at + CHUNK
                while end < len(own) and _kinds()[ord(own[end])]:
                    end += 1
                pieces.append(own[at:end])
                at = end
            yield lo, pieces, True
            lo += 1
            continue
        hi, size = lo, 0
        while hi < n and size + len(texts[hi] or "") <= CHUNK:
            size += len(texts[hi] or "")
            hi += 1
        yield lo, [t or "" for t in texts[lo:hi]], False
        lo = hi


def _words_of(texts: list[str | None]):
    """(row of the first text, its Words, whether all are one text) for chunks of the texts."""
    for lo, own, one in _chunks(texts):
        if one:
            for piece in own:
                words = Words([piece])
                yield lo, words, True
        else:
            yield lo, Words(own), False


def _grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def _gram_hashes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word, and which word each is of."""
    padded = [f"^{w}$" for w in words] if n > 1 else words
    size = np.array([len(w) for w in padded], np.int64)
    count = np.maximum(size - n + 1, 0)
    owner = np.repeat(np.arange(len(words)), count)
    begin = np.cumsum(size) - size
    starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
    return _hashes(_codes("".join(padded)), starts, starts + n), owner


# ---- training


class Counts:
    """Words of one language with their counts, by hash, as arrays."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size = self.merged = 0

    def add(self, words: Words) -> None:
        h, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
        self.parts.append((h, counts, pa.array([words.word(i) for i in first.tolist()], pa.string())))
        self.size += len(h)
        if self.size > 2 * max(self.merged, FLUSH // 8):
            self.merge()

    def merge(self) -> None:
        if self.parts:
            h, first, inverse = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([p[1] for p in self.parts]), len(h)).astype(np.int64)
            self.parts = [(h, counts, pa.concat_arrays([p[2] for p in self.parts]).take(pa.array(first)))]
            self.size = self.merged = len(h)

    def rows(self, lang: str) -> pa.RecordBatch:
        self.merge()
        h, counts, words = self.parts[0]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h), words, pa.array(counts)], ["lang", "h", "item", "freq"])


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, h, item, freq) of the words of docs (lang, text)."""

    def run(batches):
        held: dict[str, Counts] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                own = held.setdefault(lang, Counts())
                for _, words, _ in _words_of(batch.column(1).filter(pa.array([x == lang for x in langs])).to_pylist()):
                    own.add(words)
                    if sum(c.merged for c in held.values()) > FLUSH:
                        yield from (c.rows(k) for k, c in held.items() if c.parts)
                        held.clear()
                        own = held.setdefault(lang, Counts())
        yield from (c.rows(k) for k, c in held.items() if c.parts)

    return docs.mapInArrow(run, "lang string, h long, item string, freq long").groupBy("lang", "h", "item").agg(F.sum("freq").alias("freq"))


def _gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """(lang, n, h, freq): how many distinct words of a language have an n-gram, as unseen words are more like rare ones."""
    names = ["lang", "n", "h", "freq"]

    def run(batches):
        for batch in batches:
            by: dict[str, list] = {}
            for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(word)
            for lang, own in by.items():
                for n in range(1, longest + 1):
                    h, counts = np.unique(_gram_hashes(own, n)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), n, np.int32)), pa.array(h), pa.array(counts.astype(np.int64))], names)

    return words.select("lang", "item").mapInArrow(run, "lang string, n int, h long, freq long").groupBy("lang", "n", "h").agg(F.sum("freq").alias("freq"))


def train(docs: DataFrame, words: int = WORDS, grams: int = GRAMS, longest: int = NGRAM) -> dict:
    """The model from rows (lang, text): languages, and for words (0) and n-grams (1, 2, ...) their log frequencies.

    heads has for each length hashes in order and logs of the frequent ones, tail is a DataFrame (n, h, logs) of all
    others, or None if there are none."""
    seen = materialize(_word_counts(docs.select("lang", "text")), "words")
    items = seen.select("lang", F.lit(0).alias("n"), "h", "freq").unionByName(materialize(_gram_counts(seen, longest), "grams"))
    totals = {(r["lang"], r["n"]): (r["total"], r["kinds"]) for r in items.groupBy("lang", "n").agg(F.sum("freq").alias("total"), F.count("*").alias("kinds")).collect()}
    langs = sorted({k[0] for k in totals})
    if not langs:
        return {"langs": [], "heads": [], "tail": None}
    # how many items have each frequency: enough to find the frequency that bounds the number of items kept
    spread = items.groupBy("lang", "n", "freq").agg(F.count("*").alias("k"))
    most = F.when(F.col("n") == 0, F.lit(words)).otherwise(F.lit(grams))
    floors = F.broadcast(_bounds(spread, most))  # a row for each language and length
    kept = F.coalesce(F.col("freq") >= F.col("floor"), F.lit(False))
    wide = items.join(floors, ["lang", "n"], "left").groupBy("n", "h").agg(F.max(kept).alias("head"), F.map_from_entries(F.collect_list(F.struct("lang", "freq"))).alias("freqs"))
    wide = materialize(wide, "wide")
    below = [[totals.get((c, n), (0, 0))[0] + SMOOTH * (totals.get((c, n), (0, 0))[1] + 1) for c in langs] for n in range(longest + 1)]
    names, under = F.array(*map(F.lit, langs)), F.array(*[F.array(*map(F.lit, row)) for row in below])
    log = lambda i: F.log((F.coalesce(F.try_element_at("freqs", F.get(names, i)), F.lit(0)) + SMOOTH) / F.get(F.get(under, F.col("n")), i))
    scored = wide.select("n", "h", "head", F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), log).alias("logs"))
    heads = []
    for n in range(longest + 1):
        rows = scored.filter(f"head and n = {n}").select("h", "logs").toArrow()  # at most words or grams items a language
        h = rows["h"].to_numpy()
        order = np.argsort(h)
        heads.append((h[order], rows["logs"].combine_chunks().flatten().to_numpy().reshape(-1, len(langs))[order]))
    tail = scored.filter("not head").select("n", "h", "logs")
    return {"langs": langs, "heads": heads, "tail": None if tail.isEmpty() else tail}


def _bounds(spread: DataFrame, most: Column) -> DataFrame:
    """(lang, n, floor): the least frequency whose items, with all more frequent ones, are at most `most`."""
    run = W.partitionBy("lang", "n").orderBy(F.desc("freq")).rowsBetween(W.unboundedPreceding, 0)
    return spread.withColumn("upto", F.sum("k").over(run)).filter(F.col("upto") <= most).groupBy("lang", "n").agg(F.min("freq").alias("floor"))


# ---- prediction


def _find(head: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where hashes stand in a head, and whether they do."""
    if not len(head[0]):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(head[0], h), len(head[0]) - 1)
    return at, head[0][at] == h


def _scan(texts: list[str | None], model: dict):
    """For each text: whether it has a letter, the logs of its words in the head summed, and its other words with their
    counts; and of those words the strings."""
    langs, n = len(model["langs"]), len(texts)
    letter, total = np.zeros(n, bool), np.zeros((n, langs))
    other: list[tuple] = []
    strings: dict[int, str] = {}
    for lo, words, one in _words_of(texts):
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        at, known = _find(model["heads"][0], distinct)
        size = len(words.letter)
        rows = slice(lo, lo + (1 if one else size))
        letter[rows] |= words.letter
        text = words.text
        hit = known[inverse]
        if hit.any():
            which = at[inverse[hit]]
            for c in range(langs):
                total[rows, c] += np.bincount(text[hit], model["heads"][0][1][which, c], size)
        if not hit.all():
            pair, times = np.unique(text[~hit] * len(distinct) + inverse[~hit], return_counts=True)
            other.append((lo + pair // len(distinct), distinct[pair % len(distinct)], times))
            for i in np.flatnonzero(~known).tolist():
                strings.setdefault(int(distinct[i]), words.word(first[i]))
    row, h, times = (np.concatenate([o[i] for o in other]) if other else np.zeros(0, np.int64) for i in range(3))
    return letter, total, row, h, times, strings


def _by_texts(docs: DataFrame, model: dict) -> DataFrame:
    """(k1, k2, lang_pred, score) of each distinct text of docs (k1, k2, text)."""
    sent = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("langs", "heads")})
    names = ["k1", "k2", "row", "letter", "part", "words", "times", "item"]

    def run(batches):
        """Each distinct text of a batch, then the words that are not in the head, by hash."""
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            once = list({k: i for i, k in enumerate(keys)}.values())
            if len(once) < len(keys):
                batch = batch.take(pa.array(once, pa.int64()))
            letter, total, at, h, times, strings = _scan(batch.column(2).to_pylist(), sent.value)
            order = np.argsort(at, kind="stable")
            offsets = pa.array(np.searchsorted(at[order], np.arange(len(once) + 1)).astype(np.int32))
            m, n = len(once), len(strings)
            parts = pa.ListArray.from_arrays(pa.array((np.arange(m + 1) * total.shape[1]).astype(np.int32)), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(row + np.arange(m)), pa.array(letter), parts, pa.ListArray.from_arrays(offsets, pa.array(h[order])), pa.ListArray.from_arrays(offsets, pa.array(times[order].astype(np.int32))), pa.nulls(m, pa.string())],
                names,
            )
            row += m
            nulls = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(strings.keys(), pa.int64()), *nulls, pa.array(strings.values(), pa.string())], names)

    langs = range(len(model["langs"]))
    # rows are numbered as they come: written once, so that they stay
    parts = materialize(docs.mapInArrow(run, "k1 long, k2 int, row long, letter boolean, part array<double>, words array<long>, times array<int>, item string"), "parts")
    asked = parts.filter("item is not null").select(F.col("k1").alias("h"), "item").distinct()
    answers = _answers(asked, model["tail"], sent)
    texts = parts.filter("row is not null")
    own = texts.select("row", "k1", "k2", "letter", *[F.get("part", F.lit(i)).alias(f"s{i}") for i in langs])
    more = texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("h"), F.col("x.times").alias("times"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("k1", "long"), ("k2", "int"), ("letter", "boolean"))]
    more = more.join(answers, "h").select("row", *none, *[(F.col("times") * F.get("logs", F.lit(i))).alias(f"s{i}") for i in langs])
    sums = own.unionByName(more).groupBy("row").agg(*[F.max(c).alias(c) for c in ("k1", "k2", "letter")], *[F.sum(f"s{i}").alias(f"s{i}") for i in langs])
    sums = sums.withColumn("t", F.array(*[f"s{i}" for i in langs]))
    best = F.array_max("t")
    pred = F.get(F.array(*map(F.lit, model["langs"])), (F.array_position("t", best) - 1).cast("int"))
    score = 1 / F.aggregate("t", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    told = sums.select("k1", "k2", F.when(F.col("letter"), pred).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letter"), score).otherwise(0.0).alias("score"))
    # a text that several batches hold has a row for each
    return told.groupBy("k1", "k2").agg(F.max(F.struct("lang_pred", "score")).alias("p")).select("k1", "k2", "p.*")


def _answers(asked: DataFrame, tail: DataFrame | None, sent) -> DataFrame:
    """(h, logs) of asked words (h, item): their own in the table, else those of their longest known n-grams."""
    if tail is None:
        return _by_grams(asked, tail, sent)
    known = materialize(asked.join(tail.filter("n = 0").select("h", "logs"), "h", "left").withColumn("item", F.when(F.col("logs").isNull(), F.col("item"))), "asked")
    return known.filter("logs is not null").select("h", "logs").unionByName(_by_grams(known.filter("logs is null").select("h", "item"), tail, sent))


def _by_grams(words: DataFrame, tail: DataFrame | None, sent) -> DataFrame:
    """(h, logs) of distinct words (h, item) never trained on: the mean over their longest known n-grams, sent or in the table."""
    names = ["h", "n", "k", "part", "grams"]

    def run(batches):
        heads = sent.value["heads"]
        for batch in batches:
            items, h = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            open_ = np.arange(len(items))
            for n in range(len(heads) - 1, 0, -1):
                if not len(open_):
                    break
                grams, owner = _gram_hashes([items[i] for i in open_.tolist()], n)
                at, known = _find(heads[n], grams)
                k = np.bincount(owner[known], minlength=len(open_))
                logs = heads[n][1]
                part = np.column_stack([np.bincount(owner[known], logs[at[known], c], len(open_)) for c in range(logs.shape[1])])
                offsets = np.searchsorted(owner[~known], np.arange(len(open_) + 1)).astype(np.int32)
                rows = pa.array((np.arange(len(open_) + 1) * part.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[open_]), pa.array(np.full(len(open_), n, np.int32)), pa.array(k.astype(np.int64)), pa.ListArray.from_arrays(rows, pa.array(part.ravel().astype(np.float64))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams[~known]))],
                    names,
                )
                open_ = open_[k == 0]  # a word with a known n-gram needs no shorter ones

    levels = words.select("h", "item").mapInArrow(run, "h long, n int, k long, part array<double>, grams array<long>")
    if tail is None:
        known = levels.filter("k > 0").select("h", "n", F.col("part").alias("total"), "k")
    else:
        levels = materialize(levels, "levels")
        asked = levels.select("h", "n", F.explode("grams").alias("gram"))
        found = asked.join(tail.filter("n > 0").select("n", F.col("h").alias("gram"), "logs"), ["n", "gram"])
        found = found.groupBy("h", "n").agg(F.collect_list("logs").alias("found"))
        total = F.when(F.col("found").isNull(), F.col("part")).otherwise(F.aggregate("found", F.col("part"), lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b)))
        known = levels.join(found, ["h", "n"], "left").select("h", "n", total.alias("total"), (F.col("k") + F.coalesce(F.size("found"), F.lit(0))).alias("k")).filter("k > 0")
    best = known.groupBy("h").agg(F.max_by(F.struct("total", "k"), "n").alias("b"))
    return best.select("h", F.transform("b.total", lambda x: x / F.col("b.k")).alias("logs"))


def _keys(text: Column) -> tuple[Column, Column]:
    """A text's name: 64 and 32 bits of two hashes."""
    return F.xxhash64(text), F.hash(text)


def predictions(docs: DataFrame, text: Column, model: dict) -> DataFrame:
    """(k1, k2, lang_pred, score) of each distinct text."""
    k1, k2 = _keys(text)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    if not model["langs"]:
        return rows.select("k1", "k2", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")).distinct()
    return _by_texts(rows, model)


def predict(docs: DataFrame, model: dict, text: str = "__text") -> DataFrame:
    """docs without the column of texts, with lang_pred and score, which take the place of columns so called."""
    columns = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    known = materialize(predictions(docs, F.col(text), model), "predictions")
    a, b = (free_name(docs.columns, c) for c in ("k1", "k2"))
    k1, k2 = _keys(F.col(text))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], k1.alias(a), k2.alias(b))
    # an inner join, as each text has its prediction: hot texts can be split
    return rows.join(known.withColumnsRenamed({"k1": a, "k2": b}), [a, b]).select(*columns, "lang_pred", "score")


class Scorer:
    """The same for single texts, from plain tables: for words (0) and n-grams (1, 2, ...) an index of strings and logs."""

    def __init__(self, model: dict):
        self.langs, self.tables = model["langs"], model["tables"]

    def word(self, word: str) -> np.ndarray:
        for n in range(len(self.tables)):
            n = -n % len(self.tables)
            index, logs = self.tables[n]
            known = [index[g] for g in ([word] if n == 0 else _grams(word, n)) if g in index]
            if known:
                return logs[known].mean(axis=0)
        return np.zeros(len(self.langs))

    def text(self, text: str | None) -> tuple[str, float]:
        found = Counter(RUN.findall((text or "").lower()))
        if not self.langs or not regex.search(r"\p{L}", text or ""):
            return UNKNOWN, 0.0
        total = sum((k * self.word(w) for w, k in found.items()), np.zeros(len(self.langs)))
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def train_on(docs: DataFrame) -> dict:
    return train(docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs (doc_id, text, lang)."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("__text"))
    return predict(rows, train_on(docs)).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose language is found with a score of at least `least`. Only rows that may have to go are shuffled."""
    text = F.col("text").cast("string")
    gone = predictions(docs, text, train_on(docs)).filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select("k1", "k2")
    gone = materialize(gone, "gone")
    held = docs.sparkSession.sparkContext.broadcast(id_filter(gone, F.col("k1")))
    a, b, c = (free_name(docs.columns, x) for x in ("k1", "k2", "gone"))
    k1, k2 = _keys(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for batch in batches:
            met = held.value.has(batch.column(batch.schema.get_field_index(a)).to_numpy())
            yield batch.append_column(c, pa.array(met))

    marked = docs.withColumn(a, k1).withColumn(b, k2).mapInArrow(run, f"{schema}, `{a}` long, `{b}` int, `{c}` boolean")
    maybe = marked.filter(F.col(c)).join(gone.withColumnsRenamed({"k1": a, "k2": b}), [a, b], "left_anti")
    columns = [F.col(f"`{x}`") for x in docs.columns]
    return marked.filter(~F.col(c)).select(*columns).unionByName(maybe.select(*columns))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
