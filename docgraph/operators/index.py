"""A stored search index: trigram postings of bodies, sorted words of fields, and bodies by slot.

Tables of an index's folder, each written once and read with partition filters:

    bodies  slot | id, body, block, ord, len, title_n, path and the columns kept, a row for each page
    grams   part | gram, block, n, ords: pages by the three characters that stand in their lower-cased body
    words   part | word, field, block, n, places (id, elem): pages by the words of their fields
    bounds  what each part of grams and words begins and ends with; stats: pages and words in all; shape: fields, slots

Pages are dealt to blocks of some BLOCK pages, and to slots of whole blocks; in a block they are numbered, so that postings
hold numbers of two bytes and are made block by block from the stored bodies, without dealing out single ids. Terms are dealt
to parts by range, so a word's parts are known from `bounds`, of which there is a row a part; the blocks of a term of very many
pages may lie in several parts. A body is followed by two marks, so that words of one or two characters are ranges of
trigrams. A longer word is looked up by its RARE rarest trigrams; what these leave is verified on the bodies, which are read
from the slots that hold them, or from all slots if it is more than SENT pages. All counts and statistics are exact.

Edge cases: null texts are empty; empty words find nothing; an empty table makes an empty index; page ids are
taken to be distinct, and a page with a null id is never found; other columns don't matter.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docgraph.functions import text as T
from docgraph.operators import search as S
from docgraph.sources.shared import cut, shared_dir

#: Pages for each part of terms and slot of bodies, parts and slots at most, pages of a block (numbered in two bytes), and how
#: many of a word's trigrams are read.
SHARE, PARTS, BLOCK, RARE = 20_000, 10_000, 16_000, 3
#: Slots that are named in a filter, and candidates that are sent to all tasks, at most.
SENT = 20_000
CHARS = 1 << 22
#: Bits of a character in a trigram's number, whose order is that of the characters.
BITS = 21
FIELDS = ("title", "summary", "aliases", "headings", "path")


def postings(lows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row), sorted: numbers of the distinct trigrams of lower-cased texts and the two marks after each."""
    ends = np.cumsum([len(t) + 2 for t in lows])
    c = np.frombuffer("".join(t + "\0\0" for t in lows).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(1 << BITS, bool)
    seen[c] = True
    chars = np.flatnonzero(seen)
    bits, rows = len(chars).bit_length(), len(lows).bit_length()
    if 3 * bits + rows > 63 and len(lows) > 1:  # more than 32,000 different characters
        half = len(lows) // 2
        (g, r), (h, q) = postings(lows[:half]), postings(lows[half:])
        gram, row = np.append(g, h), np.append(r, q + half)
        order = np.lexsort((row, gram))
        return gram[order], row[order]
    rows = min(rows, 63 - 3 * bits)  # the only row is 0
    code = (np.cumsum(seen) - 1)[c]
    inside = np.ones(len(c), bool)
    inside[ends - 1] = inside[ends - 2] = False
    row = np.repeat(np.arange(len(lows)), np.diff(ends, prepend=0))
    key = (((code[:-2] << 2 * bits) | (code[1:-1] << bits) | code[2:]) << rows | row[:-2])[inside[:-2]]
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    row, key, mask = key & ((1 << rows) - 1), key >> rows, (1 << bits) - 1
    return (chars[key >> 2 * bits] << 2 * BITS) | (chars[key >> bits & mask] << BITS) | chars[key & mask], row


def grams_of(low: str) -> np.ndarray:
    """Numbers of the distinct trigrams of a lower-cased text and the two marks after it."""
    return postings([low])[0]


def _span(word: str) -> tuple[int, int]:
    """The numbers of the trigrams that begin with a word of up to three characters."""
    low = 0
    for k in range(3):
        low = low << BITS | (ord(word[k]) if k < len(word) else 0)
    return low, low + (1 << BITS * (3 - len(word))) - 1


def _element(field: str):
    return lambda text, i: F.struct(F.lit(field).alias("field"), i.alias("elem"), F.coalesce(text, F.lit("")).alias("text"))


def _block(id_: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")


def _store(rows: DataFrame, by: list[str], path: str, parts: int) -> DataFrame:
    """Write rows sorted and dealt by range to `parts` parts; gives the bounds (part, first, last) of the first column."""
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    dealt.write.partitionBy("part").parquet(path)
    return rows.sparkSession.read.schema(dealt.schema).parquet(path).groupBy("part").agg(F.min(by[0]).cast("string").alias("first"), F.max(by[0]).cast("string").alias("last"))


@dataclass(frozen=True)
class Index:
    """A stored index; `fields` tells which fields it has."""

    spark: SparkSession
    folder: str
    fields: tuple[str, ...]
    slots: int
    blocks: int
    kind: str
    page: StructType
    bounds: dict[str, list[tuple[int, str, str]]]

    @classmethod
    def build(cls, pages: DataFrame, fields: S.Fields, keep: tuple[str, ...] = (), folder: str | None = None, parts: int | None = None, slots: int | None = None, block: int = BLOCK) -> Index:
        """The index of pages, in a new folder under the shared one; keep: columns that searches filter or order by.

        parts and slots: one for SHARE pages each, and so many at least; block: pages of a block, 16,000 at most."""
        spark = pages.sparkSession
        folder = folder or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        has = [f for f in FIELDS if getattr(fields, f)]
        body = F.coalesce(F.col(fields.body).cast("string"), F.lit("")) if fields.body else F.lit("")
        rows = pages.select(F.col(fields.id).alias("id"), body.alias("body"), *[F.col(getattr(fields, f)).alias(f"f_{f}") for f in has], *keep)
        n = pages.count()
        blocks, share = 1 + n // min(block, BLOCK), min(PARTS, 1 + n // SHARE)
        parts, slots = max(parts or 1, share), max(slots or 1, share)
        title = F.size(F.array_distinct(T.field_words(F.coalesce(F.col("f_title").cast("string"), F.lit(""))))) if fields.title else F.lit(0)
        path = F.lower("f_path") if fields.path else F.lit(None).cast("string")
        own = F.when(F.col("id").isNotNull(), _block(F.col("id"), blocks)).otherwise(_block(F.col("body"), blocks))
        dealt = rows.withColumn("block", own).withColumn("slot", F.pmod("block", F.lit(slots)).cast("int")).repartition("slot", "block")
        dealt = dealt.withColumn("ord", (F.dense_rank().over(W.partitionBy("slot", "block").orderBy("id")) - 1).cast("smallint"))
        stored = dealt.select("id", "body", "block", "ord", T.word_count("body").cast("long").alias("len"), title.alias("title_n"), path.alias("path_low"), *keep, "slot")
        stored.write.partitionBy("slot").parquet(f"{folder}/bodies")
        bodies = spark.read.schema(stored.schema).parquet(f"{folder}/bodies")
        bodies.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).write.parquet(f"{folder}/stats")

        kind = rows.schema["id"].dataType.simpleString()

        def spread(batches):
            for batch in batches:
                block_, ord_, lows, at = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), 0
                while at < len(lows):
                    to, size = at, 0
                    while to < len(lows) and block_[to] == block_[at] and (to == at or size + len(lows[to]) <= CHARS):
                        size += len(lows[to])
                        to += 1
                    gram, row = postings(lows[at:to])
                    head = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
                    ends = np.append(head, len(row))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ord_[at:to][row], pa.int16()))
                    yield pa.RecordBatch.from_arrays([pa.array(gram[head]), pa.array(np.full(len(head), block_[at]), pa.int32()), pa.array(np.diff(ends), pa.int32()), lists], ["gram", "block", "n", "ords"])
                    at = to

        # written before they are dealt by range, which reads its rows twice
        grams = cut(bodies.filter("id is not null").select("block", "ord", F.lower("body")).mapInArrow(spread, "gram long, block int, n int, ords array<smallint>"))
        bounds = _store(grams, ["gram", "block"], f"{folder}/grams", parts).select(F.lit("grams").alias("table"), "*")
        if has:
            texts = [
                F.transform(F.array(F.col(f"f_{f}").cast("string")) if f not in ("aliases", "headings") else F.coalesce(F.col(f"f_{f}"), F.array().cast("array<string>")), _element(f))
                for f in has
            ]
            said = rows.select("id", F.explode(F.concat(*texts)).alias("x")).select("id", "x.*")
            word = F.when(F.col("field") == "path", F.array(F.lower(T.basename("text")))).otherwise(F.array_distinct(T.field_words("text")))
            said = said.select("field", "id", "elem", F.explode(word).alias("word")).filter("word <> ''")
            words = said.groupBy("word", "field", _block(F.col("id"), blocks).alias("block")).agg(F.array_sort(F.collect_set(F.struct("id", "elem"))).alias("places"))
            own = _store(words.select("word", "field", "block", F.size("places").alias("n"), "places"), ["word", "field", "block"], f"{folder}/words", parts)
            bounds = bounds.unionByName(own.select(F.lit("words").alias("table"), "*"))
        bounds.coalesce(1).write.parquet(f"{folder}/bounds")
        spark.createDataFrame([(has, slots, blocks, kind, stored.schema.json())], "fields array<string>, slots int, blocks int, kind string, page string").coalesce(1).write.parquet(f"{folder}/shape")
        return cls.open(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        """An index that was built before."""
        bounds: dict[str, list] = {"grams": [], "words": []}
        for r in spark.read.parquet(f"{folder}/bounds").collect():  # a row for each part
            bounds[r["table"]].append((r["part"], r["first"], r["last"]))
        shape = spark.read.parquet(f"{folder}/shape").first()
        return cls(spark, folder, tuple(shape["fields"]), shape["slots"], shape["blocks"], shape["kind"], StructType.fromJson(json.loads(shape["page"])), bounds)

    def table(self, name: str) -> DataFrame:
        """A table of the folder; docs: bodies without their texts."""
        if name == "docs":
            return self.table("bodies").drop("body", "slot")
        schemas = {
            "grams": "gram long, block int, n int, ords array<smallint>, part int",
            "words": f"word string, field string, block int, n int, places array<struct<id: {self.kind}, elem: int>>, part int",
            "bodies": self.page,
        }
        read = self.spark.read.schema(schemas[name]) if name in schemas else self.spark.read
        return read.parquet(f"{self.folder}/{name}")

    def _grams(self, spans: list[tuple[int, int]]) -> DataFrame:
        """Postings of the trigrams within spans of numbers, out of the parts that may hold them."""
        parts = sorted({p for p, first, last in self.bounds["grams"] for lo, hi in spans if int(first) <= hi and lo <= int(last)})
        single = [lo for lo, hi in spans if lo == hi]
        hit = reduce(lambda a, b: a | b, [F.col("gram").between(lo, hi) for lo, hi in spans if lo < hi], F.col("gram").isin(single))
        return self.table("grams").filter(F.col("part").isin(parts) & hit)

    def _words(self, prefixes: list[str], whole: list[str]) -> DataFrame:
        """Words that begin with a prefix or are one of `whole`, out of the parts that may hold them."""
        spans = [(p.encode(), p.encode() + b"\xff") for p in prefixes] + [(w.encode(), w.encode()) for w in whole]
        parts = sorted({p for p, first, last in self.bounds["words"] for lo, hi in spans if first.encode() <= hi and lo <= last.encode()})
        hit = reduce(lambda a, b: a | b, [F.col("word").startswith(p) for p in prefixes], F.col("word").isin(whole))
        return self.table("words").filter(F.col("part").isin(parts) & hit)

    def candidates(self, tokens: list[str]) -> DataFrame:
        """(id): pages whose bodies hold all the rarest trigrams of any token, or a token of up to three characters."""
        spans = {t: [_span(t)] if len(t) <= 3 else [(g, g) for g in {(ord(a) << 2 * BITS) | (ord(b) << BITS) | ord(c) for a, b, c in zip(t, t[1:], t[2:])}] for t in tokens}
        if long := [s for t in spans if len(t) > 3 for s in spans[t]]:
            pages = dict(self._grams(long).groupBy("gram").agg(F.sum("n")).collect())  # a row for each trigram of the query
            for t in spans:
                if len(t) > 3:
                    spans[t] = sorted(spans[t], key=lambda s: (pages.get(s[0], 0), s))[:RARE]
        kept = {t: own for t, own in spans.items() if own}
        if not kept:
            return self.table("docs").select("id").limit(0)
        rows = self._grams(sorted({s for own in kept.values() for s in own})).select("gram", "block", F.explode("ords").alias("ord"))
        seen = [F.count_if(reduce(lambda a, b: a | b, [F.col("gram").between(lo, hi) for lo, hi in own])) >= (1 if len(t) <= 3 else len(own)) for t, own in kept.items()]
        found = rows.groupBy("block", "ord").agg(reduce(lambda a, b: a | b, seen).alias("any")).filter("any")
        return self.table("docs").filter("id is not null").join(found, ["block", "ord"], "left_semi").select("id")

    def _many(self, tokens: list[str]) -> bool:
        """Whether one trigram that begins with a token of up to three characters stands on more than SENT pages alone."""
        short = [_span(t) for t in tokens if 0 < len(t) <= 3]
        return bool(short) and (self._grams(short).groupBy("gram").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > SENT

    def bodies(self, ids: DataFrame) -> DataFrame:
        """(id, body) of some pages, SENT at most: they are sent to all tasks and read from their slots alone."""
        slot = F.pmod(_block(F.col("id"), self.blocks), F.lit(self.slots)).cast("int")
        held = [r[0] for r in ids.select(slot.alias("s")).distinct().collect()]  # as many as there are slots, at most
        return self.table("bodies").filter(F.col("slot").isin(held)).join(F.broadcast(ids.distinct()), "id", "left_semi").select("id", "body")

    def counts(self, tokens: list[str], where: Column | None = None) -> DataFrame:
        """(id, tf_0, tf_1, ...): how often the bodies hold each token, for pages that hold any; where: on kept columns.

        Few candidates are read from their slots; if they are many, the bodies are read where they lie and none is dealt out."""
        rows = self.table("bodies").filter("id is not null") if where is None else self.table("bodies").filter(F.col("id").isNotNull() & where)
        if where is not None or not self._many(tokens):
            found = self.candidates(tokens)
            found = cut(found if where is None else found.join(self.table("docs").filter(where).select("id"), "id", "left_semi"))
            if found.limit(SENT + 1).count() <= SENT:
                rows = self.bodies(found)
        rows = rows.withColumn("low", F.lower("body")).select("id", *[T.occurrences(F.col("low"), t).alias(f"tf_{i}") for i, t in enumerate(tokens)])
        rows = rows.groupBy("id").agg(*[F.sum(f"tf_{i}").cast("int").alias(f"tf_{i}") for i in range(len(tokens))])
        return rows.filter(reduce(lambda a, b: a | b, [F.col(f"tf_{i}") > 0 for i in range(len(tokens))], F.lit(False)))

    def weights(self, tokens: list[str], prompt: bool = False) -> DataFrame:
        """(id, w_0, file_0, w_1, ...): what the fields give for each token, for pages that any field names."""
        wanted, parts_of = S.query_words(tokens), [S.query_words([t]) for t in tokens]
        parts = sorted({p for own in parts_of for p in own})
        files = {t: t.rpartition("/")[2] for t in tokens if "." in t.rpartition("/")[2]} if "path" in self.fields and not prompt else {}
        rows = self._words(parts, sorted(set(files.values()))).select("word", "field", F.explode("places").alias("x")).select("word", "field", "x.id", "x.elem")
        plain = F.col("field") != "path"
        begins = [F.max(plain & F.col("word").startswith(p)).alias(f"p_{k}") for k, p in enumerate(parts)]
        exact = [F.max((F.col("field") == "title") & (F.col("word") == w)).alias(f"e_{k}") for k, w in enumerate(wanted)]
        named = [F.max((F.col("field") == "path") & (F.col("word") == files[t])).alias(f"n_{i}") if t in files else F.lit(False).alias(f"n_{i}") for i, t in enumerate(tokens)]
        rows = rows.groupBy("field", "id", "elem").agg(*begins, *exact, *named)
        weight = {"title": S.NAME, "summary": S.SUMMARY, "aliases": S.ALIAS, "headings": S.HEADING}
        hits = [reduce(lambda a, b: a & b, [F.col(f"p_{parts.index(p)}") for p in own], plain) for own in parts_of]
        # of several aliases or headings the best counts, which is one hit
        whole = reduce(lambda a, b: a & b, [F.max(f"e_{k}") for k in range(len(wanted))], F.lit(bool(wanted)))
        flags = [F.max(F.when((F.col("field") == f) & hits[i], 1).otherwise(0)).alias(f"h_{f}_{i}") for f in weight if f in self.fields for i in range(len(tokens))]
        rows = rows.groupBy("id").agg(whole.alias("whole"), *flags, *[F.max(f"n_{i}").alias(f"n_{i}") for i in range(len(tokens))])
        rows = rows.join(self.table("docs").select("id", "title_n", "path_low"), "id")
        title = F.when(F.col("whole") & (F.col("title_n") == len(wanted)), S.TITLE).otherwise(0.0) if "title" in self.fields else F.lit(0.0)
        out = [(reduce(lambda a, b: a + b, [w * F.col(f"h_{f}_{i}") for f, w in weight.items() if f in self.fields], F.lit(0.0)) + title).alias(f"w_{i}") for i in range(len(tokens))]
        return rows.select("id", *out, *[(F.col(f"n_{i}") & F.coalesce(T.names_file(F.col("path_low"), F.lit(t)), F.lit(False))).alias(f"file_{i}") for i, t in enumerate(tokens)])

    def search(self, query: str, limit: int = 10, rank: str | None = None, digits: int | None = None, terms: int | None = None, prompt: bool = False, where: Column | None = None) -> DataFrame:
        """id, score and snippet of the best pages, as search.search() over the pages gives them; where: on kept columns."""
        tokens = S.query_tokens(query)
        if prompt:
            tokens, terms = [t for t in tokens if len(t) > 1], terms or S.PROMPT_TERMS
        docs = self.table("docs") if where is None else self.table("docs").filter(where)
        if not tokens:
            return docs.limit(0).select("id", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("snippet"))
        k = len(tokens)
        said = self.counts(tokens, where)
        rows = self.weights(tokens, prompt).join(said, "id", "full") if self.fields else said.select("id", *[x for i in range(k) for x in (F.lit(0.0).alias(f"w_{i}"), F.lit(False).alias(f"file_{i}"))], *[f"tf_{i}" for i in range(k)])
        rows = rows.join(docs.select("id", "len", *([rank] if rank else [])), "id")
        numbers = [x for i in range(k) for x in (F.coalesce(f"w_{i}", F.lit(0.0)).alias(f"w_{i}"), F.coalesce(f"tf_{i}", F.lit(0)).alias(f"tf_{i}"), F.coalesce(f"file_{i}", F.lit(False)).alias(f"file_{i}"))]
        rows = rows.select("id", "len", *([rank] if rank else []), *numbers)
        rows = cut(rows.withColumns({f"hit_{i}": (F.col(f"w_{i}") > 0) | (F.col(f"tf_{i}") > 0) | F.col(f"file_{i}") for i in range(k)}))
        sizes = self.table("stats") if where is None else docs.agg(F.count("*").alias("n"), F.sum("len").alias("total"))
        stats = S.statistics(rows, k).drop("n", "total").crossJoin(F.broadcast(sizes))  # one row each
        order = [F.desc("score"), *([F.desc(rank)] if rank else []), F.asc("id")]
        top = S.scored(rows, stats, k, terms, digits).orderBy(*order).limit(limit).select("id", "score", *([rank] if rank else []))
        top = cut(top)
        shown = self.bodies(top.select("id")).select("id", T.snippet(F.col("body"), tokens).alias("snippet"))
        return top.join(F.broadcast(shown), "id", "left").orderBy(*order).select("id", "score", "snippet")
