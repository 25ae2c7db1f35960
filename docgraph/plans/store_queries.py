"""Queries over what is stored between questions: the index, the catalog's generations, the live loop; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators import delta as D
from docgraph.operators.automaton import count_words
from docgraph.operators.index import Index
from docgraph.plans.search_queries import BODY, PART, _bm25, _field_sql
from docgraph.sources.adapter import table
from docgraph.sources.shared import shared_dir
from docgraph.sources.store import Store
from docgraph.streaming.live import run_live

RARE = "eren thi er q thion"


def bm25_by_index(spark, sf):
    """bm25_body_topk from an index, with words of one to five characters."""
    index = Index.build(table(spark, sf, "documents"), BODY, parts=16, slots=16, block=2000)
    return index.search(RARE, limit=20, digits=6).select(F.col("id").alias("doc_id"), "score")


def bm25_by_index_filtered(spark, sf):
    """The same over the pages of a language, whose statistics are their own."""
    index = Index.build(table(spark, sf, "documents"), BODY, keep=("lang",), parts=16, slots=16, block=2000)
    return index.search("eau que ment", limit=20, digits=6, where=F.col("lang") == "fr").select(F.col("id").alias("doc_id"), "score")


def fields_by_index(spark, sf):
    """field_weighted_search from an index."""
    index = Index.build(table(spark, sf, "part").withColumn("alias", F.array("p_brand")), PART, parts=8, slots=4, block=500)
    return index.search("red bolt small", limit=50, digits=6).select(F.col("id").alias("p_partkey"), "score")


def words_in_documents(spark, sf):
    """All words of all benchmark items in all documents: documents that hold one, occurrences, and the sum of the first places."""
    words = table(spark, sf, "benchmark").select(F.explode(T.field_words(F.coalesce("text", F.lit("")))).alias("word"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return count_words(docs, words).groupBy("word").agg(F.count("*").alias("docs"), F.sum("n").alias("times"), F.sum("first").alias("offsets"))


def delta_build(spark, sf):
    """The catalog of documents after two builds: pages came, went and changed in between."""
    d = table(spark, sf, "documents").filter("doc_id is not null")
    body = F.concat(F.lit("[a]("), (F.col("doc_id") + 1).cast("string"), F.lit(".md) [b]("), (F.col("doc_id") * 7 % 1000).cast("string"), F.lit(".md)\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("]("), F.lit("]")))
    pages = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), body.alias("body"))
    first = pages.filter("id % 11 <> 3").withColumn("body", F.when(F.col("id") % 37 == 2, F.lit("[c](../d/2.md)")).otherwise(F.col("body"))).withColumn("title", F.when(F.col("id") % 41 == 5, F.concat(F.lit("Old "), "title")).otherwise(F.col("title")))
    store = Store(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}", D.KEYS)
    D.build(store, first)
    D.build(store, pages.filter("id % 10 <> 4"))
    return store.read("rendered").select(F.col("id").alias("doc_id"), "title", F.sha2("body", 256).alias("body"), F.array_join("linked", "|").alias("linked"), F.array_join("linking", "|").alias("linking"))


_DELTA_SQL = """
    with d as (select doc_id, 'Doc ' || doc_id as title, '[a](' || (doc_id + 1) || '.md) [b](' || (doc_id * 7 % 1000) || '.md)' || chr(10) || replace(coalesce(text, ''), '](', ']') as body from documents where doc_id % 10 <> 4),
    e as (select distinct src, dst from (select doc_id as src, doc_id + 1 as dst from d union all select doc_id, doc_id * 7 % 1000 from d) where src <> dst),
    o as (select src, string_agg('Doc ' || dst, '|' order by 'Doc ' || dst) as linked from e where dst in (select doc_id from d) group by src),
    i as (select dst, string_agg('Doc ' || src, '|' order by 'Doc ' || src) as linking from e group by dst)
    select doc_id, title, sha256(body) as body, coalesce(linked, '') as linked, coalesce(linking, '') as linking from d left join o on src = doc_id left join i on dst = doc_id"""

#: Hours of quiet that end a run of edits, hours that one may last, hours that a question waits.
QUIET, CAP, WAIT = 6, 24, 5
HOUR = 3_600_000


def live_compiles(spark, sf):
    """Events as edits of their user's pages, views as questions: compiles and answers of a stream that is stopped half way."""
    e = table(spark, sf, "events").filter("user_id is not null and ts is not null").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "view").alias("edit"))
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    root = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    if low is None:
        return spark.createDataFrame([], "key string, kind string, at long, started long, ended long, n long, generation long, stale boolean")
    step = (high - low) / 4
    for k in range(4):
        part = e.filter(F.col("ts") >= low + k * step) if k == 3 else e.filter((F.col("ts") >= low + k * step) & (F.col("ts") < low + (k + 1) * step))
        part.write.mode("append").parquet(f"{root}/in")
        if k == 1:
            run_live(spark, f"{root}/in", f"{root}/out", f"{root}/state", QUIET * HOUR, CAP * HOUR, WAIT * HOUR, late="10 days").awaitTermination()
    # a far event moves the watermark past all that is due
    spark.createDataFrame([("", high + 400 * step, True)], e.schema).write.mode("append").parquet(f"{root}/in")
    run_live(spark, f"{root}/in", f"{root}/out", f"{root}/state", QUIET * HOUR, CAP * HOUR, WAIT * HOUR, late="10 days").awaitTermination()
    return spark.read.schema("key string, kind string, at long, started long, ended long, n long, generation long, stale boolean").parquet(f"{root}/out")


_LIVE_SQL = f"""
    with recursive e as (select user_id::varchar as key, epoch_us(ts) // 1000 as ms, row_number() over (partition by user_id order by ts, event_id) as i from events where event_type <> 'view'),
    w as (
      select key, i, ms, ms as first, least(ms + {QUIET * HOUR}, ms + {CAP * HOUR}) as due, 1 as batch from e where i = 1
      union all
      select e.key, e.i, e.ms, case when e.ms >= w.due then e.ms else w.first end, least(e.ms + {QUIET * HOUR}, case when e.ms >= w.due then e.ms else w.first end + {CAP * HOUR}), w.batch + (e.ms >= w.due)::int
      from w join e on e.key = w.key and e.i = w.i + 1),
    b as (select key, batch, min(ms) as started, max(ms) as ended, count(*) as n, max(due) as due, max(i) as generation from w group by all),
    q as (select user_id::varchar as key, epoch_us(ts) // 1000 as t, event_id from events where event_type = 'view'),
    a as (select q.key, q.t, q.event_id, b.due, b.n, b.generation from q asof left join b on q.key = b.key and q.t >= b.started)
    select key, 'compile' as kind, due as "at", started, ended, n, generation, false as stale from b
    union all
    select key, 'answer', case when due is null or due <= t then t when due <= t + {WAIT * HOUR} then due else t + {WAIT * HOUR} end, t, null, null,
      case when due is null then 0 when due <= t + {WAIT * HOUR} then generation else generation - n end, coalesce(due > t + {WAIT * HOUR}, false) from a"""


QUERIES = {
    "bm25_by_index": (bm25_by_index, _bm25(RARE.split(), "true")),
    "bm25_by_index_filtered": (bm25_by_index_filtered, _bm25(["eau", "que", "ment"], "lang = 'fr'")),
    "fields_by_index": (fields_by_index, _field_sql()),
    "words_in_documents": (words_in_documents, r"""
        with w as (select distinct unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as word from benchmark), d as (select lower(text) as t from documents where text is not null)
        select word, count(*) as docs, sum((length(t) - length(replace(t, word, ''))) // length(word))::bigint as times, sum(instr(t, word) - 1)::bigint as offsets from w join d on contains(t, word) group by word"""),
    "delta_build": (delta_build, _DELTA_SQL),
    "live_compiles": (live_compiles, _LIVE_SQL),
}
