"""Queries for ranked search, each with the SQL that checks it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.functions.dates import dated_on, query_dates
from docgraph.operators import graph as G
from docgraph.operators import search as S
from docgraph.sources.adapter import conversation_pages, table, text_pages

QUERY = "eren the erer thion"
BODY = S.Fields(id="doc_id", body="text")


def _top(rows):
    return rows.select("doc_id", "score")


def bm25_body_topk(spark, sf):
    return S.search(table(spark, sf, "documents"), QUERY, BODY, limit=20, digits=6).select("doc_id", "score")


def bm25_filtered_stats(spark, sf):
    return S.search(table(spark, sf, "documents").filter("lang = 'fr'"), "eau que ment", BODY, limit=20, digits=6).select("doc_id", "score")


def _bm25(terms: list[str], where: str) -> str:
    tf = ", ".join(f"((length(t) - length(replace(t, '{w}', ''))) // {len(w)})::double as tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count_if(tf{i} > 0) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * case when tf{i} > 0 then tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / (total / n))) else 0 end" for i in range(len(terms)))
    hit = " or ".join(f"tf{i} > 0" for i in range(len(terms)))
    return rf"""
        with d as (select doc_id, lower(text) as t, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::double as l from documents where {where}),
        f as (select doc_id, l, {tf} from d), s as (select count(*)::double as n, sum(l) as total, {df} from f)
        select doc_id, round({score}, 6) as score from f, s where {hit} order by score desc, doc_id limit 20"""


PART = S.Fields(id="p_partkey", title="p_name", aliases="alias", summary="p_type")


def field_weighted_search(spark, sf):
    p = table(spark, sf, "part").withColumn("alias", F.array("p_brand"))
    return S.search(p, "red bolt small", PART, limit=50, digits=6).select("p_partkey", "score")


def _field_sql() -> str:
    words = ["red", "bolt", "small"]
    w = ", ".join(
        f"""case when exists_title_{x} then 3.0 else 0 end + case when whole then 3.0 else 0 end
          + case when len(list_filter(b, lambda x: starts_with(x, '{x}'))) > 0 then 2.0 else 0 end + case when len(list_filter(y, lambda x: starts_with(x, '{x}'))) > 0 then 1.5 else 0 end as w{i}"""
        for i, x in enumerate(words)
    )
    flags = ", ".join(f"len(list_filter(a, lambda x: starts_with(x, '{x}'))) > 0 as exists_title_{x}" for x in words)
    df = ", ".join(f"count_if(w{i} > 0) as df{i}" for i in range(3))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * w{i}" for i in range(3))
    return rf"""
        with p as (select p_partkey, regexp_extract_all(lower(p_name), '[\p{{L}}\p{{N}}]+') as a, regexp_extract_all(lower(p_brand), '[\p{{L}}\p{{N}}]+') as b, regexp_extract_all(lower(p_type), '[\p{{L}}\p{{N}}]+') as y from part),
        q as (select *, {flags}, list_sort(list_distinct(a)) = ['bolt', 'red', 'small'] as whole from p),
        f as (select p_partkey, {w} from q), s as (select count(*)::double as n, {df} from f)
        select p_partkey, round({score}, 6) as score from f, s where w0 > 0 or w1 > 0 or w2 > 0 order by score desc, p_partkey limit 50"""


def rarest_terms_cut(spark, sf):
    return S.search(table(spark, sf, "documents"), "the of erer thion eren zzzz", BODY, limit=20, digits=6, terms=3).select("doc_id", "score")


def _rarest_sql() -> str:
    terms = ["the", "of", "erer", "thion", "eren", "zzzz"]
    tf = ", ".join(f"((length(t) - length(replace(t, '{w}', ''))) // {len(w)})::double as tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count_if(tf{i} > 0) as df{i}" for i in range(6))
    rows = " union all ".join(f"select {i} as i, df{i} as df from s" for i in range(6))
    score = " + ".join(f"(case when {i} in (select i from kept) then ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) else 0 end) * case when tf{i} > 0 then tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / (total / n))) else 0 end" for i in range(6))
    hit = " or ".join(f"tf{i} > 0" for i in range(6))
    return rf"""
        with d as (select doc_id, lower(text) as t, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::double as l from documents),
        f as (select doc_id, l, {tf} from d), s as (select count(*)::double as n, sum(l) as total, {df} from f),
        kept as (select i from ({rows}) where df > 0 order by df, i limit 3)
        select doc_id, round({score}, 6) as score from f, s where {hit} order by score desc, doc_id limit 20"""


def names_file_boost(spark, sf):
    p = table(spark, sf, "pages").withColumn("path", F.concat(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), F.lit(".html")))
    return S.search(p, "25.html en/685.html", S.Fields(id="page_id", path="path"), limit=20, digits=6).select("page_id", "score")


_NAMES_SQL = r"""
    with p as (select page_id, lower(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') || '.html') as path from pages),
    f as (select page_id, ends_with(path, '/25.html') as a, ends_with(path, '/en/685.html') as b from p),
    s as (select count(*)::double as n, count_if(a)::double as na, count_if(b)::double as nb from f)
    select page_id, round(6.0 * (case when a then ln(1 + (n - na + 0.5) / (na + 0.5)) / sqrt(na) else 0 end + case when b then ln(1 + (n - nb + 0.5) / (nb + 0.5)) / sqrt(nb) else 0 end), 6) as score
    from f, s where a or b order by score desc, page_id limit 20"""


def title_and_subset_sets(spark, sf):
    whole, inside, more = S.word_sets(T.field_words("p_name"), F.array(F.lit("bolt"), F.lit("red")))
    return table(spark, sf, "part").select("p_partkey", whole.alias("whole"), inside.alias("inside"), more.cast("long").alias("more"))


def top3_per_page(spark, sf):
    i = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), "l_linenumber", "l_partkey"]
    return S.top_per_group(i, ["l_orderkey"], order, 3).select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.col("rn").cast("long").alias("rn"))


def relative_cut(spark, sf):
    i = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_extendedprice").alias("score"))
    return S.relative_cut(i, "l_orderkey", "score", 0.9)


def doc_dedupe(spark, sf):
    i = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("doc"))
    return S.doc_once(i, ["l_orderkey"], "doc", ["l_partkey"])


def dated_token(spark, sf):
    o = table(spark, sf, "orders")
    days = query_dates("shipped 1998-10-03 or 28.05.1997, also 4 July and May 5 1996")
    return o.filter(dated_on(F.col("o_orderdate"), days)).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def notes_tail(spark, sf):
    n = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("double").alias("score"), F.lit(None).cast("date").alias("updated"), (F.col("item_id") % 7 == 0).alias("superseded"), F.when(F.col("item_id") % 2 == 0, 1.0).otherwise(0.5).alias("trust"), "text")
    return S.notes_tail(n, "then what", 100.0, ["text"]).select("id", "score", "trust")


#: Items of a benchmark that are sent together.
ITEMS = 20_000


def _shared_words(docs, items, k):
    """item_id, doc_id and n: how many distinct words they share, for at least the k best documents of each item.

    The items' words are sent to all tasks, ITEMS items (more or less) at a time, each of which passes over the documents once."""
    groups = -(-items.count() // ITEMS)
    parts = [_shared_with(docs, items.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g), k) for g in range(groups)]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else items.select("item_id", F.col("item_id").alias("doc_id"), F.lit(0).cast("long").alias("n")).limit(0)


def _shared_with(docs, items, k):
    rows = items.select("item_id", F.array_distinct(T.field_words(F.coalesce("text", F.lit("")))).alias("words")).orderBy("item_id").collect()
    ids, postings = np.array([r.item_id for r in rows], np.int64), {}
    for i, r in enumerate(rows):
        for w in r.words:
            postings.setdefault(w, []).append(i)
    sent = docs.sparkSession.sparkContext.broadcast((ids, {w: np.array(p, np.int64) for w, p in postings.items()}))

    def run(batches):
        ids, postings = sent.value
        block = max(1, (4 << 20) // max(1, len(ids)))
        for whole in batches:
            for lo in range(0, len(whole), block):
                batch = whole.slice(lo, block)
                doc = batch.column(0).to_numpy(zero_copy_only=False)
                n = np.zeros((len(doc), len(ids)), np.int64)
                for row, words in zip(n, batch.column(1).to_pylist()):
                    own = [postings[w] for w in words if w in postings]
                    if own:
                        row += np.bincount(np.concatenate(own), minlength=len(ids))
                by = np.argsort(doc, kind="stable")
                best = by[np.argsort(-n[by], axis=0, kind="stable")[:k]]
                item = np.broadcast_to(np.arange(len(ids)), best.shape)
                best, item = best.ravel(), item.ravel()
                hit = n[best, item] > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[item[hit]]), pa.array(doc[best[hit]]), pa.array(n[best, item][hit])], ["item_id", "doc_id", "n"])

    words = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.array_distinct(T.field_words("text")).alias("words"))
    return words.mapInArrow(run, "item_id long, doc_id long, n long")


def date_token_search(spark, sf):
    """Orders as notes of their day: a date in the query is a word of its own."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", (F.col("o_custkey") % 2 == 0).alias("note"))
    return S.search(o, "urgent 1998-07-03", S.Fields(id="o_orderkey", title="o_orderpriority"), limit=40, digits=6, dated=("o_orderdate", "note")).select("o_orderkey", "score")


def hint_rows(spark, sf):
    """Lines of orders as items of pages: two a page and eight in all."""
    li = table(spark, sf, "lineitem").filter("l_orderkey < 40").select(F.col("l_orderkey").alias("page_id"), F.col("l_orderkey").alias("page_rank"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("rn"), (F.col("l_partkey") % 50).alias("start_line"), (F.col("l_partkey") % 50 + F.col("l_quantity").cast("int") % 30).alias("end_line"), (F.col("l_tax") > 0.07).alias("test"), (F.col("l_discount") > 0.09).alias("nested"))
    return S.hint_rows(li).select("page_id", F.col("rn").cast("long").alias("rn"), F.col("start_line").cast("long").alias("start_line"))


def eval_mrr_whole(spark, sf):
    """Each benchmark item as a query of all its words; the documents that hold its whole text are the expected ones."""
    items, docs = table(spark, sf, "benchmark").select("item_id", "text"), table(spark, sf, "documents").select("doc_id", "text")
    hits = S.top_per_group(_shared_words(docs, items, 10), ["item_id"], [F.desc("n"), "doc_id"], 10).select(F.col("item_id").alias("query"), F.col("doc_id").alias("id"), F.col("rn").alias("rank"))
    whole = items.select(F.col("item_id").alias("query"), F.regexp_replace("text", r"\s+", " ").alias("part"))
    texts = docs.select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"\s+", " ").alias("t"))
    holding = texts.join(F.broadcast(hits), "id").join(F.broadcast(whole), "query").filter(F.contains("t", "part"))
    expected = holding.groupBy("query").agg(F.min_by("id", "rank").alias("expected"))
    cases = items.select(F.col("item_id").alias("query")).join(expected, "query", "left")
    return S.reciprocal_rank(hits, cases).select(F.round("top1", 6).alias("top1"), F.round("mrr", 6).alias("mrr"))


_EVAL_SQL = r"""
    with w as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from benchmark),
    d as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from documents where doc_id is not null),
    h as (select item_id, doc_id, count(*) as n from w join d using (w) group by all),
    r as (select *, row_number() over (partition by item_id order by n desc, doc_id) as rn from h),
    f as (select r.item_id, min(rn) as rank from r join documents using (doc_id) join benchmark b on b.item_id = r.item_id
      where rn <= 10 and contains(regexp_replace(documents.text, '\s+', ' ', 'g'), regexp_replace(b.text, '\s+', ' ', 'g')) group by r.item_id)
    select round(avg(case when rank = 1 then 1.0 else 0.0 end), 6) as top1, round(avg(coalesce(1.0 / rank, 0)), 6) as mrr from benchmark left join f using (item_id)"""


def label_search(spark, sf):
    from docgraph.operators import labels as L

    return L.search(L.labels(conversation_pages(spark, sf)), "assistant 3", limit=500).select("doc", F.col("start").cast("long").alias("start"), "label")


def doc_label_rows(spark, sf):
    from docgraph.operators import labels as L

    d = text_pages(spark, sf).filter(F.contains("body", F.lit(" | "))).select("path", F.concat(F.lit("| "), F.regexp_replace("body", "\n", "\n| ")).alias("text"))
    return L.table_rows(d, "the").select("doc", F.col("line").cast("long").alias("line"))


QUERIES = {
    "bm25_body_topk": (bm25_body_topk, _bm25(["eren", "the", "erer", "thion"], "true")),
    "bm25_filtered_stats": (bm25_filtered_stats, _bm25(["eau", "que", "ment"], "lang = 'fr'")),
    "field_weighted_search": (field_weighted_search, _field_sql()),
    "rarest_terms_cut": (rarest_terms_cut, _rarest_sql()),
    "names_file_boost": (names_file_boost, _NAMES_SQL),
    "title_and_subset_sets": (title_and_subset_sets, "select p_partkey, list_sort(list_distinct(w)) = ['bolt', 'red'] as whole, list_contains(w, 'bolt') and list_contains(w, 'red') as inside, len(list_filter(list_distinct(w), lambda x: x not in ('bolt', 'red')))::bigint as more from (select p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') as w from part)"),
    "top3_per_page": (top3_per_page, "select * from (select l_orderkey, l_partkey, l_linenumber, l_extendedprice, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) as rn from lineitem) where rn <= 3"),
    "relative_cut": (relative_cut, """
        with s as (select l_orderkey, l_suppkey, max(l_extendedprice) as score from lineitem group by all)
        select l_orderkey, l_suppkey, score from (select *, max(score) over (partition by l_orderkey) as own, max(score) over () as best from s) where score >= own or score >= 0.9 * best"""),
    "doc_dedupe": (doc_dedupe, """
        with s as (select l_orderkey, l_partkey, min(l_returnflag) as doc from lineitem group by all)
        select l_orderkey, l_partkey, case when row_number() over (partition by l_orderkey, doc order by l_partkey) = 1 then doc end as doc from s"""),
    "dated_token": (dated_token, "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders where o_orderdate::date in (date '1998-10-03', date '1997-05-28', date '1996-05-05') or (month(o_orderdate) = 7 and day(o_orderdate) = 4)"),
    "notes_tail": (notes_tail, r"""
        select id, score, trust from (
          select item_id as id, length(text)::double as score, case when item_id % 2 = 0 then 1.0::double else 0.5::double end as trust from benchmark
          where item_id % 7 <> 0 and (length(text) >= 200 or len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: starts_with(x, 'then') or starts_with(x, 'what'))) > 0)
          order by score desc, id limit 10)
        order by trust desc, score desc, id limit 2"""),
    "eval_mrr": (eval_mrr_whole, _EVAL_SQL),
    "date_token_search": (date_token_search, """
        with f as (select o_orderkey, o_orderpriority = '1-URGENT' as a, o_custkey % 2 = 0 and o_orderdate::date = date '1998-07-03' as b from orders),
        s as (select count(*)::double as n, count_if(a)::double as na, count_if(b)::double as nb from f)
        select o_orderkey, round(3.0 * (case when a then ln(1 + (n - na + 0.5) / (na + 0.5)) else 0 end + case when b then ln(1 + (n - nb + 0.5) / (nb + 0.5)) else 0 end), 6) as score
        from f, s where a or b order by score desc, o_orderkey limit 40"""),
    "hint_rows": (hint_rows, """
        with l as (select l_orderkey as page_id, l_linenumber * 1000000 + l_partkey as rn, l_partkey % 50 as a, l_partkey % 50 + trunc(l_quantity)::bigint % 30 as b from lineitem where l_orderkey < 40 and not l_tax > 0.07 and not l_discount > 0.09),
        k as (select *, row_number() over (partition by page_id order by rn) as place from l x where not exists (select 1 from l y where y.page_id = x.page_id and y.rn <> x.rn and x.a <= y.a and y.b <= x.b))
        select page_id, place as rn, a as start_line from k where place <= 2 order by page_id, place limit 8"""),
    "label_search": (label_search, """
        with s as (select conv_id, turn, role, length(text) - length(replace(text, chr(10), '')) + 1 as n from conversations),
        l as (select *, coalesce(sum(n + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) + 1 as start from s)
        select 'chats/conv_' || conv_id || '.md' as doc, start::bigint as start, role || ' ' || turn as label from l where role = 'assistant' and turn = 3
        order by doc, start limit 500"""),
    "doc_label_rows": (doc_label_rows, r"""
        select 'docs/' || source || '/' || lang || '/doc_' || doc_id || '.txt' as doc, i::bigint as line
        from (select *, unnest(string_split(text, chr(10))) as r, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where contains(text, ' | '))
        where contains(' ' || array_to_string(list_transform(regexp_extract_all(lower(r), '[\p{L}\p{N}_.\-]+'), lambda x: x), ' ') || ' ', ' the ')"""),
}
