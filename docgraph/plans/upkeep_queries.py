"""Queries for resolution, upkeep and outlines on the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators import catalog as C
from docgraph.operators import graph as G
from docgraph.operators import identity as I
from docgraph.operators import readers
from docgraph.operators import resolve as R
from docgraph.sources import files as S
from docgraph.sources.adapter import conversation_pages, places, table


def _site(spark, sf):
    """pages as files (id, path, title, kind, memory)."""
    p = table(spark, sf, "pages")
    path = F.regexp_replace("url", r"^[a-z]+://|/?[?#].*$|/$", "")
    return p.select(F.col("page_id").cast("string").alias("id"), path.alias("path"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), (F.col("page_id") % 5 == 0).alias("memory"))


_SITE = "p as (select page_id::varchar as id, regexp_replace(url, '^[a-z]+://|/?[?#].*$|/$', '', 'g') as path, 'Page ' || page_id as title, page_id % 5 = 0 as memory from pages)"


def _parts(spark, sf):
    """part as items of pages (brands)."""
    kind = F.when(F.col("p_size") % 3 == 0, "type").when(F.col("p_size") % 3 == 1, "fn").otherwise("value")
    owner = F.when(F.col("p_size") % 4 == 0, F.substring_index("p_type", " ", 1))
    return table(spark, sf, "part").select(F.col("p_brand").alias("page_id"), F.col("p_partkey").alias("start_line"), F.col("p_partkey").alias("end_line"), kind.alias("kind"), F.col("p_name").alias("name"), owner.alias("owner"), F.concat_ws(" ", kind, F.col("p_name")).alias("signature"), (F.col("p_partkey") % 2 == 0).alias("public"))


_PARTS = """i as (select p_brand as page_id, p_partkey as line, case p_size % 3 when 0 then 'type' when 1 then 'fn' else 'value' end as kind, p_name as name,
        case when p_size % 4 = 0 then string_split(p_type, ' ')[1] end as owner, p_partkey % 2 = 0 as public from part)"""


def code_mention_filter(spark, sf):
    part = table(spark, sf, "part")
    stem = F.substring_index("p_name", " ", 1)
    mark = F.when(F.col("p_partkey") % 4 == 0, "::new").when(F.col("p_partkey") % 4 == 1, ".rs").otherwise(" of")
    pages = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, "code:rust").otherwise("text").alias("kind"), F.concat(F.lit("src/"), stem, F.lit(".rs")).alias("path"), F.concat(F.lit("see "), stem, mark).alias("body"))
    said = part.select((F.col("p_partkey") % 7 + 1).alias("dst"), F.col("p_partkey").alias("src"))
    return G.code_mentions(said, pages)


def source_targets(spark, sf):
    p = _site(spark, sf)
    depth = F.size(F.split("path", "/"))
    said = p.select("path", F.concat(F.when(F.col("memory"), "$HOME/").otherwise(""), F.substring_index("path", "/", -2)).alias("literal")).unionByName(p.filter(depth > 1).select("path", F.concat(F.lit("./"), F.substring_index("path", "/", -1)).alias("literal")))
    return R.source_join(said, p)


def candidate_ids(spark, sf):
    return R.candidate_ids(_site(spark, sf), "missing/en/page 7.html")


def caller_counts(spark, sf):
    li = table(spark, sf, "lineitem")
    calls = li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_partkey") + 1).alias("twin"))
    return R.caller_count(calls, part, table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("id")))


def stem_pages(spark, sf):
    names = table(spark, sf, "pages").select(F.upper(F.col("page_id").cast("string")).alias("name"))
    return R.stem_pages(_site(spark, sf), names)


def names_not_found(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.explode(T.field_words("text")).alias("name")).distinct()
    items = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("name"), F.col("p_name").alias("qualified"))
    return R.not_found(asked, items, _site(spark, sf))


def agreed_types(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_tax") < 0.08, F.col("l_returnflag")).alias("kind"))
    return R.agreed(li, ["l_orderkey"], "kind")


def stale_kept(spark, sf):
    written = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    live = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return C.stale_pages(written, live, table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("id")))


def outside_roots(spark, sf):
    p = _site(spark, sf)
    return C.outside(p.withColumn("path", F.concat_ws("/", F.when(F.col("memory"), "notes"), "path")), ["notes", "x"]).select("id")


def union_once(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), "c_custkey").filter("c_custkey % 25 = 3").groupBy("key").agg(F.min("name").alias("name"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return C.once([c, n], "key")


def exports_of(spark, sf):
    return C.exports(_parts(spark, sf)).select("page_id", F.array_join("exports", "|").alias("exports"))


def owner_runs(spark, sf):
    return C.owner_runs(_parts(spark, sf)).select("page_id", "start_line", "header")


def lint_totals(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, "code:python").otherwise("text").alias("kind"), F.col("text").alias("body"))
    return C.lint_totals(d)


def carried_notes(spark, sf):
    c = table(spark, sf, "conversations")
    written = c.filter("turn = 0").select(F.col("conv_id").alias("source"), F.concat(F.lit("# T\n\n## Notes\n\n"), F.when(F.col("conv_id") % 4 == 0, "_none yet_").otherwise(F.col("role"))).alias("page"))
    return C.with_notes(c.select(F.col("conv_id").alias("source")).distinct(), written)


def include_closure(spark, sf):
    _, edges = places(spark, sf)
    return G.closure(edges).groupBy("id").agg(F.count("*").alias("reached"))


def map_slugs(spark, sf):
    c = table(spark, sf, "customer").select(F.concat_ws("::", "c_mktsegment", "c_name").alias("name")).unionByName(table(spark, sf, "region").select(F.lit("--").alias("name")))
    return c.distinct().select("name", T.map_slug("name").alias("slug"))


def unfenced(spark, sf):
    d = table(spark, sf, "documents").filter("text not like '%`%'").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "```py\n").otherwise(""), "text", F.lit("\n```")).alias("body"))
    return d.select("doc_id", T.unfence("body").alias("body"))


def content_texts(spark, sf):
    pages = conversation_pages(spark, sf).select("path", F.col("text").alias("body"))
    kept = readers.content_text(readers.sections(pages), ("user 0", "assistant 1"))
    return kept.select("path", F.length(F.regexp_replace("text", r"\s+", "")).cast("long").alias("size"))


def reserved_ids(spark, sf):
    n = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") == 0, "index").when(F.col("n_nationkey") == 1, "index_page").when(F.col("n_nationkey") == 2, "graph").when(F.col("n_nationkey") == 3, "index_page_2").otherwise(F.lower("n_name")).alias("id"), "n_nationkey")
    return I.remap_reserved(n).select("n_nationkey", "id")


def relevant_changes(spark, sf):
    p = _site(spark, sf)
    changes = p.filter("id % 2 = 0").select("path").unionByName(p.select(F.concat("path", F.lit(".md")).alias("path"))).unionByName(p.select(F.concat("path", F.lit("/new/x.md")).alias("path"))).unionByName(p.select(F.concat("path", F.lit(".log")).alias("path")))
    return S.relevant(changes, p.filter("not memory"), ["md"])


def ignored_counts(spark, sf):
    p = table(spark, sf, "part").select(F.concat_ws("/", F.element_at(F.array(F.lit("src"), F.lit("vendor"), F.lit("a/third_party"), F.lit("out")), (F.col("p_size") % 4 + 1).cast("int")), "p_name").alias("path"))
    return S.skipped(p, p.filter("path not like 'out/%'"))


QUERIES = {
    "code_mention_filter": (code_mention_filter, """
        with p as (select p_partkey as id, p_size > 5 as code, p_partkey % 4 as k, string_split(p_name, ' ')[1] as stem from part)
        select s.id as src, d.id as dst from p s join p d on d.id = s.id % 7 + 1 where not d.code or s.stem = d.stem and s.k in (0, 1)"""),
    "source_targets": (source_targets, f"""
        with {_SITE}, f as (select *, string_split(path, '/') as s from p),
        said as (select path, s, memory, case when memory then '$HOME/' else '' end || array_to_string(s[-2:], '/') as literal, array_to_string(s[-2:], '/') as tail from f
          union select path, s, false, './' || s[-1], s[-1] from f where len(s) > 1),
        ends as (select tail, min(path) as target from (select distinct path, array_to_string(s[k:], '/') as tail from (select path, s, unnest(range(1, len(s) + 1)) as k from f)) group by tail having count(distinct path) = 1)
        select distinct path, literal, target from (
          select a.path, a.literal, coalesce(r.path, b.path, e.target) as target from said a
          left join p r on not a.memory and r.path = a.tail left join p b on not a.memory and b.path = array_to_string(list_concat(a.s[:-2], [a.tail]), '/') left join ends e on e.tail = a.tail)
        where target is not null"""),
    "candidate_ids": (candidate_ids, f"""
        with {_SITE}, t as (select id, case when ends_with(lower(path), '/missing/en/page 7.html') then 1 when string_split(lower(path), '/')[-1] = 'page 7.html' then 2 else 3 end as tier from p)
        select id from t where tier = (select min(tier) from t) order by id limit 5"""),
    "caller_counts": (caller_counts, """
        select p_partkey as id, count(distinct l_suppkey) as callers from part join lineitem on l_partkey = p_partkey or p_size > 25 and l_partkey = p_partkey + 1
        where l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by 1"""),
    "stem_pages": (stem_pages, f"with {_SITE}, n as (select distinct page_id::varchar as name from pages) select name, id from n join p on lower(string_split(string_split(path, '/')[-1], '.')[1]) = lower(name) where not memory"),
    "names_not_found": (names_not_found, rf"""
        with {_SITE}, a as (select distinct unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) as name from benchmark)
        select name from a where name not in (select unnest(string_split(p_name, ' ')) from part) and name not in (select lower(string_split(string_split(path, '/')[-1], '.')[1]) from p where not memory)"""),
    "agreed_types": (agreed_types, """
        select l_orderkey, min(k) as kind from (select l_orderkey, case when l_tax < 0.08 then l_returnflag end as k from lineitem) group by 1
        having count(distinct k) = 1 and count(*) = count(k)"""),
    "stale_kept": (stale_kept, "select c_custkey as id from customer where c_custkey not in (select o_custkey from orders) and c_acctbal <= 9000"),
    "outside_roots": (outside_roots, f"with {_SITE} select id from p where not memory"),
    "union_once": (union_once, "select n_nationkey as key, coalesce((select min(c_name) from customer where c_nationkey = n_nationkey and c_custkey % 25 = 3), n_name) as name from nation"),
    "exports_of": (exports_of, f"""
        with {_PARTS}, d as (select distinct page_id, coalesce(owner, name) as g, case when owner is not null then 3 when kind = 'type' then 0 when kind = 'fn' then 1 else 2 end as k, name, kind || ' ' || name as s from i where public),
        f as (select *, row_number() over (partition by page_id, s order by g, k, name) as rn from d)
        select page_id, string_agg(s, '|' order by g, k, name, s) as exports from f where rn = 1 group by page_id"""),
    "owner_runs": (owner_runs, f"""
        with {_PARTS} select page_id, line as start_line, case when owner is not null and coalesce(lag(owner) over (partition by page_id order by line), '') <> owner then owner end as header from i"""),
    "lint_totals": (lint_totals, "select count(*) as pages, count_if(doc_id % 3 = 0)::bigint as code, count_if(doc_id % 3 <> 0 and (length(text) + 7) // 4 > 4000)::bigint as large from documents"),
    "carried_notes": (carried_notes, "select conv_id as source, max(case when turn = 0 and conv_id % 4 <> 0 then role end) as notes from conversations group by 1"),
    "include_closure": (include_closure, """
        with recursive e as (select 'c' || c_custkey as src, 'n' || c_nationkey as dst from customer union select 's' || s_suppkey, 'n' || s_nationkey from supplier union select 'n' || n_nationkey, 'r' || n_regionkey from nation),
        r(id, node) as (select src, dst from e union select r.id, e.dst from r join e on e.src = r.node) select id, count(*) as reached from r group by id"""),
    "map_slugs": (map_slugs, "select name, case when s = '' then 'fn' else s end as slug from (select name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') as s from (select c_mktsegment || '::' || c_name as name from customer union select '--'))"),
    "unfenced": (unfenced, "select doc_id, case when doc_id % 2 = 0 then text else text || chr(10) || '```' end as body from documents where text not like '%`%'"),
    "content_texts": (content_texts, r"""
        select 'chats/conv_' || conv_id || '.md' as path, sum(length(regexp_replace(text, '\s+', '', 'g')))::bigint as size from conversations
        where role || ' ' || turn not in ('user 0', 'assistant 1') group by conv_id"""),
    "reserved_ids": (reserved_ids, "select n_nationkey, case n_nationkey when 0 then 'index_page_3' when 1 then 'index_page' when 2 then 'graph_page' when 3 then 'index_page_2' else lower(n_name) end as id from nation"),
    "relevant_changes": (relevant_changes, f"""
        with {_SITE}, k as (select path from p where not memory), s as (select path, string_split(path, '/') as s from k),
        f as (select distinct array_to_string(s[:n], '/') as path from (select s, unnest(range(0, len(s))) as n from s)),
        c as (select path from p where id::bigint % 2 = 0 union select path || '.md' from p union select path || '/new/x.md' from p union select path || '.log' from p)
        select distinct path from c where path in (select path from k) or path in (select path from f where path <> '')
          or ends_with(path, '.md') and array_to_string(string_split(path, '/')[:-2], '/') in (select path from f)"""),
    "ignored_counts": (ignored_counts, """
        select rule, count(*) as files from (select distinct p_size % 4 as k, p_name, case p_size % 4 when 1 then 'vendor' when 2 then 'third_party' when 3 then 'ignored' end as rule, p_partkey from part) where rule is not null group by rule"""),
}
