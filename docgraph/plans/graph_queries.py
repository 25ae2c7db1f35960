"""Queries for joins, graphs, windows, identity and streams, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators import catalog as C
from docgraph.operators import flow
from docgraph.operators import graph as G
from docgraph.operators import identity as I
from docgraph.operators import labels as L
from docgraph.operators import resolve as R
from docgraph.sources.adapter import places, table, transitions
from docgraph.streaming.sessions import sessions


def pagerank_40(spark, sf):
    nodes, edges = places(spark, sf)
    return G.pagerank(nodes, edges).select("id", F.round("rank", 6).alias("rank"))


_NODES = """nodes as (select 'c' || c_custkey as id from customer union all select 's' || s_suppkey from supplier union all select 'n' || n_nationkey from nation union all select 'r' || r_regionkey from region),
    e as (select 'c' || c_custkey as src, 'n' || c_nationkey as dst from customer union select 's' || s_suppkey, 'n' || s_nationkey from supplier union select 'n' || n_nationkey, 'r' || n_regionkey from nation)"""
_PAGERANK = f"""
    with recursive {_NODES},
    od as (select src, count(*) d from e group by 1), nn as (select count(*)::double n from nodes),
    pr(it, id, rank) as (
      select 0, id, 1.0::double / (select n from nn) from nodes
      union all
      select it + 1, id, 0.15 / (select n from nn) + 0.85 * sum(c) from (
        select p.it, x.id, 0.0::double c from nodes x, (select distinct it from pr) p
        union all select p.it, e.dst, p.rank / od.d from pr p join e on e.src = p.id join od on od.src = p.id
        union all select z.it, x.id, z.m / (select n from nn) from nodes x, (select it, sum(case when id not in (select src from od) then rank else 0 end) m from pr group by it) z
      ) where it < 40 group by it, id)
    select id, round(rank, 6) as rank from pr where it = 40"""


def bfs_neighborhood(spark, sf):
    _, edges = places(spark, sf)
    return G.neighbourhood(spark.createDataFrame([("n3",)], "id string"), edges, 2).select("id", F.col("level").cast("long").alias("level"))


def callee_closure(spark, sf):
    return G.callees(spark.createDataFrame([("click",)], "id string"), transitions(spark, sf).filter("src < dst")).select("id", F.col("level").cast("long").alias("level"), "via")


def callers_depth1(spark, sf):
    return G.callers(spark.createDataFrame([("view",)], "id string"), transitions(spark, sf)).select("id", "via")


def degree(spark, sf):
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return G.degrees(e)


def orphans(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return G.orphans(p, table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


def link_edges(spark, sf):
    """Pages whose links are written as Markdown: each page is the one at the first link of the page before it, too."""
    p = table(spark, sf, "pages")
    hrefs = F.filter(F.regexp_extract_all("html", F.lit('href="(/[a-zA-Z]+)"'), F.lit(1)), lambda h: h != "")
    body = F.array_join(F.transform(hrefs, lambda h: F.concat(F.lit("[x]("), h, F.lit(")"))), " ")
    own = p.select("page_id", F.get(hrefs, F.lit(0)).alias("first")).filter("first is not null").select((F.col("page_id") + 1).alias("page_id"), F.substring("first", 2, 999).alias("own"))
    rows = p.select("page_id", body.alias("body")).join(own, "page_id", "left")
    return G.link_edges(rows.select(F.col("page_id").alias("id"), F.coalesce("own", F.concat(F.lit("p/"), F.col("page_id").cast("string"))).alias("path"), "body"))


def _runs_of_items(spark, sf, length):
    """(id, name): every run of `length` words of each benchmark item, as a name of the item."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}0-9']+"), F.lit(0))
    items = table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("id"), length.cast("int").alias("n"), words.alias("w")).filter("size(w) >= n")
    return items.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("name"))


def mention_ngram_join(spark, sf):
    """Documents that hold five words in a row of a benchmark item."""
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return G.mentions(pages, _runs_of_items(spark, sf, F.lit(5)))


def mention_longest(spark, sf):
    """The same with runs of one to six words as names, of which the longest at each word counts."""
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return G.mentions(pages, _runs_of_items(spark, sf, 1 + F.col("item_id") % 6))


def mention_long_names(spark, sf):
    """The same with names of one to twenty-one words."""
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return G.mentions(pages, _runs_of_items(spark, sf, 1 + 5 * (F.col("item_id") % 5)))


def free_numbers(spark, sf):
    """Parts as pages of a few names, of which a third end in a number that others would be given."""
    p = table(spark, sf, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), (F.col("p_partkey") % 400).cast("string"))).otherwise("")
    pages = p.select(F.concat(F.lit("Lot "), (F.col("p_size") % 7).cast("string"), tail).alias("name"), F.concat(F.lit("lots/"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("path"))
    return I.assign(pages).select("path", "id")


#: One page after the other takes the first number that is free.
_FREE_SQL = """
        with recursive p as (select 'lots/' || lpad(p_partkey::varchar, 12, '0') as path, 'lot_' || p_size % 7 || case when p_partkey % 3 = 0 then '_' || p_partkey % 400 else '' end as slug from part),
        o as (select *, row_number() over (partition by slug order by path) as k, count(*) over (partition by slug) as n from p),
        h as (select s.slug, list(distinct try_cast(substr(t.slug, length(s.slug) + 2) as bigint)) as held from (select distinct slug from o where n > 1) s join (select distinct slug from p) t on starts_with(t.slug, s.slug || '_') and regexp_full_match(substr(t.slug, length(s.slug) + 2), '[2-9]|[1-9][0-9]+') group by s.slug),
        w as (
          select slug, path, k, slug as id, 1::bigint as last from o where k = 1
          union all
          select o.slug, o.path, o.k, o.slug || '_' || x.m, x.m from w join o on o.slug = w.slug and o.k = w.k + 1 left join h on h.slug = o.slug,
            lateral (select list_min(list_filter(range(w.last + 1, w.last + len(coalesce(h.held, [])) + 2), lambda v: not list_contains(coalesce(h.held, []), v))) as m) x)
        select path, id from w"""


_RUNS = r"""
        it as (select -1 - item_id as dst, {n} as n, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}0-9'']+') as w from benchmark),
        n as (select n, phrase, min(dst) as dst from (select dst, n, array_to_string(w[i : i + n - 1], ' ') as phrase from (select *, unnest(range(1, len(w) - n + 2)) as i from it where len(w) >= n)) group by all),
        d as (select doc_id as src, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}0-9'']+') as w from documents),
        g as (select src, i, k as n, array_to_string(w[i : i + k - 1], ' ') as phrase from (select src, w, unnest(range(1, len(w) + 1)) as i from d) cross join (select distinct n as k from it) where i + k - 1 <= len(w)),
        h as (select src, i, arg_max(n.dst, n.n) as dst from g join n using (n, phrase) group by src, i)
        select distinct src, dst from h"""


def suffix_join(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "").alias("path"))
    wanted = p.select(F.substring_index("path", "/", -2).alias("include")).distinct()
    return R.suffix_join(wanted, p)


def min_rank_pick(spark, sf):
    p = table(spark, sf, "part").withColumn("rank", F.col("p_size") % 5)
    return R.least_rank(p, "p_name", "p_partkey", "rank", "p_brand", "p_partkey")


def unique_key_pairing(spark, sf):
    left = table(spark, sf, "part").select(F.col("p_partkey").alias("a"), "p_name", F.col("p_size").alias("k"))
    right = table(spark, sf, "part").select(F.col("p_partkey").alias("b"), "p_name", (F.col("p_size") + 1).alias("k"))
    return R.pair_unique(left, right, ["p_name", "k"], "a", "b")


def same_name(spark, sf):
    i = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("page_id"), F.concat_ws("/", "p_name", "p_type", F.col("p_size").cast("string")).alias("name"))
    return R.same_name(i)


def defined_fold(spark, sf):
    p = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), ((F.col("p_partkey") * 7919 / 13).cast("long") % 4).alias("rank"))
    return R.defined_fold(p)


def tiered_resolution(spark, sf):
    """Each order line's supplier by tier: of the customer's nation, else of its region, else the only one left."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n"))
    n = table(spark, sf, "nation")
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("n_regionkey").alias("s_region"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    rows = o.join(c, "o_custkey").join(n.select(F.col("n_nationkey").alias("n"), "n_regionkey"), "n").join(lines, "o_orderkey").join(s, "s_suppkey")
    rows = rows.withColumn("tier", F.when(F.col("s_nationkey") == F.col("n"), 1).when(F.col("s_region") == F.col("n_regionkey"), 2).otherwise(3).cast("long"))
    return R.first_tier(rows, ["o_orderkey"], only=[3]).select("o_orderkey", "s_suppkey", "tier")


def supersedes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    n = o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("id"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("slug"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.array().cast("array<string>").alias("aliases"),
        F.array(F.concat(F.lit("ORDER "), (F.col("o_orderkey") + 1 + F.col("o_custkey") % 2 * 50).cast("string"))).alias("supersedes"),
        (F.col("o_custkey") % 3 != 0).alias("local"),
    )
    return R.supersedes(n)


def prior_page(spark, sf):
    written = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("file"))
    return C.prior_pages(table(spark, sf, "customer").select(F.col("c_custkey").alias("source"), (F.col("c_custkey") * 3).alias("file")), written)


def anti_stale(spark, sf):
    live = table(spark, sf, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("id"))
    return C.stale_pages(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), live).select(F.col("id").alias("c_custkey"))


def anti_broken(spark, sf):
    names = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("slug")).distinct()
    links = F.array_join(F.transform(T.field_words("text"), lambda w: F.concat(F.lit("[["), w, F.lit("]]"))), " ")
    pages = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), links.alias("body"))
    return C.broken_links(pages, names.select(F.col("slug").alias("id"))).groupBy(F.col("id").alias("item_id")).agg(F.count("*").alias("broken"))


def label_end(spark, sf):
    c = table(spark, sf, "conversations").withColumn("level", F.when(F.col("role") == "user", 1).otherwise(2)).withColumn("last", F.lit(999).cast("long"))
    return G.next_at_most(c.select("conv_id", "turn", "level", "last"), ["conv_id"], "turn", "level", "last").select("conv_id", "turn", "ends")


def repeated_label_cut(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "role", "turn")
    return L.alternate(c, ["conv_id", "role"], ["turn"], 3).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


def budget_prefix(spark, sf):
    d = table(spark, sf, "documents").withColumn("size", T.token_estimate("text"))
    return G.longest_prefix(d.select("source", "doc_id", "size"), ["source"], [F.desc("size"), F.col("doc_id")], F.col("size"), 4000).select("source", "doc_id", "used")


def greedy_admission(spark, sf):
    d = table(spark, sf, "documents").withColumn("size", T.token_estimate("text"))
    return G.greedy(d, ["source"], ["doc_id"], "size", 2000).select("source", "doc_id")


def median_split(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return G.median_split(s, "s_acctbal").select("s_suppkey", "upper")


def strict_winner(spark, sf):
    return R.strict_winner(table(spark, sf, "part").select("p_name", "p_partkey", "p_size"), "p_name", ["p_size"], "p_partkey").withColumn("winner", F.coalesce("winner", F.lit(-1).cast("long")))


def id_collisions(spark, sf):
    p = table(spark, sf, "part").withColumn("slug", T.slugify("p_name"))
    return I.ordinals(p, "slug", ["p_partkey"]).select("p_partkey", "id")


def innermost_span(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("site"), (F.col("event_id") % 1000).cast("long").alias("line"))
    spans = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("page_id"), F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 900).alias("start"), (F.col("o_orderkey") % 900 + 20 + F.col("o_custkey") % 200).alias("end"))
    return G.innermost(e, spans).select("page_id", "site", "item")


def debounce_sessions(spark, sf):
    return sessions(table(spark, sf, "events"), "ts", ["user_id"], "30 minutes").select("user_id", "started", "n")


def coverage_pivot(spark, sf):
    return flow.counts_by(table(spark, sf, "events"), ["user_id"], "event_type", ("click", "error", "purchase", "signup", "view"))


def target_form(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_discount") > 0.08, F.col("l_suppkey"))).alias("c"), F.max(F.col("l_tax") > 0.07).alias("open"))
    return li.select("l_orderkey", R.target_form(F.col("c"), F.col("open")).alias("form"))


def sees(spark, sf):
    nodes, edges = places(spark, sf)
    return G.sees(edges, nodes).groupBy("id").agg(F.count("*").alias("n"))


QUERIES = {
    "pagerank_40": (pagerank_40, _PAGERANK),
    "bfs_neighborhood": (bfs_neighborhood, f"""
        with recursive {_NODES}, b as (select src, dst from e union select dst, src from e),
        w(id, level) as (select 'n3', 0 union select b.dst, level + 1 from w join b on b.src = w.id where level < 2)
        select id, min(level)::bigint as level from w group by id"""),
    "callee_closure": (callee_closure, """
        with recursive t as (select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events),
        e as (select distinct src, dst from t where src < dst), w(id, level) as (select 'click', 0 union select e.dst, level + 1 from w join e on e.src = w.id),
        l as (select id, min(level) as level from w group by id)
        select l.id, l.level::bigint as level, min(p.id) as via from l join e on e.dst = l.id join l p on p.id = e.src and p.level = l.level - 1 where l.level > 0 group by all"""),
    "callers_depth1": (callers_depth1, """
        select distinct src as id, 'view' as via from (select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events) where dst = 'view' and src <> 'view'"""),
    "degree": (degree, """
        with e as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem)
        select id, sum(i)::bigint as degree_in, sum(o)::bigint as degree_out from (select src as id, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by id"""),
    "orphans": (orphans, "select p_partkey as id from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 48)"),
    "link_edges": (link_edges, r"""
        with h as (select page_id, regexp_extract_all(html, 'href="(/[a-zA-Z]+)"', 1) as h from pages),
        p as (select a.page_id as id, coalesce(substr(b.h[1], 2), 'p/' || a.page_id) as path, a.h from h a left join h b on b.page_id + 1 = a.page_id),
        t as (select path, max(id) as dst from p group by path)
        select distinct p.id as src, dst from (select *, unnest(h) as href from p) p join t on t.path = substr(p.href, 2) where p.id <> dst"""),
    "mention_ngram_join": (mention_ngram_join, "with" + _RUNS.format(n="5")),
    "mention_longest": (mention_longest, "with" + _RUNS.format(n="1 + item_id % 6")),
    "mention_long_names": (mention_long_names, "with" + _RUNS.format(n="1 + 5 * (item_id % 5)")),
    "free_numbers": (free_numbers, _FREE_SQL),
    "suffix_join": (suffix_join, r"""
        with p as (select page_id as id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') as path from pages),
        w as (select distinct array_to_string(string_split(path, '/')[-2:], '/') as include from p)
        select include, min(id) as id, count(*) as hits from w join p on path = include or ends_with(path, '/' || include) group by include"""),
    "min_rank_pick": (min_rank_pick, "select p_name, p_partkey from (select *, row_number() over (partition by p_name order by p_size % 5, p_brand, p_partkey) as rn from part) where rn = 1"),
    "unique_key_pairing": (unique_key_pairing, """
        with u as (select p_name, p_size as k, min(p_partkey) as id from part group by all having count(*) = 1)
        select x.id as a, y.id as b from u x join u y on x.p_name = y.p_name and x.k = y.k + 1"""),
    "same_name": (same_name, """
        with i as (select p_partkey as id, p_brand as page_id, p_name || '/' || p_type || '/' || p_size as name from part)
        select a.id, b.id as other from i a join i b on a.name = b.name and a.id <> b.id and a.page_id <> b.page_id where a.name in (select name from i group by name having count(*) = 2)"""),
    "defined_fold": (defined_fold, """
        with r as (select distinct p_name || ' ' || p_size as name, lpad(p_partkey::varchar, 9, '0') as id, p_partkey * 7919 // 13 % 4 as rank from part),
        m as (select *, min(rank) over (partition by name order by id rows between unbounded preceding and 1 preceding) as before from r)
        select name, case when bool_or(rank = before) then null else arg_min(id, rank) end as id from m group by name"""),
    "tiered_resolution": (tiered_resolution, """
        with r as (
          select distinct o_orderkey, l_suppkey as s_suppkey, case when s_nationkey = c_nationkey then 1 when sn.n_regionkey = cn.n_regionkey then 2 else 3 end as tier
          from orders join customer on c_custkey = o_custkey join nation cn on cn.n_nationkey = c_nationkey join lineitem on l_orderkey = o_orderkey
          join supplier on s_suppkey = l_suppkey join nation sn on sn.n_nationkey = s_nationkey),
        k as (select *, count(*) over (partition by o_orderkey, tier) as n from r), f as (select * from k where tier < 3 or n = 1),
        b as (select *, min(tier) over (partition by o_orderkey) as best from f)
        select o_orderkey, s_suppkey, tier::bigint as tier from b where tier = best"""),
    "supersedes": (supersedes, """
        with o as (select o_orderkey as k, o_custkey % 3 <> 0 as local, o_orderkey + 1 + o_custkey % 2 * 50 as t from orders)
        select lpad(a.k::varchar, 9, '0') as id, min(lpad(b.k::varchar, 9, '0')) as superseded_by from o a join o b on b.t = a.k and a.k <> b.k where b.local or not a.local group by 1"""),
    "prior_page": (prior_page, "select c_custkey as source, c_custkey * 3 as file, coalesce(max(case when o_orderkey = c_custkey * 3 then o_orderkey end), min(o_orderkey)) as prior from customer join orders on o_custkey = c_custkey group by all"),
    "anti_stale": (anti_stale, "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)"),
    "anti_broken": (anti_broken, r"""
        select item_id, count(*) as broken from (select distinct item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from benchmark)
        where w not in (select unnest(string_split(p_name, ' ')) from part) group by item_id"""),
    "label_end": (label_end, """
        with c as (select *, case when role = 'user' then 1 else 2 end as level from conversations)
        select a.conv_id, a.turn, coalesce(min(b.turn) - 1, 999)::bigint as ends from c a left join c b on a.conv_id = b.conv_id and b.turn > a.turn and b.level <= a.level group by a.conv_id, a.turn"""),
    "repeated_label_cut": (repeated_label_cut, """
        with c as (select conv_id, turn, row_number() over (partition by conv_id, role order by turn) as u, row_number() over (partition by conv_id, role order by turn desc) as d from conversations)
        select conv_id, turn, place::bigint as place from (select *, case when u <= d then 2 * u - 1 else 2 * d end as place from c) where place <= 3"""),
    "budget_prefix": (budget_prefix, """
        select source, doc_id, used::bigint as used from (select source, doc_id, sum(length(text) // 4) over (partition by source order by length(text) // 4 desc, doc_id rows unbounded preceding) as used from documents) where used <= 4000"""),
    "greedy_admission": (greedy_admission, """
        with recursive o as (select source, doc_id, length(text) // 4 as t, row_number() over (partition by source order by doc_id) as rn from documents),
        g as (
          select source, 0::bigint as rn, 0::bigint as used, false as kept, null::bigint as doc_id from (select distinct source from documents)
          union all select o.source, o.rn, case when g.used + o.t <= 2000 then g.used + o.t else g.used end, g.used + o.t <= 2000, o.doc_id from g join o on o.source = g.source and o.rn = g.rn + 1)
        select source, doc_id from g where kept"""),
    "median_split": (median_split, "select s_suppkey, s_acctbal >= (select s_acctbal from supplier order by s_acctbal limit 1 offset (select count(*) // 2 from supplier)) as upper from supplier"),
    "strict_winner": (strict_winner, """
        select p_name, case when count(*) filter (where p_size = m) = 1 then min(p_partkey) filter (where p_size = m) else -1 end as winner
        from (select *, min(p_size) over (partition by p_name) as m from part) group by p_name"""),
    "id_collisions": (id_collisions, "select p_partkey, case when rn = 1 then s else s || '_' || rn end as id from (select p_partkey, replace(p_name, ' ', '_') as s, row_number() over (partition by p_name order by p_partkey) as rn from part)"),
    "innermost_span": (innermost_span, """
        with s as (select o_custkey % 100 as page_id, o_orderkey as item, o_orderkey % 900 as a, o_orderkey % 900 + 20 + o_custkey % 200 as b from orders)
        select page_id, site, item from (
          select e.user_id as page_id, e.event_id as site, s.item, row_number() over (partition by e.user_id, e.event_id order by b - a, a, item) as rn
          from events e join s on s.page_id = e.user_id and e.event_id % 1000 between a and b) where rn = 1"""),
    "debounce_sessions": (debounce_sessions, """
        with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
        s as (select *, sum(new) over (partition by user_id order by ts) as sid from g)
        select user_id, min(ts) as started, count(*) as n from s group by user_id, sid"""),
    "coverage_pivot": (coverage_pivot, "select user_id, " + ", ".join(f"count_if(event_type = '{t}')::bigint as {t}" for t in ("click", "error", "purchase", "signup", "view")) + " from events group by user_id"),
    "target_form": (target_form, """
        select l_orderkey, case when n = 0 and o then 'outside' when n = 0 then 'hidden' when n = 1 and not o then 'resolved' else 'one_of' end as form
        from (select l_orderkey, count(distinct case when l_discount > 0.08 then l_suppkey end) as n, bool_or(l_tax > 0.07) as o from lineitem group by l_orderkey)"""),
    "sees": (sees, f"with {_NODES} select id, count(*) as n from (select id, id as seen from nodes union select src, dst from e union select a.src, b.dst from e a join e b on a.dst = b.src) group by id"),
}
