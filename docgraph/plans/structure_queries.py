"""Queries for pairing, inheritance, walks, rewriting, outlines, labels and items; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.operators import catalog as C
from docgraph.operators import graph as G
from docgraph.operators import labels as L
from docgraph.operators import outline as O
from docgraph.operators import resolve as R
from docgraph.operators import rewrite
from docgraph.operators import search as S
from docgraph.sources.adapter import conversation_pages, table

STAGES = [["p_brand", "p_name", "p_size"], ["p_brand", "p_name"], ["p_name", "p_size"]]


def staged_pairs(spark, sf):
    """Even parts as declarations, odd ones as definitions; three rounds, each on coarser keys."""
    p = table(spark, sf, "part")
    side = lambda k, name: p.filter(F.col("p_partkey") % 2 == k).select(F.col("p_partkey").alias(name), "p_brand", "p_name", "p_size")
    return R.staged_pairs(side(0, "declared"), side(1, "defined"), STAGES, "declared", "defined").select("declared", "defined", F.col("stage").cast("long").alias("stage"))


def _staged_sql() -> str:
    out = ["with l as (select * from part where p_partkey % 2 = 0), r as (select * from part where p_partkey % 2 = 1)"]
    for k, keys in enumerate(STAGES):
        cols = ", ".join(keys)
        one = lambda t: f"(select {cols}, min(p_partkey) as id from {t} group by {cols} having count(*) = 1)"  # noqa: E731, B023
        free = "" if not k else f" where a.id not in (select declared from c{k - 1}) and b.id not in (select defined from c{k - 1})"
        same = " and ".join(f"a.{c} is not distinct from b.{c}" for c in keys)
        prior = "" if not k else f"select * from c{k - 1} union all "
        out.append(f"c{k} as ({prior}select a.id as declared, b.id as defined, {k}::bigint as stage from {one('l')} a join {one('r')} b on {same}{free})")
    return ", ".join(out) + f" select * from c{len(STAGES) - 1}"


def _classes(spark, sf):
    """Parts as classes: asked, bases (some from outside, some in cycles) and a method of each."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("class"))
    c = F.col("class")
    base = lambda n, b, when: p.filter(when).select("class", F.lit(n).alias("position"), b.cast("long").alias("base"))
    bases = base(0, F.when(c % 13 != 0, F.floor(c / 2)), c > 1).unionByName(base(1, F.floor(c / 3), c > 2)).unionByName(base(2, c + 1, c % 7 == 0)).join(p.select(F.col("class").alias("base")), "base", "left_semi")
    bases = bases.unionByName(base(0, F.lit(None), (c > 1) & (c % 13 == 0)))
    name = lambda m: F.concat(F.lit("m"), (m % 11).cast("string"))
    return p.withColumn("name", name(c * 3)), bases, p.withColumn("name", name(c))


_BASES = """
    b as (
      select class, 0 as position, case when class % 13 <> 0 then class // 2 end as base from p where class > 1
      union all select class, 1, class // 3 from p where class > 2 union all select class, 2, class + 1 from p where class % 7 = 0),
    h as (select * from b where base is null or base in (select class from p))"""
_CLASSES = f"""
    p as (select p_partkey as class from part), a as (select class, 'm' || class * 3 % 11 as name from p), m as (select class, 'm' || class % 11 as name from p where class % 4 = 0),{_BASES}"""


def inherited_methods(spark, sf):
    """Of all parts a quarter has a method of its own, others look for it among their bases."""
    asked, bases, methods = _classes(spark, sf)
    return R.inherited(asked, bases, methods.filter(F.col("class") % 4 == 0))


_INHERITED_SQL = f"""
    with recursive {_CLASSES},
    r as (
      select class, name, class as node, []::int[] as way, 0 as level, false as gone, false as has from a
      union all
      select r.class, r.name, h.base, list_append(r.way, h.position), r.level + 1, h.base is null or r.level >= {R.DEPTH}, h.base is not null and r.level < {R.DEPTH} and exists (select 1 from m where m.class = h.base and m.name = r.name)
      from r join h on h.class = r.node where not r.gone and not r.has),
    f as (select class, name, first(node order by way) as found, first(way order by way) as way from r where has group by all),
    o as (select class, name, first(way order by way) as way from r where gone group by all)
    select a.class, a.name, f.found, o.way is not null and (f.way is null or o.way < f.way) as open from a left join f using (class, name) left join o using (class, name)"""


def overridden_methods(spark, sf):
    """All parts, each with a method of its own: the classes below each that have it too."""
    _, bases, methods = _classes(spark, sf)
    return R.overrides(methods, bases, methods)


_OVERRIDES_SQL = f"""
    with recursive p as (select p_partkey as class from part), m as (select class, 'm' || class % 11 as name from p),{_BASES},
    r as (select class, class as node from m union select r.class, h.class from r join h on h.base = r.node)
    select distinct q.class, q.name, r.node as sub from m q join r on q.class = r.class and r.node <> q.class join m on m.class = r.node and m.name = q.name"""


def walk_order(spark, sf):
    """Parts that call three others each, in the order in which a queue meets them."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    call = lambda n, to: p.select(k.alias("src"), to.cast("long").alias("dst"), F.lit(n).alias("nth"))
    calls = call(0, k * 2 % 1000 + 1).unionByName(call(1, k * k % 997 + 1)).unionByName(call(2, F.col("p_size") * 13))
    starts = p.filter("p_partkey in (1, 2)").select(k.alias("id"), (3 - k).alias("nth"))
    return G.walk_order(starts, calls).select("id", F.col("level").cast("long").alias("level"), "via", "place")


_WALK_SQL = """
    with recursive e as (select src, dst, min(nth) as nth from (select p_partkey as src, p_partkey * 2 % 1000 + 1 as dst, 0 as nth from part union all select p_partkey, p_partkey * p_partkey % 997 + 1, 1 from part union all select p_partkey, p_size * 13, 2 from part) group by all),
    s as (select list(p_partkey order by 3 - p_partkey) as ids from part where p_partkey in (1, 2)),
    w as (
      select 0 as level, ids as frontier, ids as seen, []::bigint[] as via from s
      union all
      select level + 1, n.ids, list_concat(seen, n.ids), n.via from w, lateral (
        select list(dst order by k) as ids, list(src order by k) as via from (
          select e.dst, min({'i': f.i, 'n': e.nth}) as k, arg_min(f.src, {'i': f.i, 'n': e.nth}) as src
          from (select unnest(frontier) as src, generate_subscripts(frontier, 1) as i) f join e on e.src = f.src where not list_contains(seen, e.dst) group by e.dst)) n
      where len(n.ids) > 0),
    x as (select level, unnest(frontier) as id, unnest(via) as via, generate_subscripts(frontier, 1) as i from w where level > 0)
    select id, level::bigint as level, via, row_number() over (order by level, i) as place from x"""


def rewritten_links(spark, sf):
    """Documents with links to others, some in code: each means a page by its name or its path."""
    d = table(spark, sf, "documents").filter("doc_id is not null")
    to = lambda i: ((F.col("doc_id") + i) % 1500).cast("string")
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\[\]`#~\n]+", " "), " ")
    said = F.transform(
        words,
        lambda w, i: F.when(i % 10 == 3, F.concat(F.lit("[[Doc "), to(i), F.lit("|"), w, F.lit("]]")))
        .when(i % 10 == 5, F.concat(F.lit("[x](../e/"), to(i), F.lit(".md#a)")))
        .when(i % 10 == 7, F.concat(F.lit("`[[Doc "), to(i), F.lit("]]`")))
        .when(i % 10 == 9, F.concat(F.lit("#"), i.cast("string"), F.lit("th")))
        .otherwise(w),
    )
    pages = d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.array_join(said, " ").alias("body"))
    ids = d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("e/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return rewrite.rewrite_links(pages, ids).select("id", F.sha2("body", 256).alias("body"))


_REWRITE_SQL = r"""
    with d as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '[\[\]`#~\n]+', ' ', 'g'), ' ') as w from documents where doc_id is not null),
    x as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) - 1 as i from d),
    t as (select *, (doc_id + i) % 1500 as k, (doc_id + i) % 1500 in (select doc_id from d) as known from x)
    select 'doc_' || doc_id as id, sha256(string_agg(case i % 10
      when 3 then '[[' || case when known then 'doc_' else 'Doc ' end || k || '|' || w || ']]'
      when 5 then '[x](' || case when known then 'doc_' || k else '../e/' || k end || '.md#a)'
      when 7 then '`[[Doc ' || k || ']]`' when 9 then '\#' || i || 'th' else w end, ' ' order by i)) as body from t group by doc_id"""

MOST = 30


def outline_cuts(spark, sf):
    """Orders as pages, their lines as items, imports and heads; each outline is cut as little as its budget asks for."""
    li = table(spark, sf, "lineitem")
    n = F.row_number().over(S.W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    kind = F.when(F.col("l_partkey") % 9 == 0, "import").when(F.col("l_partkey") % 11 == 0, "head").otherwise("item")
    lines = li.select(F.col("l_orderkey").alias("page"), n.alias("at"), kind.alias("kind"), (F.col("l_returnflag") == "R").alias("test"), (20 + F.col("l_partkey") % 40).alias("size"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey") % 50).alias("doc_size"))
    return O.cuts(lines, MOST).select("page", F.col("level").cast("long").alias("level"), "shown", F.col("tokens").cast("long").alias("tokens"), "marker")


_OUTLINE_SQL = f"""
    with li as (select l_orderkey as page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as nr, case when l_partkey % 9 = 0 then 'import' when l_partkey % 11 = 0 then 'head' else 'item' end as kind,
      l_returnflag = 'R' as test, 20 + l_partkey % 40 as size, case when l_suppkey % 3 = 0 then l_suppkey % 50 else 0 end as doc from lineitem),
    s as (select page, count_if(kind = 'item') as items, count_if(kind = 'item' and test) as tests, count_if(kind = 'import') as imports from li group by page),
    x as (select li.*, s.*exclude (page), items = tests as alone from li join s using (page)),
    k as (select *, kind <> 'item' or alone or not test as kept from x),
    l as (
      select page, any_value(items) as items, any_value(alone) as alone, any_value(imports) as n3, case when any_value(alone) then 0 else any_value(tests) end as n1, count_if(kind = 'item' and kept and doc > 0) as n2,
        sum(size) + sum(case when kind = 'item' then doc else 0 end) as c0, sum(case when kept then size else 0 end) + sum(case when kept and kind = 'item' then doc else 0 end) as c1,
        sum(case when kept then size else 0 end) as c2, sum(case when kept and kind <> 'import' then size else 0 end) as c3, sum(case when kind = 'head' then size else 0 end) as head, count_if(kind = 'item' and kept) as n
      from k group by page),
    m as (select *, c0 // 4 as whole, list_filter([case when n1 > 0 then n1 || ' test items' end], lambda v: v is not null) as d1 from l),
    n as (select *, list_concat(d1, list_filter([case when n2 > 0 then n2 || ' docs' end], lambda v: v is not null)) as d2 from m),
    o as (select *, list_concat(d2, list_filter([case when n3 > 0 then n3 || ' imports' end], lambda v: v is not null)) as d3, ' — pass max_tokens: ' || whole || ' for all' || chr(10) as tail from n),
    q as (select *, '… dropped: ' || array_to_string(d1, ', ') || tail as m1, '… dropped: ' || array_to_string(d2, ', ') || tail as m2, '… dropped: ' || array_to_string(d3, ', ') || tail as m3 from o),
    c as (select *, case when whole <= {MOST} then 0 when n1 > 0 and (c1 + length(m1)) // 4 <= {MOST} then 1 when n2 > 0 and (c2 + length(m2)) // 4 <= {MOST} then 2 when n3 > 0 and (c3 + length(m3)) // 4 <= {MOST} then 3 else 4 end as level from q),
    i as (
      select k.page, row_number() over w as nth, sum(k.size) over w - k.size as before, k.nr, c.head, c.n, c.tail, case when len(c.d3) > 0 then 'dropped: ' || array_to_string(c.d3, ', ') || '; ' else '' end as dropped
      from k join c using (page) where c.level = 4 and k.kind = 'item' and k.kept window w as (partition by k.page order by k.nr)),
    j as (select *, '… ' || dropped || (n - nth + 1) || ' more items from line ' || nr || tail as marker from i),
    t as (select page, nth - 1 as shown, (head + before + length(marker)) // 4 as tokens, marker from j where (head + before + length(marker)) // 4 <= {MOST} or nth = 1 qualify row_number() over (partition by page order by nth desc) = 1)
    select page, level::bigint as level, (case when level = 0 or alone then items else n end)::bigint as shown, (case level when 0 then c0 when 1 then c1 + length(m1) when 2 then c2 + length(m2) else c3 + length(m3) end // 4)::bigint as tokens, case level when 0 then '' when 1 then m1 when 2 then m2 else m3 end as marker from c where level < 4
    union all select page, 4, shown, tokens::bigint, marker from t
    union all select page, 4, 0, ((head + length('… ' || case when len(d3) > 0 then 'dropped: ' || array_to_string(d3, ', ') else '' end || tail)) // 4)::bigint, '… ' || case when len(d3) > 0 then 'dropped: ' || array_to_string(d3, ', ') else '' end || tail from c where level = 4 and n = 0"""


def label_parts(spark, sf):
    """A query that names two labels one after the other."""
    found = L.labels(conversation_pages(spark, sf))
    return L.search(found, "user 0 assistant 1", limit=300).select("doc", F.col("start").cast("long").alias("start"), "label", "reading", "cut")


_PARTS_SQL = """
    with s as (select conv_id, turn, role, length(text) - length(replace(text, chr(10), '')) + 1 as n from conversations),
    l as (select *, coalesce(sum(n + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) + 1 as start from s),
    h as (select 'chats/conv_' || conv_id || '.md' as doc, start::bigint as start, role || ' ' || turn as label, case when role = 'user' and turn = 0 then 0 else 1 end as part from l where (role = 'user' and turn = 0) or (role = 'assistant' and turn = 1)),
    r as (select *, row_number() over (order by part, doc, start) as p, count(*) over () as total from h)
    select doc, start, label, 'parts' as reading, greatest(total - 300, 0) as cut from r where p <= 300 order by doc, start"""


def ranked_labels(spark, sf):
    """Orders as labels of their customer's page, headings and bold names, of which the limit cuts some."""
    o = table(spark, sf, "orders")
    name = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("## Ship: the order "), name)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("**Order: "), name, F.lit("** now"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("## Order: "), name)).otherwise(F.concat(F.lit("**Pack the order "), name, F.lit("** now")))
    docs = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    pages = docs.select(F.concat(F.lit("c/"), (F.col("o_custkey") % 10).cast("string"), F.lit("/"), F.col("o_custkey").cast("string"), F.lit(".md")).alias("path"), "text")
    return L.search(L.labels(pages), "order", limit=37).select("doc", F.col("start").cast("long").alias("start"), "label", "cut")


_RANKED_SQL = """
    with o as (select 'c/' || o_custkey % 10 || '/' || o_custkey || '.md' as doc, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as start from orders),
    l as (select doc, start, case k % 4 when 0 then 'Ship: the order ' || k when 1 then 'Order: ' || k when 2 then 'Order: ' || k else 'Pack the order ' || k end as label, k % 4 in (1, 3) as bold, k % 4 in (0, 3) as late,
      lower(case k % 4 when 0 then 'Ship' when 1 then 'Order' when 2 then 'Order' else 'Pack the order ' || k end) as head from o),
    r as (select *, row_number() over (order by bold, late, doc, start) as p, count(*) over () as total, row_number() over (partition by bold, late, doc, head order by start) as up, row_number() over (partition by bold, late, doc, head order by start desc) as down from l),
    s as (select *, count_if(p <= 37) over (partition by bold, late, doc, head) as slots, case when up <= down then 2 * up - 1 else 2 * down end as place from r)
    select doc, start::bigint as start, label, greatest(total - 37, 0) as cut from s where place <= slots"""


def rendered_pages(spark, sf):
    """Documents as pages of code and prose: links, mentions, exports, imports, bodies and notes."""
    d = table(spark, sf, "documents").filter("doc_id is not null")
    at = lambda c: F.concat(F.lit("doc_"), c.cast("string"))
    code = F.col("doc_id") % 3 == 0
    pages = d.select(
        at(F.col("doc_id")).alias("id"), F.concat(F.lit("d/"), at(F.col("doc_id"))).alias("path"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.when(code, "code:python").otherwise("text").alias("kind"), F.col("text").alias("body"),
        F.array(F.coalesce("lang", F.lit("none"))).alias("tags"), F.when(code, F.array(F.concat(F.lit("def f"), F.col("doc_id").cast("string")))).alias("exports"), F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("os"), F.lit("sys"))).alias("imports"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("kept "), F.col("doc_id").cast("string"))).alias("notes"),
    )
    edges = d.filter("doc_id >= 7").select(at(F.col("doc_id")).alias("src"), at(F.floor(F.col("doc_id") / 2)).alias("dst"), F.when(F.col("doc_id") % 2 == 0, "import").otherwise("link").alias("kind"))
    rows = C.catalog(pages, edges, pages.select("id", F.lit(0.5).alias("rank")))
    return C.render(rows).select("id", F.length("page").cast("long").alias("chars"), F.sha2("page", 256).alias("page"))


_RENDER_SQL = r"""
    with d as (select *, doc_id % 3 = 0 as code, regexp_replace(coalesce(text, ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') as body from documents where doc_id is not null),
    e as (select doc_id as src, doc_id // 2 as dst, doc_id % 2 = 0 as import from d where doc_id >= 7),
    i as (select dst, string_agg('- [[doc_' || src || ']]' || chr(10), '' order by 'doc_' || src) filter (where import) as importers, string_agg('- [[doc_' || src || ']]' || chr(10), '' order by 'doc_' || src) filter (where not import) as said from e group by dst),
    f as (select *, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(body, '`+'), lambda x: length(x))), 0))) as fence from d left join i on dst = doc_id),
    p as (select 'doc_' || doc_id as id, '---' || chr(10) || 'title: "Doc ' || doc_id || '"' || chr(10) || 'tags: ["' || coalesce(lang, 'none') || '"]' || chr(10) || 'kind: ' || case when code then 'code:python' else 'text' end || chr(10)
      || 'source: "d/doc_' || doc_id || '"' || chr(10) || 'source_hash: ' || sha256(coalesce(text, '')) || chr(10) || '---' || chr(10) || '# Doc ' || doc_id || chr(10) || chr(10)
      || case when doc_id >= 7 then '## Related' || chr(10) || '- [[doc_' || doc_id // 2 || ']]' || chr(10) || chr(10) else '' end
      || coalesce('## Imported by' || chr(10) || importers || chr(10), '') || coalesce('## Mentioned in' || chr(10) || said || chr(10), '')
      || case when code then '## Exports' || chr(10) || '- `def f' || doc_id || '`' || chr(10) || chr(10) || case when doc_id % 6 = 0 then '## Imports' || chr(10) || '- os' || chr(10) || '- sys' || chr(10) || chr(10) else '' end else '' end
      || case when body <> '' then '## Body' || chr(10) || case when code then fence || 'python' || chr(10) || body || chr(10) || fence else body end || chr(10) || chr(10) else '' end
      || '## Notes' || chr(10) || case when doc_id % 5 = 0 then 'kept ' || doc_id else '_none yet_' end || chr(10) as page from f)
    select id, length(page)::bigint as chars, sha256(page) as page from p"""


def item_scores(spark, sf):
    """Parts as items of code: whole names, words of names, shared stems and docs, by how rare the query's words are."""
    p = table(spark, sf, "part")
    query = "bolts red_ring old economy::gear"
    idfs = S.answer(p, query, S.Fields(id="p_partkey", title="p_name", summary="p_type"), stems=True).idfs
    items = p.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.when(F.col("p_size") % 4 == 0, F.lower("p_type")).alias("owner"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("An old "), F.lower("p_type"))).alias("doc"), F.when(F.col("p_size") % 5 == 0, F.lit("bolted on")).alias("doc_text"), (F.col("p_partkey") % 10 == 0).alias("test"))
    return S.item_scores(items, S.query_tokens(query), idfs).select("p_partkey", F.round("score", 6).alias("score"))


_ITEMS_SQL = """
    with p as (select p_partkey as id, p_name as name, string_split(p_name, ' ') as w, lower(p_type) as type, p_size, p_partkey % 10 = 0 as test from part),
    -- pages that a title or type has: of bolts the stem, of red_ring both parts, of old the word, of economy::gear both parts
    h as (select *, list_contains(w, 'bolt') as h0, list_contains(w, 'red') and list_contains(w, 'ring') as h1, list_contains(w, 'old') as h2, false as h3 from p),
    n as (select count(*)::double as n, count_if(h0) as d0, count_if(h1) as d1, count_if(h2) as d2, count_if(h3) as d3 from h),
    i as (select ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) as i0, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) as i1, ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) as i2, ln(1 + (n - d3 + 0.5) / (d3 + 0.5)) as i3 from n),
    f as (
      select id, test, i0 * (case when list_contains(w, 'bolt') then 0.6 else 0 end + case when p_size % 5 = 0 then 0.15 else 0 end)
        + i1 * (case when name = 'red ring' then 3.5 else 0 end)
        + i2 * (case when list_contains(w, 'old') then 2.0 else 0 end + case when p_size % 3 = 0 then 1.0 else 0 end)
        + i3 * 0 as score from h, i)
    select id as p_partkey, round(case when test then score * 0.5 else score end, 6) as score from f where score > 0"""

QUERIES = {
    "staged_pairs": (staged_pairs, _staged_sql()),
    "inherited_methods": (inherited_methods, _INHERITED_SQL),
    "overridden_methods": (overridden_methods, _OVERRIDES_SQL),
    "walk_order": (walk_order, _WALK_SQL),
    "rewritten_links": (rewritten_links, _REWRITE_SQL),
    "outline_cuts": (outline_cuts, _OUTLINE_SQL),
    "label_parts": (label_parts, _PARTS_SQL),
    "ranked_labels": (ranked_labels, _RANKED_SQL),
    "item_scores": (item_scores, _ITEMS_SQL),
    "rendered_pages": (rendered_pages, _RENDER_SQL),
}
