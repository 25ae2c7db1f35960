"""Queries for scalars, scans and catalog rows, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators import catalog as C
from docgraph.sources.adapter import conversation_pages, table, text_pages


def catalog_pages(spark, sf):
    """The catalog of documents, each linking to the one whose number is what is left of its own after 7."""
    p = text_pages(spark, sf)
    d = table(spark, sf, "documents")
    at = lambda c: F.concat(F.lit("doc_"), c.cast("string"))
    edges = d.filter("doc_id >= 7").select(at(F.col("doc_id")).alias("src"), at(F.col("doc_id") % 7).alias("dst"), F.when(F.col("doc_id") % 2 == 0, "import").otherwise("link").alias("kind"))
    rows = C.catalog(p, edges, p.select("id", F.lit(0.5).alias("rank")))
    return rows.select(
        "id", "path", "title", "kind", F.col("token_estimate").alias("tokens"), T.word_count("body").cast("long").alias("words"), T.title_case(T.derive_name("path")).alias("derived"),
        F.col("degree_in").cast("long").alias("degree_in"), F.col("degree_out").cast("long").alias("degree_out"), F.size("imports_in").cast("long").alias("imports_in"), F.array_join("neighbors_out", ",").alias("to"),
    )


def kind_tag_filter(spark, sf):
    p = text_pages(spark, sf)
    return p.filter(T.kind_filter("kind", "docs") & T.tag_filter("tags", "#src/")).filter(T.tag_filter("tags", "fr")).select("id", "path")


def slugify_names(spark, sf):
    n = table(spark, sf, "customer").select(F.col("c_name").alias("name")).unionByName(table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name")))
    return n.distinct().select("name", T.slugify("name").alias("slug"))


def name_words(spark, sf):
    p = table(spark, sf, "part").select(F.concat_ws("_", F.translate(F.initcap("p_name"), " ", ""), "p_type").alias("name")).distinct()
    return p.select("name", F.array_join(T.name_words("name"), " ").alias("words"))


def title_case(spark, sf):
    return table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")).distinct().select("name", T.title_case("name").alias("title"))


def clip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clip(T.one_line("text"), 80).alias("line"))


def body_counts(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").select("doc_id", *[T.occurrences(low, w).cast("long").alias(f"n_{w}") for w in ("the", "ver", "eau", "ing")])


def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet("text", ["eren"]).alias("around")).filter("around is not null")


def first_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_sentence("text").alias("sentence"))


def tokenize(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.tokenize("text"), " ").alias("tokens"))


def token_df(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(T.field_words("text"))).alias("word"))
    return d.groupBy("word").agg(F.count("*").alias("df")).filter("df >= 20")


def corpus_stats(spark, sf):
    d = table(spark, sf, "documents").withColumn("len", T.word_count("text").cast("long"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("len").alias("total"), F.round(F.avg("len"), 6).alias("average"))


def resolve_link(spark, sf):
    p = table(spark, sf, "pages").withColumn("path", F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""))
    links = p.select("path", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[a-zA-Z]+)"'), F.lit(1)))).alias("link"))
    return links.select("path", "link", T.resolve_link("path", F.concat(F.lit("../x/."), "link")).alias("target"))


def path_parts(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    return p.select("path", T.basename("path").alias("base"), T.module_stem("path").alias("stem"), T.source_rank("path").cast("long").alias("rank"), T.is_test_path("path").alias("test"))


def conversation_sections(spark, sf):
    p = conversation_pages(spark, sf).select("path", F.explode(F.split("text", "\n")).alias("line"))
    p = p.withColumn("level", T.heading_level("line")).filter("level > 0")
    return p.groupBy("path").agg(F.count("*").alias("headings"), F.max(T.heading_text("line")).alias("last"))


def exact_duplicates(spark, sf):
    d = table(spark, sf, "documents").withColumn("hash", T.fingerprint(F.col("text")))
    return d.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1").select("first", "copies")


def fingerprint_diff(spark, sf):
    e = table(spark, sf, "events").withColumn("half", F.when(F.dayofyear("ts") % 2 == 0, 1).otherwise(0))
    state = e.groupBy("half", "user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    state = state.select("half", F.col("user_id").alias("id"), T.fingerprint(F.col("n") % 4, F.lit("x")).alias("fingerprint"))
    return C.changed(state.filter("half = 1").drop("half"), state.filter("half = 0").drop("half"))


def large_pages(spark, sf):
    return C.large_pages(text_pages(spark, sf), 1500).select("id", F.col("tokens").cast("long").alias("tokens"))


def visible_names(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))


QUERIES = {
    "catalog_pages": (catalog_pages, r"""
        select 'doc_' || doc_id as id, 'docs/' || source || '/' || lang || '/doc_' || doc_id || '.txt' as path, 'Doc ' || doc_id as title, 'text' as kind,
          (length(text) // 4)::bigint as tokens, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::bigint as words, 'Doc ' || doc_id as derived,
          (select count(*) from documents o where o.doc_id >= 7 and o.doc_id % 7 = d.doc_id)::bigint as degree_in, (doc_id >= 7)::bigint as degree_out,
          (select count(*) from documents o where o.doc_id >= 7 and o.doc_id % 7 = d.doc_id and o.doc_id % 2 = 0)::bigint as imports_in, case when doc_id >= 7 then 'doc_' || doc_id % 7 else '' end as "to"
        from documents d"""),
    "kind_tag_filter": (kind_tag_filter, "select 'doc_' || doc_id as id, 'docs/' || source || '/' || lang || '/doc_' || doc_id || '.txt' as path from documents where lang = 'fr'"),
    "slugify_names": (slugify_names, r"""
        select name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') as slug
        from (select c_name as name from customer union select p_name || ' ' || p_brand from part)"""),
    "name_words": (name_words, r"""
        select name, lower(replace(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' ')) as words from (
          select distinct list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') || '_' || p_type as name from part)
        where true""".replace("where true", "")),
    "title_case": (title_case, "select name, list_aggregate(list_transform(string_split(name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') as title from (select distinct p_name || ' ' || lower(p_type) as name from part)"),
    "clip": (clip, r"select doc_id, case when length(t) > 80 then substr(t, 1, 79) || '…' else t end as line from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents)"),
    "body_counts": (body_counts, "select doc_id, " + ", ".join(f"((length(t) - length(replace(t, '{w}', ''))) // 3)::bigint as n_{w}" for w in ("the", "ver", "eau", "ing")) + " from (select doc_id, lower(text) as t from documents)"),
    "snippet": (snippet, r"""
        select doc_id, case when lo > 1 then '…' else '' end || trim(regexp_replace(substr(text, lo, hi - lo), '\s+', ' ', 'g')) || case when hi <= length(text) then '…' else '' end as around
        from (select doc_id, text, greatest(p - 60, 1) as lo, least(p + 64, length(text) + 1) as hi from (select doc_id, text, instr(lower(text), 'eren') as p from documents) where p > 0)"""),
    "first_sentence": (first_sentence, r"""
        with d as (select doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as w from documents),
        e as (select doc_id, w, list_position(list_transform(w, lambda x: regexp_matches(x, '[.!?]$') and not regexp_matches(x, '(^|\.)\p{Lu}[.!?]$')), true) as k from d)
        select doc_id, array_to_string(case when coalesce(k, 0) = 0 then w else w[1 : k] end, ' ') as sentence from e"""),
    "tokenize": (tokenize, r"""
        select item_id, string_agg(w, ' ' order by i) as tokens from (
          select item_id, w, min(i) as i from (
            select item_id, i, regexp_replace(regexp_replace(w, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '') as w
            from (select item_id, unnest(regexp_split_to_array(lower(text), '\s+')) as w, generate_subscripts(regexp_split_to_array(lower(text), '\s+'), 1) as i from benchmark))
          where w <> '' group by item_id, w) group by item_id"""),
    "token_df": (token_df, r"select word, count(*) as df from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as word from documents) group by word having count(*) >= 20"),
    "corpus_stats": (corpus_stats, r"select lang, count(*) as n, sum(l)::bigint as total, round(avg(l), 6) as average from (select lang, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as l from documents) group by lang"),
    "resolve_link": (resolve_link, r"""
        select path, link, case when len(f) < 2 then null else array_to_string(list_concat(f[1 : len(f) - 2], ['x', substr(link, 2)]), '/') end as target
        from (select path, string_split(path, '/') as f, unnest(list_distinct(regexp_extract_all(html, 'href="(/[a-zA-Z]+)"', 1))) as link
          from (select regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') as path, html from pages))"""),
    "path_parts": (path_parts, r"""
        select path, base, lower(string_split(base, '.')[1]) as stem, 2::bigint as rank, false as test
        from (select distinct path, string_split(path, '/')[-1] as base from (select regexp_replace(url, '^[a-z]+://', '') as path from pages))"""),
    "conversation_sections": (conversation_sections, "select 'chats/conv_' || conv_id || '.md' as path, count(*) as headings, max(role || ' ' || turn) as last from conversations group by conv_id"),
    "exact_duplicates": (exact_duplicates, "select min(doc_id) as first, count(*) as copies from documents group by text having count(*) > 1"),
    "fingerprint_diff": (fingerprint_diff, """
        with s as (select case when dayofyear(ts) % 2 = 0 then 1 else 0 end as half, user_id as id, count(*) % 4 as n from events group by all)
        select coalesce(a.id, b.id) as id, case when b.id is null then 'added' when a.id is null then 'removed' else 'changed' end as change
        from (select * from s where half = 1) a full join (select * from s where half = 0) b on a.id = b.id
        where b.id is null or a.id is null or a.n <> b.n"""),
    "large_pages": (large_pages, "select 'doc_' || doc_id as id, ((length(text) + 7) // 4)::bigint as tokens from documents where (length(text) + 7) // 4 > 1500"),
    "json_fields": (visible_names, "select (props->>'$.k')::bigint as k, count(*) as n from events where props->>'$.k' is not null group by 1"),
}
