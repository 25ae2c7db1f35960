"""Links in prose rewritten to page ids; code stays as it is.

A text is cut into pieces: code, links, tags and what lies between. Only links go out, a row each, to meet the ids that they
mean; they come back as one list a page, in order, and the pieces are put together again around them. Nothing but the links is
shuffled, and no dictionary of pages is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.sources.shared import cut

#: Fenced code, which may be unclosed; code between equal runs of backticks.
FENCE = r"(?<![^\n])[ ]{0,3}(?:(?<f>`{3,})[^`\n]*|(?<g>~{3,})[^\n]*)(?:\n(?s:.*?)(?:\n[ ]{0,3}(?:\k<f>`*|\k<g>~*)[ \t]*(?=\n|$)|$)|$)"
INLINE = r"(?<!`)(?<b>`+)(?!`)(?s:.+?)(?<!`)\k<b>(?!`)"
WIKI = r"\[\[[^\[\]|#\n]+(?:#[^\[\]|\n]*)?(?:\|[^\[\]\n]*)?\]\]"
LINK = r"\[[^\[\]\n]*\]\([^)\s]+\)"
#: A tag that begins with a digit, after white space or at a line's start.
TAG = r"(?<![^\s])#[0-9][^\s!\"#$%&'()*+,.:;<=>?@\[\\\]^`{|}~\x{2000}-\x{206F}\x{2E00}-\x{2E7F}]*"
PIECE = rf"{FENCE}|{INLINE}|{WIKI}|{LINK}|{TAG}|`+|[^`\[#~\n]+|(?s:.)"


def pieces(text: Column) -> Column:
    """The text cut into code, links, tags and the rest."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _target(piece: Column) -> Column:
    """(kind, value) of a link's piece: the name of a double-bracket link, the target of a Markdown link."""
    bracket = piece.startswith("[")  # few pieces need the patterns
    wiki, link = bracket & piece.rlike(f"^{WIKI}$"), bracket & piece.rlike(f"^{LINK}$")
    name = F.trim(F.regexp_extract(piece, r"^\[\[([^\[\]|#\n]+)", 1))
    return F.when(wiki, F.struct(F.lit("name").alias("kind"), name.alias("value"))).when(link, F.struct(F.lit("path").alias("kind"), F.regexp_extract(piece, r"\]\(([^)\s]+)\)$", 1).alias("value")))


def rewrite_links(pages: DataFrame, ids: DataFrame, body: str = "body") -> DataFrame:
    """pages (id, path, body) with links that mean a page of `ids` (id, path) written by its id.

    [[Name#a|shown]] becomes [[id#a|shown]] if the name's slug is a page's id and the name itself is none; [shown](path#a) of a
    page at that path becomes [shown](id.md#a), the least id counting; a # that would start a tag like #1st is escaped. A null body stays."""
    tag = lambda p: p.startswith("#") & p.rlike(f"^{TAG.removeprefix('(?<![^\\s])')}$") & ~p.rlike("^#[0-9]+/*$")
    own = F.transform(pieces(F.col(body)), lambda p: F.when(tag(p), F.concat(F.lit("\\"), p)).otherwise(p))
    rows = cut(pages.select("*", own.alias("__pieces"), F.xxhash64("id", "path", body).alias("__row")).drop(body))
    at = F.filter(F.transform("__pieces", lambda p, i: F.struct(i.alias("at"), p.alias("piece"))), lambda x: x["piece"].startswith("["))
    links = rows.select("path", "__row", F.explode(at).alias("x")).withColumn("t", _target(F.col("x.piece"))).filter("t is not null")
    links = cut(links.select("__row", "path", "x.at", "x.piece", F.col("t.kind").alias("kind"), F.col("t.value").alias("value")))
    known = ids.select(F.col("id").alias("to")).distinct()
    # what a name or a target means is told once, however many links say it
    said = links.filter("kind = 'name'").select("__row", "at", "piece", "value")
    names = cut(said.select("value").distinct().withColumn("to", T.slugify("value"))).filter("to <> value")
    names = cut(names.join(known, "to", "left_semi").join(known.withColumnRenamed("to", "value"), "value", "left_anti"))
    named = said.join(names, "value").select("__row", "at", F.concat(F.lit("[["), "to", F.regexp_extract("piece", r"^\[\[[^\[\]|#\n]+(.*)$", 1)).alias("new"))
    at_path = ids.groupBy(F.col("path").alias("target")).agg(F.min("id").alias("to"))
    aims = links.filter("kind = 'path'").select("__row", "at", "piece", "value", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("folder"), F.regexp_replace("value", r"[#?].*$", "").alias("bare"))
    targets = aims.select("folder", "bare").distinct().withColumn("target", T.resolve_link(F.col("folder"), F.col("bare")))
    targets = cut(cut(targets).join(at_path, "target").select(F.col("folder").alias("t_folder"), F.col("bare").alias("t_bare"), "to"))
    linked = aims.join(targets, F.col("folder").eqNullSafe(F.col("t_folder")) & (F.col("bare") == F.col("t_bare")))
    linked = linked.select("__row", "at", F.concat(F.regexp_extract("piece", r"^(\[[^\[\]\n]*\]\()", 1), "to", F.lit(".md"), F.regexp_extract("value", r"(#.*)?$", 0), F.lit(")")).alias("new"))
    new = named.unionByName(linked).distinct().groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("__new"))
    # stretches of pieces, each up to a new link: no link is looked up, so that long pages take no more than their length
    begin = lambda k: F.when(k == 0, 0).otherwise(F.get("__new", k - 1)["at"] + 1)
    end = lambda k: F.coalesce(F.get("__new", k)["at"], F.size("__pieces"))
    stretch = lambda k: F.concat(F.array_join(F.slice("__pieces", begin(k) + 1, end(k) - begin(k)), ""), F.coalesce(F.get("__new", k)["new"], F.lit("")))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.size("__new")), stretch), "")
    text = F.when(F.col("__new").isNull(), F.array_join("__pieces", "")).otherwise(text)
    return rows.join(new, "__row", "left").withColumn(body, text).select(*pages.columns)
