"""Catalog tables, rendering, lint and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.functions import text as T

LARGE = 4000
#: Sections that rendering adds around a page's own text.
CHROME = ("Related", "Imported by", "Mentioned in", "Exports", "Imports", "Notes")


def catalog(pages: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """pages with degrees, rank, token estimate and sorted neighbours; kinds of edges are counted together, imports apart.

    What edges and ranks say of a page is gathered by its id first, so that texts meet one narrow table, once."""
    e = edges.select("src", "dst", (F.col("kind") == "import").alias("import")).distinct()
    ends = e.select(F.col("src").alias("id"), F.lit("out").alias("side"), F.col("dst").alias("other"), "import").unionByName(e.select(F.col("dst").alias("id"), F.lit("in").alias("side"), F.col("src").alias("other"), "import"))
    told = ends.withColumn("rank", F.lit(None).cast("double")).unionByName(ranks.select("id", F.lit("rank").alias("side"), F.lit(None).cast("string").alias("other"), F.lit(False).alias("import"), F.col("rank").cast("double").alias("rank")))
    sides = {"neighbors_out": F.col("side") == "out", "neighbors_in": F.col("side") == "in", "imports_out": (F.col("side") == "out") & F.col("import"), "imports_in": (F.col("side") == "in") & F.col("import")}
    narrow = told.groupBy("id").agg(F.max("rank").alias("rank"), *[F.array_sort(F.collect_set(F.when(w, F.col("other")))).alias(c) for c, w in sides.items()])
    none = F.array().cast("array<string>")
    rows = pages.join(narrow, "id", "left").withColumns({c: F.coalesce(c, none) for c in sides})
    return rows.withColumn("degree_out", F.size("neighbors_out")).withColumn("degree_in", F.size("neighbors_in")).withColumn("token_estimate", T.token_estimate("body"))


#: What stands under Notes where nobody has written any.
NO_NOTES = "_none yet_"


def _section(name: str, lines: Column) -> Column:
    lines = F.coalesce(lines, F.array().cast("array<string>"))
    text = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"## {name}\n"), text, F.lit("\n\n"))).otherwise("")


def _linked(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.concat(F.lit("[["), x, F.lit("]]")))


def fenced(body: Column, language: Column) -> Column:
    """Code between fences that are longer than any run of backticks in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(body, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))
    return F.concat(fence, language, F.lit("\n"), body, F.lit("\n"), fence)


def render(rows: DataFrame) -> DataFrame:
    """(id, page): each catalog row as Markdown.

    Front matter, title, the pages it links to, those that import it and others that mention it, of code what it exports and
    imports, its text (code between fences) and its notes. Sections without lines are left out, but for the notes, whose place
    is always there. Columns created, updated, aliases, tags, exports, imports and notes count if they are there."""
    has = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    lists, code = "array<string>", F.col("kind").startswith("code:")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise("")
    some = lambda c: F.when(F.size(has(c, lists)) > 0, F.to_json(has(c, lists)))
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")
    notes = F.trim(F.coalesce(has("notes", "string"), F.lit("")))
    page = F.concat(
        F.lit("---\n"), F.concat(F.lit("title: "), T.yaml_string("title"), F.lit("\n")), line("created", has("created", "string")), line("updated", has("updated", "string")), line("aliases", some("aliases")), line("tags", some("tags")),
        line("kind", F.col("kind")), line("source", T.yaml_string("path")), line("source_hash", F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256)), F.lit("---\n"), F.lit("# "), F.col("title"), F.lit("\n\n"),
        _section("Related", _linked(F.col("neighbors_out"))), _section("Imported by", _linked(F.col("imports_in"))), _section("Mentioned in", _linked(F.array_except("neighbors_in", "imports_in"))),
        F.when(code, F.concat(_section("Exports", F.transform(has("exports", lists), lambda x: F.concat(F.lit("`"), x, F.lit("`")))), _section("Imports", has("imports", lists)))).otherwise(""),
        F.when(body != "", F.concat(F.lit("## Body\n"), F.when(code, fenced(body, F.substring("kind", 6, 99))).otherwise(body), F.lit("\n\n"))).otherwise(""),
        F.lit("## Notes\n"), F.when(notes == "", F.lit(NO_NOTES)).otherwise(notes), F.lit("\n"),
    )
    return rows.select("id", page.alias("page"))


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """(id, change): added, changed or removed between two tables of (id, fingerprint)."""
    both = new.withColumnRenamed("fingerprint", "now").join(old.withColumnRenamed("fingerprint", "was"), "id", "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed")
    return both.select("id", kind.alias("change")).filter("change is not null")


def broken_links(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, target): double-bracket links outside code whose slug is no page."""
    prose = F.regexp_replace(F.regexp_replace("body", r"(?s)(^|\n)(```|~~~).*?(\n\2|$)", "$1"), r"`[^`\n]*`", "")
    found = pages.select("id", F.explode(F.regexp_extract_all(prose, F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1))).alias("link"))
    found = found.select("id", T.link_target("link").alias("target")).distinct().withColumn("slug", T.slugify("target"))
    return found.join(ids.select(F.col("id").alias("slug")), "slug", "left_anti").select("id", "target")


def large_pages(pages: DataFrame, most: int = LARGE) -> DataFrame:
    size = F.floor((F.length("body") + 7) / 4)
    return pages.filter(~F.col("kind").startswith("code")).withColumn("tokens", size).filter(F.col("tokens") > most).select("id", "tokens")


def index_lines(rows: DataFrame) -> DataFrame:
    """One line a page, in order of id: what an index file holds."""
    line = F.concat(F.lit("- [["), F.col("id"), F.lit("]] "), T.link_text("title"), F.when(F.col("summary").isNotNull(), F.concat(F.lit(": "), T.clip(T.one_line("summary"), 120))).otherwise(""))
    return rows.orderBy("id").select("id", line.alias("line"))


def prior_pages(live: DataFrame, written: DataFrame) -> DataFrame:
    """(source, file): which written page (source, file) a live page (source, file) goes on from: its own, else the least."""
    old = written.select("source", F.col("file").alias("old"))
    own = F.struct((F.col("old") != F.col("file")).alias("other"), "old")
    return live.select("source", "file").join(old, "source").groupBy("source", F.col("file")).agg(F.min(own)["old"].alias("prior"))


def stale_pages(written: DataFrame, live: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(id): pages written before that no longer live; those with notes still to be moved (`kept`) stay."""
    gone = written.select("id").distinct().join(live.select("id"), "id", "left_anti")
    return gone if kept is None else gone.join(kept.select("id"), "id", "left_anti")


def outside(files: DataFrame, roots: list[str], path: str = "path") -> DataFrame:
    """files that lie under none of the roots."""
    keep = F.lit(True)
    for r in roots:
        keep = keep & (F.col(path) != r) & ~F.col(path).startswith(r.rstrip("/") + "/")
    return files.filter(keep)


def once(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of the tables, of equal keys the one of the first table."""
    rows = None
    for k, t in enumerate(tables):
        t = t.withColumn("__table", F.lit(k))
        rows = t if rows is None else rows.unionByName(t)
    first = F.row_number().over(W.partitionBy(key).orderBy("__table"))
    return rows.withColumn("__first", first).filter("__first = 1").drop("__table", "__first")


def exports(items: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, exports): signatures of public items, each once: members beside the type that owns them, types before members."""
    kind = F.when(F.col("kind") == "type", 0).when(F.col("kind").isin("fn", "method"), 1).otherwise(2)
    key = F.struct(F.coalesce("owner", "name").alias("group"), F.when(F.col("owner").isNull(), kind).otherwise(3).alias("kind"), "name", "signature")
    rows = items.filter("public").groupBy(page).agg(F.array_sort(F.collect_set(key)).alias("all"))
    return rows.select(page, F.array_distinct(F.transform("all", lambda x: x["signature"])).alias("exports"))


def lint_totals(pages: DataFrame) -> DataFrame:
    """One row: pages, pages of code, pages of text that are too large."""
    large = ~F.col("kind").startswith("code") & (F.floor((F.length("body") + 7) / 4) > LARGE)
    return pages.agg(F.count("*").alias("pages"), F.count_if(F.col("kind").startswith("code")).alias("code"), F.count_if(large).alias("large"))


def with_notes(pages: DataFrame, written: DataFrame) -> DataFrame:
    """pages (source, body, ...) with `notes`: the Notes section of the page written for the source before; a placeholder is none."""
    text = F.regexp_replace(F.regexp_extract("page", r"(?s)\n## Notes[ \t]*\n(.*)$", 1), r"^\s+|\s+$", "")
    notes = F.when((text != "") & ~text.rlike(r"^_.*_$"), text)
    return pages.join(written.select("source", notes.alias("notes")).filter("notes is not null").dropDuplicates(["source"]), "source", "left")


def write_changed(pages: DataFrame, prints: DataFrame, path: str) -> DataFrame:
    """Append to `path` the pages (id, page, fingerprint) whose fingerprint is not among `prints` (id, fingerprint); returns them."""
    new = pages.join(prints.select("id", "fingerprint"), ["id", "fingerprint"], "left_anti")
    new.write.mode("append").parquet(path)
    return new


def owner_runs(items: DataFrame) -> DataFrame:
    """items (page_id, start_line, owner, ...) with `header`: the owner, where it differs from that of the item before."""
    before = F.lag(F.coalesce("owner", F.lit(""))).over(W.partitionBy("page_id").orderBy("start_line", "end_line", "name"))
    return items.withColumn("header", F.when(F.col("owner").isNotNull() & (F.coalesce(before, F.lit("")) != F.col("owner")), F.col("owner")))
