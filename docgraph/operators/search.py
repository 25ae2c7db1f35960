"""Ranked lexical search: corpus statistics, field weights, saturation, boosts, symbol lines and the notes' tail.

A query's words are literals known on the driver, so that a page's facts are one projection over one scan, statistics
are one aggregate, and scores join one row of statistics to the scan. Nothing but the top rows is shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.functions.dates import QueryDate, dated_on, query_dates
from docgraph.functions.stem import stem, stem_words
from docgraph.sources.shared import cut

#: Weights of the fields of a page and of an item.
NAME, TITLE, FILE, ALIAS, SYMBOL, SYMBOL_WORD, IN_ONE_NAME, SYMBOL_DOC, SYMBOL_DOC_REST, SUMMARY, HEADING, BODY = 3.0, 3.0, 6.0, 2.0, 2.8, 2.0, 1.0, 0.75, 0.375, 1.5, 1.0, 1.0
ITEM_WHOLE, ITEM_WORD, ITEM_DOC, ITEM_DOC_REST, TEST_FACTOR = 3.5, 2.0, 1.0, 0.5, 0.5
K1, B = 1.2, 0.75
SYMBOLS_A_PAGE, RELATIVE_LEAST = 3, 0.3
#: English words that say nothing of what a prompt is about; other languages' are a parameter.
FUNCTION_WORDS = frozenset(
    "a an the and or but nor so yet if then else than as of to in on at by for from with into onto over under up out off about via per "
    "is are was were be been am do does did has have had will would can could shall should may might must not no "
    "i me my we us our you your he him his she her it its they them their this that these those there here "
    "what which who whom whose where when why how all any some each both only also very just too because while until since whether".split()
)
PROMPT_TERMS, NOTES_AT_MOST, NOTES_CANDIDATES, NOTE_WORD = 24, 2, 10, 4


def query_tokens(query: str) -> list[str]:
    """tokenize() of a query on the driver."""
    words = (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in query.lower().split())
    return list(dict.fromkeys(w for w in words if w))


def prompt_tokens(text: str) -> list[str]:
    """The tokens of a prompt: those of two characters or more."""
    return [t for t in query_tokens(text) if len(t) > 1]


def query_words(tokens: list[str]) -> list[str]:
    return sorted({p for t in tokens for p in re.split(r"[\W_]+", t) if p})


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


@dataclass(frozen=True)
class Fields:
    """Which columns of a page hold which field; all but id optional."""

    id: str = "id"
    title: str | None = None
    body: str | None = None
    summary: str | None = None
    aliases: str | None = None
    headings: str | None = None
    path: str | None = None
    symbols: str | None = None
    docs: str | None = None
    symbol_words: str | None = None


def facts(pages: DataFrame, tokens: list[str], fields: Fields, prompt: bool = False, stems: bool = False) -> DataFrame:
    """For each page and token i: w_i (field weight), tf_i, file_i (names the page's file), hit_i; and len.

    Field words of a page are computed once; aliases and headings are arrays, of which the best counts. stems: words of a
    field that share their stem with a token count as well, in part."""
    words = query_words(tokens)
    out = pages

    def tier(column: str, t: str) -> Column:
        if not stems:
            return F.when(T.literal_hit(F.col(column), t), 1.0).otherwise(0.0)
        return T.field_tier(F.col(column), F.col(f"{column}_stems"), F.lit(t), F.array(*[F.lit(stem(p)) for p in query_words([t])]))

    for name in ("title", "summary", "docs", "symbols"):
        if column := getattr(fields, name):
            out = out.withColumn(f"__{name}", T.field_words(F.coalesce(F.col(column).cast("string"), F.lit("")) if name != "symbols" else F.array_join(F.col(fields.symbol_words or column), " ")))
            if stems:
                out = out.withColumn(f"__{name}_stems", stem_words(F.col(f"__{name}")))
    body = F.lower(F.coalesce(F.col(fields.body), F.lit(""))) if fields.body else F.lit("")
    out = out.withColumn("__body", body).withColumn("len", T.word_count(F.col(fields.body)).cast("long") if fields.body else F.lit(0).cast("long"))
    wanted = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    for i, t in enumerate(tokens):
        w = F.lit(0.0)
        if fields.title:
            hit = tier("__title", t)
            whole, _, _ = word_sets(F.col("__title"), wanted)
            w = w + NAME * hit + F.when(whole, TITLE).otherwise(0.0)
        if fields.summary:
            w = w + SUMMARY * tier("__summary", t)
        for column, weight in ((fields.aliases, ALIAS), (fields.headings, HEADING)):
            if column:
                w = w + F.when(_some_hit(F.col(column), t), weight).otherwise(0.0)
        if fields.symbols:
            whole = F.array_contains(F.transform(F.col(fields.symbols), F.lower), t)
            part = F.array_contains(F.col(fields.symbol_words) if fields.symbol_words else F.flatten(F.transform(F.col(fields.symbols), T.name_words)), t)
            near = F.array_contains(F.col("__symbols_stems"), stem(t)) if stems else F.lit(False)
            w = w + F.when(whole, SYMBOL).when(part, SYMBOL_WORD).when(near, T.STEM_TIER * SYMBOL_WORD).otherwise(0.0)
        if fields.docs:
            w = w + SYMBOL_DOC * tier("__docs", t)
        file_ = T.names_file(F.col(fields.path), F.lit(t)) if fields.path and not prompt else F.lit(False)
        out = out.withColumn(f"w_{i}", w).withColumn(f"tf_{i}", T.occurrences(F.col("__body"), t)).withColumn(f"file_{i}", file_)
        out = out.withColumn(f"hit_{i}", (F.col(f"w_{i}") > 0) | (F.col(f"tf_{i}") > 0) | F.col(f"file_{i}"))
    return out.drop("__body", *[f"__{n}{s}" for n in ("title", "summary", "docs", "symbols") for s in ("", "_stems")])


def date_facts(rows: DataFrame, first: int, dates: list[QueryDate], updated: str, note: str) -> DataFrame:
    """rows of facts() with one further token for each date of a query: a note of that day hits it like a title."""
    for i, day in enumerate(dates, first):
        hit = F.coalesce(F.col(note) & dated_on(F.col(updated), [day]), F.lit(False))
        rows = rows.withColumns({f"w_{i}": F.when(hit, TITLE).otherwise(0.0), f"tf_{i}": F.lit(0), f"file_{i}": F.lit(False), f"hit_{i}": hit})
    return rows


def word_sets(words: Column, wanted: Column) -> tuple[Column, Column, Column]:
    """Whether a field's words are the wanted ones, whether they hold them all, and how many others they hold."""
    missing, others = F.size(F.array_except(wanted, words)), F.size(F.array_except(words, wanted))
    return (missing == 0) & (others == 0), missing == 0, others


def _some_hit(texts: Column, token: str) -> Column:
    return F.exists(texts, lambda a: T.literal_hit(T.field_words(a), token))


def statistics(rows: DataFrame, k: int) -> DataFrame:
    """One row over all rows of facts(): n, total (words), df_i and named_i."""
    counts = [F.sum(F.col(f"hit_{i}").cast("long")).alias(f"df_{i}") for i in range(k)]
    named = [F.sum(F.col(f"file_{i}").cast("long")).alias(f"named_{i}") for i in range(k)]
    return rows.agg(F.count("*").alias("n"), F.sum("len").alias("total"), *counts, *named)


def scored(rows: DataFrame, stats: DataFrame, k: int, terms: int | None = None, digits: int | None = None) -> DataFrame:
    """rows that any token hits, with score; terms: only so many rarest tokens count (ties by position)."""
    out = rows.crossJoin(F.broadcast(stats))  # one row
    average = F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(1.0)
    for i in range(k):
        out = out.withColumn(f"idf_{i}", idf(F.col("n"), F.col(f"df_{i}")))
    if terms is not None and k > terms:
        ranks = F.array_sort(F.filter(F.array(*[F.struct(F.col(f"df_{i}").alias("df"), F.lit(i).alias("i")) for i in range(k)]), lambda x: x["df"] > 0))
        kept = F.transform(F.slice(ranks, 1, terms), lambda x: x["i"])
        out = out.withColumn("__kept", kept)
        for i in range(k):
            out = out.withColumn(f"idf_{i}", F.when(F.array_contains("__kept", i), F.col(f"idf_{i}")).otherwise(0.0))
    base, file_ = F.lit(0.0), F.lit(0.0)
    for i in range(k):
        tf = F.col(f"tf_{i}").cast("double")
        base = base + F.col(f"idf_{i}") * (F.col(f"w_{i}") + BODY * F.when(tf > 0, saturation(tf, F.col("len"), average)).otherwise(0.0))
        file_ = file_ + F.when(F.col(f"file_{i}"), idf(F.col("n"), F.col(f"named_{i}")) / F.sqrt(F.greatest(F.col(f"named_{i}"), F.lit(1)))).otherwise(0.0)
    score = base + FILE * file_
    hit = F.lit(False)
    for i in range(k):
        hit = hit | F.col(f"hit_{i}")
    return out.filter(hit).withColumn("score", F.round(score, digits) if digits is not None else score)


@dataclass(frozen=True)
class Answer:
    """The best pages (id, score, snippet), the scores of all that any word hits (id, score), and what the words of the query
    weigh: idf of each token, and which tokens count."""

    top: DataFrame
    scores: DataFrame
    tokens: list[str]
    idfs: list[float]
    counted: list[int]

    @property
    def available(self) -> float:
        """The idf of all tokens that count."""
        return sum(self.idfs[i] for i in self.counted)


def nothing(pages: DataFrame, id_: str = "id") -> Answer:
    """An answer without pages."""
    none = pages.limit(0).select(F.col(id_), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("snippet"))
    return Answer(none, none.select(id_, "score"), [], [], [])


def answer(pages: DataFrame, query: str, fields: Fields, limit: int = 10, rank: str | None = None, digits: int | None = None, terms: int | None = None, prompt: bool = False, stems: bool = False, dated: tuple[str, str] | None = None, bodies=None) -> Answer:
    """The best pages by score, then rank, then id, with the weights of the query's words. No words, no pages.

    dated: columns of a note's day and of whether it is a note; each date in the query is then a token of its own.
    bodies: an index of the pages' bodies, which are then looked up in it and never scanned."""
    tokens = query_tokens(query)
    if prompt:
        tokens, terms = prompt_tokens(query), terms or PROMPT_TERMS
    if not tokens:
        return nothing(pages, fields.id)
    # what scores need of each page is written once: statistics, scores and ranks come from a few numbers a page
    rows = facts(pages, tokens, fields, prompt, stems) if bodies is None else _indexed(pages, tokens, fields, prompt, stems, bodies)
    dates = query_dates(query) if dated else []
    k = len(tokens) + len(dates)
    if dates:
        rows = date_facts(rows, len(tokens), dates, *dated)
    numbers = [f"{c}_{i}" for i in range(k) for c in ("w", "tf", "file", "hit")]
    rows = cut(rows.select(F.col(fields.id), "len", *numbers, *([rank] if rank else [])))
    stats = cut(statistics(rows, k))
    row = stats.first()  # one row of numbers
    df = [row[f"df_{i}"] or 0 for i in range(len(tokens))]
    known = sorted((i for i, d in enumerate(df) if d), key=lambda i: (df[i], i))
    found = scored(rows, stats, k, terms, digits)
    order = [F.desc("score"), *([F.desc(rank)] if rank else []), F.asc(fields.id)]
    top = found.orderBy(*order).limit(limit).select(fields.id, "score", *([rank] if rank else []))
    if not fields.body:
        top = top.withColumn("snippet", F.lit(None).cast("string")).select(fields.id, "score", "snippet")
    else:
        # `limit` rows go out to the pages for their texts
        texts = pages.select(F.col(fields.id), F.col(fields.body).alias("__text")) if bodies is None else bodies.bodies(top.select(F.col(fields.id).alias("id"))).select(F.col("id").alias(fields.id), F.col("body").alias("__text"))
        shown = texts.select(fields.id, T.snippet(F.col("__text"), tokens).alias("snippet"))
        top = shown.join(F.broadcast(top), fields.id).orderBy(*order).select(fields.id, "score", "snippet")
    return Answer(top, found.select(F.col(fields.id), "score"), tokens, [math.log(1 + (row["n"] - d + 0.5) / (d + 0.5)) for d in df], known[:terms] if terms else known)


def _indexed(pages: DataFrame, tokens: list[str], fields: Fields, prompt: bool, stems: bool, bodies) -> DataFrame:
    """facts() of all fields but the body, joined with what an index says of the bodies."""
    rows = facts(pages, tokens, replace(fields, body=None), prompt, stems).drop("len", *[f"tf_{i}" for i in range(len(tokens))])
    said = bodies.counts(tokens).withColumnRenamed("id", "__id")
    sizes = bodies.table("docs").select(F.col("id").alias("__key"), "len")
    rows = rows.join(sizes, F.col(fields.id) == F.col("__key")).drop("__key").join(said, F.col(fields.id) == F.col("__id"), "left").drop("__id")
    found = {f"tf_{i}": F.coalesce(f"tf_{i}", F.lit(0)) for i in range(len(tokens))}
    return rows.withColumns(found).withColumns({f"hit_{i}": F.col(f"hit_{i}") | (F.col(f"tf_{i}") > 0) for i in range(len(tokens))})


def search(pages: DataFrame, query: str, fields: Fields, limit: int = 10, **how) -> DataFrame:
    """id, score and snippet of the best pages; see answer()."""
    return answer(pages, query, fields, limit, **how).top


def tagged(pages: DataFrame, tag: str, path: str = "path", id_: str = "id", tags: str = "tags", limit: int | None = None) -> DataFrame:
    """Pages of a tag by path, for a query without words."""
    out = pages.filter(T.tag_filter(F.col(tags), tag)).orderBy(path, id_)
    return out.limit(limit) if limit else out


def names_page(pages: DataFrame, query: str, least: int, columns: list[str]) -> Column:
    """Whether a word of the query of at least so many characters hits one of the columns (not the body)."""
    out = F.lit(False)
    for t in query_tokens(query):
        if len(t) >= least:
            for c in columns:
                out = out | T.literal_hit(T.field_words(F.coalesce(F.col(c), F.lit(""))), t)
    return out


def notes_tail(notes: DataFrame, query: str, best_code: float, columns: list[str], trust: str = "trust") -> DataFrame:
    """Up to two notes after the code: of the ten best by score those that pass the gate, most trusted first.

    notes: id, score, updated, superseded, trust, and the columns whose words name a note."""
    dates: list[QueryDate] = query_dates(query)
    gate = ~F.col("superseded") & (names_page(notes, query, NOTE_WORD, columns) | dated_on(F.col("updated"), dates) | ((F.col("score") > 0) & (F.col("score") >= 2 * best_code)))
    top = notes.filter(gate).orderBy(F.desc("score"), F.desc("updated"), "id").limit(NOTES_CANDIDATES)
    return top.orderBy(F.desc(trust), F.desc("score"), F.desc("updated"), "id").limit(NOTES_AT_MOST)


def item_facts(items: DataFrame) -> DataFrame:
    """items with the words, and their stems, of name, doc and doc_text: made once, for any number of questions."""
    words = {"__name": T.name_words("name"), "__doc": T.field_words(F.coalesce("doc", F.lit(""))), "__rest": T.field_words(F.coalesce("doc_text", F.lit("")))}
    rows = items.withColumns(words)
    return rows.withColumns({f"{c}_stems": stem_words(F.col(c)) for c in words})


def item_scores(items: DataFrame, tokens: list[str], idfs: list[float]) -> DataFrame:
    """Score of each item (name, owner, doc, doc_text, test) for a query's tokens with their idf; items that nothing hits go."""
    made = [c for c in ("__name", "__doc", "__rest", "__name_stems", "__doc_stems", "__rest_stems") if c not in items.columns]
    rows = item_facts(items) if made else items
    wanted = F.array(*map(F.lit, query_words(tokens)))
    own = F.col("__name")
    spelled = (F.size(own) > 1) & (F.size(F.array_except(own, wanted)) == 0) & (F.size(F.array_except(wanted, own)) == 0)
    total = F.lit(0.0)
    for t, v in zip(tokens, idfs):
        parts = F.array(*[F.lit(stem(p)) for p in query_words([t])])
        whole = spelled | (F.lower("name") == t) | (F.lower(T.qualified_name("owner", "name")) == t)
        name = F.when(whole, ITEM_WHOLE).when(F.array_contains(own, t), ITEM_WORD).when(F.array_contains("__name_stems", stem(t)), ITEM_WORD * T.STEM_TIER).otherwise(0.0)
        doc, rest = (T.field_tier(F.col(c), F.col(f"{c}_stems"), F.lit(t), parts) for c in ("__doc", "__rest"))
        total = total + v * (name + F.when(doc > 0, ITEM_DOC * doc).otherwise(ITEM_DOC_REST * rest))
    rows = rows.withColumn("score", F.when(F.col("test"), total * TEST_FACTOR).otherwise(total)).filter("score > 0")
    return rows.drop(*made)


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int, dedupe: list[str] | None = None) -> DataFrame:
    """The first k rows of each group, of rows equal in `dedupe` the first alone; with column rn."""
    if dedupe:
        first = F.row_number().over(W.partitionBy(*group, *dedupe).orderBy(*order))
        rows = rows.withColumn("__d", first).filter("__d = 1").drop("__d")
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rn") <= k)


def page_symbols(items: DataFrame) -> DataFrame:
    """Up to three best items of each page, one for each place."""
    return top_per_group(items, ["page_id"], [F.desc("score"), "start_line", "name"], SYMBOLS_A_PAGE, ["start_line", "end_line", "owner", "name"])


def relative_cut(rows: DataFrame, group: str, score: str, least: float = RELATIVE_LEAST) -> DataFrame:
    """Rows at their group's best, or at `least` of the best of all; the best of all is one aggregated row."""
    own = F.max(score).over(W.partitionBy(group))
    best = F.broadcast(rows.agg(F.max(score).alias("__best")))
    return rows.withColumn("__own", own).crossJoin(best).filter((F.col(score) >= F.col("__own")) | (F.col(score) >= least * F.col("__best"))).drop("__own", "__best")


def doc_once(rows: DataFrame, group: list[str], doc: str, order: list) -> DataFrame:
    """A doc is shown once for each group; further rows with it lose it."""
    rn = F.row_number().over(W.partitionBy(*group, doc).orderBy(*order))
    return rows.withColumn(doc, F.when(rn == 1, F.col(doc)))


def reciprocal_rank(hits: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """top1 and mrr@k over cases (query, expected) of ranked hits (query, id, rank)."""
    found = cases.join(hits.filter(F.col("rank") <= k), [F.col("expected") == F.col("id"), cases["query"] == hits["query"]], "left")
    return found.agg(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("top1"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def query_names(query: str) -> tuple[list[str], bool]:
    """The identifiers of a query in order, each once, and whether it is made of them alone."""
    words = [w for w in query.split() if re.search(r"[^\W_]", w)]
    names = [re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in words if T.is_identifier(w)]
    return list(dict.fromkeys(names)), bool(words) and len(names) == len(words)


def lone_identifier(query: str, known: list[str]) -> bool:
    """Whether just one token of a query is known, and is written like code: with _, :: or an upper letter after a lower one."""
    found = [t for t in query_tokens(query) if len(t) > 1 and t in known]
    words = (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in query.split())
    return len(found) == 1 and any(w.lower() == found[0] and re.search(r"_|::|[a-z][A-Z]", w) for w in words)


def is_machine_prompt(text: str) -> bool:
    """Whether a prompt opens with a tag, as programs write them, not people."""
    return bool(re.match(r"\s*<[A-Za-z]", text))


PAGE_LINES, ALL_LINES = 2, 8


def hint_rows(lines: DataFrame, page_lines: int = PAGE_LINES, all_lines: int = ALL_LINES) -> DataFrame:
    """The lines of a hint in order (page_rank, rn): no tests or nested items, none that holds another shown line of its
    page, two a page and eight in all. lines: page_rank, page_id, rn, start_line, end_line, test, nested."""
    shown = lines.filter("not test and not nested")
    inner = shown.select(F.col("page_id").alias("i_page"), F.col("start_line").alias("i_start"), F.col("end_line").alias("i_end"), F.col("rn").alias("i_rn"))
    holds = (F.col("page_id") == F.col("i_page")) & (F.col("rn") != F.col("i_rn")) & (F.col("start_line") <= F.col("i_start")) & (F.col("i_end") <= F.col("end_line"))
    plain = shown.join(inner, holds, "left_anti")
    few = plain.withColumn("rn", F.row_number().over(W.partitionBy("page_id").orderBy("rn"))).filter(F.col("rn") <= page_lines)
    return few.orderBy("page_rank", "rn").limit(all_lines)


def rendered_lines(hits: DataFrame) -> DataFrame:
    """(rank, line): each hit (rank, path, title, score, snippet, symbols) as text, its symbol lines under it."""
    head = F.concat_ws("  ", F.col("path"), F.col("title"), F.format_number("score", 2))
    own = F.transform(F.coalesce("symbols", F.array().cast("array<struct<start:int,end:int,name:string,signature:string>>")), lambda s: F.concat(F.lit("  "), F.col("path"), F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit("  "), s["name"], F.lit("  "), T.clip(T.one_line(s["signature"]), 120)))
    said = F.when(F.col("snippet").isNotNull(), F.array(F.concat(F.lit("  "), "snippet"))).otherwise(F.array().cast("array<string>"))
    return hits.select("rank", F.array_join(F.concat(F.array(head), own, said), "\n").alias("line"))
