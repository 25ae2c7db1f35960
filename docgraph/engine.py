"""The engine as one object: build a catalog from files, then ask it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators import catalog, extract, graph, identity, labels, readers, resolve, rewrite, search
from docgraph.operators.index import Index
from docgraph.sources import files as source_files
from docgraph.sources.shared import cut

HINT_PAGES, HINT_SHARE, HINT_WORDS = 5, 0.5, 2


class Engine:
    """Catalog tables of one corpus; every question returns a DataFrame."""

    def __init__(self, pages: DataFrame, edges: DataFrame, ranks: DataFrame, items: DataFrame, calls: DataFrame):
        self.pages, self.edges, self.ranks, self.items, self.calls_ = pages, edges, ranks, items, calls
        self._fields: DataFrame | None = None
        self._labels: DataFrame | None = None
        self._index: Index | None = None

    @classmethod
    def build(cls, spark: SparkSession, files: DataFrame, notes: DataFrame | None = None) -> Engine:
        """files: path, content. Text and Markdown become pages, code becomes pages with items.

        notes: the same of notes about them, which take ids that no other page has and are searched apart."""
        files = source_files.scripts(files)
        docs = readers.pages(files)
        languages = F.create_map(*[F.lit(x) for e, (name, _) in extract._languages().items() for x in (e, f"code:{name}")])
        code = files.withColumn("kind", languages[T.extension("path")]).filter("kind is not null")
        none = F.array().cast("array<string>")
        code = code.select("path", T.derive_name("path").alias("name"), "kind", none.alias("aliases"), none.alias("tags"), F.lit(None).cast("string").alias("created"), F.lit(None).cast("string").alias("updated"), none.alias("supersedes"), F.lit(None).cast("string").alias("summary"), none.alias("headings"), F.col("content").alias("body"))
        no, yes = F.lit(False).alias("memory"), F.lit(True).alias("memory")
        rows = docs.unionByName(code)
        ids = cut(identity.assign(rows.select("name", "path")))
        rows, known = rows.select("*", no), ids.select("path", "id", no)
        if notes is not None:
            said = readers.pages(notes)
            rows = rows.unionByName(said.select("*", yes))
            known = known.unionByName(cut(identity.assign(said.select("name", "path"), ids)).select("path", "id", yes))
        pages = cut(rows.join(known, ["path", "memory"]).withColumnRenamed("name", "title"))

        items = cut(search.item_facts(extract.items(files).join(ids.select(F.col("path").alias("page_id"), "id"), "page_id")))
        links = graph.link_edges(pages).withColumn("kind", F.lit("link"))
        said = graph.mentions(pages, pages.select("id", F.explode(F.concat(F.array("title"), "aliases")).alias("name")))
        said = graph.code_mentions(said, pages).withColumn("kind", F.lit("mention"))
        stems = pages.filter("kind like 'code:%'").select("id", "path", T.module_stem("path").alias("stem"), T.source_rank("path").alias("rank"))
        defined = resolve.defined_fold(items.filter("public and owner is null").join(stems.select("id", "rank"), "id").select("name", "id", "rank"))
        at = ids.select("path", "id")
        by_path = resolve.least_rank(stems.withColumn("at", F.col("path")), "stem", "at", "rank", "path").select("stem", F.col("at").alias("id"))
        named = defined.join(at, "id").select("name", F.col("path").alias("id"))
        imported = resolve.file_edges(extract.imports(files), files, by_path, named)
        imported = imported.join(at.select(F.col("path").alias("src"), F.col("id").alias("s")), "src").join(at.select(F.col("path").alias("dst"), F.col("id").alias("d")), "dst")
        imported = imported.select(F.col("s").alias("src"), F.col("d").alias("dst")).withColumn("kind", F.lit("import"))
        edges = cut(links.unionByName(said).unionByName(imported))
        ranks = graph.pagerank(pages.select("id"), edges)

        key = F.concat_ws("#", F.col("id"), F.col("ix").cast("string"))
        family = F.substring_index("page_id", ".", -1)
        fns = items.filter("kind in ('fn', 'method') and not test").select(key.alias("fn_id"), F.col("id").alias("page_id"), "owner", "name", family.alias("family"), "least", "most", "receiver", F.lit(None).cast("string").alias("namespace"))
        sites = extract.calls(files).join(ids.select(F.col("path").alias("page_id"), "id"), "page_id").withColumn("family", family)
        sites = sites.select(F.concat_ws("#", "id", F.col("caller_ix").cast("string")).alias("caller"), F.col("id").alias("page_id"), "name", "via", "qual", "args", "line", "family")
        sites = sites.withColumn("site_id", F.concat_ws(":", "caller", F.col("line").cast("string"), "name")).join(fns.select(F.col("fn_id").alias("caller"), "owner"), "caller")
        visible = graph.sees(edges.filter("kind = 'import'"), pages.select("id"))
        resolved = resolve.resolve_calls(sites, fns, visible, stems.select(F.col("id").alias("page_id"), "stem"))
        calls = cut(resolved.join(sites.select("site_id", "caller", "line").distinct(), "site_id").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "line"))
        return cls(pages, edges, ranks, items, calls)

    def catalog(self) -> DataFrame:
        return catalog.catalog(self.pages, self.edges, self.ranks)

    def rendered(self, written: DataFrame | None = None) -> DataFrame:
        """(id, page): pages as Markdown, with what code exports and imports; links in prose name ids.

        written: (source, page) of pages written before, whose notes are kept."""
        rows = self.catalog()
        exports = catalog.exports(self.items.withColumn("signature", F.coalesce("signature", "name")), "id")
        told = self.edges.filter("kind = 'import'").join(self.pages.select(F.col("id").alias("dst"), "path"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("path")).alias("imports"))
        rows = rows.join(exports.join(told, "id", "full"), "id", "left")
        prose = rewrite.rewrite_links(rows.filter("kind in ('markdown', 'text')"), self.pages.select("id", "path"))
        rows = prose.unionByName(rows.filter("kind not in ('markdown', 'text')"))
        if written is not None:
            rows = catalog.with_notes(rows.withColumn("source", F.col("path")), written).drop("source")
        return catalog.render(rows)

    def _searchable(self) -> tuple[DataFrame, search.Fields]:
        """Pages with the fields that a search looks at; symbol fields are made once."""
        if self._fields is None:
            own = self.items.filter("not test and kind not in ('module', 'top_level') and not (nested and kind = 'value')").select("id", "name", "owner", "doc", T.qualified_name("owner", "name").alias("qualified"))
            titles = self.pages.select("id", F.split(F.lower("title"), r"\s+").alias("said"))
            own = own.join(titles, "id")
            # names that are words of the page's own title say nothing more; a method is known by its owner too
            whole = F.array_compact(F.array(F.when(~F.array_contains("said", F.lower("name")), F.lower("name")), F.when(F.col("owner").isNotNull(), F.lower("qualified"))))
            words = F.array_except(T.name_words("name"), "said")
            symbols = own.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(whole)))).alias("symbols"), F.array_distinct(F.flatten(F.collect_list(words))).alias("symbol_words"), F.array_join(F.array_sort(F.collect_set("doc")), " ").alias("docs"))
            symbols = symbols.withColumn("symbol_words", F.array_sort(F.array_except("symbol_words", "symbols")))
            none = F.array().cast("array<string>")
            rows = self.pages.join(symbols, "id", "left").join(self.ranks, "id", "left")
            self._fields = cut(rows.withColumns({c: F.coalesce(c, none) for c in ("symbols", "symbol_words")}))
        return self._fields, search.Fields("id", "title", "body", "summary", "aliases", "headings", "path", "symbols", "docs", "symbol_words")

    @property
    def index(self) -> Index:
        """The index of all bodies, built for the first question: no question reads bodies that it doesn't concern."""
        if self._index is None:
            self._index = Index.build(self.pages, search.Fields("id", body="body"))
        return self._index

    def search(self, query: str, kind: str | None = None, tag: str | None = None, limit: int = 10, notes: bool | None = False) -> DataFrame:
        """id, score, snippet; without words but with a tag, its pages by path. notes: of notes alone, or (None) of both."""
        return self._answer(query, kind, tag, limit, notes).top

    def _answer(self, query: str, kind: str | None, tag: str | None, limit: int, notes: bool | None = False) -> search.Answer:
        rows, fields = self._searchable()
        if notes is not None:
            rows = rows.filter(F.col("memory") == notes)
        if kind:
            rows = rows.filter(T.kind_filter("kind", kind))
        if tag:
            if not search.query_tokens(query):
                found = search.tagged(rows, tag, limit=limit).select("id", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("snippet"))
                return search.Answer(found, found.select("id", "score"), [], [], [])
            rows = rows.filter(T.tag_filter("tags", tag))
        # a date in the query is a word that notes of that day have
        rows = rows.withColumn("day", F.col("updated").try_cast("date"))
        return search.answer(rows, query, fields, limit, rank="rank", stems=True, dated=("day", "memory") if notes is not False else None, bodies=self.index)

    def answer(self, query: str, kind: str | None = None, tag: str | None = None, limit: int = 10) -> DataFrame:
        """rank, id, path, title, score, snippet and symbols (up to three lines of code a page) of a search.

        What identifiers in the query name is shown too: a query of them alone gives just their definitions, page by page.
        Lines that score far below the best of their answer go, unless they are their page's best. Up to two notes
        follow: those that the query names or dates, or that score twice as high as any page."""
        found = self._answer(query, kind, tag, limit)
        hits = cut(found.top)
        at = self.pages.select("id", "path", "title")
        names, only = search.query_names(query)
        line = F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end"), "name", F.coalesce("signature", "name").alias("signature"))
        named = self.items.limit(0).select("id", F.lit(0).alias("nth"), line.alias("line"))
        for k, name in enumerate(names):
            named = named.unionByName(self.definitions(name).select("id", F.lit(k).alias("nth"), line.alias("line")))
        own = self.items.join(F.broadcast(hits.select("id")), "id", "left_semi").filter("kind not in ('module', 'top_level') and not (nested and kind = 'value')").withColumn("page_id", F.col("id"))
        best = search.item_scores(own, found.tokens, found.idfs) if found.tokens else own.limit(0).withColumn("score", F.lit(0.0))
        best = search.relative_cut(search.page_symbols(best), "id", "score")
        lines = best.select("id", (F.col("rn") - 1000).alias("nth"), line.alias("line")).unionByName(named).groupBy("id", "line").agg(F.min("nth").alias("nth"))
        if only and not (shown := cut(named)).isEmpty():
            lines = shown.groupBy("id", "line").agg(F.min("nth").alias("nth"))
            pages = lines.groupBy("id").agg(F.min("nth").alias("order")).join(hits, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        else:
            pages = hits.withColumn("order", F.lit(0)).unionByName(named.select("id").distinct().join(hits.select("id"), "id", "left_anti").select("id", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("snippet"), F.lit(1).alias("order")))
        symbols = lines.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]).alias("symbols"))
        if self.has_notes:
            best = hits.agg(F.max("score")).first()[0] or 0.0
            tail = self.notes_tail(query, best).withColumn("order", 2 + F.row_number().over(W.orderBy(F.desc("trust"), F.desc("score"), F.desc("updated"), "id")))  # two notes
            pages = pages.unionByName(tail.select("id", "order", "score", F.lit(None).cast("string").alias("snippet")), allowMissingColumns=True)
        rows = pages.join(at, "id").join(symbols, "id", "left")
        rank = F.row_number().over(W.orderBy("order", F.desc("score"), "id"))  # a few pages
        return rows.select(rank.alias("rank"), "id", "path", "title", "score", "snippet", "symbols").orderBy("rank")

    @property
    def has_notes(self) -> bool:
        return not self.pages.filter("memory").isEmpty()

    def notes_tail(self, query: str, best: float) -> DataFrame:
        """Up to two notes (id, score, updated, superseded, trust, ...) that may follow pages of which the best scores `best`."""
        found = self._answer(query, None, None, search.NOTES_AT_MOST, True)
        notes = self.pages.filter("memory")
        gone = resolve.supersedes(notes.select("id", T.slugify("title").alias("slug"), "title", "aliases", "supersedes", F.lit(True).alias("local"))).select("id", F.lit(True).alias("gone"))
        rows = notes.join(found.scores, "id", "left").join(gone, "id", "left")
        rows = rows.select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("updated").try_cast("date").alias("updated"), F.coalesce("gone", F.lit(False)).alias("superseded"), F.lit(1.0).alias("trust"), "title", F.array_join("aliases", " ").alias("names"), "summary")
        return search.notes_tail(rows, query, best, ["title", "names", "summary"])

    def answer_lines(self, query: str, **how) -> DataFrame:
        return search.rendered_lines(self.answer(query, **how))

    def not_found(self, query: str) -> DataFrame:
        """(name): of a query made of identifiers alone, those that nothing is called by."""
        names, only = search.query_names(query)
        asked = self.pages.sparkSession.createDataFrame([(n,) for n in names if only], "name string")
        items = self.items.select("name", T.qualified_name("owner", "name").alias("qualified"))
        return resolve.not_found(asked, items, self.pages.select("id", "path", "memory"))

    def candidates(self, wanted: str) -> DataFrame:
        """(id): what may have been meant where page() finds nothing."""
        return resolve.candidate_ids(self.pages, wanted)

    def hint_lines(self, prompt: str) -> DataFrame:
        """Up to eight lines of code that a prompt speaks of: (path, start_line, end_line, name, signature)."""
        found, top = self._hint(prompt)
        pages = cut(top)
        order = W.orderBy(F.desc("score"), "id")  # a few pages
        ranked = pages.withColumn("page_rank", F.row_number().over(order)).select("id", "page_rank")
        items = self.items.join(F.broadcast(ranked), "id").withColumn("page_id", F.col("id"))
        scored = search.item_scores(items, found.tokens, found.idfs) if found.tokens else items.limit(0).withColumn("score", F.lit(0.0))
        lines = search.page_symbols(scored).join(self.pages.select("id", "path"), "id")
        return search.hint_rows(lines).select("path", "start_line", "end_line", "name", "signature")

    def hint(self, prompt: str) -> DataFrame:
        """Pages of code that a prompt speaks of: few, and none unless enough of what it says is known to the corpus; see _hint."""
        return self._hint(prompt)[1]

    def _hint(self, prompt: str, function_words: frozenset[str] | None = None) -> tuple[search.Answer, DataFrame]:
        """None for a machine's prompt or one of fewer words than HINT_WORDS; if the best page has less than its share of what
        the prompt's known words weigh; if these are too few and not a lone name; or if function words alone carry it."""
        none = search.nothing(self.pages)
        if search.is_machine_prompt(prompt) or len(search.prompt_tokens(prompt)) < HINT_WORDS:
            return none, none.top
        rows, fields = self._searchable()
        code = rows.filter(T.kind_filter("kind", "code"))
        ask = lambda text: search.answer(code, text, fields, HINT_PAGES, rank="rank", prompt=True, bodies=self.index)
        carries = lambda found: (found.top.agg(F.max("score")).first()[0] or 0.0) >= HINT_SHARE * found.available and not found.top.isEmpty()
        found = ask(prompt)
        known = [found.tokens[i] for i in found.counted]
        if not carries(found) or (len(known) < HINT_WORDS and not search.lone_identifier(prompt, known)):
            return none, none.top
        words = prompt.split()
        rest = [w for w in words if not set(search.query_tokens(w)) & (search.FUNCTION_WORDS if function_words is None else function_words)]
        if len(rest) < len(words):
            plain = " ".join(rest)
            if not (search.lone_identifier(plain, known) if len(search.prompt_tokens(plain)) < HINT_WORDS else carries(ask(plain))):
                return none, none.top
        best = F.broadcast(found.top.agg(F.max("score").alias("best")))
        return found, found.top.crossJoin(best).filter(F.col("score") >= HINT_SHARE * F.col("best")).drop("best")

    def page(self, wanted: str) -> DataFrame:
        return resolve.resolve_id(self.pages, wanted)

    def definitions(self, name: str, limit: int = 3) -> DataFrame:
        """Items of a name, or of owner::name."""
        owner, _, last = name.rpartition("::")
        hit = (F.col("name") == last) & (F.lit(True) if not owner else T.owner_key("owner") == owner.rpartition("::")[2])
        return self.items.filter(hit & ~F.col("kind").isin("module", "top_level")).join(self.ranks, "id", "left").orderBy(F.desc("rank"), "page_id", "start_line").limit(limit)

    def neighbors(self, page_id: str, depth: int = 1, limit: int | None = None, tokens: int | None = None) -> DataFrame:
        """Pages about a page, imports first, then by rank; with `tokens`, as many as fit into that many, in this order."""
        start = self.pages.sparkSession.createDataFrame([(page_id,)], "id string")
        near = graph.neighbourhood(start, self.edges, depth).filter("level > 0")
        imported = self.edges.filter((F.col("kind") == "import") & (F.col("src") == page_id)).select(F.col("dst").alias("id"), F.lit(1).alias("imported"))
        rows = near.join(imported.distinct(), "id", "left").join(self.ranks, "id").join(self.pages.select("id", "title", "summary", T.token_estimate("body").alias("tokens")), "id")
        rows = rows.withColumn("order", F.struct(-F.coalesce("imported", F.lit(0)), -F.col("rank"), F.col("id")))
        if tokens is not None:
            kept = graph.greedy(rows.withColumn("g", F.lit(0)), ["g"], ["order", "id"], "tokens", tokens).select("id")
            rows = rows.join(kept, "id", "left_semi")
        rows = rows.orderBy("order").drop("order", "imported")
        return rows.limit(limit) if limit else rows

    def callers(self, name: str, depth: int | None = 1) -> DataFrame:
        return graph.callers(self._functions(name), self.calls_, depth)

    def calls(self, name: str, depth: int | None = None) -> DataFrame:
        return graph.callees(self._functions(name), self.calls_, depth)

    def _functions(self, name: str) -> DataFrame:
        return self.items.filter((F.col("name") == name) & F.col("kind").isin("fn", "method")).select(F.concat_ws("#", F.col("id"), F.col("ix").cast("string")).alias("id"))

    def doc_search(self, query: str, limit: int | None = None) -> DataFrame:
        if self._labels is None:
            self._labels = cut(labels.labels(self.pages.filter("kind = 'markdown'"), text="body"))
        return labels.search(self._labels, query, limit)

    def lint(self) -> dict[str, DataFrame]:
        ids = self.pages.select("id")
        return {"broken": catalog.broken_links(self.pages.filter("kind in ('markdown', 'text')"), ids), "orphans": graph.orphans(ids, self.edges), "large": catalog.large_pages(self.pages)}

    def fingerprints(self) -> DataFrame:
        """(id, fingerprint) of what a page shows, to tell which pages an edit changed."""
        c = self.catalog()
        return c.select("id", T.fingerprint(F.col("title"), F.col("path"), F.col("body"), F.array_join("neighbors_out", ","), F.array_join("neighbors_in", ",")).alias("fingerprint"))
