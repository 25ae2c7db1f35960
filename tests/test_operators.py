"""Operators on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.functions.dates import QueryDate, query_dates
from docgraph.operators import catalog, extract, flow, graph, identity, labels, resolve, search
from docgraph.sources import files
from docgraph.sources.generator import generate
from docgraph.streaming import sessions


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_pagerank_of_a_dangling_star(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = dict(map(tuple, graph.pagerank(nodes, spark.createDataFrame([("b", "a"), ("c", "a")], "src string, dst string")).collect()))
    assert got["a"] == pytest.approx(27 / 47, abs=1e-4) and got["b"] == got["c"] == pytest.approx(10 / 47, abs=1e-4)
    assert sum(got.values()) == pytest.approx(1)


@pytest.mark.parametrize(
    "query, want",
    [("on 2024-05-03.", [(2024, 5, 3)]), ("03.05.2024 and 03.05", [(2024, 5, 3), (None, 5, 3)]), ("3 May 2024", [(2024, 5, 3)]), ("May 3", [(None, 5, 3)]), ("29 February", [(None, 2, 29)]), ("2023-02-29 31.04.", []), ("3 травня", [(None, 5, 3)])],
)
def test_query_dates(query, want):
    assert query_dates(query) == [QueryDate(*w) for w in want]


def test_text_functions(spark):
    assert one(spark, T.tokenize(F.lit("  (Foo_bar) foo::baz, FOO_BAR -- x"))) == ["foo_bar", "foo::baz", "x"]
    assert one(spark, T.name_words(F.lit("getHTTPResponse_code"))) == ["get", "http", "response", "code"]
    assert one(spark, T.slugify(F.lit("Über Straße, Київ!"))) == "uber_strasse_kyiv"
    assert one(spark, T.slugify(F.lit("!!"))).startswith("page_") and len(one(spark, T.slugify(F.lit("a" * 300)))) == 217
    assert one(spark, T.norm_path(F.lit("a/./b/../c"))) == "a/c" and one(spark, T.norm_path(F.lit("../x"))) is None
    assert one(spark, T.resolve_link(F.lit("d/e.md"), F.lit("../f.md#x"))) == "f.md" and one(spark, T.resolve_link(F.lit("d/e.md"), F.lit("https://x"))) is None
    assert one(spark, T.module_stem(F.lit("src/backends/index.ts"))) == "backends" and one(spark, T.source_rank(F.lit("a/b.h"))) == 0
    assert one(spark, T.first_sentence(F.lit("By J. Doe here. Then more."))) == "By J. Doe here."
    assert one(spark, T.clip(T.one_line(F.lit("a \x1b[31m b\n c")), 4)) == "a b…"
    assert one(spark, T.snippet(F.lit("x" * 80 + " Needle " + "y" * 80), ["needle"])) == "…" + "x" * 59 + " Needle " + "y" * 59 + "…"
    assert one(spark, T.snippet(F.lit("none"), ["needle"])) is None
    assert one(spark, T.front_matter(F.lit("---\ntitle: 'A b'\n---\nx"), "title")) == "A b"
    assert one(spark, T.heading_level(F.lit("## x ##"))) == 2 and one(spark, T.heading_text(F.lit("## x ##"))) == "x" and one(spark, T.heading_level(F.lit("#x"))) == 0
    assert one(spark, T.refers_to_module(F.lit("use graph::walk;"), F.lit("graph"), F.lit("rs"))) and not one(spark, T.refers_to_module(F.lit("a paragraph"), F.lit("graph"), F.lit("rs")))
    assert one(spark, T.names_file(F.lit("a/B.rs"), F.lit("b.rs"))) and not one(spark, T.names_file(F.lit("a/xb.rs"), F.lit("b.rs")))
    assert T.is_identifier("foo_bar") and T.is_identifier("fooBar,") and not T.is_identifier("Foo") and not T.is_identifier("2fa_x")
    with pytest.raises(ValueError):
        T.tag_argument(" #/ ")


def test_search_ranks_a_rare_title_over_volume(spark):
    rows = [("p1", "Zebra", "short", [], "text")] + [("p2", "Other", "zebra common " * 3 + "common " * 80, [], "text")] + [(f"f{i}", "Filler", "common words", [], "text") for i in range(5)]
    df = spark.createDataFrame(rows, "id string, title string, body string, aliases array<string>, kind string")
    fields = search.Fields(title="title", body="body", aliases="aliases")
    got = search.search(df, "zebra common", fields).collect()
    assert got[0]["id"] == "p1" and search.search(df, " ,. ", fields).count() == 0
    assert [r["id"] for r in search.search(df.repartition(5), "zebra common", fields).collect()] == [r["id"] for r in got]


def test_more_occurrences_score_higher(spark):
    df = spark.createDataFrame([("a", "w " * 25 + "x " * 15), ("b", "w " * 40)], "id string, body string")
    got = {r["id"]: r["score"] for r in search.search(df, "w", search.Fields(body="body")).collect()}
    assert got["b"] > got["a"]


def test_symbol_lines(spark):
    df = spark.createDataFrame([("p", "resolve_link", None, "Joins links.", None, False, 1, 2), ("p", "resolve", None, None, None, False, 5, 6), ("p", "resolve", None, None, None, True, 8, 9), ("p", "walk", None, None, "resolve", False, 9, 9)], "page_id string, name string, owner string, doc string, doc_text string, test boolean, start_line int, end_line int")
    got = {(r["name"], r["start_line"]): r["score"] for r in search.item_scores(df, ["resolve"], [1.0]).collect()}
    assert got == {("resolve_link", 1): 2.0, ("resolve", 5): 3.5, ("resolve", 8): 1.75, ("walk", 9): 0.5}
    assert [r["name"] for r in search.page_symbols(search.item_scores(df, ["resolve", "link"], [1.0, 1.0])).orderBy("rn").collect()][0] == "resolve_link"


def test_defined_fold_and_tiers(spark):
    df = spark.createDataFrame([("x", "a", 2), ("x", "b", 1), ("y", "a", 1), ("y", "b", 1), ("y", "c", 0), ("z", "a", 1), ("z", "b", 2)], "name string, id string, rank int")
    assert dict(map(tuple, resolve.defined_fold(df).collect())) == {"x": "b", "y": None, "z": "a"}
    c = spark.createDataFrame([(1, "f", 5), (1, "g", 5), (2, "f", 5), (3, "f", 2), (3, "g", 5)], "site int, fn string, tier int")
    assert sorted((r["site"], r["fn"]) for r in resolve.first_tier(c, ["site"], only=[5]).collect()) == [(2, "f"), (3, "f")]


def test_target_forms(spark):
    forms = {(0, True): "outside", (0, False): "hidden", (1, False): "resolved", (1, True): "one_of", (2, False): "one_of"}
    for (n, open_), want in forms.items():
        assert one(spark, resolve.target_form(F.array(*[F.lit(i) for i in range(n)]), F.lit(open_))) == want


def test_mentions_take_the_longest_name_at_each_word(spark):
    pages = spark.createDataFrame([(1, "the red bolt and a red nut"), (2, "red bolt is me")], "id int, body string")
    names = spark.createDataFrame([(2, "Red Bolt"), (3, "red"), (4, "bolt"), (5, "")], "id int, name string")
    assert sorted(map(tuple, graph.mentions(pages, names).collect())) == [(1, 2), (1, 3), (1, 4), (2, 4)]


def test_ids_are_unique_and_do_not_depend_on_order(spark):
    paths = ["a/mod.rs", "b/mod.rs", "c/x/util.h", "c/x/util.cpp", "d/x/util.cpp", "Index.md", "u.py", "U.py"]
    df = spark.createDataFrame([(p.rsplit("/", 1)[-1].split(".")[0], p) for p in paths], "name string, path string")
    got = {r["path"]: r["id"] for r in identity.assign(df).collect()}
    assert len(set(got.values())) == len(paths) and "index" not in got.values()
    assert got["a/mod.rs"] == "a_mod" and got["b/mod.rs"] == "b_mod"
    assert {r["path"]: r["id"] for r in identity.assign(df.repartition(7).orderBy(F.desc("path"))).collect()} == got


def test_greedy_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("q", k, s) for k, s in enumerate([5, 9, 3, 4, 2])], "g string, k int, size long")
    assert sorted(r["k"] for r in graph.greedy(df, ["g"], ["k"], "size", 10).collect()) == [0, 2, 4]


def test_lint_ignores_links_in_code(spark):
    df = spark.createDataFrame([("a", "see [[B]] and [[Gone|x]] `[[code]]`\n```\n[[fenced]]\n```\n", "markdown")], "id string, body string, kind string")
    assert [tuple(r) for r in catalog.broken_links(df, spark.createDataFrame([("b",)], "id string")).collect()] == [("a", "Gone")]


def test_catalog_and_render(spark):
    pages = spark.createDataFrame([("a", "A", "x/a.md", "markdown", "body text"), ("b", "B", "x/b.md", "markdown", "b")], "id string, title string, path string, kind string, body string")
    edges = spark.createDataFrame([("a", "b", "link"), ("a", "b", "mention"), ("b", "a", "import")], "src string, dst string, kind string")
    rows = catalog.catalog(pages, edges, spark.createDataFrame([("a", 0.5), ("b", 0.5)], "id string, rank double"))
    got = {r["id"]: r for r in rows.collect()}
    assert got["a"]["neighbors_out"] == ["b"] and got["a"]["degree_in"] == 1 and got["a"]["imports_in"] == ["b"] and got["a"]["token_estimate"] == 2
    assert "## Imported by\n- [[b]]\n" in {r["id"]: r["page"] for r in catalog.render(rows).collect()}["a"]


def test_labels():
    text = "# Top\n**Step one** do\n  - **Inner**\n```\n# not me\n```\n## Sub\n**Field:** x\nend"
    assert labels.find(text) == [(1, 9, 1, "Top"), (2, 6, 7, "Step one"), (3, 6, 8, "Inner"), (7, 9, 2, "Sub")]


def test_label_search_takes_the_first_tier(spark):
    df = spark.createDataFrame([("d", "# Task 4: Write the parser\n# Parser writes task\n# T12 go\n")], "path string, text string")
    found = labels.labels(df)
    assert [r["label"] for r in labels.search(found, "write the").collect()] == ["Task 4: Write the parser"]
    assert [r["label"] for r in labels.search(found, "task parser").collect()] == ["Task 4: Write the parser", "Parser writes task"]
    assert labels.search(found, "").count() == 3


def test_python_items_and_calls():
    f = extract.python("__all__ = ['f']\nX: int = 1\ndef f(a, b=1, *c):\n    '''One. Two.'''\n    g(a, *b)\n    def h(): pass\nclass C(B):\n    @staticmethod\n    def s(x): return self.y(1)\n    def _p(self, x): x.q()\ndef g(): pass\n")
    got = {(i.kind, i.name): i for i in f.items}
    assert got["fn", "f"].public and not got["fn", "g"].public and got["fn", "h"].nested
    assert (got["fn", "f"].least, got["fn", "f"].most, got["fn", "f"].doc) == (1, None, "One.")
    assert (got["method", "s"].least, got["method", "s"].receiver, got["method", "_p"].least) == (1, False, 1)
    assert [(c.name, c.via, c.qual, c.args) for c in f.calls] == [("g", "bare", None, None), ("y", "self", None, 1), ("q", "member", "x", 0)]
    assert extract.python("def broken(:").items == []


def test_flow_edges():
    steps = flow.functions("def f(x):\n    for i in x:\n        if i:\n            break\n        g(i)\n    return 1\n")[0][1]
    kinds = {s[0]: s[4] for s in steps}
    edges = flow.edges(steps)
    assert [kinds[k] for k in sorted(kinds)] == ["function", "loop", "branch", "exit", "call", "exit"]
    assert (1, 2, "loop") in edges and (2, 3, "yes") in edges and (2, 4, "no") in edges and (4, 1, "") in edges and (1, 5, "done") in edges and (3, 5, "") in edges
    assert {b for _, b, _ in edges} >= set(kinds) - {0}
    assert flow.mermaid(steps, edges).startswith("flowchart TD")


def test_tree_walk_obeys_ignore_rules(spark, tmp_path):
    for p in ("a.py", "b.log", "keep.log", "node_modules/x.js", "sub/c.py", ".hidden", "out/d.py", "run"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("#!/bin/sh\n" if p == "run" else "x = 1\n")
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\nout/\n")
    assert files.listing(str(tmp_path)) == ["a.py", "keep.log", "run", "sub/c.py"]
    got = {r["path"]: r["content"] for r in files.scripts(files.read_tree(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.py", "keep.log", "run.sh", "sub/c.py"} and got["a.py"] == "x = 1\n"


def test_whole_evaluation_uses_short_words_and_whole_texts(spark, tmp_path):
    from docgraph.plans import search_queries

    start = "one two six ten red sun sky sea hat cup "
    items = [(1, start * 2 + "end a"), (2, "a cat sat on  the mat"), (3, "nowhere to be found"), (4, None)]
    docs = [(10, start * 2 + "end b"), (11, "x " + start * 2 + "end a y"), (12, "the mat the cat"), (13, "cat a the sat mat on a cat sat on the"), (14, "so a cat\nsat on the mat"), (15, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ranks = []
    for _, text in items:
        own = set((text or "").split())
        best = sorted((-len(own & set((t or "").split())), d, " ".join((t or "").split())) for d, t in docs if own & set((t or "").split()))
        ranks.append(next((k + 1 for k, (_, _, t) in enumerate(best[:10]) if " ".join((text or "").split()) in t), None))
    assert ranks == [1, 2, None, None]
    got = search_queries.eval_mrr_whole(spark, str(tmp_path)).first()
    assert tuple(got) == (0.25, 0.375)


def test_generator_is_the_same_under_any_partitioning(spark):
    assert generate(spark, 50, 1).orderBy("path").collect() == generate(spark, 50, 1).repartition(7).orderBy("path").collect()
    assert generate(spark, 50, 2).orderBy("path").collect() != generate(spark, 50, 1).orderBy("path").collect()


def test_capped_sessions(spark):
    df = spark.createDataFrame([("p", t) for t in (0.0, 0.1, 0.2, 1.0, 1.1, 1.2, 5.0)], "path string, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    assert sorted((round(r["started"], 1), r["n"]) for r in sessions.capped(df, "ts", ["path"], 0.9, 0.5).collect()) == [(0.0, 3), (1.0, 3), (5.0, 1)]


def test_stream_keeps_pages_current(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "path string, version long, body string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema).write.parquet(f"{src}/1")
    for step in (1, 2):
        stream = spark.readStream.schema(schema).parquet(f"{src}/*")
        sessions.keep_current(stream, out, str(tmp_path / "check")).awaitTermination()
        if step == 1:
            spark.createDataFrame([("a", 2, "z")], schema).write.parquet(f"{src}/2")
    assert sorted((r["path"], r["body"]) for r in sessions.current(spark, out).collect()) == [("a", "z"), ("b", "y")]
