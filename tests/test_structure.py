"""Names, ids, labels, walks, pairs, links and outlines in the cases that tables of orders don't have."""

import glob
import random
import time
from collections import deque

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docgraph.operators import graph, identity, labels, outline, resolve, rewrite, search


def test_names_of_any_length_are_found(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(6)]
    texts = {i: [rng.choice(words) for _ in range(rng.randrange(60))] for i in range(12)}
    names = {100 + k: [rng.choice(words) for _ in range(k % 19 + 1)] for k in range(40)}
    for k, n in list(names.items())[:12]:  # so that long ones occur
        texts[k % 12][5:5] = n
    want = set()
    for i, t in texts.items():
        for at in range(len(t)):
            best = max(((len(n), -k) for k, n in names.items() if t[at : at + len(n)] == n), default=None)
            if best:
                want.add((i, -best[1]))
    pages = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(50, None), (51, "")], "id int, body string")
    named = spark.createDataFrame([(k, " ".join(n).upper()) for k, n in names.items()] + [(7, None), (8, "--")], "id int, name string")
    assert {tuple(r) for r in graph.mentions(pages, named).collect()} == want and max(map(len, names.values())) == 19
    assert graph.mentions(pages, named.limit(0)).collect() == []


def test_pages_are_matched_where_they_lie_whatever_the_names(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(4)]
    texts = [(rng.randrange(30), " ".join(rng.choice(words) for _ in range(rng.randrange(50)))) for _ in range(25)] + [(None, "w0 w1")]
    names = [(f"n{k}", " ".join(rng.choice(words) for _ in range(k % 9 + 1))) for k in range(30)]
    pages = spark.createDataFrame([(f"p{i}" if i is not None else None, b) for i, b in texts], "id string, body string")
    named = spark.createDataFrame(names, "id string, name string")
    places = {}
    for i, body in texts:
        t = body.split()
        for at in range(len(t)) if i is not None else ():
            found = [(-len(n.split()), d) for d, n in names if t[at : at + len(n.split())] == n.split()]
            places[i, at] = min([*found, *([places[i, at]] if (i, at) in places else [])], default=(0, None))
    want = {(f"p{i}", d) for (i, _), (_, d) in places.items() if d}
    assert len({i for i, _ in texts}) < len(texts) - 1  # pages of one id: the longest name at a place of any counts
    assert {tuple(r) for r in graph.mentions(pages, named).collect()} == want
    monkeypatch.setattr(graph, "WORDS", 20)
    assert {tuple(r) for r in graph.mentions(pages, named).collect()} == want
    alone = pages.dropDuplicates(["id"])
    got = graph.mentions(alone, named)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "SENT", 10)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in graph.mentions(alone, named).collect()}


def test_ids_of_deep_trees_and_many_suffixes_come_apart(spark):
    deep = [f"{c}/{'/'.join(['x'] * 30)}/mod.rs" for c in "abc"]
    dotted = ["p/y.a.b.c.d.e.f.g.h.i.j.k.md", "p/y.a.b.c.d.e.f.g.h.i.j.l.md"]
    rows = [("mod", p) for p in deep] + [("y", p) for p in dotted]
    got = {r["path"]: r["id"] for r in identity.assign(spark.createDataFrame(rows, "name string, path string")).collect()}
    assert [got[p].split("_")[0] for p in deep] == ["a", "b", "c"] and all(i.endswith("_mod") for i in got.values() if "mod" in i)
    assert {got[p] for p in dotted} == {"y_a_b_c_d_e_f_g_h_i_j_k_md", "y_a_b_c_d_e_f_g_h_i_j_l_md"}


def test_numbers_pass_over_ids_that_pages_have(spark):
    rows = [("Note", "a"), ("Note", "b"), ("Note", "c"), ("Note 2", "d"), ("Note 4", "e"), ("Note 4", "f"), ("Index", "g"), ("Taken", "h"), (None, "i")]
    taken = spark.createDataFrame([("taken",), ("note_3",)], "id string")
    got = {r["path"]: r["id"] for r in identity.assign(spark.createDataFrame(rows, "name string, path string"), taken).collect()}
    assert {got[p] for p in "abc"} == {"note", "note_5", "note_6"} and (got["a"], got["b"], got["c"]) == ("note", "note_5", "note_6")
    assert (got["d"], got["e"], got["f"], got["g"], got["h"]) == ("note_2", "note_4", "note_4_2", "index_2", "taken_2")
    assert len(set(got.values())) == len(rows)


# ---- labels


def found(spark, *texts):
    return labels.labels(spark.createDataFrame([(f"d{k}.md", t) for k, t in enumerate(texts)], "path string, text string"))


def ask(rows, query, limit=None):
    return [(r["doc"], r["label"]) for r in labels.search(rows, query, limit).collect()]


def test_headings_come_before_bold_names_and_fronts_before_the_rest(spark):
    rows = found(spark, "**Set up the tree.**\n\n# Before you set up\n\n# Set up\n", "## Set-up of it\n")
    assert ask(rows, "set up", 1) == [("d0.md", "Set up")]
    assert ask(rows, "set up", 2) == [("d0.md", "Set up"), ("d0.md", "Before you set up")]
    # hyphens split words only after all others
    assert ask(rows, "set up") == [("d0.md", "Set up"), ("d0.md", "Before you set up"), ("d0.md", "Set up the tree."), ("d1.md", "Set-up of it")]
    assert labels.search(rows, "set up", 1).first()["cut"] == 3


def test_a_query_may_name_several_labels(spark):
    rows = found(spark, "# Alpha one\n\n# Beta two\n\n# T4a: fix\n\n# Pins\n\n# Pins again\n", "# Beta two more\n")
    assert ask(rows, "alpha one beta two") == [("d0.md", "Alpha one"), ("d0.md", "Beta two"), ("d1.md", "Beta two more")]
    assert ask(rows, "pins t4a") == [("d0.md", "Pins"), ("d0.md", "T4a: fix")]
    assert {r["reading"] for r in labels.search(rows, "pins t4a").collect()} == {"parts"}
    assert labels.segments(rows, ["so", "alpha", "one", "beta"]) == [["alpha", "one"]]


def test_loose_readings_come_last(spark):
    rows = found(spark, "# 11.4 Of mice\n\n# Write the parser now\n\n# Now parser\n")
    assert ask(rows, "11.4 whatever") == [("d0.md", "11.4 Of mice")]
    assert ask(rows, "parser for the write") == [("d0.md", "Write the parser now")]
    assert ask(rows, "nothing here") == [] and ask(rows, "zzz") == []
    assert len(ask(rows, "")) == 3 and len(ask(rows, "", 2)) == 2


def test_the_limit_shows_first_and_last_of_a_repeated_head(spark):
    rows = found(spark, "\n".join(f"# N1: part {i}" for i in range(7)))
    assert [x[1] for x in ask(rows, "n1", 4)] == ["N1: part 0", "N1: part 1", "N1: part 5", "N1: part 6"]


def test_labels_end_before_the_next_of_their_level(spark):
    text = "# A\n## B\n**c** x\n  **d** y\n## E\n# F\n"
    assert [(s, e, label) for s, e, _, label in labels.find(text)] == [(1, 5, "A"), (2, 4, "B"), (3, 4, "c"), (4, 4, "d"), (5, 5, "E"), (6, 7, "F")]


# ---- walks, pairs, inheritance


def test_a_walk_meets_nodes_as_a_queue_does(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40), k) for k in range(90)]
    out = {}
    for s, d, k in edges:
        out.setdefault(s, []).append((k, d))
    queue, seen, want = deque([(3, 0), (1, 0)]), {3, 1}, []
    while queue:
        node, level = queue.popleft()
        if level:
            want.append((node, level))
        for _, d in sorted(out.get(node, [])):
            if d not in seen:
                seen.add(d)
                queue.append((d, level + 1))
    starts = spark.createDataFrame([(3, 0), (1, 1)], "id int, nth int")
    rows = graph.walk_order(starts, spark.createDataFrame(edges, "src int, dst int, nth int"))
    got = [(r["id"], r["level"]) for r in rows.orderBy("place").collect()]
    assert got == want and len(got) > 10
    near = graph.walk_order(starts, spark.createDataFrame(edges, "src int, dst int, nth int"), 1)
    assert [(r["id"], r["level"]) for r in near.orderBy("place").collect()] == [x for x in want if x[1] == 1]
    fits = graph.longest_prefix(rows.withColumn("all", F.lit(0)), ["all"], [F.col("place")], F.lit(4), 18)
    assert [r["place"] for r in fits.orderBy("place").collect()] == [1, 2, 3, 4]


def test_pairs_of_a_stage_block_later_ones(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, None, 5)], "l int, k string, n int")
    right = spark.createDataFrame([(11, "a", 1), (13, "b", 2), (14, None, 5), (15, "c", 1)], "r int, k string, n int")
    got = {(x["l"], x["r"], x["stage"]) for x in resolve.staged_pairs(left, right, [["k", "n"], ["k"], ["n"]], "l", "r").collect()}
    # 2 stays alone: a stands for two on the left, though 1 is paired; 3 pairs with 13 by k
    assert got == {(1, 11, 0), (4, 14, 0), (3, 13, 1)}


def test_the_first_base_in_order_gives_the_method(spark):
    bases = spark.createDataFrame([("D", 0, "B"), ("D", 1, "C"), ("B", 0, "A"), ("C", 0, None), ("E", 0, None), ("E", 1, "A"), ("L", 0, "L2"), ("L2", 0, "L")], "class string, position int, base string")
    methods = spark.createDataFrame([("A", "run"), ("C", "run"), ("C", "stop"), ("D", "own")], "class string, name string")
    asked = spark.createDataFrame([("D", "run"), ("D", "stop"), ("D", "none"), ("E", "run"), ("L", "run"), ("A", "run")], "class string, name string")
    got = {(r["class"], r["name"]): (r["found"], r["open"]) for r in resolve.inherited(asked, bases, methods).collect()}
    assert got == {("D", "run"): ("A", False), ("D", "stop"): ("C", False), ("D", "none"): (None, True), ("E", "run"): ("A", True), ("L", "run"): (None, True), ("A", "run"): (None, False)}
    below = resolve.overrides(spark.createDataFrame([("A", "run"), ("C", "own")], "class string, name string"), bases, methods)
    assert {tuple(r) for r in below.collect()} == {("C", "own", "D")}


def _written(folder):
    """Rows in all cut points of a folder."""
    return sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{folder}/cut-*/*.parquet"))


def test_work_on_classes_grows_with_classes_not_with_ways(spark, tmp_path, monkeypatch):
    from docgraph.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    width, depth = 6, 8  # each class of a layer has all classes of the layer below as bases
    at = lambda layer, k: layer * width + k
    rows = [(at(d, a), b, at(d - 1, b)) for d in range(1, depth) for a in range(width) for b in range(width)]
    bases = spark.createDataFrame(rows, "class int, position int, base int")
    methods = spark.createDataFrame([(at(0, 4), "run"), (at(2, 3), "run")], "class int, name string")
    asked = spark.createDataFrame([(c, "run") for c in range(width * depth)], "class int, name string")
    got = {r["class"]: (r["found"], r["open"]) for r in resolve.inherited(asked, bases, methods).collect()}
    # the first base leads down to the last layer by 0, 0, ..., 4, which is before any way by class 3 of layer 2
    assert got == {c: (at(0, 4) if c >= width else None, False) for c in range(width * depth)}
    assert _written(tmp_path) < 2 * depth * len(rows)


def test_walks_to_overrides_enter_only_classes_that_lead_to_one(spark, tmp_path, monkeypatch):
    from docgraph.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    width, depth = 6, 8
    at = lambda layer, k: layer * width + k
    rows = [(at(d, a), b, at(d - 1, b)) for d in range(1, depth) for a in range(width) for b in range(width)]
    bases = spark.createDataFrame(rows, "class int, position int, base int")
    methods = spark.createDataFrame([(at(0, 4), "run"), (at(2, 3), "run")], "class int, name string")
    leaves = [(1000 + k, 0, at(depth - 1, k % width)) for k in range(500)]  # without the method and nobody's base
    below = resolve.overrides(methods, bases.unionByName(spark.createDataFrame(leaves, bases.schema)), methods)
    assert {tuple(r) for r in below.collect()} == {(at(0, 4), "run", at(2, 3))}
    assert _written(tmp_path) < 2 * len(rows) + len(leaves)


def test_a_class_in_a_cycle_is_not_below_itself(spark):
    bases = spark.createDataFrame([("A", 0, "B"), ("B", 0, "A")], "class string, position int, base string")
    methods = spark.createDataFrame([("A", "run"), ("B", "run")], "class string, name string")
    assert {tuple(r) for r in resolve.overrides(methods, bases, methods).collect()} == {("A", "run", "B"), ("B", "run", "A")}


@pytest.mark.parametrize("seed", [0, 1])
def test_overrides_equal_a_walk_from_each_class(spark, seed):
    rng = random.Random(seed)
    # classes 0 to 29 without loops but that of 7, 30 to 49 with some, one of them above and below the others
    edges = {(c, rng.randrange(c)) for c in range(1, 30) for _ in range(2)} | {(rng.randrange(30, 50), rng.randrange(30, 50)) for _ in range(22)} | {(30, 31), (31, 32), (32, 30), (4, 30), (31, 20), (7, 7)}
    methods = {(c, f"m{rng.randrange(3)}") for c in range(50) if rng.random() < 0.6}
    asked = {m for m in methods if rng.random() < 0.7} | {(c, "m0") for c in range(0, 50, 9)} | {(99, "m1")}
    want = set()
    for c, name in asked:
        seen, open_ = {c}, [c]
        while open_:
            node = open_.pop()
            more = {a for a, b in edges if b == node} - seen
            seen |= more
            open_ += more
        want |= {(c, name, node) for node in seen - {c} if (node, name) in methods}
    bases = spark.createDataFrame([(a, 0, b) for a, b in edges] + [(5, 1, None), (40, 1, None)], "class int, position int, base int")
    got = [tuple(r) for r in resolve.overrides(spark.createDataFrame(list(asked), "class int, name string"), bases, spark.createDataFrame(list(methods), "class int, name string")).collect()]
    assert sorted(got) == sorted(want) and len(got) > 20


# ---- links and outlines


@pytest.mark.parametrize(
    "text, want",
    [
        ("see [[Big Page]] and [[Gone]]", "see [[big_page]] and [[Gone]]"),
        ("[[Big Page#top|shown]] [[big_page]]", "[[big_page#top|shown]] [[big_page]]"),
        ("`[[Big Page]]` ``a ` [[Big Page]]`` [[Big Page]]", "`[[Big Page]]` ``a ` [[Big Page]]`` [[big_page]]"),
        ("```\n[[Big Page]]\n```\n[[Big Page]]", "```\n[[Big Page]]\n```\n[[big_page]]"),
        ("~~~ x\n[[Big Page]]\nnever closed", "~~~ x\n[[Big Page]]\nnever closed"),
        ("[a](../x/big.md#s) [b](gone.md) [c](http://x/big.md)", "[a](big_page.md#s) [b](gone.md) [c](http://x/big.md)"),
        ("#1st\nno #12 a#3b #4x/ #5/", "\\#1st\nno #12 a#3b \\#4x/ #5/"),
        ("one ` tick [[Big Page]]", "one ` tick [[big_page]]"),
        ("", ""),
        (None, None),
    ],
)
def test_links_are_rewritten_outside_code(spark, text, want):
    ids = spark.createDataFrame([("big_page", "x/big.md")], "id string, path string")
    pages = spark.createDataFrame([("p", "d/p.md", text, 1)], "id string, path string, body string, extra int")
    out = rewrite.rewrite_links(pages, ids)
    assert out.columns == pages.columns and out.first()["body"] == want


def test_a_page_of_very_many_links_takes_time_by_its_length(spark):
    ids = spark.createDataFrame([("big_page", "x/big.md")], "id string, path string")
    parts = [("[[Big Page|{}]] [[Gone]] #1st", "[[big_page|{}]] [[Gone]] \\#1st"), ("[a](../x/big.md#{0}) `[[Big Page]]` w{0}", "[a](big_page.md#{0}) `[[Big Page]]` w{0}")]
    text, want = (" ".join(parts[i % 2][k].format(i) for i in range(60_000)) for k in (0, 1))
    pages = spark.createDataFrame([("p", "d/p.md", text), ("q", None, "[[Big Page]] [b](/x/big.md) [c](x/big.md)")], "id string, path string, body string")
    start = time.monotonic()
    got = {r["id"]: r["body"] for r in rewrite.rewrite_links(pages, ids).collect()}
    assert got["p"] == want and got["q"] == "[[big_page]] [b](big_page.md) [c](x/big.md)"
    assert time.monotonic() - start < 120  # looking each piece up in a list of all links took 10^10 steps


def test_outlines_are_cut_as_little_as_it_takes(spark):
    def page(name, *lines):
        return [(name, k + 1, kind, test, size, doc) for k, (kind, test, size, doc) in enumerate(lines)]

    plain, tested = ("item", False, 40, 0), ("item", True, 40, None)
    rows = page("whole", plain) + page("tests", plain, tested, tested, tested) + page("only", *[tested] * 5) + page("docs", ("item", False, 40, 120), plain) + page("imports", plain, *[("import", None, 40, None)] * 4) + page("ceiling", ("head", None, 10, None), *[plain] * 9) + page("bare", ("head", None, 400, None))
    lines = spark.createDataFrame(rows, "page string, at int, kind string, test boolean, size int, doc_size int")
    got = {r["page"]: (r["level"], r["shown"], r["marker"]) for r in outline.cuts(lines, 33).collect()}
    assert got["whole"] == (0, 1, "") and got["tests"][:2] == (1, 1) and got["docs"][:2] == (2, 2) and got["imports"][:2] == (3, 1)
    assert got["tests"][2] == "… dropped: 3 test items — pass max_tokens: 40 for all\n"
    assert got["only"][:2] == (4, 1) and got["ceiling"][0] == 4 and got["ceiling"][2].startswith(f"… {9 - got['ceiling'][1]} more items from line {got['ceiling'][1] + 2}")
    assert got["bare"][:2] == (4, 0)


def test_items_are_scored_by_how_rare_the_words_are(spark):
    schema = "id int, name string, owner string, doc string, doc_text string, test boolean"
    items = spark.createDataFrame([(1, "common_word", None, None, None, False), (2, "rare_word", None, None, None, False), (3, "x", "Owner", "provisioned", None, False), (4, "x", None, None, "rare", True), (5, "y", None, None, None, False)], schema)
    got = {r["id"]: round(r["score"], 6) for r in search.item_scores(items, ["common", "rare", "provisioning", "owner::x"], [0.1, 2.0, 1.0, 3.0]).collect()}
    assert got == {1: 0.2, 2: 4.0, 3: round(0.3 + 3 * 3.5, 6), 4: 0.5}


def test_admission_in_order_needs_few_rows_of_each_size(spark):
    rng = random.Random(4)
    rows = [(g, k, rng.choice([0, 1, 2, 3, 5, 8, 40])) for g in "ab" for k in range(400)]
    want = []
    for g in "ab":
        left = 50
        for _, k, size in (r for r in rows if r[0] == g):
            if size <= left:
                left -= size
                want.append((g, k))
    rng.shuffle(rows)
    got = graph.greedy(spark.createDataFrame(rows, "g string, k int, size long"), ["g"], ["k"], "size", 50)
    assert sorted((r["g"], r["k"]) for r in got.collect()) == sorted(want)
