"""Indexes, automata, generations and the live loop against plain Python."""

import random
import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from docgraph.operators import automaton, delta, index, order, search
from docgraph.sources.store import Store
from docgraph.streaming import live

WORDS = "red bolt Red-bolt bolts cold kalt ab a é über 中文 ringing ring order-book _x_ v1.2".split()


def pages(n=60, seed=1):
    rng = random.Random(seed)
    text = lambda k: rng.choice([" ", "\n", ", "]).join(rng.choice(WORDS) for _ in range(rng.randrange(k)))
    return [(f"p{i}", rng.choice([None, text(4)]), rng.choice([None, "", text(40)]), text(6), [text(3) for _ in range(rng.randrange(3))], [text(3)], f"src/{text(1) or 'x'}/f{i % 9}.rs", rng.random(), rng.choice("ab")) for i in range(n)]


SCHEMA = "id string, title string, body string, summary string, aliases array<string>, headings array<string>, path string, rank double, kind string"
FIELDS = search.Fields("id", "title", "body", "summary", "aliases", "headings", "path")


@pytest.fixture(scope="module")
def built(spark):
    rows = spark.createDataFrame(pages(), SCHEMA)
    return rows, index.Index.build(rows, FIELDS, keep=("rank", "kind"), parts=3, slots=4, block=7)


@pytest.mark.parametrize("query", ["a", "ab bolt 中", "order-book v1.2", "ringing cold zzz f3.rs", "", "BOLTS über 中文"])
def test_an_index_answers_as_a_scan_does(built, query):
    rows, made = built
    for where in (None, F.col("kind") == "a") if query == "ab bolt 中" else (None,):
        want = search.search(rows if where is None else rows.filter(where), query, FIELDS, limit=25, rank="rank", digits=6).collect()
        got = made.search(query, limit=25, rank="rank", digits=6, where=where).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_an_index_opens_again_and_prompts_take_the_rarest_terms(spark, built):
    rows, made = built
    again = index.Index.open(spark, made.folder)
    assert again == made
    query = "red bolt cold ring a ab"
    want = search.search(rows, query, FIELDS, limit=9, digits=6, prompt=True, terms=2).collect()
    assert [tuple(r) for r in again.search(query, limit=9, digits=6, prompt=True, terms=2).collect()] == [tuple(r) for r in want]


def test_terms_are_read_from_the_parts_that_hold_them(built):
    _, made = built
    plan = made._grams([index._span("é")])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan) and "PushedFilters: [" in plan
    some = {r["part"] for r in made._words(["kalt"], []).select("part").distinct().collect()}
    assert some and some < {p for p, _, _ in made.bounds["words"]}


def test_many_candidates_are_counted_where_the_bodies_lie(spark, built, monkeypatch):
    rows, _ = built
    monkeypatch.setattr(index, "SHARE", 10)
    monkeypatch.setattr(index, "SENT", 5)
    made = index.Index.build(rows, FIELDS, keep=("kind",), parts=3, slots=4, block=7)
    assert made.slots >= 7 and made.table("grams").schema["ords"].dataType.elementType.simpleString() == "smallint"
    assert {r["part"] for r in made.table("grams").select("part").distinct().collect()} > {0, 1, 2}
    for query, where in (("ab bolt", None), ("bolts cold", None), ("ab bolt", F.col("kind") == "a")):
        assert "Join" not in made.counts(query.split(), where)._jdf.queryExecution().executedPlan().toString()
        want = search.search(rows if where is None else rows.filter(where), query, FIELDS, limit=25, digits=6).collect()
        assert [tuple(r) for r in made.search(query, limit=25, digits=6, where=where).collect()] == [tuple(r) for r in want]


def test_an_index_shuffles_a_page_and_a_list_of_pages_once(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij ") for _ in range(400))
    rows = spark.createDataFrame([(i, text) for i in range(160)], "id int, body string").repartition(16).localCheckpoint()

    def moved():  # records that all stages so far have shuffled
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = moved()
    made = index.Index.build(rows, search.Fields("id", body="body"), parts=2, slots=2, block=1000)
    lists = made.table("grams").count()
    assert lists > 200 and moved() - before < 2 * (160 + lists)


def test_an_empty_table_makes_an_empty_index(spark):
    made = index.Index.build(spark.createDataFrame([], SCHEMA), FIELDS, parts=2, slots=2)
    assert made.search("red bolt").collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé中\U0001f600", max_size=12))
def test_trigrams_are_numbered_in_the_order_of_characters(text):
    got = index.grams_of(text).tolist()
    padded = text + "\0\0"
    assert got == sorted({(ord(a) << 42) | (ord(b) << 21) | ord(c) for a, b, c in zip(padded, padded[1:], padded[2:])})
    for word in {text[i : i + n] for i in range(len(text)) for n in (1, 2, 3)} | {"a", "中a"}:
        lo, hi = index._span(word)
        assert any(lo <= g <= hi for g in got) == (word in text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=5), max_size=8, unique=True), st.lists(st.text(alphabet="abéz", max_size=50), max_size=5), st.sampled_from([1, 2, 5, 512]))
def test_an_automaton_counts_as_str_does(words, texts, lane):
    prior, automaton.LANE = automaton.LANE, lane
    try:
        made = automaton.Automaton(words)
        got = {(t, words[w], n, first) for t, w, n, first in zip(*(x.tolist() for x in made.counts(texts)))}
        every = sorted((t, words[w], s) for t, w, s in zip(*(x.tolist() for x in made.matches(texts))))
    finally:
        automaton.LANE = prior
    assert got == {(k, w, t.count(w), t.find(w)) for k, t in enumerate(texts) for w in words if w in t}
    assert every == sorted((k, w, i) for k, t in enumerate(texts) for w in words for i in range(len(t)) if t.startswith(w, i))


def test_words_beyond_one_automaton_are_counted_by_several(spark):
    docs = spark.createDataFrame([(1, "abab aba"), (2, None), (3, ""), (None, "zab")], "id int, text string")
    words = spark.createDataFrame([("ab",), ("aba",), ("b a",), ("",), (None,), ("ab",)], "word string")
    want = sorted([(1, "ab", 3, 0), (1, "aba", 2, 0), (1, "b a", 1, 3), (None, "ab", 1, 1)], key=str)
    for most in (1, 2, 100):
        assert sorted(map(tuple, automaton.count_words(docs, words, most).collect()), key=str) == want
    assert automaton.count_words(docs, words.limit(0)).collect() == []


def test_numbers_and_totals_in_an_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(9)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    total, want = {}, {}
    for g, k, v in rows:
        total[g] = total.get(g, 0) + v
        want[k] = total[g]
    assert {r["k"]: r["t"] for r in order.running_total(df, ["g"], [F.col("k")], F.col("v"), "t").collect()} == want
    down = order.numbered(df, ["g"], [F.col("k").desc()], "n").filter("n = 1").collect()
    assert {(r["g"], r["k"]) for r in down} == {(g, max(k for h, k, _ in rows if h == g)) for g in {r[0] for r in rows}}


def test_free_numbers_pass_over_held_ones(spark):
    rows = spark.createDataFrame([("a", k) for k in range(6)] + [("b", 0)], "g string, k int")
    held = spark.createDataFrame([("a", 2), ("a", 3), ("a", 5), ("a", 1), ("a", 5), ("c", 2), ("a", 900)], "g string, number long")
    got = {(r["g"], r["k"]): r["n"] for r in order.free_numbers(rows, ["g"], [F.col("k")], held, 2, "n").collect()}
    assert got == {("a", 0): 4, ("a", 1): 6, ("a", 2): 7, ("a", 3): 8, ("a", 4): 9, ("a", 5): 10, ("b", 0): 2}


# ---- generations


def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


PAGES = "id string, path string, title string, body string"


def shown(store):
    return {r["id"]: (r["title"], r["body"], list(r["linked"]), list(r["linking"])) for r in store.read("rendered").filter("owner = 'catalog'").collect()}


def test_a_delta_build_equals_a_full_one_and_writes_what_it_touches(spark, tmp_path):
    rng = random.Random(8)

    def corpus(old=()):
        rows = {r[0]: r for r in old}
        for i in rng.sample(range(60), 60 if not old else 6):
            to = " ".join(f"[x](p{rng.randrange(60)}.md)" for _ in range(2))
            rows[f"n{i}"] = (f"n{i}", f"d/p{rng.choice([i, i, i, 59 - i])}.md", rng.choice([f"T{i}", f"T{i}", f"U{rng.random()}", None]), rng.choice([f"{to} body", f"{to} other", None]))
        for i in rng.sample(range(60), 2 if old else 0):
            rows.pop(f"n{i}", None)
        return sorted(rows.values())

    store, rows = Store(spark, folder(tmp_path), delta.KEYS), ()
    for step in range(4):
        rows = corpus(rows)
        frame = spark.createDataFrame(rows, PAGES)
        wrote = delta.build(store, frame)
        fresh = Store(spark, folder(tmp_path), delta.KEYS)
        delta.build(fresh, frame)
        assert shown(store) == shown(fresh)
        if step:
            assert wrote["pages"] <= 8 and wrote["links"] <= 8 and wrote["rendered"] < 45
    assert delta.build(store, frame) == {"pages": 0, "links": 0, "rendered": 0}
    delta.build(store, frame.limit(0))
    assert shown(store) == {}


def test_others_rows_stay_and_old_generations_go(spark, tmp_path):
    store = Store(spark, folder(tmp_path), delta.KEYS)
    first = spark.createDataFrame([("a", "a.md", "A", "[b](b.md)"), ("b", "b.md", "B", None)], PAGES)
    delta.build(store, first)
    foreign = store.read("rendered").limit(1).select(F.lit("c").alias("id"), F.lit("mine").alias("title"), "path", "body", "linked", "linking", "fingerprint", F.lit("me").alias("owner"), F.lit(False).alias("gone"))
    store.commit({"rendered": foreign})
    delta.build(store, spark.createDataFrame([("b", "b.md", "B2", None), ("c", "c.md", "C", "[b](b.md)")], PAGES))
    rows = {r["id"]: (r["title"], r["owner"]) for r in store.read("rendered").collect()}
    assert rows == {"b": ("B2", "catalog"), "c": ("mine", "me")}
    assert store.generations() == [1, 2, 3] and {r["id"] for r in store.read("pages", 1).collect()} == {"a", "b"}
    before = sorted(map(tuple, store.read("pages").collect()), key=str)
    assert store.compact() == 4 and store.parts() == {"pages": [4], "links": [4], "rendered": [4]}
    gone = store.clear(keep=1)
    assert "pages/g1" in gone and "manifest/g3" in gone and store.generations() == [4]
    assert sorted(map(tuple, store.read("pages").collect()), key=str) == before


def test_a_failed_generation_does_not_count(spark, tmp_path):
    store = Store(spark, folder(tmp_path), {"t": "k"})
    row = lambda k, v, gone=False: spark.createDataFrame([(k, v, gone)], "k string, v int, gone boolean")
    assert store.read("t") is None
    store.commit({"t": row("a", 1)})
    row("a", 99).write.parquet(f"{store.folder}/t/g2")  # written, but no manifest says so
    assert [tuple(r) for r in store.read("t").collect()] == [("a", 1)]
    store.commit({"t": row("b", 2).unionByName(row("a", 0, True))})
    assert [tuple(r) for r in store.read("t").collect()] == [("b", 2)]


# ---- the live loop


def replay(events, quiet, cap, wait):
    """Compiles and answers of one key, edit by edit."""
    edits, asked = sorted(t for t, e in events if e), sorted(t for t, e in events if not e)
    compiles = []
    for t in edits:
        if not compiles or t >= compiles[-1]["due"]:
            compiles.append({"first": t, "n": 0})
        c = compiles[-1]
        c["n"], c["last"], c["due"] = c["n"] + 1, t, min(t + quiet, c["first"] + cap)
    out, done = [], 0
    for c in compiles:
        done += c["n"]
        c["generation"] = done
        out.append(("compile", c["due"], c["first"], c["last"], c["n"], done, False))
    for t in asked:
        mine = [c for c in compiles if c["first"] <= t]
        if not mine or mine[-1]["due"] <= t:
            out.append(("answer", t, t, None, None, mine[-1]["generation"] if mine else 0, False))
        elif mine[-1]["due"] <= t + wait:
            out.append(("answer", mine[-1]["due"], t, None, None, mine[-1]["generation"], False))
        else:
            out.append(("answer", t + wait, t, None, None, mine[-1]["generation"] - mine[-1]["n"], True))
    return out


def test_the_live_loop_caps_compiles_and_marks_stale_answers(spark, tmp_path):
    rng = random.Random(11)
    events = {k: [(rng.randrange(1, 4000) * 10, rng.random() < 0.7) for _ in range(rng.randrange(1, 60))] for k in "abc"}
    rows = sorted((t, k, e) for k, own in events.items() for t, e in own)
    at = F.timestamp_millis(F.col("t")).alias("ts")
    into, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    for k in range(3):  # stopped twice in the middle, the rows of a step in any order
        own = [r for r in rows if k * 14_000 <= r[0] < (k + 1) * 14_000]
        rng.shuffle(own)
        spark.createDataFrame(own, "t long, key string, edit boolean").select("key", at, "edit").repartition(2).write.mode("append").parquet(into)
        if k == 2:
            spark.createDataFrame([(10**9, "end", True)], "t long, key string, edit boolean").select("key", at, "edit").write.mode("append").parquet(into)
        live.run_live(spark, into, out, state, 300, 1000, 400, late="20 seconds").awaitTermination()
    found = spark.read.schema(live.OUT).parquet(out).collect()
    assert {r["key"] for r in found} == set(events)
    for k, own in events.items():
        got = sorted((tuple(r)[1:] for r in found if r["key"] == k), key=str)
        assert got == sorted(replay(own, 300, 1000, 400), key=str)


def test_a_group_of_keys_is_visited_once(monkeypatch):
    calls = []

    class Handle:
        kept = None

        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, value):
            calls.append("update")
            self.kept = value

        def registerTimer(self, at):
            calls.append(at)

        def deleteTimer(self, at):
            calls.append(-at)

    class Times:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = lambda: now
            self.getExpiryTimeInMs = lambda: 301

    loop, handle = live.Debounce(300, 1000, 400), Handle()
    loop.init(handle)
    rows = [Row(key=f"k{i}", at=i, edit=True) for i in range(50)]
    assert list(loop.handleInputRows((3,), iter(rows), Times(0))) == [] and calls == ["get", "update", 301]
    calls.clear()
    got = list(loop.handleExpiredTimer((3,), Times(310), Times(310)))
    assert sorted((r.key, r.at) for r in got) == sorted((f"k{i}", 300 + i) for i in range(10)) and calls == ["get", "update", 311]


def test_a_delta_build_writes_bodies_once_beside_the_store(spark, tmp_path, monkeypatch):
    from docgraph.sources import shared

    cuts = tmp_path / "cuts"
    cuts.mkdir()
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{cuts}")
    store = Store(spark, f"file://{tmp_path}/store", delta.KEYS)
    made = spark.createDataFrame([(k, f"d/{k}.md", f"Doc {k}", f"[a]({k + 1}.md)") for k in range(50)], "id long, path string, title string, body string")
    assert delta.build(store, made) == {"pages": 50, "links": 50, "rendered": 50}
    assert delta.build(store, made.filter("id <> 7")) == {"pages": 1, "links": 1, "rendered": 3}  # 7 went, 6 and 8 were beside it
    with_body = [spark.read.parquet(str(c)) for c in cuts.iterdir() if "body" in spark.read.parquet(str(c)).columns]
    assert sum(c.count() for c in with_body) == 50 + 49
