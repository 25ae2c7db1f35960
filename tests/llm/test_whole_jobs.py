"""Operators and the pipeline against brute force on small tables, and clashing column names."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docgraph.llm import archives, bpe, jaccard, language, mixing, neighbours, pages, repeats, webp
from docgraph.llm.common import IdFilter, id_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named as those that operators use inside.
CLASHES = ("k1", "k2", "key", "tag", "id", "starts", "cls", "comp", "score", "lang_pred", "parts", "epoch", "shard", "copy", "__key", "__text", "__k", "mix_k", "gone", "left", "text_hash")
LETTERS = {"en": "abcdefgh", "de": "hijklmno", "fr": "opqrstuv"}


def corpus(seed=1, n=120):
    """Texts of three invented languages with exact and near copies, shared passages, blanks and texts of no language."""
    rng = np.random.default_rng(seed)
    vocabulary = {c: ["".join(rng.choice(list(x), rng.integers(2, 8))) for _ in range(120)] for c, x in LETTERS.items()}
    rows, passage = [], {c: " ".join(rng.choice(v, 40)) for c, v in vocabulary.items()}
    for i in range(n):
        c = list(LETTERS)[int(rng.integers(0, 3))]
        words = rng.choice(vocabulary[c], int(rng.integers(1, 90))).tolist()
        if i % 5 == 0:
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = passage[c].split()
        rows.append([i, " ".join(words), c, f"s{int(rng.integers(0, 4))}"])
    for i in range(n, n + 30):
        _, text, c, _ = rows[int(rng.integers(0, n))]
        words = text.split()
        for _ in range(i % 3):
            words[int(rng.integers(0, len(words)))] = str(rng.choice(vocabulary[c]))
        rows.append([i, " ".join(words), c if i % 4 else None, "s0"])
    rows += [[n + 30, None, "en", "s1"], [n + 31, "", "de", None], [n + 32, " \n", None, "s2"], [n + 33, "12 34 !!", "en", "s1"], [n + 34, rows[3][1], "en", None], [n + 34, rows[3][1], "en", None], [None, rows[4][1], "en", "s3"]]
    return [(*r, len(r[1] or "")) for r in rows]


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def shingles(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """Component of each row, brute force over all pairs."""
    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(rows))], sets


def kept_words(rows):
    """Of each row its words and which go, brute force over all windows."""
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 12 if d is not None else 0):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 12 if d is not None else 0):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        out.append((w, gone))
    return out


def scorer(rows):
    """The language model by plain counting."""
    counts = [{} for _ in range(5)]
    langs = sorted({r[2] for r in rows})
    for _, t, c, *_ in rows:
        for w in language.RUN.findall((t or "").lower()):
            counts[0].setdefault(w, dict.fromkeys(langs, 0))[c] += 1
    for w, own in counts[0].items():
        for c in langs:
            for n in range(1, 5) if own[c] else ():
                for g in language._grams(w, n):
                    counts[n].setdefault(g, dict.fromkeys(langs, 0))[c] += 1
    tables = []
    for own in counts:
        below = {c: sum(f[c] for f in own.values()) + 0.5 * (sum(f[c] > 0 for f in own.values()) + 1) for c in langs}
        tables.append(({w: i for i, w in enumerate(own)}, np.array([[np.log((f[c] + 0.5) / below[c]) for c in langs] for f in own.values()]).reshape(-1, len(langs))))
    return language.Scorer({"langs": langs, "tables": tables})


def is_held_out(doc_id):
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def clashing(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_id_filter_loses_none(spark):
    ids = spark.range(0, 200_000).select(F.xxhash64("id").alias("h"))
    held = id_filter(ids, F.col("h"))
    h = np.array([r.h for r in ids.limit(5000).collect()])
    assert held.has(h).all() and held.blocks > 1
    assert held.has(np.random.default_rng(0).integers(-(2**63), 2**63, 20_000)).mean() < 0.03
    assert not IdFilter(1).has(h).any()


def test_jaccard_equals_all_pairs(docs, rows):
    comp, sets = components(rows)
    least = {}
    for r, c in zip(rows, comp):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted(((r[0], len(s), least.get(c) if s else r[0]) for r, c, s in zip(rows, comp, sets) if r[0] is not None), key=str)
    got = jaccard.near_components(docs.filter("doc_id is not null")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    by = {r.doc_id: r.component_id for r in jaccard.near_components(docs).collect() if r.doc_id is not None}
    assert by == {w[0]: w[2] for w in want}


def test_language_equals_plain_counting_and_finds_held_out_texts(docs, rows):
    own = scorer([r for r in rows if r[2] is not None and r[0] is not None and not is_held_out(r[0])])
    got = language.identify(docs).collect()
    want = Counter((r[0], is_held_out(r[0]), own.text(r[1])[0]) for r in rows)
    assert Counter((r.doc_id, r.held_out, r.lang_pred) for r in got) == want
    score = {r[0]: own.text(r[1])[1] for r in rows}
    assert all(abs(r.score - score[r.doc_id]) < 1e-9 for r in got)
    lang = {r[0]: r[2] for r in rows if r[2]}
    tried = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert len(tried) > 20 and np.mean(tried) > 0.95


def test_held_out_rows_are_not_learned_from(docs):
    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert plain(language.identify(docs)) == plain(language.identify(other))


def test_very_long_texts_are_read_in_pieces(spark, monkeypatch):
    rows = [(0, "abc abd " * 30, "a"), (1, "xyz xyw " * 30, "b"), (4, "abc xyz abq" * 50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = plain(language.identify(df))
    monkeypatch.setattr(language, "CHUNK", 64)
    assert [x[:3] for x in plain(language.identify(df))] == [x[:3] for x in want]
    pieces = [p for _, own, _ in language._chunks(["abc xyz abq" * 50]) for p in own]
    assert "".join(pieces) == "abc xyz abq" * 50 and len(pieces) > 1


def test_marks_stay_in_their_word():
    w = language.Words(["नमस्ते दुनिया été", "12 ½", ""])
    assert [w.word(i) for i in range(len(w.starts))] == ["नमस्ते", "दुनिया", "été"] and w.letter.tolist() == [True, False, False]


def test_repeats_with_null_and_large_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    table = [(None, text), (2**60 + 1, text), (2**60 + 3, text), (None, None), (5, ""), (6, "  ")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.count_repeats(df).collect() if r.doc_id is not None}
    assert got == {2**60 + 1: 0, 2**60 + 3: 20, 5: 0, 6: 0}
    left = sorted((r.doc_id or 0, r.text or "") for r in repeats.drop_repeats(df).collect())
    assert left == [(0, ""), (0, text), (5, ""), (6, "  "), (2**60 + 1, text)]


def test_repeats_equal_all_windows(docs, rows):
    want = sorted(((r[0], len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g) if not y).encode()).hexdigest()) for r, (w, g) in zip(rows, kept_words(rows))), key=str)
    assert plain(repeats.count_repeats(docs)) == want


def brute_mix(spark, rows, block=mixing.BLOCK_WORDS, seed=mixing.SEED):
    """Per row index and (pass, shard): the words taken, by walking all slots one after another."""
    hashes = [tuple(r) for r in spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(rows)], "k long, doc_id long, text string").select("k", F.xxhash64("text").alias("h"), F.xxhash64("doc_id", F.xxhash64("text")).alias("b")).orderBy("k").collect()]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    buckets = 1 + len(rows) // mixing.ROWS_A_BUCKET
    streams = []
    for s in sources:
        own = [(hashes[k][2] % buckets, -(2**63) if r[0] is None else r[0], len(words(r[1])), -(2**63) if r[1] is None else hashes[k][1], k) for k, r in enumerate(rows) if r[3] == s]
        streams.append([(k, i) for *_, k in sorted(own) for i in range(len(words(rows[k][1])))])
    sizes = [len(x) for x in streams]
    goals = mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))])
    lines = [dict(source=s, size=n) for s, n in zip(sources, sizes)]
    plan = mixing._plan(lines, block, mixing.WEIGHTS, mixing.REPEATS, seed)
    out, at = {}, [0] * len(sources)
    left = [min(round(g), 3 * n) for g, n in zip(goals, sizes)]
    for shard, got in mixing.draws(np.array([p[-1] for p in plan]), mixing.SHARD_SLOTS, seed):
        for six, n in enumerate(got.tolist()):
            for slot in range(at[six], at[six] + n):
                blocks = -(-sizes[six] // block)
                epoch, i = divmod(slot, blocks)
                b = int(mixing.permute(blocks, mixing._key(seed, six, epoch), np.array([i]))[0])
                for k, w in streams[six][b * block : (b + 1) * block]:
                    if left[six]:
                        left[six] -= 1
                        out.setdefault((k, epoch, shard), []).append(w)
            at[six] += n
    assert not any(left)
    return out, dict(zip(sources, goals))


@pytest.mark.parametrize("slots", [mixing.SHARD_SLOTS, 3])
def test_mixing_equals_a_walk_over_all_slots(spark, docs, rows, monkeypatch, slots):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", slots)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    taken, goals = brute_mix(spark, rows, 16)
    counts, shards = Counter(), {}
    for (k, _, shard), w in taken.items():
        counts[k] += len(w)
        shards[k] = min(shards.get(k, shard), shard)
    got = Counter((r.doc_id, r.size, r.taken, r.first_shard) for r in mixing.mix_counts(docs, block=16).collect())
    assert got == Counter((r[0], len(words(r[1])), counts[k], shards.get(k)) for k, r in enumerate(rows))
    pieces = Counter((rows[k][0], rows[k][3], shard, " ".join(words(rows[k][1])[i] for i in sorted(w))) for (k, _, shard), w in taken.items())
    mixed = mixing.mix_documents(docs, block=16, by_shard=True).collect()
    assert Counter((r.doc_id, r.source, r.shard, " ".join(words(r.text))) for r in mixed) == pieces


def test_draws_decide_the_shards(docs):
    quota = np.array([50, 20, 10])
    made = [got for _, got in mixing.draws(quota, 8, 1)]
    assert (sum(made) == quota).all() and all(g.sum() == 8 for g in made) and len({tuple(g) for g in made}) > 2
    assert [g.tolist() for g in made] != [g.tolist() for _, g in mixing.draws(quota, 8, 2)]


def test_rows_equal_but_for_their_source_keep_apart(spark):
    text = " ".join(f"w{i}" for i in range(10))
    df = spark.createDataFrame([(1, text, "a"), (1, text, None), (2, "x " * 30, "b")], "doc_id long, text string, source string")
    taken = sorted((r.doc_id, r.taken) for r in mixing.mix_counts(df).collect())
    got = Counter()
    for r in mixing.mix_documents(df).collect():
        got[r.source] += len(words(r.text))
    assert got == {"a": 30, None: 7, "b": 13} and taken == [(1, 7), (1, 30), (2, 13)]


def test_extra_columns_may_be_called_anything(docs):
    odd, columns = clashing(docs), None
    columns = odd.columns
    for got, want in (
        (language.keep_identified(odd), language.keep_identified(docs)), (jaccard.keep_one(odd), jaccard.keep_one(docs)), (repeats.drop_repeats(odd), repeats.drop_repeats(docs)), (mixing.mix_documents(odd), mixing.mix_documents(docs)),
    ):
        assert got.columns == columns
        assert plain(got.select(docs.columns)) == plain(want)
        assert got.filter(" or ".join(f"`{c}` <> 'own {c}'" for c in CLASHES)).count() == 0
    by = mixing.mix_documents(odd, by_shard=True)
    assert by.columns == [c for c in columns if c != "shard"] + ["shard"]
    assert plain(language.identify(odd)) == plain(language.identify(docs))


@pytest.mark.parametrize("page, text", [
    ("<article><p>İİİİ</p><script>x</script><p>Hello world", "İİİİ Hello world"),
    ('<article><p title="the hidden truth">keep me</p><p hidden>not me</p></article>', "keep me"),
    ("<main><p>A body much longer than its teaser</p><article>teaser</article></main>", "A body much longer than its teaser teaser"),
    ("<main><p>short</p><article>the article itself, longer</article></main>", "the article itself, longer"),
    ('<article><div class="post-header"><h1>Title</h1></div><p>x</p></article><div class="site-header">no</div>', "Title x"),
    ("<article><label>Term</label><p>x</p></article>", "Term x"),
])
def test_articles_are_whole(page, text):
    assert pages.main_text(page)[0] == text


def test_pages_equal_an_article_built_from_known_parts(spark):
    rng = np.random.default_rng(2)
    noise = ["<nav>menu</nav>", "<aside>side</aside>", '<div class="ad">buy</div>', "<form><input>go</form>", "<script>var x='<p>no</p>'</script>", "<!-- <p>no</p> -->", '<section id="comments"><p>nice</p></section>', "<style>p{}</style>", '<div role="alert">beware</div>']
    table, want = [], {}
    for k in range(60):
        parts = [f"w{k}x{i} &amp; <b>b</b>old{i}" for i in range(int(rng.integers(0, 8)))]
        inside = "".join(str(rng.choice(noise)) * int(rng.integers(0, 2)) + f"<{t}>\n {p} \t</{t}>" for p, t in zip(parts, rng.choice(["p", "h2", "li", "blockquote", "div"], 8)))
        around = [str(rng.choice(noise)) for _ in range(4)]
        table.append((k, f"http://h{k % 3}/{k}", f"<html><body><header>top</header>{around[0]}{around[1]}<article>{inside}</article>{around[2]}{around[3]}<footer>end</footer></body></html>"))
        want[k] = " ".join(re.sub("<[^>]*>", "", p).replace("&amp;", "&") for p in parts)
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
    assert {k: t for k, (t, _) in got.items() if want[k]} == {k: t for k, t in want.items() if t}
    assert all(n == len(t) for t, n in got.values())


def test_arc_records_that_cannot_be_read_are_left_out(spark):
    good = b"http://a/ 1.2.3.4 20010203040506 text/html 3\nabc\n"
    bad = b"http://b/ 1.2.3.4 20010203040506 text/html -\nxyz\n"
    short = b"http://c/ 1.2.3.4 20010203040506 text/html 99\nxyz\n"
    df = spark.createDataFrame([("one", bytearray(good + bad + good)), ("two", bytearray(good + short)), ("three", bytearray(b"\x1f\x8bnot gzip"))], "archive string, content binary")
    got = archives.read_pages(archives.convert(df)).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"] and len({r.record_id for r in got}) == 3
    assert {(r.archive, r.reason) for r in archives.rejects(df).collect()} == {("one", "no header line"), ("two", "shorter than declared"), ("two", "no header line"), ("three", "damaged gzip member")}


def test_webp_of_another_encoder():
    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    width, height, px = webp.decode(data)
    assert (width, height, len(px)) == (1, 1, 1) and int(px[0]) >> 24 == 0


def test_webp_payloads_of_several_files(monkeypatch):
    monkeypatch.setattr(webp, "MOST", 128)
    payload = bytes(range(256)) + b"ab" * 32
    media = webp.encode_payload(payload)
    assert media.count(b"WEBPVP8L") == 3 and webp.decode_payload(media, len(payload))[2].tobytes() == payload


def test_neighbours_reach_recall_on_random_directions(spark):
    x = np.random.default_rng(8).standard_normal((3000, 24)).astype(np.float32)
    got = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert neighbours.depth_of(3000) > 1
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    d, hit = x.astype(np.float64), []
    for q in range(0, 3000, 20):
        s = neighbours.exact(np.broadcast_to(d[q], d.shape), d)
        best = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        assert len(found[q]) == 20 and all(s[i] == v for i, v in found[q].items())
        hit.append(len(set(best) & set(found[q])) / 20)
    assert np.mean(hit) >= 0.9


def test_queries_short_of_neighbours_are_searched_everywhere(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_SAMPLE", 64)
    x = np.repeat(np.eye(4) * 5, 16, axis=0) + np.random.default_rng(1).standard_normal((64, 4)) * 0.01
    got = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), rows_a_part=8, recall=0.1).collect()
    assert Counter(r.query_id for r in got) == {q: 20 for q in range(0, 64, 20)}


def test_bpe_of_rows_that_come_in_any_order(docs, rows):
    import public_tokenizers as p

    path = p.path(bpe.VOCABULARY)
    enc, _ = bpe.encoder(path, p.PATTERN)
    got = bpe.encode_digests(docs.repartition(4, F.rand()), path, p.PATTERN).collect()
    want = []
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)


def test_pipeline_stage_by_stage(spark, docs, rows, tmp_path):
    """Each stage on its predecessor's brute-force result, and run() over them all."""
    import public_tokenizers as p

    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeats", "mix", "tokens"]
    now, stage = [tuple(r) for r in rows], dict(corpus_pipeline.STAGES)

    def apply(name, given):
        path = f"file://{tmp_path}/{name}"
        spark.createDataFrame(given, SCHEMA).repartition(3).write.parquet(path)
        return stage[name](spark, spark.read.parquet(path), str(tmp_path))

    own = scorer([r for r in now if r[2] is not None and r[0] is not None and not is_held_out(r[0])])
    want = [r for r in now if (x := own.text(r[1]))[0] != "und" and x[1] >= 0.5]
    got = apply("language", now)
    assert got.columns == docs.columns and plain(got) == sorted(want, key=str) and len(want) > 100

    now, (comp, sets) = want, components(want)
    least = {}
    for r, c in zip(now, comp):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    seen, want = set(), []
    for r, c, s in zip(now, comp, sets):
        key = (r[0], c if s else r[1])
        if r[0] is None or r[0] == (least[c] if s else r[0]) and key not in seen:
            seen.add(key)
            want.append(r)
    got = apply("near_duplicates", now)
    assert got.columns == docs.columns and plain(got) == sorted(want, key=str) and len(want) < len(now)

    now, want = want, []
    for r, (w, gone) in zip(now, kept_words(now)):
        if not w or not all(gone):
            text = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else r[1]
            want.append((r[0], text, r[2], r[3], len(text)))
    got = apply("repeats", now)
    assert got.columns == docs.columns and plain(got) == sorted(want, key=str) and sum(r[4] for r in want) < sum(r[4] for r in now)

    now, taken = want, brute_mix(spark, want)[0]
    by = {}
    for (k, epoch, _), w in taken.items():
        by.setdefault((k, epoch), []).extend(w)
    want = []
    for (k, _), w in by.items():
        r = now[k]
        text = r[1] if len(w) == len(words(r[1])) else " ".join(words(r[1])[i] for i in sorted(w))
        want.append((r[0], text, r[2], r[3], len(text)))
    got = apply("mix", now)
    assert got.columns == docs.columns and plain(got) == sorted(want, key=str)

    now, (enc, _) = want, bpe.encoder(p.path(bpe.VOCABULARY), p.PATTERN)
    want = Counter((r[0], tuple(enc.encode_ordinary(r[1]))) for r in now)
    assert Counter((r.doc_id, tuple(r.ids)) for r in apply("tokens", now).collect()) == want
    whole = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole) == want and all(r.n_tokens == len(r.ids) for r in whole)


def test_equal_rows_are_mixed_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s", 7)] * 3000 + [(2, "e f", None, 3), (1, "a b c d", "t", 7)], "doc_id long, text string, source string, n_chars long")
    got = mixing.mix_documents(docs).groupBy("doc_id", "source", "text").count().collect()
    plan = {(r["doc_id"], r["size"]): r["n"] for r in mixing.mix_counts(docs).groupBy("doc_id", "size").agg(F.sum("taken").alias("n")).collect()}
    words = Counter()
    for r in got:
        words[r["doc_id"]] += r["count"] * len(r["text"].split())
    assert words == {1: plan[1, 4], 2: plan[2, 2]} and plan[1, 4] > 4000
