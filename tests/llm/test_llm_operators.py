"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import gzip
import hashlib
import os
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.llm import archives, bpe, jaccard, language, mixing, neighbours, pages, quotes, repeats, webp
from docgraph.llm.components import components

LINE = " ".join(f"word{i}" for i in range(30))
LONG = " ".join(f"w{i * i % 9973}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, cls string, h double"
TEXTS = [
    (0, LINE, "en", "a"),
    (1, LINE.upper(), "en", "a"),
    (2, LINE + " more", "en", None),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, " \n\t ", "de", "b"),
    (6, "One two", "de", "b"),
    (7, "one  TWO", "de", "b"),
    (8, LONG, "en", "a"),
    (9, LONG + " end", "en", "a"),
    (10, "été ñandú 中文", "fr", "c"),
    (10, "été ñandú 中文", "fr", "c"),
    (11, LINE, "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 0.5) for r in TEXTS], SCHEMA).repartition(3, "doc_id").cache()


def words(text):
    return (text or "").encode().split()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_webp_reads_back_every_payload(docs):
    got = webp.read_back(webp.to_images(docs)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        raw = next((t or "").encode() for d, t, *_ in TEXTS if d == r.doc_id)
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    by = {r.doc_id: (r.media_sha256, r.feature) for r in got}
    assert by[0] == by[11] and by[3] == by[4] and by[0] != by[1]
    assert webp.read_back(webp.to_images(docs.limit(0))).count() == 0


@pytest.mark.parametrize("colours", [1, 2, 4, 13, 200, 0])
def test_webp_round_trips_all_transforms(colours):
    rng = np.random.default_rng(colours)
    for w, h in ((1, 1), (17, 9), (5, 12)):
        px = rng.integers(0, 2**32, w * h, dtype=np.uint32) if not colours else rng.integers(0, 2**32, colours, dtype=np.uint32)[rng.integers(0, colours, w * h)]
        for transforms in ((), (2,), (0,), (1,), (0, 1, 2), (3,), (3, 0)):
            if 3 in transforms and len(np.unique(px)) > 256:
                continue
            for cache, groups in ((0, 1), (6, 3)):
                width, height, back = webp.decode(webp.encode(px, w, transforms, cache, groups))
                assert (width, height) == (w, h) and (back == px).all()


def test_webp_rejects_damaged_files():
    data = webp.encode_bytes(bytes(range(256)) * 8)
    for bad in (b"RIFFxxxxWEBP", data[:40], data[:20] + b"\x00" + data[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_pixel_arrays_keep_nulls(spark):
    df = spark.createDataFrame([(1, bytearray(webp.encode_bytes(b"a" * 64))), (2, None)], "k int, media binary")
    got = {r.k: r for r in webp.pixel_arrays(df).collect()}
    assert got[2].pixels is None and (got[1].width, got[1].height) == (64, 1) and got[1].pixels[:4] == b"aaa\xff"


def test_archives_round_trip_and_mark_revisits(spark):
    page = [(1, "http://a b", "x"), (2, None, None), (3, "u", ""), (4, "u", "x"), (5, "u", "HTTP/1.1 200 OK\r\n\r\nfoo"), (6, "u", "\r\n\r\n"), (7, "u", "é" * 1000), (7, "u", "é" * 1000)]
    df = spark.createDataFrame([(*p, "extra") for p in page], "page_id long, url string, html string, digest string")
    got = archives.read_pages(archives.convert(archives.pages_to_arc(df))).collect()
    assert len(got) == len(page)
    best = {}
    for k, _, h in page:
        best[h or ""] = max(best.get(h or "", k), k)
    for r in got:
        payload = next(h or "" for k, _, h in page if k == r.page_id)
        assert r.payload_bytes == len(payload.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        if r.page_id != 7:
            assert (r.record_type, r.refers_to) == (("response", None) if best[payload] == r.page_id else ("revisit", best[payload]))
    assert sorted(r.record_type for r in got if r.page_id == 7) == ["response", "revisit"]
    assert archives.read_pages(archives.convert(archives.pages_to_arc(df.limit(0)))).count() == 0


def test_arc_versions_and_lengths():
    record = archives.ArcRecord("http://x/", "1.2.3.4", "20010203040506", "text/html", b"GET\n\nbody\n")
    for version in (1, 2):
        got = list(archives.read_arc(archives.write_arc("f", version, [record, record])))
        assert [(g.url, g.date, g.content_type, g.body) for g in got] == [(record.url, record.date, record.content_type, record.body)] * 2
    plain = b"filedesc://f 0.0.0.0 20010101000000 text/plain 15\n1 0 x\nURL more\n\nhttp://x/ 1.2.3.4 20010203040506 text/html; charset=utf-8 3\nabc\n"
    assert [(g.content_type, g.body) for g in archives.read_arc(plain)] == [("text/html; charset=utf-8", b"abc")]
    with pytest.raises(ValueError):
        list(archives.read_arc(b"http://x/ 1.2.3.4 20010203040506 text/html 30\nabc\n"))
    assert archives.iso("20010203040506") == "2001-02-03T04:05:06Z"


def test_gzip_members_are_read_without_copies_of_the_rest():
    rng, sizes = np.random.default_rng(9), [0, 1, 100, archives.PIECE, 3 * archives.PIECE, *range(archives.PIECE - 40, archives.PIECE + 10)]
    payloads = [rng.bytes(n) for n in [*sizes, *[2000] * 600]]
    members = [gzip.compress(p, 1, mtime=0) for p in payloads]
    # a member of one piece to the byte; without a file name it has 18 bytes around its blocks
    assert any(len(m) == archives.PIECE for m in members)
    whole, at = b"".join(sorted(members, key=lambda m: len(m) != archives.PIECE)), 0
    tracemalloc.start()
    try:
        for offset, data in archives._members(whole):
            assert offset == at and gzip.compress(data, 1, mtime=0) == whole[at : at + len(gzip.compress(data, 1, mtime=0))]
            at += len(gzip.compress(data, 1, mtime=0))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert at == len(whole) and peak < len(whole) // 2
    assert [d for _, d in archives._members(members[-1][:-4])] == [payloads[-1]]  # cut short


def test_jaccard_components(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_components(docs).collect()}
    assert {(0, 26, 0), (1, 26, 0), (2, 27, 0), (11, 26, 0), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (10, 1, 10)} <= got
    assert {r[2] for r in got if r[0] in (8, 9)} == {8}
    assert jaccard.near_components(docs.limit(0)).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6, 8, 10]


def test_components_of_chains_and_loops(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 100), (201, 200), (200, 201), (201, 202)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((200, 201, 202), 200)}


def test_keep_one_tells_texts_of_one_id_apart(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(1, a), (2, b), (2, a + " more"), (2, b), (3, c), (3, b + " end"), (3, c + " too"), (4, ""), (4, c), (4, ""), (5, a), (None, a), (None, a), (6, None), (6, b), (7, d), (7, e), (7, d)]
    got = sorted((r.doc_id or 0, r.text or "") for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    texts = [t for k, t in got if k == 3]
    assert len(texts) == 1 and texts[0] in (c, c + " too")
    assert [r for r in got if r[0] != 3] == [(0, a), (0, a), (1, a), (2, b), (4, ""), (6, ""), (7, d), (7, e)]


def test_language(docs, spark):
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5))
    for r in got.values():
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert got[8].lang_pred == "en"
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0
    assert language.keep_identified(docs).columns == docs.columns


def test_language_falls_back_to_shorter_grams():
    model = {"langs": ["a", "b"], "tables": [({"known": 0}, np.array([[0.0, -1.0]])), ({"z": 0}, np.array([[-1.0, 0.0]])), ({"xy": 0}, np.array([[0.0, -2.0]]))]}
    scorer = language.Scorer(model)
    assert scorer.text("Known!")[0] == "a" and scorer.text("qxyz")[0] == "a" and scorer.text("qz")[0] == "b" and scorer.text("123 ½")[0] == "und"


def test_language_scores_rare_words_and_grams(spark):
    rng = np.random.default_rng(3)
    vocabulary = {c: ["".join(rng.choice(list(letters), rng.integers(1, 9))) for _ in range(80)] for c, letters in (("a", "abcdefg"), ("b", "abcdxyz"), ("c", "cdegxz"))}
    rows = [(c, " ".join(rng.choice(v, 12))) for c, v in vocabulary.items() for _ in range(20 if c == "a" else 4)]
    texts = [t for _, t in rows[::5]] + [" ".join("".join(rng.choice(list("abcdefgxyzq"), rng.integers(1, 8))) for _ in range(4)) for _ in range(40)] + ["qqq", "12", None]
    counts = [{} for _ in range(5)]
    for c, t in rows:
        for w in t.split():
            counts[0].setdefault(w, dict.fromkeys("abc", 0))[c] += 1
    for w, own in counts[0].items():
        for c in "abc":
            for n in range(1, 5) if own[c] else ():
                for g in language._grams(w, n):
                    counts[n].setdefault(g, dict.fromkeys("abc", 0))[c] += 1
    tables = []
    for own in counts:
        below = {c: sum(f[c] for f in own.values()) + 0.5 * (sum(f[c] > 0 for f in own.values()) + 1) for c in "abc"}
        tables.append(({w: i for i, w in enumerate(own)}, np.array([[np.log((f[c] + 0.5) / below[c]) for c in "abc"] for f in own.values()])))
    scorer = language.Scorer({"langs": list("abc"), "tables": tables})
    df = spark.createDataFrame(list(enumerate(texts)), "k long, __text string")
    train = spark.createDataFrame(rows, "lang string, text string")
    for kept in (1, 10, 100_000):
        got = {r.k: (r.lang_pred, r.score) for r in language.predict(df, language.train(train, kept, kept)).collect()}
        for k, t in enumerate(texts):
            want = scorer.text(t)
            assert got[k][0] == want[0] and abs(got[k][1] - want[1]) < 1e-9


def test_bpe(docs):
    import public_tokenizers as p

    path = p.path(bpe.VOCABULARY)
    enc, _ = bpe.encoder(path, p.PATTERN)
    texts = dict((d, t or "") for d, t, *_ in TEXTS)
    got = bpe.encode(docs, path, p.PATTERN).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded).decode() == texts[r.doc_id]
    assert bpe.encode_digests(docs.limit(0), path, p.PATTERN).count() == 0


def test_substring_dedup(docs):
    first = {}
    for d, t, *_ in sorted(TEXTS, key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    want = []
    for d, t, *_ in TEXTS:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        want.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    assert rows(repeats.count_repeats(docs)) == sorted(want, key=str)
    assert repeats.count_repeats(docs.limit(0)).count() == 0
    left = {r.doc_id: r.text for r in repeats.drop_repeats(docs).collect()}
    assert left[0] == LINE and left[2] == "more" and 11 not in left and left[9] == "end" and left[6] == "One two"


def test_two_texts_of_one_doc_id_keep_their_own_places(spark):
    df = spark.createDataFrame([(1, LINE), (2, "x y " + LINE), (2, LINE + " z")], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in repeats.count_repeats(df).collect() if r.doc_id == 2)
    assert got == [(31, 30), (32, 30)]


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[7] = x[20]
    table = [(i, v.tolist(), 1.0) for i, v in enumerate(x)] + [(1000, None, 0.0), (1020, [0.0] * 8, 0.0), (1040, [float("nan")] + [1.0] * 7, 0.0), (1060, [None] + [1.0] * 7, 0.0), (0, x[0].tolist(), 1.0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, score double")
    got = neighbours.search(df).collect()
    d = x.astype(np.float64)
    for q in range(0, 300, 20):
        s = neighbours.exact(np.broadcast_to(d[q], d.shape), d)
        want = [(i, s[i]) for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert {r.query_id for r in got} == set(range(0, 300, 20))
    assert neighbours.search(df.limit(0)).count() == 0
    few = neighbours.search(df.filter("vec_id in (0, 1, 2)")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few)[0][0] == 0 and len(few) == 2


def test_neighbours_through_several_parts(spark):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((30, 8)) * 3)[rng.integers(0, 30, 1200)] + rng.standard_normal((1200, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    got = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), rows_a_part=300).collect()
    near = neighbours.knn(x.astype(float), x[::20].astype(float), 21, own=False)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & (set(n.tolist()) - {q})) / 20 for q, n in zip(range(0, 1200, 20), near)]) >= 0.9


def test_mixing_takes_each_target(docs):
    got = mixing.mix_counts(docs).collect()
    assert len(got) == len(TEXTS)
    source = {d: s for d, _, _, s in TEXTS}
    sums = {}
    for r in got:
        assert r.taken <= 3 * r.size and r.size == len(words(next(t for d, t, *_ in TEXTS if d == r.doc_id)))
        key = source[r.doc_id]
        t, n = sums.get(key, (r.target, 0))
        sums[key] = (t, n + r.taken)
    for target, taken in sums.values():
        assert abs(target - taken) <= 1
    assert rows(mixing.mix_counts(docs.repartition(1))) == rows(mixing.mix_counts(docs))
    assert mixing.mix_counts(docs.limit(0)).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(n for _, n in sums.values())


HTML = """<html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Top</header><nav><ul><li>a<li>b</ul></nav>
<div class="cookie-notice">Cookies</div><article><h1>Head&amp;line</h1><p>One <b>bo</b>ld&nbsp;two<p>Three<br>four<aside>Side</aside><form>F</form>
<section class="comments"><p>Nice!</p></section><footer>by</footer></article><footer>&copy;</footer></body></html>"""


def test_pages(spark):
    menu = "home news sport weather contact about help terms privacy"
    other = [f"<div>{menu}</div><p>{i} only page says {' '.join(f'u{i}x{k}' for k in range(12))}</p>" for i in range(3)]
    table = [(1, "http://h/1", HTML), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", "<p>plain"), (5, "http://h/5", "a <!-- open"), *((10 + i, f"http://k/{i}", h) for i, h in enumerate(other)), (1, "http://h/1", HTML)]
    got = pages.extract(spark.createDataFrame([(*t, "x") for t in table], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(table) and all(r.n_chars == len(r.text) for r in got)
    assert by[1] == "Head&line One bold two Three four" and by[2] == "" and by[3] == "" and by[4] == "plain" and by[5] == "a"
    assert by[10] == "0 only page says " + " ".join(f"u0x{k}" for k in range(12))
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_a_host_are_compared_across_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    notes = [" ".join(f"note{k}x{j}" for j in range(9)) for k in range(30)]
    texts = []
    for i in range(120):
        own = [f"u{i}x{j}" for j in range(rng.integers(3, 30))]
        at = int(rng.integers(0, len(own)))
        texts.append(" ".join([*own[:at], notes[i % 30] if i < 60 else f"only{i}", *own[at:], "short shared end"]))
    texts += texts[:20]  # equal pages count once
    table = [(i, f"http://h/{i}", f"<p>{t}</p>") for i, t in enumerate(texts)] + [(1000, "http://k/0", f"<p>{notes[0]}</p>")]
    want = [" ".join(k) for k in pages.unique_runs([t.split(" ") for t in texts])]
    assert any("note" in t for t in texts) and not any("note" in w for w in want)
    for shard in (512, 8):
        monkeypatch.setattr(pages, "SHARD", shard)
        got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
        assert [got[i] for i in range(len(texts))] == want and got[1000] == notes[0]


def test_elements_in_doubt_are_decided_by_the_pages_of_the_host(spark, monkeypatch):
    box = "read these other fine stories that we have picked out for you today"
    page = lambda i: f"<nav>one two {i}</nav><article><p>a{i}</p><div class='related-work'><p>own w{i} {' '.join(f'u{i}x{k}' for k in range(9))}</p></div><section id='notice-period'>{box}</section><div class='ad-box'>buy{i}</div><p>z{i}</p></article>"
    own = lambda i: f"a{i} own w{i} {' '.join(f'u{i}x{k}' for k in range(9))}"
    table = [(i, f"http://h/{i}", page(i)) for i in range(20)] + [(50, "http://k/1", page(50)), (51, "http://k/1", page(50)), (52, "http://k/2", f"<nav>{box}</nav><p>alone")]
    table += [(60, "http://m/1", page(60)), (61, "http://m/1", page(60)), (62, "http://n/1", page(62)), (63, "http://n/2", f"<aside>{box}</aside><article>x</article>")]
    for shard in (512, 4):
        monkeypatch.setattr(pages, "SHARD", shard)
        got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
        assert [got[i] for i in range(20)] == [f"{own(i)} z{i}" for i in range(20)]  # the box stands on all of them
        assert got[60] == got[61] == f"{own(60)} {box} z60"  # copies of one page are one
        assert got[62] == f"{own(62)} z62" and got[63] == "x" and got[52] == "alone"  # furniture of a marked page tells, too


def test_pages_survive_odd_markup():
    for odd in ("<", "<p", "<<p>>", "</p></p>x", '<a href="x>y', "<article><article>a</article>b", "<p>" * 3000 + "x", "<script>never closed", "&#xZZ; &#99999999;", "<div class='ad'><p>q</div>r"):
        pages.main_text(odd)
    assert pages.main_text("<main><p>a</p></main><p>b</p>")[0] == "a"
    assert pages.main_text("<article>x<div class=ads>y</div>z</article>")[0] == "x z"


@pytest.mark.parametrize("page, text", [
    ("a <svg width=1/> b <svg><path/></svg> c", "a b c"), ("a <MATH /> b", "a b"), ("a <select><option>x</select> b <select> c", "a b c"), ("a <video src=x> b", "a b"),
    ("a <svg> b", "a b"), ("a <script>x</SCRIPT > b <script> c", "a b"), ("İİİİ <script>x</script>y z", "İİİİ y z"), ("a <style>x</ſtyle></STYLE>b", "a b"),
])
def test_pages_keep_text_around_raw_elements(page, text):
    assert " ".join(t for _, t in pages.blocks(page)) == text


TALK = [
    (1, 0, "u", "Hello there friend.\nSecond line of it."),
    (1, 1, "a", "On Monday, Ann wrote:\n> Hello there friend.\n> Second line of it.\n\nHi Ann"),
    (1, 2, "u", "> > hello   THERE friend.\n> Hi Ann\nthanks\n"),
    (1, 3, "u", None),
    (1, 4, "u", "> Hi Ann\nok"),
    (1, 4, "b", "x"),
    (1, 4, "b", "x"),
    (2, 0, "u", "> nothing known"),
    (2, 1, "u", "nothing known"),
    (None, None, None, None),
]


def test_quotes(spark):
    df = spark.createDataFrame([(*t, "x") for t in TALK], "conv_id long, turn long, role string, text string, body string")
    got = {(r.conv_id, r.turn, r.role): (r.body, r.max_level, r.n_linked, r.reply_to, r.thread, r.position) for r in quotes.link_quotes(df).collect()}
    assert got[1, 0, "u"] == ("Hello there friend.\nSecond line of it.", 0, 0, None, 0, 1)
    assert got[1, 1, "a"] == ("Hi Ann", 1, 1, 0, 0, 2)
    assert got[1, 2, "u"] == ("thanks", 2, 2, 1, 0, 3)
    assert got[1, 4, "u"] == ("ok", 1, 1, 1, 0, 4)
    assert got[1, 3, "u"][0] == "" and got[1, 4, "b"][-1] == 6
    assert got[2, 0, "u"][3] is None and len(got) == 9
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_quotes_equal_their_sql(spark):
    import duckdb

    df = spark.createDataFrame(TALK[:-1], "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    want = con.sql(quotes.ORACLE_SQL)
    names = quotes.link_quotes(df).columns
    assert sorted(want.columns) == sorted(names)
    assert sorted(map(str, con.sql(quotes.ORACLE_SQL).project(", ".join(names)).fetchall())) == sorted(str(tuple(r)) for r in quotes.link_quotes(df).collect())


def test_the_driver_does_not_learn_from_the_sample(spark, monkeypatch):
    learn, here = neighbours.learn, os.getpid()

    def elsewhere(*args):
        assert os.getpid() != here
        return learn(*args)

    monkeypatch.setattr(neighbours, "learn", elsewhere)
    x = np.random.default_rng(6).standard_normal((900, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, [1.0] * 3) for i in range(40)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows_a_part=200).collect()
    assert {r.query_id for r in got} == set(range(0, 900, 20)) and max(r.vec_id for r in got) < 900


def test_near_duplicates_go_in_one_python_worker_a_task(docs):
    kept = jaccard.keep_one(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # rows that may have to go, with their classes, and all others; rows without a doc_id need none
    odd = docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    assert rows(jaccard.keep_one(odd).filter("doc_id is not null")) == rows(kept) and jaccard.keep_one(odd).filter("doc_id is null").count() == 3
