"""Plane files, fill-in-middle and periodic runs against brute force, round trips and the library they stand for."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docgraph.llm import bpe, fim, planes, rope, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, part int, runs string, fim_text string, restored string, form string, low string"
VOCABULARY = public_tokenizers.path(planes.VOCABULARY)


def rows(n=60, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(["a", "b", "né", "中文", "x\U0001f600", "end.", "it's", "<|endoftext|>"]) for _ in range(rng.randrange(120))]
        out.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(words)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one <S> two"), (n + 4, "ab " * 400), (n + 5, "x" * 3000), (n + 6, "a<P"), (n + 7, "> <"), (n + 8, "\xa0a b")]
    out += [(7, "seven again"), (7, "seven again"), (None, "no name"), (None, None), (-3, "a a a a a a a a a a a a a")]
    return out


def write(spark, folder, got):
    frame = spark.createDataFrame([(*r, *("x" if k not in (2, 4) else k for k in range(10))) for r in got] if got else [], SCHEMA)
    frame.repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def words(text):
    return (text or "").encode().split()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---- plane files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**62), 2**62)), st.lists(st.integers(0, 2**32 - 1), max_size=30)), max_size=8), st.sampled_from([planes.BITS, planes.BYTES]), st.integers(1, 40), st.sampled_from([255, 65535, 2**32 - 1]))
def test_a_file_gives_back_its_documents_and_any_range(docs, kind, chunk, most):
    docs = [(d, np.array(ids, np.uint32) % np.uint32(most)) for d, ids in docs]
    f = planes.File(planes.pack(docs, kind, chunk))
    assert f.size == planes.width(max((int(i.max(initial=0)) for _, i in docs), default=0))
    got = list(f.documents())
    assert [(d, i.tolist()) for d, _, i in got] == [(d, i.tolist()) for d, i in docs]
    ids = np.concatenate([i for _, i in docs]) if docs else np.zeros(0, np.uint32)
    for lo in range(0, len(ids) + 1, 3):
        assert f.ids(lo, len(ids) - lo // 2 if lo // 2 + lo <= len(ids) else lo).tolist() == ids[lo : (len(ids) - lo // 2 if lo // 2 + lo <= len(ids) else lo)].tolist()


def test_planes_hold_bytes_and_bits_by_significance():
    ids = np.array([0x0102, 0x0304, 0xFF00], np.uint32)
    assert planes.to_planes(ids, 2, planes.BYTES) == [b"\x02\x04\x00", b"\x01\x03\xff"]
    bits = planes.to_planes(ids, 2, planes.BITS)
    assert len(bits) == 16 and bits[1] == bytes([0b001]) and bits[8] == bytes([0b111]) and bits[15] == bytes([0b100])


@pytest.mark.parametrize("at", [0, 12, -1, -30])
def test_damage_is_told(at):
    raw = bytearray(planes.pack([(1, np.arange(500, dtype=np.uint32))], chunk=64))
    raw[at] ^= 255
    with pytest.raises(ValueError):
        list(planes.File(bytes(raw)).documents())
    with pytest.raises(ValueError):
        planes.File(b"")


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab é\n'1.　", max_size=300), st.integers(1, 40))
def test_pieces_are_encoded_as_the_whole(text, most):
    made, got = planes.tokenizer(VOCABULARY), planes.pieces(text, most)
    assert "".join(got) == text
    assert [i for p in got for i in made.encode(p, add_special_tokens=False).ids] == made.encode(text, add_special_tokens=False).ids


def expected_ids(got):
    made = planes.tokenizer(VOCABULARY)
    return [(d, made.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in got]


def test_files_of_documents_equal_the_library(spark, tmp_path):
    got = rows()
    found = planes.op11_plane_files(spark, write(spark, tmp_path, got)).collect()
    assert len(found) == len(got)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    found = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((d for d, _ in got if d is not None)) + [None, None]
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((d or 0, len(i), crc(i)) for d, i in expected_ids(got))
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]


@pytest.mark.parametrize("kind", [planes.BITS, planes.BYTES])
def test_small_chunks_and_files_hold_the_same_ids(spark, kind):
    got = rows(30)
    docs = spark.createDataFrame(got, "doc_id long, text string")
    files = planes.documents_to_files(docs, VOCABULARY, kind=kind, chunk=7, file_ids=50)
    assert files.filter("n_docs > 1").count() and files.filter("file > 0").count()
    found = planes.read_ids(files).collect()
    assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in found) == sorted((d or 0, i) for d, i in expected_ids(got))


def test_an_id_of_most_rows_is_spread_over_ranges(spark):
    docs = spark.createDataFrame([(5, f"text {i}") for i in range(400)] + [(i, "x") for i in range(10)], "doc_id long, text string")
    bounds = planes.ranges(docs, 8)
    assert (bounds == 5).sum() > 1
    parts = planes.encode(docs, VOCABULARY, bounds=bounds).filter("doc_id = 5").groupBy("part").count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 200
    found = planes.read_ids(planes.documents_to_files(docs, VOCABULARY)).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted([5] * 400 + list(range(10)))


def test_no_documents_make_no_files(spark, tmp_path):
    folder = write(spark, tmp_path, [])
    assert planes.op11_plane_files(spark, folder).collect() == []
    assert fim.op12_fill_in_middle(spark, folder).collect() == []
    assert runs.op13_periodic_runs(spark, folder).collect() == []


def test_ids_decode_by_the_token_byte_table(spark):
    path = public_tokenizers.path(bpe.VOCABULARY)
    got = rows(20)
    docs = spark.createDataFrame(got, "doc_id long, text string")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids")
    back = bpe.decode(ids.unionByName(spark.createDataFrame([(99, None)], "doc_id long, ids array<int>")), path).collect()
    assert sorted((r["doc_id"] or 0, None if r["decoded"] is None else bytes(r["decoded"]).decode()) for r in back if r["doc_id"] != 99) == sorted((d or 0, t or "") for d, t in got)
    assert [r["decoded"] for r in back if r["doc_id"] == 99] == [None]
    table_ = bpe.encoder(path, bpe.WHOLE)[1]
    some = np.random.default_rng(3).integers(0, len(table_), 500)
    flat, first, size = bpe.byte_table(path)
    assert bpe._spelled(flat, first, size, some) == b"".join(table_[i] for i in some)
    with pytest.raises(Exception, match="token-byte table"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), path).collect()


# ---- ropes and fill-in-middle


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab é\U0001f600", max_size=200), st.integers(1, 9), st.sampled_from([None, r"\w+", r"\s+|b", "a|"]), st.lists(st.floats(0, 1), max_size=6))
def test_ropes_split_and_join_as_texts_do(text, leaf, unit, at):
    pattern = None if unit is None else re.compile(unit)
    whole = rope.build(text, pattern, leaf)
    assert rope.text_of(whole) == text and whole.points == len(text)
    units = [leaf.text[a:b] for leaf in rope.leaves(whole) for a, b in ([(i, i + 1) for i in range(leaf.points)] if leaf.ends is None else zip([0, *leaf.ends], leaf.ends))]
    assert "".join(units) == text and len(units) == whole.units and all(units)
    for x in at:
        k = round(x * whole.units)
        a, b = rope.split(whole, k)
        assert (rope.text_of(a), a.units, rope.text_of(b), b.units) == ("".join(units[:k]), k, "".join(units[k:]), whole.units - k)
        whole = rope.join(b, a)
        units = units[k:] + units[:k]
        assert rope.text_of(whole) == "".join(units)
        assert whole.height <= 2 + 1.5 * np.log2(2 + sum(1 for _ in rope.leaves(whole)))
        p = round(x * whole.points)
        if unit is None:
            assert rope.text_of(rope.split(whole, p, by_units=False)[0]) == "".join(units)[:p]
    for what in ("ab", "a", "é b"):
        assert rope.find(whole, what) == "".join(units).find(what)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aé<PSM> \U0001f600", max_size=60), st.sampled_from(["plain", "psm", "spm", None]), st.integers(0, 70), st.integers(0, 70), st.sampled_from([None, r"\w+|<."]))
def test_transformed_texts_come_back(text, form, a, b, unit):
    out, made, n, prefix, middle = fim.transform(text, form, (a, b), None if unit is None else re.compile(unit))
    assert fim.restore(out, made) == text
    if not text or form in ("plain", None) or any(s in text for s in fim.SENTINELS):
        assert (out, made, prefix, middle) == (text, "plain", None, None)
        return
    if unit is None:
        low, high = sorted((min(a, len(text)), min(b, len(text))))
        assert (n, prefix, middle) == (len(text), low, high - low)
    low, high = prefix, prefix + middle
    p, m, s = text[:low], text[low:high], text[high:]
    assert out == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


def test_words_as_units_are_never_cut():
    text = "alpha beta gamma delta"
    for a in range(8):
        for b in range(a, 8):
            out, _, n, prefix, middle = fim.transform(text, "psm", (a, b), re.compile(r"\w+"))
            assert n == 7 and {prefix, prefix + middle} <= {0, 5, 6, 10, 11, 16, 17, 22}


def test_outputs_without_their_sentinels_are_told():
    for text, form in (("abc", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c", "spm")):
        with pytest.raises(ValueError):
            fim.restore(text, form)


def expected_fim(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, "spm" if h4 % 100 < 20 else "psm", low, high - low, sha(out), sha(text))


def test_fill_in_middle_equals_slices(spark, tmp_path):
    got = rows()
    found = fim.op12_fill_in_middle(spark, write(spark, tmp_path, got))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((expected_fim(*r) for r in got), key=str)


def test_other_columns_come_along_and_clashing_ones_give_way(spark):
    docs = spark.createDataFrame([(1, "abcdef", "x", "y", "z")], "doc_id long, text string, FORM string, fim_text string, `a b` string")
    out = fim.from_fim(fim.to_fim(docs, F.lit("psm"), F.lit(4), F.lit(2))).first()
    assert out.asDict() == {"doc_id": 1, "FORM": "x", "a b": "z", "fim_text": "<P>ab<S>ef<M>cd", "fim_form": "psm", "fim_units": 6, "prefix_chars": 2, "middle_chars": 2, "restored": "abcdef"}


# ---- periodic runs


def all_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and not any(all(w[k] == w[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=4), st.integers(2, 13))
def test_runs_equal_brute_force(texts, least):
    codes, bounds = runs._codes(texts) if texts else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    found = [[] for _ in texts]
    for s, length, q in zip(*(x.tolist() for x in runs.runs_of(codes, least))):
        k = int(np.searchsorted(bounds, s, "right")) - 1
        found[k].append((s - int(bounds[k]), length, q))
    assert found == [all_runs(t, least) for t in texts]


@pytest.mark.parametrize("word", ["fibonacci", "one", "nested", "thue"])
def test_runs_of_words_with_many_squares(word):
    if word == "fibonacci":
        a, b = "a", "ab"
        while len(b) < 300:
            a, b = b, b + a
        text = b[:300]
    elif word == "thue":
        text = "".join(str(bin(i).count("1") % 2) for i in range(256))
    else:
        text = "a" * 300 if word == "one" else ("aab" * 5 + "c") * 8
    w = [c.encode() for c in text]
    codes, _ = runs._codes([w])
    assert list(zip(*(x.tolist() for x in runs.runs_of(codes, 2)))) == all_runs(w, 2)


def test_a_long_period_takes_few_steps():
    w = [str(i % 5000).encode() for i in range(12_500)]
    codes, _ = runs._codes([w])
    classes, small, steps = runs.Classes(codes), np.arange(len(codes)), 0
    while (small := classes.refine(small)) is not None:
        steps += len(small)
    assert steps < 2 * len(w)
    assert [x.tolist() for x in runs.runs_of(codes)] == [[0], [12_500], [5000]]


def expected_runs(doc_id, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found, gone = all_runs(w), set()
    for s, length, q in found:
        gone |= set(range(s + q, s + length))
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, sha("".join(f"{s},{x},{q}\n" for s, x, q in found)), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_periodic_runs_equal_brute_force(spark, tmp_path):
    got = rows(150)
    assert sum(d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in got) > 5
    found = runs.op13_periodic_runs(spark, write(spark, tmp_path, got))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((expected_runs(*r) for r in got), key=str)


def test_texts_beyond_a_batch_are_whole(spark):
    texts = ["a b " * 20, "c", "x y z " * 9, None]
    assert [len(g) for g in runs._groups(texts, 10)] == [1, 1, 1, 1] and [len(g) for g in runs._groups(texts, 41)] == [2, 2]
    found = runs.find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r["runs"]] for r in found] == [[(0, 40, 2)], [], [(0, 27, 3)], []]
    assert [r["collapsed"] for r in found] == ["a b", "c", "x y z", ""]
