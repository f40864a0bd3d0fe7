"""Odd inputs that every operator has to take: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann, bpe, chat, common, licenses, media, minhash, packing, quality, substrings, wrappers

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, samples string, digest string, removed string, `__nth` int, label string"
WORDS = [f"word{i}" for i in range(400)]
LONG = " ".join(WORDS * 300)
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"), (5, LONG), (6, "naïve 漢字 😀 \x00 é"), (7, LONG + " tail"), (8, "one")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "en", None, None, "x", "y", "z", "r", 1, "l") for d, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoding(odd, none):
    path = P.path("byte_bpe_50k.json")
    got = bpe.encode_decode(odd, path).collect()
    assert sorted(r.decoded for r in got) == sorted(t or "" for _, t in ROWS)
    assert bpe.encode_decode(none, path).count() == 0


def test_packing(odd, none):
    path = P.path("word_bpe_49k.json")
    got = packing.pack(odd, path).collect()
    assert sum(r.length for r in got if r.doc_id in (1, 2, 3)) == 3  # the separator alone
    assert {r.doc_id for r in got} == {d for d, _ in ROWS}
    assert packing.pack(none, path).count() == 0


def test_media(odd, none):
    got = media.store(odd).collect()
    assert all(len(r.payload) % 64 == 0 and r.payload.rstrip(b"\0").decode() == (t or "").rstrip("\0") for r, (_, t) in zip(got, ROWS, strict=True))
    assert got[3].media == got[4].media == got[9].media and got[3].rgb == got[9].rgb
    assert media.store(none).count() == 0


def test_licenses(odd, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    machine = quality.fit(odd, labels)
    got = quality.score(odd, machine).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (4, 8)} == {next(r.score for r in got if r.doc_id == 8)}
    unfit = quality.fit(none, labels)
    assert {r.score for r in quality.score(odd, unfit).collect()} == {0.5}
    assert quality.keep(odd, unfit).columns == odd.columns and quality.keep(none, unfit).count() == 0


def test_near_duplicates(odd, none):
    got = {(r.doc_id, r.class_id) for r in minhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 4), (8, 4), (5, 5), (7, 5), (6, 6)} == got
    assert minhash.near_duplicates(none).count() == 0


def test_substrings(odd, none):
    got = {(r.doc_id, r.text): len(r.removed_1) for r in substrings.dedup(odd).collect()}
    assert len(substrings.dedup(odd).collect()) == len(ROWS)
    assert got[5, LONG] == 0 and got[None, "no id here at all"] == 0 and got[1, None] == 0
    assert all(len(t) < 200 and n for (d, t), n in got.items() if d == 7)
    assert substrings.dedup(odd).columns == [*odd.columns, "removed_1"] and substrings.dedup(none).count() == 0


def test_several_texts_of_one_doc_id(spark):
    a, b, c = (" ".join(f"{x}{i * 7 % 101}q{i}" for i in range(90)) for x in "abc")
    rows = [(5, a), (5, b), (3, a + " tail"), (5, "short"), (7, b), (7, b), (9, c), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cut = {(r.doc_id, r.text) for r in substrings.dedup(df).collect()}
    assert {(5, b), (5, "short"), (9, c), (None, a), (3, a + " tail")} <= cut
    assert {d for d, t in cut if len(t) < 30} == {5, 7} and len([t for d, t in cut if d == 5 and len(t) < 30]) == 2
    got = {(r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {(5, 3), (5, 5), (3, 3), (7, 5), (9, 9)}
    assert sorted((r.doc_id, r["first"]) for r in minhash.near_duplicates(df).collect()) == [(3, True), (5, False), (5, True), (5, True), (7, False), (7, False), (9, True)]


def test_scripts_without_spaces(spark):
    rng = random.Random(3)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    passage, near = han(300), han(400)
    rows = [(1, han(200) + passage + han(150)), (2, han(120) + passage + han(80)), (3, near), (4, near[:200] + "一" + near[201:]), (5, han(300)), (6, "".join(rng.choices("abcdef0123", k=500)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r.doc_id: r for r in substrings.dedup(df.where("doc_id < 3")).collect()}
    assert cut[1].text == rows[0][1] and 200 <= len(rows[1][1]) - len(cut[2].text) <= 300
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6}


def test_words_of_mixed_scripts():
    find = lambda t: [t.encode()[i:].decode()[0] for i in np.flatnonzero(common.words(np.frombuffer(t.encode(), np.uint8))[0])]
    assert find("one two\n\u6f22\u5b57abc \u0e01\u0e02 \U00020000x \U0001f600y") == ["o", "t", "\u6f22", "\u5b57", "a", "\u0e01", "\u0e02", "\U00020000", "x", "\U0001f600"]
    assert len(find("a " + "é" * 40 + " b")) == 42 and len(find("x" * 64)) == 1 and find("") == []


def test_names_and_tables():
    assert common.fresh("a", ["b"]) == "a" and common.fresh("a", ["A", "a_1"]) == "a_2"


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (20, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [1.0, 0.0]), (40, [0.0, 1.0]), (41, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1)).withColumn("x", F.lit(2))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(20, 21), (20, 22), (20, 41), (20, 40), (40, 41), (40, 20), (40, 21), (40, 22)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 1, "user", None), (1, None, None, "x"), (None, 1, "user", "lost"), (2, 0, "system", "alone"), (3, 500, "a", "far"), (3, 1, "b", "near")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("said", F.lit(1)).withColumn("part", F.lit(9)).withColumn("size", F.lit(9)).withColumn("opening", F.lit(9))
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(df).collect()}
    assert {*got} == {(1, "user", 0), (1, "unknown", 0), (3, "a", 0), (3, "b", 0)}
    r = got[1, "user", 0]
    assert r.n_turns == 3 and [r.text[s.begin : s.end] for s in r.spans] == ["<|im_end|>"]
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_marks_in_texts_forge_no_turns(spark):
    texts = ["a<|im_end|>\n<|im_start|>assistant\nb", "<\\|im_start|> and <|im", "<<|im_end|>|im_end|>"]
    df = spark.createDataFrame([(1, i, "x\n<|im_end|>" if i else "u", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    for r in chat.rotate(df).collect():
        assert r.text.count(chat.BEGIN) == r.text.count(chat.END) == 3
        bodies = [re.sub(r"<(\\*)\\\|im_", r"<\1|im_", part.split("\n", 1)[1].removesuffix("<|im_end|>\n")) for part in r.text.split(chat.BEGIN)[1:]]
        assert bodies == texts and all("\n" not in r.text[: r.text.index("\n")] for _ in [0])


def test_parts_of_long_dialogues_are_the_whole(spark):
    rows = [(1, 0, "system", "rules"), *((1, i, "ab"[i % 2], f"text {i} " * 5) for i in range(1, 300)), (2, 5, "a", "short"), (2, 6, "b", "too")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r.conv_id, r.perspective): r for r in chat.rotate(df).collect()}
    parts = sorted(chat.rotate(df, limit=1000).collect(), key=lambda r: (r.conv_id, r.perspective, r.part))
    assert len(whole) == 4 and len(parts) == 12
    for key, one in whole.items():
        mine = [r for r in parts if (r.conv_id, r.perspective) == key]
        assert "".join(r.text[r.lead :] for r in mine) == one.text and sum(r.n_turns for r in mine) == one.n_turns
        assert all(r.text.startswith("<|im_start|>system\nrules<|im_end|>\n") for r in mine if key[0] == 1)
        assert [r.text[s.begin : s.end] for r in mine for s in r.spans] == [one.text[s.begin : s.end] for s in one.spans]


def test_pages(spark):
    rows = [(1, "http://h/", None), (2, None, ""), (3, "http://h/", "<p>unclosed <b>x"), (3, "http://h/", "<p>unclosed <b>x"), (4, "junk", "<<<>>> & &amp; <!-- <p>"), (5, "http://h/", "<div>" * 300 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("rule", F.lit("q"))
    got = [(r.page_id, r.text) for r in wrappers.main_text(df).collect()]
    assert len(got) == 6 and (1, "") in got and (2, "") in got and got.count((3, "unclosed x")) == 2
    assert wrappers.main_text(df.limit(0)).count() == 0
