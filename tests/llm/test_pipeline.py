"""The pipeline's stages on the small tables, and the registry's SQL."""

import hashlib
import struct
import zlib

import pytest
from tests.oracle import connect, rows

import corpus_pipeline
from quillspark.llm import minhash, registry

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_drop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name
        rows_ = docs.collect()
        assert len(rows_) <= before
        before = len(rows_)
        docs = spark.createDataFrame(rows_, docs.schema)
    assert len({r.doc_id for r in rows_}) == len(rows_)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in rows_}


ODD = [(1, None, 1), (2, "", 2), (4, "one", 3), (4, "one", 3), (4, "one", 4), (4, "two other words here", 5), (8, "one", 6), (None, "no id", 7), (None, "no id", 7), (9, " ".join(f"w{i}" for i in range(40_000)), 8), (10, " ".join(f"w{i}" for i in range(40_000)) + " tail", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    names = "doc_id long, text string, h1 int, lang string, source string, n_chars long, nth int, NTH_1 int, kept string, chunks string, removed string, `__nth` int, `__chunks` int, flagged_doc int, flagged_key int, `a.b` int, label int"
    return spark.createDataFrame([(d, t, n, "en", "s", None, 1, 2, "k", "c", "r", 1, 2, 3, 4, 5, 6) for d, t, n in ODD], names)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, odd, name, stage):
    got = stage(spark, odd, SF)
    rows_ = got.collect()
    assert name == "packing" or got.columns == odd.columns
    found = sorted((-1 if r.doc_id is None else r.doc_id for r in rows_))
    if name == "near_duplicates":
        assert found == [-1, -1, 1, 4, 4, 9] and {r.text for r in rows_ if r.doc_id == 4} == {"one", "two other words here"}
    elif name == "substrings":
        assert len(rows_) == len(ODD) and {r.doc_id for r in rows_ if r.text is None} == {1} and max(len(r.text or "") for r in rows_ if r.doc_id == 10) < 200
    elif name == "packing":
        assert {r.doc_id for r in rows_} == {d for d, _, _ in ODD}
    else:
        assert {repr(r) for r in rows_} <= {repr(r) for r in odd.collect()}
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_sql(spark):
    duck = connect(SF)
    for name, statement in registry.oracle_sql().items():
        assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.execute(statement).df()), name


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in registry.queries()} == {f"op{n}" for n in range(1, 14)}


def test_contract_columns(spark):
    """The registered queries' results, each against what its rows must be."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    run = lambda name: registry.queries()[name](spark, SF)
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in run("op3_bpe").collect()}
    assert {*got} == {*texts}
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    got = {r.doc_id: r for r in run("op4_media").collect()}
    for doc, text in texts.items():
        raw = text.encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert (got[doc].n_bytes, got[doc].payload_bytes, got[doc].payload_sha256, got[doc].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert got[doc].media_bytes > 0 and len(got[doc].media_sha256) == 64 and got[doc].feature
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    pieces: dict[int, list] = {}
    for r in run("op2_packing").collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length])))
            at += r.length
        assert at == len(ids)
    assert {r.doc_id for r in run("op8_substrings").collect()} == {*texts} and {r.doc_id for r in run("op10_minhash").collect()} == {*texts}
    ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    assert {(r.query_id, r["rank"]) for r in run("op9_ann").collect()} == {(i, k) for i in ids if i % 20 == 0 for k in range(1, 1 + min(20, len(ids) - 1))}
    assert {c for r in run("op6_licenses").limit(5).collect() for c in r.asDict()} <= {"doc_id", "license", "coverage", "begin", "end", "matched"}


def test_classes_of_the_table_equal_brute_force(spark):
    """All pairs of sf0.001's texts by exact weighted Jaccard similarity."""
    rows_ = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    total, counts = minhash.document_frequencies(spark.createDataFrame(rows_, "doc_id long, text string"))
    shingler = minhash.Shingler(minhash.rarities(total, counts))
    sets = [shingler.weighted(w) for w in shingler.words([r.text or "" for r in rows_])]
    label = {r.doc_id: r.doc_id for r in rows_}
    for i, a in enumerate(rows_):
        for j in range(i):
            b = rows_[j]
            if label[a.doc_id] != label[b.doc_id] and (a.text == b.text or len(sets[i][0]) and minhash.jaccard(sets[i], sets[j]) >= 0.8):
                low, high = sorted((label[a.doc_id], label[b.doc_id]))
                label = {d: low if c == high else c for d, c in label.items()}
    assert {r.doc_id: r.class_id for r in registry.queries()["op10_minhash"](spark, SF).collect()} == label
