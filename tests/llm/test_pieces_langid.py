"""SentencePiece coding against the library, and the language network on held-out rows."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from clarion.llm import langid, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
EDGES = [None, "", " ", "  ", "a", "a ", " a", "  a  b ", "\n", "a\n b\t\tc \r\n", "▁x ▁ y▁", "é ü 漢字 😀", "x" * 5000, "ab " * 3000, "</s> <s> <unk>", " a　b", "0x00\x00b"]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


def random_texts(n=300):
    rng = random.Random(3)
    return ["".join(rng.choice("ab The cat,. \n\t▁éß漢😀  ") for _ in range(rng.randrange(40))) for _ in range(n)]


def test_chunks_give_the_librarys_ids(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    coder = pieces.PieceCoder(model)
    assert coder.by_chunk
    texts = [t or "" for t in EDGES] + random_texts()
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == sp.encode(text), text


def test_table_is_bounded_and_refilled(model, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 5)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    coder = pieces.PieceCoder(model)
    for text in ("one two three", "four five six one", "seven eight nine"):
        assert coder.encode([text])[0].tolist() == sp.encode(text)
        assert len(coder.table) <= 5


def test_digests_and_round_trip(spark, model):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = EDGES + random_texts(60)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in pieces.digest(docs, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == pieces.digest_one(ids, sp.decode(ids) if ids else "")
    assert pieces.digest(docs.limit(0), model).count() == 0
    apart = pieces.decode(pieces.encode(docs, model), model).select("doc_id", "ids", "decoded")
    together = pieces.round_trip(docs.withColumn("_coded", F.lit(1)), model)
    assert set(together.columns) == {*docs.columns, "_coded", "ids", "decoded"} and len(set(together.columns)) == len(together.columns)
    assert sorted(map(str, apart.collect())) == sorted(map(str, together.select("doc_id", "ids", "decoded").collect()))


def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs, net).where(langid.held_out()).selectExpr("count(*) n", "count_if(lang = language.lang) ok", "min(language.score) lo", "max(language.score) hi").first()
    assert out.n > 150 and out.ok / out.n > 0.97
    assert 0 <= out.lo and out.hi <= 1
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "12 + 3 = 15 !!"), (4, "the and of with " * 30_000), (4, "the and of with " * 30_000), (None, "the")], "doc_id long, text string")
    rows = langid.predict(edge, net).collect()
    assert [r.language.lang for r in rows if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert len({(r.language.lang, r.language.score) for r in rows if r.doc_id == 4}) == 1
    assert langid.predict(edge.limit(0), net).count() == 0


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    net = langid.fit(docs)
    assert {r.language.lang for r in langid.predict(docs, net).collect()} == {"und"}


def test_pair_tables_equal_the_plain_convolution():
    import numpy as np

    net = langid.ByteNet(["a", "b"])
    x, owner, filled = langid.windows([b"Some text with letters " * 30, b"x"])
    assert len(x) == len(owner) == len(filled) and filled.sum() == 23 * 30 + 1
    hidden = np.maximum(np.concatenate([a.max(axis=1) for a in net.answers(x)], axis=1), 0)
    z = hidden @ net.dense + net.bias
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(p, net.probabilities(x, net.tables()), atol=1e-5)


def test_digest_is_sha256_of_ids():
    assert pieces.digest_one([1, 2], "x")[1] == hashlib.sha256(b"1,2").hexdigest()


def test_the_chunk_table_is_bounded_by_its_characters(monkeypatch):
    import public_tokenizers

    coder = pieces.PieceCoder(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))
    monkeypatch.setattr(pieces, "TABLE_CHARS", 2_000)
    texts = [f"{'x' * 300}{i} word{i}" for i in range(40)]
    got = [x.tolist() for i in range(0, 40, 4) for x in coder.encode(texts[i:i + 4])]
    assert got == [coder.sp.encode(t) for t in texts]
    assert sum(map(len, coder.table)) <= 2_000 and coder.chars == sum(map(len, coder.table))
