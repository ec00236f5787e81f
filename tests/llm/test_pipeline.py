"""The corpus pipeline against a plain version of its stages, and its contract."""

import random
import re
import zlib

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__
from clarion.llm import langid, mixing

SYLLABLES = {"en": "the and ing ion ed th her wh", "de": "sch ung ein ich heit ver ge ß", "fr": "eau oi ment ê é que tre ç"}


def corpus():
    rng = random.Random(12)
    rows = []
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        text = " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 90)))
        rows.append((i, text, lang if i % 3 else None, rng.choice(["a", "a", "b", None]), len(text)))
    for i in range(40):  # copies with other blanks
        src = rows[i * 2]
        rows.append((300 + i, src[1].replace(" ", "  ") if i % 2 else src[1], None, "b", 0))
    for i in range(30):  # near copies
        words = rows[100 + i][1].split(" ")
        words[-1] = "changed"
        rows.append((400 + i, " ".join(words), "en", "c", 0))
    return rows + [(500, None, "en", "a", 0), (501, "", "de", "a", 0), (502, "123 456", "fr", "b", 7)]


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_stages_agree_with_the_plain_version(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    named = stages["language"](spark, docs, tables).persist()
    assert named.columns == columns
    ids = {r.doc_id for r in named.collect()}
    assert ids == {r[0] for r in corpus() if r[0] < 500}

    once = stages["exact_dedup"](spark, named, tables).persist()
    best = {}
    for r in named.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(r.text), r.doc_id))
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == sorted(d for _, d in best.values())

    near = stages["near_dedup"](spark, once, tables).persist()
    rows = sorted((r.doc_id, shingles(r.text)) for r in once.collect())
    root = {d: d for d, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, (a, sa) in enumerate(rows):
        for b, sb in rows[:i]:
            if 100 * len(sa & sb) >= 80 * len(sa | sb):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(d for d in root if root[d] == d)

    mixed = stages["mix"](spark, near, tables).persist()
    copies = {r.doc_id: r.copies for r in mixing.plan(near).collect()}
    assert mixed.columns == columns and {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: c for d, c in copies.items() if c}

    out = stages["sentencepiece"](spark, mixed, tables).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == mixed.count() and all(r.ids == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)

    whole = corpus_pipeline.run(spark, tables).collect()
    assert sorted(map(str, whole)) == sorted(map(str, out))


def test_language_loses_no_clean_document(spark, tables):
    """Short texts, texts in all languages and unlabelled tables are no evidence against a document."""
    stage = dict(corpus_pipeline.STAGES)["language"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) AS lang", "source", "n_chars")
    assert {r.doc_id for r in stage(spark, unlabelled, tables).collect()} == {r[0] for r in corpus() if r[0] < 500}
    by_lang = {lang: [r[1] for r in corpus() if r[2] == lang] for lang in SYLLABLES}
    mixed = [" ".join(by_lang[lang][k % len(by_lang[lang])][:600] for lang in SYLLABLES) for k in range(40)]
    short = [by_lang[lang][k][:n].strip() for lang in SYLLABLES for k, n in enumerate((2, 3, 5, 8, 12, 20))]
    rows = [(1_000 + k, t, None, "a", len(t)) for k, t in enumerate(mixed + short)]
    got = {r.doc_id for r in stage(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), tables).collect()}
    assert len({r[0] for r in rows} - got) == 0


def test_empty_table_runs_through(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0


def test_every_operator_is_registered(spark):
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_held_out_is_the_remainder_of_the_checksum(spark):
    rows = spark.range(50).select("id", langid.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
