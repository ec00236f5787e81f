"""The source audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from clarion.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, min_docs, top):
    docs, counts, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or "")):
            docs[lang, t].add(i)
            counts[lang, source][t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), d in docs.items() if x == lang and len(d) >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, x.decode(), -v, r) for part, found in (("pair", pairs), ("term", terms)) for r, (v, x) in enumerate(found, 1)}
    return out


def compare(spark, rows, min_docs=3, top=4):
    got = [tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA), min_docs, top).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, min_docs, top)
    return got


def test_matches_plain_counting(spark):
    rng = random.Random(1)
    words = ["one", "One", "one,", "(two)", "two.three", "Zwei-drei", "Éte", "éte", "K", "don't", "4", "_x", "日本", "a\x00b"] + [f"w{chr(97 + i)}" for i in range(12)]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", "\x0b", "  ", "\x1c", " "]) for _ in range(rng.randrange(12))), rng.choice(["en", "de", None]),
             rng.choice(["s1", "s2", "s10", "", None])) for i in range(120)]
    rows += [(500, None, "en", "s9"), (500, "", "en", "s9"), (1, "one two", "xx", "only"), (1, "one two", "xx", "only"), (None, "one", "xx", "only"), (7, "lone", "yy", "a"), (8, "", "yy", "b")]
    got = compare(spark, rows)
    assert {r[4] for r in got if r[0] == "yy"} == {0}  # no kept terms
    compare(spark, rows, min_docs=1, top=50)


def test_chunks_of_one_document_are_one_document(spark):
    """Four spellings in two documents are two documents, whatever the spellings' own counts."""
    rows = [(1, "Word word, (word)", "en", "a"), (2, "word. Word", "en", "b")]
    assert divergence.term_counts(spark.createDataFrame(rows, SCHEMA), 3).count() == 0
    got = divergence.term_counts(spark.createDataFrame([*rows, (3, "word!", "en", "b")], SCHEMA), 3)
    assert {tuple(r) for r in got.collect()} == {("en", "word", "a", 3), ("en", "word", "b", 3)}


def test_long_texts_and_other_columns(spark):
    rows = [(1, "lang term " * 300_000, "en", "a", "x", 1), (2, "term", "en", "b", "y", 2), (3, "x" * 100_000, "en", "b", "z", 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", term string, n int")
    assert {tuple(r) for r in divergence.term_counts(df, 2).collect()} == {("en", "term", "a", 300_000), ("en", "term", "b", 1)}
    assert divergence.audit(df.limit(0)).count() == 0


def test_buckets_are_summed_when_they_hold_much(monkeypatch):
    """An owner that sums its entries now and then gives the same rows."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "e", "f"]) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    part = lambda i: pa.RecordBatch.from_arrays([pa.array(texts[i:i + 30]), pa.array(["en", "de"] * 15), pa.array(["s", "t", "u"] * 10)], names=["text", "lang", "source"])
    bundles = [divergence.count_chunks(part(i), i, 1, 20) for i in range(0, 300, 30)]

    def rows():
        return sorted(map(repr, pa.Table.from_batches(list(divergence._owner(20)(iter(bundles)))).to_pylist()))
    whole = rows()
    monkeypatch.setattr(divergence, "HELD", 40)
    assert rows() == whole
