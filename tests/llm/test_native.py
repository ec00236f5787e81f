"""Licences, url reputation, mixing, shards and fingerprints."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from clarion.llm import licences, mixing, reputation, sharding, winnowing

# licences


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = licences.fit(docs)
    extra = [(10_001, "Intro.\nReleased under the MIT License.\nend"), (10_002, "x\n\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
             (10_003, "He got a license to fish from the public office."), (10_004, None), (10_005, ""), (10_006, "Licensed under CC BY-NC 4.0."), (10_006, "Licensed under CC BY-NC 4.0."),
             (None, "All rights reserved."), (10_007, "the apache of the files, version one " * 20_000)]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    return licences.by_document(docs.unionByName(more), model), docs, model


def test_licences_are_named(scanned):
    out, docs, _ = scanned
    rows = out.collect()
    got = {r.doc_id: r.family for r in rows}
    want = {10_001: "MIT", 10_002: "GPL", 10_003: None, 10_004: None, 10_005: None, 10_006: "CC-BY-NC", None: "proprietary", 10_007: None}
    assert {k: got[k] for k in want} == want
    assert len(rows) == docs.count() + 9 and len([r for r in rows if r.doc_id == 10_006]) == 2
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache", "All rights reserved.": "proprietary",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL"}
    for r in docs.collect():
        found = [f for line, f in lines.items() if line in r.text]
        assert (got[r.doc_id] in found) if found else got[r.doc_id] is None


def test_a_few_words_of_a_notice_confirm_nothing(spark, scanned):
    _, docs, model = scanned
    lines = ["the License", "under the License", "See the License.", "of the License", "All rights reserved.", "Released under the MIT License."]
    few = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.family for r in licences.by_document(few, model).collect()}
    assert [got[i] for i in range(6)] == [None, None, None, None, "proprietary", "MIT"]


def test_licences_of_an_empty_table(spark, scanned):
    _, docs, model = scanned
    assert licences.by_document(docs.limit(0), model).count() == 0


def test_paragraphs_without_anchor_words_have_no_features(spark, scanned):
    _, docs, model = scanned
    from pyspark.sql import functions as F

    rest = licences.paragraphs(docs).where(~F.arrays_overlap("words", F.lit(model.anchors)))
    grams = rest.select(F.explode(F.concat("words", licences.pairs_of(F.col("words")))).alias("g")).distinct()
    assert grams.where(F.col("g").isin(model.vocabulary)).count() == 0


def test_notices_of_everyday_words_are_found(spark):
    """Their words stand in many lines, singly and in other orders."""
    rng = random.Random(4)
    common = ["all", "rights", "reserved", "released", "under", "the", "license", "of", "a", "public", "and", "was", "to", "mit", "prior", "written", "permission"]
    other = ["river", "tree", "walked", "house", "green", "evening", "table", "letter", "north", "sang"]
    lines = [" ".join(rng.choice(common if rng.random() < 0.3 else other) for _ in range(rng.randrange(8, 30))) for _ in range(1_500)]
    notices = {2_001: ("All rights reserved.", "proprietary"), 2_002: ("Released under the MIT License.", "MIT"),
               2_003: ("No part of this publication may be reproduced without the prior written permission of the publisher.", "proprietary")}
    rows = list(enumerate(lines)) + [(i, t) for i, (t, _) in notices.items()] + [(3_000 + i, lines[i] + "\nAll rights reserved.") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.family for r in licences.by_document(docs, licences.fit(docs)).collect()}
    assert {i: got[i] for i in notices} == {i: f for i, (_, f) in notices.items()}
    assert all(got[3_000 + i] == "proprietary" for i in range(50))
    assert sum(got[i] is not None for i in range(1_500)) <= 5


# reputation

def test_rules_hosts_and_paths(spark):
    urls = ["http://Www.Example.COM/en/a?x#y", "https://example.com/en/", "http://a.net/es/1", "http://net/fr/", "http://a.com", "http://a.com/", "nothing", None, "x://h?q/en/", "", "http://u.example.com:80/en/b", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "host string, good boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.judge(pages, none).collect()}
    assert got == {
        0: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 1: ("example.com", "/en/", "example.com/en/", "block"), 2: ("a.net", "/es/1", "net/es/", "block"),
        3: ("net", "/fr/", "net/fr/", "block"), 4: ("a.com", "", None, "allow"), 5: ("a.com", "/", "com/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("h", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("u.example.com:80", "/en/b", None, "allow"), 11: ("b:", "//c/d", None, "allow")}
    assert reputation.judge(pages.limit(0), none).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(["bad.a.org", "good.a.org", "new.a.org", "one.a.org", "x.b.co.uk"])], "page_id long, url string")
    seen = [("bad.a.org", i % 20 == 0) for i in range(200)] + [("good.a.org", i % 20 != 0) for i in range(200)] + [("one.a.org", False)] + [("x.b.co.uk", None)]
    got = {r.host: r for r in reputation.judge(pages, spark.createDataFrame(seen, "host string, good boolean"), rules=[]).collect()}
    assert got["bad.a.org"].verdict == "block" and {got[h].verdict for h in ("good.a.org", "new.a.org", "one.a.org", "x.b.co.uk")} == {"allow"}
    assert got["one.a.org"].good_rate > 0.2 and got["new.a.org"].labelled == 0
    assert got["new.a.org"].good_upper > got["new.a.org"].good_rate


# mixing

def fill(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not above:
            return out | {s: level * w[s] for s in open_}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(["w"] * int(rng.expovariate(1 / 40))), rng.choice(["a"] * 8 + ["b", "c", "é", None])) for i in range(1500)]
    docs += [(9001, None, "a"), (9002, "", "only empty"), (9003, "two\x0bwords", "z"), (9003, "two\x0bwords", "z")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, source string, size int")
    rows = mixing.plan(df).collect()
    assert len(rows) == len(docs)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.copies <= 2
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    want = fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and {r.source_size for r in rows if r.source == s} == {sizes[s]}
        assert abs(taken[s] - target[s]) <= 0.05 * sizes[s] + 300 if sizes[s] > 50 else True
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(df.repartition(5)).collect()))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in rows)
    copies = {r.doc_id: r.copies for r in rows if r.doc_id != 9003}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect() if r.doc_id != 9003} == {d: c for d, c in copies.items() if c}


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], empty.schema)
    assert {(r.target, r.copies) for r in mixing.plan(blank).collect()} == {(0.0, 0)}


# shards

def test_shards_are_contiguous_and_balanced(spark):
    rng = random.Random(6)
    texts = ["é" * rng.randrange(400) for _ in range(700)] + ["same text"] * 400 + [None, "", ""]
    docs = spark.createDataFrame([(i // 2 if i < 20 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    rows = sharding.assign(docs).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    assert set(by) == set(range(16))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / 16) <= largest
    crc = {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts}
    assert {(r.size, r.text_crc32) for r in rows} == crc
    key = lambda r: (r.doc_id, r.size, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, sharding.assign(docs.repartition(3)).collect()))
    assert sharding.assign(docs.limit(0)).count() == 0
    assert {r.shard for r in sharding.assign(docs.limit(1)).collect()} <= set(range(16))


# fingerprints

def brute_winnow(text, k=winnowing.K, w=winnowing.W):
    if not text:
        return [], []
    k = min(k, len(text))
    h = [int(winnowing.kgram_hashes(text[i: i + k], k)[0]) for i in range(len(text) - k + 1)]
    w, chosen = min(w, len(h)), []
    for i in range(len(h) - w + 1):
        low = min(h[i: i + w])
        at = max(j for j in range(i, i + w) if h[j] == low)
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return [h[i] for i in chosen], chosen


TEXTS = ["", None, "a", "ab" * 7, "ab" * 200, "the quick brown fox jumps over the lazy dog " * 5, "é漢😀" * 40, "x" * 17]


@pytest.mark.parametrize("k,w", [(winnowing.K, winnowing.W), (5, 3), (7, 10)])
def test_winnow_is_the_rightmost_minimum(k, w):
    for t in TEXTS:
        hashes, at = winnowing.winnow(t, k, w)
        assert (hashes.tolist(), at.tolist()) == brute_winnow(t, k, w)


def test_shared_runs_share_a_hash():
    rng = random.Random(1)
    run = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.K + winnowing.W - 1))
    for _ in range(50):
        a, b = ("".join(rng.choice("stuvwx") for _ in range(rng.randrange(80))) + run + "".join(rng.choice("yz") for _ in range(30)) for _ in range(2))
        assert np.intersect1d(winnowing.winnow(a)[0], winnowing.winnow(b)[0]).size


def test_edited_neighbours(spark):
    rng = random.Random(9)
    texts = [("".join(rng.choice("abcdé \n") for _ in range(rng.randrange(300))) or None) for _ in range(120)] + TEXTS
    docs = spark.createDataFrame([(3 * i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(7)
    got = {r.doc_id: r for r in winnowing.edited_likeness(docs).collect()}
    assert len(got) == len(texts)
    sets = [set(brute_winnow(t)[0]) for t in texts]
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        n = len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        r = got[3 * i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(dice(sets[i], set(brute_winnow(edited)[0])))
        assert r.near_next == pytest.approx(dice(sets[i], sets[(i + 1) % len(texts)]))
    by_text = defaultdict(set)
    for i, t in enumerate(texts):
        by_text[t or ""].add(got[3 * i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert winnowing.edited_likeness(docs.limit(0)).count() == 0
    one = winnowing.edited_likeness(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    with_f = winnowing.fingerprints(docs)
    assert all(r.hashes == [int(x) for x in winnowing.winnow(r.text)[0].view(np.int64)] for r in with_f.collect())


def test_shards_are_written_whole(spark, tmp_path):
    """Repeated doc_ids, repeated rows, nulls and a column named shard: every row once, in order of the slots."""
    rows = [(i // 2, f"text {i % 7} " * (i % 5), f"x{i}", i) for i in range(100)] + [(None, None, None, 1), (None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string, shard int")
    sharding.write(docs, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    want = {r["shard"]: r["count"] for r in sharding.assign(docs, 4).groupBy("shard").count().collect()}
    assert {r["_shard"]: r["count"] for r in back.groupBy("_shard").count().collect()} == want


def test_mix_with_clashing_names_and_repeated_ids(spark):
    rows = [(1, "a b c", "s", 1, 2, 3), (1, "d e f", "s", 4, 5, 6), (1, "d e f", "s", 4, 5, 6), (2, "g", None, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _d int, size int, times int")
    one = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert set(one) <= set(rows) and one
    for n in (1, 5):
        assert sorted(map(tuple, mixing.mix(docs.repartition(n, "text")).collect()), key=repr) == one


def test_fingerprints_keep_a_column_named_f(spark):
    docs = spark.createDataFrame([(1, "some text that is long enough to have fingerprints", 5)], "doc_id long, text string, _f int")
    out = winnowing.fingerprints(docs)
    assert out.columns == ["doc_id", "text", "_f", "hashes", "positions"] and out.first()["_f"] == 5
