"""Exact, near and substring de-duplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from clarion.llm import exact_dedup, minhash, passages

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu", "xi", "omi", "pi", "rho", "sig", "tau", "ups"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") + rng.choice("stuvw") for _ in range(n))


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string")


# exact

def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    return {(d, min(g)[3], len(g), d == min(g)[3], hashlib.sha256(b.encode()).hexdigest()) for b, g in groups.items() for _, _, _, d in g}


EXACT = ["a b", "ab", "a\tb \n", None, "", " \x0b", "é b", "éb", "x" * 50_000, "x" * 50_000, "A b", "a b"]


@pytest.mark.parametrize("bucket_keys", [1, 2_000])
def test_exact_groups(spark, bucket_keys):
    docs = frame(spark, EXACT * 3)
    got = {tuple(r) for r in exact_dedup.dedup(docs, bucket_keys).collect()}
    assert got == brute_exact([(i, t) for i, t in enumerate(EXACT * 3)])


def test_exact_chains_keep_colliding_keys_apart(spark):
    weak = lambda body: len(body) % 2
    docs = frame(spark, EXACT * 2)
    got = {tuple(r) for r in exact_dedup.dedup(docs, 1, weak).collect()}
    assert got == brute_exact([(i, t) for i, t in enumerate(EXACT * 2)])


def test_exact_null_and_repeated_ids(spark):
    docs = frame(spark, ["a", "a", "b", "b", "c"], [None, 3, 5, 5, None])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs).collect()), key=str)
    assert got == sorted([(None, 3, 2, False), (3, 3, 2, True), (5, 5, 2, True), (5, 5, 2, True), (None, None, 1, True)], key=str)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(3, "a"), (5, "b")]
    assert kept.where("doc_id is null").count() == 1
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def test_directory_splits_overfull_buckets():
    loads = np.zeros(1 << exact_dedup.MOST_DEPTH, np.int64)
    loads[:8], loads[40_000] = 100, 5
    directory = exact_dedup.build_directory(loads, 150)
    assert len(directory) == len(loads)
    for b in np.unique(directory):
        assert loads[directory == b].sum() <= 150 or (directory == b).sum() == 1
    assert np.all(np.diff(directory) >= 0)
    assert len(np.unique(exact_dedup.build_directory(loads, 10_000))) == 1


# near

def brute_near(texts, words, percent=80):
    def shingle_set(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i: i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def near_texts():
    rng = random.Random(5)
    base = prose(rng, 120).split(" ")
    texts = [None, "", " \n", "One two", "one TWO", "one two three four", "One two three four"]
    for _ in range(40):  # edited copies: many are close to the base but not to each other
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10 ** 6))
        texts.append(" ".join(w))
    line = prose(rng, 60)
    texts += [line + " " + prose(rng, 50) for _ in range(25)]  # share a passage, but are no near copies
    texts += [prose(rng, 80) for _ in range(20)] + ["É é ß " + prose(rng, 30)] * 2
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("words,small", [(4, minhash.SMALL), (5, 2)])
def test_near_components(spark, words, small):
    texts = near_texts()
    got = {tuple(r) for r in minhash.near_components(frame(spark, texts), words, 0.8, small).collect()}
    assert got == brute_near(texts, words)


def test_near_components_of_many_edits_at_shared_places(spark):
    """Edits that several copies share are no proof of a link, and groups stay large after the pivots."""
    rng = random.Random(11)
    base = prose(rng, 110).split(" ")
    texts = []
    for _ in range(110):
        gone = set(rng.sample(range(0, 110, 7), rng.randrange(9)))
        w = [x for k, x in enumerate(base) if k not in gone]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(3))
        texts.append(" ".join(w))
    got = {tuple(r) for r in minhash.near_components(frame(spark, texts), 4, 0.8, 2).collect()}
    assert got == brute_near(texts, 4)


def test_near_edges(spark):
    docs = frame(spark, ["a b c d e", "a b c d e", "x y z q r", None], [None, 4, 7, None])
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_components(docs).collect()), key=str)
    assert rows == sorted([(None, 1, 4, False), (4, 1, 4, True), (7, 1, 7, True), (None, 0, None, True)], key=str)
    assert minhash.keep_one(docs).columns == docs.columns and minhash.keep_one(docs).count() == 3
    assert minhash.near_components(docs.limit(0)).count() == 0


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    a, b = np.unique(pool[:1900]), np.unique(pool[100:2000])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 1800 / 2000) < 0.1
    scatter, _ = minhash._tables()
    assert len(np.unique(scatter)) == minhash.UNIVERSE


# substring

def test_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(8)
    passage = prose(rng, 70).split(" ")
    fuzzy = list(passage)
    fuzzy[20], fuzzy[45] = "changed", "other"
    del fuzzy[33]
    texts = [prose(rng, 90) for _ in range(12)]
    texts[2] += " " + " ".join(passage) + " " + prose(rng, 30)
    texts[5] = " ".join(passage).upper() + "\n" + texts[5]
    texts[9] += "\n" + " ".join(fuzzy)
    texts += ["tick tock " * 40 + prose(rng, 20), prose(rng, 25) + " tick tock" * 40, None, "", "short"]
    got = passages.repeated(frame(spark, texts)).collect()
    assert {(r.doc_id, r.ref_id) for r in got} == {(5, 2), (9, 2), (13, 12)}
    for r in got:
        a, b = (re.findall(r"\S+", texts[i].lower()) for i in (r.doc_id, r.ref_id))
        assert r.identity >= 0.8 and r.n_words == r.end - r.start >= 50
        if r.doc_id == 5:
            assert a[r.start: r.end] == b[r.ref_start: r.ref_end] == passage
        if r.doc_id == 9:
            assert (r.start, r.end) == (90, 90 + len(fuzzy)) and r.identity < 1
    assert passages.repeated(frame(spark, texts).limit(0)).count() == 0


def test_passages_whose_parts_stand_in_earlier_documents(spark):
    rng = random.Random(21)
    passage = prose(rng, 60).split(" ")
    part = lambda a, b: " ".join([prose(rng, 40), *passage[a: b], prose(rng, 40)])
    texts = [part(0, 32), part(28, 60), part(0, 49), part(11, 60), part(15, 45), prose(rng, 90), part(0, 60), part(0, 60)]
    got = {(r.doc_id, r.ref_id, r.start, r.end, r.ref_start, r.ref_end) for r in passages.repeated(frame(spark, texts)).collect()}
    assert (7, 6, 40, 100, 40, 100) in got


def test_edited_passages_whose_halves_stand_in_earlier_documents(spark):
    rng = random.Random(22)
    texts, pairs = [], []
    for _ in range(25):
        passage = prose(rng, 60).split(" ")
        edited = list(passage)
        edited[12] = edited[40] = "changed"
        for cut in (passage[:30], passage[30:], passage, edited):
            texts.append(" ".join([prose(rng, 40), *cut, prose(rng, 40)]))
        pairs.append((len(texts) - 1, len(texts) - 2))
    got = {(r.doc_id, r.ref_id) for r in passages.repeated(frame(spark, texts)).collect()}
    assert got == set(pairs)


def test_passages_whose_seeds_stand_earlier_in_the_same_document(spark):
    rng = random.Random(25)
    passage = prose(rng, 60).split(" ")
    edited = [w if k % 9 else "changed" for k, w in enumerate(passage, 1)]
    quotes = [w for at in range(0, 60, 20) for w in passage[at: at + 23] + prose(rng, 60).split(" ")]
    texts = [" ".join([prose(rng, 40), *passage, prose(rng, 40)]),
             " ".join([*passage, prose(rng, 30), *passage, prose(rng, 30), *passage]),
             " ".join(quotes + edited)]
    got = {(r.doc_id, r.ref_id, r.start, r.end, r.ref_start, r.ref_end) for r in passages.repeated(frame(spark, texts)).collect()}
    assert {(1, 0, at, at + 60, 40, 100) for at in (0, 90, 180)} <= got
    assert any(doc == 2 and start >= len(quotes) and end - start >= 50 for doc, _, start, end, _, _ in got)


def test_matches_are_all_longest_equal_runs():
    rng = np.random.default_rng(26)
    for _ in range(200):
        a, b = (rng.integers(0, 3, rng.integers(0, 25)).astype(np.uint64) for _ in range(2))
        runs = set()
        for x in range(len(a)):
            for y in range(len(b)):
                if a[x] == b[y] and (not x or not y or a[x - 1] != b[y - 1]):
                    n = next((i for i in range(min(len(a) - x, len(b) - y)) if a[x + i] != b[y + i]), min(len(a) - x, len(b) - y))
                    runs |= {(x, y, n)} if n >= 4 else set()
        found = list(zip(*(c.tolist() for c in passages.matches(a, b))))
        assert len(found) == len(runs) and set(found) == runs
    same = np.zeros(5_000, np.uint64)
    assert len(passages.matches(same, same[:4_000])[0]) == 5_000 + 4_000 - 2 * 4 + 1  # one for each diagonal


def longest_alike(same, least=50, similarity=0.8):
    """The longest stretch between two equal words that is at least 80 % equal, by trying all."""
    return max((j - i for i in range(len(same)) for j in range(i + least, len(same) + 1) if same[i] and same[j - 1] and sum(same[i:j]) >= similarity * (j - i)), default=0)


def test_edited_passages_against_trying_all_stretches(spark):
    rng = random.Random(23)
    texts, pairs = [], []
    for trial in range(120):
        passage = prose(rng, 60).split(" ")
        every, rate = (5, 6, 7, 8)[trial % 4], (0.1, 0.15)[trial % 2]
        same = [k % every != every - 1 for k in range(60)] if trial < 60 else [rng.random() >= rate for _ in range(60)]
        for cut in (passage, [w if s else "changed" for w, s in zip(passage, same)]):
            texts.append(" ".join([prose(rng, 20), *cut, prose(rng, 20)]))
        if longest_alike(same) > 0:
            pairs.append((len(texts) - 1, len(texts) - 2))
    got = {(r.doc_id, r.ref_id) for r in passages.repeated(frame(spark, texts)).collect()}
    assert len(pairs) > 90 and got == set(pairs)


def test_stretches_are_cut_out_of_a_chain_with_a_wide_gap():
    rng = random.Random(24)
    one, two, a, b = (passages.word_hashes(prose(rng, n)) for n in (55, 60, 38, 38))
    x, y = np.r_[one, a, two], np.r_[one, b, two]
    found = passages.stretches(x, y, passages.aligned(x, y, [(0, 0, 55), (93, 93, 60)]), 50, 0.8)
    assert sorted(found) == [(0, 55, 0, 55, 1.0), (93, 153, 93, 153, 1.0)]


def test_keys_of_runs_meet_wherever_they_stand():
    words = passages.word_hashes(prose(random.Random(3), 200))
    for k in (1, 4, 5, 50):
        h = passages.runs(words, k)
        assert len(h) == 201 - k and (passages.runs(words[60:140], k) == h[60: 141 - k]).all()
    assert passages.segments(np.array([3, 4, 40]), np.array([13, 14, 50]), np.array([50, 50, 5])) == [(3, 13, 51)]
    keys, at, n = passages.contexts(words)
    assert len(keys) == len(at) == len(n) > 151 and (at + n <= 200).all()


def test_fenwick_chaining_is_the_quadratic_optimum():
    rng = random.Random(2)
    for _ in range(60):
        segs = sorted({(rng.randrange(60), rng.randrange(60)): rng.randrange(3, 9) for _ in range(rng.randrange(1, 25))}.items())
        segs = [(x, y, n) for (x, y), n in segs]
        score = []
        for j, (x, y, n) in enumerate(segs):
            best = 0.0
            for i in range(j):
                xe, ye = segs[i][0] + segs[i][2], segs[i][1] + segs[i][2]
                if xe <= x and ye <= y:
                    best = max(best, score[i] - passages.GAP_COST * (x - xe + y - ye))
            score.append(n + best)
        first = passages.chains(segs, most_gap=1000)[0]
        value = sum(n for _, _, n in first) - passages.GAP_COST * sum((b[0] - a[0] - a[2]) + (b[1] - a[1] - a[2]) for a, b in zip(first, first[1:]))
        assert abs(value - max(score)) < 1e-9


def test_only_keys_that_documents_share_are_moved(spark):
    rng = random.Random(31)
    apart = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(40)]
    words = sum(len(t.split()) for t in apart)
    assert passages.moved_keys(frame(spark, apart).select("doc_id", "text"), 50, 3).agg({"n": "sum"}).first()[0] is None
    passage = prose(rng, 60)
    texts = [*apart, f"{prose(rng, 30)} {passage}", f"{passage} {prose(rng, 30)}", None]
    cells = passages.moved_keys(frame(spark, texts).select("doc_id", "text"), 50, 3).collect()
    assert {d for c in cells for d in np.cumsum(passages.unpacked(c["doc_ids"])).tolist()} == {40, 41}
    assert 2 * 57 <= sum(c["n"] for c in cells) < words // 20


def test_pairs_of_moved_keys_against_all_keys(spark):
    rng = random.Random(32)
    parts = [prose(rng, 30) for _ in range(12)]
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.6 else prose(rng, 25) for _ in range(6)) for _ in range(40)] + ["tick tock " * 40] * 2
    first, want = {}, {}
    for doc, text in enumerate(texts):
        words = passages.word_hashes(text)
        h, p = passages.seeds(words)
        ch, cp, cn = passages.contexts(words)
        for key, at, n in zip([*h.tolist(), *ch.tolist()], [*p.tolist(), *cp.tolist()], [4] * len(h) + cn.tolist()):
            ref, ref_at, ref_n = first.setdefault(key, (doc, at, n))
            if ref != doc:
                a, b, c, d = want.get((doc, ref), (at, at + n, ref_at, ref_at + ref_n))
                want[doc, ref] = min(a, at), max(b, at + n), min(c, ref_at), max(d, ref_at + ref_n)
    got = {}
    links = passages.moved_keys(frame(spark, texts).select("doc_id", "text"), 50, 3).repartitionById(3, "bucket").mapInArrow(
        passages._linked, "doc_id long, ref_id long, low int, high int, ref_low int, ref_high int")
    for doc, ref, *ends in links.collect():
        a, b, c, d = got.get((doc, ref), ends)
        got[doc, ref] = min(a, ends[0]), max(b, ends[1]), min(c, ends[2]), max(d, ends[3])
    assert got == want and len(want) > 100


def test_numbers_packed_by_byte():
    for a in ([], [0], [5, 0, 255], [2**63, 1, 2**64 - 1], list(range(70_000))):
        assert passages.unpacked(passages.packed(np.array(a, np.uint64))).tolist() == a
    ids = np.array([-7, -7, 3, 2**62])
    assert np.cumsum(passages.unpacked(passages.packed(passages._steps(ids)))).view(np.int64).tolist() == ids.tolist()


def test_words_hashed_all_at_once_are_as_one_by_one():
    import xxhash

    rng = random.Random(31)
    texts = ["".join(rng.choice("abXYZé中 \t\n\x0b\x1c") for _ in range(rng.randrange(0, 300))) for _ in range(40)]
    texts += [" ".join("".join(rng.choice("abcXY9é") for _ in range(n)) for _ in range(20)) for n in range(1, 40)] + ["", " "]
    got = passages.all_word_hashes([t.encode() for t in texts])
    for text, words in zip(texts, got, strict=True):
        assert words.tolist() == [xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()]
    assert passages.all_word_hashes([]) == []


def test_stable_order_is_that_of_a_stable_sort():
    rng = np.random.default_rng(32)
    for h in (rng.integers(0, 50, 1_000), rng.integers(0, 2 ** 63, 1_000), np.repeat(rng.integers(0, 2 ** 63, 300), 3), np.zeros(1, int), np.zeros(0, int)):
        h = h.astype(np.uint64)
        assert (passages.stable_order(h) == np.argsort(h, kind="stable")).all()


def periodic(rng, n):
    """Texts of repeated words and lines, with edits."""
    words = [f"w{rng.randrange(6)}" for _ in range(9)]
    out = []
    while len(out) < n:
        out += [rng.choice(words)] * rng.randrange(1, 40) if rng.random() < 0.6 else words * rng.randrange(1, 8)
    return ["edit" if rng.random() < 0.03 else w for w in out[:n]]


def test_chains_left_out_have_no_stretch():
    rng, left_out = random.Random(33), 0
    for _ in range(60):
        a, b = (passages.word_hashes(" ".join(periodic(rng, rng.randrange(60, 400)))) for _ in range(2))
        ref = passages.Reference(b)
        found = passages.chains(passages.segments(*ref.matches(a)))
        spans = np.array([(*c[0][:2], c[-1][0] + c[-1][2], c[-1][1] + c[-1][2]) for c in found], np.int64).reshape(-1, 4)
        never = passages.hopeless(a, ref, ref.coded(a), spans, 50, 0.8)
        left_out += int(never.sum())
        for c in (c for c, n in zip(found, never) if n):
            assert not any(passages.stretches(a, b, passages.aligned(a, b, c, far), 50, 0.8) for far in (False, True))
        if ref.possible(ref.coded(a), 50, 0.8) is None:
            assert not any(passages.stretches(a, b, passages.aligned(a, b, c, far), 50, 0.8) for c in found for far in (False, True))
    assert left_out > 1_000


def test_stretches_against_trying_all():
    rng = random.Random(34)
    for _ in range(200):
        x = y = 0
        found = []
        for _ in range(rng.randrange(1, 40)):
            n = rng.randrange(1, 12)
            found.append((x, y, n))
            x, y = x + n + rng.randrange(0, 4), y + n + rng.randrange(0, 4)
        a, b = np.arange(x + 20, dtype=np.uint64), np.arange(1_000, 1_020 + y, dtype=np.uint64)  # nothing equal in the gaps
        want, open_ = [], [(0, len(found))]
        while open_:
            lo, hi = open_.pop()
            best = None
            for i in range(lo, hi):
                for j in range(i, hi):
                    wide, high = (found[j][s] + found[j][2] - found[i][s] for s in (0, 1))
                    ident = sum(n for *_, n in found[i: j + 1]) / max(wide, high)
                    if min(wide, high) >= 20 and ident >= 0.8 - 1e-9 and (best is None or wide > best[0]):
                        best = wide, i, j, ident
            if best:
                _, i, j, ident = best
                want.append((found[i][0], found[j][0] + found[j][2], found[i][1], found[j][1] + found[j][2], ident))
                open_ += [(lo, i), (j + 1, hi)]
        assert passages.stretches(a, b, found, 20, 0.8) == [pytest.approx(w) for w in want]


def test_long_periodic_texts_are_cut_in_little_time():
    """Periods of 30 and 29 words with edits: thousands of runs, none of which make one stretch of all (39 s for 5,000 words before)."""
    import time

    rng = random.Random(35)
    base = prose(rng, 30).split()
    other = [w if i % 7 else "x" + w for i, w in enumerate(base)][:29]
    a, b = (passages.word_hashes(" ".join((p * 90)[:2_500])) for p in (base, other))
    begun = time.process_time()
    list(passages._compared(a, passages.Reference(b), 50, 0.8))
    assert time.process_time() - begun < 5


def test_a_common_reference_is_met_in_parts(spark, monkeypatch):
    rng = random.Random(36)
    passage = prose(rng, 70)
    docs = frame(spark, [" ".join([prose(rng, 15), passage, prose(rng, 15)]) for _ in range(30)])
    whole = sorted(tuple(r) for r in passages.repeated(docs).collect())
    monkeypatch.setattr(passages, "PAIRS", 4)
    assert sorted(tuple(r) for r in passages.repeated(docs).collect()) == whole
    assert {r[0] for r in whole if r[3] == 0} == set(range(1, 30))


def test_equal_texts_and_those_of_changed_words_are_one_passage():
    rng = random.Random(37)
    words = prose(rng, 90).split()
    a = passages.word_hashes(" ".join(words))
    changed = passages.word_hashes(" ".join(w if i % 15 != 7 else "changed" for i, w in enumerate(words)))
    inside = np.r_[passages.word_hashes(prose(rng, 20)), changed]
    assert list(passages._compared(a, passages.Reference(a), 50, 0.8)) == [(0, 90, 0, 90, 1.0)]
    assert list(passages._compared(a, passages.Reference(inside), 50, 0.8)) == [(0, 90, 20, 110, pytest.approx(84 / 90))]
    assert list(passages._compared(a[:40], passages.Reference(a[:40]), 50, 0.8)) == []
