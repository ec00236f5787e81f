"""MinHash near-duplicate detection with circulant permutations.

A document's set holds the distinct word shingles of its whole text.  A first
permutation scatters the shingles over ``UNIVERSE`` places; coordinate ``k`` of
the signature is the smallest value that a second permutation, circularly
shifted by ``k``, gives to an occupied place.  So two permutations make all
coordinates, and a shingle's values for all of them lie side by side in one
table.  ``BANDS`` bands of ``ROWS`` coordinates put documents into groups; at a
similarity of 0.8 a pair misses all of them with probability 3e-6.

Documents with equal sets form one class with one representative, so copies
never meet in a group.  Links are confirmed on full sets (64-bit shingle
hashes).  A group's members are not all paired: ``STARS`` times each is compared
with a pivot of the group, the links are contracted to components, and only
groups that still hold several components go on.  These meet one more pivot, the
member whose shingles are held most widely.  For the rest, exactly:

* A shingle that no other remaining document holds cannot be shared.  With c
  of a document's n shingles left, a partner of m shingles is in reach only if
  c >= t (n + m - c); members that reach nobody in their group leave it.  Most
  edited copies that miss the threshold fall out here.
* Groups of over ``SMALL`` members fall into groups by prefix shingles: in any
  fixed order (here: rarest first), two sets with a similarity of t share one of
  their first n - ceil(t n) + 1 shingles, so no link is lost, and frequent
  passages come last.  Only shingles behind the shared one can be shared
  besides, so a pair whose places are too late is left out.
* In each group, members outside its largest component are compared with the
  members of other components that are in reach.

Null and empty texts have no shingles and link with nothing; fewer words than a
shingle make one shingle of all of them.  Rows that repeat a doc_id get the same
answer; a null doc_id takes part only as a copy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clarion.llm.common import SHINGLE_WORDS, SIMILARITY, parts, stored, tidy

BANDS, ROWS = 32, 5
UNIVERSE, SEED = 1 << 22, 20_250_101
SMALL, STARS = 32, 3
#: Groups of the pivots: bands with equal number modulo this share their choice.
PIVOTS = 3
_WORDS_HELD = 150_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six blanks
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j: len(h) - n + 1 + j])
    return np.unique(out)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and for each place the second one's values under all shifts."""
    rng = np.random.default_rng(SEED)
    scatter, ring = np.arange(UNIVERSE, dtype=np.int32), np.arange(UNIVERSE, dtype=np.int32)
    rng.shuffle(scatter)
    rng.shuffle(ring)
    k = BANDS * ROWS
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: k - 1]]), k)


def signature(hashes: np.ndarray) -> np.ndarray:
    scatter, shifted = _tables()
    places = scatter[(hashes & np.uint64(UNIVERSE - 1)).astype(np.intp)]
    out = np.full(BANDS * ROWS, UNIVERSE, np.int32)
    for at in range(0, len(places), 1024):
        np.minimum(out, shifted[places[at: at + 1024]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows, key = sig.reshape(BANDS, ROWS).astype(np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            n, keys, bands = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.string()),
                                              pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "class", "bands"])
        _HASHES.clear()
        _tables.cache_clear()
        tidy()
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([shingles(t, words).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["rep", "hashes"])
        _HASHES.clear()
        tidy()
    return run


def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b):
        both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
        both.sort()
        out.append(int((both[1:] == both[:-1]).sum()))
    return pa.array(out, pa.int64())


def _linked(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * shared >= F.lit(percent) * (a + b - shared)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda n: sets.select(F.col("rep").alias(n), F.col("hashes").alias(f"h{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = both.select("a", "b", (F.length("ha") / 8).cast("long").alias("na"), (F.length("hb") / 8).cast("long").alias("nb"), F.arrow_udf(_shared, "long")("ha", "hb").alias("s"))
    return shared.where(_linked(F.col("s"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``v`` and its component's smallest vertex ``root``, for all vertices of ``edges`` (a, b) but the roots.

    Large-star and small-star steps; every step keeps one row per edge and no
    vertex's neighbours are gathered.  Done when every vertex hangs on one root.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    # written at once: every step reads it several times
    star = stored(edges.where("a <> b").select(most.alias("u"), least.alias("v")).distinct(), "near-edges")
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "near-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        star = stored(small.where("u <> v").distinct(), "near-stars")
        ends = star.select("u", F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(star.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("low")))
        ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
        if not ends.agg(F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("low") == 1)))).first()[0]:
            return star.select(F.col("u").alias("v"), F.col("v").alias("root"))


def _sizes_fit(percent: int) -> Column:
    return (F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))


def _several(groups: DataFrame) -> DataFrame:
    """Members of the groups that hold more than one component."""
    open_ = groups.groupBy("g").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("g")
    return groups.join(open_, "g", "left_semi")


def _contract(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their component, in groups that still hold more than one."""
    known = roots.withColumnRenamed("v", "rep")
    return _several(groups.drop("root").join(known, "rep", "left").withColumn("root", F.coalesce("root", "rep")))


def _star(groups: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """Each member with its group's pivot, the first by ``order``, and the groups without their pivots."""
    pivots = groups.groupBy("g").agg(F.min(F.struct(order.alias("o"), "rep", "n")).alias("p")).select("g", F.col("p.rep").alias("b"), F.col("p.n").alias("nb"))
    met = groups.join(pivots, "g").where("rep <> b")
    return met.select(F.col("rep").alias("a"), F.col("n").alias("na"), "b", "nb"), met.select(*groups.columns)


def _in_reach(c: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether a set of n shingles, c of which others hold, can be similar enough to one of m."""
    return F.lit(100) * c >= F.lit(percent) * (n + m - c)


def _held(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """The members' shingles that another member of any group holds too, with the number of holders."""
    words = sets.join(groups.select("rep").distinct(), "rep", "left_semi").select("rep", (F.length("hashes") / 8).cast("long").alias("n"), F.explode(F.arrow_udf(_as_longs, "array<long>")("hashes")).alias("s"))
    words = stored(words, "near-words")
    return stored(words.join(words.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "s"), "near-held")


def _with_holders(groups: DataFrame, held: DataFrame) -> DataFrame:
    """The members with ``c``, their number of held shingles, and ``typical``, how widely these are held; each is joined once."""
    holders = held.groupBy("rep").agg((F.sum("df") / F.first("n")).alias("typical"), F.count(F.lit(1)).alias("c"))
    return stored(groups.join(holders, "rep"), "near-open")  # without a shared shingle there is no partner


def _most_typical(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A star around each group's member with the most widely held shingles: most likely what the others are edits of."""
    pairs, rest = _star(groups, F.struct(-F.col("typical"), F.xxhash64("rep")))
    return pairs, rest.drop("typical")


def _largest(groups: DataFrame) -> DataFrame:
    """Each group's component with the most members, as ``main``."""
    sizes = groups.groupBy("g", "root").agg(F.count(F.lit(1)).alias("k"))
    return sizes.groupBy("g").agg(F.max(F.struct("k", "root")).alias("main")).select("g", F.col("main.root").alias("main"))


def _remaining(groups: DataFrame, held: DataFrame, percent: int, small: int) -> DataFrame:
    """The pairs of members that pivots have not settled and that are in each other's reach."""
    smallest = groups.groupBy("g").agg(F.min("n").alias("_m"))
    members = groups.join(smallest, "g").where(_in_reach(F.col("c"), F.col("n"), F.greatest("_m", F.ceil(F.col("n") * percent / 100)), percent)).drop("_m")
    members = stored(_several(members), "near-members")
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("members"))
    narrow = members.join(sizes.where(F.col("members") <= small), "g", "left_semi").select("g", "rep", "n", "c", "root", F.lit(1).alias("place"))
    # large groups by prefix shingle, across groups; unshared shingles come first in the order and take their places
    many = members.join(sizes.where(F.col("members") > small), "g", "left_semi")
    large = many.select("rep", "n", "c", "root").distinct()
    unshared = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("rep"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "s")) + unshared
    head = held.select("rep", "s", "n", place.alias("place")).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1)
    head = stored(head.drop("n"), "near-prefixes")
    # one of any two components in a group is not its largest, so only prefix shingles of members outside the largest count
    outside = many.join(_largest(many), "g").where("root <> main").select("rep").distinct()
    wanted = head.join(outside, "rep", "left_semi").select("s").distinct()
    head = head.join(wanted, "s", "left_semi").join(large, "rep")
    split = stored(head.select(F.xxhash64(F.lit("prefix"), "s").alias("g"), "rep", "n", "c", "root", "place"), "near-split")
    parts = stored(narrow.unionByName(_several(split)), "near-parts")
    one = parts.join(_largest(parts), "g").where("root <> main").select("g", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("root").alias("ra"), F.col("place").alias("pa"))
    two = parts.select("g", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("root").alias("rb"), F.col("place").alias("pb"))
    # the first shingle that a pair shares has all others of both sets behind it
    most = F.least("ca", "cb", F.col("na") - F.col("pa") + 1, F.col("nb") - F.col("pb") + 1)
    return one.join(two, "g").where(F.col("ra") != F.col("rb")).where(_in_reach(most, F.col("na"), F.col("nb"), percent))


def _as_longs(b: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(x.as_buffer(), np.int64) for x in b], pa.list_(pa.int64()))


def near_components(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    return _components_of(docs, words, similarity, small).drop("text_hash")


def _components_of(docs: DataFrame, words: int, similarity: float, small: int = SMALL) -> DataFrame:
    percent = math.ceil(round(similarity * 100, 6))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketch(words), "doc_id long, text_hash long, n_shingles long, class string, bands array<long>"), "near-sketch")
    classes = stored(sketch.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "near-classes")
    banded = classes.where(F.col("rep").isNotNull()).select("rep", "n", F.posexplode("bands").alias("pick", "g")).withColumn("pick", F.col("pick") % PIVOTS)
    shared = banded.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("g")
    groups = stored(banded.join(shared, "g", "left_semi").withColumn("root", F.col("rep")), "near-groups")
    wanted = groups.select("rep").distinct()
    text = rows.where(F.col("doc_id").isNotNull()).join(wanted, rows["doc_id"] == wanted["rep"], "left_semi").select(F.col("doc_id").alias("rep"), "text")
    sets = stored(text.mapInArrow(_sets(words), "rep long, hashes binary").dropDuplicates(["rep"]), "near-sets")

    edges = None

    def link(pairs: DataFrame) -> DataFrame:
        """The components with the links among ``pairs`` added, as one row per linked class."""
        pairs = stored(pairs.where(_sizes_fit(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
        found = confirm(pairs, sets, percent)
        return components(found if edges is None else found.unionByName(edges.select(F.col("v").alias("a"), F.col("root").alias("b"))))

    for salt in range(STARS):
        if groups.isEmpty():
            break
        pairs, rest = _star(groups, F.xxhash64("rep", F.col("pick"), F.lit(salt)))
        edges = link(pairs)
        groups = stored(_contract(rest, edges), "near-groups")
    if not groups.isEmpty():
        held = _held(groups, sets)
        pairs, rest = _most_typical(_with_holders(groups, held))
        edges = link(pairs)
        groups = stored(_contract(rest, edges), "near-groups")
        if not groups.isEmpty():
            edges = link(_remaining(groups, held, percent, small))

    if edges is None:
        classes = classes.withColumn("component_id", F.col("rep"))
    else:
        classes = classes.join(edges.select(F.col("v").alias("rep"), F.col("root").alias("_root")), "rep", "left").withColumn("component_id", F.coalesce("_root", "rep"))
    out = sketch.select("doc_id", "text_hash", "n_shingles", "class").join(classes.select("class", "component_id"), "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, whole: the smallest doc_id of each group of near-duplicates."""
    stay = _components_of(docs, words, similarity).where("kept").select(F.col("doc_id").alias("_stay"), F.col("text_hash").alias("_text")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stay"]) & (F.xxhash64(docs["text"]) == stay["_text"]), "left_semi")
