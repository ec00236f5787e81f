"""Source divergence audit by chunk factorisation.

How far apart are the sources of a language in the words they use, and which
words set a source off?  Words are runs of letters (``TERM``); a language keeps
those that stand in at least ``min_docs`` of its documents.

* **Chunks.**  A task counts the whitespace chunks of each document and sums
  them per (language, source) over a slice of documents.  Chunks are dealt to
  buckets by their hash, one row of arrays per slice and bucket, so a chunk that
  every document holds travels once per slice.
* **Terms.**  A bucket's owner sees every distinct chunk of its bucket once and
  cuts it into terms once, however often it occurs, and joins the terms back to
  the chunk's counts.
* **Distinct documents.**  A term's documents are the union over its chunks
  ("Word", "word,").  A chunk held by ``min_docs`` documents settles its terms;
  chunks held by fewer carry their documents, so the union is exact wherever it
  decides and no list is longer than ``min_docs``.
* **Divergence.**  Smoothed shares p = 1 + floor(10^9 (n + 5) / (N + 5 V)) are
  whole numbers; sums of their differences are exact and have no order.

Null text, language and source count as ''.  A text without terms still makes
its (language, source) a group.  Repeated rows count as often as they stand in
the table.  Texts are taken whole; one that is longer than ``SLICE_BYTES`` is a
slice of its own.  An empty table gives no rows.  Other columns are ignored.
Ties in value go by the item's UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clarion.llm.common import parts, stored

#: A term: letters of ASCII and everything beyond it.
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
MIN_DOCS, SMOOTH, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Bytes of text whose chunks are counted at a time, and entries that an owner holds before it sums them.
SLICE_BYTES, HELD = 8_000_000, 1_000_000
#: Sources whose differences to all others are summed at a time.
BLOCK = 256

_BUNDLE = "bucket int, langs array<string>, sources array<string>, chunks array<string>, at array<int>, grp array<int>, n array<int>, d array<int>, docs array<long>"
_TERMS = "lang string, term string, times int, d long, docs array<long>, sources array<string>, n array<long>"


def _lists(ends: np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def count_chunks(part: pa.RecordBatch, first: int, buckets: int, few: int) -> pa.RecordBatch | None:
    """One row per bucket with the chunk counts of a slice of documents; ``first`` numbers its first document."""
    groups = list(zip(part.column("lang").to_pylist(), part.column("source").to_pylist()))
    named = sorted(set(groups))
    number = {g: i for i, g in enumerate(named)}
    of_doc = np.array([number[g] for g in groups], np.int64)
    lang_of = np.unique([g[0] for g in named], return_inverse=True)[1]

    lists = pc.ascii_split_whitespace(part.column("text"))
    words, doc = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)  # blanks at the ends leave empty strings
    words, doc = words.filter(full), doc.filter(full).to_numpy()
    if not len(words):
        return None
    coded = words.dictionary_encode()
    bucket = (pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False)) % buckets).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    place = np.empty(len(bucket), np.int64)
    place[by_bucket] = np.arange(len(bucket))

    by_group = np.argsort(of_doc, kind="stable")  # documents of a group stand together
    rank = np.empty(len(groups), np.int64)
    rank[by_group] = np.arange(len(groups))
    pairs, times = np.unique(place[coded.indices.to_numpy()] * len(groups) + rank[doc], return_counts=True)
    chunk, doc = pairs // len(groups), by_group[pairs % len(groups)]
    group = of_doc[doc]
    entry = _starts(chunk, group)
    e_chunk, e_group = chunk[entry], group[entry]
    n, d = np.add.reduceat(times, entry), np.diff(np.append(entry, len(chunk)))
    span = _starts(chunk, lang_of[group])  # documents of the chunk in one language
    listed = np.repeat(np.diff(np.append(span, len(chunk))) < few, np.diff(np.append(span, len(chunk))))

    sorted_bucket = bucket[by_bucket]
    first_chunk = _starts(sorted_bucket)
    ends = np.append(first_chunk, len(bucket))
    cut = np.searchsorted(e_chunk, ends)
    doc_cut = np.concatenate([[0], np.cumsum(listed)])[np.searchsorted(chunk, ends)]
    rows = len(first_chunk)
    same = lambda names: _lists(np.arange(rows + 1) * len(names), pa.array(names * rows, pa.string()))
    ints = lambda x: pa.array(x, pa.int32())
    return pa.RecordBatch.from_arrays([
        ints(sorted_bucket[first_chunk]), same([g[0] for g in named]), same([g[1] for g in named]),
        _lists(ends, coded.dictionary.take(pa.array(by_bucket)).cast(pa.string())),
        _lists(cut, ints(e_chunk - np.repeat(first_chunk, np.diff(cut)))), _lists(cut, ints(e_group)), _lists(cut, ints(n)), _lists(cut, ints(d)),
        _lists(doc_cut, pa.array(first + doc[listed], pa.int64()))], schema=_schema(_BUNDLE))


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split(" ") for f in text.split(", ")]
    return pa.schema([(n, pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k]) for n, k in fields])


def _counter(buckets: int, few: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for part in parts(batches, "text", SLICE_BYTES):
            if (out := count_chunks(part, first, buckets, few)) is not None:
                yield out
            first += part.num_rows
    return run


def terms_of(chunk: str) -> dict[str, int]:
    """The terms of a chunk and how often it holds them; only A-Z are lower-cased."""
    return Counter(TERM.findall(chunk.encode().lower().decode()))


class _Bucket:
    """The chunks of one bucket: counts per group, and the documents of those held by few."""

    def __init__(self, few: int):
        self.few, self.chunks, self.groups, self.langs = few, {}, {}, {}
        self.entries: list[np.ndarray] = []  # rows: chunk, group, n, d
        self.docs: list[np.ndarray] = []  # rows: chunk, language, document
        self.held = 0

    def add(self, langs: list, sources: list, chunks: list, at: np.ndarray, grp: np.ndarray, n: np.ndarray, d: np.ndarray, docs: np.ndarray) -> None:
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)], np.int64)
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        chunk = np.array([self.chunks.setdefault(c, len(self.chunks)) for c in chunks], np.int64)[at]
        self.entries.append(np.stack([chunk, group[grp], n, d]))
        span = _starts(at, lang[grp])
        listed = np.add.reduceat(d, span) < self.few
        held = np.repeat(listed, np.diff(np.append(span, len(at))))
        self.docs.append(np.stack([np.repeat(chunk[held], d[held]), np.repeat(lang[grp][held], d[held]), docs]))
        self.held += len(at) + len(docs)
        if self.held > HELD:
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries by (chunk, language, group), where a (chunk, language) begins, its documents' number, and the documents of those held by few."""
        lang_of = np.array([self.langs[g[0]] for g in self.groups], np.int64)
        e = np.concatenate(self.entries, axis=1)
        e = e[:, np.lexsort((e[1], lang_of[e[1]], e[0]))]
        first = _starts(e[0], e[1])
        e = np.stack([e[0][first], e[1][first], np.add.reduceat(e[2], first), np.add.reduceat(e[3], first)])
        span = _starts(e[0], lang_of[e[1]])
        d = np.add.reduceat(e[3], span)
        docs = np.concatenate(self.docs, axis=1)
        docs = docs[:, np.lexsort((docs[2], docs[1], docs[0]))]
        key, few = e[0][span] * len(self.langs) + lang_of[e[1]][span], d < self.few
        docs = docs[:, np.isin(docs[0] * len(self.langs) + docs[1], key[few])]
        self.entries, self.docs = [e], [docs]
        self.held = 0 if e.shape[1] + docs.shape[1] > HELD // 2 else e.shape[1] + docs.shape[1]
        return e, span, d, docs

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The terms of every chunk, joined to its counts."""
        e, span, d, docs = self.sum()
        names = list(self.groups)
        of = e[0][span]
        cut = [terms_of(c) for c in self.chunks]
        each = np.array([len(c) for c in cut], np.int64)
        first = np.concatenate([[0], np.cumsum(each)])[:-1]
        flat = pa.array([t for c in cut for t in c], pa.string())
        times = np.array([k for c in cut for k in c.values()], np.int32)
        ends = np.append(span, e.shape[1])
        doc_ends = np.concatenate([[0], np.cumsum(np.where(d < self.few, d, 0))])
        lang = pa.array([names[g][0] for g in e[1][span]], pa.string())
        wide = [_lists(doc_ends, pa.array(docs[2], pa.int64())),
                _lists(ends, pa.array([names[g][1] for g in e[1]], pa.string())), _lists(ends, pa.array(e[2], pa.int64()))]
        for at in range(0, len(of), 20_000):
            own = np.arange(at, min(at + 20_000, len(of)))
            row = np.repeat(own, each[of[own]])
            term = np.repeat(first[of[own]] - np.concatenate([[0], np.cumsum(each[of[own]])])[:-1], each[of[own]]) + np.arange(len(row))
            if len(row):
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(row)), flat.take(pa.array(term)), pa.array(times[term], pa.int32()), pa.array(d[row], pa.int64()),
                                                  *[w.take(pa.array(row)) for w in wide]], schema=_schema(_TERMS))


def _owner(few: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, bucket = None, None
        for b in batches:
            for i, no in enumerate(b.column("bucket").to_pylist()):
                if no != here:
                    if bucket:
                        yield from bucket.rows()
                    here, bucket = no, _Bucket(few)
                one = {n: b.column(n)[i].values for n in b.schema.names[1:]}
                bucket.add(*(one[n].to_pylist() for n in ("langs", "sources", "chunks")),
                           *(one[n].to_numpy().astype(np.int64) for n in ("at", "grp", "n", "d", "docs")))
        if bucket:
            yield from bucket.rows()
    return run


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n: occurrences of each kept term in each group that has it."""
    spark = docs.sparkSession
    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = read.mapInArrow(_counter(buckets, min_docs), _BUNDLE).repartition("bucket").sortWithinPartitions("bucket")
    by_term = dealt.mapInArrow(_owner(min_docs), _TERMS).groupBy("lang", "term").agg(
        F.max("d").alias("most"), F.flatten(F.collect_list("docs")).alias("docs"), F.collect_list(F.struct("times", "sources", "n")).alias("parts"))
    kept = by_term.where((F.col("most") >= min_docs) | (F.size(F.array_distinct("docs")) >= min_docs))
    each = kept.select("lang", "term", F.explode("parts").alias("p")).select(
        "lang", "term", "p.times", F.explode(F.arrays_zip("p.sources", "p.n")).alias("e"))
    return each.groupBy("lang", "term", F.col("e.sources").alias("source")).agg(F.sum(F.col("times") * F.col("e.n")).alias("n"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + SMOOTH) / (total + SMOOTH terms)), in whole numbers."""
    big = (n + F.lit(SMOOTH)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", big, (total + F.lit(SMOOTH) * terms).cast("decimal(20,0)")) + F.lit(1)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of |p[a] - p[b]| over rows (lang, block, p): for each source a of the block an array over all b.

    Rows come in order of language and block; one block's sums are held."""
    here, sums = None, None

    def out():
        first = here[1] * BLOCK
        return pa.RecordBatch.from_arrays([pa.array([here[0]] * len(sums), pa.string()), pa.array(range(first, first + len(sums)), pa.int32()),
                                           pa.array(list(sums), pa.list_(pa.int64()))], names=["lang", "a", "f"])
    for b in batches:
        langs, blocks = b.column("lang").to_pylist(), b.column("block").to_pylist()
        key = list(zip(langs, blocks))
        starts = [i for i in range(len(key)) if not i or key[i] != key[i - 1]] + [len(key)]
        for i, j in zip(starts, starts[1:]):
            rows = b.column("p").slice(i, j - i)
            p = rows.flatten().to_numpy().reshape(j - i, -1)
            if key[i] != here:
                if here:
                    yield out()
                here, sums = key[i], np.zeros((min(BLOCK, p.shape[1] - key[i][1] * BLOCK), p.shape[1]), np.int64)
            for a in range(len(sums)):
                sums[a] += np.abs(p - p[:, [here[1] * BLOCK + a]]).sum(axis=0)
    if here:
        yield out()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: for each other source of the language the sum of |p - q| over
    the kept terms, all ranks.  Part ``term``: kept terms that the source uses
    more than its language does, by p - q, the first ``top``.
    """
    counts = stored(term_counts(docs, min_docs), "term-counts")
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    zero = F.lit(0).cast("long")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    langs = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("total_lang"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("lang").orderBy("source")
    groups = stored(groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").select(
        "lang", "source", (F.row_number().over(order) - 1).alias("i"), F.coalesce("terms", zero).alias("terms"),
        F.coalesce("total_lang", zero).alias("total_lang"), F.coalesce("total", zero).alias("total")), "groups")

    rows = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    # the share of a term that the group lacks, for all groups of a language in order
    lacking = groups.where("terms > 0").groupBy("lang").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", share(zero, F.col("total"), F.col("terms")).alias("p")))), lambda x: x["p"]).alias("p0"))
    dense = rows.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("i", "p"))).alias("has")).join(lacking, "lang").select(
        "lang", "term", F.transform("p0", lambda x, i: F.coalesce(F.col("has")[i], x)).alias("p"))
    blocks = dense.select("lang", "p", F.explode(F.sequence(F.lit(0), ((F.size("p") - 1) / BLOCK).cast("int"))).alias("block"))
    sums = blocks.sortWithinPartitions("lang", "block").mapInArrow(_differences, "lang string, a int, f array<long>")
    sums = sums.select("lang", "a", F.posexplode("f").alias("b", "f")).groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))
    one, other = (groups.select("lang", F.col("source").alias(s), F.col("i").alias(i)) for s, i in (("source", "a"), ("item", "b")))
    pairs = one.join(other, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", zero).alias("value"))

    terms = rows.join(of_lang, ["lang", "term"]).withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
