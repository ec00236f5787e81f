"""Document fingerprints by winnowing.

All k-grams of code points are hashed; from every window of ``w`` adjacent
hashes the smallest is chosen, the rightmost of equal ones.  The chosen hashes
with their positions are the fingerprint: any run of ``w + k - 1`` code points
that two texts share puts a common hash into both fingerprints.

A text with fewer than ``w`` k-grams has one window; one shorter than ``k`` is
hashed whole; null and empty texts have an empty fingerprint.  The likeness of
two fingerprints is twice the number of distinct hashes they share, divided by
the sum of their numbers of distinct hashes (two empty ones: 1).

``edited_likeness`` compares neighbours in doc_id order.  Rows are
range-partitioned by doc_id and streamed in order; only the first and the last
text of each partition meet in a second, small join.  Rows with the same doc_id
are ordered by their text, null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clarion.llm.common import fresh, stored

K, W = 16, 16
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def kgram_hashes(text: str, k: int) -> np.ndarray:
    """The polynomial hash of every k-gram, built from those of powers of two."""
    block = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    size, out, have = 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, have = block, size
            else:
                n = len(block) - have
                out, have = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + block[have:], have + size
        if (size << 1) > k:
            break
        block = block[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + block[size:]
        size <<= 1
    h = out[: max(0, len(text) - k + 1)]
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, by position."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = kgram_hashes(text, min(k, len(text)))
    low, at, size = h, np.arange(len(h)), 1
    w = min(w, len(h))
    while size < w:
        step = min(size, w - size)
        right = low[step:] <= low[:-step]
        low, at = np.minimum(low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return h[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct hashes."""
    total = len(a) + len(b)
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / total if total else 1.0


def name(hashes: np.ndarray, at: np.ndarray) -> str:
    """A fingerprint's digest."""
    return hashlib.sha256(hashes.astype("<u8").tobytes() + at.astype("<i8").tobytes()).hexdigest()


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """``docs`` plus ``hashes`` (array<long>) and ``positions`` (array<long>) of column text; columns of these names are replaced."""
    kind = pa.struct([("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])

    @F.arrow_udf("hashes array<long>, positions array<long>")
    def chosen(batch: pa.Array) -> pa.Array:
        both = [winnow(t, k, w) for t in batch.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([h.view(np.int64) for h, _ in both], pa.list_(pa.int64())), pa.array([p for _, p in both], pa.list_(pa.int64()))], fields=list(kind))

    f = fresh(docs, "f")
    return docs.withColumn(f, chosen(F.col("text"))).withColumn("hashes", F.col(f"{f}.hashes")).withColumn("positions", F.col(f"{f}.positions")).drop(f)


class _Doc:
    """A document with its fingerprint."""

    def __init__(self, doc_id: int | None, text: str | None, k: int, w: int):
        self.doc_id, self.text = doc_id, text or ""
        hashes, at = winnow(self.text, k, w)
        self.name, self.hashes = name(hashes, at), np.unique(hashes)

    def row(self, after: "_Doc", k: int, w: int) -> tuple:
        n = len(self.text)
        cut = n // 4
        edited = self.text[: n - cut] + after.text[:cut]
        hashes, at = winnow(edited, k, w)
        return (self.doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), self.name, name(hashes, at),
                likeness(self.hashes, np.unique(hashes)), likeness(self.hashes, after.hashes))


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_BLANK = (None,) * 7


def _along(k: int, w: int):
    """Rows of one partition in order; the first and the last text go along for the neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last = TaskContext.get().partitionId(), None

        def block(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [*_KINDS, pa.int64(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[*_NAMES, "pid", "role", "edge_id", "edge_text"])

        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                doc = _Doc(doc_id, text, k, w)
                rows.append((*last.row(doc, k, w), pid, "row", None, None) if last else (*_BLANK, pid, "head", doc_id, doc.text))
                last = doc
            if rows:
                yield block(rows)
        if last:
            yield block([(*_BLANK, pid, "tail", last.doc_id, last.text)])
    return run


def _edges(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_Doc(d, t, k, w).row(_Doc(d2, t2, k, w), k, w) for d, t, d2, t2 in zip(*(b.column(i).to_pylist() for i in range(4)))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 7, _KINDS)], names=_NAMES)
    return run


def edited_likeness(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and likenesses.

    The edited text has its last quarter (in code points, rounded down) replaced
    by as many first code points of the next document in doc_id order (the first
    follows the last).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the order ends with the text's hash, so a doc_id that repeats often does not fill a partition
    ordered = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    parts = stored(ordered.mapInArrow(_along(k, w), _ROW + ", pid long, role string, edge_id long, edge_text string"), "winnow")
    heads = parts.where("role = 'head'").select(F.col("pid").alias("hp"), F.col("edge_id").alias("next_id"), F.col("edge_text").alias("next_text"))
    tails = parts.where("role = 'tail'").select("pid", "edge_id", "edge_text")
    # one narrow row per partition
    pids, every = heads.select(F.col("hp").alias("pid")), Window.orderBy("pid")
    follows = pids.withColumn("hp", F.coalesce(F.lead("pid").over(every), F.min("pid").over(Window.partitionBy())))
    meet = tails.join(follows, "pid").join(heads, "hp").select("edge_id", "edge_text", "next_id", "next_text")
    return parts.where("role = 'row'").select(*_NAMES).unionByName(meet.mapInArrow(_edges(k, w), _ROW))
