"""Exact de-duplication with an extendible-hash index on shared files.

* A text's key is a 64-bit hash of its normalised bytes.
* The directory maps key prefixes to buckets.  It starts with one bucket; while
  a bucket holds more than ``BUCKET_KEYS`` keys it is split by one more bit,
  and the directory doubles when the bucket was at its full depth.  It has at
  most ``2 ** MOST_DEPTH`` entries, whatever the input; fuller buckets then
  keep longer chains, which are streamed.
* Writers (one per input split) collapse the copies in each batch, so a text
  that fills a third of the table reaches its owner once per batch.
* Owner tasks read one bucket after another in key order, chain the entries of
  equal keys and compare their bytes, and write the index: bucket, key, chain
  position, digest, body, the row that stays and the group's size.

Only the index entry of a key is held at a time.  Rows find their group in the
index by key and digest in a join whose right side has one row per text.

Null texts count as empty.  Of equal texts the row with the most code points in
its original text stays, then the smallest doc_id; a null doc_id comes last.
Rows that repeat a doc_id get the same answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clarion.llm.common import fresh, parts, stored

BLANKS = b" \t\n\x0b\x0c\r"
BUCKET_KEYS, MOST_DEPTH = 2_000, 16

_MEMBER = "doc_id long, n_chars long, key long, digest string"
_PAGE = "bucket int, key long, digest string, body binary, n_chars long, doc_id long, n long"
_INDEX = "bucket int, key long, chain int, digest string, body binary, n_chars long, keep_id long, group_size long"


def normalise(text: str | None) -> bytes:
    return (text or "").encode().translate(None, BLANKS)


def hash_key(body: bytes) -> int:
    """Signed 64-bit key."""
    h = xxhash.xxh3_64_intdigest(body)
    return h - (1 << 64) if h >> 63 else h


def prefix(key: int) -> int:
    return (key & 0xFFFF_FFFF_FFFF_FFFF) >> (64 - MOST_DEPTH)


def build_directory(loads: np.ndarray, bucket_keys: int = BUCKET_KEYS) -> np.ndarray:
    """Bucket of each of the ``2 ** MOST_DEPTH`` longest prefixes, from the keys under each.

    A bucket is named by the first longest prefix under it.
    """
    directory, depth = np.zeros(1, np.int64), 0
    sums = np.concatenate([[0], np.cumsum(loads)])
    full = len(loads).bit_length() - 1
    local = {0: 0}  # bucket -> its own depth
    while depth < full:
        over = [b for b, d in local.items() if d == depth and sums[b + (len(loads) >> d)] - sums[b] > bucket_keys]
        if not over:
            break
        directory, depth = np.repeat(directory, 2), depth + 1  # the directory doubles
        for b in over:  # each overfull bucket splits; the others are pointed to by two entries
            half = b + (len(loads) >> depth)
            local[b], local[half] = depth, depth
            directory[half // (len(loads) >> depth)] = half
    return np.repeat(directory, len(loads) >> depth)


def _members(key_of: Callable[[bytes], int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text"):
            texts = b.column("text").to_pylist()
            bodies = [normalise(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([key_of(x) for x in bodies], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string())], names=["doc_id", "n_chars", "key", "digest"])
    return run


def _better(a: tuple, b: tuple) -> bool:
    """Whether row (n_chars, doc_id) ``a`` stays before ``b``."""
    return a[0] > b[0] or a[0] == b[0] and a[1] is not None and (b[1] is None or a[1] < b[1])


def _pages(directory: np.ndarray, key_of: Callable[[bytes], int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages: dict[bytes, list] = {}
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py()
                body, row = normalise(text), (len(text or ""), doc_id)
                page = pages.setdefault(body, [row, 0])
                page[1] += 1
                if _better(row, page[0]):
                    page[0] = row
            keys = [key_of(x) for x in pages]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(directory[prefix(k)]) for k in keys], pa.int32()), pa.array(keys, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in pages], pa.string()), pa.array(list(pages), pa.binary()),
                pa.array([p[0][0] for p in pages.values()], pa.int64()), pa.array([p[0][1] for p in pages.values()], pa.int64()),
                pa.array([p[1] for p in pages.values()], pa.int64())], names=[f.split()[0] for f in _PAGE.split(", ")])
    return run


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains the entries of each key; they come in order of bucket and key."""
    names = [f.split()[0] for f in _INDEX.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    done: list[tuple] = []
    here, chained = None, []  # the key at hand and its chain: [digest, body, (n_chars, doc_id), n]

    def close() -> None:
        done.extend((*here, pos, dig, body, row[0], row[1], n) for pos, (dig, body, row, n) in enumerate(chained))
        chained.clear()

    def block() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done), kinds)], names=names)
        done.clear()
        return out

    for b in batches:
        for bucket, key, dig, body, chars, doc_id, n in zip(*(b.column(i).to_pylist() for i in range(7))):
            if (bucket, key) != here:
                close()
                here = (bucket, key)
            entry = next((c for c in chained if c[1] == body), None)
            if entry is None:
                chained.append([dig, body, (chars, doc_id), n])
                continue
            entry[3] += n
            if _better((chars, doc_id), entry[2]):
                entry[2] = (chars, doc_id)
        if done:
            yield block()
    close()
    if done:
        yield block()


def members(docs: DataFrame, key_of: Callable[[bytes], int] = hash_key) -> DataFrame:
    """One narrow row per document: doc_id, n_chars, key, digest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(_members(key_of), _MEMBER), "dedup-members")


def directory_of(rows: DataFrame, bucket_keys: int = BUCKET_KEYS) -> np.ndarray:
    """The directory for the keys of ``rows``; reads at most ``2 ** MOST_DEPTH`` counts."""
    loads = np.zeros(1 << MOST_DEPTH, np.int64)
    top = F.shiftrightunsigned("key", 64 - MOST_DEPTH).cast("int")
    for r in rows.groupBy("key").agg(F.lit(1).alias("one")).groupBy(top.alias("p")).count().collect():
        loads[r.p] = r["count"]
    return build_directory(loads, bucket_keys)


def build_index(docs: DataFrame, directory: np.ndarray, key_of: Callable[[bytes], int] = hash_key) -> DataFrame:
    """The index, written to the shared folder: one row per distinct text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pages = rows.mapInArrow(_pages(directory, key_of), _PAGE)
    owned = pages.repartition("bucket").sortWithinPartitions("bucket", "key")
    return stored(owned.mapInArrow(_owner, _INDEX), "dedup-index")


def dedup(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, key_of: Callable[[bytes], int] = hash_key) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs`` (doc_id, text)."""
    rows = members(docs, key_of)
    index = build_index(docs, directory_of(rows, bucket_keys), key_of)
    groups = index.select("key", "digest", "keep_id", "group_size")
    return rows.join(groups, ["key", "digest"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, whole; of repeated rows (same doc_id and text), one."""
    stay = dedup(docs).where("kept").groupBy(F.col("keep_id").alias("_stay"), F.col("text_sha256").alias("_text")).agg(F.count(F.lit(1)).alias("n"))
    digest = fresh(docs, "digest")
    blanks = BLANKS.decode()
    named = docs.withColumn(digest, F.sha2(F.translate(F.coalesce("text", F.lit("")), blanks, ""), 256))
    match = lambda s: named["doc_id"].eqNullSafe(s["_stay"]) & (named[digest] == s["_text"])
    one, more = (stay.where(c).drop("n") for c in ("n = 1", "n > 1"))
    again = named.join(more, match(more), "left_semi")
    # of rows under one doc_id the longest text stays
    longest = F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(F.length("text").desc()))
    turn = fresh(named, "turn")
    again = again.withColumn(turn, longest).where(F.col(turn) == 1).drop(turn)
    return named.join(one, match(one), "left_semi").unionByName(again).drop(digest)
