"""SentencePiece encoding and decoding through a distinct-chunk table.

In the normalised text every space is the marker U+2581 and one marker stands
in front.  When no piece of the vocabulary has a marker behind another
character, no merge crosses the place in front of a run of markers, so the
text falls into chunks (markers plus the characters up to the next marker)
whose pieces do not depend on each other.  Each distinct chunk is segmented
once by the library, and a text's ids are its chunks' ids joined by position.

The table belongs to a task (joining the positions of all texts through a
shuffle would move several times the input).  It is emptied when it reaches
``TABLE_CHUNKS`` entries or ``TABLE_CHARS`` characters, so memory stays bounded.

Null and empty texts give no ids; decoding a null or empty list gives "".
Vocabularies whose pieces cross markers, or that define symbols of their own,
are encoded text by text with the same results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarion.llm.common import fresh

MARK = "▁"
TABLE_CHUNKS, TABLE_CHARS = 100_000, 4_000_000
#: Characters of text whose chunks are held at a time.
SLICE_CHARS = 500_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_CROSSES = re.compile(f"[^{MARK}]{MARK}")


@lru_cache(maxsize=2)
def _coder(model: bytes) -> "PieceCoder":
    return PieceCoder(model)


class PieceCoder:
    """Encodes lists of texts with one model; holds the chunk table."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        lone = self.sp.piece_to_id(MARK)
        special = {self.sp.unk_id(), self.sp.bos_id(), self.sp.eos_id(), self.sp.pad_id()}
        plain = self.sp.encode("a b") == self.sp.encode("a") + self.sp.encode("b") and self.sp.decode(self.sp.encode("a  b ")) == "a  b "
        self.by_chunk = plain and lone not in special and not any(
            _CROSSES.search(self.sp.id_to_piece(i)) for i in range(n))
        self.lone = lone
        self.table: dict[str, tuple[int, ...]] = {}
        self.chars = 0

    def _learn(self, wanted: set[str]) -> None:
        """Segment the chunks that the table lacks, each once."""
        new = [c for c in wanted if c not in self.table]
        if len(self.table) + len(new) > TABLE_CHUNKS or self.chars + sum(map(len, new)) > TABLE_CHARS:
            self.table.clear()
            new, self.chars = list(wanted), 0
        self.chars += sum(map(len, new))
        # the library puts the first marker in front by itself, but not for an empty text
        for chunk, ids in zip(new, self.sp.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1)):
            self.table[chunk] = tuple(ids) if len(chunk) > 1 else (self.lone,)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_chunk:
            return [np.array(self.sp.encode(t, num_threads=1), dtype=np.int32) for t in texts]
        cut = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self._learn(set(chain.from_iterable(cut)))
        get = self.table.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, c)), dtype=np.int32) for c in cut]


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts (null: empty) in parts, so that few are Python strings at a time."""
    part, chars = [], 0
    for x in texts:
        t = x.as_py() or ""
        part.append(t)
        chars += len(t)
        if chars >= SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def read_model(path: str) -> bytes:
    """The model file's bytes, read on the driver and sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode_column(text: Column, model: bytes) -> Column:
    """``array<int>`` of the text's piece ids."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(model)
        for batch in batches:
            ids = [x for part in _slices(batch) for x in coder.encode(part)]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return encode(text)


def decode_column(ids: Column, model: bytes) -> Column:
    """The library's decoding of a list of ids."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sp = _coder(model).sp
        for batch in batches:
            flat, ends = batch.values.to_numpy(), batch.offsets.to_numpy()
            lists = (flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:]))  # a null list is empty
            yield pa.array([sp.decode(x) if x else "" for x in lists], pa.string())

    return decode(ids)


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the piece ids of column ``text`` as column ``ids``."""
    return df.withColumn(ids, encode_column(F.col(text), model))


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in column ``ids`` as column ``text``."""
    return df.withColumn(text, decode_column(F.col(ids), model))


def round_trip(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of column ``text`` and the text that the library decodes from them.

    Both are made by one Python operator, so a task has one worker and its ids
    do not travel back for decoding.
    """

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(model)
        for batch in batches:
            flat, counts, texts = [np.empty(0, np.int32)], [0], []
            for part in _slices(batch):
                coded = coder.encode(part)
                flat += coded
                counts += map(len, coded)
                texts.append(pa.array([coder.sp.decode(x.tolist()) if len(x) else "" for x in coded], pa.string()))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
            yield pa.StructArray.from_arrays([lists, pa.concat_arrays(texts) if texts else pa.array([], pa.string())], ["ids", "decoded"])

    coded = fresh(df, "coded")
    out = df.withColumn(coded, both(F.col(text)))
    return out.withColumn(ids, F.col(f"{coded}.ids")).withColumn(decoded, F.col(f"{coded}.decoded")).drop(coded)


def digest(df: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, from a real round trip."""
    return round_trip(df.select("doc_id", "text"), model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def digest_one(ids: list[int], decoded: str) -> tuple[int, str, str]:
    """The same digests for one text, in plain Python (for tests)."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(decoded)
