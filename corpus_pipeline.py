"""The corpus pipeline: language, copies, near copies, mix, pieces.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of ``documents``.

* language: trains on the labelled rows of its input and drops documents in no
  language: those without letters, and those of ``LEAST_BYTES`` or more of which
  no window looks like any language (``LEAST_SCORE``).  Short texts and texts in
  several languages stay; without labels all with letters do;
* copies: of equal texts one stays; near copies: of each group of documents
  linked by five-word shingles at 0.8 or more one stays;
* mix: documents come as often as the source weights ask (0, 1 or 2 times);
* pieces: ids of every document, with digests of ids and round trip.

An empty table runs through with no rows; null texts have no language and go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarion.llm import exact_dedup, langid, minhash, mixing, pieces
from clarion.llm.common import fresh, stored, table
from clarion.llm.queries import MODEL_FILE

LEAST_SCORE, LEAST_BYTES = 0.4, 1_024


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = langid.fit(docs.where(~langid.held_out()))
    if not net.langs:  # nothing learned
        return docs.where(F.col("text").rlike(r"\p{L}"))
    out = fresh(docs, "language")
    named = langid.predict(docs, net, out=out)
    unlike = (F.octet_length("text") >= LEAST_BYTES) & (F.col(f"{out}.best") < LEAST_SCORE)
    return named.where((F.col(f"{out}.lang") != "und") & ~unlike).drop(out)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = pieces.read_model(public_tokenizers.path(MODEL_FILE))
    both = pieces.round_trip(docs.select("doc_id", "text"), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("exact_dedup", copies), ("near_dedup", near_copies), ("mix", mix), ("sentencepiece", encoded)]

#: The language network and the piece model are no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
