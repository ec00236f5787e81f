"""Language identification with a byte convolutional network.

Filters of several widths slide over windows of ``WINDOW`` bytes (lower-cased
ASCII, blanks as padding), each filter's largest answer in the window goes
through a softmax layer, and a document's probabilities are the mean over all
its windows, weighted by their bytes.  The network is trained here, in numpy,
on a bounded sample: ``PER_LANG`` documents of each label (the smallest hashes)
and ``SPANS`` spans of ``SPAN`` characters from each, spread over the whole
text; at most ``MOST_DOCS`` documents in all.  Prediction reads whole texts.

A filter over one-hot bytes is a sum of table rows, so two adjacent bytes are
looked up at once in tables of 65,536 rows.

Null texts and texts without letters give ``und`` with score 0; so does
everything when there is no labelled row.  Predictions use the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from clarion.llm.common import tidy

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
PER_LANG, SPANS, SPAN, MOST_DOCS = 400, 12, 200, 20_000
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.02, 11
#: Windows worked on at a time.
BLOCK = 128
_LETTER = re.compile(r"[^\W\d_]")


class ByteNet:
    """Weights by width ``(width, 256, filters)``, and the softmax layer."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.conv = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), max(len(langs), 1))).astype(np.float32)
        self.bias = np.zeros(max(len(langs), 1), np.float32)

    def answers(self, x: np.ndarray) -> list[np.ndarray]:
        """Each width's filter answers, (windows, places, filters); for training."""
        return [sum(t[j][x[:, j: x.shape[1] - len(t) + 1 + j]] for j in range(len(t))) for t in self.conv]

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        params = [*self.conv, self.dense, self.bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                pick = order[at: at + BATCH]
                xb, rows = x[pick], np.arange(len(pick))
                ans = self.answers(xb)
                best = [a.argmax(axis=1) for a in ans]
                pooled = np.concatenate([np.take_along_axis(a, b[:, None], 1)[:, 0] for a, b in zip(ans, best)], axis=1)
                hidden = np.maximum(pooled, 0)
                z = hidden @ self.dense + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[rows, y[pick]] -= 1
                p /= len(pick)
                back = (p @ self.dense.T) * (pooled > 0)
                grads = []
                for k, (t, b) in enumerate(zip(self.conv, best)):
                    g, part = np.zeros_like(t), back[:, k * FILTERS: (k + 1) * FILTERS]
                    for j in range(len(t)):
                        np.add.at(g[j], (xb[rows[:, None], b + j], np.arange(FILTERS)[None]), part)
                    grads.append(g)
                grads += [hidden.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """Answers of byte pairs: a filter of width w is one or two table rows."""
        out = []
        for t in self.conv:
            pair = lambda j: (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS)  # noqa: E731, B023
            out.append((pair(0),) if len(t) == 2 else (pair(0), t[2]) if len(t) == 3 else (pair(0), pair(2)))
        return out

    def probabilities(self, x: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """(windows, languages), block by block."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), BLOCK):
            b = x[at: at + BLOCK]
            pair = b[:, :-1].astype(np.intp) * 256 + b[:, 1:]
            pooled = []
            for tab in tables:
                if len(tab) == 1:
                    a = tab[0].take(pair, axis=0)
                elif tab[1].shape[0] == 256:
                    a = tab[0].take(pair[:, :-1], axis=0)
                    a += tab[1].take(b[:, 2:], axis=0)
                else:
                    a = tab[0].take(pair[:, :-2], axis=0)
                    a += tab[1].take(pair[:, 2:], axis=0)
                pooled.append(a.max(axis=1))
            z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            out[at: at + BLOCK] = p / p.sum(axis=1, keepdims=True)
        return out


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, each window's text number and its bytes."""
    padded, owner, filled = [], [], []
    for k, t in enumerate(texts):
        n = max(1, -(-len(t) // WINDOW))
        padded.append(t.lower().ljust(n * WINDOW))
        owner.append(np.full(n, k))
        f = np.full(n, WINDOW)
        f[-1] = max(1, len(t) - (n - 1) * WINDOW)
        filled.append(f)
    x = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, WINDOW)
    return x, np.concatenate(owner), np.concatenate(filled)


def sample(df: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    """The bounded training sample: ``lang`` and ``spans``, from rows with both values."""
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("lang"), F.xxhash64(key, lang).alias("h"))
    length = F.length("t")
    spans = F.transform(F.sequence(F.lit(0), F.lit(SPANS - 1)), lambda i: F.substring(F.col("t"), (F.lit(1) + F.floor(i * length / SPANS)).cast("int"), F.lit(SPAN)))
    w = Window.partitionBy("lang").orderBy("h")
    # only hashes and labels are ranked; the spans are cut from the few rows chosen
    cut = rows.select("lang", "h").withColumn("r", F.row_number().over(w)).where(F.col("r") <= PER_LANG).orderBy("r", "h", "lang").limit(MOST_DOCS)
    return rows.join(F.broadcast(cut.select("lang", "h").distinct()), ["lang", "h"]).select("lang", "h", F.array_distinct(spans).alias("spans"))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteNet:
    """Train on a bounded sample of the rows of ``df`` that have a text and a label."""
    rows = sorted((r.lang, r.h, tuple(r.spans)) for r in sample(df, text, lang, key).orderBy("h", "lang", F.xxhash64("spans"), "spans").limit(2 * MOST_DOCS).collect())
    langs = sorted({r[0] for r in rows})
    net = ByteNet(langs)
    if not rows:
        return net
    spans, y = [], []
    for lang_, _, parts in rows:
        for s in parts:
            if _LETTER.search(s):
                spans.append(s.encode()[:WINDOW])
                y.append(langs.index(lang_))
    if spans:
        net.train(windows(spans)[0], np.array(y))
    return net


def predict_column(text: Column, net: ByteNet) -> Column:
    """``struct<lang: string, score: double, best: double>`` of a text; best: the largest probability of a label in any window."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("best", pa.float64())])

    @F.arrow_udf("lang string, score double, best double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tabs = net.tables()
        for batch in batches:
            langs, scores, best = (np.full(len(batch), x) for x in ("und", 0.0, 0.0))
            langs = langs.astype(object)
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_pylist()
            todo = [k for k, t in enumerate(batch) if net.langs and _LETTER.search(t.as_py() or "")]
            at = 0
            while at < len(todo):
                part, size = [], 0
                while at < len(todo) and (not part or size < 4_000_000):
                    part.append(todo[at])
                    size += sizes[todo[at]]
                    at += 1
                x, owner, filled = windows([batch[k].as_buffer().to_pybytes() for k in part])
                p = net.probabilities(x, tabs)
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                top = np.maximum.reduceat(p.max(axis=1), starts)
                p = p * filled[:, None]
                mean = np.add.reduceat(p, starts, axis=0) / np.add.reduceat(filled, starts)[:, None]
                for k, row, most in zip(part, mean, top):
                    langs[k] = net.langs[int(row.argmax())]
                    scores[k] = min(1.0, round(float(row.max()), 6))
                    best[k] = min(1.0, round(float(most), 6))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(best, pa.float64())], fields=list(kind))
        tidy()

    return predict(text)


def predict(df: DataFrame, net: ByteNet, text: str = "text", out: str = "language") -> DataFrame:
    """``df`` plus struct column ``out`` with ``lang``, ``score`` and ``best``."""
    return df.withColumn(out, predict_column(F.col(text), net))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
