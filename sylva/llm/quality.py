"""Operator 1, quality classifier: hashed word n-gram logistic regression with FTRL updates.

Features of a text: hashed unigrams and bigrams of its words (runs of non-blank bytes, A-Z folded) and of their shapes
(which kinds of bytes occur, how the word begins and ends, whether it repeats the word before), each with the share of
the text's words it makes up. A score is the sparse dot product of these shares with the weights, through a sigmoid.

Defined results: a null or empty text and one of blanks score the bias alone. Repeated rows score alike. An empty table
gives an empty result; without labels every score is 0.5. Other columns pass through, but those named like a result
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._ftrl import Ftrl, sigmoid
from ._spark import append, fold, labelled_sample, lean, table
from ._text import chunks, grams, mix, not_blank, sums

BITS = 18
SIZE = 1 << BITS
#: The most labelled rows that the model is fitted on.
MAX_TRAIN_ROWS = 12_000
#: Shares are below 1; the factor brings a feature that makes up a hundredth of a text to about 1.
SCALE = 20.0
_WORD = not_blank()


def _kinds() -> np.ndarray:
    """A bit for each kind of byte: lower, upper, digit, outside ASCII, sentence mark, bracket or quote, bar or slash, other sign."""
    bits = np.full(256, 128, np.uint16)
    bits[~_WORD] = 0
    bits[97:123], bits[65:91], bits[48:58], bits[128:] = 1, 2, 4, 8
    bits[[ord(c) for c in ".,;:!?"]] = 16
    bits[[ord(c) for c in "()[]{}'\"<>"]] = 32
    bits[[ord(c) for c in "|/\\"]] = 64
    return bits


_KIND = _kinds()


def _features(chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashed feature, offset of each row) of the four families, and the words of each row."""
    starts, ends, at = chunk.words(_WORD)
    h = chunk.hashes(starts, ends)
    if not len(h):
        return [(np.zeros(0, np.int64), at)] * 4
    kinds = _KIND[chunk.data]
    seen = np.bitwise_or.reduceat(kinds, starts)  # to the next start, over blanks too, which have no bit
    again = np.zeros(len(h), np.uint64)
    again[1:] = h[1:] == h[:-1]
    again[at[:-1][at[:-1] < len(h)]] = 0
    long = np.minimum(ends - starts, 31).astype(np.uint64) // np.uint64(8)
    shape = mix(seen.astype(np.uint64) | kinds[starts].astype(np.uint64) << np.uint64(8) | kinds[ends - 1].astype(np.uint64) << np.uint64(16) | again << np.uint64(24) | long << np.uint64(25))
    out = []
    for family, (x, k) in enumerate(((h, 1), (h, 2), (shape, 1), (shape, 2))):
        g, offsets = grams(x, at, k)
        out.append(((mix(g + np.uint64(family + 1)) >> np.uint64(64 - BITS)).astype(np.int64), offsets))
    return out


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, features, shares) of each labelled text."""
    for b in batches:
        y = b.column("y").to_numpy(zero_copy_only=False)
        for c in chunks(b.column("text")):
            families = _features(c)
            ids, shares = [], []
            for r in range(c.hi - c.lo):
                total = max(1, families[0][1][r + 1] - families[0][1][r])
                i, n = np.unique(np.concatenate([f[o[r] : o[r + 1]] for f, o in families]), return_counts=True)
                ids.append(i.astype(np.int32))
                shares.append((n * (SCALE / total)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(y[c.lo : c.hi], pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["y", "ids", "shares"])


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float


def fit(sample: DataFrame, epochs: int = 3) -> QualityModel:
    """A model from (text, y). The sample is bounded by its maker; only its hashed vectors reach the driver."""
    rows = sample.mapInArrow(lean(vectors), "y int, ids array<int>, shares array<float>").toArrow()
    model, bias = Ftrl(SIZE, alpha=0.5, l1=0.3, l2=0.1), Ftrl(1, alpha=0.3, l1=0.0, l2=0.0)
    y = rows.column("y").to_numpy()
    ids, shares = ([np.asarray(v.values) for v in rows.column(k)] for k in ("ids", "shares"))
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for r in rng.permutation(len(y)):
            w, b = model.weights(ids[r])[:, 0], bias.weights()
            g = sigmoid(w @ shares[r] + b[0, 0]) - y[r]
            model.update(ids[r], (g * shares[r])[:, None], w[:, None])
            bias.update(np.array([0]), np.array([[g]]), b)
    return QualityModel(model.weights()[:, 0].astype(np.float32), float(bias.weights()[0, 0]))


def score(docs: DataFrame, model: QualityModel, text: str = "text", drop: tuple = ()) -> DataFrame:
    """docs with ``score``, the probability of label 1. One narrow pass; the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        m, out = shared.value, np.zeros(b.num_rows)
        for c in chunks(b.column(text)):
            families = _features(c)
            words = np.maximum(1, np.diff(families[0][1]))
            out[c.lo : c.hi] = sigmoid(m.bias + sum(sums(m.weights[f], o) for f, o in families) * (SCALE / words))
        return [pa.array(out)]

    return append(docs, make, [("score", T.DoubleType())], drop)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", lambda: fold() == 0, MAX_TRAIN_ROWS)
    scored = score(docs.select("doc_id", "text"), fit(sample), drop=("text",))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
