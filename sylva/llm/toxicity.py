"""Operator 9, toxicity: a factorization machine over hashed terms.

A text is the set of its hashed words (runs of alphanumeric bytes, A-Z folded), each with its inverse document
frequency in the sample as its value x_i. The score is sigmoid(bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j),
the pair sum in linear time as half of |sum v x|^2 - sum |v x|^2, so that pairs such as an insult with a mention of a
group weigh more than their parts. Linear weights are learned with FTRL updates, factors with AdaGrad; a term takes
part once it is in ``MIN_TEXTS`` texts of the sample. As in DiFacto (Li et al. 2016), a term has factors while L1 leaves it a linear
weight: otherwise the pairs of a long text's usual words outweigh all others. A pair of terms that both mark nothing alone is not learned.

Defined results: null, empty and wordless texts score the bias alone; repeated rows score alike; an empty table gives
an empty result; without labels every score is 0.5. Columns named like a result are replaced.
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
from ._text import Chunk, alphanumeric, chunks, sums

BITS = 18
SIZE = 1 << BITS
FACTORS = 4
#: The most labelled rows that the model is fitted on.
MAX_TRAIN_ROWS = 12_000
MIN_TEXTS = 4
_WORD = alphanumeric()


def terms(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each row, and the offset of each row."""
    starts, ends, at = c.words(_WORD)
    h = (c.hashes(starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pairs = np.unique(rows << BITS | h)
    return pairs & (SIZE - 1), np.searchsorted(pairs, np.arange(len(at)) << BITS)


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        y = b.column("y").to_numpy(zero_copy_only=False)
        for c in chunks(b.column("text")):
            t, at = terms(c)
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(t, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(y[c.lo : c.hi], pa.int32()), ids], ["y", "ids"])


@dataclass
class ToxicityModel:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    #: x_i of each hashed term
    value: np.ndarray


def fit(sample: DataFrame, epochs: int = 6, rate: float = 0.15, decay: float = 1e-4, start: float = 0.1) -> ToxicityModel:
    """A model from (text, y). The sample is bounded by its maker; only its hashed terms reach the driver.

    ``rate``, ``decay`` and ``start`` (the spread they begin with) are those of the factors.
    """
    rows = sample.mapInArrow(lean(vectors), "y int, ids array<int>").toArrow()
    y, ids = rows.column("y").to_numpy(), [np.asarray(v.values) for v in rows.column("ids")]
    texts = np.zeros(SIZE, np.int32)
    for i in ids:
        texts[i] += 1
    ids = [i[texts[i] >= MIN_TEXTS] for i in ids]
    value = np.log((1 + len(ids)) / (1 + texts)) / np.log(2 + len(ids))
    rng = np.random.default_rng(9)
    v = np.where((texts >= MIN_TEXTS)[:, None], rng.normal(0, start, (SIZE, FACTORS)), 0.0)
    linear, bias, seen = Ftrl(SIZE, alpha=1.0, l1=3.0, l2=0.5), Ftrl(1, alpha=0.1, l1=0.0, l2=0.0), np.full((SIZE, FACTORS), 1.0)
    for _ in range(epochs):
        for r in rng.permutation(len(y)):
            i = ids[r]
            x = value[i]
            w, b, u = linear.weights(i)[:, 0], bias.weights(), v[i]
            on = (w != 0)[:, None]
            ux = u * x[:, None] * on
            total = ux.sum(0)
            g = sigmoid(b[0, 0] + w @ x + 0.5 * (total @ total - (ux * ux).sum())) - y[r]
            linear.update(i, (g * x)[:, None], w[:, None])
            bias.update(np.array([0]), np.array([[g]]), b)
            step = on * (g * x[:, None] * (total - ux) + decay * u)
            seen[i] += step * step
            v[i] = u - rate * step / np.sqrt(seen[i])
    w = linear.weights()[:, 0]
    return ToxicityModel(float(bias.weights()[0, 0]), w.astype(np.float32), (v * (w != 0)[:, None]).astype(np.float32), value.astype(np.float32))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", drop: tuple = ()) -> DataFrame:
    """docs with ``score``, the probability of label 1. One narrow pass; the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        m, out = shared.value, np.zeros(b.num_rows)
        for c in chunks(b.column(text)):
            t, at = terms(c)
            x = np.empty((len(t), FACTORS + 2), np.float32)
            x[:, 0], x[:, 1:-1] = m.linear[t] * m.value[t], m.factors[t] * m.value[t][:, None]
            x[:, -1] = (x[:, 1:-1] ** 2).sum(1)
            s = sums(x, at)
            out[c.lo : c.hi] = sigmoid(m.bias + s[:, 0] + 0.5 * ((s[:, 1:-1] ** 2).sum(1) - s[:, -1]))
        return [pa.array(out)]

    return append(docs, make, [("score", T.DoubleType())], drop)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", lambda: fold(of=4) == 2, MAX_TRAIN_ROWS)
    scored = score(docs.select("doc_id", "text"), fit(sample), drop=("text",))
    return scored.select("doc_id", (fold(of=4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
