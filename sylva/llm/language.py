"""Operator 4, language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features of a text: hashed n-grams of one to three characters (lower-cased by Unicode), each with its share of the
text's n-grams times its inverse document frequency over all training texts. Weights come from FTRL updates with an
elastic-net penalty (L1 leaves most at zero); a temperature fitted on a tenth of the sample calibrates the scores.

Defined results: ``und`` with score 0 for null, empty and letterless texts (no character that Unicode calls a letter);
without labelled rows every text is ``und``. Ties go to the first language in sorted order. Repeated rows get the same
answer; an empty table gives an empty result. Columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._ftrl import Ftrl
from ._spark import append, bounded_rows, fold, lean, table
from ._text import CHUNK, chunks, sums

BITS = 16
SIZE = 1 << BITS
ORDERS = (1, 2, 3)
#: The most labelled rows that the weights are fitted on; document frequencies cover every training row.
MAX_TRAIN_ROWS = 4_000
UNDETERMINED = "und"
#: Documents with less confidence are rejected by the pipeline's stage.
LEAST_SCORE = 0.5
#: Bytes of texts that are scored together; each n-gram takes some 30 bytes a language meanwhile.
TEXT_BYTES = CHUNK // 4
SCALE = 10.0
#: What may be a letter; ``isalpha`` decides, as other numbers (a half, a circled one) match it too.
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def _grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashed n-grams of all texts and the offset of each text."""
    texts = [t.lower() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for k in ORDERS:
        n = np.maximum(np.diff(at) - k + 1, 0)
        offsets = np.concatenate([[0], np.cumsum(n)])
        m = max(0, len(points) - k + 1)
        h = np.full(m, k * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            h = (h ^ points[j : m + j]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        inside = np.ones(m, bool)
        for j in range(1, k):  # n-grams that run into the next text
            cut = at[1:-1] - j
            inside[cut[(cut >= 0) & (cut < m)]] = False
        out.append(((h[inside] >> np.uint32(32 - BITS)).astype(np.uint16), offsets))
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: in how many texts each hashed n-gram occurs, and the number of texts."""
    count, texts = np.zeros(SIZE, np.int64), 0
    mark = np.zeros(SIZE, bool)
    for b in batches:
        for c in chunks(b.column("text")):
            rows = b.column("text").slice(c.lo, c.hi - c.lo).to_pylist()
            families = _grams([t or "" for t in rows])
            for r in range(len(rows)):
                mark[:] = False
                for g, o in families:
                    mark[g[o[r] : o[r + 1]]] = True
                count += mark
            texts += len(rows)
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([texts]), pa.array([count.tolist()], pa.list_(pa.int64()))], ["texts", "counts"])


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(texts, frequency of each of the SIZE hashed n-grams) over all of docs.

    Each task sends one fixed-size array; they are added by slot in a shuffle, so what reaches the driver is one array.
    """
    parts = docs.select("text").mapInArrow(lean(_frequencies), "texts long, counts array<long>")
    total = parts.select("texts", F.posexplode("counts").alias("slot", "n")).where("n > 0 or slot = 0")
    rows = total.groupBy("slot").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("slot") == 0, F.col("texts"))).alias("texts")).toArrow()
    out = np.zeros(SIZE, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return int(sum(x or 0 for x in rows.column("texts").to_pylist())), out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b.column("text")):
            rows = b.column("text").slice(c.lo, c.hi - c.lo).to_pylist()
            families = _grams([t or "" for t in rows])
            ids, shares = [], []
            for r in range(len(rows)):
                g = np.concatenate([g[o[r] : o[r + 1]] for g, o in families])
                i, n = np.unique(g, return_counts=True)
                ids.append(i.astype(np.int32))
                shares.append((n / max(1, len(g))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("lang").slice(c.lo, c.hi - c.lo), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["lang", "ids", "shares"])


@dataclass
class LanguageModel:
    languages: list[str]
    #: idf is folded in; one column for each language.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(docs: DataFrame, epochs: int = 2) -> LanguageModel:
    """A model from (doc_id, text, lang) rows that may be learned from; rows without lang teach nothing."""
    docs = docs.where(F.col("lang").isNotNull())
    texts, frequency = document_frequencies(docs)
    idf = np.log((1 + texts) / (1 + frequency)) + 0.1
    sample = bounded_rows(docs.select("doc_id", "text", "lang"), "doc_id", MAX_TRAIN_ROWS)
    rows = sample.select("text", "lang").mapInArrow(lean(_vectors), "lang string, ids array<int>, shares array<float>").toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    if not names:
        return LanguageModel([], np.zeros((SIZE, 0), np.float32), np.zeros(0), 1.0)
    y = np.searchsorted(names, rows.column("lang").to_pylist())
    ids = [np.asarray(v.values) for v in rows.column("ids")]
    values = [np.asarray(v.values) * idf[i] * SCALE for v, i in zip(rows.column("shares"), ids, strict=True)]
    order = np.random.default_rng(4).permutation(len(y))
    apart = len(y) // 10
    model, bias = Ftrl(SIZE, len(names), alpha=1.0, l1=0.05, l2=0.1), Ftrl(1, len(names), alpha=0.3, l1=0.0, l2=0.1)
    one = np.eye(len(names))
    for _ in range(epochs):
        for r in order[apart:]:
            w, b = model.weights(ids[r]), bias.weights()
            g = _softmax(values[r] @ w + b[0]) - one[y[r]]
            model.update(ids[r], values[r][:, None] * g, w)
            bias.update(np.array([0]), g[None], b)
    w, b = model.weights(), bias.weights()[0]
    temperature = 1.0
    if apart:
        logits = np.array([values[r] @ w[ids[r]] + b for r in order[:apart]])
        grid = np.geomspace(0.05, 20, 200)
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(apart), y[order[:apart]]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return LanguageModel(names, (w * idf[:, None] * SCALE).astype(np.float32), b, temperature)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", drop: tuple = ()) -> DataFrame:
    """docs with ``lang_pred`` and ``score``. One narrow pass; the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        languages, score = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows)
        for c in chunks(b.column(text), TEXT_BYTES) if m.languages else ():
            rows = [t or "" for t in b.column(text).slice(c.lo, c.hi - c.lo).to_pylist()]
            families = _grams(rows)
            n = np.maximum(1, sum(np.diff(o) for _, o in families))
            p = _softmax((sum(sums(m.weights[g], o) for g, o in families) / n[:, None] + m.bias) / m.temperature)
            best = p.argmax(1)
            for r, t in enumerate(rows):
                if has_letter(t):
                    languages[c.lo + r], score[c.lo + r] = m.languages[best[r]], p[r, best[r]]
        return [pa.array(languages, pa.string()), pa.array(score)]

    return append(docs, make, [("lang_pred", T.StringType()), ("score", T.DoubleType())], drop)


def accepted() -> Column:
    """The pipeline's decision over identify()'s columns."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(fold() != 0)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(training_rows(docs)), drop=("text",))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
