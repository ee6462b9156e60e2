"""A corpus pipeline of five stages, each an operator of ``sylva.llm`` over all that the stage before it kept.

1. language ID: documents without a letter or without a confident language go;
2. n-gram Jaccard join: of each group of near duplicates the document with the group's smallest doc_id stays, and so do rows without a doc_id;
   of rows that repeat a doc_id one counts and stays, the first with a text, by text and the row's hash;
3. benchmark decontamination: documents in which a window of a benchmark item occurs go;
4. PII: every span found is replaced by its kind in angle brackets;
5. SentencePiece: documents are encoded and decoded again; the token ids are returned with the documents.

Stages 1 to 4 return the columns of documents, ``n_chars`` following the text; nulls, empty tables, repeated rows and further columns are
as the operators define. ``run`` writes each stage's rows to the shared checkpoint folder and the next stage reads them from there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from sylva.llm import decontaminate, jaccard, language, pieces, pii
from sylva.llm._spark import cut, table, written


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs in their order, n_chars of changed texts anew."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(language.training_rows(table(spark, sf_dir, "documents")))
    judged = language.identify(docs, model)
    return judged.where(language.accepted()).select(*docs.columns)


def _one_row_an_id(docs: DataFrame) -> DataFrame:
    """docs with one row for each repeated doc_id: one with a text before one without, then by text and the row's hash."""
    times = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if times.isEmpty():
        return docs
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    order = F.struct(F.col("text").isNull(), F.col("text"), F.xxhash64(*hashed))
    again = docs.join(times, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{n}`") for n in docs.columns]), order).alias("row"))
    return docs.join(times, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select("row.*"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _one_row_an_id(docs)
    lost = jaccard.near_duplicates(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(docs.drop("n_words", "hits", "items"), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("items") == 0).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.detect(docs, pii.fit(docs))
    return _columns(found.withColumn("text", pii.redacted(F.col("text"), F.col("spans"))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.tokenize(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", redact), ("sentencepiece", encode)]

#: The classifiers and the tokenizer are beyond SQL; tests hold the near-duplicate, decontamination and encoding stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
