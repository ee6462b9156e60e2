"""Operator 10, sharding by a two-pass external shuffle.

Pass 1 scatters whole records into buckets by a seeded hash of all their columns; the number of buckets follows from the
input's bytes, so that one fits in a task's memory. Equal records that together would fill half a bucket or more are told
apart by their map task and their occurrence in it, so no repeated row is a hot bucket. Pass 2 sorts each bucket by the
hash and applies a Fisher-Yates shuffle seeded by the seed and the bucket's number, so a task that runs again on
another executor gives the same order. The shuffled buckets are written; a bucket's records take consecutive ranks of
one global order (after those of the buckets before it, whose sizes are the only thing summed up over all), and rank r
goes to shard r mod ``shards``, slot r div ``shards``: the law ``rows``.

Defined results: null text has no bytes and the crc32 of nothing, and is another record than an empty one; null doc_ids
are values like others; repeated rows are records like others, and interchangeable as they are equal in all columns.
The order depends on the rows alone, but for rows so often repeated that map tasks tell them apart. An empty table
gives an empty result. Columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import cut, table, written

SHARDS = 40
BUCKET_BYTES = 8 << 20
#: Buckets of a small table, so that tasks share it.
MIN_BUCKETS = 64
TASK_BUCKETS = 4
SEED = 77
RECORD_BYTES = 16


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long"))


def _hash(seed: int, field: T.StructField) -> list[Column]:
    """What a column gives to a record's hash: its value and whether it is null, which hashes skip."""
    c = F.col(f"`{field.name}`")
    return [c.isNull(), F.array_sort(F.map_entries(c)) if isinstance(field.dataType, T.MapType) else c]


def scattered(docs: DataFrame, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Pass 1: docs with the hash of each record and its bucket; the number of buckets."""
    given = docs.drop("record_hash", "bucket")
    given = given.withColumn("record_hash", F.xxhash64(F.lit(seed), *[x for f in given.schema.fields for x in _hash(seed, f)]))
    # a few bytes a distinct record; repeated ones of half a bucket are at most two for each bucket
    sums = cut(with_size(given.select(text, "record_hash"), text).groupBy("record_hash").agg(F.sum("size").alias("bytes"), F.count("size").alias("n")))
    total = sums.agg(F.sum("bytes")).head()[0] or 0
    buckets = max(MIN_BUCKETS, -(-total // bucket_bytes))
    hot = sums.where((F.col("bytes") * 2 >= bucket_bytes) & (F.col("n") > 1)).select("record_hash")
    bucket = lambda salt: F.pmod(F.xxhash64(F.lit(seed), "record_hash", salt), F.lit(buckets)).cast("int").alias("bucket")
    usual = given.join(F.broadcast(hot), "record_hash", "left_anti").select("*", bucket(F.lit(0)))
    again = given.join(F.broadcast(hot), "record_hash", "left_semi").withColumn("__task", F.spark_partition_id())
    schema = T.StructType([*again.schema.fields, T.StructField("__nth", T.LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which of the task's equal records each is: the same numbers in whatever order they come."""
        seen: dict[int, int] = {}
        for b in batches:
            nth = []
            for h in b.column("record_hash").to_pylist():
                seen[h] = seen.get(h, 0) + 1
                nth.append(seen[h])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth, pa.int64())], [*b.schema.names, "__nth"])

    again = again.mapInArrow(numbered, schema).select(*given.columns, bucket(F.struct("__task", "__nth")))
    return usual.select(*given.columns, "bucket").unionByName(again), buckets


def shuffled(docs: DataFrame, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Both passes: docs with ``bucket`` and ``place``, a record's place in its bucket after the shuffle."""
    base, buckets = scattered(docs.drop("place"), text, seed, bucket_bytes)
    schema = T.StructType([*[f for f in base.schema.fields if f.name != "record_hash"], T.StructField("place", T.LongType())])

    def fisher_yates(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("record_hash").to_numpy(), kind="stable")
        place = np.arange(t.num_rows)
        rng = np.random.default_rng([seed, t.column("bucket")[0].as_py()])
        for k, j in zip(range(t.num_rows - 1, 0, -1), rng.integers(0, np.arange(t.num_rows, 1, -1)), strict=True):
            place[k], place[j] = place[j], place[k]
        t = t.drop_columns("record_hash").take(pa.array(order[place], pa.int64()))
        return t.append_column("place", pa.array(np.arange(t.num_rows), pa.int64()))

    # tasks of a few buckets each, however many there are
    return base.repartition(-(-buckets // TASK_BUCKETS), "bucket").groupBy("bucket").applyInArrow(fisher_yates, schema)


def shards(docs: DataFrame, text: str = "text", count: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with ``shard`` and ``slot`` under the law ``rows``: shard sizes differ by one record at most."""
    names = [n for n in docs.columns if n not in ("shard", "slot", "bucket", "place", "record_hash")]
    placed = written(shuffled(docs.select(*names), text, seed, bucket_bytes))
    # a row for each bucket, that is for each bucket_bytes of records: some 13 million for 100 TB
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.col("place")
    return placed.join(F.broadcast(starts), "bucket").select(*names, (rank % count).cast("int").alias("shard"), F.floor(rank / count).cast("long").alias("slot"))


def write(docs: DataFrame, path: str, **options) -> None:
    """Shards as Parquet under ``path/shard=N``; a shard's order is that of ``slot``."""
    shards(docs, **options).write.partitionBy("shard").parquet(path)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return with_size(out).select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
