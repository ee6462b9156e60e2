"""What the operators share on Spark's side: lineage cuts, bounded label samples, Arrow column builders, memory of workers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a local master (tests) gets a folder of its own
    and a cluster is refused, as a folder of one machine would lose the others' data.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint. What earlier cuts have made unreachable is let go of first, so that
    its shuffle files don't wait on disk for a collection.
    """
    shared_folder(df.sparkSession)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: for wide rows, which it packs, and for stages of a pipeline."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column = "doc_id", of: int = 5) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % of, F.lit(0))


def bounded_rows(df: DataFrame, key: str, most: int, salt: int = 11) -> DataFrame:
    """About ``most`` rows of df, the same ones at every run: those whose hashed key falls under a threshold.

    The bound holds for distinct keys up to the spread of a binomial; every row stays when there are fewer.
    """
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Callable[[], Column], most: int) -> DataFrame:
    """(text, y) of at most about ``most`` labelled rows outside the held-out fold.

    The ids are bounded by ``most`` before they are broadcast, so no text is shuffled. Several labels of one id count
    as the largest; rows without id or label teach nothing.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = bounded_rows(rows, "doc_id", most)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", F.col("y").cast("int").alias("y"))


#: Bytes of rows that a worker takes up and hands back at once.
PART_BYTES = 2 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def parts(b: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of b in slices of at most ``most`` bytes; a larger row is a slice of its own."""
    if b.num_rows < 2 or b.nbytes <= most:
        yield b
    else:
        half = b.num_rows // 2
        yield from parts(b.slice(0, half), most)
        yield from parts(b.slice(half), most)


def give_back() -> None:
    """Return freed memory to the system. A worker lives on through later stages, and its allocators would keep as much as its largest batch took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, fed slice by slice; what a batch took is given back after it."""

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from parts(b)
            del b
            give_back()

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(fed(batches))
        give_back()

    return lean_run


def append(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[tuple[str, T.DataType]], drop: Iterable[str] = ()) -> DataFrame:
    """df with the columns that ``make`` computes from each slice of an Arrow batch; ``drop`` leaves inputs out of what returns.

    Input columns named like a new one are replaced by it. Slices are handed back one by one, so neither the worker nor the
    JVM holds the columns of a whole batch of long texts besides its input.
    """
    names = [name for name, _ in fields]
    base = df.drop(*names)
    kept = [f for f in base.schema.fields if f.name not in set(drop)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + make(b), [f.name for f in kept] + names)

    return base.mapInArrow(lean(run), T.StructType(kept + [T.StructField(n, t) for n, t in fields]))
