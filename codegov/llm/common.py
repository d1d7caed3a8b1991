"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    A private one is made only where Spark runs in this process and the setting is absent (tests, a laptop); on a
    cluster its absence is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches held to BATCH_BYTES: rows of long texts would make batches of any size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def give_back() -> None:
    """Memory that this Python process no longer uses goes back to the system, since driver and workers live on for other jobs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def thrifty(run: Callable) -> Callable:
    """``run`` of a mapInArrow; at a task's end its worker gives back what it no longer uses, since idle workers stay."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def added(docs: DataFrame, names: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step(docs)`` without the columns ``names`` that it adds, also where docs has columns of these names."""
    own = docs.columns
    renamed = docs.toDF(*[f"__{n}" if n in names else n for n in own])
    return step(renamed).drop(*names).toDF(*own)


def bucket_of(doc_id, modulus: int):
    """crc32 of the id's text, modulo ``modulus``: the fold that decides which rows may teach a model."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled documents of either class outside fold ``held``: (doc_id, text, y).

    Ids come in the order of a hash, so the sample is the same in every run. The id list is bounded by the parameter
    (2 * per_class rows), which is why it may be broadcast; it stays a plan, since rows made from a list in the driver
    would have workers of another kind started for them. Rows with a null id, label or text teach nothing.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (bucket_of("doc_id", modulus) != held))
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).join(docs.where(F.col("text").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
    mixed = F.xxhash64("doc_id", F.lit(label))
    ordinary, marked = (usable.where(F.col("y") == y).orderBy(mixed, "doc_id").limit(per_class) for y in (0, 1))
    ids = ordinary.union(marked).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")
