"""The folder that driver and executors share, for checkpoints and tables between jobs."""

from __future__ import annotations

import gc
import re
import uuid
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one only where all is one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, a tenth or less of what ``checkpointed`` writes; it stays until ``dropped``.

    Spark takes it for as small as its compressed files, so joins with it need a hint that they aren't to broadcast it.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes what ``kept`` has written; nothing that is read later may need it."""
    jvm, folders = df.sparkSession.sparkContext._jvm, {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def tidied(spark: SparkSession) -> None:
    """Lets go of what finished jobs have shuffled: Spark removes it only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
