"""Facts of unchanged files taken from a table of earlier runs; only the rest is extracted.

An entry's key is a hash of a file's content, the project's settings, the kind of fact and what else the extraction
depends on. Facts are kept without their file, so equal contents share an entry. The table is partitioned by the first
digits of the key: a run replaces the partitions that get new entries or lose stale ones, and no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

#: Hexadecimal digits of a key that name its partition.
DIGITS = 2


def entry_key(content: Column, settings: str, fact: str, context: str = "") -> Column:
    """Twice hashed: the inner hash is over the content and everything else that the facts depend on."""
    return F.sha2(F.sha2(F.concat_ws("-", F.coalesce(content, F.lit("")), F.lit(settings), F.lit(fact), *([F.lit(context)] if context else [])), 256), 256)


def read_entries(like: DataFrame, folder: str, fact: str, schema: str) -> DataFrame:
    """(cache_key, part, item): the entries of a fact; an entry without facts is one row whose item is null."""
    spark = like.sparkSession
    kind = f"cache_key string, item struct<{schema}>, part string"
    try:
        return spark.read.schema(kind).parquet(f"{folder}/{fact}").where("cache_key is not null")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], kind)
        raise


def collect(sources: DataFrame, extract: Callable[[DataFrame], DataFrame], folder: str, fact: str, schema: str, settings: str = "", context: str = "") -> tuple[DataFrame, DataFrame]:
    """(facts, plan): the facts of all sources with their keys, and (cache_key, part) with hit, miss or stale of every entry.

    ``sources``: (keys, content); ``extract`` turns (cache_key, content) into (cache_key, facts of ``schema``). The cache
    is brought up to date before this returns: what was missing is added, and what no source needs any more is gone.
    """
    keys = [c for c in sources.columns if c != "content"]
    keyed = sources.withColumn("cache_key", entry_key(F.col("content"), settings, fact, context))
    names = [f.name for f in sources.sparkSession.createDataFrame([], schema).schema]
    old = read_entries(sources, folder, fact, schema)
    wanted, held = checkpointed(keyed.select("cache_key").distinct()), old.select("cache_key").distinct()
    state = F.when(F.col("w").isNull(), "stale").when(F.col("h").isNull(), "miss").otherwise("hit")
    plan = checkpointed(wanted.withColumn("w", F.lit(1)).join(held.withColumn("h", F.lit(1)), "cache_key", "full_outer").select("cache_key", state.alias("part")))
    missing = plan.where("part = 'miss'").select("cache_key")
    texts = keyed.join(missing, "cache_key", "left_semi").groupBy("cache_key").agg(F.min("content").alias("content"))  # equal for equal keys
    found = extract(texts).select("cache_key", F.struct(*names).alias("item"))
    digits = F.substring("cache_key", 1, DIGITS)
    # an entry without facts is an entry too
    new = checkpointed(missing.join(found, "cache_key", "left").select("cache_key", "item", digits.alias("part")))
    touched = plan.where("part != 'hit'").select(digits.alias("part")).distinct()
    stays = plan.where("part = 'hit'").select("cache_key")
    kept = old.join(touched, "part", "left_semi").join(stays, "cache_key", "left_semi").select("cache_key", "item", "part")
    hits = checkpointed(old.join(stays, "cache_key", "left_semi").select("cache_key", "item"))
    # a partition that loses all its entries is replaced by one without any
    empty = touched.select(F.lit(None).cast("string").alias("cache_key"), F.lit(None).cast(f"struct<{schema}>").alias("item"), "part")
    rows = checkpointed(kept.unionByName(new).unionByName(empty))
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/{fact}")
    items = hits.unionByName(new.select("cache_key", "item")).where("item is not null")
    return keyed.select(*keys, "cache_key").join(items, "cache_key").select(*keys, "cache_key", "item.*"), plan
