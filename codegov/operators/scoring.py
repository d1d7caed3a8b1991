"""Batched scoring of candidates with a pluggable scorer and a result cache."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cache_plan(items: DataFrame, cache: DataFrame) -> DataFrame:
    """(cache_key, part): hit, miss or stale, for every key of either side."""
    left, right = items.select("cache_key").distinct().withColumn("i", F.lit(True)), cache.select("cache_key").distinct().withColumn("c", F.lit(True))
    both = left.join(right, "cache_key", "full_outer")
    return both.select("cache_key", F.when(F.col("i").isNull(), "stale").when(F.col("c").isNull(), "miss").otherwise("hit").alias("part"))


def merge_results(items: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """(original_index, cache_key, confidence, cached): cached and new results in the items' own order.

    ``cache``: (cache_key, confidence), one row a key; ``fresh``: (original_index, confidence) of the items that missed.
    The order is a range partitioning, so no task holds all items.
    """
    hits = items.select("original_index", "cache_key").join(cache.select("cache_key", "confidence"), "cache_key").withColumn("cached", F.lit(True))
    new = items.select("original_index", "cache_key").join(fresh.select("original_index", "confidence"), "original_index").withColumn("cached", F.lit(False))
    names = ["original_index", "cache_key", "confidence", "cached"]
    return hits.select(*names).unionByName(new.select(*names)).orderBy("original_index")


def next_cache(merged: DataFrame) -> DataFrame:
    """(cache_key, confidence): the cache after a run. What no item used is gone; of equal keys the first item's result stays."""
    return merged.groupBy("cache_key").agg(F.min_by("confidence", "original_index").alias("confidence"))


def _walk(tokens: list[int], budget: int, max_items: int, used: int = 0, count: int = 0) -> list[int]:
    """For each item, 1 if a batch starts with it, else 0; the batch before has ``used`` tokens of ``count`` items."""
    out = []
    for t in tokens:
        new = count and used + t > budget or count >= max_items
        used, count = (t, 1) if new else (used + t, count + 1)
        out.append(int(new))
    return out


def _exits(tokens: list[int], budget: int, max_items: int) -> list[tuple[int, int, int, int]]:
    """(first, batches, used, count): batches from a start at the item ``first`` on, and the last one's tokens and items.

    Starts are those that a batch from before can leave: the first ``max_items`` items, or the one after.
    """
    n, ends = len(tokens), [0] * (len(tokens) + 1)
    total = [0, *accumulate(tokens)]
    end = n
    for k in range(n - 1, -1, -1):
        while end > k + 1 and (total[end] - total[k] > budget or end - k > max_items):
            end -= 1
        ends[k] = end
    number, last = [0] * (n + 1), [n] * (n + 1)
    for k in range(n - 1, -1, -1):
        number[k], last[k] = (1, k) if ends[k] == n else (1 + number[ends[k]], last[ends[k]])
    return [(k, number[k], total[n] - total[last[k]], n - last[k]) for k in range(min(n, max_items + 1))]


def batches(items: DataFrame, budget: int, max_items: int, chunk_items: int = 100_000) -> DataFrame:
    """``items`` with pack_group and batch_no: in order, a batch ends when the next item would exceed tokens or count.

    An item above the budget stands alone, an exact fit stays. All items are one sequence, in tasks of about
    ``chunk_items``: a task says for each item where a batch may start first how its batches end, the driver carries the
    open batch from chunk to chunk over those few rows, and each chunk is walked from there. Only index and tokens are
    dealt out; ``original_index`` is unique, so other columns come back by it.
    """
    slim = items.select("original_index", "tokens")
    chunks = -(-slim.count() // chunk_items)
    bounds = slim.agg(F.percentile_approx("original_index", [k / chunks for k in range(1, chunks)], max(10_000, 10 * chunks))).first()[0] if chunks > 1 else []
    edges = np.array(sorted(set(bounds)), dtype="int64")

    @F.pandas_udf("int")
    def chunk(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, at.to_numpy(), side="left").astype("int32"))

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values("original_index", kind="stable")

    dealt = slim.withColumn("chunk", chunk("original_index"))

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = ordered(rows)["tokens"].tolist()
        found = pd.DataFrame(_exits(tokens, budget, max_items), columns=["first", "batches", "used", "count"])
        return found.assign(tokens=(tokens + [0])[: len(found)], chunk=rows["chunk"].iloc[0], size=len(tokens))

    state: dict[int, tuple[int, int, int]] = {0: (0, 0, 0)}
    if chunks > 1:
        number, used, count = 0, 0, 0
        said = dealt.groupBy("chunk").applyInPandas(ends, "first long, batches long, used long, count long, tokens long, chunk int, size long").toPandas()
        for k, rows in said.sort_values(["chunk", "first"]).groupby("chunk"):
            state[int(k)] = (number, used, count)
            starts = _walk(rows["tokens"].tolist(), budget, max_items, used, count)
            if 1 in starts:
                row = rows.iloc[starts.index(1)]
                number, used, count = number + int(row["batches"]), int(row["used"]), int(row["count"])
            elif len(rows) == rows["size"].iloc[0]:
                used, count = used + int(rows["tokens"].sum()), count + len(rows)
            else:
                raise AssertionError("a batch has more items than it may")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = ordered(rows)
        number, used, count = state[int(rows["chunk"].iloc[0])]
        starts = np.cumsum(_walk(rows["tokens"].tolist(), budget, max_items, used, count))
        return rows[["original_index", "tokens"]].assign(batch_no=(number + starts).astype("int32"))

    kinds = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in slim.columns)
    numbered = dealt.groupBy("chunk").applyInPandas(run, f"{kinds}, batch_no int")
    if set(items.columns) != set(slim.columns):
        numbered = numbered.drop("tokens").join(items, "original_index")
    return numbered.select(*items.columns, F.lit(0).alias("pack_group"), "batch_no")


def score_batches(packed: DataFrame, scorer: Callable[[list[str], list[str]], list[tuple[str, float]]]) -> DataFrame:
    """(cache_key, original_index, confidence): one scorer call per batch.

    A scorer takes keys and texts and returns (key, confidence) pairs in any order; a wrong number of them, or a key
    that is missing, is an error.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["cache_key"].tolist()
        found = scorer(keys, rows["serialized"].tolist())
        if len(found) != len(keys):
            raise ValueError(f"the scorer returned {len(found)} results for {len(keys)} items")
        by = dict(found)
        if lost := [k for k in keys if k not in by]:
            raise ValueError(f"the scorer returned no result for {lost[0]}")
        return pd.DataFrame({"cache_key": keys, "original_index": rows["original_index"], "confidence": [float(by[k]) for k in keys]})

    return packed.groupBy("pack_group", "batch_no").applyInPandas(run, "cache_key string, original_index long, confidence double")


def usage(rows: DataFrame) -> DataFrame:
    """Totals of tokens and cost over all batches."""
    return rows.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))
