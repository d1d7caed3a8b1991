"""Churn over commit history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import matches
from ..functions.identity import artifact, fingerprint

CHURN = "git/churn@v1"


def recent_commits(commits: DataFrame, as_of: datetime, since_days: int | None = None, max_commits: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The commits of the last days, and of these the newest ones (per key, if there are keys)."""
    if since_days is not None:
        commits = commits.where(F.col("date") >= F.lit(as_of) - F.make_interval(days=F.lit(since_days)))
    if max_commits is None:
        return commits
    if not keys:
        return commits.orderBy(F.col("date").desc(), "hash").limit(max_commits)
    newest = Window.partitionBy(*keys).orderBy(F.col("date").desc(), "hash")
    return commits.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= max_commits).drop("__n")


def changes_in_window(commits: DataFrame, changes: DataFrame, as_of: datetime, window_days: int = 90, keys: tuple[str, ...] = ()) -> DataFrame:
    """The change rows of commits in the window; a row stays as often as it is listed, unknown hashes go."""
    return changes.join(recent_commits(commits, as_of, window_days).select(*keys, "hash"), [*keys, "hash"], "left_semi")


def churn_counts(commits: DataFrame, changes: DataFrame, as_of: datetime, window_days: int = 90, exclude: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path, count); excludes apply before the count, which combines before its shuffle."""
    kept = changes_in_window(commits, changes, as_of, window_days, keys)
    if exclude:
        kept = kept.where(~matches(F.col("path"), exclude))
    return kept.groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("count"))


def churn_findings(counts: DataFrame, threshold: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    return counts.where(F.col("count") >= threshold).select(
        *keys, F.lit(CHURN).alias("rule_id"), F.lit(CHURN).alias("instance_id"), fingerprint(CHURN, path=F.col("path")).alias("fingerprint"),
        F.concat("path", F.lit(" changed "), F.col("count").cast("string"), F.lit(" times")).alias("message"),
        F.array(artifact("churn", path=F.col("path"), count=F.col("count"))).alias("artifacts"), "path", "count",
    )


def rolling_churn(commits: DataFrame, changes: DataFrame, window_days: int = 90, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path, hash, date, count): changes of a path in the days up to each of its commits."""
    dated = changes.join(commits.select(*keys, "hash", "date"), [*keys, "hash"])
    back = Window.partitionBy(*keys, "path").orderBy(F.unix_seconds("date")).rangeBetween(-window_days * 86400, 0)
    return dated.select(*keys, "path", "hash", "date", F.count(F.lit(1)).over(back).alias("count"))
