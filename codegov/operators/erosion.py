"""Boundaries that erode: violations of a layer whose files also change often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pattern_tables import glob_join
from ..functions.ranking import placed

#: The rules whose findings are violations of a boundary.
COUPLING = r"^coupling/(pure-imports|layer-imports)@v\d+$"


def findings_for(findings: DataFrame, needed: list[str]) -> DataFrame:
    """The findings of the rules that an insight asks for, with or without instance or version."""
    keep = F.lit(False)
    for n in needed:
        keep = keep | (F.col("rule_id") == n) | F.col("rule_id").startswith(n + ":") | F.col("rule_id").startswith(n + "@")
    return findings.where(keep)


def boundaries(findings: DataFrame) -> DataFrame:
    """(boundary, root, violation_count, sample): coupling findings per boundary, the text after the instance's colon.

    ``findings``: (rule_id, instance_id, fingerprint, package_root, dependency). The root is that of the first finding
    with package facts, else the boundary itself; the sample is the first with a dependency, else the first.
    """
    rows = findings.where(F.col("rule_id").rlike(COUPLING) & F.col("instance_id").contains(":")).withColumn("boundary", F.regexp_replace("instance_id", "^[^:]*:", ""))
    found = rows.groupBy("boundary").agg(
        F.min_by("package_root", F.when(F.col("package_root").isNotNull(), F.col("fingerprint"))).alias("pkg"), F.count(F.lit(1)).alias("violation_count"), F.min_by("fingerprint", F.struct(F.col("dependency").isNull(), "fingerprint")).alias("sample")
    )
    return found.select("boundary", F.coalesce(F.concat("pkg", F.lit("/**")), "boundary").alias("root"), "violation_count", "sample")


def erosion(bounds: DataFrame, churn: DataFrame) -> DataFrame:
    """(boundary, churn_total, hot_files, hottest, violation_count, sample, place) of the boundaries with churn, worst first.

    Roots are any globs; changed paths meet them by a join on literal pieces. ``place`` counts from 1: boundaries are
    ranked through range partitions, so no task has them all.
    """
    hot = glob_join(churn.select("path", "count"), bounds, column="root")
    found = hot.groupBy("boundary").agg(F.sum("count").alias("churn_total"), F.count(F.lit(1)).alias("hot_files"), F.min_by("path", F.struct(-F.col("count"), "path")).alias("hottest"), F.first("violation_count").alias("violation_count"), F.first("sample").alias("sample"))
    return placed(found.where("churn_total > 0").withColumn("worst", -F.col("churn_total")), "worst", "boundary").drop("worst")
