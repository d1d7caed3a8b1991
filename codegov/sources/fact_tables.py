"""Fact tables of many repositories, bucketed so that merging, keep-first and joins of one file's facts shuffle nothing.

Every kind leads with ``repo``. A repository may hold any share of all facts, so buckets go by repository and file (and
name, where facts meet by name), never by repository alone. Projects of one repository append to the same table with
their place in the order of registration.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouping import keep_first

BUCKETS = 16
#: What facts of a kind are bucketed by; every kind's identity holds these columns.
BUCKETED = {"constants": ("repo", "file"), "depends_on": ("repo", "from_path"), "function_signatures": ("repo", "file", "name"), "positional_sources": ("repo", "file", "name"), "positional_accesses": ("repo", "of_file", "of_name"), "algorithmic_bindings": ("repo", "file")}


def table_name(folder: str, kind: str) -> str:
    return f"facts_{sha256(folder.encode()).hexdigest()[:16]}_{kind}"


def append_facts(facts: DataFrame, kind: str, folder: str, project: int, buckets: int = BUCKETS) -> None:
    """Adds a project's facts; ``project`` is its place among the registered ones. One file a bucket."""
    by = BUCKETED[kind]
    rows = facts.withColumn("source_order", F.lit(project)).repartition(buckets, *by)
    rows.write.mode("append").format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", f"{folder}/{kind}").saveAsTable(table_name(folder, kind))


def merged(spark: SparkSession, kind: str, folder: str) -> DataFrame:
    """The facts of all projects; of equal ones the first registered project's stays. No shuffle: buckets hold whole identities."""
    rest = tuple(c for c in BUCKETED[kind] if c in ("repo", "of_file", "of_name"))
    return keep_first(spark.table(table_name(folder, kind)), kind, "source_order", rest)
