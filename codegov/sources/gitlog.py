"""Exported git logs as commit and change tables.

A record starts with ``COMMIT\\x01hash\\x01author\\x01email\\x01date\\x01subject``; lines ``STATUS\\tpath`` or
``R90\\told\\tnew`` follow. Records with a missing field, unknown letters, lines without a tab and renames without both
paths are dropped. A bad record's lines go with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Status letters (fixed values).
STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied"}


def status_word(letter: Column, strict: bool = False) -> Column:
    """The word of a status letter; null, or an error in the strict form, where it is unknown."""
    table = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    word = F.element_at(table, letter)
    return F.coalesce(word, F.raise_error(F.concat(F.lit("unknown status "), letter)).cast("string")) if strict else word


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row per record of the log files."""
    return spark.read.option("lineSep", "\nCOMMIT\x01").text(path)


def parse_records(records: DataFrame) -> DataFrame:
    """(hash, author, author_email, date, subject, lines) of the valid records; other columns pass through."""
    body = F.regexp_replace("value", "^COMMIT\x01", "")
    head = F.substring_index(body, "\n", 1)
    part = lambda k: F.get(F.split(head, "\x01", 5), F.lit(k))
    started = F.col("value").startswith("COMMIT\x01") | F.col("value").contains("\x01")
    rows = records.where(started).select(
        *[c for c in records.columns if c != "value"], part(0).alias("hash"), part(1).alias("author"), part(2).alias("author_email"), F.try_to_timestamp(part(3)).alias("date"), F.coalesce(part(4), F.lit("")).alias("subject"), F.slice(F.split(body, "\n"), 2, 1 << 30).alias("lines"), F.size(F.split(head, "\x01")).alias("parts")
    )
    full = (F.col("hash") != "") & (F.col("author") != "") & (F.col("author_email") != "") & F.col("date").isNotNull() & (F.col("parts") >= 5)
    return rows.where(full).drop("parts")


def commits(parsed: DataFrame) -> DataFrame:
    return parsed.drop("lines")


def file_changes(parsed: DataFrame) -> DataFrame:
    """(hash, path, status, old_path) and the commit's date, so that windows need no join."""
    keys = [c for c in parsed.columns if c not in ("author", "author_email", "subject", "lines")]
    rows = parsed.select(*keys, F.explode("lines").alias("line")).where(F.col("line").contains("\t"))
    parts = F.split("line", "\t")
    letter = F.substring("line", 1, 1)
    moved = letter.isin("R", "C")
    rows = rows.select(*keys, status_word(letter).alias("status"), F.when(moved, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"), F.when(moved, F.get(parts, F.lit(1))).alias("old_path"), moved.alias("moved"))
    return rows.where(F.col("status").isNotNull() & (F.coalesce("path", F.lit("")) != "") & (~F.col("moved") | (F.coalesce("old_path", F.lit("")) != ""))).drop("moved")
