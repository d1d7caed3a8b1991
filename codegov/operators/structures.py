"""Rules over signatures and positional structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import artifact, fingerprint, repeated

ARGUMENTS, POSITION, SEMANTIC = "connascence/arguments@v1", "connascence/position@v1", "connascence/semantic@v1"


def heterogeneous(types: Column) -> Column:
    return F.size(F.array_distinct(types)) > 1


def argument_findings(signatures: DataFrame, flag_boolean: bool = True, max_arguments: int = 3, only_exported: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Functions with a parameter of type exactly ``boolean``, or with too many parameters."""
    rows = signatures.where("exported") if only_exported else signatures
    flag = F.exists("parameters", lambda p: p["type"] == "boolean") if flag_boolean else F.lit(False)
    long = F.size("parameters") > max_arguments
    params = F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.lit(": "), p["type"])), ", ")
    return rows.where(flag | long).select(
        *keys, fingerprint(ARGUMENTS, function=F.col("name"), params=params).alias("fingerprint"), F.col("name").alias("function"), params.alias("params"), flag.alias("has_flag"), long.alias("is_long"),
        F.array(artifact("function", file=F.col("file"), line=F.col("line"), name=F.col("name"))).alias("artifacts"), F.struct("file", "line", "column").alias("ord"),
    )


def origin(accesses: DataFrame) -> DataFrame:
    """``accesses`` with of_file and of_name, what they read: their origin where they have one, else themselves."""
    has_origin = F.col("origin_file").isNotNull() | F.col("origin_name").isNotNull()
    return accesses.withColumns({"of_file": F.when(has_origin, F.col("origin_file")).otherwise(F.col("file")), "of_name": F.when(has_origin, F.col("origin_name")).otherwise(F.col("name"))})


def position_findings(sources: DataFrame, accesses: DataFrame, only_heterogeneous: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Positional structures that are read by index; an access counts for its origin where it has one.

    A row for every access and one for each source that is read, with themselves as evidence, since a structure may be
    read anywhere; rows of a structure share a fingerprint, and ``identity.count_findings`` and ``identity.evidence``
    fold them. ``accesses`` may have what they read already (``origin``), so that bucketed tables meet as they lie.
    """
    left = sources.where("is_heterogeneous") if only_heterogeneous else sources
    right = accesses if "of_file" in accesses.columns else origin(accesses)
    at = lambda rows, c, kind="string": F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    by, names = [*keys, "of_file", "of_name"], left.select(*keys, F.col("file").alias("of_file"), F.col("name").alias("of_name")).distinct()
    order = lambda rows, k: F.struct(F.lit(k).alias("k"), F.col("file").alias("file"), at(rows, "line", "int").cast("int").alias("line"))
    reads = right.join(names, by).select(*by, F.lit("access").alias("what"), F.array(artifact("access", file=F.col("file"), name=F.col("name"), index=F.col("accessed_index"), line=F.col("line"))).alias("artifacts"), order(right, 1).alias("ord"), F.col("file").alias("at_file"))
    read = right.select(*by).distinct().withColumnsRenamed({"of_file": "file", "of_name": "name"})
    first = artifact("source", file=F.col("file"), name=F.col("name"), line=at(left, "line"), column=at(left, "column"), positions=at(left, "positions").cast("string"))
    own = left.join(read, [*keys, "file", "name"], "left_semi").select(*keys, F.col("file").alias("of_file"), F.col("name").alias("of_name"), F.lit("source").alias("what"), F.array(first).alias("artifacts"), order(left, 0).alias("ord"), F.col("file").alias("at_file"))
    message = F.concat(F.col("of_name"), F.lit(" in "), F.col("of_file"), F.lit(" is read by position"))
    return own.unionByName(reads).select(*keys, F.lit(POSITION).alias("rule_id"), F.lit(POSITION).alias("instance_id"), fingerprint(POSITION, file=F.col("of_file"), name=F.col("of_name")).alias("fingerprint"), message.alias("message"), F.col("of_file").alias("file"), F.col("of_name").alias("name"), "what", "artifacts", "ord")


def candidates(signatures: DataFrame) -> DataFrame:
    """Functions worth scoring: several output types and a return value that occurs more than once."""
    values = F.transform("return_sites", lambda s: s["value"])
    return signatures.where(F.col("output_heterogeneous") & (F.size(F.array_distinct(values)) != F.size(values)))


def semantic_findings(scored: DataFrame, threshold: float) -> DataFrame:
    """Scored candidates of enough confidence, with the values that they return more than once."""
    value = F.array_join(F.transform("return_sites", lambda s: F.concat(s["value"], F.when(s["guard"].isNotNull(), F.concat(F.lit("["), s["guard"], F.lit("]"))).otherwise(""))), "|")
    again = F.array_distinct(repeated(F.transform("return_sites", lambda s: s["value"])))
    return scored.where(F.col("confidence") >= threshold).select(
        fingerprint(SEMANTIC, value=value, kind=F.col("return_type")).alias("fingerprint"), value.alias("value"), F.col("return_type").alias("kind"), F.array_join(again, ", ").alias("repeated"), "confidence", F.array(artifact("function", file=F.col("file"), name=F.col("name"))).alias("artifacts"), F.struct("file", "line", "column").alias("ord")
    )
