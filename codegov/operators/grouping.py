"""Rules that group facts: shared literals and shared algorithm invariants; merging and de-duplicating facts.

Values such as '' or 0 are everywhere, so groups are judged on counts alone, which combine before the shuffle; evidence
is rows of the groups that qualify, never one row a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import artifact, fingerprint

LITERAL, ALGORITHM = "connascence/meaning@v1", "connascence/algorithm@v1"
#: Binding keys that say nothing (fixed values).
NOISE = (",", "/", "\\")
#: What makes two facts of a kind the same fact.
FACT_KEYS = {
    "constants": ("file", "line", "column", "value"), "depends_on": ("from_path", "line", "column", "to_path"), "function_signatures": ("file", "name", "line", "column"),
    "positional_accesses": ("file", "name", "accessed_index", "line", "column"), "positional_sources": ("file", "name", "line", "column"),
    "algorithmic_bindings": ("file", "pattern_id", "role", "function_name", "binding_key", "line", "column"),
}


def shared_literals(constants: DataFrame, threshold: int = 2, ignored: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, kind, value, files): literals that at least ``threshold`` files (of one repository, with its key) hold."""
    kept = constants.where(~F.col("value").isin(*ignored)) if ignored else constants
    files = kept.select(*keys, "kind", "value", "file").distinct().groupBy(*keys, "kind", "value").agg(F.count(F.lit(1)).alias("files"))
    return files.where(F.col("files") >= threshold)


def _literal_id() -> Column:
    return fingerprint(LITERAL, kind=F.col("kind"), value=F.col("value"))


def literal_counts(constants: DataFrame, threshold: int = 2, ignored: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, rule_id, fingerprint, kind, value, files, n): literals that enough files hold, and their occurrences."""
    kept = constants.where(~F.col("value").isin(*ignored)) if ignored else constants
    per = kept.groupBy(*keys, "kind", "value", "file").agg(F.count(F.lit(1)).alias("n"))
    found = per.groupBy(*keys, "kind", "value").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("n")).where(F.col("files") >= threshold)
    return found.select(*keys, F.lit(LITERAL).alias("rule_id"), _literal_id().alias("fingerprint"), "kind", "value", "files", "n")


def literal_findings(constants: DataFrame, threshold: int = 2, ignored: tuple[str, ...] = (), max_artifacts: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for every occurrence with itself as evidence, or for the first ``max_artifacts`` where that is set.

    Rows of a literal share a fingerprint; ``identity.count_findings`` and ``identity.evidence`` fold them.
    """
    good = shared_literals(constants, threshold, ignored, keys)
    rows = constants.join(good, [*keys, "kind", "value"])
    if max_artifacts is not None:
        order = Window.partitionBy(*keys, "kind", "value").orderBy("file", "line", "column")
        rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_artifacts)
    place = artifact("literal", file=F.col("file"), line=F.col("line"), column=F.col("column"))
    return rows.select(*keys, F.lit(LITERAL).alias("rule_id"), _literal_id().alias("fingerprint"), "kind", "value", "files", F.array(place).alias("artifacts"))


def _telling(bindings: DataFrame, patterns: tuple[str, ...] | None, ignored: tuple[str, ...]) -> DataFrame:
    rows = bindings.where((F.col("binding_key") != "") & ~F.col("binding_key").isin(*NOISE, *ignored))
    if patterns is not None:
        rows = rows.where(F.col("pattern_id").isin(*patterns)) if patterns else rows.limit(0)
    return rows


def shared_algorithms(bindings: DataFrame, patterns: tuple[str, ...] | None = None, ignored: tuple[str, ...] = (), min_files: int = 2, complete_pair: bool = True, same_container: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pattern_id, binding_key, files, roles, fingerprint): the same key bound in several files by complementary roles.

    ``same_container``: some container (the function's name, else the file) must hold two roles itself.
    """
    rows, group = _telling(bindings, patterns, ignored), [*keys, "pattern_id", "binding_key"]
    good = rows.groupBy(*group).agg(F.count_distinct("file").alias("files"), F.count_distinct("role").alias("roles"))
    good = good.where((F.col("files") >= min_files) & ((F.col("roles") >= 2) | F.lit(not complete_pair)))
    if same_container:
        per = rows.groupBy(*group, F.coalesce("containing_function", "file").alias("container")).agg(F.min("role").alias("low"), F.max("role").alias("high"))
        good = good.join(per.where("low != high"), group, "left_semi")
    return good.select(*group, F.col("files").cast("long").alias("files"), F.col("roles").cast("long").alias("roles"), fingerprint(ALGORITHM, patternId=F.col("pattern_id"), bindingKey=F.col("binding_key")).alias("fingerprint"))


def algorithm_findings(bindings: DataFrame, patterns: tuple[str, ...] | None = None, ignored: tuple[str, ...] = (), min_files: int = 2, complete_pair: bool = True, same_container: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rule's rows: one for every binding of what ``shared_algorithms`` finds, with itself as evidence."""
    good = shared_algorithms(bindings, patterns, ignored, min_files, complete_pair, same_container, keys)
    rows = _telling(bindings, patterns, ignored).join(good, [*keys, "pattern_id", "binding_key"])
    at = lambda c: F.col(c) if c in bindings.columns else F.lit(None).cast("string")
    site = artifact("binding", patternId=F.col("pattern_id"), role=F.col("role"), bindingKey=F.col("binding_key"), functionName=at("function_name"), file=F.col("file"), line=at("line"), column=at("column"), containingFunction=at("containing_function"))
    message = F.concat(F.lit("pattern "), F.col("pattern_id"), F.lit(" shares "), F.col("binding_key"), F.lit(" across "), F.col("files").cast("string"), F.lit(" files without a shared abstraction"))
    return rows.select(*keys, F.lit(ALGORITHM).alias("rule_id"), F.lit(ALGORITHM).alias("instance_id"), "fingerprint", message.alias("message"), F.array(site).alias("artifacts"), F.struct(F.col("file"), at("line").alias("line"), at("column").alias("column"), F.col("role")).alias("ord"))


def merge_facts(*sources: DataFrame) -> DataFrame:
    """The rows of several collectors in registration order."""
    ordered = [s.withColumn("source_order", F.lit(k)) for k, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ordered)


def merge_values(*sources: DataFrame) -> DataFrame:
    """(key, value): facts that are single values; of several collectors that supply one, the last registered wins."""
    return merge_facts(*sources).groupBy("key").agg(F.max_by("value", "source_order").alias("value"))


def keep_first(facts: DataFrame, kind: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first of the facts that share a key; min_by combines before the shuffle, where a window would not."""
    names = [*keys, *FACT_KEYS[kind]]
    rest = [c for c in facts.columns if c not in names]
    first = facts.groupBy(*names).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return first.select(*(F.col(c) if c in names else F.col(f"r.{c}").alias(c) for c in facts.columns))
