"""Stable identities: canonical JSON, fingerprints, and folding of findings that share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_json(**fields: Column) -> Column:
    """JSON of an object with sorted keys, no spaces, nulls kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def fingerprint(rule_id: str | Column, **identifier: Column) -> Column:
    """Hex SHA-256 of the canonical JSON of rule and identifier; key order doesn't matter, array order does."""
    rule = F.lit(rule_id) if isinstance(rule_id, str) else rule_id
    data = F.struct(*(identifier[k].alias(k) for k in sorted(identifier)))
    return F.sha2(F.to_json(F.struct(data.alias("data"), rule.alias("ruleId")), {"ignoreNullFields": "false"}), 256)


def artifact(kind: str, **data: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), stable_json(**data).alias("data"))


def _first(findings: DataFrame, order: str, keys: tuple[str, ...]) -> tuple[list[str], Column]:
    """The fields of a finding, and the whole first finding: by ``order``, ties by the fields themselves."""
    kept = [c for c in findings.columns if c not in (order, "fingerprint", "artifacts", *keys)]
    return kept, F.min(F.struct(order, *kept)).alias("__first")


def fold_findings(findings: DataFrame, order: str = "ord", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per fingerprint: the first finding's fields, the artifacts of all, sorted by their JSON text.

    For fingerprints of few artifacts: they become one row. ``count_findings`` and ``evidence`` have no such bound.
    """
    kept, first = _first(findings, order, keys)
    out = findings.groupBy(*keys, "fingerprint").agg(first, F.array_sort(F.flatten(F.collect_list("artifacts"))).alias("artifacts"))
    return out.select(*keys, "fingerprint", *(f"__first.{c}" for c in kept), "artifacts")


def count_findings(findings: DataFrame, order: str = "ord", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per fingerprint: the first finding's fields and ``n``, the number of artifacts of all.

    Every aggregate combines before the shuffle, so a fingerprint may have any number of them; ``evidence`` has them.
    """
    kept, first = _first(findings, order, keys)
    out = findings.groupBy(*keys, "fingerprint").agg(first, F.sum(F.size("artifacts")).alias("n"))
    return out.select(*keys, "fingerprint", *(f"__first.{c}" for c in kept), "n")


def evidence(findings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, fingerprint, kind, data): the artifacts of all findings as rows, sorted over range partitions."""
    names = [*keys, "fingerprint", "kind", "data"]
    return findings.select(*keys, "fingerprint", F.inline("artifacts")).repartitionByRange(*names).sortWithinPartitions(*names)


def location(file: Column, line: Column, column: Column | None = None) -> Column:
    return F.concat_ws(":", file, line.cast("string"), *([column.cast("string")] if column is not None else []))


def repeated(values: Column) -> Column:
    """Every occurrence of a value after its first, in order."""
    return F.filter(values, lambda x, i: F.array_position(values, x) - 1 != i)


def union_types(text: Column) -> Column:
    """The distinct members of a union type text."""
    return F.array_distinct(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)))


def guard_text(text: Column) -> Column:
    return F.substring(F.trim(text), 1, 300)


def display(kind: Column, data: Column) -> Column:
    """What a reader sees of an artifact, as a map of texts by kind; fields without a value are left out, an unknown kind is its ``value``."""
    at = lambda name: F.get_json_object(data, f"$.{name}")
    spot = F.concat_ws(":", at("file"), at("line"), at("column"))
    binding = {"location": spot, "role": at("role"), "pattern": at("patternId"), "invariant": at("bindingKey"), "function": at("functionName"), "container": F.coalesce(at("containingFunction"), F.lit("(module-level)"))}
    shown = {
        "churn": {"file": at("path"), "changes": at("count")},
        "import": {"file": spot, "dependency": at("dependency")},
        "literal": {"location": spot},
        "function": {"location": spot, "function": at("name")},
        "source": {"role": F.lit("[Source]"), "location": spot, "identifier": at("name"), "positions": at("positions")},
        "access": {"role": F.lit("[Access]"), "location": spot, "identifier": at("name"), "kind": at("accessKind"), "index": at("index")},
        "binding": binding,
    }
    as_map = lambda fields: F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))
    out = as_map({"value": data})
    for name, fields in shown.items():
        out = F.when(kind == name, as_map(fields)).otherwise(out)
    return F.map_filter(out, lambda _, v: v.isNotNull())
