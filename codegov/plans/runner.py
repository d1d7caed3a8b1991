"""Collectors, enrichers, rules and insights as plain functions over tables, composed lazily."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import count_findings, evidence
from ..operators.erosion import findings_for
from ..operators.grouping import merge_facts

#: Tables by key; a fact that is no table is a single value.
Facts = dict[str, Any]


@dataclass(frozen=True)
class Collector:
    id: str
    provides: tuple[str, ...]
    collect: Callable[[tuple[str, ...]], Facts]


@dataclass(frozen=True)
class Enricher:
    id: str
    needs: tuple[str, ...]
    provides: tuple[str, ...]
    enrich: Callable[[Facts], Facts]


@dataclass(frozen=True)
class Rule:
    """``evaluate`` returns (rule_id, instance_id, fingerprint, message, artifacts, ord)."""

    id: str
    needs: tuple[str, ...]
    evaluate: Callable[[Facts], DataFrame]
    #: (warning) rows about the rule's own settings, such as patterns that match nothing.
    warn: Callable[[Facts], DataFrame] | None = None


@dataclass(frozen=True)
class Insight:
    id: str
    needs_rules: tuple[str, ...]
    analyze: Callable[[DataFrame], DataFrame]


@dataclass
class Result:
    findings: DataFrame | None = None
    evidence: DataFrame | None = None
    warnings: DataFrame | None = None
    skipped: list[str] = field(default_factory=list)


def check(parts, what: str) -> None:
    ids = [p.id for p in parts]
    if any(not i for i in ids) or len(set(ids)) != len(ids):
        raise ValueError(f"every {what} needs an id of its own")
    for p in parts:
        if what != "insight" and not (p.needs if what == "rule" else p.provides):
            raise ValueError(f"{what} {p.id} names no facts")


def gather(collectors: list[Collector], needed: set[str]) -> Facts:
    """The needed facts of all collectors; tables of one key are united in registration order, of single values the last wins."""
    tables: dict[str, list] = {}
    for c in collectors:
        wanted = tuple(k for k in c.provides if k in needed)
        for k, fact in (c.collect(wanted) if wanted else {}).items():
            held = tables.setdefault(k, [])
            if not (isinstance(fact, DataFrame) and all(isinstance(x, DataFrame) for x in held)):
                held.clear()  # a value takes the place of what was there, and a table that of a value
            held.append(fact)
    return {k: v[0] if len(v) == 1 else merge_facts(*v).drop("source_order") for k, v in tables.items()}


def run(collectors: list[Collector], rules: list[Rule], enrichers: list[Enricher] | None = None) -> Result:
    """Facts, enriched facts, findings: one row per fingerprint, and their evidence as rows. A rule without its facts is skipped.

    Enrichers all see the collected facts. Findings of rules that need enriched facts are marked for verification.
    """
    enrichers = enrichers or []
    check(collectors, "collector")
    check(rules, "rule")
    check(enrichers, "enricher")
    if not collectors or not rules:
        return Result()
    needed = {k for r in rules for k in r.needs}
    needed |= {k for e in enrichers if needed & set(e.provides) for k in e.needs}
    facts = gather(collectors, needed)
    scored: set[str] = set()
    added: Facts = {}
    for e in enrichers:
        if all(k in facts for k in e.needs):
            added |= e.enrich({k: facts[k] for k in e.needs})
            scored |= set(e.provides)
    facts |= added
    result, found, sites, warned = Result(), [], [], []
    for k, r in enumerate(rules):
        if not all(x in facts for x in r.needs):
            result.skipped.append(r.id)
            continue
        if r.warn is not None:
            warned.append(r.warn({x: facts[x] for x in r.needs}).select(F.lit(r.id).alias("rule"), "warning"))
        rows = r.evaluate({x: facts[x] for x in r.needs}).select("rule_id", "instance_id", "fingerprint", "message", "artifacts", "ord").withColumn("requires_verification", F.lit(bool(scored & set(r.needs))))
        sites.append(rows.drop("ord"))
        found.append(count_findings(rows).withColumn("__rule", F.lit(k)))  # each rule has an order of its own
    if warned:
        result.warnings = reduce(DataFrame.unionByName, warned)
    if found:
        # a fingerprint of several rules is one finding, of the rule that was named first
        first = F.min(F.struct("__rule", "rule_id", "instance_id", "message", "requires_verification")).alias("f")
        both = reduce(DataFrame.unionByName, found).groupBy("fingerprint").agg(first, F.sum("n").alias("n"))
        result.findings = both.select("fingerprint", "f.rule_id", "f.instance_id", "f.message", "f.requires_verification", "n")
        result.evidence = evidence(reduce(DataFrame.unionByName, sites))
    return result


def insights(findings: DataFrame, parts: list[Insight]) -> dict[str, DataFrame]:
    """Each insight over the findings that it asks for."""
    check(parts, "insight")
    return {p.id: p.analyze(findings_for(findings, list(p.needs_rules))) for p in parts}
