"""Patterns as tables: many globs against many paths by equijoins on what is literal in a pattern.

A pattern is found by one literal piece of it: the whole of it if it has no wildcard, the longest of its leading
directories and its literal segments, or the extension of its last segment. A path has all pieces that could lead to it:
itself, its directories, its segments and its extensions. Pairs that share a piece are checked by the pattern's regular
expression. A pattern without any literal piece, or a negated one, meets every path, as it has to.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .globs import MAGIC, glob_to_regex, is_glob
from .paths import ancestors

#: Parts into which all paths are dealt for patterns that meet every path.
PARTS = 16
#: Patterns that are sent to every task; of more of them both sides of a join are dealt by its key.
FEW = 10_000
_EXTENSION = re.compile(r"[*?\]}](\.[^*?\[\]{}/]+)$")


def piece(pattern: str) -> tuple[str, str, str | None, bool]:
    """(kind, value, regex, negated): how a pattern is found and checked; without a regex the piece decides."""
    negated, plain = pattern.startswith("!"), pattern.removeprefix("!")
    regex = glob_to_regex(plain) if is_glob(plain) else "^" + re.sub(r"([^\w/])", r"\\\1", plain) + "$"
    if negated:
        return "any", "", regex, True
    if not is_glob(plain):
        return "path", plain, None, False
    parts = plain.split("/")
    fixed = next(k for k, p in enumerate(parts) if MAGIC.search(p) or "{" in p)
    # braces and brackets may hold slashes, so only what stands before the first of them is taken apart
    whole = not re.search(r"[{\[][^}\]]*/", plain)
    found = [("folder", "/".join(parts[:fixed]))] if fixed else []
    found += [("segment", p) for p in parts[fixed:] if whole and p and not MAGIC.search(p)]
    if found:
        return *max(found, key=lambda x: len(x[1])), regex, False
    if whole and (m := _EXTENSION.search(parts[-1])):
        return "extension", m[1], regex, False
    return "any", "", regex, False


def indexed(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """``patterns`` with (kind, piece, regex, negated); a row of Python a pattern, none a path."""
    fields = "kind string, piece string, regex string, negated boolean"

    def work(batches):
        for b in batches:
            rows = [piece(p) for p in b.column(column).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(c), pa.bool_() if k == 3 else pa.string()) for k, c in enumerate(cols))], [*b.schema.names, "kind", "piece", "regex", "negated"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patterns.schema.fields)
    return patterns.where(F.col(column).isNotNull()).mapInArrow(work, f"{kept}, {fields}")


def pieces(path: Column) -> Column:
    """All (kind, piece) under which a path is found, for patterns of literal pieces."""
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("piece")))
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    dots = F.split(name, r"\.")
    tails = F.when(F.size(dots) > 1, F.transform(F.sequence(F.lit(2), F.size(dots)), lambda k: F.concat(F.lit("."), F.array_join(F.slice(dots, k, F.size(dots)), "."))))
    return F.concat(of("path", F.array(path)), of("folder", F.concat(F.array(path), ancestors(path))), of("segment", F.array_distinct(parts)), of("extension", F.coalesce(tails, F.expr("cast(array() as array<string>)"))))


def _held(patterns: DataFrame) -> tuple[DataFrame, str]:
    """``patterns``, made once, and the hint for joins with them, by their count: Spark's estimate goes by compressed files and would send all pieces of all paths through the driver."""
    patterns = checkpointed(patterns)
    return patterns, "broadcast" if patterns.limit(FEW + 1).count() <= FEW else "merge"


def glob_join(paths: DataFrame, patterns: DataFrame, path: str = "path", column: str = "pattern") -> DataFrame:
    """All pairs of a row of ``paths`` and a row of ``patterns`` whose pattern matches the path, with the columns of both.

    Column names must differ. Only equijoins; up to FEW patterns are broadcast, of more of them skewed pieces are split by
    Spark. Patterns are made and counted when this is called. Those that meet every path are dealt to PARTS parts of the paths.
    """
    return _glob_join(paths, *_held(patterns), path, column)


def _glob_join(paths: DataFrame, patterns: DataFrame, way: str, path: str, column: str) -> DataFrame:
    index = indexed(patterns, column)
    some = index.where("kind != 'any'").hint(way)
    found = paths.withColumn("__p", F.explode(pieces(F.col(path)))).join(some, (F.col("__p.kind") == F.col("kind")) & (F.col("__p.piece") == F.col("piece"))).drop("__p")
    every = index.where("kind = 'any'").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).hint(way)
    dealt = paths.withColumn("__to", F.pmod(F.xxhash64(path), F.lit(PARTS)).cast("int")).join(every, F.col("__to") == F.col("__part")).drop("__to", "__part")
    hit = F.col("regex").isNull() | (F.rlike(F.col(path), F.col("regex")) != F.col("negated"))
    return found.unionByName(dealt).where(hit).drop("kind", "piece", "regex", "negated")


def import_join(targets: DataFrame, patterns: DataFrame, path: str = "to_path", column: str = "pattern") -> DataFrame:
    """Pairs of import targets and import patterns: a name without wildcards matches itself and its sub-paths, a glob as a path."""
    magic = F.rlike(F.col(column), F.lit(r"[*?\[\]{}]|^!"))
    patterns, way = _held(patterns)
    named = patterns.where(~magic).withColumn("__name", F.col(column)).hint(way)
    under = targets.withColumn("__up", F.explode(F.concat(F.array(F.col(path)), ancestors(F.col(path))))).join(named, F.col("__up") == F.col("__name")).drop("__up", "__name")
    return under.unionByName(_glob_join(targets, patterns.where(magic), way, path, column))


def idle(targets: DataFrame, patterns: DataFrame, path: str = "to_path", column: str = "pattern") -> DataFrame:
    """The patterns that match no import of the whole graph; none on an empty graph."""
    hit = import_join(targets.select(path).distinct(), patterns.select(column).distinct(), path, column).select(column).distinct()
    some = targets.agg(F.max(F.col(path).isNotNull())).scalar()
    return patterns.select(column).distinct().join(hit, column, "left_anti").where(some)
