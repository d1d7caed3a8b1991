"""Paths and import specifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_external(specifier: Column) -> Column:
    return ~specifier.startswith(".")


def resolve(importer: Column, specifier: Column) -> Column:
    """The project path of a relative specifier seen from the importing file, with ``.`` and ``..`` worked off."""
    folder = F.slice(F.split(importer, "/"), 1, F.greatest(F.size(F.split(importer, "/")) - 1, F.lit(0)))
    parts = F.concat(folder, F.split(specifier, "/"))

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when((part == ".") | (part == ""), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")


def ancestors(path: Column) -> Column:
    """The directories above a path, deepest first, without the root."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.when(depth > 0, F.transform(F.sequence(depth, F.lit(1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.expr("cast(array() as array<string>)"))


def module_key(path: Column) -> Column:
    """A path without its source extension and without a trailing ``/index``, so that importers and files compare."""
    return F.regexp_replace(F.regexp_replace(path, r"\.(?:[cm]?[jt]sx?|d\.ts)$", ""), "/index$", "")
