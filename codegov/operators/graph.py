"""Enclosing packages and functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors

#: Lines per bucket of the range join.
BUCKET = 64


def nearest_package(files: DataFrame, packages: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path, name, root_path): the package of the deepest directory above each file; once per directory."""
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    homes = files.select(*keys, folder.alias("folder")).distinct().withColumn("up", F.explode(F.concat(F.array("folder"), ancestors(F.col("folder")))))
    found = homes.join(packages.select(*keys, F.col("root_path").alias("up"), "name"), [*keys, "up"])
    best = found.groupBy(*keys, "folder").agg(F.max_by(F.struct("name", F.col("up").alias("root_path")), F.length("up")).alias("p"))
    return files.withColumn("folder", folder).join(best, [*keys, "folder"]).select(*keys, "path", "p.name", "p.root_path")


def parse_range(text: Column) -> dict[str, Column]:
    """Parts of ``file:startLine:startColumn:endLine:endColumn``; ``?`` is null, a missing end is the start."""
    part = lambda k: F.get(F.split(text, ":"), F.lit(k)).try_cast("int")
    return {"file_index": part(0), "sl": part(1), "sc": part(2), "el": F.coalesce(part(3), part(1)), "ec": F.coalesce(part(4), part(2))}


def _inside(functions: DataFrame, calls: DataFrame, keys: tuple[str, ...], module: bool) -> DataFrame:
    """(keys, call_idx, cl, cc, fun_idx, size): every call with every function range that holds its start."""
    ranges = functions.where(F.col("sl").isNotNull() & ~(F.lit(module) & (F.col("sl") == 1) & (F.col("sc") == 1))).select(*keys, "fun_idx", "sl", "sc", "el", "ec")
    ranges = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("sl") / BUCKET), F.floor(F.greatest("el", "sl") / BUCKET))))
    x = calls.where("cl is not null").withColumn("bucket", F.floor(F.col("cl") / BUCKET)).join(ranges, [*keys, "bucket"])
    inside = F.col("cl").between(F.col("sl"), F.col("el")) & ((F.col("cl") != F.col("sl")) | (F.col("cc") >= F.col("sc"))) & ((F.col("cl") != F.col("el")) | (F.col("cc") <= F.col("ec")))
    size = (F.col("el") - F.col("sl")).cast("long") * 100000 + (F.col("ec") - F.col("sc"))
    return x.where(inside).select(*keys, "call_idx", "cl", "cc", "fun_idx", size.alias("size"))


def containers(functions: DataFrame, calls: DataFrame, keys: tuple[str, ...] = ("file",), module: bool = True) -> DataFrame:
    """(keys, call_idx, fun_idx): the smallest function range that holds a call's start; the first wins ties.

    ``functions``: (keys, fun_idx, sl, sc, el, ec); ``calls``: (keys, call_idx, cl, cc). Ranges are dealt to the line
    buckets that they touch, so a huge file is many join keys. Unknown starts go, and with ``module`` the module's own range.
    """
    return _inside(functions, calls, keys, module).groupBy(*keys, "call_idx").agg(F.min_by("fun_idx", F.struct("size", "fun_idx")).alias("fun_idx"))


def enclosing_function(functions: DataFrame, calls: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(call_idx, fun_idx) as of ``containers``, for calls that are numbered over all files: a number that several files have is one call."""
    return _inside(functions, calls, keys, True).groupBy("call_idx").agg(F.min_by("fun_idx", F.struct("size", "fun_idx")).alias("fun_idx"))


def call_edges(functions: DataFrame, calls: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys, caller_id, callee_id, line, column): a row for every resolved target of every call.

    ``targets``: (call_idx, callee_idx). A function's id is ``file:line:column`` with columns from 0. A call outside every
    function has no caller and goes, as does a target that is unknown, without a start, or a module's own range. A number
    that several places have is one call, at the place with the smallest range; of equal ones the first place.
    """
    known = functions.where(F.col("sl").isNotNull() & ~((F.col("sl") == 1) & (F.col("sc") == 1)))
    names = known.select("fun_idx", F.concat_ws(":", *keys, F.col("sl").cast("string"), (F.col("sc") - 1).cast("string")).alias("id"))
    best = F.min(F.struct("size", "fun_idx", *keys, "cl", "cc")).alias("s")
    calls = _inside(functions, calls, keys, True).groupBy("call_idx").agg(best)
    found = calls.select("call_idx", "s.fun_idx", *(F.col("s")[k].alias(k) for k in keys), F.col("s.cl").alias("line"), (F.col("s.cc") - 1).alias("column")).join(targets, "call_idx")
    found = found.join(names.withColumnRenamed("id", "caller_id"), "fun_idx")
    return found.join(names.select(F.col("fun_idx").alias("callee_idx"), F.col("id").alias("callee_id")), "callee_idx").select(*keys, "caller_id", "callee_id", "line", "column")
