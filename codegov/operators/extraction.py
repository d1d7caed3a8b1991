"""Facts from source text: imports, literals and pattern bindings, from one scan of each text inside the tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_external, resolve
from ..sources.shared import checkpointed
from .graph import containers, nearest_package
from .source_scan import Scan

#: Preset matchers: pattern, role, kind of site, callee, index of the argument that binds (fixed values). A template's
#: argument is one of its fixed parts.
PRESETS = (
    ("pack-unpack", "packer", "call", r"\.join$", 0),
    ("pack-unpack", "packer", "template", r"^template-literal$", 0),
    ("pack-unpack", "unpacker", "call", r"\.split$", 0),
    ("file-encoding", "reader", "call", r"^readFile(Sync)?$", 1),
    ("file-encoding", "writer", "call", r"^writeFile(Sync)?$", 2),
    ("hash-algo", "hasher", "call", r"^createHash$", 0),
    ("buffer-encoding", "encoder", "call", r"^Buffer\.from$", 1),
    ("buffer-encoding", "decoder", "call", r"\.toString$", 0),
    ("date-format", "formatter", "call", r"\.toISOString$", None),
    ("date-format", "parser", "new", r"^Date$", 0),
)


def imports_of(text: str) -> list[tuple[str, int, int]]:
    """(specifier, line, column): require calls, dynamic imports, static imports other than of types."""
    scan = Scan(text)
    return [(value, *scan.place(at)) for value, at, _ in sorted(scan.imports, key=lambda x: (x[2], x[1]))]


def literals_of(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, value, line, column): strings and all numbers.

    Specifiers of import and export declarations and names of modules don't count, nor do names of members of interfaces
    and of type literals, nor either side of a comparison with a ``typeof``. An argument of a call counts, also where the
    call is a ``require``, a dynamic import or a decorator's.
    """
    scan = Scan(text)
    return [(kind, value, *scan.place(at)) for kind, value, at in scan.literals]


def template_segments(text: str) -> list[str]:
    """The fixed parts of a template literal's inside; empty ones and a first or last part of white space only go."""
    return [args[0] for _, kind, _, args, at in Scan(f"`{text}`").calls if kind == "template" and not at]


def sites_of(text: str) -> list[tuple]:
    """(what, id, name, arguments, line, column, end_line, end_column): calls, constructions, segments of templates, and functions with their ends.

    Arguments are literals or null; a segment is the one argument of a row of what ``template``.
    """
    scan = Scan(text)
    found = [(kind, k, callee, args, *scan.place(at), None, None) for k, kind, callee, args, at in scan.calls]
    return found + [("function", k, name, None, *scan.place(a), *scan.place(max(a, b - 1))) for k, name, a, b in scan.functions]


def _each(sources: DataFrame, work, fields: str, arrow: list[pa.DataType]) -> DataFrame:
    names = [f.split(" ")[0] for f in fields.split(", ")]
    keys = [c for c in sources.columns if c != "content"]
    kinds = ", ".join(f"{c} {sources.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column("content").to_pylist()):
                found = work(text or "")
                rows += found
                at += [i] * len(found)
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at, pa.int64())) for k in keys), *(pa.array(list(c), t) for c, t in zip(columns, arrow, strict=True))], [*keys, *names])

    return sources.select(*keys, "content").mapInArrow(run, f"{kinds}, {fields}")


def page_scripts(pages: DataFrame) -> DataFrame:
    """(page_id, content): the body of every script of every page, whatever its attributes."""
    bodies = F.regexp_extract_all("html", F.lit(r"(?is)<script(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>(.*?)</script(?=[\s/>])"), F.lit(1))
    return pages.select("page_id", F.explode(bodies).alias("content"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, content): a source for every page with links, with an import of each anchor's href on a line of its own.

    As in URLs, line feeds and tabs don't count and a backslash is a slash.
    """
    hrefs = F.regexp_extract_all("html", F.lit(r"(?is)<a\s(?:(?!href\s*=)[^>\s\"'][^>\s\"'=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?\s+|\s)*href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), F.lit(1))
    clean = F.transform(hrefs, lambda h: F.translate(F.translate(h, "\\", "/"), "\r\n\t", ""))
    quoted = F.transform(clean, lambda h: F.when(F.substring(h, 1, 1).isin('"', "'"), h).otherwise(F.concat(F.lit('"'), h, F.lit('"'))))
    return pages.select("page_id", F.concat_ws("\n", F.transform(quoted, lambda h: F.concat(F.lit("import "), h, F.lit(";")))).alias("content")).where("content != ''")


def imports(sources: DataFrame) -> DataFrame:
    """(keys, specifier, line, column)."""
    return _each(sources, imports_of, "specifier string, line int, column int", [pa.string(), pa.int32(), pa.int32()])


def literals(sources: DataFrame) -> DataFrame:
    """(keys, kind, value, line, column)."""
    return _each(sources, literals_of, "kind string, value string, line int, column int", [pa.string(), pa.string(), pa.int32(), pa.int32()])


def calls(sources: DataFrame, cut=checkpointed) -> DataFrame:
    """(keys, kind, callee, arguments, line, column, containing_function): call sites with the function that holds them.

    A text is looked at once; call sites and ranges of functions leave as rows and meet by a range join on lines. Functions
    are declarations, methods as ``Class.method`` or alone, and arrow functions by their variable or as ``arrow``.
    """
    keys = [c for c in sources.columns if c != "content"]
    fields = "__what string, __id bigint, __name string, __arguments array<string>, __line int, __column int, __end_line int, __end_column int"
    kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), *[pa.int32()] * 4]
    rows = cut(_each(sources.withColumn("__source", F.xxhash64("content")), sites_of, fields, kinds))
    by, to = [*keys, "__source"], lambda **names: [F.col(f"__{v}").alias(k) for k, v in names.items()]
    functions = rows.where("__what = 'function'").select(*by, *to(fun_idx="id", sl="line", sc="column", el="end_line", ec="end_column", __function="name"))
    found = rows.where("__what != 'function'").withColumnRenamed("__id", "call_idx")
    held = containers(functions, found.select(*by, "call_idx", *to(cl="line", cc="column")), tuple(by), module=False)
    named = held.join(functions.select(*by, "fun_idx", "__function").distinct(), [*by, "fun_idx"]).select(*by, "call_idx", "__function")
    out = found.join(named, [*by, "call_idx"], "left")
    return out.select(*keys, *to(kind="what", callee="name", arguments="arguments", line="line", column="column", containing_function="function"))


def bindings(found: DataFrame, matchers=PRESETS) -> DataFrame:
    """Sites that match a pattern's role. Matchers are configuration, so each is one column over the sites."""
    hits = [
        F.when(
            (F.col("kind") == kind) & F.col("callee").rlike(callee) & (F.lit(True) if k is None else F.get("arguments", F.lit(k)).isNotNull()),
            F.struct(F.lit(pattern).alias("pattern_id"), F.lit(role).alias("role"), (F.lit("") if k is None else F.get("arguments", F.lit(k))).alias("binding_key")),
        )
        for pattern, role, kind, callee, k in matchers
    ]
    rows = found.withColumn("m", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return rows.select(*[c for c in found.columns if c not in ("kind", "arguments")], "m.pattern_id", "m.role", "m.binding_key").withColumnRenamed("callee", "function_name")


def depends_on(found: DataFrame, packages: DataFrame) -> DataFrame:
    """The ``depends_on`` facts of imports (file, specifier, line, column), with the importing file's nearest package.

    A relative specifier becomes a project path. Any other one is external and its own package.
    """
    homes = nearest_package(found.select(F.col("file").alias("path")).distinct(), packages)
    rows = found.join(homes.select(F.col("path").alias("file"), F.col("name").alias("from_pkg_name"), F.col("root_path").alias("from_pkg_root")), "file", "left")
    outside, text = is_external(F.col("specifier")), F.col("specifier")
    return rows.select(
        F.col("file").alias("from_path"), "from_pkg_name", "from_pkg_root", "file", "line", "column", F.when(outside, text).otherwise(resolve(F.col("file"), text)).alias("to_path"), outside.alias("is_external"),
        F.when(outside, text).alias("to_pkg_name"), F.lit(None).cast("string").alias("to_pkg_root"),
    )
