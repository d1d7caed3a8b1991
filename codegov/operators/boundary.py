"""Layer boundaries over import edges: pure, allow-list and deny-list rules, and their transitive reach."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import matches, matches_any_import
from ..functions.identity import artifact, fingerprint
from ..functions.paths import ancestors, module_key
from ..sources.shared import checkpointed, kept, tidied
from .reach import condensed_walk, walk_by

PURE, IMPORTS = "coupling/pure-imports@v1", "coupling/layer-imports@v1"


@dataclass(frozen=True)
class Layer:
    """A boundary: a package name or a glob; either a list of allowed or of forbidden imports, or neither (pure)."""

    target: str
    allows: tuple = field(default=())
    forbids: tuple = field(default=())
    transitive: bool = False

    def __post_init__(self):
        if not self.target or self.target.startswith(("./", "../")):
            raise ValueError("a layer needs a target that is no relative path")
        if self.allows and self.forbids:
            raise ValueError("a layer either allows or forbids")
        if self.transitive and not (self.allows or self.forbids):
            raise ValueError("a layer that looks further needs imports that it allows or forbids")


def layer_roots(edges: DataFrame, targets: list[str]) -> dict[str, str]:
    """For each target ``<root>/**`` of the package of that name on some edge, else the target itself as a glob; one pass."""
    rows = edges.where(F.col("from_pkg_name").isin(*targets)).groupBy("from_pkg_name").agg(F.min("from_pkg_root").alias("root")).collect()
    named = {r["from_pkg_name"]: f"{r['root']}/**" for r in rows if r["root"]}
    return {t: named.get(t, t) for t in targets}


def leaves(root: str) -> Column:
    """Whether an edge leaves the layer: no import of its own package by name, no internal edge that stays inside."""
    own = F.col("is_external") & (F.col("to_path") == F.col("from_pkg_name"))
    stays = ~F.col("is_external") & matches(F.col("to_path"), root)
    return matches(F.col("from_path"), root) & ~F.coalesce(own, F.lit(False)) & ~stays


def _offends(layer: Layer) -> Column:
    to = F.col("to_path")
    if layer.forbids:
        return matches_any_import(to, layer.forbids)
    return ~matches_any_import(to, layer.allows)


def violations(edges: DataFrame, *layers: Layer, keys: tuple[str, ...] = ()) -> DataFrame:
    """One finding per (keys, target, dependency, import site) of pure, allow-list or deny-list layers; one pass for all of them."""
    roots = layer_roots(edges, [x.target for x in layers])
    rule = lambda x: IMPORTS if x.allows or x.forbids else PURE
    hits = [F.when(leaves(roots[x.target]) & _offends(x), F.struct(F.lit(rule(x)).alias("rule"), F.lit(x.target).alias("target"))) for x in layers]
    found = edges.withColumn("hit", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    target, name = F.col("hit.target"), F.col("hit.rule")
    return found.select(
        *keys, name.alias("rule_id"), F.concat(name, F.lit(":"), target).alias("instance_id"), fingerprint(name, target=target, dependency=F.col("to_path")).alias("fingerprint"),
        F.concat(target, F.lit(" imports "), F.col("to_path")).alias("message"),
        F.array(artifact("import", file=F.col("file"), line=F.col("line"), column=F.col("column"), dependency=F.col("to_path"), packageRoot=F.col("from_pkg_root"))).alias("artifacts"),
        F.struct("file", "line", "column", "to_path").alias("ord"), F.col("to_path").alias("dependency"),
    )


def idle_patterns(edges: DataFrame, patterns: tuple) -> DataFrame:
    """(pattern): patterns that match no import of the whole graph; none on an empty graph. One pass over the edges."""
    hits = [F.max(matches_any_import(F.col("to_path"), [p]).cast("int")).alias(f"h{k}") for k, p in enumerate(patterns)]
    one = edges.agg(F.count(F.lit(1)).alias("n"), *hits).where("n > 0")
    rows = F.array(*(F.struct(F.lit(getattr(p, "pattern", p)).alias("pattern"), F.col(f"h{k}").alias("hit")) for k, p in enumerate(patterns)))
    return one.select(F.explode(rows).alias("r")).where("r.hit = 0").select("r.pattern")


def _closed(layers: list[Layer], to: Column) -> Column:
    """The targets of the layers that forbid an import; null if none does."""
    bad = [F.when(matches_any_import(to, x.forbids), F.lit(x.target)) for x in layers if x.forbids]
    return F.filter(F.array(*bad), lambda t: t.isNotNull()) if bad else F.lit(None).cast("array<string>")


def _members(plain: DataFrame) -> DataFrame:
    """(a, b): the files of every directory that some import names; other directories have no row. ``plain``: (from_path, a, b, is_external)."""
    named = plain.where("not is_external").select(F.col("b").alias("a")).distinct()
    files = plain.select("from_path", F.col("a").alias("b")).distinct()
    return files.select(F.explode(ancestors(F.col("from_path"))).alias("a"), "b").join(named.hint("merge"), "a", "left_semi").where("a != b").distinct()


def reach(edges: DataFrame, layers: list[Layer], exact_paths: bool = False, cut=checkpointed, condense: bool | None = None) -> DataFrame:
    """(target, current_path, dependency, site): what a layer reaches through internal files that it may import.

    Nodes are module keys; an import leads from its file to what it names, and a directory that some import names leads
    to its files. Allow mode reports external imports that aren't allowed; deny mode reports forbidden imports and
    doesn't walk them. ``site`` is the first place of the import. The walk goes by strongly connected components
    (``condense``) where several layers share the graph; a single layer visits each node once anyway. For that one the
    imports stay in the shared folder as compressed Parquet, as the result reads them.
    """
    key = (lambda c: c) if exact_paths else module_key
    names = ["from_path", "from_pkg_name", "from_pkg_root", "to_path", "is_external", "file", "line", "column"]
    plain = edges.select(*names).where(F.col("from_path").isNotNull() & F.col("to_path").isNotNull())
    condense = len(layers) > 1 if condense is None else condense
    plain = (cut if condense else kept)(plain).withColumns({"a": key(F.col("from_path")), "b": key(F.col("to_path"))})
    roots = layer_roots(plain, [x.target for x in layers])
    to, inner = F.col("to_path"), plain.where(~F.col("is_external"))
    starts = [F.when(leaves(roots[x.target]) & (~matches_any_import(to, x.forbids) if x.forbids else matches_any_import(to, x.allows)), F.lit(x.target)) for x in layers]
    first = cut(inner.select("to_path", "b", F.explode(F.filter(F.array(*starts), lambda t: t.isNotNull())).alias("who")).distinct())
    graph = inner.select("a", "b", "to_path").withColumn("closed", _closed(layers, to))
    folders = cut(_members(plain))
    none = F.lit(None).cast("array<string>").alias("closed")
    seeds = first.select("who", F.col("b").alias("a"))
    tidied(edges.sparkSession)
    if condense:
        seen = cut(condensed_walk(seeds, graph.drop("to_path").unionByName(folders.select("a", "b", none)), cut))
        onward = seen.join(graph.hint("merge"), "a").where(~F.coalesce(F.array_contains("closed", F.col("who")), F.lit(False))).select("who", "to_path", "b")
    else:  # each import is walked once, so the walk tells by which path a node was reached; that of a folder's file is null
        _, by = walk_by(seeds, graph.unionByName(folders.select("a", "b", F.lit(None).cast("string").alias("to_path"), none)), ("to_path",), cut)
        onward = (first.limit(0) if by is None else by.where("to_path is not null").withColumnRenamed("a", "b")).select("who", "to_path", "b")
    via = first.select("who", "to_path", "b").unionByName(onward).distinct().select("who", F.col("to_path").alias("current_path"), F.col("b").alias("k"))
    # the imports that offend, once for each layer, at the keys under which their files are walked
    bad = [F.when(matches_any_import(to, x.forbids) if x.forbids else F.col("is_external") & ~matches_any_import(to, x.allows), F.lit(x.target)) for x in layers if x.allows or x.forbids]
    if not bad:
        return via.select(F.col("who").alias("target"), "current_path", F.col("current_path").alias("dependency"), F.lit(None).cast("struct<file:string,line:int,column:int,packageRoot:string>").alias("site")).limit(0)
    site = F.struct("file", "line", "column", F.col("from_pkg_root").alias("packageRoot"))
    sites = plain.withColumn("who", F.explode(F.filter(F.array(*bad), lambda t: t.isNotNull()))).groupBy("who", F.col("a").alias("k"), F.col("to_path").alias("dependency")).agg(F.min(site).alias("site"))
    if not folders.isEmpty():
        inside = sites.join(folders.select(F.col("a").alias("folder"), F.col("b").alias("k")).hint("merge"), "k").groupBy("who", F.col("folder").alias("k"), "dependency").agg(F.min("site").alias("site"))
        sites = sites.unionByName(inside).groupBy("who", "k", "dependency").agg(F.min("site").alias("site"))
    return via.join(sites.hint("merge"), ["who", "k"]).select(F.col("who").alias("target"), "current_path", "dependency", "site")


def reach_findings(rows: DataFrame, layers: list[Layer]) -> DataFrame:
    """One finding a row of ``reach``, of the layer's own rule, with the first site as its evidence."""
    target, words = F.col("target"), F.create_map(*(F.lit(x) for layer in layers for x in (layer.target, "not declared in allowed" if layer.allows else "declared in forbidden")))
    message = F.concat(F.lit("[Transitive] "), target, F.lit(" reaches "), F.col("dependency"), F.lit(" via "), F.col("current_path"), F.lit(" in "), F.col("site.file"), F.lit(": "), F.element_at(words, target), F.lit(" imports"))
    return rows.select(
        F.lit(IMPORTS).alias("rule_id"), F.concat(F.lit(IMPORTS + ":"), target).alias("instance_id"), fingerprint(IMPORTS, target=target, currentPath=F.col("current_path"), dependency=F.col("dependency")).alias("fingerprint"), message.alias("message"),
        F.array(artifact("import", file=F.col("site.file"), line=F.col("site.line"), column=F.col("site.column"), dependency=F.col("dependency"), packageRoot=F.col("site.packageRoot"))).alias("artifacts"),
        F.struct(F.col("site.file").alias("file"), F.col("site.line").alias("line"), F.col("site.column").alias("column"), F.col("dependency").alias("to_path")).alias("ord"), F.col("dependency"),
    )


def layer_findings(edges: DataFrame, *layers: Layer, cut=checkpointed) -> DataFrame:
    """What ``violations`` gives, and for layers that ask for it what they reach through others."""
    direct, far = violations(edges, *layers), [x for x in layers if x.transitive]
    return direct.unionByName(reach_findings(reach(edges, far, cut=cut), far)) if far else direct


def layer_warnings(edges: DataFrame, *layers: Layer) -> DataFrame:
    """(warning): patterns of the layers that match no import of the whole graph."""
    patterns = tuple(dict.fromkeys(p for x in layers for p in (*x.allows, *x.forbids)))
    return idle_patterns(edges, patterns).select(F.concat(F.lit("no import matches "), "pattern").alias("warning")) if patterns else edges.select(F.lit("").alias("warning")).limit(0)
