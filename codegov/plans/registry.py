"""Every registered query of the library proper, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import budget, globs, identity, paths, pattern_tables
from ..operators import boundary, erosion, extraction, git_rules, graph, grouping, ledger, scoring, structures
from ..sources import fact_cache, fact_tables, gitlog, ledger_files
from ..sources.shared import shared_folder
from ..streaming import jobs
from . import runner
from .adapters import AS_OF, LEDGER_AS_OF, duck, fact

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Get = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None):
    """Registers ``f(get)``, where get(name) is a fact table; ``sql`` over the same tables is its oracle."""

    def put(f: Callable[[Get], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: fact(spark, sf_dir, table))
        if sql is not None:
            ORACLE_SQL[name] = duck(sql)
        return f

    return put


def _edges(get: Get) -> DataFrame:
    return get("edges").withColumnRenamed("col", "column")


def _json(*parts: str) -> str:
    """SQL of a JSON text: literal pieces and column expressions in turn."""
    return " || ".join(f"'{p}'" if k % 2 == 0 else p for k, p in enumerate(parts))


# ---- git history

_WINDOW = "FROM {changes} WHERE hash IN (SELECT hash FROM {commits} WHERE date >= TIMESTAMP '2001-05-03 00:00:00')"


@query("a01_churn", "SELECT path, count(*) AS count, SHA[" + _json('{"data":{"path":"', "path", '"},"ruleId":"git/churn@v1"}') + f"] AS fingerprint {_WINDOW} AND path NOT LIKE '%/Brand11/%' GROUP BY path HAVING count(*) >= 3")
def a01(get):
    counts = git_rules.churn_counts(get("commits"), get("changes"), AS_OF, 90, exclude=("**/Brand11/**",))
    return git_rules.churn_findings(counts, 3).select("path", "count", "fingerprint")


@query("j01_changes_in_window", f"SELECT hash, path, status {_WINDOW}")
def j01(get):
    return git_rules.changes_in_window(get("commits"), get("changes"), AS_OF, 90).select("hash", "path", "status")


@query("r02_recent_commits", "SELECT hash, author, subject FROM {commits} WHERE date >= TIMESTAMP '2000-08-01 00:00:00' ORDER BY date DESC, hash LIMIT 100")
def r02(get):
    return git_rules.recent_commits(get("commits"), AS_OF, 365, 100).select("hash", "author", "subject")


@query("o04_newest_per_author", "SELECT author, hash FROM (SELECT author, hash, row_number() OVER (PARTITION BY author ORDER BY date DESC, hash) AS n FROM {commits}) x WHERE n <= 3")
def o04(get):
    return git_rules.recent_commits(get("commits"), AS_OF, None, 3, keys=("author",)).select("author", "hash")


@query("w05_rolling_churn", "SELECT path, hash, count(*) OVER (PARTITION BY path ORDER BY epoch(date) RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW) AS count FROM {changes} JOIN {commits} USING (hash)")
def w05(get):
    return git_rules.rolling_churn(get("commits"), get("changes"), 90).select("path", "hash", "count")


@query(
    "r01_git_log",
    "SELECT hash, 'Ann' AS author, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'N' THEN 'modified' ELSE 'renamed' END AS status, path, CASE WHEN l_returnflag = 'R' THEN 'old/' || path END AS old_path, 'fix' || chr(1) || subject AS subject "
    "FROM (SELECT CAST(l_orderkey AS STRING) AS hash, l_returnflag, path FROM {lineitem} JOIN {paths} ON l_partkey = p_partkey) x JOIN {commits} USING (hash) WHERE CAST(author AS INT) % 10 <> 3",
)
def r01(get):
    """Log texts written from the tables, one record per commit, some with a missing field or odd lines, parsed again."""
    line = F.when(F.col("l_returnflag") == "R", F.concat_ws("\t", F.lit("R90"), F.concat(F.lit("old/"), "path"), "path")).otherwise(F.concat_ws("\t", "l_returnflag_", "path"))
    rows = get("lineitem").join(get("paths"), F.col("l_partkey") == F.col("p_partkey")).withColumn("l_returnflag_", F.when(F.col("l_returnflag") == "N", "M").otherwise(F.col("l_returnflag")))
    lines = rows.groupBy(F.col("l_orderkey").cast("string").alias("hash")).agg(F.collect_list(line).alias("l"))
    author = F.when(F.col("author").cast("int") % 10 == 3, "").otherwise("Ann")
    head = F.concat_ws("\x01", F.lit("COMMIT"), "hash", author, F.lit("a@example.org"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.concat(F.lit("fix\x01"), "subject"))
    records = get("commits").join(lines, "hash").select(F.array_join(F.concat(F.array(head), F.col("l"), F.array(F.lit("X\tunknown"), F.lit("no tab"), F.lit("R90\tonly-old"))), "\n").alias("value"))
    parsed = gitlog.parse_records(records)
    return gitlog.file_changes(parsed).join(gitlog.commits(parsed).select("hash", "author", "subject"), "hash").select("hash", "author", "status", "path", "old_path", "subject")


@query("s03_status_words", "SELECT l_returnflag AS letter, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'renamed' END AS word, count(*) AS n FROM {lineitem} GROUP BY l_returnflag")
def s03(get):
    return get("lineitem").groupBy(F.col("l_returnflag").alias("letter")).agg(F.count(F.lit(1)).alias("n")).withColumn("word", gitlog.status_word(F.col("letter")))


# ---- paths and patterns


@query("p01_globs", "SELECT path, path LIKE 'packages/economy/%' AS inside, regexp_matches(path, '^packages/[^/]*/src/Brand(1|2)[^/]/part[^/]*1[.]ts$') AS braces, NOT path LIKE 'packages/promo/%' AS outside FROM {paths}")
def p01(get):
    c = F.col("path")
    return get("paths").select("path", globs.matches(c, "packages/economy/**").alias("inside"), globs.matches(c, "packages/*/src/Brand{1,2}?/part*1.ts").alias("braces"), globs.matches(c, "!packages/promo/**").alias("outside"))


@query("p02_import_patterns", "SELECT to_path, count(*) AS n, to_path = '@supp/nation_1' OR to_path LIKE '@supp/nation\\_1/%' ESCAPE '\\' AS plain, regexp_matches(to_path, 'nation_2$') AS regex, regexp_matches(to_path, '^@supp/[^/]*$') AS glob FROM {edges} GROUP BY to_path")
def p02(get):
    import re

    c, rows = F.col("to_path"), get("edges").groupBy("to_path").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("to_path", "n", globs.matches_import(c, "@supp/nation_1").alias("plain"), globs.matches_import(c, re.compile("nation_2$")).alias("regex"), globs.matches_import(c, "@supp/*").alias("glob"))


@query("p01_pattern_table", """SELECT pattern, count(*) AS n FROM (
    SELECT 'packages/' || pkg || '/**' AS pattern, path FROM (SELECT DISTINCT pkg FROM {paths}) a JOIN {paths} b USING (pkg)
    UNION ALL SELECT '**/' || brand || '/part' || d || '*.ts', path FROM (SELECT DISTINCT replace(p_brand, '#', '') AS brand, substring(CAST(p_partkey AS STRING), 1, 1) AS d FROM {part}) a JOIN {paths} ON path LIKE '%/' || brand || '/part' || d || '%.ts'
    UNION ALL SELECT path, path FROM {paths} UNION ALL SELECT '!packages/promo/**', path FROM {paths} WHERE path NOT LIKE 'packages/promo/%' UNION ALL SELECT '**/*.ts', path FROM {paths}) x GROUP BY pattern""")
def p01_table(get):
    """A table of patterns, thousands of them, against all paths: folders, names inside, whole paths, a negated one and an extension."""
    brand, digit = F.replace("p_brand", F.lit("#"), F.lit("")), F.substring(F.col("p_partkey").cast("string"), 1, 1)
    rows = get("paths")
    made = [rows.select(F.concat(F.lit("packages/"), "pkg", F.lit("/**")).alias("pattern")), rows.select(F.concat(F.lit("**/"), brand, F.lit("/part"), digit, F.lit("*.ts")).alias("pattern")), rows.select(F.col("path").alias("pattern"))]
    fixed = [rows.select(F.lit(p).alias("pattern")).limit(1) for p in ("!packages/promo/**", "**/*.ts")]
    patterns = reduce(DataFrame.unionByName, [*made, *fixed]).distinct()
    return pattern_tables.glob_join(rows.select("path"), patterns).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query("p02_pattern_table", """WITH t AS (SELECT DISTINCT to_path FROM {edges}), m AS (
    SELECT '@supp/nation_' || CAST(n_nationkey AS STRING) AS pattern, to_path FROM {nation} JOIN t ON to_path = '@supp/nation_' || CAST(n_nationkey AS STRING)
    UNION ALL SELECT DISTINCT 'packages/' || pkg, to_path FROM {paths} JOIN t ON starts_with(to_path, 'packages/' || pkg || '/')
    UNION ALL SELECT '@supp/nation_' || k || '*', to_path FROM (SELECT DISTINCT substring(CAST(n_nationkey AS STRING), 1, 1) AS k FROM {nation}) a JOIN t ON starts_with(to_path, '@supp/nation_' || k)) SELECT pattern, count(*) AS n FROM m GROUP BY pattern""")
def p02_table(get):
    """A table of import patterns: names with their sub-paths, and globs."""
    nation = F.col("n_nationkey").cast("string")
    made = [get("nation").select(F.concat(F.lit("@supp/nation_"), nation).alias("pattern")), get("paths").select(F.concat(F.lit("packages/"), "pkg").alias("pattern")), get("nation").select(F.concat(F.lit("@supp/nation_"), F.substring(nation, 1, 1), F.lit("*")).alias("pattern"))]
    targets = get("edges").select("to_path").distinct()
    return pattern_tables.import_join(targets, reduce(DataFrame.unionByName, made).distinct()).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query("p08_idle_table", "SELECT '@supp/nation_' || CAST(n_nationkey AS STRING) || s AS pattern FROM {nation} CROSS JOIN (VALUES (''), ('x'), ('/**')) v(s) WHERE EXISTS (SELECT 1 FROM {edges}) AND NOT EXISTS (SELECT 1 FROM {edges} WHERE to_path = '@supp/nation_' || CAST(n_nationkey AS STRING) || replace(s, '/**', ''))")
def p08_table(get):
    nation = F.concat(F.lit("@supp/nation_"), F.col("n_nationkey").cast("string"))
    patterns = get("nation").select(F.explode(F.array(nation, F.concat(nation, F.lit("x")), F.concat(nation, F.lit("/**")))).alias("pattern"))
    return pattern_tables.idle(get("edges"), patterns)


@query("s05_external_imports", "SELECT is_external, count(*) AS n FROM (SELECT CASE WHEN is_external THEN to_path ELSE './' || to_path END AS s, is_external FROM {edges}) x GROUP BY is_external")
def s05(get):
    s = F.when(F.col("is_external"), F.col("to_path")).otherwise(F.concat(F.lit("./"), "to_path"))
    return get("edges").select(paths.is_external(s).alias("is_external")).groupBy("is_external").agg(F.count(F.lit(1)).alias("n"))


@query("s06_resolve_paths", "SELECT path, 'packages/' || pkg || '/lib/x' AS resolved, 'packages/' || pkg || '/src/' || replace(p_brand, '#', '') || '/y' AS near FROM {paths}")
def s06(get):
    return get("paths").select("path", paths.resolve(F.col("path"), F.lit("../.././lib/x")).alias("resolved"), paths.resolve(F.col("path"), F.lit("./y")).alias("near"))


@query("s20_ancestors", "SELECT path, 'packages/' || pkg || '/src/' || replace(p_brand, '#', '') || ';packages/' || pkg || '/src;packages/' || pkg || ';packages' AS up FROM {paths}")
def s20(get):
    return get("paths").select("path", F.array_join(paths.ancestors(F.col("path")), ";").alias("up"))


@query("j03_nearest_package", "SELECT path, '@acme/' || pkg AS name, 'packages/' || pkg AS root_path FROM {paths}")
def j03(get):
    return graph.nearest_package(get("paths").select("path"), get("packages"))


# ---- boundaries

_CROSS = "FROM {edges} WHERE from_path LIKE 'packages/economy/%' AND NOT (NOT is_external AND to_path LIKE 'packages/economy/%')"
_ECONOMY = "@acme/economy"


def _folded(rows: DataFrame) -> DataFrame:
    return identity.count_findings(rows).select("fingerprint", "dependency", "n")


def _finding(rule: str, where: str) -> str:
    return "SELECT to_path AS dependency, count(*) AS n, SHA[" + _json('{"data":{"dependency":"', "to_path", f'","target":"{_ECONOMY}"}},"ruleId":"{rule}"}}') + f"] AS fingerprint {_CROSS} {where} GROUP BY to_path"


@query("p05_pure_layer", _finding(boundary.PURE, ""))
def p05(get):
    return _folded(boundary.violations(_edges(get), boundary.Layer(_ECONOMY)))


@query("p06_allow_list", _finding(boundary.IMPORTS, "AND NOT (to_path LIKE 'packages/promo/%' OR to_path = '@supp/nation_1')"))
def p06(get):
    return _folded(boundary.violations(_edges(get), boundary.Layer(_ECONOMY, allows=("packages/promo/**", "@supp/nation_1"))))


@query("p07_deny_list", _finding(boundary.IMPORTS, "AND (to_path LIKE 'packages/promo/%' OR to_path = '@supp/nation_1')"))
def p07(get):
    return _folded(boundary.violations(_edges(get), boundary.Layer(_ECONOMY, forbids=("packages/promo/**", "@supp/nation_1"))))


@query("p03_layer_root", "SELECT DISTINCT from_pkg_root || '/**' AS root FROM {edges} WHERE from_pkg_name = '@acme/economy' UNION ALL SELECT 'src/other/**'")
def p03(get):
    e = _edges(get)
    roots = boundary.layer_roots(e, [_ECONOMY, "src/other/**"])
    return e.sparkSession.createDataFrame([(r,) for r in roots.values()], "root string")


@query("p08_idle_patterns", "SELECT p AS pattern FROM (VALUES ('@supp/nation_1'), ('@typo/**'), ('packages/promo/**')) v(p) WHERE EXISTS (SELECT 1 FROM {edges}) AND NOT EXISTS (SELECT 1 FROM {edges} WHERE to_path = p OR starts_with(to_path, replace(p, '/**', '') || '/'))")
def p08(get):
    return boundary.idle_patterns(_edges(get), ("@supp/nation_1", "@typo/**", "packages/promo/**"))


_OK = "(to_path LIKE 'packages/promo/%' OR to_path = '@supp/nation_1')"


_WALK = f"""WITH RECURSIVE walk AS (
      SELECT DISTINCT to_path AS path {_CROSS} AND NOT is_external AND {_OK}
      UNION SELECT e.to_path FROM walk w JOIN {{edges}} e ON e.from_path = w.path WHERE NOT e.is_external),
    far AS (SELECT DISTINCT path AS current_path, to_path AS dependency FROM walk JOIN {{edges}} ON from_path = path WHERE is_external AND NOT {_OK})"""
_REACHING = boundary.Layer("packages/economy/**", allows=("packages/promo/**", "@supp/nation_1"), transitive=True)


@query("j05_layer_reach", f"{_WALK} SELECT 'packages/economy/**' AS target, current_path, dependency FROM far")
def j05(get):
    return boundary.reach(_edges(get), [_REACHING]).select("target", "current_path", "dependency")


@query(
    "j05_layer_rule",
    f"""{_WALK}, direct AS (SELECT to_path AS dependency, count(*) AS n {_CROSS} AND NOT {_OK} GROUP BY to_path)
    SELECT SHA[{_json('{"data":{"currentPath":"', 'current_path', '","dependency":"', 'dependency', '","target":"packages/economy/**"},"ruleId":"coupling/layer-imports@v1"}')}] AS fingerprint, CAST(1 AS BIGINT) AS n FROM far
    UNION ALL SELECT SHA[{_json('{"data":{"dependency":"', 'dependency', '","target":"packages/economy/**"},"ruleId":"coupling/layer-imports@v1"}')}], n FROM direct""",
)
def j05_rule(get):
    """The layer as a rule of the runner: its direct findings and, under the same rule, what it reaches."""
    ts = runner.Collector("ts", ("depends_on",), lambda _: {"depends_on": _edges(get)})
    rule = runner.Rule("layer", ("depends_on",), lambda f: boundary.layer_findings(f["depends_on"], _REACHING), lambda f: boundary.layer_warnings(f["depends_on"], _REACHING))
    return runner.run([ts], [rule]).findings.select("fingerprint", "n")


# ---- grouping rules

_LITERAL_ID = _json('{"data":{"kind":"', "kind", '","value":"', "value", '"},"ruleId":"connascence/meaning@v1"}')


@query("a02_shared_literals", f"SELECT kind, value, count(DISTINCT file) AS files, count(*) AS n, SHA[{_LITERAL_ID}] AS fingerprint FROM {{constants}} WHERE value NOT IN ('0', '1') GROUP BY kind, value HAVING count(DISTINCT file) >= 2")
def a02(get):
    return grouping.literal_counts(get("constants"), 2, ("0", "1")).select("kind", "value", "files", "n", "fingerprint")


@query("a02_shared_lines", "SELECT value, count(DISTINCT file) AS files FROM (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS value FROM {documents}) x WHERE value <> '' GROUP BY value HAVING count(DISTINCT file) >= 2")
def a02_lines(get):
    lines = get("documents").select(F.col("doc_id").alias("file"), F.lit("line").alias("kind"), F.explode(F.split("text", "\n")).alias("value"))
    return grouping.shared_literals(lines.where("value != ''"), 2).select("value", "files")


_ALGO = "SELECT pattern_id, binding_key, count(DISTINCT file) AS files, count(DISTINCT role) AS roles, SHA[" + _json('{"data":{"bindingKey":"', "binding_key", '","patternId":"', "pattern_id", '"},"ruleId":"connascence/algorithm@v1"}') + "] AS fingerprint FROM {bindings}"


@query("a03_shared_algorithms", f"{_ALGO} WHERE binding_key <> 'Brand#11' GROUP BY pattern_id, binding_key HAVING count(DISTINCT file) >= 2 AND count(DISTINCT role) >= 2")
def a03(get):
    return grouping.shared_algorithms(get("bindings"), ignored=("Brand#11",))


@query("a04_same_container", f"{_ALGO} b WHERE EXISTS (SELECT 1 FROM {{bindings}} x WHERE x.pattern_id = b.pattern_id AND x.binding_key = b.binding_key GROUP BY coalesce(containing_function, file) HAVING count(DISTINCT role) >= 2) GROUP BY pattern_id, binding_key HAVING count(DISTINCT file) >= 2 AND count(DISTINCT role) >= 2")
def a04(get):
    return grouping.shared_algorithms(get("bindings"), same_container=True)


@query("a03_rule", f"""WITH g AS ({_ALGO} WHERE binding_key <> 'Brand#11' GROUP BY pattern_id, binding_key HAVING count(DISTINCT file) >= 2 AND count(DISTINCT role) >= 2)
    SELECT g.fingerprint, b.role, coalesce(b.containing_function, '') AS container, g.files, count(*) AS n FROM g JOIN {{bindings}} b ON b.pattern_id = g.pattern_id AND b.binding_key = g.binding_key GROUP BY ALL""")
def a03_rule(get):
    """The findings of shared algorithms as a rule of the runner, and the bindings behind them as evidence."""
    ts = runner.Collector("ts", ("algorithmic_bindings",), lambda _: {"algorithmic_bindings": get("bindings")})
    rule = runner.Rule("algorithms", ("algorithmic_bindings",), lambda f: grouping.algorithm_findings(f["algorithmic_bindings"], ignored=("Brand#11",)))
    found = runner.run([ts], [rule])
    sites = found.evidence.select("fingerprint", F.get_json_object("data", "$.role").alias("role"), F.coalesce(F.get_json_object("data", "$.containingFunction"), F.lit("")).alias("container"))
    files = F.regexp_extract("message", r"across (\d+) files", 1).cast("long")
    return sites.groupBy("fingerprint", "role", "container").agg(F.count(F.lit(1)).alias("n")).join(found.findings.select("fingerprint", files.alias("files")), "fingerprint")


@query("w01_keep_first", "SELECT file, line, col, value, min(seq) AS seq FROM (SELECT *, CASE kind WHEN 'string' THEN 0 ELSE 1 END AS seq FROM {constants}) x GROUP BY file, line, col, value")
def w01(get):
    rows = get("constants").withColumnRenamed("col", "column").withColumn("seq", F.when(F.col("kind") == "string", 0).otherwise(1))
    return grouping.keep_first(rows, "constants", "seq").select("file", "line", F.col("column").alias("col"), "value", "seq")


@query("u01_merge_facts", "SELECT 0 AS source_order, count(*) AS n FROM {constants} WHERE kind = 'string' UNION ALL SELECT 1, count(*) FROM {constants} WHERE kind = 'number'")
def u01(get):
    c = get("constants")
    merged = grouping.merge_facts(c.where("kind = 'string'"), c.where("kind = 'number'").drop("col"))
    return merged.groupBy("source_order").agg(F.count(F.lit(1)).alias("n"))


_VALUES = ("click", "purchase", "view")


@query("u01_last_wins", "SELECT user_id AS key, arg_max(v, s) AS value FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS s, max(event_id) AS v FROM {events} WHERE event_type IN ('click', 'purchase', 'view') GROUP BY user_id, event_type) x GROUP BY user_id")
def u01_values(get):
    """A value per user from each of three collectors, the newest event of their type."""
    one = lambda t: get("events").where(F.col("event_type") == t).groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("value"))
    return grouping.merge_values(*map(one, _VALUES))


# ---- signatures and structures


def _signatures(get: Get) -> DataFrame:
    p = get("parameters").groupBy("l_orderkey", "exported").agg(F.array_sort(F.collect_list(F.struct("position", "type", "l_linestatus"))).alias("p"))
    types = F.transform("p", lambda x: x["type"])
    sites = F.transform("p", lambda x: F.struct(x["l_linestatus"].alias("value"), F.when(x["position"] == 1, F.lit("first")).alias("guard")))
    return p.select(
        F.concat(F.lit("fn_"), (F.col("l_orderkey") % 500).cast("string")).alias("name"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"), "exported",
        F.transform("p", lambda x: F.struct(F.concat(F.lit("p"), x["position"].cast("string")).alias("name"), x["type"].alias("type"), x["position"].cast("int").alias("position"))).alias("parameters"),
        structures.heterogeneous(types).alias("input_heterogeneous"), F.lit("O | F").alias("return_type"), F.lit(True).alias("output_heterogeneous"), sites.alias("return_sites"), F.col("l_orderkey").alias("key"),
    )


_PARAMS = "SELECT l_orderkey, 'fn_' || CAST(l_orderkey % 500 AS STRING) AS function, string_agg('p' || CAST(position AS STRING) || ': ' || type, ', ' ORDER BY position) AS params, bool_or(type = 'boolean') AS has_flag, count(*) > 3 AS is_long, count(DISTINCT type) > 1 AS mixed FROM {parameters}"


@query("p09_arguments", f"SELECT function, params, count(*) AS n, SHA[{_json('{"data":{"function":"', 'function', '","params":"', 'params', '"},"ruleId":"connascence/arguments@v1"}')}] AS fingerprint FROM ({_PARAMS} WHERE exported GROUP BY l_orderkey) x WHERE has_flag OR is_long GROUP BY function, params")
def p09(get):
    found = identity.count_findings(structures.argument_findings(_signatures(get)))
    return found.select("function", "params", "n", "fingerprint")


@query("a12_heterogeneity", f"SELECT l_orderkey AS key, mixed FROM ({_PARAMS} GROUP BY l_orderkey) x")
def a12(get):
    return _signatures(get).select("key", F.col("input_heterogeneous").alias("mixed"))


_SITES = "SELECT l_orderkey, string_agg(l_linestatus || CASE WHEN position = 1 THEN '[first]' ELSE '' END, '|' ORDER BY position) AS value, count(*) > count(DISTINCT l_linestatus) AS again, count(*) AS n, string_agg(DISTINCT l_linestatus, ', ' ORDER BY l_linestatus) AS kinds FROM {parameters} GROUP BY l_orderkey"


@query("p11_candidates", f"SELECT l_orderkey AS key FROM ({_SITES}) x WHERE again")
def p11(get):
    return structures.candidates(_signatures(get)).select("key")


@query("p10_semantic", f"SELECT value, 'O | F' AS kind, count(*) AS n FROM ({_SITES}) x WHERE again AND (l_orderkey % 10) / 10.0 >= 0.7 GROUP BY value")
def p10(get):
    scored = structures.candidates(_signatures(get)).withColumn("confidence", (F.col("key") % 10) / 10.0)
    found = identity.count_findings(structures.semantic_findings(scored, 0.7))
    return found.select("value", "kind", "n")


@query("s11_repeated_values", "SELECT l_orderkey AS key, count(*) - count(DISTINCT type) AS n FROM {parameters} GROUP BY l_orderkey")
def s11(get):
    return _signatures(get).select("key", F.size(identity.repeated(F.transform("parameters", lambda p: p["type"]))).cast("long").alias("n"))


@query("s07_union_types", "SELECT doc_id, len(list_distinct(list_transform(string_split(lang || ' | ' || source || '|' || lang, '|'), lambda x: trim(x)))) AS n FROM {documents}")
def s07(get):
    return get("documents").select("doc_id", F.size(identity.union_types(F.concat("lang", F.lit(" | "), "source", F.lit("|"), "lang"))).cast("long").alias("n"))


@query("s12_guard_text", "SELECT doc_id, substring(trim(text), 1, 300) AS guard FROM {documents}")
def s12(get):
    return get("documents").select("doc_id", identity.guard_text(F.col("text")).alias("guard"))


@query("s09_locations", "SELECT file || ':' || CAST(line AS STRING) || ':' || CAST(col AS STRING) AS place, count(*) AS n FROM {constants} GROUP BY file, line, col")
def s09(get):
    return get("constants").groupBy(identity.location(F.col("file"), F.col("line"), F.col("col")).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("j02_positions", "SELECT s.file, s.name, count(*) AS accesses, SHA[" + _json('{"data":{"file":"', "s.file", '","name":"', "s.name", '"},"ruleId":"connascence/position@v1"}') + "] AS fingerprint FROM {sources} s JOIN {accesses} a ON s.file = coalesce(a.origin_file, a.file) AND s.name = coalesce(a.origin_name, a.name) WHERE s.is_heterogeneous GROUP BY s.file, s.name")
def j02(get):
    found = structures.position_findings(get("sources"), get("accesses")).where("what = 'access'")
    return identity.count_findings(found).select("file", "name", F.col("n").alias("accesses"), "fingerprint")


@query("j02_evidence", """WITH m AS (SELECT s.file, s.name, a.accessed_index, a.line FROM (SELECT DISTINCT file, name FROM {sources} WHERE is_heterogeneous) s JOIN {accesses} a ON s.file = coalesce(a.origin_file, a.file) AND s.name = coalesce(a.origin_name, a.name))
    SELECT file, name, 'access' AS kind, accessed_index AS index, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT DISTINCT file, name, 'source', NULL, CAST(1 AS BIGINT) FROM m""")
def j02_evidence(get):
    """The evidence of every structure: its source, and each access with its index."""
    found = structures.position_findings(get("sources"), get("accesses"))
    at = F.get_json_object("data", "$.index")
    rows = identity.evidence(found, ("file", "name")).groupBy("file", "name", "kind", at.alias("index")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("file", "name", "kind", "index", "n")


@query(
    "j04_enclosing_function",
    "SELECT call_idx, fun_idx FROM (SELECT call_idx, fun_idx, row_number() OVER (PARTITION BY call_idx ORDER BY (el - sl) * 100000 + (ec - sc), fun_idx) AS n FROM {sites} s JOIN {ranges} r ON s.file = r.file AND cl BETWEEN sl AND el AND (cl <> sl OR cc >= sc) AND (cl <> el OR cc <= ec)) x WHERE n = 1",
)
def j04(get):
    return graph.enclosing_function(get("ranges"), get("sites"))


@query(
    "j04_call_edges",
    """WITH e AS (SELECT call_idx, fun_idx, s.file, cl, cc, row_number() OVER (PARTITION BY call_idx ORDER BY (el - sl) * 100000 + (ec - sc), fun_idx) AS n FROM {sites} s JOIN {ranges} r ON s.file = r.file AND cl BETWEEN sl AND el AND (cl <> sl OR cc >= sc) AND (cl <> el OR cc <= ec)),
    f AS (SELECT fun_idx, file || ':' || CAST(sl AS STRING) || ':' || CAST(sc - 1 AS STRING) AS id FROM {ranges})
    SELECT e.file, a.id AS caller_id, b.id AS callee_id, cl AS line, cc - 1 AS col FROM e JOIN {targets} t ON e.call_idx = t.call_idx JOIN f a ON a.fun_idx = e.fun_idx JOIN f b ON b.fun_idx = callee_idx WHERE n = 1""",
)
def j04_edges(get):
    return graph.call_edges(get("ranges"), get("sites"), get("targets")).withColumnRenamed("column", "col")


@query("s22_range_text", "SELECT o_orderkey, CAST(o_custkey AS INT) AS file_index, CAST(o_orderkey % 400 AS INT) AS sl, CAST(o_orderkey % 400 AS INT) AS el FROM {orders}")
def s22(get):
    r = graph.parse_range(F.concat_ws(":", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 400).cast("string"), F.lit("3"), F.lit("?"), F.lit("?")))
    return get("orders").select("o_orderkey", r["file_index"].alias("file_index"), r["sl"].alias("sl"), r["el"].alias("el"))


# ---- ledger

_LAST = "WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ord DESC) AS n FROM {ledger}) x WHERE n = 1)"
_LIVE = "TIMESTAMP '2024-01-31 00:00:00'"


@query("a07_ledger_fold", f"{_LAST} SELECT fingerprint, type, ord, rule_id FROM last")
def a07(get):
    return ledger.latest(get("ledger")).select("fingerprint", "type", "ord", "rule_id")


@query("p12_not_baselined", f"{_LAST} SELECT fingerprint, type FROM last WHERE type = 'observed' OR type = 'baselined' AND expires_at <= {_LIVE}")
def p12(get):
    return ledger.not_baselined(ledger.latest(get("ledger")), LEDGER_AS_OF).select("fingerprint", "type")


@query("p13_states", f"{_LAST} SELECT fingerprint, type AS state FROM last WHERE type IN ('observed', 'revoked')")
def p13(get):
    return ledger.with_state(ledger.latest(get("ledger")), "observed, revoked").select("fingerprint", "state")


@query("a10_summary", f"{_LAST} SELECT type AS state, rule_id, count(*) AS n FROM last GROUP BY ROLLUP (type, rule_id)")
def a10(get):
    return ledger.summary(ledger.with_state(ledger.latest(get("ledger"))))


@query("r06_state_export", f"""{_LAST} SELECT type AS state, '[' || string_agg('{{"fingerprint":"' || fingerprint || '","rule_id":"' || rule_id || '"}}', ',' ORDER BY fingerprint) || ']' AS items FROM last GROUP BY type""")
def r06(get):
    return ledger_files.export_states(ledger.with_state(ledger.latest(get("ledger"))), ["fingerprint", "rule_id"])


@query("r08_state_lines", f"""{_LAST} SELECT type AS state, '{{"fingerprint":"' || fingerprint || '","rule_id":"' || rule_id || '"}}' AS item FROM last""")
def r08(get):
    """The export of r06 as a line per item: its one array per state is as large as the state."""
    return ledger_files.export_lines(ledger.with_state(ledger.latest(get("ledger"))), ["fingerprint", "rule_id"])


@query("r06_export_sections", f"""{_LAST}, v AS (SELECT DISTINCT from_pkg_name AS boundary, to_path FROM {{edges}} WHERE from_pkg_name IN ('@acme/economy', '@acme/promo', '@acme/standard') AND NOT (NOT is_external AND starts_with(to_path, from_pkg_root || '/'))),
    x AS (SELECT axiom_id, CASE arg_max(type, ord) WHEN 'declared' THEN 'active' ELSE arg_max(type, ord) END AS state FROM {{axioms}} GROUP BY axiom_id)
    SELECT 'findings' AS section, '{{"state":"' || type || '","fingerprint":"' || fingerprint || '","rule_id":"' || rule_id || '"}}' AS item FROM last
    UNION ALL SELECT 'axioms', '{{"state":"' || state || '","axiom_id":"' || axiom_id || '"}}' FROM x
    UNION ALL SELECT 'insights', '{{"boundary":"' || boundary || '","violation_count":' || CAST(count(*) AS STRING) || '}}' FROM v GROUP BY boundary""")
def r06_sections(get):
    """Findings, axioms and an insight in one export."""
    states = ledger.with_state(ledger.latest(get("ledger")))
    bounds = erosion.boundaries(erosion.findings_for(_coupling(get), ["coupling/pure-imports"]))
    return ledger_files.export_sections(findings=(states, ["state", "fingerprint", "rule_id"]), axioms=(ledger.axiom_states(get("axioms")), ["state", "axiom_id"]), insights=(bounds, ["boundary", "violation_count"]))


@query("w02_rejected_transitions", "SELECT fingerprint, ord, type FROM (SELECT *, lag(type) OVER w AS was, lag(expires_at) OVER w AS until FROM {ledger} WINDOW w AS (PARTITION BY fingerprint ORDER BY ord)) x WHERE type IN ('observed', 'unverified') AND was = 'baselined' AND until > timestamp")
def w02(get):
    return ledger.rejected_transitions(get("ledger")).select("fingerprint", "ord", "type")


_OUTCOME = f"""{_LAST}, o AS (
  SELECT coalesce(l.fingerprint, c.fingerprint) AS fingerprint, l.type AS was, c.fingerprint IS NOT NULL AS present, coalesce(c.requires_verification, false) AS review,
         coalesce(l.type = 'baselined' AND l.expires_at > {_LIVE}, false) AS live, coalesce(l.type = 'baselined' AND NOT l.expires_at > {_LIVE}, false) AS expired
  FROM last l FULL JOIN {{current}} c ON l.fingerprint = c.fingerprint),
f AS (SELECT *, present AND (was IS NULL OR expired OR was = 'resolved') AS is_new, NOT present AND was IN ('observed', 'unverified', 'baselined') AS gone, present AND NOT live AND coalesce(was, '') <> 'revoked' AS visible FROM o)"""


def _outcome(get: Get) -> DataFrame:
    return ledger.reconcile(get("current"), ledger.latest(get("ledger")), LEDGER_AS_OF)


@query("j06_reconcile", f"{_OUTCOME} SELECT fingerprint, was, present, is_new, gone AS auto_resolved, live AS baselined, expired, visible, CASE WHEN gone THEN 'resolved' WHEN is_new AND review THEN 'unverified' WHEN is_new THEN 'observed' END AS event FROM f")
def j06(get):
    return _outcome(get).select("fingerprint", "was", "present", "is_new", "auto_resolved", "baselined", "expired", "visible", "event")


@query("a09_verdict", f"{_OUTCOME} SELECT count(*) FILTER (WHERE present AND was = 'resolved' AND NOT review) AS regressions, count(*) FILTER (WHERE present AND was = 'resolved' AND review) AS regressions_to_review, count(*) FILTER (WHERE expired AND present) AS expired_baselines, count(*) FILTER (WHERE visible) AS visible, count(*) FILTER (WHERE visible AND NOT review) AS actionable, count(*) FILTER (WHERE visible AND NOT review) + count(*) FILTER (WHERE present AND was = 'resolved') + count(*) FILTER (WHERE expired AND present) > 0 AS failed FROM f")
def a09(get):
    return ledger.verdict(_outcome(get))


@query("u05_events_to_write", f"{_OUTCOME} SELECT CASE WHEN gone THEN 0 ELSE 1 END AS phase, fingerprint, CASE WHEN gone THEN 'resolved' WHEN review THEN 'unverified' ELSE 'observed' END AS type FROM f WHERE gone OR is_new")
def u05(get):
    return ledger.events_to_write(_outcome(get))


@query("u03_visible", f"{_OUTCOME} SELECT fingerprint FROM f WHERE visible")
def u03(get):
    return _outcome(get).where("visible").select("fingerprint")


@query("u04_new", f"{_OUTCOME} SELECT fingerprint FROM f WHERE is_new")
def u04(get):
    return _outcome(get).where("is_new").select("fingerprint")


_REQUESTS = "SELECT DISTINCT fingerprint, CASE ord % 4 WHEN 0 THEN 'resolve' WHEN 1 THEN 'verify' WHEN 2 THEN 'dismiss' ELSE 'reopen' END AS action FROM {ledger} UNION ALL SELECT 'no such finding', 'resolve'"


@query(
    "j07_decisions",
    f"""{_LAST}, r AS ({_REQUESTS}), c AS (SELECT fingerprint FROM r WHERE action IN ('dismiss', 'reopen') GROUP BY fingerprint HAVING count(DISTINCT action) = 2),
    x AS (SELECT r.fingerprint, action, type AS state, c.fingerprint IS NOT NULL AND action IN ('dismiss', 'reopen') AS clash FROM r LEFT JOIN last USING (fingerprint) LEFT JOIN c USING (fingerprint))
    SELECT fingerprint, action, state, CASE WHEN clash THEN NULL WHEN action = 'resolve' AND state IN ('observed', 'baselined') THEN 'resolved' WHEN action = 'verify' AND state = 'unverified' THEN 'observed'
      WHEN action = 'dismiss' AND state = 'unverified' THEN 'revoked' WHEN action = 'reopen' AND state = 'revoked' THEN 'unverified' END AS event,
      action = 'resolve' AND coalesce(state, '') = 'baselined' AS warns FROM x""",
)
def j07(get):
    rows = get("ledger")
    action = F.element_at(F.array(*map(F.lit, ("resolve", "verify", "dismiss", "reopen"))), (F.col("ord") % 4 + 1).cast("int"))
    requests = rows.select("fingerprint", action.alias("action")).distinct()
    requests = requests.unionByName(rows.sparkSession.createDataFrame([("no such finding", "resolve")], "fingerprint string, action string"))
    return ledger.decide(requests, ledger.latest(rows)).select("fingerprint", "action", "state", "event", F.coalesce("warns", F.lit(False)).alias("warns"))


@query("j08_axiom_links", "SELECT 'axiom' || CAST(o_orderkey AS STRING) AS axiom_id, 'missing' || CAST(o_orderkey AS STRING) AS missing FROM {orders} WHERE o_orderkey % 2 = 0")
def j08(get):
    last = ledger.latest(get("ledger"))
    first = last.agg(F.min("fingerprint").alias("f"))
    links = F.when(F.col("o_orderkey") % 2 == 0, F.concat("f", F.lit(" , missing"), F.col("o_orderkey").cast("string"), F.lit(",,"))).otherwise(F.col("f"))
    declared = get("orders").join(F.broadcast(first), how="cross").select(F.concat(F.lit("axiom"), F.col("o_orderkey").cast("string")).alias("axiom_id"), links.alias("links"))
    return ledger.missing_links(declared, last)


_AXIOM = "SELECT axiom_id, CASE arg_max(type, ord) WHEN 'declared' THEN 'active' ELSE arg_max(type, ord) END AS state, arg_max(scope, ord) FILTER (WHERE type = 'declared') AS scope FROM {axioms} GROUP BY axiom_id"


@query("p14_axioms", _AXIOM)
def p14(get):
    return ledger.axiom_states(get("axioms")).select("axiom_id", "state", "scope")


@query("j09_axiom_decisions", f"SELECT r.axiom_id, CASE WHEN s.state IS NULL THEN 'unknown axiom' WHEN s.state <> 'active' THEN 'axiom is ' || s.state END AS rejected FROM (SELECT 'axiom' || CAST(c_custkey AS STRING) AS axiom_id FROM {{customer}}) r LEFT JOIN ({_AXIOM}) s ON r.axiom_id = s.axiom_id")
def j09(get):
    asked = get("customer").select(F.concat(F.lit("axiom"), F.col("c_custkey").cast("string")).alias("axiom_id"))
    return ledger.axiom_decisions(asked, ledger.axiom_states(get("axioms"))).select("axiom_id", "rejected")


@query("x07_baseline", f"{_LAST} SELECT fingerprint, 'baselined' AS type, TIMESTAMP '2024-03-01 00:00:00' AS expires_at FROM last WHERE type = 'observed' OR type = 'baselined' AND expires_at <= {_LIVE}")
def x07(get):
    return ledger.baseline_events(ledger.latest(get("ledger")), LEDGER_AS_OF).select("fingerprint", "type", "expires_at")


@query("p16_lookup", f"{_LAST} SELECT fingerprint, type FROM last WHERE fingerprint IN (SELECT fingerprint FROM {{current}})")
def p16(get):
    return ledger.lookup(ledger.latest(get("ledger")), get("current")).select("fingerprint", "type")


# ---- insight


def _coupling(get: Get) -> DataFrame:
    e = _edges(get)
    names = [f"@acme/{k}" for k in ("economy", "promo", "standard")]
    both = boundary.violations(e, *map(boundary.Layer, names))
    folded = identity.count_findings(both.withColumn("package_root", F.get_json_object(F.get("artifacts", F.lit(0))["data"], "$.packageRoot")))
    return folded.select("rule_id", "instance_id", "fingerprint", "package_root", "dependency")


_BOUNDS = """WITH v AS (SELECT DISTINCT from_pkg_name AS boundary, from_pkg_root AS root, to_path FROM {edges} WHERE from_pkg_name IN ('@acme/economy', '@acme/promo', '@acme/standard') AND NOT (NOT is_external AND starts_with(to_path, from_pkg_root || '/'))),
  b AS (SELECT boundary, root, count(*) AS violation_count FROM v GROUP BY boundary, root)"""


@query("a06_boundaries", f"{_BOUNDS} SELECT boundary, root || '/**' AS root, violation_count FROM b")
def a06(get):
    return erosion.boundaries(erosion.findings_for(_coupling(get), ["coupling/pure-imports"])).select("boundary", "root", "violation_count")


_EROSION = "SELECT boundary, CAST(sum(count) AS BIGINT) AS churn_total, count(*) AS hot_files, arg_min(path, (-count, path)) AS hottest, any_value(violation_count) AS violation_count"
_CHURN = f"c AS (SELECT path, count(*) AS count {_WINDOW} GROUP BY path)"


@query("a08_erosion", f"{_BOUNDS}, {_CHURN}, e AS ({_EROSION} FROM b JOIN c ON starts_with(path, root || '/') GROUP BY boundary) SELECT *, row_number() OVER (ORDER BY churn_total DESC, boundary) AS place FROM e")
def a08(get):
    counts = git_rules.churn_counts(get("commits"), get("changes"), AS_OF, 90)
    found = erosion.erosion(erosion.boundaries(_coupling(get)), counts)
    return found.select("boundary", "churn_total", "hot_files", "hottest", "violation_count", "place")


@query("a08_erosion_of_globs", f"""WITH {_CHURN}, r AS (SELECT DISTINCT replace(p_brand, '#', '') AS brand, p_size % 3 AS k, 1 AS violation_count FROM {{part}}),
  e AS ({_EROSION} FROM (SELECT brand || CAST(k AS STRING) AS boundary, path, count, violation_count FROM r JOIN c ON CASE k WHEN 0 THEN path LIKE '%/' || brand || '/%' WHEN 1 THEN path LIKE '%/src/' || brand || '/part_.ts' ELSE path LIKE 'packages/%/src/' || brand || '/%7.ts' END) m GROUP BY boundary)
  SELECT *, row_number() OVER (ORDER BY churn_total DESC, boundary) AS place FROM e""")
def a08_globs(get):
    """Boundaries whose roots are globs without a leading directory, with a wildcard inside, and with both."""
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    kind = F.col("p_size") % 3
    root = F.when(kind == 0, F.concat(F.lit("**/"), brand, F.lit("/**"))).when(kind == 1, F.concat(F.lit("**/src/"), brand, F.lit("/part?.ts"))).otherwise(F.concat(F.lit("packages/*/src/"), brand, F.lit("/*7.ts")))
    bounds = get("part").select(F.concat(brand, kind.cast("string")).alias("boundary"), root.alias("root"), F.lit(1).alias("violation_count"), F.lit("").alias("sample")).distinct()
    counts = git_rules.churn_counts(get("commits"), get("changes"), AS_OF, 90)
    return erosion.erosion(bounds, counts).select("boundary", "churn_total", "hot_files", "hottest", "violation_count", "place")


@query("x05_insight", f"{_BOUNDS} SELECT 'boundaries' AS insight, boundary AS name, violation_count AS n FROM b UNION ALL SELECT 'by_rule', 'coupling/pure-imports@v1', sum(violation_count)::BIGINT FROM b HAVING count(*) > 0 UNION ALL SELECT 'by_rule', 'git/churn@v1', count(*) FROM (SELECT path {_WINDOW} GROUP BY path HAVING count(*) >= 3) c HAVING count(*) > 0")
def x05(get):
    """Two insights over the findings of two rules; each sees only the rules that it asks for."""
    churn = git_rules.churn_findings(git_rules.churn_counts(get("commits"), get("changes"), AS_OF, 90), 3)
    findings = _coupling(get).unionByName(churn.select("rule_id", "instance_id", "fingerprint"), allowMissingColumns=True)
    parts = [
        runner.Insight("boundaries", ("coupling/pure-imports",), lambda f: erosion.boundaries(f).select(F.col("boundary").alias("name"), F.col("violation_count").alias("n"))),
        runner.Insight("by_rule", ("coupling/pure-imports", "git/churn"), lambda f: f.groupBy(F.col("rule_id").alias("name")).agg(F.count(F.lit(1)).alias("n"))),
    ]
    return reduce(DataFrame.unionByName, [rows.select(F.lit(k).alias("insight"), "name", "n") for k, rows in runner.insights(findings, parts).items()])


@query("s21_display", f"SELECT 'churn' AS kind, path AS file, CAST(count(*) AS STRING) AS changes, NULL AS dependency {_WINDOW} GROUP BY path HAVING count(*) >= 3 UNION ALL SELECT 'import', file || ':' || CAST(line AS STRING) || ':' || CAST(col AS STRING), NULL, to_path {_CROSS}")
def s21(get):
    churn = git_rules.churn_findings(git_rules.churn_counts(get("commits"), get("changes"), AS_OF, 90), 3)
    rows = churn.select("fingerprint", "artifacts").unionByName(boundary.violations(_edges(get), boundary.Layer(_ECONOMY)).select("fingerprint", "artifacts"))
    shown = identity.evidence(rows).select("kind", identity.display(F.col("kind"), F.col("data")).alias("m"))
    return shown.select("kind", *(F.col("m").getItem(k).alias(k) for k in ("file", "changes", "dependency")))


# ---- scoring


@query("s14_tokens", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM {documents}")
def s14(get):
    return get("documents").select("doc_id", budget.tokens(F.col("text")).alias("tokens"))


@query("s18_cache_keys", "SELECT doc_id, SHA[lang || chr(31) || source] AS key FROM {documents}")
def s18(get):
    return get("documents").select("doc_id", budget.cache_key(F.col("lang"), F.col("source")).alias("key"))


@query("a11_usage", "SELECT CAST(sum(tokens) AS BIGINT) AS input_tokens, CAST(count(*) * 29 AS BIGINT) AS output_tokens, CAST(sum(tokens) + count(*) * 29 * 5 AS BIGINT) AS micro_cost FROM {items}")
def a11(get):
    per = budget.output_estimate({"type": "object", "properties": {"confidence": {"type": "number"}, "flag": {"type": "boolean"}, "ok": {"type": "integer"}}}) - 6
    rows = get("items").select(F.col("tokens").alias("input_tokens"), F.lit(per).cast("long").alias("output_tokens")).withColumn("cost", budget.cost(F.col("input_tokens"), F.col("output_tokens"), 1e-6, 5e-6))
    return scoring.usage(rows).select("input_tokens", "output_tokens", F.round(F.col("cost") * 1e6).cast("long").alias("micro_cost"))


@query("j12_cache_plan", "SELECT cache_key, CASE WHEN original_index % 3 = 0 THEN 'hit' ELSE 'miss' END AS part FROM {items} UNION ALL SELECT SHA['old' || CAST(doc_id AS STRING)], 'stale' FROM {labels}")
def j12(get):
    items = get("items")
    cache = items.where("original_index % 3 = 0").select("cache_key").unionByName(get("labels").select(F.sha2(F.concat(F.lit("old"), F.col("doc_id").cast("string")), 256).alias("cache_key")))
    return scoring.cache_plan(items, cache)


@query(
    "w06_batches",
    """WITH RECURSIVE i AS (SELECT original_index, tokens, row_number() OVER (ORDER BY original_index) AS n FROM {items}),
    b AS (SELECT n, original_index, tokens AS used, 1 AS held, 0 AS batch_no FROM i WHERE n = 1
      UNION ALL SELECT i.n, i.original_index, CASE WHEN used + tokens > 10000 OR held >= 20 THEN tokens ELSE used + tokens END, CASE WHEN used + tokens > 10000 OR held >= 20 THEN 1 ELSE held + 1 END, batch_no + CASE WHEN used + tokens > 10000 OR held >= 20 THEN 1 ELSE 0 END
      FROM b JOIN i ON i.n = b.n + 1)
    SELECT original_index, batch_no FROM b""",
)
def w06(get):
    return scoring.batches(get("items").select("original_index", "tokens"), 10_000, 20).select("original_index", "batch_no")


@query("x03_scores", "SELECT doc_id AS original_index, CAST(length(text) % 7 AS BIGINT) AS confidence FROM {documents}")
def x03(get):
    """A scorer that says the text's length modulo 7, in reverse order, over packed batches; texts come to their batches by index."""
    def scorer(keys, texts):
        return [(k, float(len(t) % 7)) for k, t in zip(keys, texts, strict=True)][::-1]

    texts = get("documents").select(F.col("doc_id").alias("original_index"), F.col("text").alias("serialized"))
    return scoring.score_batches(scoring.batches(get("items"), 10_000, 20).join(texts, "original_index"), scorer).select("original_index", F.col("confidence").cast("long").alias("confidence"))


_KNOWN = "CASE WHEN i.tokens % 3 = 0 THEN 1000 + i.tokens ELSE CAST(length(d.text) % 7 AS BIGINT) END AS confidence"


def _merged(get: Get) -> DataFrame:
    """Items whose cost is a multiple of 3 have a cached score; the others are packed and scored. The cache also has stale keys."""
    items, texts = get("items"), get("documents").select(F.col("doc_id").alias("original_index"), F.col("text").alias("serialized"))
    cache = items.where("tokens % 3 = 0").select("cache_key", (F.lit(1000.0) + F.col("tokens")).alias("confidence"))
    cache = cache.unionByName(get("labels").select(F.sha2(F.concat(F.lit("old"), F.col("doc_id").cast("string")), 256).alias("cache_key"), F.lit(-1.0).alias("confidence")))
    misses = items.join(cache, "cache_key", "left_anti")
    scorer = lambda keys, found: [(k, float(len(t) % 7)) for k, t in zip(keys, found, strict=True)]
    fresh = scoring.score_batches(scoring.batches(misses, 10_000, 20).join(texts, "original_index"), scorer)
    return scoring.merge_results(items, cache, fresh)


@query("o03_merged_scores", f"SELECT original_index, cache_key, {_KNOWN}, i.tokens % 3 = 0 AS cached FROM {{items}} i JOIN {{documents}} d ON original_index = doc_id")
def o03(get):
    return _merged(get).select("original_index", "cache_key", F.col("confidence").cast("long").alias("confidence"), "cached")


@query("j12_next_cache", f"SELECT cache_key, {_KNOWN} FROM {{items}} i JOIN {{documents}} d ON original_index = doc_id")
def j12_kept(get):
    return scoring.next_cache(_merged(get)).select("cache_key", F.col("confidence").cast("long").alias("confidence"))


# ---- extraction


@query("e02_literals", "SELECT page_id, 'string' AS kind, '</p>' AS value FROM {pages} UNION ALL SELECT page_id, 'number', regexp_extract(html, 'track[(]([0-9]+)[)]', 1) FROM {pages}")
def e02(get):
    """Literals of all scripts of the pages."""
    return extraction.literals(extraction.page_scripts(get("pages"))).select("page_id", "kind", "value")


def _commented() -> Column:
    return F.concat(F.lit("\n/* import 'no'; "), F.replace(F.coalesce("html", F.lit("")), F.lit("*/"), F.lit("* /")), F.lit(" x.join('no') */"))


@query("e01_imports", "SELECT page_id, '@x/' || CAST(page_id % 7 AS STRING) AS specifier, true AS is_external, CAST(2 AS INT) AS line FROM {pages} UNION ALL SELECT page_id, './lib/' || CAST(page_id % 3 AS STRING), false, 1 FROM {pages}")
def e01(get):
    """Imports of sources written from the pages, whose whole html is a comment of them; types and comments don't count."""
    i = F.col("page_id")
    text = F.concat(F.lit("import a from './lib/"), (i % 3).cast("string"), F.lit("'; import type T from './t'\nconst b = require('@x/"), (i % 7).cast("string"), F.lit("') // require('no')\n"))
    found = extraction.imports(get("pages").select("page_id", F.concat(text, _commented()).alias("content")))
    return found.select("page_id", "specifier", paths.is_external(F.col("specifier")).alias("is_external"), "line")


@query("e03_bindings", "SELECT page_id, 'pack-unpack' AS pattern_id, 'packer' AS role, CAST(page_id % 4 AS STRING) AS binding_key, 'f' AS containing_function FROM {pages} UNION ALL SELECT page_id, 'pack-unpack', 'unpacker', ':', 'f' FROM {pages}")
def e03(get):
    text = F.concat(F.lit("function f(x) { return x.join('"), (F.col("page_id") % 4).cast("string"), F.lit("') + x.split(\":\") + x.split(y) + new Date(x) }"))
    found = extraction.bindings(extraction.calls(get("pages").select("page_id", F.concat(text, _commented()).alias("content"))))
    return found.select("page_id", "pattern_id", "role", "binding_key", "containing_function")


@query("e04_page_imports", """SELECT page_id, specifier, NOT starts_with(specifier, '.') AS is_external, CAST(line AS INT) AS line FROM (
    SELECT page_id, unnest(h) AS specifier, unnest(range(1, len(h) + 1)) AS line FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM {pages}) a) x""")
def e04(get):
    """Every anchor of the pages as an import."""
    found = extraction.imports(extraction.page_links(get("pages")))
    return found.select("page_id", "specifier", paths.is_external(F.col("specifier")).alias("is_external"), "line")


@query("e05_page_bindings", "SELECT page_id, 'tracker' AS pattern_id, 'track' AS role, 'track' AS function_name, '' AS binding_key FROM (SELECT page_id, unnest(regexp_extract_all(html, '\\btrack[(]', 0)) AS c FROM {pages}) x")
def e05(get):
    """Bindings of all scripts of the pages; the presets, and a pattern of the calls that these pages make."""
    matchers = (*extraction.PRESETS, ("tracker", "track", "call", r"^track$", None))
    found = extraction.bindings(extraction.calls(extraction.page_scripts(get("pages"))), matchers)
    return found.select("page_id", "pattern_id", "role", "function_name", "binding_key")


@query("e06_depends_on", """SELECT 'sites/' || CAST(page_id % 7 AS STRING) || '/pages/p' || CAST(page_id AS STRING) || '.html' AS from_path, '@site/' || CAST(page_id % 7 AS STRING) AS from_pkg_name, 'sites/' || CAST(page_id % 7 AS STRING) AS from_pkg_root, CAST(line AS INT) AS line,
    CASE WHEN starts_with(h, '/t') THEN h ELSE 'sites/' || CAST(page_id % 7 AS STRING) || '/pages' || h END AS to_path, starts_with(h, '/t') AS is_external, CASE WHEN starts_with(h, '/t') THEN h END AS to_pkg_name
    FROM (SELECT page_id, unnest(h) AS h, unnest(range(1, len(h) + 1)) AS line FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM {pages}) a) x""")
def e06(get):
    """Every anchor of the pages as an import of a page beside it, or of something external; sites are the packages."""
    site = F.concat(F.lit("sites/"), (F.col("page_id") % 7).cast("string"))
    sources = extraction.page_links(get("pages")).select(F.concat(site, F.lit("/pages/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("file"), F.regexp_replace("content", '(?m)^import "/(?!t)', 'import "./').alias("content"))
    packages = get("pages").select(F.concat(F.lit("@site/"), (F.col("page_id") % 7).cast("string")).alias("name"), site.alias("root_path")).distinct()
    found = extraction.depends_on(extraction.imports(sources), packages)
    return found.select("from_path", "from_pkg_name", "from_pkg_root", "line", "to_path", "is_external", "to_pkg_name")


_TEXT_LINES = "SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {documents}) t"


def _written(get: Get, line) -> DataFrame:
    """(doc_id, content): a source a document, with ``line(size, number)`` for each line of its text, inside a class of its name."""
    sizes = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: line(F.length(x).cast("string"), i.cast("string")))
    return get("documents").select("doc_id", F.concat(F.lit("export class D"), F.col("doc_id").cast("string"), F.lit(" extends Base<{a: string}> {\n"), F.array_join(sizes, "\n"), F.lit("\n}\nx.join('end')")).alias("content"))


@query(
    "e07_containers",
    f"""WITH l AS ({_TEXT_LINES}), b AS (
    SELECT doc_id, CAST(length(line) AS STRING) AS binding_key, 'packer' AS role, 'D' || CAST(doc_id AS STRING) || '.m' || CAST(i AS STRING) AS containing_function, CAST(i + 2 AS INT) AS line FROM l
    UNION ALL SELECT doc_id, '|' || CAST(length(line) AS STRING), 'unpacker', 'g' || CAST(i AS STRING), CAST(i + 2 AS INT) FROM l
    UNION ALL SELECT doc_id, 'end', 'packer', NULL, CAST(count(*) + 3 AS INT) FROM l GROUP BY doc_id) SELECT * FROM b""",
)
def e07(get):
    """Bindings inside methods and arrow functions of sources that are written from whole documents; the last one is in no function."""
    line = lambda n, i: F.concat(F.lit("  m"), i, F.lit("(a: {k: string}): string { const g"), i, F.lit(" = (y: string[]) => { return z.split('|"), n, F.lit("') }; return a.join('"), n, F.lit("') }"))
    found = extraction.bindings(extraction.calls(_written(get, line)))
    return found.select("doc_id", "binding_key", "role", "containing_function", "line")


@query("e08_contexts", f"WITH l AS ({_TEXT_LINES}) SELECT doc_id, 'string' AS kind, 'v' || CAST(length(line) AS STRING) AS value, CAST(i + 2 AS INT) AS line FROM l UNION ALL SELECT doc_id, 'number', CAST(i AS STRING), CAST(i + 2 AS INT) FROM l UNION ALL SELECT doc_id, 'string', 'end', CAST(count(*) + 3 AS INT) FROM l GROUP BY doc_id")
def e08(get):
    """Literals of sources that are written from whole documents: of members' names, comparisons with a type and specifiers none."""
    line = lambda n, i: F.concat(F.lit("  f: { 't"), n, F.lit("': string } = typeof x === 'u"), n, F.lit("' ? { 'v"), n, F.lit("': "), i, F.lit(" } : 'w' !== typeof import.meta; // 'no'"))
    return extraction.literals(_written(get, line)).select("doc_id", "kind", "value", "line")


# ---- files


@query("r07_sources", "SELECT DISTINCT path FROM {changes} WHERE path NOT LIKE '%/Brand11/%' AND status <> 'renamed'")
def r07(get):
    """The files of all changes as overlapping sets, renamed ones under a vendored folder."""
    path = F.when(F.col("status") == "renamed", F.concat(F.lit("node_modules/"), "path")).otherwise(F.col("path"))
    return ledger_files.list_sources(get("changes").select(path.alias("path")), ("**/Brand11/**",))


def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as Parquet in the shared folder; of two tables only the one that is needed is read."""
    folder = _shared_folder(spark)
    fact(spark, sf_dir, "constants").withColumnRenamed("col", "column").write.parquet(f"{folder}/constants")
    fact(spark, sf_dir, "packages").write.parquet(f"{folder}/packages")
    read = ledger_files.read_facts(spark, folder, ["constants"])
    return reduce(DataFrame.unionByName, [t.groupBy(F.lit(k).alias("fact"), "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files")) for k, t in read.items()])


def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger appended to a file in two runs, revocations in the second, and read again: the latest event by entry id."""
    path, rows = f"{_shared_folder(spark)}/ledger.ndjson", fact(spark, sf_dir, "ledger")
    for k, part in enumerate(("type <> 'revoked'", "type = 'revoked'")):
        ledger_files.append_ledger(ledger_files.stamp(rows.where(part), f"run{k}", k, ["ord"]).drop("ord"), path)
    return ledger.latest(ledger_files.read_ledger(spark, path), order="entry_id").select("fingerprint", "type", "run_id", "rule_id")


def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the ledger as an earlier run; the rest is checked and appended twice over, which adds it once."""
    path, rows = f"{_shared_folder(spark)}/ledger.ndjson", fact(spark, sf_dir, "ledger").withColumn("note", F.col("ord").cast("string"))
    ledger_files.append_ledger(ledger_files.stamp(rows.where("ord % 4 <> 0"), "old", 0, ["ord"]).drop("ord"), path)
    late = rows.where("ord % 4 = 0")
    rejected = [ledger_files.append_run(late, path, "new", LEDGER_AS_OF, ["ord"]).select("ord") for _ in range(2)]
    written = ledger_files.read_ledger(spark, path).where("run_id = 'new'").groupBy(F.col("note").cast("long").alias("ord")).agg(F.count(F.lit(1)).alias("times"), F.max(F.length("entry_id")).alias("id_size"))
    refused = reduce(DataFrame.unionByName, rejected).groupBy("ord").agg(F.count(F.lit(1)).alias("refused"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return late.select("fingerprint", "ord", "type").join(written, "ord", "left").join(refused, "ord", "left").select("fingerprint", "ord", "type", zero("times"), zero("refused"))


def e09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of the pages' scripts in two runs; every third page was another one in the first, so it alone is looked at in the second."""
    folder = _shared_folder(spark)
    pages = extraction.page_scripts(fact(spark, sf_dir, "pages"))
    before = pages.withColumn("content", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("old('x', "), F.col("page_id").cast("string"), F.lit(")"))).otherwise(F.col("content")))
    run = lambda s: fact_cache.collect(s, extraction.literals, folder, "constants", "kind string, value string, line int, column int", "tsconfig.json")
    run(before)
    facts, plan = run(pages)
    left = fact_cache.read_entries(pages, folder, "constants", "kind string, value string, line int, column int").select("cache_key").distinct().withColumn("kept", F.lit(True))
    return facts.join(plan, "cache_key").join(left, "cache_key", "left").select("page_id", "kind", "value", F.col("part").alias("was"), "kept")


def _projects(rows: DataFrame, kind: str, folder: str, number) -> None:
    """Three projects of every repository; a quarter of the files is in all of them."""
    for k in range(3):
        fact_tables.append_facts(rows.where((number % 4 == k) | (number % 4 == 3)), kind, folder, k)


def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of several projects in one bucketed table; of those that projects share, the first project's stays."""
    folder, number = _shared_folder(spark), F.regexp_extract("file", "[0-9]+", 0).cast("int")
    rows = fact(spark, sf_dir, "constants").withColumnRenamed("col", "column").withColumn("repo", F.concat(F.lit("r"), (number % 5).cast("string")))
    _projects(rows, "constants", folder, number)
    return fact_tables.merged(spark, "constants", folder).select("repo", "file", "line", F.col("column").alias("col"), "value", "source_order")


def u02_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional structures of several projects and their accesses meet by repository, as their tables lie."""
    folder = _shared_folder(spark)
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("int")
    repo = lambda c: F.concat(F.lit("r"), (number(c) % 3).cast("string"))
    found = fact(spark, sf_dir, "sources").withColumns({"repo": repo("name"), "line": F.lit(1), "column": F.lit(1)})
    reads = structures.origin(fact(spark, sf_dir, "accesses").withColumn("column", F.lit(1))).withColumn("repo", repo("of_name"))
    _projects(found, "positional_sources", folder, number("name"))
    _projects(reads, "positional_accesses", folder, number("of_name"))
    rows = structures.position_findings(*(fact_tables.merged(spark, k, folder) for k in ("positional_sources", "positional_accesses")), keys=("repo",))
    return rows.groupBy("repo", "file", "name").agg(F.count_if(F.col("what") == "access").alias("accesses"), F.count_if(F.col("what") == "source").alias("sources"))


QUERIES |= {"r03_read_facts": r03, "r04_ledger_file": r04, "r05_checked_append": r05, "e09_changed_pages": e09, "u02_projects": u02, "u02_rule_join": u02_rules}
ORACLE_SQL |= {
    "r03_read_facts": duck("SELECT 'constants' AS fact, kind, count(*) AS n, count(DISTINCT file) AS files FROM {constants} GROUP BY kind"),
    "r05_checked_append": duck("""WITH old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ord DESC) AS n FROM {ledger} WHERE ord % 4 <> 0) x WHERE n = 1),
        late AS (SELECT *, last_value(CASE WHEN type NOT IN ('observed', 'unverified') THEN {'t': type, 'u': expires_at} END IGNORE NULLS) OVER (PARTITION BY fingerprint ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {ledger} WHERE ord % 4 = 0),
        j AS (SELECT late.*, coalesce(late.type IN ('observed', 'unverified') AND CASE WHEN b IS NULL THEN old.type ELSE b.t END = 'baselined' AND CASE WHEN b IS NULL THEN old.expires_at ELSE b.u END > TIMESTAMP '2024-01-31 00:00:00', false) AS bad FROM late LEFT JOIN old ON old.fingerprint = late.fingerprint)
        SELECT fingerprint, ord, type, CAST(CASE WHEN bad THEN 0 ELSE 1 END AS BIGINT) AS times, CAST(CASE WHEN bad THEN 2 ELSE 0 END AS BIGINT) AS refused FROM j""".replace("{'t': type, 'u': expires_at}", "struct_pack(t := type, u := expires_at)")),
    "u02_projects": duck("SELECT 'r' || CAST(u % 5 AS STRING) AS repo, file, line, col, value, CAST(min(k) AS INT) AS source_order FROM (SELECT *, CAST(regexp_extract(file, '[0-9]+', 0) AS INT) AS u FROM {constants}) x JOIN (VALUES (0), (1), (2)) p(k) ON u % 4 = k OR u % 4 = 3 GROUP BY u, file, line, col, value"),
    "u02_rule_join": duck("""WITH a AS (SELECT DISTINCT file, name, coalesce(origin_file, file) AS of_file, coalesce(origin_name, name) AS of_name, accessed_index, line FROM {accesses})
        SELECT 'r' || CAST(CAST(substring(s.name, 5) AS INT) % 3 AS STRING) AS repo, s.file, s.name, count(*) AS accesses, CAST(1 AS BIGINT) AS sources FROM (SELECT DISTINCT file, name FROM {sources} WHERE is_heterogeneous) s JOIN a ON s.file = of_file AND s.name = of_name GROUP BY s.file, s.name"""),
    "e09_changed_pages": """WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS script FROM pages),
        v AS (SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM s o WHERE o.page_id % 3 <> 0 AND o.script = s.script) THEN 'hit' ELSE 'miss' END AS was FROM s)
        SELECT page_id, 'string' AS kind, '</p>' AS value, was, true AS kept FROM v UNION ALL SELECT page_id, 'number', regexp_extract(script, 'track[(]([0-9]+)[)]', 1), was, true FROM v""",
    "r04_ledger_file": duck("SELECT fingerprint, type, CASE WHEN type = 'revoked' THEN 'run1' ELSE 'run0' END AS run_id, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY type = 'revoked' DESC, ord DESC) AS n FROM {ledger}) x WHERE n = 1"),
}


# ---- streaming


def _shared_folder(spark: SparkSession) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _drain(df: DataFrame, mode: str) -> DataFrame:
    """What the stream writes, as Parquet with its state beside it: a folder a batch."""
    spark, folder, done = df.sparkSession, _shared_folder(df.sparkSession), []

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows-{k}")
        done.append(k)

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = [f"{folder}/rows-{k}" for k in dict.fromkeys(done)]
    return spark.read.schema(df.schema).parquet(*rows) if rows else spark.createDataFrame([], df.schema)


def _arriving(parts: list[DataFrame], job: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a stream writes as ``parts`` arrive one after the other; each starts the job again where it ended."""
    spark = parts[0].sparkSession
    folder, done = _shared_folder(spark), []

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/rows-{k}")
        done.append(f"{folder}/rows-{k}")

    for part in parts:
        part.write.mode("append").option("compression", "zstd").parquet(f"{folder}/in")
        stream = job(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
        stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*dict.fromkeys(done))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # the table is a file or a folder; as a pattern it may be either
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger fold over a stream of events."""
    e = _stream(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("fingerprint"), F.col("event_id").alias("ord"), F.col("event_type").alias("type"))
    out = _drain(jobs.fold_stream(rows), "update")  # a batch writes the findings that it changes
    return out.groupBy("fingerprint").agg(F.max_by("latest", "latest.ord").alias("latest")).select("fingerprint", "latest.ord", "latest.type")


def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn in tumbling windows over a stream of changes."""
    e = _stream(spark, sf_dir, "events")
    rows = e.select(F.col("ts").cast("timestamp").alias("date"), F.col("event_type").alias("path"))
    out = _drain(jobs.churn_stream(rows, "1 day", late="60 days"), "update")
    return out.groupBy(F.col("w.start").alias("day"), "path").agg(F.max("count").alias("count"))  # counts only grow


#: When the first and the second part of the events end.
_THIRDS = (datetime(2024, 1, 11), datetime(2024, 1, 21))


def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as state with timers, over batches out of order; the last one moves the clock beyond all baselines."""
    rows = fact(spark, sf_dir, "ledger").select("fingerprint", "ord", "type", "expires_at", "timestamp")
    clock = rows.agg((F.max("timestamp") + F.make_interval(years=F.lit(2))).alias("timestamp")).select(F.lit("clock").alias("fingerprint"), F.lit(0).cast("long").alias("ord"), F.lit("observed").alias("type"), F.lit(None).cast("timestamp").alias("expires_at"), "timestamp")
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        parts = [rows.where(F.pmod(F.xxhash64("ord"), F.lit(3)) == k) for k in (2, 0, 1)]
        out = _arriving([*parts, clock, clock.withColumn("ord", F.lit(1).cast("long"))], lambda s: jobs.state_stream(s, "60 days"), "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    # an end is reported of a latest event, so the last one that ended is the latest or was replaced
    last, ended = F.max_by(F.struct("ord", "type"), F.when(F.col("what") == "latest", F.col("ord"))), F.max(F.when(F.col("what") == "expired", F.col("ord")))
    found = out.where("fingerprint != 'clock'").groupBy("fingerprint").agg(last.alias("l"), ended.alias("ended"))
    return found.select("fingerprint", "l.*", F.coalesce(F.col("ended") == F.col("l.ord"), F.lit(False)).alias("expired"))


def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn in sliding windows in append mode: windows are written once, when the watermark has passed them; a third batch is too late and changes nothing."""
    e = fact(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("date"), F.col("event_type").alias("path"), "event_id")
    early, late = F.col("date") < F.lit(_THIRDS[0]), F.col("event_id") % 10 == 3
    parts = [e.where(~(early & late) & (F.col("date") < F.lit(_THIRDS[1]))), e.where(F.col("date") >= F.lit(_THIRDS[1])), e.where(early & late)]
    clock = e.agg((F.max("date") + F.make_interval(years=F.lit(1))).alias("date"))
    clock = clock.select("date", F.lit("clock").alias("path"), F.lit(0).cast("long").alias("event_id"))
    out = _arriving([x.select("date", "path") for x in (*parts, clock, clock)], lambda s: jobs.churn_stream(s, "2 days", "1 day", late="1 day"), "append")
    return out.where("path != 'clock'").select(F.col("w.start").alias("day"), "path", "count")


QUERIES |= {"t01_stream_fold": t01, "t02_stream_churn": t02, "t03_stream_state": t03, "t04_sliding_churn": t04}
ORACLE_SQL |= {
    "t01_stream_fold": "SELECT CAST(user_id AS VARCHAR) AS fingerprint, max(event_id) AS ord, arg_max(event_type, event_id) AS type FROM events GROUP BY user_id",
    "t02_stream_churn": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type AS path, count(*) AS count FROM events GROUP BY 1, 2",
    "t03_stream_state": duck("SELECT fingerprint, ord, type, type = 'baselined' AS expired FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ord DESC) AS n FROM {ledger}) x WHERE n = 1"),
    "t04_sliding_churn": f"""SELECT day, event_type AS path, count(*) AS count FROM (SELECT event_type, unnest([CAST(date_trunc('day', ts) AS TIMESTAMP), CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 1 DAY]) AS day
        FROM events WHERE NOT (ts < TIMESTAMP '{_THIRDS[0]}' AND event_id % 10 = 3)) x GROUP BY 1, 2""",
}


# ---- runner


@query("x06_runner", "SELECT fingerprint, n, requires_verification FROM (SELECT SHA[" + _json('{"data":{"path":"', "path", '"},"ruleId":"git/churn@v1"}') + f"] AS fingerprint, CAST(1 AS BIGINT) AS n, false AS requires_verification FROM (SELECT path {_WINDOW} GROUP BY path HAVING count(*) >= 3) c UNION ALL SELECT SHA[{_LITERAL_ID}], CAST(count(*) AS BIGINT), true FROM {{constants}} GROUP BY kind, value HAVING count(DISTINCT file) >= 2) x")
def x06(get):
    """Two rules over two collectors; literals are supplied by an enricher, so their findings await verification."""
    git = runner.Collector("git", ("git_commits", "git_file_changes"), lambda _: {"git_commits": get("commits"), "git_file_changes": get("changes")})
    lit = runner.Enricher("literals", ("git_commits",), ("constants",), lambda _: {"constants": get("constants").withColumnRenamed("col", "column")})

    def churn(facts):
        found = git_rules.churn_findings(git_rules.churn_counts(facts["git_commits"], facts["git_file_changes"], AS_OF, 90), 3)
        return found.withColumn("ord", F.struct("path"))

    def literal(facts):
        found = grouping.literal_findings(facts["constants"])
        return found.withColumn("instance_id", F.col("rule_id")).withColumn("message", F.col("value")).withColumn("ord", F.struct("kind", "value"))

    rules = [runner.Rule("churn", ("git_commits", "git_file_changes"), churn), runner.Rule("literals", ("constants",), literal), runner.Rule("idle", ("call_nodes",), churn)]
    found = runner.run([git], rules, [lit]).findings
    return found.select("fingerprint", "n", "requires_verification")


@query("x06_warnings", "SELECT 'layer' AS rule, p AS warning FROM (VALUES ('@supp/nation_1'), ('@typo/**'), ('packages/promo/**')) v(p) WHERE EXISTS (SELECT 1 FROM {edges}) AND NOT EXISTS (SELECT 1 FROM {edges} WHERE to_path = p OR starts_with(to_path, replace(p, '/**', '') || '/'))")
def x06_warnings(get):
    """A layer's patterns that match no import come back as warnings of its rule."""
    allowed = ("@supp/nation_1", "@typo/**", "packages/promo/**")
    ts = runner.Collector("ts", ("depends_on",), lambda _: {"depends_on": _edges(get)})
    layer = runner.Rule("layer", ("depends_on",), lambda f: boundary.violations(f["depends_on"], boundary.Layer(_ECONOMY, allows=allowed)), lambda f: boundary.idle_patterns(f["depends_on"], allowed).withColumnRenamed("pattern", "warning"))
    return runner.run([ts], [layer]).warnings
