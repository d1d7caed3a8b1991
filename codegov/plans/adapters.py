"""Fact tables derived from the driver's tables, in SQL that Spark and DuckDB both read.

``{name}`` stands for a table. Two things are spelled differently by the two and have placeholders: SHA[..] is the hex
SHA-256 of a text, and DAYS[..] an interval of that many days.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF, LEDGER_AS_OF = datetime(2001, 8, 1), datetime(2024, 1, 31)

FACTS = {
    "commits": "SELECT CAST(o_orderkey AS STRING) AS hash, CAST(o_custkey AS STRING) AS author, CAST(o_orderdate AS TIMESTAMP) AS date, o_orderpriority AS subject FROM {orders}",
    "paths": "SELECT p_partkey, p_size, p_brand, lower(p_type) AS pkg, 'packages/' || lower(p_type) || '/src/' || replace(p_brand, '#', '') || '/part' || CAST(p_partkey AS STRING) || '.ts' AS path FROM {part}",
    "changes": "SELECT CAST(l_orderkey AS STRING) AS hash, path, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'N' THEN 'modified' ELSE 'renamed' END AS status FROM {lineitem} JOIN {paths} ON l_partkey = p_partkey",
    "edges": """
        SELECT a.path AS from_path, '@acme/' || a.pkg AS from_pkg_name, 'packages/' || a.pkg AS from_pkg_root, a.path AS file, CAST(l_orderkey % 400 AS INT) AS line, CAST(l_linenumber AS INT) AS col,
               CASE WHEN l_linenumber % 3 = 0 THEN '@supp/nation_' || CAST(s_nationkey AS STRING) ELSE b.path END AS to_path, l_linenumber % 3 = 0 AS is_external
        FROM (SELECT *, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM {part}) AS target FROM {lineitem}) l
        JOIN {paths} a ON l_partkey = a.p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {paths} b ON b.p_partkey = target""",
    "constants": """
        SELECT 'src/u' || CAST(user_id AS STRING) || '.ts' AS file, 'string' AS kind, event_type AS value, CAST(event_id % 500 AS INT) AS line, 1 AS col FROM {events}
        UNION ALL SELECT 'src/u' || CAST(user_id AS STRING) || '.ts', 'number', regexp_extract(props, '[0-9]+', 0), CAST(event_id % 500 AS INT), 9 FROM {events}""",
    "bindings": """
        SELECT p_type AS pattern_id, l_returnflag AS role, p_brand AS binding_key, 's' || CAST(l_suppkey AS STRING) AS file,
               CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 'fn' || CAST(l_suppkey % 7 AS STRING) END AS containing_function FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "parameters": """
        SELECT l_orderkey, o_orderstatus <> 'P' AS exported, l_linestatus, CASE l_returnflag WHEN 'A' THEN 'boolean' WHEN 'N' THEN 'number' ELSE 'string' END AS type,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS position FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "sources": "SELECT p_brand AS file, 'part' || CAST(p_partkey AS STRING) AS name, p_size % 2 = 0 AS is_heterogeneous FROM {part}",
    "accesses": """
        SELECT CASE WHEN l_linenumber % 2 = 0 THEN p_brand ELSE 'elsewhere' END AS file, CASE WHEN l_linenumber % 2 = 0 THEN 'part' || CAST(l_partkey AS STRING) ELSE 'copy' END AS name,
               CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE p_brand END AS origin_file, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 'part' || CAST(l_partkey AS STRING) END AS origin_name,
               CAST(l_linenumber AS STRING) AS accessed_index, CAST(l_orderkey % 400 AS INT) AS line FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "keyed_events": "SELECT event_id, user_id, event_type, CAST(ts AS TIMESTAMP) AS ts, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}",
    "ledger": """
        SELECT event_id AS ord, SHA[CAST(user_id AS STRING) || ':' || CAST(k AS STRING)] AS fingerprint, ts AS timestamp,
               CASE event_type WHEN 'click' THEN 'observed' WHEN 'view' THEN 'unverified' WHEN 'purchase' THEN 'baselined' WHEN 'error' THEN 'revoked' ELSE 'resolved' END AS type,
               CASE WHEN event_type = 'purchase' THEN ts + DAYS[k % 40] END AS expires_at, 'rule' || CAST(k % 4 AS STRING) || '@v1' AS rule_id FROM {keyed_events}""",
    "current": """
        SELECT fingerprint, max(review) = 1 AS requires_verification FROM (
          SELECT SHA[CAST(user_id AS STRING) || ':' || CAST(k AS STRING)] AS fingerprint, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS review FROM {keyed_events} WHERE event_type IN ('click', 'purchase')
          UNION ALL SELECT SHA['new:' || CAST(o_orderkey AS STRING)], 0 FROM {orders}) x GROUP BY fingerprint""",
    "axioms": """
        SELECT 'axiom' || CAST(o_custkey AS STRING) AS axiom_id, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'declared' WHEN 'O' THEN 'superseded' ELSE 'revoked' END AS type,
               CASE WHEN o_orderstatus = 'F' THEN 'scope ' || o_orderpriority END AS scope, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS claim FROM {orders}""",
    "packages": "SELECT DISTINCT '@acme/' || lower(p_type) AS name, 'packages/' || lower(p_type) AS root_path FROM {part}",
    "ranges": "SELECT 'f' || CAST(o_custkey % (5 * n) AS STRING) AS file, o_orderkey AS fun_idx, CAST(o_orderkey % 400 AS INT) + 2 AS sl, 1 AS sc, CAST(o_orderkey % 400 + o_orderkey % 37 AS INT) + 2 AS el, 80 AS ec FROM {orders} JOIN (SELECT count(*) AS n FROM {supplier}) c ON 1 = 1",
    "sites": """
        SELECT 'f' || CAST(l_partkey % (5 * n) AS STRING) AS file, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS call_idx, max(CAST((l_orderkey * l_linenumber) % 440 AS INT)) AS cl, 5 AS cc
        FROM {lineitem} JOIN (SELECT count(*) AS n FROM {supplier}) c ON 1 = 1 GROUP BY l_partkey, n, l_orderkey, l_linenumber""",
    "targets": "SELECT DISTINCT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS call_idx, l_partkey AS callee_idx FROM {lineitem}",
    "items": "SELECT doc_id AS original_index, CAST(ceil(n_chars / 4.0) AS BIGINT) AS tokens, SHA[CAST(doc_id AS STRING)] AS cache_key FROM {documents}",
}


def _spell(sql: str, duck: bool) -> str:
    def nested(name: str, left: str, right: str, text: str) -> str:
        while (m := re.search(rf"{name}\[([^\[\]]*)\]", text)) is not None:
            text = text[: m.start()] + left + m[1] + right + text[m.end() :]
        return text

    sql = nested("SHA", "sha256(" if duck else "sha2(", ")" if duck else ", 256)", sql)
    return nested("DAYS", "to_days(CAST(" if duck else "make_dt_interval(CAST(", " AS INT))", sql)


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived fact table, or one of the driver's own."""
    if name not in FACTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _spell(FACTS[name], duck=False)
    return spark.sql(sql, **{n: fact(spark, sf_dir, n) for n in _names(sql)})


def duck(sql: str) -> str:
    """DuckDB SQL of a query over fact tables: the facts that it names, as common table expressions in front."""
    done: dict[str, str] = {}

    def need(text: str) -> None:
        for n in _names(text):
            if n in FACTS and n not in done:
                need(FACTS[n])
                done[n] = _spell(FACTS[n], duck=True)

    need(sql)
    head = "".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', body)}), " for n, body in done.items())
    body = re.sub(r"[{](\w+)[}]", r"\1", _spell(sql, duck=True)).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}{body[len('WITH RECURSIVE') :]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head}{body[len('WITH') :]}"
    return f"WITH {head.rstrip(', ')} {body}" if head else body
