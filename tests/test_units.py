"""Semantics that the driver's tables don't reach."""

import re
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codegov.functions import budget, globs, identity, paths
from codegov.operators import boundary, extraction, graph, grouping, ledger, scoring
from codegov.plans import runner
from codegov.sources import gitlog, ledger_files
from codegov.sources.schemas import LEDGER

AS_OF = datetime(2024, 1, 31)


@pytest.mark.parametrize(
    ("pattern", "path", "expected"),
    [("a/**", "a", True), ("a/**", "a/b/c", True), ("**/x", "x", True), ("**/x", "a/b/x", True), ("a/*", "a/b/c", False), ("*", ".hidden", False), ("a/**", "a/.git/x", False), ("a.{ts,js}", "a.js", True), ("a.{ts,js}", "a.py", False), ("[ab]c", "bc", True), ("[!ab]c", "bc", False), ("a?c", "abc", True), ("@x/y.z", "@x/y.z", True), ("@x/y.z", "@x/yaz", False), ("ab/**", "abc", False)],
)
def test_globs(pattern, path, expected):
    assert (bool(re.match(globs.glob_to_regex(pattern), path)) if globs.is_glob(pattern) else pattern == path) is expected


def test_extended_globs_are_rejected():
    with pytest.raises(ValueError):
        globs.glob_to_regex("@(a|b)")


def test_paths(spark):
    row = spark.range(1).select(paths.resolve(F.lit("a/b/c.ts"), F.lit("../x/./y")).alias("r"), paths.ancestors(F.lit("c.ts")).alias("none"), paths.module_key(F.lit("a/b/index.ts")).alias("k")).first()
    assert (row.r, row.none, row.k) == ("a/x/y", [], "a/b")


def test_fold_is_idempotent_and_unites_artifacts(spark):
    rows = spark.createDataFrame([("f", "m1", 2, [("k", "b")]), ("f", "m0", 1, [("k", "a")]), ("g", "m", 1, [("k", "z")])], "fingerprint string, message string, ord int, artifacts array<struct<kind:string,data:string>>")
    once = {r.fingerprint: (r.message, [a.data for a in r.artifacts]) for r in identity.fold_findings(rows).collect()}
    assert once == {"f": ("m0", ["a", "b"]), "g": ("m", ["z"])}


def test_layers_are_validated():
    for bad in ({"target": ""}, {"target": "./x"}, {"target": "x", "allows": ("a",), "forbids": ("b",)}):
        with pytest.raises(ValueError):
            boundary.Layer(**bad)


def test_reach_walks_cycles_and_every_branch(spark):
    edges = [("app/a.ts", "lib/ok.ts", False), ("lib/ok.ts", "lib/one.ts", False), ("lib/ok.ts", "lib/two.ts", False), ("lib/one.ts", "lib/ok.ts", False), ("lib/one.ts", "react", True), ("lib/two.ts", "lodash", True)]
    rows = spark.createDataFrame([(a, None, None, a, 1, 1, b, e) for a, b, e in edges], "from_path string, from_pkg_name string, from_pkg_root string, file string, line int, column int, to_path string, is_external boolean")
    found = boundary.reach(rows, [boundary.Layer("app/**", allows=("lib/**", "lodash"))]).collect()
    assert {(r.current_path, r.dependency) for r in found} == {("lib/one.ts", "react")}
    denied = boundary.reach(rows, [boundary.Layer("app/**", forbids=("react", "lib/two.ts"))]).collect()
    assert {(r.current_path, r.dependency) for r in denied} == {("lib/one.ts", "react"), ("lib/ok.ts", "lib/two.ts")}


def test_git_log(spark, tmp_path):
    text = "\n".join(["M\torphan", "COMMIT\x01h1\x01A\x01a@x\x012024-01-01T10:00:00+02:00\x01s\x01t", "M\ta.ts", "R90\told.ts\tnew.ts", "Q\tx", "no tab", "R90\tonly", "COMMIT\x01h2\x01\x01a@x\x012024-01-02T00:00:00Z\x01s", "M\tb.ts", "COMMIT\x01h3\x01A\x01a@x\x012024-01-03T00:00:00Z\x01", "D\tc.ts"])
    (tmp_path / "log.txt").write_text(text)
    parsed = gitlog.parse_records(gitlog.read_records(spark, str(tmp_path / "log.txt")))
    assert {(r.hash, r.subject) for r in gitlog.commits(parsed).collect()} == {("h1", "s\x01t"), ("h3", "")}
    assert {(r.hash, r.status, r.path, r.old_path) for r in gitlog.file_changes(parsed).collect()} == {("h1", "modified", "a.ts", None), ("h1", "renamed", "new.ts", "old.ts"), ("h3", "deleted", "c.ts", None)}


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "ledger.ndjson")
    assert ledger_files.read_ledger(spark, path).count() == 0
    rows = spark.createDataFrame([{"fingerprint": f"f{k}", "type": "observed", "rule_id": "r"} for k in range(5)], LEDGER)
    ledger_files.append_ledger(ledger_files.stamp(rows, "run1", 1, ["fingerprint"]), path)
    back = ledger_files.read_ledger(spark, path).orderBy("entry_id").collect()
    assert [r.fingerprint for r in back] == [f"f{k}" for k in range(5)] and {r.run_id for r in back} == {"run1"}


def test_second_reconcile_writes_nothing(spark):
    now = spark.createDataFrame([("a", False), ("b", True)], "fingerprint string, requires_verification boolean")
    empty = spark.createDataFrame([], "fingerprint string, type string, expires_at timestamp")
    events = ledger.events_to_write(ledger.reconcile(now, empty, AS_OF)).select("fingerprint", "type", F.lit(None).cast("timestamp").alias("expires_at"))
    assert {(r.fingerprint, r.type) for r in events.collect()} == {("a", "observed"), ("b", "unverified")}
    assert ledger.events_to_write(ledger.reconcile(now, events, AS_OF)).count() == 0


def test_outcome_table(spark):
    past, later = datetime(2024, 1, 31), datetime(2024, 2, 1)
    cases = [(t, e, p) for t, e in (("observed", None), ("unverified", None), ("baselined", later), ("baselined", past), ("resolved", None), ("revoked", None)) for p in (True, False)]
    last = spark.createDataFrame([(str(k), t, e) for k, (t, e, _) in enumerate(cases)], "fingerprint string, type string, expires_at timestamp")
    now = spark.createDataFrame([(str(k), False) for k, c in enumerate(cases) if c[2]], "fingerprint string, requires_verification boolean")
    got = {int(r.fingerprint): (r.event, r.visible) for r in ledger.reconcile(now, last, AS_OF).collect()}
    assert [got[k] for k in range(12)] == [(None, True), ("resolved", False), (None, True), ("resolved", False), (None, False), ("resolved", False), ("observed", True), ("resolved", False), ("observed", True), (None, False), (None, False), (None, False)]


def test_state_filter_rejects_unknown_names(spark):
    with pytest.raises(ValueError):
        ledger.with_state(spark.createDataFrame([("a", "observed")], "fingerprint string, type string"), "seen")


@pytest.mark.parametrize(("tokens", "expected"), [([5, 5, 1], [0, 0, 1]), ([20, 1], [0, 1]), ([10], [0]), ([6, 6, 4], [0, 1, 1]), ([1, 1, 1, 1], [0, 0, 0, 1])])
def test_batches(spark, tokens, expected):
    rows = spark.createDataFrame(list(enumerate(tokens)), "original_index long, tokens long")
    got = scoring.batches(rows, 10, 3).orderBy("original_index").collect()
    assert [r.batch_no for r in got] == expected


def test_batches_run_across_chunks(spark):
    import random

    draw = random.Random(5)
    for budget_, most, size, high in ((30, 4, 7, 12), (30, 9, 3, 5), (10, 3, 1, 14), (1000, 50, 11, 3)):
        tokens = [draw.randint(0, high) for _ in range(150)]
        want, number, used, count = [], 0, 0, 0
        for t in tokens:
            if count and used + t > budget_ or count >= most:
                number, used, count = number + 1, 0, 0
            used, count = used + t, count + 1
            want.append(number)
        rows = spark.createDataFrame([(3 * k, t, f"x{k}") for k, t in enumerate(tokens)], "original_index long, tokens long, cache_key string")
        packed = scoring.batches(rows, budget_, most, chunk_items=size)
        got = packed.orderBy("original_index").collect()
        assert [r.batch_no for r in got] == want and [r.cache_key for r in got] == [f"x{k}" for k in range(150)]


def test_scorers_are_held_to_their_contract(spark):
    rows = spark.createDataFrame([("k", 0, "t", 0, 0)], "cache_key string, original_index long, serialized string, pack_group int, batch_no int")
    for bad in (lambda k, t: [], lambda k, t: [("other", 1.0)]):
        with pytest.raises(Exception, match="scorer returned"):
            scoring.score_batches(rows, bad).collect()


def test_budgets():
    assert budget.input_budget(1000, "x" * 41) == 889 and budget.items_per_batch(100, 30) == 2 and budget.items_per_batch(10, 30) == 1
    assert budget.output_estimate({"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": "number"}}}}) == 6 * 2 + 2 + 50 + 12
    with pytest.raises(ValueError):
        budget.input_budget(10, "x" * 100)


def test_extraction():
    text = "import a from './a'\nimport type T from './t'\n// require('no')\nconst b = require('b'), n = 0x1F\nif (typeof b === 'string') x = `t ${y}` + \"lit\"\nimport('./dyn')"
    assert [s for s, _, _ in extraction.imports_of(text)] == ["b", "./dyn", "./a"]
    assert [(k, v) for k, v, _, _ in extraction.literals_of(text)] == [("string", "b"), ("number", "0x1F"), ("string", "lit"), ("string", "./dyn")]
    assert extraction.template_segments(" ${a}:${b} ") == [":"]


def test_bindings_follow_the_reference_presets(spark):
    text = "function f(a, b, y) { x = `${a}:${b}`; w = `id-${g(`${a}|${y.join(';')}`)} - ${b}\\n`; q = `fixed`\nd = new Date('2020-01-01') + new Date(x) + new Date().toISOString() + a.join('-' + b) + split(' ')\ne = Buffer.from(a, 'base64'), h = c().toString('hex'), k = 'a,b'.split(',') }"
    sources = spark.createDataFrame([(1, text)], "id int, content string")
    got = sorted((r.pattern_id, r.role, r.function_name, r.binding_key) for r in extraction.bindings(extraction.calls(sources)).collect())
    template = [("pack-unpack", "packer", "template-literal", k) for k in (":", "id-", " - ", "|")]
    assert got == sorted([
        *template, ("pack-unpack", "packer", "y.join", ";"), ("pack-unpack", "unpacker", "'a,b'.split", ","), ("date-format", "parser", "Date", "2020-01-01"), ("date-format", "formatter", "new Date().toISOString", ""),
        ("buffer-encoding", "encoder", "Buffer.from", "base64"), ("buffer-encoding", "decoder", "c().toString", "hex"),
    ])
    back = spark.createDataFrame([(2, "function g(s) { return s.split(':') }")], "id int, content string")
    both = extraction.bindings(extraction.calls(sources.union(back))).withColumn("file", F.col("id").cast("string"))
    assert [r.binding_key for r in grouping.shared_algorithms(both).collect()] == [":"]


def test_whole_pages_are_extracted(spark):
    html = """<a class="x>y" href='/one'>1</a><abbr href="/no"></abbr><script type="module" data-x='a>b'>f("p");\ng(a.join("|"))</script><A HREF="/two\nb">2</A> <SCRIPT>h(`${x}:${y}`, 7)</SCRIPT ><a data-href="/no" href=/three>3</a><scripty>"no"</scripty><a name="n">4</a>"""
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id int, html string")
    scripts, links = extraction.page_scripts(pages), extraction.page_links(pages)
    assert sorted((r.kind, r.value) for r in extraction.literals(scripts).collect()) == [("number", "7"), ("string", "p"), ("string", "|")]
    assert [(r.specifier, r.line) for r in extraction.imports(links).collect()] == [("/one", 1), ("/twob", 2), ("/three", 3)]
    assert sorted((r.function_name, r.binding_key) for r in extraction.bindings(extraction.calls(scripts)).collect()) == [("a.join", "|"), ("template-literal", ":")]


def test_e02_reads_every_script(spark, tmp_path):
    from codegov.plans.registry import QUERIES

    html = """<script>var t="</p>";track(1);</script><script defer>u("second")</script>"""
    spark.createDataFrame([(1, html), (2, "<script>v('other', 5)</script>")], "page_id int, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r.page_id, r.value) for r in QUERIES["e02_literals"](spark, str(tmp_path)).collect()) == [(1, "1"), (1, "</p>"), (1, "second"), (2, "5"), (2, "other")]


def test_literals_count_files_once_and_keep_kinds_apart(spark):
    rows = spark.createDataFrame([("a", "string", "1", 1, 1), ("a", "string", "1", 2, 1), ("b", "number", "1", 1, 1)], "file string, kind string, value string, line int, column int")
    assert grouping.shared_literals(rows, 2).count() == 0 and grouping.shared_literals(rows, 1).count() == 2
    assert grouping.literal_findings(rows.limit(0)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_rows_and_counts_need_no_arrays(spark):
    rows = spark.createDataFrame([(f, "string", "v", k, 1) for f in ("b", "a") for k in (2, 1)], "file string, kind string, value string, line int, column int")
    found = grouping.literal_findings(rows).withColumn("ord", F.col("value"))
    one, evidence = identity.count_findings(found), identity.evidence(found)
    assert [(r.value, r.n) for r in one.collect()] == [("v", 4)] and [(r.files, r.n) for r in grouping.literal_counts(rows).collect()] == [(2, 4)]
    assert [r.data for r in evidence.collect()] == [f'{{"column":1,"file":"{f}","line":{k}}}' for f in ("a", "b") for k in (1, 2)]
    states = spark.createDataFrame([("s", "b"), ("s", "a"), ("r", "c")], "state string, fingerprint string")
    lines = ledger_files.export_lines(states, ["fingerprint"])
    assert [(r.state, r.item) for r in lines.collect()] == [("r", '{"fingerprint":"c"}'), ("s", '{"fingerprint":"a"}'), ("s", '{"fingerprint":"b"}')]
    assert not any("collect_list" in plan_of(x) for x in (one, evidence, lines, grouping.literal_counts(rows)))


@pytest.mark.parametrize("name", ["a02_shared_literals", "x06_runner", "p05_pure_layer", "p06_allow_list", "p07_deny_list", "r08_state_lines"])
def test_counts_are_made_without_collecting(spark, sf_dir, name):
    from codegov.plans.registry import QUERIES

    assert "collect_list" not in plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["t01_stream_fold", "t02_stream_churn"])
def test_streams_keep_result_and_state_in_the_shared_folder(spark, sf_dir, name):
    from pathlib import Path

    from codegov.plans.registry import QUERIES

    files = QUERIES[name](spark, sf_dir).inputFiles()
    assert files and all(f.startswith("file:") and spark.conf.get("spark.checkpoint.dir") in f for f in files)
    assert (Path(files[0].split("file://")[-1]).parents[1] / "state" / "offsets").is_dir()


def test_ledger_state_is_a_row_a_bucket_and_reports_as_a_plain_fold(spark, tmp_path):
    import random
    from datetime import UTC, datetime, timedelta

    from codegov.streaming import jobs

    rng, day = random.Random(5), lambda d: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(days=d)
    parts = [[(f"f{rng.randrange(40)}", 1000 * k + n if n % 9 else n, rng.choice(["observed", "baselined", "baselined", "revoked"]), 20 * k + rng.random() * 20, rng.random() * 60) for n in range(120)] for k in range(4)]
    want, held, open_, mark = [], {}, {}, -1000.0
    for part in parts:  # (fingerprint, ord, type, day, end)
        best = {}
        for f, o, t, _, u in part:
            best[f] = max(best.get(f, (-1,)), (o, t, u), key=lambda x: x[0])
        for f, (o, t, u) in best.items():
            if o > held.get(f, -1):
                held[f] = o
                open_.pop(f, None)
                want.append((f, "latest", o, t))
                if t == "baselined" and u <= mark:
                    want.append((f, "expired", o, t))
                elif t == "baselined":
                    open_[f] = (u, o)
        mark = max(mark, max(x[3] for x in part) - 30)
        for f in [f for f, (u, _) in open_.items() if u <= mark]:
            want.append((f, "expired", open_.pop(f)[1], "baselined"))
    got, name = [], "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            rows = [(f, o, t, day(u) if t == "baselined" else None, day(d)) for f, o, t, d, u in part]
            spark.createDataFrame(rows, "fingerprint string, ord long, type string, expires_at timestamp, timestamp timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
            put = lambda batch, _: got.extend(map(tuple, batch.collect()))
            jobs.state_stream(stream, "30 days", buckets=2).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    assert sorted(got) == sorted(want) and sum(x[1] == "expired" for x in want) > 20
    assert spark.read.format("statestore").option("stateVarName", "latest").load(f"{tmp_path}/state").count() == 2


def test_runner_checks_and_skips(spark):
    rule = runner.Rule("r", ("missing",), lambda f: None)
    one = runner.Collector("c", ("x",), lambda k: {})
    assert runner.run([one], [rule]).skipped == ["r"] and runner.run([], [rule]).findings is None
    with pytest.raises(ValueError):
        runner.run([one, one], [rule])


def test_call_edges_need_both_ends(spark):
    functions = spark.createDataFrame([("a", 1, 1, 1, 99, 1), ("a", 2, 5, 3, 20, 1), ("a", 3, 8, 3, 12, 1), ("b", 4, 7, 1, 9, 1), ("b", 5, None, None, None, None)], "file string, fun_idx long, sl int, sc int, el int, ec int")
    calls = spark.createDataFrame([("a", 10, 9, 5), ("a", 11, 15, 2), ("a", 12, 50, 1), ("b", 13, None, None)], "file string, call_idx long, cl int, cc int")
    targets = spark.createDataFrame([(10, 4), (10, 2), (11, 1), (11, 5), (11, 99), (12, 4), (13, 4)], "call_idx long, callee_idx long")
    found = {(r.caller_id, r.callee_id, r.line, r.column) for r in graph.call_edges(functions, calls, targets).collect()}
    assert found == {("a:8:2", "b:7:0", 9, 4), ("a:8:2", "a:5:2", 9, 4)}  # the module's range, unknown starts and unknown targets go


def test_a_call_number_of_two_files_is_one_call(spark):
    functions = spark.createDataFrame([("a", 1, 5, 1, 20, 1), ("b", 2, 5, 1, 9, 1), ("c", 3, 90, 1, 95, 1)], "file string, fun_idx long, sl int, sc int, el int, ec int")
    calls = spark.createDataFrame([("a", 10, 6, 1), ("b", 10, 7, 3), ("c", 10, 50, 1), ("a", 11, 8, 1), ("c", 11, 8, 2)], "file string, call_idx long, cl int, cc int")
    assert sorted(map(tuple, graph.enclosing_function(functions, calls).select("call_idx", "fun_idx").collect())) == [(10, 2), (11, 1)]
    targets = spark.createDataFrame([(10, 1), (10, 3), (11, 3)], "call_idx long, callee_idx long")
    found = sorted(map(tuple, graph.call_edges(functions, calls, targets).select("file", "caller_id", "callee_id", "line", "column").collect()))
    assert found == [("a", "a:5:0", "c:90:0", 8, 0), ("b", "b:5:0", "a:5:0", 7, 2), ("b", "b:5:0", "c:90:0", 7, 2)]


def test_facts_merge_tables_and_let_the_last_value_win(spark):
    table = lambda v: spark.createDataFrame([(v,)], "v int")
    parts = [runner.Collector("a", ("t", "x", "y"), lambda k: {"t": table(1), "x": 1, "y": 1}), runner.Collector("b", ("t", "x", "y"), lambda k: {"t": table(2), "x": 2, "y": table(3)})]
    facts = runner.gather(parts, {"t", "x", "y"})
    assert sorted(r.v for r in facts["t"].collect()) == [1, 2] and facts["x"] == 2 and facts["y"].first().v == 3
    values = grouping.merge_values(*(spark.createDataFrame(rows, "key string, value int") for rows in ([("k", 9), ("only", 5)], [("k", 1)])))
    assert {tuple(r) for r in values.collect()} == {("k", 1), ("only", 5)}


def test_display_of_artifacts(spark):
    rows = [("churn", '{"path":"a","count":3}'), ("access", '{"file":"f","line":2,"index":"0"}'), ("binding", '{"file":"f","line":1,"column":4,"role":"pack","patternId":"p","bindingKey":":","functionName":"join"}'), ("other", '{"z":1}')]
    shown = {r.kind: r.m for r in spark.createDataFrame(rows, "kind string, data string").select("kind", identity.display(F.col("kind"), F.col("data")).alias("m")).collect()}
    assert shown["churn"] == {"file": "a", "changes": "3"} and shown["access"] == {"role": "[Access]", "location": "f:2", "index": "0"} and shown["other"] == {"value": '{"z":1}'}
    assert shown["binding"] == {"location": "f:1:4", "role": "pack", "pattern": "p", "invariant": ":", "function": "join", "container": "(module-level)"}


def test_ledger_paths_and_runner_parts_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        ledger_files.read_ledger(spark, str(tmp_path / "ledger.json"))
    with pytest.raises(ValueError):
        runner.insights(spark.range(0), [runner.Insight("", (), lambda f: f)])
    collector = runner.Collector("c", ("x",), lambda k: {"x": spark.range(1)})
    rule = runner.Rule("r", ("x",), lambda f: spark.createDataFrame([], "rule_id string, instance_id string, fingerprint string, message string, artifacts array<struct<kind:string,data:string>>, ord int"), lambda f: f["x"].selectExpr("'w' as warning"))
    with pytest.raises(ValueError):
        runner.run([collector], [rule], [runner.Enricher("e", ("x",), (), lambda f: {})])
    assert [tuple(r) for r in runner.run([collector], [rule]).warnings.collect()] == [("r", "w")]


def test_merged_results_keep_order_and_drop_stale(spark):
    items = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a")], "original_index long, cache_key string")
    cache, fresh = spark.createDataFrame([("a", 0.5), ("old", 0.1)], "cache_key string, confidence double"), spark.createDataFrame([(1, 0.9)], "original_index long, confidence double")
    merged = scoring.merge_results(items, cache, fresh)
    assert [(r.original_index, r.confidence, r.cached) for r in merged.collect()] == [(1, 0.9, False), (2, 0.5, True), (3, 0.5, True)]
    assert {tuple(r) for r in scoring.next_cache(merged).collect()} == {("a", 0.5), ("b", 0.9)}


def test_dependencies_have_paths_and_packages(spark):
    found = spark.createDataFrame([("p/a/x/f.ts", "../y", 1, 1), ("p/a/x/f.ts", "lib", 2, 1), ("q/g.ts", "./h", 1, 1)], "file string, specifier string, line int, column int")
    packages = spark.createDataFrame([("@p", "p"), ("@p/a", "p/a")], "name string, root_path string")
    rows = {(r.from_path, r.from_pkg_name, r.to_path, r.is_external, r.to_pkg_name) for r in extraction.depends_on(found, packages).collect()}
    assert rows == {("p/a/x/f.ts", "@p/a", "p/a/y", False, None), ("p/a/x/f.ts", "@p/a", "lib", True, "lib"), ("q/g.ts", None, "q/h", False, None)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert pd.Series(list(e.queries())).is_unique and set(e.oracle_sql()) <= set(e.queries())


# ---- reach over graphs


EDGES = "from_path string, from_pkg_name string, from_pkg_root string, file string, line int, column int, to_path string, is_external boolean"


def edges_of(spark, rows):
    return spark.createDataFrame([(a, None, None, a, k + 1, 1, b, not b.endswith((".ts", "/dir")) and "/" not in b) for k, (a, b) in enumerate(rows)], EDGES)


def test_reach_by_components_equals_a_plain_walk(spark):
    import random

    rng = random.Random(3)
    files = [f"m{k % 6}/{'sub/' if k % 3 else ''}f{k}.ts" for k in range(40)] + ["m1/index.ts", "m2/sub/index.ts"]
    rows = {(rng.choice(files), rng.choice([*files, "m1", "m2/sub", "m3/sub", "lodash", "react", "pg"])) for _ in range(110)}
    rows |= {(f"m4/c{k}.ts", f"m4/c{(k + 1) % 5}.ts") for k in range(5)} | {("m0/f0.ts", "m4/c0.ts"), ("m4/c3.ts", "pg"), ("m0/f0.ts", "m5"), ("m4/c2.ts", "m4/c4.ts")}
    rows = sorted((a, b) for a, b in rows if a != b)
    layers = [("m0/**", ("m1", "m2", "m4", "lodash"), ()), ("m1/**", (), ("react", "m3", "m4/c2.ts")), ("m2/**", (), ("pg", "m5"))]
    table = spark.createDataFrame([(a, None, None, a, k + 1, 1, b, "/" not in b and b not in ("m1", "m5")) for k, (a, b) in enumerate(rows)], EDGES)
    want = set().union(*(plain_reach(rows, layer, {"m1", "m5"}) for layer in layers))
    asked = [boundary.Layer(t, allows=a, forbids=f, transitive=True) for t, a, f in layers]
    for condense in (True, False):
        got = {(r.target, r.current_path, r.dependency) for r in boundary.reach(table, asked, condense=condense).collect()}
        assert got == want, condense
    assert len(want) > 20


def plain_reach(rows, layer, folders):
    """What ``boundary.reach`` gives for a layer ``name/**``, one path after another; ``folders``: names without a slash that are no packages."""
    target, allows, forbids = layer
    root, found, seen = target.removesuffix("**"), set(), set()
    key = lambda p: re.sub(r"/index$", "", re.sub(r"\.ts$", "", p))
    outside = lambda p: "/" not in p and p not in folders
    listed = lambda p, names: any(p == n or p.startswith(n + "/") for n in names)
    bad = lambda p: listed(p, forbids) if forbids else outside(p) and not listed(p, allows)
    ok = lambda p: not listed(p, forbids) if forbids else listed(p, allows)
    todo = [b for a, b in rows if a.startswith(root) and not outside(b) and not (b + "/").startswith(root) and ok(b)]
    while todo:
        p = todo.pop()
        if p in seen:
            continue
        seen.add(p)
        for a, b in rows:
            if key(a) == key(p) or a.startswith(key(p) + "/"):
                if bad(b):
                    found.add((target, p, b))
                elif not outside(b):
                    todo.append(b)
    return found


def test_a_walk_keeps_edges_compressed(spark):
    import random
    from pathlib import Path

    from codegov.sources.shared import shared_folder

    rng, folder = random.Random(4), Path(shared_folder(spark).removeprefix("file:"))
    files = [f"packages/m{k % 7}/src/deeper/folder/f{k}.ts" for k in range(300)]
    rows = [(rng.choice(files), rng.choice([*files, "lodash", "react"])) for _ in range(20_000)]
    rows = [(a, b) for a, b in rows if not a.startswith("packages/m2/") or b.startswith("packages/m3/")] + [("packages/m3/src/deeper/folder/f3.ts", "pg")]
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    layer = boundary.Layer("packages/m2/**", allows=("packages/m3/**",), transitive=True)
    got = {(r.target, r.current_path, r.dependency) for r in boundary.reach(edges_of(spark, rows), [layer]).collect()}
    assert got == plain_reach(sorted(set(rows)), (layer.target, ("packages/m3",), ()), set()) and len(got) > 100
    assert size() - before < 30 * len(rows)


def test_a_site_is_shuffled_once(spark):
    rows = [("src/p/a.ts", "src/c/u.ts"), ("src/c/u.ts", "pg"), ("src/c/u.ts", "pg"), ("src/c/u.ts", "fs"), ("src/c/u.ts", "pg")]
    found = boundary.reach(edges_of(spark, rows), [boundary.Layer("src/p/**", allows=("src/c/**",), transitive=True)])
    assert {(r.dependency, r.site.file, r.site.line) for r in found.collect()} == {("pg", "src/c/u.ts", 2), ("fs", "src/c/u.ts", 4)}
    assert "min_by(" not in found._jdf.queryExecution().executedPlan().toString()  # its order is that of its own fields


def test_components(spark):
    from codegov.operators.reach import strong_components

    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "y"), ("y", "z"), ("g", "g"), ("p", "q"), ("q", "p"), ("q", "a"), ("f", "x")]
    rows = strong_components(spark.createDataFrame(pairs, "a string, b string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.component, set()).add(r.a)
    assert sorted(map(sorted, by.values())) == [["a", "b", "c"], ["d", "e"], ["p", "q"]]
    assert strong_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_a_hub_is_dealt_to_several_join_keys(spark):
    from codegov.operators.reach import spread, walk

    edges = spark.range(1000).select(F.lit("hub").alias("a"), F.concat(F.lit("n"), "id").alias("b"), F.lit(None).cast("array<string>").alias("closed"))
    dealt, parts = spread(edges, fan=50)
    assert dealt.groupBy("a", "part").count().agg({"count": "max"}).first()[0] <= 100 and parts.first().parts == 20
    seeds = spark.createDataFrame([("w", "hub")], "who string, a string")
    assert walk(seeds, edges, fan=50).count() == 1001


def test_no_folder_that_nothing_names_becomes_a_key(spark):
    table = edges_of(spark, [("deep/er/a.ts", "deep/er/b.ts"), ("deep/x.ts", "other/dir")] + [("other/dir/f.ts", "pg")])
    key = boundary.module_key
    keys = {r.a for r in boundary._members(table.withColumns({"a": key(F.col("from_path")), "b": key(F.col("to_path"))})).collect()}
    assert keys == {"other/dir"}


def test_reach_findings_are_the_layers_own(spark):
    table = edges_of(spark, [("src/payments/checkout.ts", "src/core/utils.ts"), ("src/core/utils.ts", "pg"), ("src/payments/checkout.ts", "fs")])
    layer = boundary.Layer("src/payments/**", allows=("src/core/**",), transitive=True)
    rows = {(r.rule_id, r.dependency): (r.message, r.artifacts[0].data) for r in boundary.layer_findings(table, layer).collect()}
    assert set(rows) == {(boundary.IMPORTS, "pg"), (boundary.IMPORTS, "fs")}
    message, data = rows[boundary.IMPORTS, "pg"]
    assert "[Transitive]" in message and "via src/core/utils.ts" in message and "not declared in allowed" in message and '"file":"src/core/utils.ts","line":2' in data
    with pytest.raises(ValueError):
        boundary.Layer("a", transitive=True)
    twice = edges_of(spark, [("src/payments/a.ts", "src/core/u.ts"), ("src/payments/b.ts", "src/core/u.ts"), ("src/core/u.ts", "pg"), ("src/core/u.ts", "pg")])
    assert boundary.reach(twice, [layer]).count() == 1


# ---- tables of patterns


def test_pattern_tables_equal_single_patterns(spark):
    from codegov.functions import pattern_tables

    names = ["a/**", "**/x.ts", "a/*/c.ts", "*", "**", "!a/**", "a/b/c.ts", "**/*.test.ts", "{a,b}/**", "a/{b/c,d}.ts", "[ab]/b/*", "**/.hidden/**", "lib/*/deep/**", "?/b/c.ts", "a", "x.ts", "@s/p*", "**/b/**", "*.ts", "a/b.c/**/d.e"]
    places = ["a", "a/b/c.ts", "a/x.ts", "x.ts", "b/b/c.ts", "a/d.ts", "q/w.test.ts", "r.test.ts", "a/.hidden/f", "lib/k/deep/z.ts", "@s/pq", "b", "a/b.c/q/d.e", "a/b.c/d.e", "lib/deep", ".x/y.ts", "dir/x.ts"]
    paths_ = spark.createDataFrame([(p,) for p in places], "path string")
    got = {(r.path, r.pattern) for r in pattern_tables.glob_join(paths_, spark.createDataFrame([(n,) for n in names], "pattern string")).collect()}
    want = set()
    for n in names:
        want |= {(r.path, n) for r in paths_.where(globs.matches(F.col("path"), n)).collect()}
    assert got == want
    targets = paths_.withColumnRenamed("path", "to_path")
    plain = ["a", "b", "@s", "lib/k", "a/**", "nope"]
    got = {(r.to_path, r.pattern) for r in pattern_tables.import_join(targets, spark.createDataFrame([(n,) for n in plain], "pattern string")).collect()}
    assert got == {(r.to_path, n) for n in plain for r in targets.where(globs.matches_import(F.col("to_path"), n)).collect()}


def test_a_hundred_thousand_patterns(spark):
    from codegov.functions import pattern_tables

    patterns = spark.range(100_000).select(F.concat(F.lit("packages/p"), (F.col("id") % 1000).cast("string"), F.lit("/src/m"), F.col("id").cast("string"), F.lit("/**")).alias("pattern"))
    paths_ = spark.range(2000).select(F.concat(F.lit("packages/p"), (F.col("id") % 1000).cast("string"), F.lit("/src/m"), F.col("id").cast("string"), F.lit("/x.ts")).alias("path"))
    found = pattern_tables.glob_join(paths_, patterns)
    assert found.count() == 2000


def test_pieces_of_paths_are_never_broadcast(spark, tmp_path, monkeypatch):
    from codegov.functions import pattern_tables

    monkeypatch.setattr(pattern_tables, "FEW", 100, raising=False)
    spark.range(200).select(F.concat(F.lit("a/b"), "id", F.lit("/x.ts")).alias("path")).write.parquet(str(tmp_path / "p"))
    paths_ = spark.read.parquet(str(tmp_path / "p"))
    many = paths_.select(F.regexp_replace("path", "x.ts", "**").alias("pattern"))
    few = many.limit(20)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for join in (lambda p: pattern_tables.glob_join(paths_, p), lambda p: pattern_tables.import_join(paths_, p, "path")):
        assert "Broadcast" not in plan(join(many)) and join(many).count() == 200
        assert "BuildLeft" not in plan(join(few)) and "SortMergeJoin" not in plan(join(few)) and join(few).count() == 20


@pytest.mark.parametrize("name", ["a08_erosion", "a08_erosion_of_globs", "p01_pattern_table", "p08_idle_table"])
def test_patterns_need_no_nested_loop(spark, sf_dir, name):
    from codegov.plans.registry import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_only_imports_count_as_violations(spark):
    from codegov.operators import erosion

    rows = spark.createDataFrame([(r, f"{r}:b", str(k), None, None) for k, r in enumerate(("coupling/pure-imports@v1", "coupling/layer-imports@v2", "coupling/other@v1"))], "rule_id string, instance_id string, fingerprint string, package_root string, dependency string")
    assert erosion.boundaries(rows).first().violation_count == 2


# ---- source texts


def held(text):
    scan = extraction.Scan(text)
    out = {}
    for _, _, callee, args, at in scan.calls:
        inside = [f for f in scan.functions if f[2] <= at < f[3]]
        out[callee] = min(inside, key=lambda f: f[3] - f[2])[1] if inside else None
    return out


@pytest.mark.parametrize(
    ("text", "callee", "expected"),
    [
        ("function parse() { const parts = 'a,b'.split(','); }", "'a,b'.split", "parse"), ("class Parser {\n  parse() {\n    const parts = 'a,b'.split(',');\n  }\n}", "'a,b'.split", "Parser.parse"),
        ("const pack = (a) => a.join(',');\nx.join('|')", "a.join", "pack"), ("const pack = (a) => a.join(',')\nx.join('|')", "x.join", None), ("function a(){ } x.join(',')", "x.join", None),
        ("list.map(i => i.join('|'))", "i.join", "arrow"), ("export default function () { t.join('4') }", "t.join", "anonymous"), ("const h = function () { s.join('3') }", "s.join", None),
        ("const o = { run() { q.join('1') } }", "q.join", "run"), ("class A { get v() { return g.split('q') } }", "g.split", None), ("class A { constructor() { g.split('q') } }", "g.split", None),
        ("const f: (x: string) => void = async <T>(y: T): Promise<void> => { z.split('k') }", "z.split", "f"), ("function out() { function inner() { } y.join('-') }", "y.join", "out"), ("a ? x => x.join('1') : y.join('2')", "y.join", None),
        ("const K = class { m() { w.join('1') } }", "w.join", "m"), ("async function go(): Promise<{ a: string }> { w.join('1') }", "w.join", "go"), ("for (const a of b) { w.join('1') }", "w.join", None),
    ],
)
def test_enclosing_functions(text, callee, expected):
    assert held(text)[callee] == expected


def test_functions_and_calls_meet_in_spark(spark):
    text = "class P {\n  parse() { return a.split(',') }\n}\nfunction f() {\n" + "\n" * 200 + "  return b.join(';')\n}\nc.join('!')"
    one_line = "function first() { d.split('1') } e.split('2')"
    sources = spark.createDataFrame([("x.ts", text), ("y.ts", one_line), ("y.ts", one_line + " "), ("z.ts", None), ("w.ts", "")], "file string, content string")
    rows = extraction.calls(sources).collect()
    assert sorted((r.file, r.callee, r.containing_function or "", r.line) for r in rows) == sorted([("x.ts", "a.split", "P.parse", 2), ("x.ts", "b.join", "f", 205), ("x.ts", "c.join", "", 207), *[("y.ts", "d.split", "first", 1), ("y.ts", "e.split", "", 1)] * 2])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("import { foo } from './foo';", []), ("export { foo } from './foo';", []), ('const t = typeof x === "string";', []), ("const t = 'string' !== typeof x", []), ('console.log("hello");', ["hello"]), ('function greet() { return "hi"; }', ["hi"]),
        ("interface I { 'k': string; readonly 'r'?: number; m(a: 'x'): void }", ["x"]), ("type T = { 'k': { 'n': 1 } }", []), ("const o = { 'k': 'v' }", ["k", "v"]), ("typeof x === 'q' + z", ["q"]), ("x + typeof y === 'w'", ["w"]), ("typeof a.b['c'].d() == 'object'", ["c"]),
        ("import x = require('y'); const z = require('w'); import('./dyn')", ["w", "./dyn"]), ("declare module 'mm' { }", []), ("const r = /['\"]/g, s = 'x'", ["x"]), ("a / 'b' / c", ["b"]), ("`a${'in'}b`", ["in"]), ("'open\nlet s = 'x'", ["x"]), ("@Dec('a') class C { }", ["a"]),
        ("switch (x) { case 'a': { f('1') } }", ["a", "1"]),
    ],
)
def test_literals_in_context(text, expected):
    assert [v for kind, v, _, _ in extraction.literals_of(text) if kind == "string"] == expected


def test_numbers():
    assert [v for kind, v, _, _ in extraction.literals_of("1 0x1F 1_000 .5 1e3 0b1 10n a1 x[2] 3.25")] == ["1", "0x1F", "1_000", ".5", "1e3", "0b1", "2", "3.25"]


def test_names_are_walked_back_however_far(spark):
    wide = "abc" + " " * 5000 + ".join(',')"
    sources = spark.createDataFrame([("a.ts", wide)], "file string, content string")
    assert [(r.role, len(r.function_name)) for r in extraction.bindings(extraction.calls(sources)).collect()] == [("packer", 5008)]
    assert extraction.Scan("new" + " " * 500 + "Date('2020').toISOString()").calls[0][2].startswith("new")


@pytest.mark.parametrize("text", ["f(" * 100_000, "\\'" * 100_000, "`\\`" * 100_000, "/[" * 100_000, "{" * 100_000, "a=>" * 100_000, "typeof " + "a." * 100_000 + "b === 'x'", "typeof a['b'] === 'c';" * 20_000, "<a " * 100_000, "a ? " * 100_000])
def test_scans_are_linear(text):
    import time

    def seconds(t):
        began = time.process_time()
        extraction.Scan(t)
        return time.process_time() - began

    small = min(seconds(text[: len(text) // 4]) for _ in range(2))
    assert seconds(text) < 12 * small + 0.2


# ---- facts over runs and projects


KINDS = "kind string, value string, line int, column int"


def test_only_changed_sources_are_extracted(spark, tmp_path):
    from codegov.sources import fact_cache

    seen = []

    def extract(rows):
        seen.append({r.content for r in rows.select("content").collect()})
        return extraction.literals(rows)

    table = lambda rows: spark.createDataFrame(rows, "file string, content string")
    run = lambda rows, **more: fact_cache.collect(table(rows), extract, str(tmp_path), "constants", KINDS, **more)
    facts = lambda found: sorted((r.file, r.value) for r in found.collect())
    states = lambda plan: sorted(r.part for r in plan.collect())
    one = [("a", "f('1')"), ("b", "g('2')"), ("same", "f('1')"), ("none", "x"), ("null", None)]
    found, plan = run(one)
    assert facts(found) == [("a", "1"), ("b", "2"), ("same", "1")] and states(plan) == ["miss"] * 4 and seen.pop() == {"f('1')", "g('2')", "x", None}
    found, plan = run(one)
    assert facts(found) == [("a", "1"), ("b", "2"), ("same", "1")] and states(plan) == ["hit"] * 4 and seen.pop() == set()
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    two = [("a", "f('1')"), ("b", "g('3')"), ("none", "x"), ("null", None)]
    found, plan = run(two)
    assert facts(found) == [("a", "1"), ("b", "3")] and states(plan) == ["hit"] * 3 + ["miss", "stale"] and seen.pop() == {"g('3')"}
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert sum(before.get(p) == t for p, t in after.items()) >= 2  # partitions without a change stay as they are
    entries = fact_cache.read_entries(table(two), str(tmp_path), "constants", KINDS)
    assert entries.select("cache_key").distinct().count() == 4
    # other settings are other entries, and a full run is what the cache gives
    found, plan = run(two, settings="other")
    assert facts(found) == [("a", "1"), ("b", "3")] and states(plan).count("miss") == 4
    found, plan = run([])
    assert found.count() == 0 and set(states(plan)) == {"stale"} and fact_cache.read_entries(table(two), str(tmp_path), "constants", KINDS).count() == 0


def test_ulids_sort_and_repeat(spark):
    rows = spark.range(5000).select(F.col("id").alias("ord"))
    one = ledger_files.stamp(rows, "run", 1_700_000_000_000, ["ord"]).orderBy("ord").collect()
    ids = [r.entry_id for r in one]
    assert ids == sorted(ids) and len(set(ids)) == 5000 and all(re.fullmatch("[0-9A-HJKMNP-TV-Z]{26}", i) for i in ids)
    assert ids == [r.entry_id for r in ledger_files.stamp(rows, "run", 1_700_000_000_000, ["ord"]).orderBy("ord").collect()]
    assert ids[-1] < ledger_files.stamp(rows.limit(1), "a later one", 1_700_000_000_001, ["ord"]).first().entry_id
    assert ids[0][:10] == "01HF7YAT00"  # the time alone


def test_appends_are_checked_in_order_and_added_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "CHUNK", 2)
    path, later, past = str(tmp_path / "l.ndjson"), datetime(2024, 3, 1), datetime(2024, 1, 1)
    kind = "fingerprint string, type string, expires_at timestamp, ord int"
    run = lambda rows, name: sorted((r.fingerprint, r.ord) for r in ledger_files.append_run(spark.createDataFrame(rows, kind), path, name, AS_OF, ["ord"]).collect())
    first = [("f", "observed", None, 1), ("f", "baselined", later, 2), ("f", "observed", None, 3), ("f", "unverified", None, 4), ("f", "resolved", None, 5), ("f", "observed", None, 6), ("g", "baselined", past, 7), ("g", "observed", None, 8), ("h", "baselined", later, 9)]
    assert run(first, "one") == [("f", 3), ("f", 4)]
    assert run(first, "one") == [("f", 3), ("f", 4)]  # again, as after a lost job
    last = lambda: {r.fingerprint: r.type for r in ledger.latest(ledger_files.read_ledger(spark, path), order="entry_id").collect()}
    assert ledger_files.read_ledger(spark, path).count() == 7 and last() == {"f": "observed", "g": "observed", "h": "baselined"}
    assert run([("h", "observed", None, 1), ("h", "unverified", None, 2), ("i", "observed", None, 3), ("f", "observed", None, 4)], "two") == [("h", 1), ("h", 2)]
    assert last() == {"f": "observed", "g": "observed", "h": "baselined", "i": "observed"}
    (tmp_path / "l.ndjson" / "run-three").mkdir()
    (tmp_path / "l.ndjson" / "run-three" / "part-0.json").write_text('{"fingerprint":"z","type":"observed"}\n')
    assert "z" not in last()  # a run that didn't finish


def test_bucketed_facts_merge_and_join_without_a_shuffle(spark, tmp_path):
    from codegov.operators import structures
    from codegov.sources import fact_tables

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([("r", "a.ts", "string", "v", 1, 1, "x"), ("r", "b.ts", "string", "v", 1, 1, "y"), ("s", "a.ts", "string", "v", 1, 1, "z")], "repo string, file string, kind string, value string, line int, column int, extra string")
    folder = f"file://{tmp_path}/facts"
    for k in (0, 1):
        fact_tables.append_facts(rows.withColumn("extra", F.concat("extra", F.lit(str(k)))), "constants", folder, k, buckets=4)
    one = fact_tables.merged(spark, "constants", folder)
    assert sorted((r.repo, r.file, r.extra, r.source_order) for r in one.collect()) == [("r", "a.ts", "x0", 0), ("r", "b.ts", "y0", 0), ("s", "a.ts", "z0", 0)]
    assert "Exchange" not in plan(one)
    assert grouping.literal_counts(one, 2, keys=("repo",)).count() == 1 and grouping.literal_counts(one, 2).first().files == 2
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sources = spark.createDataFrame([("r", "a.ts", "p", True, 1, 1), ("s", "a.ts", "p", True, 1, 1)], "repo string, file string, name string, is_heterogeneous boolean, line int, column int")
        reads = structures.origin(spark.createDataFrame([("r", "c.ts", "q", "a.ts", "p", "0", 3, 1), ("r", "a.ts", "p", None, None, "1", 4, 1)], "repo string, file string, name string, origin_file string, origin_name string, accessed_index string, line int, column int"))
        for kind, table in (("positional_sources", sources), ("positional_accesses", reads)):
            fact_tables.append_facts(table, kind, folder, 0, buckets=4)
        found = structures.position_findings(*(fact_tables.merged(spark, k, folder) for k in ("positional_sources", "positional_accesses")), keys=("repo",))
        assert "Exchange" not in plan(found)
        assert sorted((r.repo, r.what, r.artifacts[0].data) for r in found.collect()) == [
            ("r", "access", '{"file":"a.ts","index":"1","line":4,"name":"p"}'), ("r", "access", '{"file":"c.ts","index":"0","line":3,"name":"q"}'), ("r", "source", '{"column":1,"file":"a.ts","line":1,"name":"p","positions":null}'),
        ]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_algorithms_show_their_bindings(spark):
    rows = spark.createDataFrame([("p", "packer", ";", "a.ts", "f"), ("p", "unpacker", ";", "b.ts", None), ("p", "packer", "only", "a.ts", None)], "pattern_id string, role string, binding_key string, file string, containing_function string")
    found = grouping.algorithm_findings(rows).collect()
    assert len(found) == 2 and len({r.fingerprint for r in found}) == 1 and {r.message for r in found} == {"pattern p shares ; across 2 files without a shared abstraction"}
    assert '"role":"packer"' in next(r.artifacts[0].data for r in found if '"a.ts"' in r.artifacts[0].data)
