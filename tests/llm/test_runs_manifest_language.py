"""Periodic runs, Merkle manifest and language profiles against plain versions, and over odd rows."""

import hashlib
import random
import string
import zlib

import duckdb
import pyarrow as pa
import pytest

from codegov.llm import language_id, manifest, word_runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "no id here no id here no id here no id here", "en", "a", 3), (1, None, None, None, None), (2, "", "en", "", 0), (3, "word", "fr", "b", 4),
    (4, "A b " * 5000, "en", "a", 20000), (4, "A b " * 5000, "en", "a", 20000), (4, "other text", "de", "a", 10), (5, "\x0b\t \n", "de", "b", 4), (6, "1234 !! \u0301\u0302 5\u0301", "en", None, 7),
    (7, "naïve Straße čeština 日本語テキスト " * 3, "cs", "é", 90), (8, "x" * 100_000, "en", "a", 100_000), (10, "abc " * 11, "en", "b", 44), (-5, "minus", "en", "a", 5),
]


@pytest.mark.parametrize("op", ["op11_word_runs", "op12_manifest", "op13_language"])
def test_query_equals_sql(spark, sf_dir, op):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    query, sql = next((m.QUERIES[op], m.ORACLE_SQL[op]) for m in (word_runs, manifest, language_id) if op in m.QUERIES)
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    names = sorted(want.columns)
    plain = lambda v: None if v != v else int(v) if isinstance(v, float) and v.is_integer() else v
    rows = lambda x: sorted(repr([plain(v) for v in r]) for r in x[names].astype(object).where(x[names].notna(), None).values.tolist())
    assert rows(got) == rows(want) and len(got) > 0


def plain_runs(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, q, n) for (s, n), q in found.items())


def test_runs_equal_a_walk_over_all_lags():
    rng, texts = random.Random(5), []
    for _ in range(400):
        w = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(0, 110))]
        p = rng.randint(1, 30)
        texts.append(w if rng.random() < 0.5 else w[p // 2 :] + w[:p] * rng.randint(1, 4) + w[: rng.randint(0, p)])
    a, b = ["a"], ["a", "b"]
    while len(b) < 200:
        a, b = b, b + a
    texts.append(b)  # every place ends a square
    for least in (1, 12):
        runs, collapsed = word_runs.runs_of_texts(pa.array([" ".join(w) for w in texts]), least)
        for w, got, text in zip(texts, runs.to_pylist(), collapsed.to_pylist(), strict=True):
            want = plain_runs(w, least)
            assert [(r["start"], r["period"], r["length"]) for r in got] == want
            gone = {i for s, q, n in want for i in range(s + q, s + n)}
            assert text == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_across_portions_of_pairs(monkeypatch):
    monkeypatch.setattr(word_runs, "PAIRS", 5)
    runs, _ = word_runs.runs_of_texts(pa.array(["z " + "a b c " * 40, "a b c " * 40]), 12)
    assert [[(r["start"], r["length"], r["period"]) for r in x] for x in runs.to_pylist()] == [[(1, 120, 3)], [(0, 120, 3)]]


def test_one_word_a_quarter_million_times_stays_small():
    runs, text = word_runs.runs_of_texts(pa.array(["a " * 250_000]), 12)
    assert runs.to_pylist() == [[{"start": 0, "length": 250_000, "period": 1}]] and text.to_pylist() == ["a"]


def test_words_are_cut_at_the_six_blanks_only():
    text = "".join(f"x{chr(i)}" for i in range(1, 0x3001))
    words, sizes = word_runs.words_of(pa.array([text, None]))
    want = text
    for c in "\t\n\x0b\x0c\r":
        want = want.replace(c, " ")
    assert words.to_pylist() == [w for w in want.split(" ") if w] and sizes.tolist() == [len(words), 0]


def test_runs_over_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumnRenamed("lang", "runs")  # a clashing name that isn't looked at
    got = word_runs.report(word_runs.word_runs(word_runs.repeat_tails(docs))).collect()
    want = []
    for doc_id, text, *_ in ODD:
        w = (text or "").split()  # no other blanks in these texts
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if w and h is not None and h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = [(0, 1, len(w))] if len(w) > 1000 and len(set(w)) == 1 else [(0, 2, len(w))] if len(w) > 1000 else plain_runs(w, 12)
        gone = {i for s, q, n in runs for i in range(s + q, s + n)}
        best = min(((-n, s, q) for s, q, n in runs), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        row = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        want.append((doc_id, len(runs), *row, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert word_runs.report(word_runs.word_runs(word_runs.repeat_tails(docs.limit(0)))).count() == 0


def plain_manifest(rows, changed, arity=16):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, a in enumerate(at):
                run = nodes[a // arity * arity : a // arity * arity + arity]
                paths[k].append((a % arity, run[: a % arity] + run[a % arity + 1 :]))
            nodes, at = [h("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)], [a // arity for a in at]
        return nodes[0], paths

    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))):
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = [tree([leaf(r, r[1]) for r in by[s]]) for s in sources]
    root, tops = tree([s[0] for s in subs]) if subs else (None, [])
    out = []
    for s, (sub, paths), top in zip(sources, subs, tops, strict=True):
        for r, path in zip(by[s], paths, strict=True):
            now = leaf(r, changed(r))
            for slot, others in path + top:
                now = h("".join([*others[:slot], now, *others[slot:]]))
            out.append((r[0], leaf(r, r[1]), sub, root, h("".join(x for _, others in path + top for x in others)), now, now == root))
    return out


def lowered(r):
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    return r[1].translate(low) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1]


@pytest.mark.parametrize("case", ["odd", "deep", "many sources", "one row"])
def test_manifest_equals_a_plain_one(spark, case):
    rows = {
        "odd": ODD,
        "deep": [(k, f"Text {k % 7}", "en", "hot" if k % 3 else f"s{k % 2}", k) for k in range(700)] + [(900, "Alone", None, None, 1)],
        "many sources": [(k, "T", "en", f"src{k % 300}", 1) for k in range(400)],
        "one row": [(0, "Only", "en", "a", 4)],
    }[case]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumnRenamed("lang", "lang")
    got = manifest.report(manifest.manifest(manifest.tampered(docs))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_manifest(rows, lowered)))


def test_manifest_of_pairs_and_of_nothing(spark):
    rows = [(k, f"t{k}", "en", f"s{k % 3}", k) for k in range(37)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("slot", manifest.F.lit(1)).withColumn("tree", manifest.F.lit("x"))
    got = manifest.report(manifest.manifest(manifest.tampered(docs), arity=2)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_manifest(rows, lowered, 2)))
    assert manifest.report(manifest.manifest(manifest.tampered(docs.limit(0)))).count() == 0


def test_a_changed_leaf_does_not_verify(spark):
    rows = [(k, f"t{k}", "en", "s", k) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("other_text", manifest.F.when(manifest.F.col("doc_id") == 7, "no").otherwise(manifest.F.col("text")))
    bad = manifest.report(manifest.manifest(docs)).where("not verified").collect()
    assert [r["doc_id"] for r in bad] == [7]


def test_language_over_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("score", manifest.F.lit(2))
    got = language_id.predict(docs, language_id.profiles(docs)).collect()
    assert len(got) == len(ODD)
    learned = {"en", "fr", "de", "cs"}
    for r in got:
        text = {i: t for i, t, *_ in ODD}[r["doc_id"]] or ""
        assert (r["lang_pred"] in learned) if any(c.isalpha() for c in text) else (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in got if r["doc_id"] == 7} == {"cs"}
    assert language_id.predict(docs.limit(0), language_id.profiles(docs)).count() == 0
    untaught = language_id.predict(docs, language_id.profiles(docs.limit(0))).collect()
    assert len(untaught) == len(ODD) and {(r["lang_pred"], r["score"]) for r in untaught} == {("und", 0.0)}


def test_language_of_held_out_documents(spark):
    got = language_id.op13_language(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    assert got.where("lang_pred != lang").count() <= 0.02 * got.count()


def test_distances_in_small_portions(monkeypatch, spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    learned = language_id.profiles(docs).collect()
    grams = language_id.np.unique([r["gram"] for r in learned])
    ranks = language_id.np.zeros((len(grams), 1), int)
    for r in learned:
        if r["lang"] == "en":
            ranks[language_id.np.searchsorted(grams, r["gram"]), 0] = r["rank"]
    texts = pa.array([t for _, t, *_ in ODD])
    whole = language_id.distances(texts, grams, ranks, 400)
    monkeypatch.setattr(language_id, "CELLS", 1)
    parts = language_id.distances(texts, grams, ranks, 400)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
