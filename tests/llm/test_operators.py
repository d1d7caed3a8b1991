"""Operators against brute force, their libraries or planted truth; defined results of odd rows."""

import collections
import hashlib
import html
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codegov.llm import byte_bpe, components, html_text, line_dedup, near_vectors, ngram_join, packing, quality, search, texthash, token_counts, toxicity
from codegov.llm.vocab import default_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", None, " \n\t ", "a", "A  b\n\n c ", "one two three four five", "one two three four five", "é ß 日本 😀\x00", "x " * 30_000, "<|endoftext|> <s> ▁ mid▁dle", "tab\tand\xa0nbsp  double", "trailing \n lines\n"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, a repeated row, and extra columns whose names clash with results."""
    rows = [(i, t, "s", 0.5, 1) for i, t in enumerate(ODD)] + [(None, "no id here at all", "s", 0.1, 0), (5, ODD[5], "s", 0.5, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, predicted int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def grams(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, k, num, den):
    sets = {i: grams(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_jaccard_equals_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, 4, 85, 100).collect()}
    assert got == brute_components(texts, 4, 85, 100)


def test_jaccard_of_edited_copies(spark):
    r = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = {}
    for g in range(6):
        base = list(r.choice(vocabulary, 80))
        for k in range(25):
            t = list(base)
            for _ in range(int(r.integers(0, 4))):
                t[int(r.integers(0, 80))] = str(r.choice(vocabulary))
            texts[len(texts)] = " ".join(t)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(rows, 5, 80, 100).collect()}
    assert got == brute_components(texts, 5, 80, 100)


def test_jaccard_of_odd_rows(odd):
    got = collections.defaultdict(set)
    for r in ngram_join.jaccard_components(odd, 4, 85, 100).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert got[0] == {(0, 0)} and got[1] == {(0, 1)} and got[2] == {(0, 2)} and got[3] == {(1, 3)} and got[6] == {(2, 5)} and got[None] == {(2, None)}
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and 6 not in {r.doc_id for r in kept.collect()} and kept.count() == odd.count() - 2


def test_components_of_long_sorted_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[1001] == 1000
    assert components.components(edges.limit(0)).count() == 0


def test_line_dedup_equals_sql(spark, docs, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(line_dedup.ORACLE_SQL["op3_line_dedup"]).fetchall()}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(docs).collect()}
    assert got == want and sum(n for _, n, _ in got.values()) > 0


def test_line_dedup_of_odd_rows(spark, odd):
    line = "This very line is long enough to count"
    rows = [(1, f"{line}\nown one"), (2, f"  {line.upper()}\t\nx\n{line}"), (3, line), (3, line), (4, "short"), (5, None), (6, "")]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_report(x).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].n_dropped, got[1].kept_sha256) == (1, sha("own one")) and (got[2].n_lines, got[2].n_dropped, got[2].kept_sha256) == (3, 2, sha("x"))
    assert got[3].n_dropped == 0 and (got[5].n_lines, got[5].kept_sha256) == (1, sha("")) and line_dedup.line_report(x).count() == 7
    assert line_dedup.dedup_lines(odd).columns == odd.columns and line_dedup.dedup_lines(odd.limit(0)).count() == 0
    assert line_dedup.line_report(odd).count() == odd.count()


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(5)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            base = r.normal(size=16)
            for _ in range(int(r.integers(1, 8))):
                rows.append((i, [float(x) for x in base + r.normal(size=16) * float(r.choice([0, 0.02, 0.2]))], label))
                i += 1
    rows += [(i, None, 0), (i + 1, [0.0] * 16, 0), (i + 2, [float("nan")] * 16, 0), (i + 3, [None] * 16, 0), (i + 4, [], 0), (i + 5, [1.0], 0)]
    got = {x.vec_id: x for x in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    valid = [(k, np.array(v), g) for k, v, g in rows if g is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    links = collections.Counter()
    root = {k: k for k, _, _ in rows}
    for a, x, g in valid:
        for b, y, h in valid:
            if a < b and g == h and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a] += 1
                links[b] += 1
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sum(got[k].n_links for k in got) >= 0.995 * sum(links.values()) and all(got[k].n_links <= links[k] for k in got)
    assert sum(got[k].component_id == root[k] for k in got) >= 0.99 * len(got)
    assert got[i].n_links == 0 and got[i].kept and near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_vectors_of_odd_rows(spark):
    rows = [(1, [1e200, 1e200], 0, 9), (2, [1e200, 1.01e200], 0, 9), (3, [1e-200, 1e-200], 0, 9), (4, [1.0, 0.0], 0, 9), (4, [1.0, 0.0], 0, 9), (5, [1.0, 0.01], 0, 9), (5, [0.0, 1.0], 1, 9), (6, [0.01, 1.0], 1, 9), (7, [0.0, 1.0], None, 9), (None, [1.0, 0.0], 0, 9)]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int").withColumn("kept", F.lit("x"))
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in near_vectors.near_vectors(x).collect())
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (-1, 0, -1, True)])


def test_vectors_reach_the_count_in_some_table():
    window, need = near_vectors.calibrate(0.98)
    y = np.random.default_rng(2).normal(size=(400, near_vectors.M)) * 0.3
    close = np.abs(y[:, None] - y[None]) <= window
    enough = np.triu(close.sum(2) >= need, 1)
    tables = near_vectors.M - need + 1
    found = [(i, j) for g in range(tables) for a, b in near_vectors._pairs(y, g, window, need, np.arange(400), np.arange(400), True) for i, j in zip(np.minimum(a, b), np.maximum(a, b), strict=True)]
    assert len(found) == len(set(found)) and set(found) == set(zip(*np.nonzero(enough), strict=True))


def test_tokenizers_equal_their_libraries(spark, odd, docs):
    import sentencepiece
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    rows = docs.select("doc_id", "text").limit(60).union(odd.select("doc_id", "text"))
    texts = [(r.doc_id, r.text or "") for r in rows.collect()]
    bpe = byte_bpe.ByteBpe(default_path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    word = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    own = packing.WordBpe(default_path("word_bpe_49k.json"))
    whole = packing.WordBpe(default_path("word_bpe_49k.json"), known=False)
    assert own.known and not whole.known
    for (_, t), w, v, e in zip(texts, own.encode_many([t for _, t in texts]), whole.encode_many([t for _, t in texts]), bpe.encode_many([t for _, t in texts]), strict=True):
        assert e.tolist() == plain.encode_ordinary(t) and bpe.decode_bytes(e) == t.encode() and bpe.decode_bytes(e[1:]) == t.encode()[len(bpe.decode_bytes(e[:1])) :]
        assert w.tolist() == v.tolist() == word.encode(t, add_special_tokens=False).ids
    want = collections.Counter((i, len(t.encode()), len(pieces.encode(t))) for i, t in texts)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(rows).collect()) == want
    got = byte_bpe.round_trip(odd).collect()
    assert len(got) == odd.count() and all(r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest() for r in got if r.doc_id is not None)
    counted = {r.doc_id: r for r in token_counts.count_tokens(odd).collect()}
    assert (counted[1].n_bytes, counted[1].n_tokens, counted[8].over_limit) == (0, 0, True)
    encoded = byte_bpe.encode_documents(odd)
    assert {r.doc_id: r.text for r in byte_bpe.decode_documents(encoded).collect()}[7] == ODD[7]
    for f in (byte_bpe.round_trip, token_counts.count_tokens, packing.cut_documents):
        assert f(odd.limit(0)).count() == 0


def test_packing_is_whole_and_tight(spark, odd, docs):
    rows = docs.select("doc_id", "text").union(odd.selectExpr("doc_id + 1000000", "text"))
    got = packing.pack_documents(rows).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048 and (got["length"] >= 1).all()
    whole = got.drop_duplicates(["doc_id", "start", "ids_crc32", "sequence_id", "offset"])
    per = whole[~whole.doc_id.isin([1000005]) & whole.doc_id.notna()].groupby("doc_id", dropna=False).agg(n=("length", "sum"), want=("doc_tokens", "max"))
    assert (per.n == per.want).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.concatenate(([0], np.cumsum(s["length"])[:-1]))).all()
    sizes = got.groupby("sequence_id")["length"].sum()
    assert sizes.sum() / (2048 * len(sizes)) > 0.95
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_vector_packing_keeps_every_limit():
    r = np.random.default_rng(1)
    need = np.stack([r.integers(1, 100, 500), np.ones(500, int), r.integers(0, 50, 500)], 1)
    found = packing.fill(need, np.array([100, 3, 60]))
    for k in range(3):
        assert np.bincount(found, need[:, k]).max() <= (100, 3, 60)[k]
    assert (found >= 0).all()


def test_search_equals_brute_force(docs, odd):
    texts = {r.doc_id: collections.Counter(words(r.text)) for r in docs.collect()}
    n, length = len(texts), {i: sum(c.values()) for i, c in texts.items()}
    mean, df = sum(length.values()) / n, collections.Counter(w for c in texts.values() for w in c)
    got = collections.defaultdict(list)
    for r in search.search(docs, docs.where("doc_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q, found in got.items():
        s = {i: sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w, m in texts[q].items() if w in c) for i, c in texts.items()}
        want = sorted(((i, x) for i, x in s.items() if x > 0), key=lambda x: (-x[1], x[0]))[:5]
        assert [i for i, _ in found] == [i for i, _ in want] and np.allclose([x for _, x in found], [x for _, x in want])
    assert {r.query_id for r in search.search(odd, odd, 3).collect()} == {3, 4, 5, 6, 7, 8, 9, 10, 11}
    assert search.search(odd.limit(0), odd.limit(0)).count() == 0


def test_html_text_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_html_text_of_other_layouts(spark):
    long = "A sentence of the story that goes on for a good while and then ends here."
    page = f"<html><body><div class='cookie-notice'><p>We use cookies on this site.</p></div><nav><a href=/>Home</a></nav><main><h1>Title &amp; more</h1><p>{long}<p>Second&nbsp;&lt;b&gt; one, {long}</main><aside><p>Related stories</p></aside><section id=comments><p>First! {long}</p></section><form><label>Mail</label></form><footer>&copy; 2024</footer><script>x='</p><p>no'</script></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(rows).collect()}
    assert got[1] == f"Title & more\n\n{long}\n\nSecond <b> one, {long}" and got[2] == got[3] == ""


def test_classifiers_learn_and_keep_odd_rows(spark, odd):
    r = np.random.default_rng(2)
    plain = [f"w{k}a" for k in range(200)]
    rows, marks = [], []
    for i in range(300):
        bad, junk = i % 3 == 0, i % 4 == 0
        t = list(r.choice(plain, 60))
        if bad:
            for k in r.integers(0, 60, 4):
                t[k] = str(r.choice(["zorkish", "zorkly", "blamper"]))
        rows.append((i, " ".join(t).upper() + " ### $$$ !!" * 8 if junk else " ".join(t)))
        marks.append((i, int(not junk), int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    tox = {x.doc_id: x for x in toxicity.score(docs, labels).collect()}
    assert np.mean([tox[i].predicted == t for i, _, t in marks]) > 0.97
    good = {x.doc_id: x for x in quality.score(docs, labels).collect()}
    assert np.mean([good[i].predicted == q for i, q, _ in marks]) > 0.97
    unseen = spark.createDataFrame([(900, "w1a w2a zorkness w3a zorkful w4a"), (901, "w1a w2a w3a w4a")], "doc_id long, text string")
    model = toxicity.train(docs, labels)
    a, b = toxicity.apply_curve(model[1], np.array(list(toxicity.Scorer(model[0]).evidence([x.text for x in unseen.orderBy("doc_id").collect()]))))
    assert a > b
    none = labels.limit(0)
    for keep, lab in ((toxicity.keep_clean, labels), (toxicity.keep_clean, none), (quality.keep_good, none)):
        out = keep(odd, lab)
        assert out.columns == odd.columns
        if lab is none:
            assert out.count() == odd.count()
    for f in (toxicity.score, quality.score):
        assert f(docs.limit(0), labels).count() == 0


def test_word_hashes_agree_with_words():
    import pyarrow as pa

    for t, s in zip(ODD, texthash.shingle_sets(pa.array(ODD, pa.string()), 3), strict=True):
        assert len(s) == len(grams(t, 3))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "line dedup", "n-gram Jaccard join", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids and ids < {r.doc_id for r in docs.select("doc_id").collect()}


def test_vectors_of_planted_links(spark):
    """Measured recall at the least similarity, over single-precision vectors, and the share of random pairs that tables make."""
    r = np.random.default_rng(11)
    base = r.normal(size=(600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = r.normal(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = r.uniform(0.9801, 0.985, 600)[:, None]
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * away]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(1200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {v.vec_id: v for v in near_vectors.near_vectors(table).collect()}
    wide = x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    want = np.argwhere(np.triu(wide @ wide.T >= 0.98, 1))
    found = sum(v.n_links for v in got.values()) / 2
    assert len(want) >= 600 and 0.995 * len(want) <= found <= len(want)
    window, need = near_vectors.calibrate(0.98)
    tables, per = near_vectors.tables_of(need)
    y = wide[:600] @ near_vectors.directions(64)
    near = np.abs(y[:, None] - y[None]) <= window
    made = np.logical_or.reduce([near[:, :, g * per : (g + 1) * per].all(2) for g in range(tables)])
    assert np.triu(made, 1).mean() * 2 < 0.001
