"""Search over several shards: thresholds, merging and ties between shards, and blocks that are skipped."""

import collections
import math
import random

import numpy as np
import pyarrow as pa

from codegov.llm import search


def brute(texts, queries, k):
    """The k best of every query by the formula, over all documents."""
    words = {i: collections.Counter(t.split()) for i, t in texts.items()}
    length = {i: sum(c.values()) for i, c in words.items()}
    mean, n = sum(length.values()) / len(length), len(length)
    df = collections.Counter(w for c in words.values() for w in c)
    out = {}
    for q, text in queries.items():
        asked = collections.Counter(text.split())
        scores = {i: sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w, m in asked.items() if w in c) for i, c in words.items()}
        out[q] = sorted(((-round(x, 9), i) for i, x in scores.items() if x > 0))[:k]
    return out


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    texts = {i: " ".join(rng.choices(vocabulary, weights, k=rng.randint(3, 60))) for i in range(n)}
    for i in range(0, n, 7):  # copies, which land in other shards
        texts[i] = texts[i % 21]
    return texts


def test_search_over_many_shards_with_ties(spark):
    texts = made(900, 4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(24)
    asked = {i: texts[i] for i in range(0, 900, 45)}
    got = collections.defaultdict(list)
    for r in search.search(docs, docs.where("doc_id % 45 = 0"), 8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-round(r.score, 9), r.doc_id))
    assert dict(got) == brute(texts, asked, 8)
    assert any(len({s for s, _ in found}) < len(found) for found in got.values())  # ties across shards


def test_hopeless_blocks_are_not_read(monkeypatch):
    rng = random.Random(9)
    texts = {}  # documents of 25 topics, each mostly in its own words
    for i in range(2000):
        topic = [f"t{i % 25}", *(f"t{i % 25}w{k}" for k in range(30))]
        texts[i] = " ".join([topic[0]] * 6 + rng.choices(topic, k=20) + rng.choices(["the", "of", "and", *(f"c{k}" for k in range(50))], k=10))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()))], ["doc_id", "text"])
    (row,) = [r for b in search._index([batch]) for r in b.to_pylist()]
    lengths = [len(t.split()) for t in texts.values()]
    shard = search.Shard(row, sum(lengths) / len(lengths))
    df = dict(zip(shard.terms.tolist(), np.diff(np.frombuffer(row["starts"], "<i8")).tolist(), strict=True))
    read = []
    plain = search._ranges
    monkeypatch.setattr(search, "_ranges", lambda a, n: (read.append(int(np.sum(n))), plain(a, n))[1])
    for q in (1, 5, 12, 30):
        (_, hashes, _), = list(search.word_hashes(pa.array([texts[q]])))
        terms, times = np.unique(hashes, return_counts=True)
        weights = np.array([m * math.log(1 + (2000 - df[t] + 0.5) / (df[t] + 0.5)) for t, m in zip(terms.tolist(), times.tolist(), strict=True)])
        read.clear()
        ids, scores = shard.best(terms, weights, 5, 0.0)
        order = np.lexsort((ids, -scores))
        assert [(-round(float(scores[i]), 9), int(ids[i])) for i in order] == brute(texts, {q: texts[q]}, 5)[q]
        postings, entries = sum(df[t] for t in terms.tolist()), read[0]
        assert entries > 0 and sum(read[1:]) < 0.8 * postings
        # a threshold from elsewhere skips more, and leaves out only what is below it
        known = float(scores[order[0]])
        read.clear()
        best, _ = shard.best(terms, weights, 5, known)
        assert int(ids[order[0]]) in best.tolist() and sum(read[1:]) < 0.3 * postings


def test_few_postings_are_gathered_one_by_one(monkeypatch):
    # common terms come as whole rows of blocks, so only short lists and the best documents' own postings are gathered
    rng = random.Random(3)
    common = [f"c{k}" for k in range(120)]  # every block of documents has nearly all of these, and some document of most topics
    texts = {i: " ".join(rng.choices(common, k=60) + rng.choices([f"t{i % 40}w{k}" for k in range(40)], k=12)) for i in range(2000)}
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()))], ["doc_id", "text"])
    (row,) = [r for b in search._index([batch]) for r in b.to_pylist()]
    shard = search.Shard(row, 72.0)
    df = dict(zip(shard.terms.tolist(), np.diff(np.frombuffer(row["starts"], "<i8")).tolist(), strict=True))
    read = []
    plain = search._ranges
    monkeypatch.setattr(search, "_ranges", lambda a, n: (read.append(int(np.sum(n))), plain(a, n))[1])

    total = most = 0
    for q in range(0, 2000, 200):
        (_, hashes, _), = list(search.word_hashes(pa.array([texts[q]])))
        terms, times = np.unique(hashes, return_counts=True)
        weights = np.array([m * math.log(1 + (2000 - df[t] + 0.5) / (df[t] + 0.5)) for t, m in zip(terms.tolist(), times.tolist(), strict=True)])
        ids, scores = shard.best(terms, weights, 5, 0.0)
        order = np.lexsort((ids, -scores))
        assert [(-round(float(scores[i]), 9), int(ids[i])) for i in order] == brute(texts, {q: texts[q]}, 5)[q]
        read.clear()
        shard.best(terms, weights, 5, float(scores.min()))
        total, most = total + sum(read), most + sum(df[t] for t in terms.tolist())
    assert total < 0.6 * most, (total, most)


def test_a_term_is_one_row_before_it_meets_the_queries(spark, monkeypatch):
    plans = []
    plain = search.cut
    monkeypatch.setattr(search, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df))[1])
    docs = spark.createDataFrame(list(made(200, 8).items()), "doc_id long, text string").repartition(12)
    search.search(docs, docs.where("doc_id % 45 = 0"), 3)
    (joined,) = [p for p in plans if "Join" in p and "df#" in p]
    assert joined.count("Join ") == 1 and "LeftSemi" not in joined  # else rows are terms times shards
    assert "Aggregate [term" in joined[joined.index("Join ") :]
