"""The parts of the operators' methods against plain versions: sums over all label sequences, loops, differences."""

import collections
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from codegov.llm import common, html_text, packing, quality, toxicity, vocab

D, ORDER = toxicity.DISCOUNT, toxicity.ORDER


class PlainKneserNey:
    """Both classes and their shared back-off, by dictionaries and recursion."""

    def __init__(self, ordinary, toxic):
        self.classes = [self.count(ordinary), self.count(toxic)]
        self.both = collections.defaultdict(collections.Counter)
        for g in self.classes:
            for h, c in g.items():
                self.both[h].update(c)
        self.lower, above = [], self.both
        for _ in range(ORDER - 1):
            t = collections.defaultdict(collections.Counter)
            for h, c in above.items():
                for x in c if h else ():
                    t[h[1:]][x] += 1
            self.lower.append(t)
            above = t
        self.alphabet = 1 + len({x for c in self.both.values() for x in c})

    @staticmethod
    def count(words):
        g = collections.defaultdict(collections.Counter)
        for w, n in words.items():
            s = toxicity.START + w + toxicity.END
            for i in range(1, len(s)):
                g[s[max(0, i - ORDER + 1) : i]][s[i]] += n
        return g

    def shared(self, h, x):
        below = self.shared(h[1:], x) if h else 1 / self.alphabet
        for t in self.lower:
            if h in t:
                n = sum(t[h].values())
                return max(t[h][x] - D, 0) / n + D * len(t[h]) / n * below
        return below

    def ratio(self, h, x):
        p = []
        for g in self.classes:
            c, n = g.get(h, {}), sum(g.get(h, {}).values())
            p.append((max(c.get(x, 0) - D, 0) / n + D * len(c) / n * self.shared(h[1:], x)) if n else self.shared(h[1:], x))
        return math.log(p[1] / p[0])

    def word(self, w):
        s = toxicity.START + w + toxicity.END
        return sum(self.ratio(s[max(0, i - ORDER + 1) : i], s[i]) for i in range(1, len(s)))


def test_ratios_equal_a_plain_kneser_ney():
    r = random.Random(4)
    make = lambda letters, n: {"".join(r.choice(letters) for _ in range(r.randint(1, 9))): r.randint(1, 4) for _ in range(n)}
    ordinary, toxic = make("abcé", 120), make("bcd", 60)
    plain = PlainKneserNey(ordinary, toxic)
    rows = sorted((h, x) for h, c in plain.both.items() for x in c)
    counts = np.array([[g.get(h, {}).get(x, 0) for g in plain.classes] for h, x in rows], float)
    scorer = toxicity.Scorer(toxicity.train_ratios(toxicity.Grams([h for h, _ in rows], [x for _, x in rows], counts)))
    words = [*ordinary, *toxic, "zzz", "abczz", "bcdbcdbcd", "é"]
    # where neither class has seen a character after a history, the plain version's shared part is the same on both sides
    assert np.allclose(scorer.words(words), [plain.word(w) for w in words], atol=1e-4)


def chain_score(field, rows, labels):
    e = sum(sum(field.weights.get(f, 0.0) for f in row) for row, y in zip(rows, labels, strict=True) if y)
    return field.start[labels[0]] + e + sum(field.step[a, b] for a, b in itertools.pairwise(labels))


def test_viterbi_equals_the_best_of_all_label_sequences():
    r = np.random.default_rng(11)
    for n in (1, 2, 5, 8):
        names = [f"f{k}" for k in range(6)]
        field = html_text.Field({f: float(x) for f, x in zip(names, r.normal(size=6), strict=True)}, r.normal(size=2), r.normal(size=(2, 2)))
        rows = [list(r.choice(names, 2)) for _ in range(n)]
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: chain_score(field, rows, y))
        assert tuple(field.decode(rows)) == best
    assert field.decode([]) == []


def test_field_is_fitted_by_the_likelihood_of_whole_chains():
    """After training, each feature's and transition's expected number, over all label sequences, is its number in the labels less the ridge."""
    from codegov.llm.html_training import labelled_pages

    pages, ridge = [(found[:7], labels[:7]) for found, labels in labelled_pages(12)], 0.5
    field = html_text.fit(pages, epochs=1500, rate=0.02, ridge=ridge)
    seen, expected = collections.Counter(), collections.Counter()

    def count(into, rows, y, share):
        for row, label in zip(rows, y, strict=True):
            for f in row if label else ():
                into[f] += share
        into["start", y[0]] += share
        for pair in itertools.pairwise(y):
            into[pair] += share

    for found, labels in pages:
        rows = html_text.features(found)
        count(seen, rows, labels, 1.0)
        scores = {y: chain_score(field, rows, y) for y in itertools.product((0, 1), repeat=len(rows))}
        top = max(scores.values())
        z = top + math.log(sum(math.exp(s - top) for s in scores.values()))
        for y, s in scores.items():
            count(expected, rows, y, math.exp(s - z))
    weights = field.weights | {("start", y): field.start[y] for y in (0, 1)} | {(a, b): field.step[a, b] for a in (0, 1) for b in (0, 1)}
    assert max(abs(expected[f] - seen[f] + ridge * w) for f, w in weights.items()) < 0.05


def test_attention_equals_a_loop_and_its_gradient_differences():
    r = np.random.default_rng(3)
    x, at, y = r.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    w = {"We": r.normal(size=(quality.FEATURES, quality.HIDDEN)) * 0.3, "be": r.normal(size=quality.HIDDEN), "V": r.normal(size=(quality.HIDDEN, quality.GATE)), "U": r.normal(size=(quality.HIDDEN, quality.GATE)), "a": r.normal(size=quality.GATE), "c": r.normal(size=quality.HIDDEN), "b": np.zeros(1)}

    def logits(w):
        out = []
        for i, j in itertools.pairwise(at):
            h = [np.tanh(w["be"] + sum(v * w["We"][k] for k, v in enumerate(row))) for row in x[i:j]]
            e = [math.exp(sum(w["a"] * np.tanh(v @ w["V"]) / (1 + np.exp(-(v @ w["U"]))))) for v in h]
            out.append(float(sum(s * v for s, v in zip(e, h, strict=True)) / sum(e) @ w["c"] + w["b"][0]))
        return np.array(out)

    s = quality.forward(w, x, at)
    assert np.allclose(s["logit"], logits(w)) and np.allclose(np.add.reduceat(s["a"], at[:-1]), 1)
    loss = lambda w: float(np.mean(np.logaddexp(0, logits(w)) - y * logits(w)))
    g = quality.gradient(w, s, x, at, y)
    for k in w:
        i = tuple(r.integers(0, n) for n in w[k].shape)
        up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[k][i]) < 1e-6


def plain_fill(demand, limits):
    """The rule one item at a time: the largest dot product of what an item needs and what is left, as shares of the limits."""
    share = [[Fraction(d, m) for d, m in zip(row, limits, strict=True)] for row in demand]
    order = sorted(range(len(demand)), key=lambda i: (-demand[i][0], -sum(share[i]), i))
    found, k = {}, 0
    while len(found) < len(demand):
        room = list(limits)
        while True:
            best = None
            for i in order:
                if i not in found and all(d <= x for d, x in zip(demand[i], room, strict=True)):
                    s = sum(a * Fraction(b, m) for a, b, m in zip(share[i], room, limits, strict=True))
                    if best is None or s > best[0]:
                        best = (s, i)
            if best is None:
                break
            found[best[1]] = k
            room = [x - d for x, d in zip(room, demand[best[1]], strict=True)]
            if min(room) <= 0:
                break
        k += 1
    return [found[i] for i in range(len(demand))]


@pytest.mark.parametrize("limits", [(100, 3, 60), (64, 64, 64), (50, 2, 40)])
def test_filling_equals_the_plain_dot_product_rule(limits):
    r = np.random.default_rng(limits[0])
    need = np.stack([r.integers(1, 51, 120), np.ones(120, int), r.integers(0, 41, 120)], 1)
    need[100:] = need[:20]  # ties
    assert packing.fill(need, np.array(limits)).tolist() == plain_fill(need.tolist(), limits)


def test_every_limit_of_packing_binds_where_it_is_the_tightest(spark):
    """Sequences under a limit on loss-bearing ids, and on segments, that is reached before the one on tokens."""
    docs = spark.createDataFrame([(k, " ".join(f"word{k + j}" for j in range(5 + k % 40))) for k in range(300)], "doc_id long, text string")
    for limits, most in (({"max_loss": 300}, "loss"), ({"max_segments": 4}, "segments")):
        rows = packing.pack_documents(docs, size=2048, **limits).toPandas()
        last = (rows["start"] + rows["length"] == rows["doc_tokens"]).astype(int)
        by = rows.assign(loss=rows["length"] - last, segments=1).groupby("sequence_id")[["length", "loss", "segments"]].sum()
        assert rows.groupby("doc_id")["length"].sum().eq(rows.groupby("doc_id")["doc_tokens"].first()).all()
        assert by["length"].max() <= 2048 and by[most].max() <= limits[f"max_{most}"] and by[most].median() >= 0.9 * limits[f"max_{most}"] and by["length"].max() < 1200


def test_join_stores_only_texts_of_pairs(spark, monkeypatch):
    import random

    from codegov.llm import ngram_join

    rng = random.Random(11)
    texts = [" ".join(rng.choices("abcdef", k=40)) for _ in range(150)]  # most share some shingle with another
    texts += [f"{t} x" for t in texts[:8]] + texts[8:16]  # near copies, exact copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = []
    plain = ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df: (out := plain(df), "text" in df.columns and stored.append(out.count()))[0])
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, 4, 85, 100).collect()}
    assert got == {i: i - 150 if i >= 150 else i for i in range(166)}
    assert 0 < sum(stored) < 80, stored


def test_a_sample_of_labelled_documents_starts_no_python(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = common.labelled_sample(docs, labels, "toxic", 3, 1, 20)
    assert "ExistingRDD" not in sample._jdf.queryExecution().toString()
    usable = labels.where("toxic in (0, 1) and pmod(crc32(cast(cast(doc_id as string) as binary)), 3) != 1").join(docs.where("text is not null"), "doc_id", "left_semi")
    want = sorted((r["doc_id"], y) for y in (0, 1) for r in usable.where(f"toxic = {y}").orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").limit(20).collect())
    assert sorted((r["doc_id"], r["y"]) for r in sample.collect()) == want and {y for _, y in want} == {0, 1}
    assert sample.schema["doc_id"].dataType == docs.schema["doc_id"].dataType


def test_a_task_gives_memory_back_when_it_ends(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    rows = common.thrifty(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(rows) == 2 and not given
    assert list(rows) == [3] and given == [1]


def test_packing_holds_few_words_between_portions():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij", k=6)) + " " + " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(2_000)) for _ in range(200)]
    bpe, largest = packing.WordBpe(vocab.default_path("word_bpe_49k.json")), 0
    for text, ids in zip(texts, bpe.encode_many(texts), strict=True):
        largest = max(largest, len(bpe.words.known))
        if text in texts[:3]:
            assert ids.tolist() == bpe.whole.encode(text, add_special_tokens=False).ids
    assert 0 < largest < 300_000  # 400,000 different words in all
    bpe.words.clear()
    assert not bpe.words.known
