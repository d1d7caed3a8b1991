"""Toxicity by class-conditional Kneser-Ney models.

Two models of spelling, one of toxic and one of ordinary documents, give each word its log-likelihood: characters are
predicted from up to eleven before them in the word, begin and end included, so inflected and joined forms of an
expression share its evidence, and a stem that is made of common syllables still has a history of its own. Each class discounts its own counts and backs off to one Kneser-Ney model of all
classes together, whose lower orders count distinct left contexts. A spelling that neither class has seen therefore
has the ratio 0, and a rare one moves it little.

A document's evidence is its log-likelihood ratio normalised by length: over the whole text, over the window of WINDOW
words where it is largest, and over its different words of largest ratio, of which TOPS are taken, since a few words decide
and one alone may be chance. Words are runs of characters other than white space, in training as in scoring. A logistic curve turns
these into a score; it is fitted on labelled documents scored by models that have not seen them (two folds).

Models and curve are fitted on at most ``per_class`` labelled documents of either class (see labelled_sample); counts
of their words are made by Spark. Every document is scored whole.

Defined results: a null or empty text has no evidence and scores like any text with ratio 0. Without labelled
documents of both classes every score is 0. Repeated ids and extra columns don't matter; each row is returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, bounded, bucket_of, cut, give_back, labelled_sample, table, thrifty
from .vocab import PORTION, coded, forget, portions

ORDER, DISCOUNT = 12, 0.75
WINDOW, TOPS = 8, (1, 2, 4, 8)
#: White space, as Python's ``split`` has it (fixed characters).
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Numbers of a document's evidence.
SIZE = 3 + len(TOPS)
#: Labelled documents of either class that the models and the curve learn from, at most.
PER_CLASS = 1200
#: Words whose characters are looked up together.
WORDS_AT_ONCE = 20_000
START, END = "\x02", "\x03"
_MULTIPLIER = 0x9E3779B97F4A7C15


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The 64-bit code of a text with one more character. The empty text has code 0."""
    return (h + c + np.uint64(1)) * np.uint64(_MULTIPLIER)


def _characters(texts: pa.Array, width: int) -> np.ndarray:
    """The characters of each text, at most ``width``, at the right of its row; by buffers, without an object a text."""
    padded = pc.utf8_lpad(texts.cast(pa.large_string()), width, padding="\0")
    data = padded.buffers()[2]
    text = data.to_pybytes().decode("utf-8") if data is not None and len(padded) else ""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(padded), width)


class Grams:
    """Counts of (history, next character), as arrays: a row per pair, histories of at most ORDER - 1 characters.

    ``suffix[:, k]`` is the code of the history's last k characters, so the history itself is at ``suffix[:, size]``.
    """

    def __init__(self, histories: list[str] | pa.Array, nexts: list[str] | pa.Array, counts: np.ndarray):
        histories, nexts = (x if isinstance(x, pa.Array) else pa.array(x, pa.string()) for x in (histories, nexts))
        n, width = len(histories), ORDER - 1
        chars = _characters(histories, width)  # from the right, so that a history's last character is at its end
        self.size = np.asarray(pc.utf8_length(histories)).astype(np.int64)
        self.next = _characters(nexts, 1)[:, 0].astype(np.uint64)
        self.suffix = np.zeros((n, width + 1), np.uint64)
        for k in range(1, width + 1):
            code = np.zeros(n, np.uint64)
            for at in range(width - k, width):
                code = _step(code, chars[:, at].astype(np.uint64))
            self.suffix[:, k] = code
        self.counts = counts  # rows x classes

    @property
    def history(self) -> np.ndarray:
        return self.suffix[np.arange(len(self.size)), self.size]


class _Table:
    """Counts of one order: of histories (total, kinds of next characters) and of histories with a next character."""

    def __init__(self, history: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.grams, self.first, of = np.unique(gram, return_index=True, return_inverse=True)
        self.counts = np.bincount(of, count).astype(np.int32)  # several tables are held at once
        self.histories, of = np.unique(history[self.first], return_inverse=True)
        self.totals, self.kinds = np.bincount(of, self.counts).astype(np.int32), np.bincount(of).astype(np.int32)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether found)"""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def shared_probability(g: Grams) -> np.ndarray:
    """P(next | history without its first character) of each row, by the Kneser-Ney model of all classes together.

    Each lower order counts the distinct characters in front of a shorter history; a history that an order has never
    seen leaves the probability of the order below as it is.
    """
    tables: list[_Table] = []
    rows, size = np.arange(len(g.size)), g.size.copy()
    for _ in range(ORDER - 1):
        rows, size = rows[size > 0], size[size > 0] - 1
        history = g.suffix[rows, size]
        t = _Table(history, _step(history, g.next[rows]), np.ones(len(rows)))
        tables.append(t)
        rows, size = rows[t.first], size[t.first]
        del t.first
    p = np.full(len(g.size), 1.0 / (1 + len(np.unique(g.next))))
    for k in range(ORDER - 1):
        open_ = np.flatnonzero(g.size > k)
        history, gram = g.suffix[open_, k], _step(g.suffix[open_, k], g.next[open_])
        for t in tables:  # a short history may be in several; the first one counts
            h, there = _find(t.histories, history)
            at, seen = _find(t.grams, gram)
            rows, h, seen, at = open_[there], h[there], seen[there], at[there]
            p[rows] = np.maximum(np.where(seen, t.counts[at], 0) - DISCOUNT, 0) / t.totals[h] + DISCOUNT * t.kinds[h] / t.totals[h] * p[rows]
            open_, history, gram = open_[~there], history[~there], gram[~there]
    return p


def train_ratios(g: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted codes and log ratios of the seen grams; sorted codes and log ratios of the seen histories.

    ``g.counts`` has a column for ordinary and one for toxic texts. For a history that a class has seen, the ratio of a
    character that neither has seen after it is that of the two back-off weights, whatever the character; so two tables
    say all that the models know.
    """
    below, history = shared_probability(g), g.history
    codes, first, of = np.unique(history, return_index=True, return_inverse=True)
    weights, p = [], []
    for y in (0, 1):
        n = g.counts[:, y]
        total, kinds = np.bincount(of, n), np.bincount(of, n > 0)
        weights.append(np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0))
        p.append(np.where(total[of] > 0, np.maximum(n - DISCOUNT, 0) / np.maximum(total[of], 1), 0.0) + weights[y][of] * below)
    grams = _step(history, g.next)
    order = np.argsort(grams)
    return grams[order], np.log(p[1] / p[0]).astype(np.float32)[order], codes, np.log(weights[1] / weights[0]).astype(np.float32)


class Scorer:
    """Log-likelihood ratios of words and the evidence of texts."""

    def __init__(self, tables):
        self.grams, self.gram_values, self.histories, self.history_values = tables

    def words(self, words: list[str]) -> np.ndarray:
        """The sum of each word's ratios, over all its characters and its end."""
        if not words:
            return np.zeros(0)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        flat = np.frombuffer((START + (END + START).join(words) + END).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(flat)) - np.repeat(starts, lengths)
        history = np.zeros(len(flat), np.uint64)  # of the characters before each place
        for back in range(ORDER - 1, 0, -1):
            at = np.flatnonzero(place >= back)
            history[at] = _step(history[at], flat[at - back])
        places = np.flatnonzero(place >= 1)
        history = history[places]
        value = self._look(self.grams, self.gram_values, _step(history, flat[places]))
        missing = np.isnan(value)
        value[missing] = np.nan_to_num(self._look(self.histories, self.history_values, history[missing]))
        return np.add.reduceat(value.astype(np.float64), starts - np.arange(len(words)))

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at, there = _find(keys, wanted)
        return np.where(there, values[at], np.float32(np.nan))

    def evidence(self, texts: list[str]):
        """Yields (largest window ratio per word, ratio per word, log of words, means of the largest ratios above 0 of different words)."""
        for part in portions(texts, PORTION):
            codes, starts, ends, distinct = coded(part, lambda t: " ".join(t.lower().split()) or None, lambda t: [])
            known = np.concatenate([self.words(distinct[i : i + WORDS_AT_ONCE]) for i in range(0, len(distinct), WORDS_AT_ONCE)] or [np.zeros(0)])
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if a == b:
                    yield (0.0,) * SIZE
                    continue
                ratios = known[codes[a:b]]
                n, total = b - a, np.concatenate(([0.0], np.cumsum(ratios)))
                width, most = min(WINDOW, n), np.maximum(known[np.unique(codes[a:b])], 0)
                most = -np.sort(-most)[: max(TOPS)]
                yield (total[width:] - total[:-width]).max() / WINDOW, total[-1] / n, math.log1p(n), *(most[:k].sum() / k for k in TOPS)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a logistic curve, by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), g)
    return mean, scale, w


def apply_curve(curve, x: np.ndarray) -> np.ndarray:
    mean, scale, w = curve
    return 1 / (1 + np.exp(-np.clip(np.column_stack([(x - mean) / scale, np.ones(len(x))]) @ w, -30, 30)))


def _gram_counts(sample: DataFrame) -> DataFrame:
    """(fold, history, next, n0, n1): in how many documents' words of either class a character follows a history.

    A word counts once a document, so one document's habits weigh little.
    """
    words = sample.select("y", "fold", F.explode(F.array_distinct(F.split(F.lower("text"), SPACE))).alias("w")).where("w != ''").groupBy("fold", "y", "w").count()
    s = words.select("fold", "y", "count", F.concat(F.lit(START), "w", F.lit(END)).alias("s"))
    s = s.select("fold", "y", "count", "s", F.explode(F.sequence(F.lit(2), F.length("s"))).alias("i"))
    at = F.greatest(F.lit(1), F.col("i") - (ORDER - 1))
    grams = s.select("fold", "y", "count", F.substring("s", at, F.col("i") - at).alias("history"), F.substring("s", F.col("i"), F.lit(1)).alias("next"))
    n = lambda y: F.sum(F.when(F.col("y") == y, F.col("count")).otherwise(0)).alias(f"n{y}")
    return grams.groupBy("fold", "history", "next").agg(n(0), n(1))


def _models(sample: DataFrame) -> tuple[list, tuple] | None:
    """The ratio tables that each fold is scored by, learned from the other one, and those of both; arrays all of them."""
    t = _gram_counts(sample).orderBy("history", "next", "fold").toArrow().combine_chunks()
    fold = t["fold"].to_numpy()
    counts = np.stack([t["n0"].to_numpy(), t["n1"].to_numpy()], 1).astype(np.float64)
    if not (counts.sum(0) > 0).all():
        return None
    histories, nexts = (pa.concat_arrays(t[c].chunks) for c in ("history", "next"))
    same = np.append(False, np.asarray(pc.and_(pc.equal(histories[1:], histories[:-1]), pc.equal(nexts[1:], nexts[:-1]))))
    del t

    def of(rows: np.ndarray, counts: np.ndarray) -> tuple:
        return train_ratios(Grams(histories.take(pa.array(rows)), nexts.take(pa.array(rows)), counts))

    folds = []
    for k in (0, 1):  # a fold without a class can't teach; the other one then stands for itself
        other = np.flatnonzero(fold == 1 - k)
        other = other if len(other) and (counts[other].sum(0) > 0).all() else np.flatnonzero(fold == k)
        folds.append(of(other, counts[other]))
        give_back()
    first = np.flatnonzero(~same)
    whole = of(first, np.add.reduceat(counts, first))
    del histories, nexts, counts, fold, same
    give_back()
    return folds, whole


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, per_class: int = PER_CLASS):
    """The ratio tables and the curve, or None without labelled documents of both classes.

    Grams are counted and labelled documents are scored where they are; the driver gets arrays of counts and SIZE
    numbers a document.
    """
    sample = cut(labelled_sample(docs, labels, "toxic", modulus, held, per_class).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(2))))
    found = _models(sample)
    if found is None:
        return None
    shared, names = docs.sparkSession.sparkContext.broadcast(found[0]), [f"x{k}" for k in range(SIZE)]

    def run(batches):
        forget()
        scorers = [Scorer(t) for t in shared.value]
        for b in batches:
            fold, texts = b.column("fold").to_numpy(), b.column("text").to_pylist()
            x = np.zeros((len(fold), SIZE))
            for k in (0, 1):
                rows = np.flatnonzero(fold == k)
                x[rows] = np.array(list(scorers[k].evidence([texts[i] for i in rows]))).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([b.column("y"), *map(pa.array, x.T)], ["y", *names])

    rows = sample.select("y", "fold", "text").mapInArrow(thrifty(run), ", ".join(["y int", *(f"{c} double" for c in names)])).orderBy("y", *names).toArrow()
    shared.destroy()
    return found[1], fit_curve(np.stack([rows[c].to_numpy() for c in names], 1), rows["y"].to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with score double and predicted int."""
    model = train(bounded(docs), labels, modulus, held, per_class)
    if model is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        forget()
        tables, curve = shared.value
        scorer = Scorer(tables)
        for b in batches:
            x = np.array(list(scorer.evidence([t or "" for t in b.column(at).to_pylist()]))).reshape(-1, SIZE)
            s = apply_curve(curve, x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(thrifty(run), f"{schema}, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pipeline's stage: documents predicted toxic go; the columns of docs."""
    return added(docs, ("score", "predicted"), lambda x: score(x, labels).where("predicted = 0"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
