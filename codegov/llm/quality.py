"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes; the whole text is cut, nothing is left out. A passage is described by
shares of byte classes, by how much of it is repeated elsewhere in the document and by the form of its words. An
encoder turns that into a vector, gated attention (a tanh branch times a sigmoid branch) weighs the passages, and the
weighted vector is scored. Encoder, gates and score are learned together from document labels alone, by gradient steps
with numpy on at most ``per_class`` labelled documents of either class; the bias is then moved from the balanced
sample to the share of good documents among all labels of the training folds.

Defined results: a null or empty text is one empty passage. Without labelled documents of both classes every score is
1. Repeated ids and extra columns don't matter; each row is returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, bounded, bucket_of, labelled_sample, table, thrifty
from .texthash import mix, word_places

PASSAGE = 512
PER_CLASS = 1200
HIDDEN, GATE = 16, 8
#: Byte classes, each a share of a passage: capitals, small letters, digits, spaces, line feeds, sentence marks, marks
#: of exclamation, quotes and brackets, bars and dashes, other signs, bytes beyond ASCII, controls.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".,;:", "!?", "'\"()[]", "|-_=+", "#$%&*@^~<>/\\{}`")
_CLASS = np.full(256, len(CLASSES) + 1, np.uint8)
for _k, _c in enumerate(CLASSES):
    _CLASS[[ord(x) for x in _c]] = _k
_CLASS[128:] = len(CLASSES)
_KINDS = len(CLASSES) + 2
FEATURES = _KINDS + 4


def describe(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passages x FEATURES, offsets of the documents in the passages)."""
    rows, ends = [], [0]
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    for i, hashes, at, places in word_places(texts):
        for k in range(len(at) - 1):
            data = np.frombuffer(raw[i + k].as_buffer(), np.uint8)
            n = max(1, -(-len(data) // PASSAGE))
            part = np.bincount(np.repeat(np.arange(n), PASSAGE)[: len(data)] * _KINDS + _CLASS[data], minlength=n * _KINDS).reshape(n, _KINDS)
            size = np.maximum(part.sum(1), 1)
            h = hashes[at[k] : at[k + 1]]
            f = np.zeros((n, FEATURES))
            f[:, :_KINDS] = np.sqrt(part / size[:, None])
            if len(h) >= 2:
                pairs = mix(h[:-1] * np.uint64(3) + h[1:])
                _, back, count = np.unique(pairs, return_inverse=True, return_counts=True)
                again = np.append(count[back] > 1, False)
                of = places[at[k] : at[k + 1]] // PASSAGE  # the passage where the word begins
                words = np.maximum(np.bincount(of, minlength=n), 1)
                f[:, _KINDS] = np.bincount(of, again, minlength=n) / words
                f[:, _KINDS + 1] = len(count) / len(pairs)
            f[:, _KINDS + 2] = np.minimum(size / np.maximum(part[:, 3] + part[:, 4] + 1, 1), 40) / 10
            f[:, _KINDS + 3] = min(math.log1p(len(data)), 12) / 10
            rows.append(f)
            ends.append(ends[-1] + n)
    return (np.concatenate(rows) if rows else np.zeros((0, FEATURES))), np.array(ends)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(w: dict, x: np.ndarray, at: np.ndarray) -> dict:
    """All values from passages to document logits; ``at``: offsets of the documents, none of them empty."""
    starts, of = at[:-1], np.repeat(np.arange(len(at) - 1), np.diff(at))
    h = np.tanh(x @ w["We"] + w["be"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[of])
    a = e / np.add.reduceat(e, starts)[of]
    z = np.add.reduceat(h * a[:, None], starts)
    return {"of": of, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ w["c"] + w["b"]}


def gradient(w: dict, s: dict, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean log loss of labels ``y``, at the values ``s`` that ``forward`` gave."""
    d = (_sigmoid(s["logit"]) - y) / len(y)
    dz = d[:, None] * w["c"]
    da = (s["h"] * dz[s["of"]]).sum(1)
    de = s["a"] * (da - np.add.reduceat(s["a"] * da, at[:-1])[s["of"]])
    dtg = de[:, None] * w["a"]
    dt, dg = dtg * s["g"] * (1 - s["t"] ** 2), dtg * s["t"] * s["g"] * (1 - s["g"])
    dh = s["a"][:, None] * dz[s["of"]] + dt @ w["V"].T + dg @ w["U"].T
    du = dh * (1 - s["h"] ** 2)
    return {"We": x.T @ du, "be": du.sum(0), "V": s["h"].T @ dt, "U": s["h"].T @ dg, "a": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ d, "b": np.array([d.sum()])}


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> dict:
    """Weights by Adam on the log loss of the document labels."""
    r = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    w = {"We": r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "be": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, GATE)), "U": r.normal(0, 0.3, (HIDDEN, GATE)), "a": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
    m, v, step = {k: np.zeros_like(q) for k, q in w.items()}, {k: np.zeros_like(q) for k, q in w.items()}, 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            sizes = at[docs + 1] - at[docs]
            rows = np.repeat(at[docs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            xb, ab = x[rows], np.concatenate(([0], np.cumsum(sizes)))
            s = forward(w, xb, ab)
            grad = gradient(w, s, xb, ab, y[docs])
            step += 1
            for k in w:
                q = grad[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w | {"mean": mean, "scale": scale}


def predict(w: dict, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, attention weights of the passages, offsets)."""
    x, at = describe(texts)
    if len(at) < 2:
        return np.zeros(0), np.zeros(0), at
    s = forward(w, (x - w["mean"]) / w["scale"], at)
    return _sigmoid(s["logit"]), s["a"], at


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, per_class: int = PER_CLASS) -> dict | None:
    """The weights, or None without labelled documents of both classes. Bags are described where their texts are."""

    def run(batches):
        for b in batches:
            x, at = describe(b.column("text"))
            bags = [x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("o"), b.column("y"), pa.array(bags, pa.binary())], ["o", "y", "bag"])

    sample = labelled_sample(docs, labels, "quality", modulus, held, per_class).select(F.xxhash64("doc_id", "text").alias("o"), "y", "text")
    bags = sample.mapInArrow(thrifty(run), "o long, y int, bag binary").toArrow().sort_by("o")  # rows arrive in any order
    y = bags["y"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    parts = [np.frombuffer(x.as_py()).reshape(-1, FEATURES) for x in bags["bag"]]
    w = fit(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), y)
    n = labels.where(F.col("quality").isin(0, 1) & (bucket_of("doc_id", modulus) != held)).agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("all")).first()
    good, bad = max(int(n["good"]), 1), max(int(n["all"]) - int(n["good"]), 1)
    w["b"] = w["b"] + math.log(good / bad) - math.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    return w


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with score double and predicted int."""
    model = train(bounded(docs), labels, modulus, held, per_class)
    if model is None:
        return docs.withColumn("score", F.lit(1.0)).withColumn("predicted", F.lit(1))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            s, _, _ = predict(shared.value, b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(thrifty(run), f"{schema}, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pipeline's stage: documents predicted to be of low quality go; the columns of docs."""
    return added(docs, ("score", "predicted"), lambda x: score(x, labels).where("predicted = 1"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_quality": op9_quality}
ORACLE_SQL: dict[str, str] = {}
