"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks in order. A block's features are the tags and class words around it, its own tag and the
form of its text; the chain's weights join neighbouring labels. The field is trained by maximum likelihood (forward and
backward sums, gradient steps) on labelled pages, and each page is decoded by Viterbi. The article's blocks are the
text, joined by empty lines.

Defined results: a null or empty page, or one without an article, has an empty text. Rows that repeat are all
returned, each with its own text, and so are rows with a null id; blocks whose labels tie are not text. Pages of any
length are read whole, in time proportional to their length, and tags that nothing closes or opens are tolerated. An empty
table gives an empty one; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, table
from .html_blocks import Block, blocks, features
from .html_training import labelled_pages

#: Generated pages that the field is trained on.
PAGES = 800


class Field:
    """Weights: per feature the score of label 1 over label 0; start and transition scores of the two labels."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, step: np.ndarray):
        self.weights, self.start, self.step = weights, start, step
        #: The names and words around a block that the field has learned something about.
        self.known = frozenset(f[3:] for f in weights if f.startswith("in ")) | {"<article", "<main"}

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The labels of highest total score."""
        if not rows:
            return []
        get = self.weights.get
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.start.tolist()
        back: list[tuple[int, int]] = []
        for k, row in enumerate(rows):
            e = sum(get(f, 0.0) for f in row)
            if k:
                from0, from1 = (0, a + s00) if a + s00 >= b + s10 else (1, b + s10), (0, a + s01) if a + s01 >= b + s11 else (1, b + s11)
                back.append((from0[0], from1[0]))
                a, b = from0[1], from1[1]
            b += e
        label = int(b > a)
        out = [label]
        for came in reversed(back):
            label = came[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 80, rate: float = 0.15, ridge: float = 0.02) -> Field:
    """Maximum likelihood with a ridge, by Adam over all pages at once; chains are padded to one length."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in row] for row in features(b)] for b, _ in pages]
    n, t = len(pages), max(len(r) for r in rows)
    size = np.array([len(r) for r in rows])
    live = np.arange(t)[None, :] < size[:, None]
    y = np.zeros((n, t), int)
    for i, (_, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
    at = np.array([i * t + k for i, r in enumerate(rows) for k, row in enumerate(r) for _ in row])
    of = np.array([f for r in rows for row in r for f in row])
    w = np.zeros(len(names) + 2 + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for epoch in range(1, epochs + 1):
        start, step = w[len(names) : len(names) + 2], w[len(names) + 2 :].reshape(2, 2)
        e = np.zeros((n, t, 2))
        e[:, :, 1] = np.bincount(at, w[of], minlength=n * t).reshape(n, t)
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = start + e[:, 0]
        for k in range(1, t):
            new = e[:, k] + np.logaddexp(alpha[:, k - 1, 0, None] + step[0], alpha[:, k - 1, 1, None] + step[1])
            alpha[:, k] = np.where(live[:, k, None], new, alpha[:, k - 1])
        for k in range(t - 2, -1, -1):
            x = beta[:, k + 1] + e[:, k + 1]
            new = np.logaddexp(x[:, 0, None] + step[:, 0], x[:, 1, None] + step[:, 1])
            beta[:, k] = np.where(live[:, k + 1, None], new, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        g = np.zeros_like(w)
        g[: len(names)] = np.bincount(of, (p[:, :, 1] - y * live).ravel()[at], minlength=len(names))
        first = np.eye(2)[y[:, 0]]
        g[len(names) : len(names) + 2] = (p[:, 0] - first).sum(0)
        pair = live[:, 1:]
        joint = np.exp(alpha[:, :-1, :, None] + step + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        g[len(names) + 2 :] = (joint.sum((0, 1)) - seen).ravel()
        g = g / n + ridge * w / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return Field({f: float(w[k]) for f, k in names.items()}, w[len(names) : len(names) + 2], w[len(names) + 2 :].reshape(2, 2))


@lru_cache(maxsize=1)
def trained(pages: int = PAGES) -> Field:
    return fit(labelled_pages(pages))


def main_text(field: Field, page: str | None) -> str:
    found = blocks(page or "", field.known)
    return "\n\n".join(b.text for b, label in zip(found, field.decode(features(found)), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches):
        for b in batches:
            texts = [main_text(shared.value, p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return bounded(pages).select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_html_text": op2_html_text}
ORACLE_SQL: dict[str, str] = {}
