"""Embedding near-dedup by collision-counting projections.

Every unit vector has M one-dimensional Gaussian projections. Two vectors collide in one where their values differ by
at most a window, which is centred on the query. Vectors at the least similarity that links differ by a normal value of
known deviation, so the chance of a collision and with it the count that a wanted share of such pairs reaches are
known; pairs that reach this count are verified by their cosine in double precision.

Counting a pair in all M sorted projections would first make all pairs that collide in any one of them. A pair that
reaches the count misses at most M - count of them, so of M - count + 1 tables, each of several projections of its own,
it collides in all projections of at least one: with 80 projections, 11 tables of 7, which bring together about 0.03 % of
random pairs. A table deals a label's vectors to cells a few windows wide by its first GRID projections; a vector goes to
its cell, and as a visitor to the smaller neighbours within a window. Each cell is sorted by its first projection, every
vector looks up its window there, and the pairs that collide in the table's other projections too are counted over all
M. That is every pair whose count suffices, none left out; it counts in the first table that brings it together.

Cells of more than BLOCK vectors are split into pairs of chunks, so no task holds an unbounded group, and no pair
leaves a task: blocks return each vector's number of links and one local component edge.

Equal vectors are one class with a number of copies, so a group of copies costs one vector.

Defined results: a null label or an invalid vector (null, empty, zero, null or non-finite components) links with
nothing: n_links 0, component_id = vec_id, kept. Vectors of different length are never compared. Rows that repeat a
vec_id, label and vector count once in n_links; rows of one vec_id with other vectors or labels are vectors of their
own. A null vec_id links with nothing. Each row is returned. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, has_rows, table
from .components import components

M = 80
#: Projections of a table that make its cells.
GRID = 3
#: A window in deviations of the projections' difference at the least similarity.
WIDTH = 2.0
#: Cell width in windows; share of the pairs at the least similarity that must reach the count.
CELL, RECALL = 4, 0.999
BLOCK, TILE = 2048, 1 << 17
PLACES = [f"c{k}" for k in range(GRID)]


def calibrate(similarity: float, m: int = M, width: float = WIDTH, recall: float = RECALL) -> tuple[float, int]:
    """(window, least count): at this similarity a share ``recall`` of pairs collides in that many projections."""
    p = math.erf(width / math.sqrt(2))
    tail, need = 0.0, m + 1
    while need > 1 and tail < recall:
        need -= 1
        tail += math.comb(m, need) * p**need * (1 - p) ** (m - need)
    return width * math.sqrt(2 - 2 * similarity), need


def directions(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(97)).standard_normal((dim, M))


def _unit(raw: list[bytes], kind) -> np.ndarray:
    """Vectors of one length as rows of norm 1."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares of very large or small components would leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tables_of(need: int) -> tuple[int, int]:
    """(tables, projections of each): a pair that reaches the count collides in all projections of one table."""
    return M - need + 1, M // (M - need + 1)


def _cells(y: np.ndarray, window: float):
    """(row, cells, home) of one table's projections: the home cell and the smaller neighbours within a window."""
    size = CELL * window
    cell = np.floor(y / size).astype(np.int64)
    beside = {0: np.ones(y.shape, bool), -1: y - cell * size <= window, 1: (cell + 1) * size - y <= window}
    for step in product((-1, 0, 1), repeat=y.shape[1]):
        if step <= (0,) * y.shape[1]:
            i = np.flatnonzero(np.logical_and.reduce([beside[d][:, k] for k, d in enumerate(step)]))
            yield i, cell[i] + np.array(step), np.full(len(i), not any(step))


def _emit(window: float, need: int, kind, vectors: bool):
    tables, per = tables_of(need)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            raw, dims = batch.column("vec").to_pylist(), {}
            for i, v in enumerate(raw):
                dims.setdefault(len(v), []).append(i)
            for _, rows in dims.items():
                unit = _unit([raw[i] for i in rows], kind)
                y, rows = unit @ directions(unit.shape[1]), np.array(rows)
                for g in range(tables):
                    for i, cells, home in _cells(y[:, g * per : g * per + min(GRID, per)], window):
                        cells = np.hstack([cells, np.zeros((len(i), GRID - cells.shape[1]), np.int64)])
                        at = pa.array(rows[i])
                        cols = [batch.column("label").take(at), pa.array(np.full(len(i), unit.shape[1], np.int32)), pa.array(np.full(len(i), g, np.int32)), *(pa.array(c) for c in cells.T), batch.column("cid").take(at)]
                        names = ["label", "dim", "g", *PLACES, "cid"]
                        if vectors:
                            cols += [pa.array(home), batch.column("copies").take(at), batch.column("vec").take(at)]
                            names += ["home", "copies", "vec"]
                        yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _pairs(y: np.ndarray, g: int, window: float, need: int, left: np.ndarray, right: np.ndarray, same: bool):
    """Pairs (left, right) that collide in all projections of table g, in no earlier table, and often enough."""
    _, per = tables_of(need)
    left = left[np.argsort(y[left, g * per], kind="stable")]
    right = right[np.argsort(y[right, g * per], kind="stable")]
    keys = y[right, g * per]
    lo = np.searchsorted(keys, y[left, g * per] - window, "left")
    hi = np.searchsorted(keys, y[left, g * per] + window, "right")
    if same:  # each pair once
        lo = np.maximum(lo, np.arange(len(left)) + 1)
        hi = np.maximum(hi, lo)
    near = lambda i, j, k: np.abs(y[i, k] - y[j, k]) <= window
    ends, start = np.cumsum(hi - lo), 0
    while start < len(left):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TILE)))
        n = hi[start:stop] - lo[start:stop]
        i = np.repeat(left[start:stop], n)
        j = right[np.repeat(lo[start:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        start = stop
        for k in range(g * per + 1, g * per + per):
            ok = near(i, j, k)
            i, j = i[ok], j[ok]
        missed = np.zeros(len(i), np.int16)
        for low in range(0, M, 8):
            missed += (np.abs(y[i, low : low + 8] - y[j, low : low + 8]) > window).sum(1).astype(np.int16)
            ok = missed <= M - need
            i, j, missed = i[ok], j[ok], missed[ok]
        for h in range(g):
            new = ~np.logical_and.reduce([near(i, j, k) for k in range(h * per, h * per + per)])
            i, j = i[new], j[new]
        yield i, j


def _roots(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row of each row's local component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for i, j in edges:
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def _block(window: float, need: int, similarity: float, kind):
    def run(key, t):
        t = t.take(pa.array(np.argsort(t["cid"].to_numpy(), kind="stable")))
        g, one, two = (int(key[k].as_py()) for k in (1, 3 + GRID, 4 + GRID))
        cid, home, copies, chunk = (t[c].to_numpy(zero_copy_only=False) for c in ("cid", "home", "copies", "chunk"))
        unit = _unit(t["vec"].to_pylist(), kind)
        y = unit @ directions(unit.shape[1])
        links, edges = np.zeros(len(cid), np.int64), []
        rows = np.arange(len(cid))
        if one == two:
            sides = [(rows[home], rows[home], True), (rows[home], rows[~home], False)]
        else:
            a, b = chunk == one, chunk == two
            sides = [(rows[a & home], rows[b], False), (rows[a & ~home], rows[b & home], False)]
        for left, right, same in sides:
            if len(left) and len(right):
                for i, j in _pairs(y, g, window, need, left, right, same):
                    ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= similarity
                    i, j = i[ok], j[ok]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    edges.append((i, j))
        linked = np.flatnonzero(links)
        return pa.table({"cid": cid[linked], "links": links[linked], "root": cid[_roots(len(cid), edges)[linked]]})

    return run


def near_vectors(vectors: DataFrame, similarity: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    kind = np.dtype("<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8")
    window, need = calibrate(similarity)

    def valid(batches):
        for b in batches:
            out = []
            for v in b.column("embedding").to_pylist():
                x = None if not v or None in v else np.array(v, np.float64)
                out.append(x.astype(kind).tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), b.column("label").cast(pa.int64()), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    rows = vectors.select("vec_id", "label", "embedding").mapInArrow(valid, "vec_id long, label long, vec binary")
    rows = rows.select("vec_id", F.when(F.col("vec").isNotNull() & F.col("vec_id").isNotNull(), F.col("label")).alias("label"), "vec").withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    good = rows.where(F.col("label").isNotNull()).dropDuplicates(["vec_id", "label", "h1", "h2"])
    classes = good.groupBy("label", "h1", "h2").agg(F.min(F.struct("vec_id", "vec")).alias("r"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.select("label", "h1", "h2", F.monotonically_increasing_id().alias("cid"), F.col("r.vec_id").alias("first"), F.col("r.vec").alias("vec"), "copies"))
    reps = classes.select("label", "cid", "copies", "vec")

    cell = "label long, dim int, g int, " + ", ".join(f"{c} long" for c in PLACES) + ", cid long"
    names = ["label", "dim", "g", *PLACES]
    sizes = reps.mapInArrow(_emit(window, need, kind, False), cell).groupBy(*names).count()
    sizes = sizes.select(*names, F.ceil(F.col("count") / BLOCK).cast("int").alias("chunks"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    dealt = reps.mapInArrow(_emit(window, need, kind, True), f"{cell}, home boolean, copies long, vec binary").withColumn("salt", F.pmod(F.xxhash64("cid", F.lit("salt")), F.lit(16)).cast("int"))
    dealt = dealt.join(sizes, [*names, "salt"]).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("one", F.least("chunk", "other")).withColumn("two", F.greatest("chunk", "other"))
    blocks = dealt.select("dim", "g", "label", *PLACES, "one", "two", "cid", "home", "copies", "chunk", "vec")
    found = cut(blocks.groupBy("dim", "g", "label", *PLACES, "one", "two").applyInArrow(_block(window, need, similarity, kind), "cid long, links long, root long"))

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("label", "h1", "h2", "cid", "first", "copies").join(links, "cid", "left")
    if has_rows(found):
        named = named.join(components(found, "cid", "root").toDF("cid", "group"), "cid", "left")
        low = named.where("group is not null").groupBy("group").agg(F.min("first").alias("low"))
        named = named.join(low, "group", "left")
    else:
        named = named.withColumn("low", F.lit(None).cast("long"))
    named = named.select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("low", "first").alias("low"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    # a class with very many copies is one join key: both sides are dealt by (key, salt)
    slim = rows.select("vec_id", "label", "h1", "h2").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int"))
    out = slim.join(named, ["label", "h1", "h2", "salt"], "left").withColumn("component_id", F.coalesce("low", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_near_vectors": op1_near_vectors}
ORACLE_SQL: dict[str, str] = {}
