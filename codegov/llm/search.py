"""Exact BM25 top-k search: an inverted index per shard, block-max WAND pruning, merged exactly.

Documents are indexed in shards of a bounded number of documents and postings, written to the shared folder. Global
statistics (documents, mean length, document frequency of every query term) are sums over all shards, so scores of
different shards compare. Queries go through all shards in blocks of a bounded number of terms; each shard returns its
k best per query, and the k best of those are the answer.

Within a shard, documents are ordered by their commonest term and length, so that neighbours are alike, and are cut
into blocks of BLOCK. Terms that one document in COMMON has are common: they have the largest impact of their postings
in each block. For a query, the lists of its other terms, which are short, are read in full, and the common terms' maxima
bound what is missing of a block's scores. Only blocks whose bound reaches the k-th best score known so far are pivots:
their postings of the common terms are read, and documents that still reach that score are scored in full from their own
postings. All other blocks are skipped with all their common postings. The blocks of largest bounds come first and raise the
threshold for the rest; a first pass over one shard in FIRST gives every query a threshold for the other shards, and a
task carries its own from shard to shard.

Bounds and thresholds between them have room for rounding (SLACK), comparisons of final scores are kept on equality, and
a document's contributions are always summed in the order of its terms' hashes, so pruning never changes the result, equal
documents have equal scores in whatever shard they are, and ties go to the smaller doc_id.

Words are runs of characters other than ASCII white space, A-Z lower-cased. A query is a document's whole text; it finds
itself as well. Defined results: a null or empty text is no query and is found by none, and so is a row with a null
doc_id, which counts in no statistic; documents that share no term with a query are not returned for it. Rows that
repeat a doc_id are separate rows of the index; of the queries, equal rows are one, and other rows of one id are
queries of their own, each with its k rows in the result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, table
from .texthash import word_hashes

K1, B = 1.2, 0.75
SHARD_DOCS, SHARD_POSTINGS = 4096, 4_000_000
#: Documents of a block; one shard in so many gives the first thresholds; blocks that are scored before the others.
BLOCK, FIRST, LEAD = 4, 8, 16
#: Terms that one document in so many has are common, at most so many of a shard (four bytes each for every document).
COMMON, COMMON_TERMS = 8, 1024
#: Bounds are sums of at most COMMON_TERMS products in single precision, which err by 2**-24 of the sum a product.
SLACK = 1e-4
#: Query terms that go through the shards at once, about (a bounded broadcast of 16 bytes each).
TERMS_AT_ONCE = 1_500_000


def _smallest(x: np.ndarray) -> np.ndarray:
    """Counts as unsigned integers of 16 bits where they fit, else of 32."""
    return x.astype("<u2" if x.max(initial=0) < 1 << 16 else "<u4")


def _index(batches):
    """One row per shard: terms, offsets, local documents, frequencies; ids and lengths of its documents."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 24
    ids, lengths, top, terms, tfs, size = [], [], [], [], [], 0

    def flush():
        order = np.lexsort((np.array(ids), np.array(lengths), np.array(top, np.uint64)))
        of = np.repeat(np.arange(len(order)), [len(terms[i]) for i in order])
        t, f = np.concatenate([terms[i] for i in order]), np.concatenate([tfs[i] for i in order])
        by = np.argsort(t, kind="stable")
        t, of, f = t[by], of[by], f[by]
        keys, starts = np.unique(t, return_index=True)
        f = _smallest(f)
        parts = [keys.astype("<u8"), np.append(starts, len(t)).astype("<i8"), of.astype("<u2"), f, np.array(ids, "<i8")[order], np.array(lengths, "<i8")[order]]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([f.dtype.itemsize], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["shard", "width", "terms", "starts", "docs", "tf", "ids", "lengths"])

    for b in batches:
        names = b.column("doc_id").to_pylist()
        for i, hashes, at in word_hashes(b.column("text")):
            for k in range(len(at) - 1):
                h = hashes[at[k] : at[k + 1]]
                if not len(h) or names[i + k] is None:
                    continue
                t, f = np.unique(h, return_counts=True)
                ids.append(names[i + k])
                lengths.append(len(h))
                top.append(t[f.argmax()])
                terms.append(t)
                tfs.append(f)
                size += len(t)
                if len(ids) >= SHARD_DOCS or size >= SHARD_POSTINGS:
                    yield flush()
                    shard += 1
                    ids, lengths, top, terms, tfs, size = [], [], [], [], [], 0
    if ids:
        yield flush()


def _frequencies(batches):
    for b in batches:
        for terms, starts in zip(b.column("terms"), b.column("starts"), strict=True):
            n = np.diff(np.frombuffer(starts.as_py(), "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_py(), "<u8").view("<i8")), pa.array(n)], ["term", "df"])


def _lengths(batches):
    for b in batches:
        words = [int(np.frombuffer(x.as_py(), "<i8").sum()) for x in b.column("lengths")]
        yield pa.RecordBatch.from_arrays([pa.array([len(x.as_py()) // 8 for x in b.column("ids")], pa.int64()), pa.array(words, pa.int64())], ["n", "words"])


def _queries(batches):
    for b in batches:
        names, texts = b.column("doc_id"), b.column("text_hash")
        for i, hashes, at in word_hashes(b.column("text")):
            for k in range(len(at) - 1):
                t, f = np.unique(hashes[at[k] : at[k + 1]], return_counts=True)
                if len(t) and names[i + k].is_valid:
                    same = pa.array(np.zeros(len(t), np.int64))
                    yield pa.RecordBatch.from_arrays([names[i + k : i + k + 1].take(same), texts[i + k : i + k + 1].take(same), pa.array(t.view(np.int64)), pa.array(f.astype(np.int64))], ["query_id", "text_hash", "term", "qtf"])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """A shard's lists as arrays; the commonest terms also have their impacts by document and their maxima by block."""

    def __init__(self, row: dict, mean_length: float):
        kinds = {"terms": "<u8", "starts": "<i8", "docs": "<u2", "tf": f"<u{row['width']}", "ids": "<i8", "lengths": "<i8"}
        self.terms, self.starts, self.docs, tf, self.ids, lengths = (np.frombuffer(row[c], k) for c, k in kinds.items())
        self.impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lengths / mean_length))[self.docs])
        sizes = np.diff(self.starts)
        # each document's own postings, in the order of their terms
        by = np.argsort(self.docs, kind="stable")
        self.own_term, self.own_impact = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by], self.impact[by]
        self.own_at = np.append(0, np.cumsum(np.bincount(self.docs, minlength=len(self.ids))))
        self.weight = np.zeros(len(sizes))  # of the query's terms, while it is scored
        common = np.flatnonzero(sizes * COMMON >= len(self.ids))
        if len(common) > COMMON_TERMS:
            common = common[np.argpartition(-sizes[common], COMMON_TERMS)[:COMMON_TERMS]]
        self.column = np.full(len(sizes), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.blocks = -(-len(self.ids) // BLOCK)
        self.common = np.zeros((len(common), self.blocks, BLOCK), np.float32)
        at = _ranges(self.starts[common], sizes[common])
        self.common.reshape(len(common), -1)[np.repeat(np.arange(len(common)), sizes[common]), self.docs[at]] = self.impact[at]
        self.most = self.common.max(2)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where ``terms`` are in this shard's list; -1 where it has none."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best of this shard, of those that reach ``least``."""
        return self.best_at(self.places(terms), weights, k, least)

    def best_at(self, places: np.ndarray, weights: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """What ``best`` returns, from the places of the query's terms in this shard."""
        here = places >= 0
        at, weights = places[here], weights[here]
        column = self.column[at]
        rare, columns = column < 0, column[column >= 0]
        common = weights[~rare].astype(np.float32)
        starts, sizes = self.starts[at[rare]], self.starts[at[rare] + 1] - self.starts[at[rare]]
        rows = _ranges(starts, sizes)
        partial = np.bincount(self.docs[rows], np.repeat(weights[rare], sizes) * self.impact[rows], minlength=self.blocks * BLOCK).reshape(-1, BLOCK)
        bound = partial.max(1) + np.einsum("i,ij", common, self.most[columns])
        # with the common terms' own impacts in place of the maxima
        closer = lambda blocks: partial[blocks].ravel() + np.einsum("i,ij", common, self.common[columns[:, None], blocks].reshape(len(columns), len(blocks) * BLOCK))
        kth = lambda x: np.partition(x, -k)[-k] * (1 - SLACK) if len(x) >= k else 0.0
        if not least > 0:  # the blocks of largest bounds give a first threshold
            lead = max(LEAD, k)
            least = kth(closer(np.argpartition(-bound, lead)[:lead] if len(bound) > lead else np.arange(len(bound))))
        pivots = np.flatnonzero((bound >= least * (1 - SLACK)) & (bound > 0))
        scores = closer(pivots)
        least = max(least, kth(scores))
        docs = (pivots[:, None] * BLOCK + np.arange(BLOCK)).ravel()[(scores >= least * (1 - SLACK)) & (scores > 0)]
        if not len(docs):
            return self.ids[docs], np.zeros(0)
        scores = self._scored(docs, at, weights)
        docs, scores = docs[scores >= least], scores[scores >= least]
        if len(docs) > k:
            order = np.lexsort((self.ids[docs], -scores))[:k]
            docs, scores = docs[order], scores[order]
        return self.ids[docs], scores

    def _scored(self, docs: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of documents, summed in the order of their terms."""
        sizes = self.own_at[docs + 1] - self.own_at[docs]
        rows = _ranges(self.own_at[docs], sizes)
        self.weight[at] = weights
        scores = np.bincount(np.repeat(np.arange(len(docs)), sizes), self.weight[self.own_term[rows]] * self.own_impact[rows], minlength=len(docs))
        self.weight[at] = 0
        return scores


def _searcher(shared, mean: float, k: int):
    def run(batches):
        number, hashes, starts, terms, weights, least = shared.value
        least = least.copy()
        asked, which = np.unique(terms, return_inverse=True)
        seen = [np.zeros(0)] * len(number)  # the best scores of this task's shards so far
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row, mean)
                place = s.places(asked)
                q, d, v = [], [], []
                for i, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                    docs, scores = s.best_at(place[which[lo:hi]], weights[lo:hi], k, least[i])
                    if len(docs):
                        q.append(np.full(len(docs), i))
                        d.append(docs)
                        v.append(scores)
                        seen[i] = np.sort(np.concatenate([seen[i], scores]))[-k:]
                        if len(seen[i]) == k:
                            least[i] = max(least[i], seen[i][0])
                if q:
                    of = np.concatenate(q)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number[of], hashes[of], np.concatenate(d), np.concatenate(v))], ["query_id", "text_hash", "doc_id", "score"])
                del s  # two shards needn't be held at once

    return run


def _through(shards: DataFrame, block: DataFrame, least: DataFrame | None, mean: float, k: int) -> DataFrame:
    """The k best of each shard for a block of queries, which goes to the tasks as one bounded broadcast."""
    if least is not None:
        block = block.join(least, ["query_id", "text_hash"], "left")
    else:
        block = block.withColumn("least", F.lit(0.0))
    t = block.orderBy("query_id", "text_hash").toArrow().combine_chunks()
    lists = pa.concat_arrays(t["t"].chunks or [pa.array([], t.schema.field("t").type)])
    starts, of = np.cumsum([0, *lists.value_lengths().to_pylist()]), lists.flatten()
    least_of = np.nan_to_num(t["least"].to_numpy().astype(float))
    shared = shards.sparkSession.sparkContext.broadcast((t["query_id"].to_numpy(), t["text_hash"].to_numpy(), starts, of.field("term").to_numpy().view(np.uint64), of.field("weight").to_numpy(), least_of))
    found = cut(shards.mapInArrow(_searcher(shared, mean, k), "query_id long, text_hash long, doc_id long, score double"))
    shared.destroy()
    return found


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best rows of ``docs`` for every row of ``queries`` (doc_id, text)."""
    plain = lambda x: x.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blob = ", ".join(f"{c} binary" for c in ("terms", "starts", "docs", "tf", "ids", "lengths"))
    shards = cut(plain(bounded(docs)).mapInArrow(_index, f"shard long, width int, {blob}"))
    sums = shards.mapInArrow(_lengths, "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    number, mean = sums["n"] or 0, (sums["words"] or 0) / max(sums["n"] or 0, 1)
    asked = plain(queries).withColumn("text_hash", F.xxhash64("text")).mapInArrow(_queries, "query_id long, text_hash long, term long, qtf long")
    asked = cut(asked.groupBy("query_id", "text_hash", "term").agg(F.max("qtf").alias("qtf")))
    # a term is one row before it meets the queries: a row for each shard that has it would be terms times shards
    df = shards.mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(float(number)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # in the order of unsigned hashes, as in the index
    weighted = asked.join(df, "term").select("query_id", "text_hash", (F.col("term").bitwiseXOR(F.lit(-(1 << 63)))).alias("u"), "term", (F.col("qtf") * idf).alias("weight"))
    weighted = weighted.groupBy("query_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("u", "term", "weight"))).alias("t"))
    weighted = cut(weighted.withColumn("t", F.transform("t", lambda x: F.struct(x["term"].alias("term"), x["weight"].alias("weight")))))
    terms = weighted.agg(F.sum(F.size("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-terms // TERMS_AT_ONCE))
    first = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    best = Window.partitionBy("query_id", "text_hash").orderBy(F.col("score").desc(), "doc_id")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found: DataFrame | None = None
    for block in range(blocks):
        part = weighted.where(F.pmod(F.xxhash64("query_id", "text_hash"), F.lit(blocks)) == block)
        early = _through(shards.where(first), part, None, mean, k)
        least = ranked(early).where(F.col("rank") == k).select("query_id", "text_hash", F.col("score").alias("least"))
        both = early.unionByName(_through(shards.where(~first), part, least, mean, k))
        found = both if found is None else found.unionByName(both)
    return ranked(found).select("query_id", "rank", "doc_id", "score")


def op4_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every document whose id is divisible by 100; all documents are searched."""
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where(F.col("doc_id") % 100 == 0), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_bm25_search": op4_bm25_search}
ORACLE_SQL: dict[str, str] = {}
