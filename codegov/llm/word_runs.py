"""Periodic runs of words: stretches that repeat themselves at least twice, found diagonal by diagonal.

A pair of equal words i and i - q lies on the diagonal of lag q; consecutive pairs are a match, and a match of m words at
lag q is a stretch of m + q words with period q. Walking word by word, every word's earlier occurrences would lengthen
the matches of their lags; a word that is everywhere has too many of them. So each class of lags (q from L to 2L - 1) is
walked in blocks of L / 2 words: a run's match is at least q words long and holds a whole block, the block's earlier
occurrences at the lags of the class lengthen the active diagonals by a block, and a diagonal that has no next block ends,
is measured to the word at both ends and, if it is long enough, emitted at once. A class looks at no more than about two
pairs a word, so even a text of one repeated word costs n log n. Names of blocks are exact (pairs of names of half blocks).
A stretch has its smallest period where several lags emit it: if it has two, the smaller one divides the larger.

Defined results: a null text has no words and no runs. Rows are independent, so repeated rows and ids, ties and null ids
need no rule; an empty table gives an empty one. Texts may have any length; a text's work is its length times a logarithm.
Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table

#: White space between words (fixed characters of the contract).
SPACES = "\\x20\\x09-\\x0D"
#: Pairs of blocks that are held at once.
PAIRS = 1 << 21


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, sizes = pc.list_flatten(lists), np.asarray(pc.list_value_length(lists)).astype(np.int64)
    full = np.asarray(pc.not_equal(pc.binary_length(words), 0))
    of = np.repeat(np.arange(len(sizes)), sizes)
    return words.filter(pa.array(full)), np.bincount(of[full], minlength=len(sizes)).astype(np.int64)


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A name for each place of ``at``: equal for equal keys; a key that occurs once, and every other place, has a negative name of its own."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    out = -1 - np.arange(n, dtype=np.int64)
    again = counts[names] > 1
    out[at[again]] = names[again]
    return out


def _twice(names: np.ndarray, size: int) -> np.ndarray:
    """The names of blocks of twice the size."""
    n = len(names)
    at = np.flatnonzero((names[: max(0, n - size)] >= 0) & (names[size:] >= 0)) if n > size else np.zeros(0, np.int64)
    return _named(names[at] * n + names[at + size], at, n)


def _diagonals(names: np.ndarray, floor: np.ndarray, size: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, first, last): matches of consecutive blocks, by the blocks' numbers, of lags from ``low`` to 2 * low - 1."""
    n = len(names)
    held = np.flatnonzero(names >= 0)
    keys = np.sort(names[held] * n + held)
    at = np.arange(-(-low // size) * size, n, size)
    at = at[names[at] >= 0]
    first = np.searchsorted(keys, names[at] * n + np.maximum(floor[at], at - 2 * low + 1))
    last = np.searchsorted(keys, names[at] * n + np.maximum(at - low + 1, floor[at]))
    many = np.maximum(last - first, 0)
    parts, ends, k = [], np.cumsum(many), 0
    while k < len(at):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        m = many[k:to]
        i = np.repeat(at[k:to], m)
        earlier = keys[np.repeat(first[k:to] - (np.cumsum(m) - m), m) + np.arange(len(i))] - names[i] * n
        pairs = np.sort((i - earlier) * (n + 1) + i // size)
        new = np.flatnonzero(np.diff(pairs, prepend=-2) != 1)
        parts.append((pairs[new], pairs[np.append(new[1:], len(pairs)) - 1] if len(new) else pairs[:0]))
        k = to
    a, b = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(a)
    a, b = a[order], b[order]
    new = np.flatnonzero(np.append(True, a[1:] != b[:-1] + 1)[: len(a)])  # a diagonal may go on in the next portion
    a, b = a[new], b[np.append(new[1:], len(b)) - 1] if len(new) else b[:0]
    return a // (n + 1), a % (n + 1), b % (n + 1)


def _further(names: list[np.ndarray], levels: int, at: np.ndarray, lag: np.ndarray, step: int) -> np.ndarray:
    """How many words a match goes on beyond ``at`` (step 1) or before it (step -1), less than a block of 2 ** levels."""
    n, off = len(names[0]), np.zeros(len(at), np.int64)
    for k in range(levels - 1, -1, -1):
        p = at + off if step == 1 else at - off - (1 << k)
        inside = (p + (1 << k) <= n) & (p - lag >= 0)
        off += (inside & (names[k][np.where(inside, p, 0)] == names[k][np.where(inside, p - lag, 0)]) & (lag > 0)) * (1 << k)
    return off


def find_runs(words: np.ndarray, floor: np.ndarray, longest: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``min_words`` words and two periods, by start and period.

    ``words`` has a number for each word, texts one after the other with a negative number of its own between two;
    ``floor`` has for each place the place where its text begins; the longest text has ``longest`` words.
    """
    n = len(words)
    real = np.flatnonzero(words >= 0)
    names, found, low = [_named(words[real], real, n)], [], 1
    while 2 * low <= longest:
        size = max(1, low // 2)
        if len(names) <= (levels := size.bit_length() - 1):
            names.append(_twice(names[-1], size // 2))
        if not (names[levels] >= 0).any():
            break
        lag, first, last = _diagonals(names[levels], floor, size, low)
        hopeful = (last - first + 1) * size + 2 * (size - 1) >= np.maximum(lag, min_words - lag)
        lag, first, last = lag[hopeful], first[hopeful], last[hopeful]
        begin, end = first * size, (last + 1) * size
        begin, end = begin - _further(names, levels, begin, lag, -1), end + _further(names, levels, end, lag, 1)
        enough = (end - begin >= lag) & (end - begin + lag >= min_words)
        found.append(np.stack([begin - lag, end - begin + lag, lag])[:, enough])
        low *= 2
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    once = np.append(True, (np.diff(start) != 0) | (np.diff(length) != 0))[: len(start)]
    start, length, period = start[once], length[once], period[once]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_of_texts(texts: pa.Array, min_words: int) -> tuple[pa.Array, pa.Array]:
    """For each text its runs, by start and period, and its words without the repetitions, joined by spaces."""
    words, sizes = words_of(texts)
    ends, docs = np.cumsum(sizes), len(sizes)
    begins = ends - sizes
    total = int(ends[-1]) if docs else 0
    place = np.arange(total) + np.repeat(np.arange(docs), sizes)  # a gap after every text
    numbers = np.full(total + docs, -1, np.int64)
    numbers[place] = np.asarray(words.dictionary_encode().indices)
    begun = begins + np.arange(docs)
    floor = np.repeat(begun, sizes + 1)
    start, length, period = find_runs(numbers, floor, int(sizes.max(initial=0)), min_words)
    of = np.searchsorted(begun, start, "right") - 1
    cover = np.zeros(total + docs + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    kept = (np.cumsum(cover)[:-1] == 0)[place]
    left = np.bincount(np.repeat(np.arange(docs), sizes)[kept], minlength=docs)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)), pa.int32()), words.filter(pa.array(kept)))
    rows = pa.StructArray.from_arrays([pa.array(x) for x in (start - begun[of], length, period)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=docs))), pa.int32()), rows), pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def word_runs(docs: DataFrame, min_words: int = 12) -> DataFrame:
    """(doc_id, runs, collapsed) for every row of (doc_id, text): the runs, and the text with each run cut to one period."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            runs, collapsed = runs_of_texts(b.column("text"), min_words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), runs, collapsed.cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return bounded(docs.select("doc_id", "text")).mapInArrow(work, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten, by crc32 of its id, the words from a place on repeat the first ones from there."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[^{SPACES}]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    x = docs.select("doc_id", "text", h.alias("h"), F.when(chosen, words).alias("words"))
    x = x.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    x = x.withColumn("rest", F.col("n") - F.col("a")).withColumn("p", (1 + F.floor(F.col("rest") / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(F.col("rest") / F.col("p")).cast("int")))
    tail = F.slice(again, F.lit(1), F.col("rest"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return x.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def report(found: DataFrame) -> DataFrame:
    """The longest run of each row (the first of the smallest period among equals) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    x = found.withColumn("best", best)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return x.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), _digest(lines).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(word_runs(repeat_tails(table(spark, sf_dir, "documents")), min_words=12))


#: SQL of the unsigned crc32 of an id's decimal text, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, c: list_reduce(list_value(xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""
_ORACLE = rf"""
WITH plain AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32} AS h FROM documents
), places AS (
  SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM plain
), lags AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM places
), texts AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM lags
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts
), pairs AS (
  SELECT x.doc_id, x.i, x.i - y.i AS lag FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i
), matches AS (
  SELECT doc_id, lag, min(i) AS first, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM pairs) GROUP BY doc_id, lag, island
), runs AS (
  SELECT doc_id, first - lag AS start, m + lag AS length, min(lag) AS period FROM matches WHERE m >= lag AND m + lag >= 12 GROUP BY doc_id, first - lag, m + lag
), best AS (
  SELECT doc_id, count(*) AS n_runs, arg_max({{'s': start, 'l': length, 'p': period}}, {{'l': length, 's': -start, 'p': -period}}) AS b,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.p::BIGINT AS period, ((1000 * b.l) // b.p)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_word_runs": op11_word_runs}
ORACLE_SQL: dict[str, str] = {"op11_word_runs": _ORACLE}
