"""Language identification by rank-order profiles of character n-grams.

A profile has the most frequent n-grams of a language in order. A document's most frequent n-grams are put in order too,
and its distance to a profile is the sum of the places by which its n-grams are out; the nearest profile's language is
predicted. Profiles are learned from every document that may teach: tasks count n-grams over a batch's distinct words and
Spark adds them up by language and n-gram. A profile has a fixed number of n-grams, so what the driver collects and
ships with the tasks is ``size`` rows a language.

Words are runs of letters and marks from a letter on, lower-cased, with a blank at both ends; n-grams are one to three characters long.
An n-gram is one 63-bit number, three code points of 21 bits, so n-grams need no dictionary between tasks.

Defined results: n-grams of one count in a document share their mean rank, and a profile's ties go to the shorter and then
smaller n-gram, so no order of rows decides anything. Distances that are equal give the language that comes first. A null
text or one without a letter is ``und`` with score 0, and so is every text where nothing was learned; a null language, a
null text and a text without letters teach nothing. Null ids are not held out. Repeated rows teach as often as they
occur. An empty table gives an empty one. Whole texts count, whatever their length. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, bucket_of, table
from .word_runs import CRC32, words_of

#: N-grams of a profile, and of a document up to the ties of the last.
SIZE = 400
#: More languages than this are an error: the column doesn't hold languages.
LANGUAGES = 5_000
#: Cells of documents x n-grams that are counted at once.
CELLS = 1 << 22
UNKNOWN = "und"


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, and the number of words of each."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()))
    return words_of(pc.replace_substring_regex(lower, r"^\p{M}+|[^\p{L}\p{M}]+\p{M}*", " "))


def grams_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, n-gram): the number of its word and the code of each n-gram of each word."""
    marked = np.frombuffer(("\0" + "".join(f" {w} \0" for w in words.to_pylist())).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = marked == 0
    word = np.cumsum(ends) - 1
    one = np.flatnonzero(~ends & (marked != 0x20))
    two = np.flatnonzero(~ends[:-1] & ~ends[1:])
    three = np.flatnonzero(~ends[:-2] & ~ends[1:-1] & ~ends[2:]) if len(marked) > 2 else one[:0]
    codes = [marked[one], marked[two] << 21 | marked[two + 1], marked[three] << 42 | marked[three + 1] << 21 | marked[three + 2]]
    return np.concatenate([word[one], word[two], word[three]]), np.concatenate(codes)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all (lang, text)."""
    def work(batches):
        for b in batches:
            words, sizes = letter_words(b.column("text"))
            langs, spoken = b.column("lang").dictionary_encode(), words.dictionary_encode()
            pairs = np.repeat(np.asarray(langs.indices).astype(np.int64), sizes) * max(1, len(spoken.dictionary)) + np.asarray(spoken.indices)
            pairs, times = np.unique(pairs, return_counts=True)
            word, code = grams_of(spoken.dictionary)
            code, gram = np.unique(code, return_inverse=True)
            order = np.argsort(word, kind="stable")
            first, many = np.searchsorted(word[order], np.arange(len(spoken.dictionary))), np.bincount(word, minlength=len(spoken.dictionary))
            lang, word = pairs // max(1, len(spoken.dictionary)), pairs % max(1, len(spoken.dictionary))
            for k in range(len(langs.dictionary)):
                mine = lang == k
                m = many[word[mine]]
                at = np.repeat(first[word[mine]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                n = np.bincount(gram[order][at], weights=np.repeat(times[mine], m), minlength=len(code)).astype(np.int64)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.repeat(langs.dictionary[k], len(some)), pa.array(code[some]), pa.array(n[some])], ["lang", "gram", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return bounded(rows).mapInArrow(work, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(lang, gram, rank): the ``size`` most frequent n-grams of each language, from rank 1."""
    order = (F.col("n").desc(), "gram")
    few = gram_counts(docs).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= size)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= size).select("lang", "gram", "rank")


def distances(texts: pa.Array, grams: np.ndarray, ranks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counted): each text's out-of-place sum to each language, and its number of n-grams.

    ``grams``: codes in order; ``ranks``: their rank in each language, 0 where a language's profile lacks them.
    """
    words, sizes = letter_words(texts)
    spoken = words.dictionary_encode()
    n_words, docs = len(spoken.dictionary), len(sizes)
    word, code = grams_of(spoken.dictionary)
    code, gram = np.unique(code, return_inverse=True)
    order = np.argsort(word, kind="stable")
    gram, many = gram[order], np.bincount(word, minlength=n_words)
    first = np.cumsum(many) - many
    known = np.zeros((len(code), ranks.shape[1]), np.int64)
    if len(grams):
        at = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
        known[grams[at] == code] = ranks[at[grams[at] == code]]
    sums, counted = np.zeros((docs, ranks.shape[1])), np.zeros(docs, np.int64)
    said, begins = np.asarray(spoken.indices).astype(np.int64), np.append(0, np.cumsum(sizes))
    step = max(1, CELLS // max(1, len(code)))
    for a in range(0, docs, step):
        b = min(docs, a + step)
        pairs = np.repeat(np.arange(b - a), sizes[a:b]) * max(1, n_words) + said[begins[a] : begins[b]]
        pairs, times = np.unique(pairs, return_counts=True)
        doc, spoke = pairs // max(1, n_words), pairs % max(1, n_words)
        m = many[spoke]
        cells = np.repeat(doc * len(code), m) + gram[np.repeat(first[spoke] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        table_ = np.bincount(cells, weights=np.repeat(times, m), minlength=(b - a) * len(code)).astype(np.int64)
        some = np.flatnonzero(table_)
        if not len(some):
            continue
        doc, which, n = some // len(code), some % len(code), table_[some]
        by = np.lexsort((-n, doc))
        doc, which, n = doc[by], which[by], n[by]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (n[1:] != n[:-1])))  # ties
        tied = np.diff(np.append(new, len(doc)))
        above = np.repeat(new, tied) - np.searchsorted(doc, doc)
        mean = above + 1 + (np.repeat(tied, tied) - 1) / 2
        top = above < size
        doc, which, mean = doc[top], which[top], mean[top]
        counted[a:b] = np.bincount(doc, minlength=b - a)
        for k in range(ranks.shape[1]):
            rank = known[which, k]
            out = np.where(rank > 0, np.minimum(np.abs(mean - rank), size), size)
            sums[a:b, k] = np.bincount(doc, weights=out, minlength=b - a)
    return sums, counted


def predict(docs: DataFrame, learned: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, lang_pred, score): the score is how much nearer the best language is than the second, 0 to 1; 1 if there is one only."""
    rows = learned.groupBy("lang").agg(F.collect_list(F.struct("gram", "rank")).alias("grams")).limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError("lang has more values than there are languages")
    langs = sorted(r["lang"] for r in rows)
    grams = np.unique(np.array([g["gram"] for r in rows for g in r["grams"]], np.int64))
    ranks = np.zeros((len(grams), len(langs)), np.int64)
    for r in rows:
        ranks[np.searchsorted(grams, [g["gram"] for g in r["grams"]]), langs.index(r["lang"])] = [g["rank"] for g in r["grams"]]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            sums, counted = distances(b.column("text"), grams, ranks, size)
            told = (counted > 0) & bool(langs)
            best = sums.argmin(1) if langs else np.zeros(len(sums), int)
            order = np.sort(sums, 1)
            second = order[:, 1] if len(langs) > 1 else np.ones(len(sums))
            first = order[:, 0] if len(langs) > 1 else np.zeros(len(sums))
            score = np.where(told & (second > 0), 1 - first / np.where(second > 0, second, 1), 0.0)
            names = pa.array([langs[k] if t else UNKNOWN for k, t in zip(best.tolist(), told.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), names, pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return bounded(docs.select("doc_id", "text")).mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False))
    learned = profiles(docs.where(~held_out).select("lang", "text"))
    return predict(docs, learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


_ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, lang, {CRC32} % 5 = 0 AS held_out, regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}[\p{{L}}\p{{M}}]*') AS words FROM documents
), spoken AS (
  SELECT doc_id, ' ' || word || ' ' AS w, count(*) AS times FROM (SELECT doc_id, unnest(words) AS word FROM docs) GROUP BY doc_id, word
), grams AS (
  SELECT doc_id, gram, sum(times) AS n FROM (
    SELECT doc_id, times, unnest(list_filter(list_concat(string_split(w, ''), list_transform(range(1, length(w)), lambda i: w[i:i + 1]), list_transform(range(1, length(w) - 1), lambda i: w[i:i + 2])), lambda g: g <> ' ')) AS gram FROM spoken)
  GROUP BY doc_id, gram
), profile AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(gram), gram) AS rank
  FROM (SELECT lang, gram, sum(n) AS n FROM grams JOIN docs USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram) QUALIFY rank <= {SIZE}
), ranked AS (
  SELECT doc_id, gram, above + 1 + (count(*) OVER (PARTITION BY doc_id, n) - 1) / 2.0::DOUBLE AS mean, above
  FROM (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY n DESC) - 1 AS above FROM grams)
), sums AS (
  SELECT doc_id, l.lang, sum(CASE WHEN rank IS NULL THEN {SIZE} ELSE least(abs(mean - rank), {SIZE}) END) AS s
  FROM ranked CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.gram = ranked.gram WHERE above < {SIZE} GROUP BY doc_id, l.lang
), best AS (
  SELECT doc_id, list(lang ORDER BY s, lang) AS langs, list(s ORDER BY s, lang) AS s FROM sums GROUP BY doc_id
)
SELECT doc_id, held_out, coalesce(langs[1], '{UNKNOWN}') AS lang_pred,
       CASE WHEN langs IS NULL THEN 0.0 WHEN len(langs) = 1 THEN 1.0 WHEN s[2] > 0 THEN 1 - s[1] / s[2] ELSE 0.0 END::DOUBLE AS score
FROM docs LEFT JOIN best USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_language": op13_language}
ORACLE_SQL: dict[str, str] = {"op13_language": _ORACLE}
