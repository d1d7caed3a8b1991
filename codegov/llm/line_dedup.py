"""Line dedup on hashes alone; DataFrame functions only.

Every document's lines become (hash, doc_id, position) rows once: 16 bytes of hash instead of the text. They are range
partitioned by hash and a salt of the document, and sorted within by document (largest first) and position; a window
over that order streams the first occurrence of a line in each document, so the documents of a line are counted exactly.
The salt spreads a line that most documents hold; its parts meet as one row each. Repeated lines then give every row a
compressed bitmap: only the 63-line words that lose a line are stored. Text never moves for the counting; it meets its
bitmap once, by doc_id and a hash of the text, when the kept text is written.

Defined results: a null or empty text is one empty line. Rows that repeat a doc_id are one document when documents are
counted; each row is returned and loses only its own lines, whether the rows have one text or several. A null doc_id
counts as no document: its row comes back as it is. Extra columns pass through ``dedup_lines`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Lines are stripped of these (fixed values of the contract); A-Z is lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
#: Parts that the rows of one line are dealt to.
SALTS = 64
#: Lines per bitmap word.
WORD = 63


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _stripped(line: Column) -> Column:
    blank = reduce(or_, [x for b in BLANKS for x in (F.startswith(line, F.lit(b)), F.endswith(line, F.lit(b)))])
    return F.when(blank, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def _key(line: Column) -> Column:
    """A text that is equal for two lines if and only if they are equal with A-Z lower-cased.

    ``lower`` also changes letters beyond ASCII, and ``translate`` is slow. Read as one character a byte, a line's A-Z
    are lower-cased as they should be; of the other bytes only the first ones of two-byte characters change, to first
    bytes of longer ones, and the number of bytes that follow still tells the two apart.
    """
    bytewise = F.lower(F.decode(F.encode(line, "UTF-8"), "ISO-8859-1"))
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(bytewise)


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, dropped): the rows that lose lines; dropped has (word, bits) of the words with a lost line."""
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.where(F.octet_length("line") >= min_chars).select("doc_id", "text_hash", "pos", _stripped(F.col("line")).alias("line")).where(F.length("line") >= min_chars)
    rows = rows.withColumn("key", _key(F.col("line"))).select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    rows = cut(rows).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("h1", "h2", "salt", "doc_id", "pos").repartitionByRange(parts, "h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").desc(), "pos")
    first = dealt.withColumn("before", F.lag("doc_id").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("doc_id")))
    part = first.groupBy("h1", "h2", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    line = Window.partitionBy("h1", "h2")  # at most SALTS rows
    repeated = part.select("h1", "h2", "salt", F.sum("n").over(line).alias("n"), F.max("keeper").over(line).alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    lost = rows.join(repeated, ["h1", "h2", "salt"]).where("doc_id != keeper")
    words = lost.groupBy("doc_id", "text_hash", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def _split(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    marks = drop_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).toDF("__id", "__text_hash", "__dropped")
    return docs.join(marks, (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__text_hash")), "left").drop("__id", "__text_hash")


def _kept(lines: Column) -> Column:
    lost = lambda i: F.coalesce(F.element_at("__dropped", F.floor(i / WORD).cast("int")), F.lit(0).cast("long"))
    return F.filter(lines, lambda x, i: F.getbit(lost(i), F.pmod(i, F.lit(WORD)).cast("int")) == 0)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents with their kept text; the columns of docs. A document that loses nothing keeps its text as it is."""
    names = docs.columns
    text = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.array_join(_kept(_lines(F.col("text"))), "\n"))
    out = _split(docs, min_chars, min_docs).withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__dropped").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def line_report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row."""
    x = _split(docs.select("doc_id", "text"), min_chars, min_docs)
    n_dropped = F.aggregate(F.map_values("__dropped"), F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b))
    plain = F.coalesce(F.col("text"), F.lit(""))
    kept = F.when(F.col("__dropped").isNull(), plain).otherwise(F.array_join(_kept(_lines(F.col("text"))), "\n"))
    return x.select(
        "doc_id",
        (F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)


_ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), many AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (m.k IS NOT NULL AND l.doc_id <> m.keeper) AS dropped FROM lines l LEFT JOIN many m ON l.k = m.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(CASE WHEN dropped THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_line_dedup": op3_line_dedup}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": _ORACLE}
