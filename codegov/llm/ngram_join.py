"""N-gram Jaccard join with adaptive multi-match prefixes.

Every document is a set of word shingles. All shingles get one global order, rare ones first, taken from a hashed
table of shingle counts over all documents (a fixed number of counters, so its size is bounded; any order that is a
function of the shingle alone keeps the join exact). With o the smallest overlap that a document of n shingles can have
with a similar one, two similar documents share at least L of the first n - o + L shingles of either, for every L up to
o. L is chosen per document: a longer prefix costs more postings, but asks for more shared shingles before a pair is
verified. A pair uses the smaller of its two levels.

The job returns components, not all pairs, so it looks for links in this order:

1. Documents with equal sets are one class; only one of them goes on.
2. In a star round each class is verified against a few classes that head its posting lists;
   verified links are contracted into components. A group of thousands of near copies costs a few comparisons per member.
3. Posting lists that still touch several components give every pair across components that shares enough prefix
   shingles and whose sizes and positions allow enough overlap; all of them are verified. This step makes the result exact: no cap, no sampling.

Texts are hashed again where they are needed instead of being stored as sets: eight bytes a shingle would be larger
than the text. For the same reason texts go through a shuffle only where they must: a table of bits that hashed ids mark
(a fixed number, so its size is bounded) tells which rows can be copies of a class's first, or can be in a pair to verify.
A row that it doesn't tell apart goes through the join on ids as well, so it never changes the result.

Defined results: a null or empty text, or one of white space only, has an empty set, n_shingles 0, and links with
nothing (component_id = doc_id). Rows that repeat a doc_id are one document that links if any of its texts does, so its
texts' components are one; each row is returned. A null doc_id links with nothing and returns a null component. Extra
columns are ignored. ``keep_one`` judges rows: of rows with equal texts and ids one stays, and a row whose text links
with no other stays whatever else has its id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, has_rows, table, thrifty
from .components import components
from .texthash import mix, set_key, shingle_sets

#: Counters of the hashed count table (a bounded broadcast of 8 bytes each).
COUNTERS = 1 << 18
#: Words of 64 bits of a table that marks ids (a bounded broadcast of 16 bytes each).
MARKS = 1 << 18
#: Most shared prefix shingles that a document may ask for.
LEVELS = 4
#: Cost of verifying a candidate, in postings.
VERIFY_COST = 25.0
#: Bits of a set's parity sketch, in longs.
SKETCH = 8
SKETCH_COLUMNS = [f"s{k}" for k in range(SKETCH)]
#: Star rounds before the exact step; heads of a posting list in each.
STARS, LIST_HEADS = 1, 4
#: Heads that a class is verified against in a star round, at most.
HEADS = 8


def least_overlap(n, num: int, den: int, floor: Callable | None = None):
    """The smallest overlap of a set of n with any set of similarity num/den or more; ``floor`` for columns."""
    return floor((n * num + den - 1) / den) if floor else (n * num + den - 1) // den


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Bit h of the sketch tells whether an odd number of the set's shingles hash to h.

    Sketches of two sets differ in at most as many bits as the sets differ in shingles, so too many differing bits prove
    that a pair isn't similar, and a similar pair never has them.
    """
    bits = np.bincount((mix(tokens ^ np.uint64(0x632BE59BD9B4E019)) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def _sets(words: int):
    def run(batches):
        for b in batches:
            sizes, keys, sketches = [], [], np.zeros((len(b), SKETCH), np.int64)
            for i, s in enumerate(shingle_sets(b.column("text"), words)):
                sizes.append(len(s))
                keys.append(set_key(s))
                sketches[i] = parity_sketch(s)
            columns = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), *(pa.array(sketches[:, k]) for k in range(SKETCH))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key", *SKETCH_COLUMNS])

    return run


def _counts(words: int, counters: int):
    def run(batches):
        total, held, size = np.zeros(counters, np.int64), [], 0
        for b in batches:
            for s in shingle_sets(b.column("text"), words):
                held.append((mix(s) % np.uint64(counters)).astype(np.int64))
                size += len(s)
                if size > counters:
                    total += np.bincount(np.concatenate(held), minlength=counters)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=counters)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["slot", "n"])

    return run


def level_of(extra: np.ndarray, n: int, overlap: int, documents: int, levels: int = LEVELS, verify: float = VERIFY_COST) -> int:
    """The level whose postings and expected candidates cost least.

    ``extra``: for the ordered shingles, how many other documents are expected to hold each. One shingle is expected to
    be shared with sum(extra) documents; L at once with about sum(extra)**L / (L! documents**(L-1)). Level 2 is the
    least where the set is large enough: it costs one posting and removes nearly all chance candidates.
    """
    best, cost, top = 1, float("inf"), min(levels, overlap)
    for level in range(min(2, top), top + 1):
        expected = float(extra[: n - overlap + level].sum())
        factor = 1.0
        for k in range(1, level + 1):
            factor *= expected / k if k == 1 else expected / (k * max(documents, 1))
        c = n - overlap + level + verify * min(factor, documents)
        if c < cost:
            best, cost = level, c
    return best


def _postings(words: int, num: int, den: int, counts: np.ndarray, documents: int):
    base = np.median(counts)
    noise = 3 * np.sqrt(base + 1)
    slots = np.uint64(len(counts))

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            ids = b.column("doc_id").to_pylist()
            held = 0
            for doc, s in zip(ids, shingle_sets(b.column("text"), words), strict=True):
                if not len(s):
                    continue
                n, o = len(s), int(least_overlap(len(s), num, den))
                c = counts[(mix(s) % slots).astype(np.int64)]
                reach = min(n, n - o + LEVELS)
                if reach < n:
                    head = np.argpartition(c, reach - 1)[:reach]
                    edge = c[head].max()
                    head = np.flatnonzero(c <= edge)
                    head = head[np.lexsort((s[head], c[head]))][:reach]
                else:
                    head = np.lexsort((s, c))
                level = level_of(np.maximum(c[head] - base - noise, 0), n, o, documents)
                head = head[: n - o + level]
                out[0].append(s[head].view(np.int64))
                out[1].append(np.full(len(head), doc, np.int64))
                out[2].append(np.arange(len(head), dtype=np.int32))
                out[3].append(np.full(len(head), n, np.int32))
                out[4].append(np.full(len(head), level, np.int16))
                held += len(head)
                if held > 200_000:
                    yield _batch(out)
                    out, held = [[] for _ in range(5)], 0
            if held:
                yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["token", "doc", "pos", "n", "level"])

    return run


def _verify(words: int, num: int, den: int):
    def run(batches):
        for b in batches:
            keep = np.zeros(len(b), bool)
            left = shingle_sets(b.column("ta"), words)
            right = shingle_sets(b.column("tb"), words)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                small, large = sorted((len(x), len(y)))
                if small and den * small >= num * large:
                    both = small if small == large and np.array_equal(x, y) else len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(keep)], ["a", "b", "linked"])

    return run


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: components of the links with Jaccard >= num/den."""
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = cut(docs.mapInArrow(thrifty(_sets(words)), f"doc_id long, n_shingles long, key binary, {', '.join(f'{c} long' for c in SKETCH_COLUMNS)}"))
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy("key", "n_shingles")
    # equal sets have equal sketches
    classes = cut(classes.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(F.min(c).alias(c) for c in SKETCH_COLUMNS)))
    size = classes.agg(F.count("*").alias("n"), F.max("copies").alias("copies")).first()
    if size["n"] <= 1:
        return sets.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")) if (size["copies"] or 0) <= 1 else _named(sets, classes, None)
    # the classes of one document's texts are one component from the start
    own = sets.where("n_shingles > 0 and doc_id is not null").select("doc_id", "key", "n_shingles").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    links: DataFrame | None = None
    if has_rows(own):
        several = sets.join(own, "doc_id").join(classes.select("key", "n_shingles", "rep"), ["key", "n_shingles"]).select("doc_id", "rep").distinct()
        links = cut(several.join(several.groupBy("doc_id").agg(F.min("rep").alias("first")), "doc_id").where("first != rep").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct())

    # the hashed count table: COUNTERS numbers, whatever the input
    counted = docs.select("doc_id", "text").mapInArrow(thrifty(_counts(words, COUNTERS)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted["slot"].to_numpy()] = counted["n"].to_numpy()

    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    copies = sets.where("n_shingles > 0 and doc_id is not null").select("doc_id").join(reps, "doc_id", "left_anti")
    told = _marked(docs.where("doc_id is not null"), copies)
    one = told.where("not marked").drop("marked").unionByName(told.where("marked").drop("marked").join(reps, "doc_id", "left_semi"))
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    number = int(size["n"])

    def postings(batches):
        yield from _postings(words, num, den, shared.value, number)(batches)

    lists = one.mapInArrow(thrifty(postings), "token long, doc long, pos int, n int, level short")
    lists = cut(lists.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("c > 1").drop("c"))
    lists = cut(_bounded(lists, num, den))
    shared.destroy()
    home = _homes(classes, links) if links is not None else None
    sketches = classes.select(F.col("rep").alias("doc"), F.col("n_shingles").cast("int").alias("n"), *SKETCH_COLUMNS)
    seen: DataFrame | None = None
    for star in range(STARS + 1):
        now = lists.join(home, "doc") if home is not None else lists.withColumn("comp", F.col("doc"))
        # the first document of a list heads it, and some that differ from list to list
        nth = [F.min_by("doc", F.xxhash64("doc", "token", F.lit(star * LIST_HEADS + k))) for k in range(1, LIST_HEADS)]
        heads = now.groupBy("token").agg(F.array_distinct(F.array(F.min("doc"), *nth)).alias("heads"), F.min("comp").alias("least"), F.max("comp").alias("largest"))
        now = now.join(heads.where("least != largest").select("token", "heads"), "token")
        exact = star == STARS
        if not exact:
            pairs = now.select("doc", "comp", F.explode("heads").alias("head")).where("doc != head").groupBy("doc", "comp", "head").agg(F.count(F.lit(1)).alias("n"))
            if home is not None:
                pairs = pairs.join(home.toDF("head", "hc"), "head").where("comp != hc")
            pairs = pairs.select("doc", "head", "n", F.least("doc", "head").alias("a"), F.greatest("doc", "head").alias("b"))
            pairs = pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")
            pairs = _possible(pairs, sketches, num, den)
            nth = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("n").desc(), "head"))  # at most as many heads as prefix shingles
            pairs = pairs.withColumn("nth", nth).where(F.col("nth") <= HEADS).select("a", "b").distinct()
        else:
            pairs = _candidates(now, sketches, num, den)
            pairs = pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
        texts = cut(_marked(docs.where("doc_id is not null and text is not null"), asked).where("marked").drop("marked"))
        checked = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        found = cut(checked.mapInArrow(thrifty(_verify(words, num, den)), "a long, b long, linked boolean").where("linked").select("a", "b").distinct())
        seen = pairs if seen is None else cut(seen.union(pairs))
        links = found if links is None else cut(links.union(found))
        if exact:
            break
        home = _homes(classes, links)
    return _named(sets, classes, links)


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``marked``: true for every doc_id in ``ids``, and for some others whose hashes meet theirs."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(64 * MARKS))
    bit = "shiftleft(1L, cast(h % 64 as int))"
    marks = cut(ids.select(h.alias("h")).groupBy(F.expr("h div 64").alias("word")).agg(F.bit_or(F.expr(bit)).alias("bits")))
    told = docs.withColumn("h", h).withColumn("word", F.expr("h div 64")).join(F.broadcast(marks), "word", "left")
    return told.select(*docs.columns, F.coalesce(F.expr(f"bits & {bit} != 0"), F.lit(False)).alias("marked"))


def _differing(num: int, den: int) -> str:
    """SQL that is false where the sketches of sides a and b prove that they aren't similar."""
    bits = " + ".join(f"bit_count({c}a ^ {c}b)" for c in SKETCH_COLUMNS)
    return f"({bits}) * {num + den} <= (na + nb) * {den - num}"


def _possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sketches and sizes don't rule out; where an id has several sets, some of them must fit."""
    side = lambda s: sketches.select(F.col("doc").alias(s), *(F.col(c).alias(c + s) for c in ("n", *SKETCH_COLUMNS)))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"least(na, nb) * {den} >= greatest(na, nb) * {num}").where(_differing(num, den))
    return both.select(*pairs.columns)


def _candidates(now: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) across components that share enough prefix shingles at positions that allow enough overlap.

    Near copies share hundreds of prefix shingles, and most of those stand in the same lists. Shingles whose lists hold
    the same documents are one group here: a document has one row a group, with the number of its shingles and the last
    position, so a pair meets once a group and not once a shingle. The groups' key is 64 bits of xor and the sum of 31
    bits over the list, with its length; xor alone would cancel repeated rows of a document. Variants of one text that
    are just not similar share many groups; the join leaves out pairs whose sketches prove that.
    """
    h = F.xxhash64("doc")
    lists = now.groupBy("token").agg(F.count(F.lit(1)).alias("g0"), F.bit_xor(h).alias("g1"), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))).alias("g2"))
    group = ["g0", "g1", "g2"]
    rows = now.join(lists, "token").groupBy(*group, "doc", "comp", "n", "level").agg(F.count(F.lit(1)).alias("w"), F.max("pos").alias("last"), F.max("most").alias("most"))
    rows = rows.join(sketches, ["doc", "n"])
    side = lambda s: rows.select(*group, F.col("doc").alias(s), *(F.col(c).alias(c + s) for c in ("comp", "n", "level", "w", "last", "most", *SKETCH_COLUMNS)))
    both = side("a").join(side("b"), group).where("a < b and compa != compb and na <= mostb and nb <= mosta")
    both = both.where(_differing(num, den))
    pairs = both.groupBy("a", "b", "na", "nb", F.least("levela", "levelb").alias("level")).agg(F.sum(F.least("wa", "wb")).alias("shared"), F.max("lasta").alias("pa"), F.max("lastb").alias("pb"))
    # what is shared up to the last shared prefix shingle, and at most all that follows it
    reach = F.col("shared") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    return pairs.where((F.col("shared") >= F.col("level")) & (reach * (num + den) >= num * (F.col("na") + F.col("nb")))).select("a", "b").distinct()


def _bounded(lists: DataFrame, num: int, den: int) -> DataFrame:
    """The postings with ``most``: the largest set that can be similar through this shingle; hopeless ones go.

    A shingle before a shared one that no other prefix holds is in no partner at all: the partner's prefix reaches to
    the shared one, so it would hold the earlier one too. With u such shingles the overlap is at most n - u.
    """
    before = F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1
    alone = F.col("pos") - before
    most = F.floor(((F.col("n") - alone) * (num + den) - F.col("n") * num) / num).cast("int")
    x = lists.withColumn("most", most)
    least = x.groupBy("token").agg(F.min("n").alias("least"))
    return x.join(least, "token").where("most >= least").drop("least")


def _homes(classes: DataFrame, links: DataFrame) -> DataFrame:
    all_of = classes.select(F.col("rep").alias("doc")).distinct()
    return cut(all_of.join(components(links).toDF("doc", "root"), "doc", "left").select("doc", F.coalesce("root", "doc").alias("comp")))


def _named(sets: DataFrame, classes: DataFrame, links: DataFrame | None) -> DataFrame:
    """Component of every row. Classes know their components; copies of a class are far more rows than classes."""
    named = classes.select("key", "n_shingles", F.col("rep").alias("doc"))
    if links is not None:
        named = named.join(components(links).toDF("doc", "root"), "doc", "left").select("key", "n_shingles", F.coalesce("root", "doc").alias("root"))
    else:
        named = named.withColumnRenamed("doc", "root").select("key", "n_shingles", "root")
    # a class with thousands of copies is one join key: both sides are dealt by (key, salt)
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    rows = sets.select("doc_id", "n_shingles", "key").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    out = rows.join(salted, ["key", "n_shingles", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The pipeline's stage: of every component one row stays, that of the smallest id; the columns of docs."""
    names = docs.columns
    if not has_rows(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")):
        homes = jaccard_components(docs, words, num, den).where("doc_id != component_id").select("doc_id").distinct()
        return docs.join(homes, "doc_id", "left_anti").select(*names)
    # ids that repeat: the nodes are (id, text), numbered in the order of ids
    rows = docs.where("doc_id is not null").withColumn("__text_hash", F.xxhash64("text"))
    nodes = cut(rows.select("doc_id", "__text_hash").distinct().orderBy("doc_id", "__text_hash").withColumn("__node", F.monotonically_increasing_id()))
    rows = cut(rows.join(nodes, ["doc_id", "__text_hash"]))  # read several times
    homes = jaccard_components(rows.select(F.col("__node").alias("doc_id"), "text"), words, num, den).where("doc_id != component_id").select(F.col("doc_id").alias("__node")).distinct()
    kept = rows.join(homes, "__node", "left_anti").dropDuplicates(["__node"])
    return kept.select(*names).unionByName(docs.where("doc_id is null"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_ngram_jaccard": op6_ngram_jaccard}
ORACLE_SQL: dict[str, str] = {}
