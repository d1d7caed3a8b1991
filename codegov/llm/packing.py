"""Vector bin packing of token pieces into training sequences.

An item has a demand in several dimensions (tokens, segments, loss-bearing tokens) and a sequence has a limit in each.
Sequences are filled one at a time; the next item is the one that fits and has the largest dot product of its demand
with what the sequence has left, both as shares of the limits. So large items come first, a nearly full sequence takes
what still fits, and a dimension that runs short steers the choice away from items that need much of it.

Items are dealt to groups of a bounded size by a hash of their row number; each group is packed by one task. Texts and
ids never move: a document is tokenised, cut and check-summed where it is read, and only its pieces are dealt out.

Defined results: a null or empty text is one piece of one token (the closing id). Rows that repeat a doc_id, and a null
doc_id, are packed like any other row. Extra columns are ignored. An empty table gives no rows. An item larger than a
limit has a sequence of its own only if ``oversize`` is set, else it is an error; documents are cut first, so they
have none.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, give_back, table, thrifty
from .vocab import Memory, byte_table, default_path, encoded, ids_bytes, last_merge, once

#: Items of a packing group, about; more would hardly fill sequences better.
GROUP = 2_000
#: Characters that are coded together, about, and words that are remembered from one such portion to the next, unless one
#: has more: texts of rare words have 60,000 different ones in two million characters, 160,000 in six.
PORTION, WORDS_KEPT = 2 << 20, 50_000
#: What ends a word's bytes; marks that are no part of a word. Words of the vocabulary's pre-tokenizer (a fixed pattern of the vocabulary file).
END, MARKS = b"\xff", frozenset(".,;:!?)")
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _raw_vocabulary(tokenizer) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Token bytes -> id, and the merges in order. The mark of a word's end is the byte END, which UTF-8 never has."""
    model, back = json.loads(tokenizer.to_str())["model"], byte_table()
    mark = model["end_of_word_suffix"]
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}

    def raw(token: str) -> bytes:
        last = token.endswith(mark)
        return bytes(map(back.__getitem__, token[: -len(mark)] if last else token)) + END * last

    return {raw(t): i for t, i in model["vocab"].items() if t not in special}, [(raw(a), raw(b)) for a, b in model["merges"]]


@lru_cache(maxsize=4)
def known_rules(path: str) -> bool:
    """Whether a file's rules are those that ``WordBpe`` takes apart; checked on the driver.

    Its normaliser and word pattern must be the ones named here, its ids must be in the order of its merges, and what
    ids alone say about the last merge of each token must be what the file says. Then merging the pair of lowest id
    again and again gives what the file's merges give.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    rules = json.loads(whole.to_str())
    parts = lambda x, y: [k.get("pattern", {}).get("Regex", k["type"]) for k in (rules[x] or {}).get(y) or []]
    if parts("pre_tokenizer", "pretokenizers") != [WORDS, "ByteLevel"] or parts("normalizer", "normalizers") != ["NFC", r"\s+", "Lowercase"] or rules["post_processor"] is not None or not rules["model"].get("end_of_word_suffix"):
        return False
    ranks, merges = _raw_vocabulary(whole)
    ids = [ranks[a + b] for a, b in merges]
    letters = [ranks.get(bytes([k]) + e, -1) for k in range(256) for e in (b"", END)]
    return ids == sorted(ids) and -1 not in letters and max(letters) < ids[0] and all(last_merge(a + b, ranks) == (a, b) for a, b in merges)


class WordBpe:
    """Ids of whole texts, as the tokenizers library gives them.

    The vocabulary drops white space, and no rule of its normaliser or pre-tokenizer reaches across a space or a line
    feed, so a text's ids are those of its runs between them. A run is normalised by the library, split by the
    vocabulary's word pattern, and each distinct word is merged once, by tiktoken over the file's own ids. Texts that
    hold a special token go through the library whole, and so do all texts where ``known`` is false.
    """

    def __init__(self, path: str, known: bool | None = None):
        import os

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.whole = Tokenizer.from_file(path)
        self.known = known_rules(path) if known is None else known
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if self.known:
            self.merge = tiktoken._tiktoken.CoreBPE(_raw_vocabulary(self.whole)[0], {}, r"[^\n]+").encode_single_piece
        self.find = regex.compile(WORDS.replace(r"\s", r"\p{White_Space}")).findall
        self.words = Memory(lambda new: [ids_bytes(self.merge(w.encode() + END)) for w in new], WORDS_KEPT)
        give_back()  # what reading the file took

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        other = [r for r in runs if not r.isascii()]
        normal = self.whole.normalizer.normalize_str(" ".join(other)).split(" ")
        if len(normal) != len(other):  # some run holds another kind of white space
            normal = [self.whole.normalizer.normalize_str(r) for r in other]
        rest = iter(normal)
        lower = [r.lower() if r.isascii() else next(rest) for r in runs]
        # letters alone are one word; the commonest other run is a word with one mark after it
        found = [(r,) if r.isalpha() else (r[:-1], r[-1]) if r[-1:] in MARKS and r[:-1].isalpha() else self.find(r) for r in lower]
        look = self.words.look(found)
        return [look(f[0]) if len(f) == 1 else b"".join(map(look, f)) for f in found]

    def encode_many(self, texts: list[str]):
        """Yields each text's ids as little-endian unsigned 32-bit integers."""
        if not self.known:
            yield from (np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4") for t in texts)
            return
        odd = [any(s in t for s in self.special) for t in texts]
        rest = encoded([t for t, o in zip(texts, odd, strict=True) if not o], lambda t: t.replace("\n", " "), list, self._encode_runs, PORTION)
        for t, o in zip(texts, odd, strict=True):
            yield np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4") if o else next(rest)


def cut_documents(docs: DataFrame, size: int = 2048, closing: int = 1, path: str | None = None) -> DataFrame:
    """Pieces of at most ``size`` ids: (row, doc_id, start, length, ids_crc32, doc_tokens)."""
    path = path or default_path("word_bpe_49k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = known_rules(path)

    def run(batches):
        from pyspark import TaskContext

        bpe = once("word_bpe", path, lambda p: WordBpe(p, known))
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            at, out = [], []
            for i, ids in enumerate(bpe.encode_many([t or "" for t in b.column("text").to_pylist()])):
                ids = np.append(ids, np.uint32(closing)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    at.append(i)
                    out.append((row, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                    row += 1
            rows = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *map(pa.array, rows)], ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])
        bpe.words.clear()

    return bounded(docs).select("doc_id", "text").mapInArrow(thrifty(run), f"doc_id {kind}, row long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The sequence of each item. ``demand``: items x dimensions, every item within the limits.

    Shares are compared as whole numbers, over a common denominator, so ties are ties; they go to the item of larger
    first demand, then of larger shares, then to the earlier one.
    """
    common = np.lcm.reduce(limits.astype(np.int64))
    scale = (common // limits) ** 2 if common < 1 << 30 else 1.0 / limits**2
    order = np.lexsort((np.arange(len(demand)), -(demand * (common // limits)).sum(1), -demand[:, 0]))
    need = demand[order]
    found = np.full(len(demand), -1, np.int64)
    names = order.copy()
    k = 0
    while len(names):
        room = limits.astype(np.int64).copy()
        free = np.ones(len(names), bool)
        while True:
            first = int(np.searchsorted(-need[:, 0], -room[0]))  # items are sorted by their first demand
            fits = free[first:] & (need[first:] <= room).all(1)
            if not fits.any():
                break
            j = first + int(np.where(fits, need[first:] @ (room * scale), -1).argmax())
            free[j] = False
            found[names[j]] = k
            room -= need[j]
            if room.min() <= 0:
                break
        names, need = names[free], need[free]
        k += 1
    return found


def pack(items: DataFrame, limits: dict[str, int], key: str = "row", group: int = GROUP, oversize: bool = False) -> DataFrame:
    """``items`` with sequence_id, offset (tokens before the item in its sequence) and slot (its place there).

    ``limits``: column -> most of it in one sequence; the first is the column of tokens. ``key`` identifies an item and
    decides its group, so the result doesn't depend on the order in which rows arrive.
    """
    names = list(limits)
    caps = np.array([limits[n] for n in names], np.int64)
    groups = max(1, -(-items.count() // group))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in items.schema)}, sequence_id long, offset long, slot int"

    def run(key_of_group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable").reset_index(drop=True).drop(columns="__group")
        need = rows[names].to_numpy(np.int64)
        large = (need > caps).any(1)
        if large.any() and not oversize:
            raise ValueError("an item is larger than a limit")
        where = np.full(len(rows), -1, np.int64)
        where[~large] = fill(need[~large], caps)
        where[large] = where.max(initial=-1) + 1 + np.arange(large.sum())
        order = np.lexsort((np.arange(len(rows)), where))
        rows, where, size = rows.iloc[order], where[order], need[order, 0]
        before = np.cumsum(size) - size
        head = np.concatenate(([True], where[1:] != where[:-1])) if len(rows) else np.zeros(0, bool)
        starts = np.flatnonzero(head)
        at = np.repeat(starts, np.diff(np.append(starts, len(rows))))
        return rows.assign(sequence_id=(int(key_of_group[0]) << 32) + where, offset=before - before[at], slot=(np.arange(len(rows)) - at).astype(np.int32))

    dealt = items.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, size: int = 2048, max_segments: int = 32, max_loss: int | None = None, closing: int = 1, path: str | None = None) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is cut every ``size`` ids: full pieces are sequences of their own, the rests are packed. Every id of a
    document but the closing one bears loss; ``max_loss`` defaults to ``size``, and a piece that exceeds it is cut to it.
    """
    pieces = cut(cut_documents(docs, min(size, max_loss or size), closing, path))
    last = (F.col("start") + F.col("length") == F.col("doc_tokens")).cast("long")
    rests = pieces.where(F.col("length") < size).withColumn("segments", F.lit(1).cast("long")).withColumn("loss", F.col("length") - last)
    packed = pack(rests, {"length": size, "segments": max_segments, "loss": max_loss or size})
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", F.lit(1 << 62) + F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(*names).unionByName(packed.select(*names))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_packing": op10_packing}
ORACLE_SQL: dict[str, str] = {}
