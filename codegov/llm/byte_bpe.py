"""Byte-level BPE encoding and decoding over Arrow batches, with the tokenizers library.

A BPE model is built from the rank file: a token's rank is its id, and its merge is the split of its bytes that lower
ranks alone lead to. Bytes go through the byte-to-character table, since the library works on characters. Pre-tokens
are the matches of the public pattern, encoded one by one; their places in the text give each token's byte offsets.
Decoding reverses the table: ids become bytes first, and only whole byte strings become text, so a character that is
split over several tokens comes back whole.

Defined results: a null or empty text has no ids; the hash columns are those of an empty string. Every row is
returned, repeated ids too; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, table
from .vocab import Memory, Pieces, byte_table, default_path, encoded, ids_bytes, last_merge, once, read_ranks, spaced

#: Marks in front of a unit: a text's first word; a match of the pattern. Texts that are cut at spaces have neither.
FIRST, MATCH = "\x1e", "\x1f"


class ByteBpe:
    def __init__(self, path: str, pattern: str | None = None):
        import os

        import public_tokenizers
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer, models

        ranks = read_ranks(path)
        chars = {b: c for c, b in byte_table().items()}
        spell = lambda t: "".join(map(chars.__getitem__, t))
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                a, b = last_merge(token, ranks)
                if a:
                    merges.append((spell(a), spell(b)))
        self.model = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges))
        # only of the public pattern is it known that no match goes on over a single space or line feed between others
        self.by_words = pattern in (None, public_tokenizers.PATTERN)
        self.find = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.chars, self.ranks = chars, ranks
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.tokens = Pieces(tokens, "u1")
        self.memory = Memory(self._encode_matches)

    def _encode_matches(self, matches: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8", "surrogatepass") for p in matches]
        known = [self.ranks.get(r) for r in raw]
        spelled = ["".join(map(self.chars.__getitem__, r)) for r, k in zip(raw, known, strict=True) if k is None]
        rest = iter(self.model.encode_batch_fast(spelled, add_special_tokens=False)) if spelled else iter(())
        return [ids_bytes([k] if k is not None else next(rest).ids) for k in known]

    def _plain(self, text: str) -> str | None:
        s = spaced(text) if self.by_words else None
        return None if s is None else FIRST + s

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """A unit is a match of the pattern (marked), a text's first word (marked), or a word that follows a space or line feed."""
        found = [(u[1:],) if u[0] == MATCH else self.find(u[1:] if u[0] == FIRST else u if u[0] == "\n" else " " + u) for u in units]
        look = self.memory.look(found)
        return [look(f[0]) if len(f) == 1 else b"".join(map(look, f)) for f in found]

    def encode_many(self, texts: list[str]):
        """Yields each text's ids as unsigned 32-bit integers.

        Most texts are cut into the words between single spaces and line feeds; others into the pattern's matches.
        """
        return encoded(texts, self._plain, lambda t: [MATCH + m for m in self.find(t)], self._encode_units)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text])).tolist()

    def decode_bytes(self, ids) -> bytes:
        return self.tokens.of(np.asarray(ids, np.int64)).tobytes()

    def offsets(self, ids) -> list[int]:
        """Where each token starts in the text's bytes."""
        sizes = self.tokens.sizes[np.asarray(ids, np.int64)]
        return (np.cumsum(sizes) - sizes).tolist()


def _load(path: str) -> ByteBpe:
    return once("byte_bpe", path, ByteBpe)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, offsets array<int>): token ids and the byte where each token starts."""
    path = path or default_path("byte_bpe_50k.tiktoken")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = _load(path)
        for b in batches:
            ids = list(bpe.encode_many([t or "" for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.offsets(i) for i in ids], pa.list_(pa.int32()))], ["doc_id", "ids", "offsets"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes, text): the bytes of the ids, and their text (bytes that aren't UTF-8 become U+FFFD)."""
    path = path or default_path("byte_bpe_50k.tiktoken")
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = _load(path)
        for b in batches:
            raw = [bpe.decode_bytes(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())], ["doc_id", "bytes", "text"])

    return bounded(encoded).select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), encoding and decoding within the batch."""
    path = path or default_path("byte_bpe_50k.tiktoken")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = _load(path)
        for b in batches:
            n, a, d = [], [], []
            for ids in bpe.encode_many([t or "" for t in b.column("text").to_pylist()]):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                d.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_byte_bpe": op7_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
