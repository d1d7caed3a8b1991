"""Token counts without ids: pieces are counted once per distinct pre-token, and joined to pre-token frequencies.

A pre-token is a run of space marks with the characters after it, split again at line feeds. No piece of the vocabulary
holds a space mark after another character, nor a line feed (checked when the model is loaded), so no merge crosses a
pre-token and a text's count is the sum over its pre-tokens.

1. Documents come in chunks of CHUNK characters. A chunk keeps how often each document has each of the chunk's
   distinct pre-tokens, and sends the distinct pre-tokens themselves, dealt to buckets by their hash.
2. A bucket has its pre-tokens of all chunks: each distinct one is counted once in the whole job.
3. The counts go back to their chunks, where frequencies times counts are summed per document.

So a pre-token is moved once per chunk instead of once per document, and neither texts nor ids are moved. Buckets grow
in number with the pre-tokens, so no task holds more than a bounded share.

If a vocabulary has pieces that cross such a border, whole texts are encoded instead.

Defined results: a null or empty text has 0 bytes and 0 tokens. Every row is returned, repeated ids and null ids too;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table
from .vocab import coded, default_path, once, portions, spaced

MARK, ESCAPED = "\u2581", "\x1f"
#: Pre-tokens of an escaped text: line feeds alone; space marks with what follows; what follows a line feed.
PRETOKEN = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Characters of a chunk, about; pre-tokens of a bucket, about.
CHUNK, BUCKET = 16 << 20, 400_000


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        # with a letter and a line feed in front, the model neither adds a space mark nor sees what stood before
        self.lead = len(self.model.encode("a\n"))
        self.splits = self.splits and self.model.encode("a  b \n c", out_type=str)[:3] == [MARK + "a", MARK, MARK + "b"]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def units(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit (see ``units_of``)."""
        full = ["a\n" + (u[1:] if u[:1] == ESCAPED else u if u[:1] == "\n" else MARK + u) for u in units]
        return np.fromiter((len(x) - self.lead for x in self.model.encode(full, num_threads=1)), np.int64, len(full))


def _plain(text: str) -> str | None:
    return None if MARK in text else spaced(text)


def units_of(text: str) -> list[str]:
    """The pre-tokens of a text: without its space mark if it has one in front, else behind an escape, line feeds as they are."""
    found = PRETOKEN.findall(MARK + text.replace(" ", MARK)) if text else []
    return [t[1:] if t[0] == MARK and t[1:2] not in ("", MARK, ESCAPED) else ESCAPED + t for t in found]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit integers behind their sizes, compressed."""
    raw = b"".join(np.append(np.uint32(len(a)), a.astype("<u4")).astype("<u4").tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), "<u4")
    out, at = [], 0
    while at < len(raw):
        out.append(raw[at + 1 : at + 1 + int(raw[at])].astype(np.int64))
        at += 1 + int(raw[at])
    return out


def _text_blob(units: list[str]) -> bytes:
    raw = [u.encode("utf-8", "surrogatepass") for u in units]
    sizes = _packed(np.fromiter(map(len, raw), np.int64, len(raw)))
    data = b"".join(raw)
    return len(sizes).to_bytes(8, "little") + sizes + len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _texts(blob: bytes) -> list[str]:
    n = int.from_bytes(blob[:8], "little")
    sizes = _unpacked(blob[8 : 8 + n])[0]
    rest = blob[8 + n :]
    data = pa.decompress(rest[8:], int.from_bytes(rest[:8], "little"), "zstd", asbytes=True)
    ends = np.cumsum(sizes).tolist()
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends, strict=False)]


def _chunks(buckets: int, schema: pa.Schema):
    """A row per chunk (bucket -1) with its documents and their frequencies, and one per chunk and bucket with pre-tokens."""

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            first = 0
            for part in portions(texts, CHUNK):
                codes, starts, ends, distinct = coded(part, _plain, units_of)
                home = (pd.util.hash_array(np.array(distinct, object), categorize=False) % np.uint64(buckets)).astype(np.int64) if distinct else np.zeros(0, np.int64)
                order = np.argsort(home, kind="stable")  # a pre-token's number: its place by bucket
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(len(order))
                docs, at = [], 0
                for a, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    docs.append(np.unique(number[codes[a:e]], return_counts=True))
                cols = [np.fromiter((len(u) for u, _ in docs), np.int64, len(docs)), np.concatenate([np.diff(u, prepend=0) for u, _ in docs]), np.concatenate([n for _, n in docs])]
                rows = [(chunk, -1, b.column("doc_id")[first : first + len(part)].to_pylist(), [len(t.encode("utf-8", "surrogatepass")) for t in part], _packed(*cols))]
                for k, n in zip(*np.unique(home, return_counts=True), strict=True):
                    rows.append((chunk, int(k), None, None, _text_blob([distinct[i] for i in order[at : at + n]])))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                chunk, first = chunk + 1, first + len(part)

    return run


def _counted(path: str):
    def run(t: pa.Table) -> pa.Table:
        parts = [_texts(x.as_py()) for x in t["blob"]]
        flat = pa.array([u for p in parts for u in p], pa.large_string()).dictionary_encode()
        n = once("pieces", path, PieceCounter).units(flat.dictionary.to_pylist())[flat.indices.to_numpy()]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "blob": pa.array([_packed(n[e - len(p) : e]) for e, p in zip(ends, parts, strict=True)], pa.binary())})

    return run


def _summed(limit: int, kind: pa.DataType):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        pieces = np.concatenate([np.zeros(0, np.int64), *(_unpacked(x.as_py())[0] for x in t["blob"][1:])])
        size, steps, times = _unpacked(t["blob"][0].as_py())
        starts = np.cumsum(size) - size
        number = np.cumsum(steps)  # steps begin anew with each document
        number -= np.repeat(np.concatenate(([0], number))[starts], size)
        total = np.concatenate(([0], np.cumsum(times * pieces[number])))
        n = total[starts + size] - total[starts]
        ids, lengths = t["ids"][0].as_py(), t["lengths"][0].as_py()
        return pa.table({"doc_id": pa.array(ids, kind), "n_bytes": pa.array(lengths, pa.int64()), "n_tokens": n, "over_limit": n > limit})

    return run


def count_tokens(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    path = path or default_path("piece_bpe_32k.model")
    kind = docs.schema["doc_id"].dataType
    fields = f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    docs = bounded(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    if not PieceCounter(path).splits:

        def whole(batches):
            for b in batches:
                texts = [t or "" for t in b.column("text").to_pylist()]
                n = once("pieces", path, PieceCounter).whole(texts)
                size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([k > limit for k in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return docs.mapInArrow(whole, fields)
    arrow = to_arrow_type(kind)
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(arrow)), ("lengths", pa.list_(pa.int64())), ("blob", pa.binary())])
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-size // (BUCKET * 16)))  # a text has at most one new pre-token in sixteen bytes or so
    chunks = cut(docs.mapInArrow(_chunks(buckets, schema), f"chunk long, bucket int, ids array<{kind.simpleString()}>, lengths array<long>, blob binary"))
    counts = chunks.where("bucket >= 0").select("chunk", "bucket", "blob").groupBy("bucket").applyInArrow(_counted(path), "chunk long, bucket int, blob binary")
    both = chunks.where("bucket < 0").unionByName(counts, allowMissingColumns=True)
    return both.groupBy("chunk").applyInArrow(_summed(limit, arrow), fields)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), limit=4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_token_counts": op8_token_counts}
ORACLE_SQL: dict[str, str] = {}
