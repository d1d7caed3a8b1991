"""Public vocabularies inside tasks: texts as codes of their distinct units, and what a vocabulary gives for each unit.

Merges never cross a pre-token, so a text's ids are those of its pre-tokens in turn. Arrow cuts the texts of a portion
into units (pre-tokens, or runs of a few of them) and codes them by their distinct values; the library sees each
distinct unit once, and a text's result is gathered from its codes. Portions have a bounded number of characters.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's memory of units, unless it is made smaller.
ENTRIES = 200_000
#: Characters that are coded together, about.
PORTION = 6 << 20
_loaded: dict = {}
_OTHER = re.compile(r"[^\S \n]").search


class Memory:
    """Unit -> value, remembered from portion to portion. ``make`` gives the values of a list of new units at once."""

    def __init__(self, make: Callable[[list[str]], list], entries: int = ENTRIES):
        self.make, self.entries, self.known = make, entries, {}

    def look(self, texts: list[list[str]]) -> Callable:
        """A look-up that knows every pre-token of ``texts``."""
        wanted = set().union(*texts)
        new = list(wanted.difference(self.known))
        if len(self.known) + len(new) > self.entries:
            self.known = {}
            new = list(wanted)
        self.known.update(zip(new, self.make(new), strict=True))
        return self.known.__getitem__

    def clear(self) -> None:
        self.known = {}


def portions(texts: list[str], budget: int = 1 << 20):
    """Lists of texts of about ``budget`` characters together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= budget:
            yield part
            part, size = [], 0
    if part:
        yield part


def spaced(text: str) -> str | None:
    """The text with a space before each line feed, to be cut at spaces, or None if it has other white space, or runs of it.

    Each word but the first stands for itself with the space before it; one that followed a line feed begins with it.
    """
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER(text):
        return None
    return text.replace("\n", " \n")


def coded(texts: list[str], plain: Callable[[str], str | None], cut: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(codes, starts, ends, distinct): text k's units are distinct[codes[starts[k]:ends[k]]].

    ``plain`` gives a text whose units lie between its spaces, or None; ``cut`` then gives the units themselves.
    """
    spaces = [plain(t) for t in texts]
    cuts = [cut(t) if s is None else None for t, s in zip(texts, spaces, strict=True)]
    whole = pc.split_pattern(pa.array([s for s in spaces if s is not None], pa.large_string()), " ")
    flat = pa.concat_arrays([whole.flatten(), pa.array([u for c in cuts if c for u in c], pa.large_string())]).dictionary_encode()
    sizes = np.zeros(len(texts), np.int64)
    is_plain = np.array([s is not None for s in spaces], bool)
    sizes[is_plain] = pc.list_value_length(whole).to_numpy(zero_copy_only=False)
    sizes[~is_plain] = [len(c) for c in cuts if c is not None]
    order = np.argsort(~is_plain, kind="stable")
    ends = np.empty(len(texts), np.int64)
    ends[order] = np.cumsum(sizes[order])
    return flat.indices.to_numpy(), ends - sizes, ends, flat.dictionary.to_pylist()


class Pieces:
    """The values of the distinct units (ids, or bytes), laid end to end."""

    def __init__(self, parts: list[bytes], kind: str = "<u4"):
        width = np.dtype(kind).itemsize
        self.sizes = np.fromiter((len(p) // width for p in parts), np.int64, len(parts))
        self.values = np.frombuffer(b"".join(parts), kind)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The values of units in turn."""
        n = self.sizes[codes]
        ends = np.cumsum(n)
        return self.values[np.repeat(self.starts[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def encoded(texts: list[str], plain: Callable, cut: Callable, encode: Callable[[list[str]], list[bytes]], portion: int = PORTION) -> Iterator[np.ndarray]:
    """Yields each text's ids; ``encode`` gives the bytes of the ids of distinct units."""
    for part in portions(texts, portion):
        codes, starts, ends, distinct = coded(part, plain, cut)
        pieces = Pieces(encode(distinct))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            yield pieces.of(codes[a:b])


def once(name: str, path: str, load: Callable):
    """What ``load(path)`` gave, loaded once per worker process; a worker holds one vocabulary at a time."""
    if (name, path) not in _loaded:
        _loaded.clear()
        _loaded[name, path] = load(path)
    return _loaded[name, path]


def forget() -> None:
    """Frees the vocabulary that an earlier job left in this worker."""
    _loaded.clear()


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_table() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: itself where it prints, else 256 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``: apply the merges of lower rank until two parts are left."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if best >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else (b"", b"")


def ids_bytes(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()
