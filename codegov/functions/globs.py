"""Path globs as anchored Java regular expressions, compiled once on the driver.

``**`` crosses directories, ``*`` and ``?`` don't; a segment that starts with a wildcard never matches a leading dot;
``{a,b}`` and ``[..]`` / ``[!..]`` work as usual; a trailing ``/**`` also matches the bare prefix; a leading ``!``
negates the whole pattern; a pattern without magic is plain equality.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = re.compile(r"[*?\[\]{}]|^!")


def is_glob(pattern: str) -> bool:
    return bool(MAGIC.search(pattern))


def _segment(text: str) -> str:
    out, i, depth = "", 0, 0
    while i < len(text):
        c = text[i]
        if c == "*":
            out += "[^/]*"
            while i + 1 < len(text) and text[i + 1] == "*":
                i += 1
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in text[i + 2 :]:
            end = text.index("]", i + 2)
            inner = text[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.sub(r"([^\w/])", r"\\\1", c)
        i += 1
    return ("(?!\\.)" if text[:1] in "*?[" else "") + out


def glob_to_regex(pattern: str) -> str:
    """The anchored regular expression of a glob without its leading ``!``."""
    if re.search(r"[@+!?*]\(", pattern):
        raise ValueError(f"extended globs are not supported: {pattern}")
    parts = re.split(r"/(?![^{}]*\})", pattern)  # a slash inside braces parts no segments
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            inner = r"(?:(?!\.)[^/]+/)*"
            if last:
                out = (out[:-1] + r"(?:/(?!\.)[^/]+)*/?") if out.endswith("/") else out + r"(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*)?"
            else:
                out += inner
        else:
            out += _segment(part) + ("" if last else "/")
    return f"^{out}$"


def matches(path: Column, patterns: str | Iterable[str]) -> Column:
    """True where any pattern matches; an empty list matches nothing."""
    found = F.lit(False)
    for p in [patterns] if isinstance(patterns, str) else patterns:
        negated, plain = p.startswith("!"), p.removeprefix("!")
        one = path.rlike(glob_to_regex(plain)) if is_glob(plain) else path == plain
        found = found | (~one if negated else one)
    return found


def matches_import(target: Column, pattern: str | re.Pattern) -> Column:
    """A compiled pattern is searched; a plain name matches itself and its sub-paths; a glob matches as a path."""
    if isinstance(pattern, re.Pattern):
        return target.rlike(pattern.pattern)
    if is_glob(pattern):
        return matches(target, pattern)
    return (target == pattern) | target.startswith(pattern + "/")


def matches_any_import(target: Column, patterns: Iterable) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | matches_import(target, p)
    return found
