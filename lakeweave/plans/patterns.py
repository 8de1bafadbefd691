"""Key patterns as pushed-down ranges plus a residual test."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_end(prefix: str) -> str | None:
    """The smallest key above all keys with this prefix; None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[i])
        if c < 0x10FFFF:
            c += 1
            return prefix[:i] + chr(0xE000 if 0xD800 <= c < 0xE000 else c)
    return None


def in_prefix(key: Column, prefix: str) -> Column:
    """A range that reaches the scan as two comparisons."""
    if not prefix:
        return F.lit(True)
    end = prefix_end(prefix)
    low = key >= F.lit(prefix)
    return low if end is None else low & (key < F.lit(end))


def glob_regex(pattern: str) -> str:
    """``*`` and ``?`` don't cross ``/``; ``[...]`` is a class; ``\\`` escapes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out.append(pattern[i : end + 1])
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def literal_prefix(pattern: str) -> str:
    return re.split(r"[*?\[\\]", pattern, maxsplit=1)[0]


def glob(key: Column, pattern: str) -> Column:
    """The literal start as a range for the scan, the rest as a regular expression."""
    if pattern == "*":
        return F.lit(True)
    return in_prefix(key, literal_prefix(pattern)) & key.rlike(glob_regex(pattern))
