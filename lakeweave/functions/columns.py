"""Column functions: predicates, ranges, digests and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of one stored row.
ROW_BYTES = 8120


def at(moment: str) -> Column:
    """A moment as a literal without a zone."""
    return F.lit(moment).cast("timestamp_ntz")


def live(expires: Column, as_of: str) -> Column:
    """Not expired: no expiry, or one after the clock."""
    return expires.isNull() | (expires > at(as_of))


def not_deleted(etag: Column) -> Column:
    """Not a tombstone."""
    return etag.isNull() | ~etag.startswith("deleted:")


def common_prefix(key: Column, prefix: str, delimiter: str) -> Column:
    """``prefix`` and what follows up to the first delimiter, else null."""
    rest = F.substring(key, F.lit(len(prefix) + 1), F.length(key))
    place = F.instr(rest, delimiter)
    return F.when(place > 0, F.concat(F.lit(prefix), F.substring(rest, F.lit(1), place + len(delimiter) - 1)))


def hex_number(digest: Column, digits: int = 8) -> Column:
    """The first hex digits of a digest as a number: a hash that other engines know too."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def chunks(size: Column, row: int = ROW_BYTES) -> Column:
    return F.floor((size + row - 1) / row).cast("bigint")


def etag_matches(header: Column, etag: Column) -> Column:
    """A comma-separated list of tags, ``*``, weak marks and quotes allowed."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "^W/", ""), '^"|"$', "")
    return (F.trim(header) == "*") | F.exists(F.split(header, ","), lambda x: (bare(x) == bare(etag)) & (bare(x) != ""))


def bytes_between(body: Column, start: int, end: int) -> Column:
    """The bytes from ``start`` to ``end``, both included; negative ones count from the end; none if they cross."""
    n = F.octet_length(body)
    s = F.greatest(F.lit(0), n + start) if start < 0 else F.lit(start)
    e = n + end if end < 0 else F.lit(end)
    return F.when((e < 0) | (s > e) | (s >= n), F.lit(b"").cast("binary")).otherwise(F.substring(body, s + 1, F.least(e, n - 1) - s + 1))


def written(body: Column, value: bytes, offset: int) -> Column:
    """``value`` over the bytes from ``offset`` on, after zeros where the body is shorter."""
    n, end = F.octet_length(body), offset + len(value)
    head = F.concat(F.substring(body, F.lit(1), F.lit(offset)), F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(0), F.lit(offset) - n))))
    return F.concat(head, F.lit(value).cast("binary"), F.substring(body, F.lit(end + 1), F.greatest(F.lit(0), n - end)))


def backoff(attempt: Column, initial: float, factor: float, most: float) -> Column:
    """min(most, initial * factor^(attempt - 1)), rounded; a factor of 0 or less means 2."""
    n, factor = F.greatest(attempt, F.lit(1)), factor if factor > 0 else 2
    return F.when(F.lit(initial) <= 0, F.lit(0)).otherwise(F.round(F.least(F.lit(float(most)), F.lit(float(initial)) * F.pow(F.lit(float(factor)), n - 1)))).cast("bigint")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double precision; stays in the JVM."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
