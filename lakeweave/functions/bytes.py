"""Functions of binary columns that SQL lacks: CRC32C, CRC64NVME and the block codec."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .batches import cuts_of, small_batches

#: Bytes that one lane of a checksum takes; longer values are cut and the parts combined.
LANE = 1024
#: Sizes and spread beyond which a block is stored as it is.
LEAST_BLOCK, MOST_BLOCK, HEAD, MOST_DISTINCT = 16, 65_536, 512, 200


class Crc:
    """A reflected CRC, all ones at the start and inverted at the end.

    Without its start value a CRC is linear, so all lanes of all values advance
    together, one byte a step, and a lane's result moves past the bytes that
    follow it by the operator of that many zero bytes."""

    def __init__(self, poly: int, bits: int) -> None:
        t = np.arange(256, dtype=np.uint64)
        for _ in range(8):
            t = np.where(t & np.uint64(1), (t >> np.uint64(1)) ^ np.uint64(poly), t >> np.uint64(1))
        self.table, self.bits, self.ones = t, bits, np.uint64((1 << bits) - 1)
        one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        self.skips = [self._step(one, np.zeros(bits, np.uint8))]  # past 1, 2, 4, ... zero bytes
        for _ in range(40):
            self.skips.append(self._apply(self.skips[-1], self.skips[-1]))

    def _step(self, crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return (crc >> np.uint64(8)) ^ self.table[((crc ^ byte) & np.uint64(255)).astype(np.int64)]

    def _apply(self, op: np.ndarray, crc: np.ndarray) -> np.ndarray:
        out = np.zeros(len(crc), np.uint64)
        for i in range(self.bits):
            out ^= np.where((crc >> np.uint64(i)) & np.uint64(1), op[i], np.uint64(0))
        return out

    def _skip(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each register past as many zero bytes as ``n`` says."""
        for k in range(int(n.max(initial=0)).bit_length()):
            far = (n >> k) & 1 == 1
            crc[far] = self._apply(self.skips[k], crc[far])
        return crc

    def __call__(self, values: list[bytes]) -> np.ndarray:
        sizes = np.array([len(v) for v in values], np.int64)
        lanes = np.maximum(1, -(-sizes // LANE))
        first = np.cumsum(lanes) - lanes
        data = np.zeros((int(lanes.sum()), LANE), np.uint8)  # zeros ahead of a value leave an empty register empty
        for v, n, at in zip(values, lanes, first, strict=True):
            data[at : at + n].reshape(-1)[n * LANE - len(v) :] = np.frombuffer(v, np.uint8)
        crc = np.zeros(len(data), np.uint64)
        for column in np.ascontiguousarray(data.T):
            crc = self._step(crc, column)
        behind = np.repeat(lanes, lanes) - 1 - (np.arange(len(data)) - np.repeat(first, lanes))
        crc = np.bitwise_xor.reduceat(self._skip(crc, behind * LANE), first) if len(values) else crc
        return crc ^ self._skip(np.full(len(values), self.ones), sizes) ^ self.ones


@cache
def crc(name: str) -> Crc:
    # The reflected polynomials and widths of the two checksums.
    return Crc(*{"crc32c": (0x82F63B78, 32), "crc64nvme": (0x9A6C9329AC4BC9B5, 64)}[name])


def _parts(*columns: pa.Array) -> Iterator[list[tuple]]:
    """The rows of columns, a bounded number of rows and bytes at a time."""
    batch = pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))])
    for at, n in cuts_of(batch):
        yield list(zip(*[c.slice(at, n).to_pylist() for c in batch.columns], strict=True))


def _each(f: Callable[[list[tuple]], list], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([], kind), *[pa.array(f(rows), kind) for rows in _parts(*columns)]])


def _hex(name: str, data: pa.Array) -> pa.Array:
    """Lower-case hex digits; null stays null."""
    c = crc(name)

    def digits(rows: list[tuple]) -> list[str | None]:
        return [None if v is None else f"{int(x):0{c.bits // 4}x}" for (v,), x in zip(rows, c([v or b"" for (v,) in rows]), strict=True)]

    return _each(digits, pa.string(), data)


@F.arrow_udf(StringType())
def crc32c(data: pa.Array) -> pa.Array:
    return _hex("crc32c", data)


@F.arrow_udf(StringType())
def crc64nvme(data: pa.Array) -> pa.Array:
    return _hex("crc64nvme", data)


def skips(block: bytes) -> bool:
    """Blocks that are not worth a try: too short, too long, or too varied."""
    return not LEAST_BLOCK <= len(block) <= MOST_BLOCK or len(set(block[:HEAD])) > MOST_DISTINCT


class Codec:
    """Blocks in zstd where that is smaller, else as they are; null stays null."""

    def __init__(self) -> None:
        import zstandard

        self._pack, self._unpack = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress

    def stored(self, block: bytes | None) -> bytes | None:
        if block is None or skips(block):
            return block
        packed = self._pack(block)
        return packed if len(packed) < len(block) else block

    def block(self, stored: bytes | None, size: int) -> bytes | None:
        """The block of ``size`` bytes: stored as it is where the lengths are equal."""
        return stored if stored is None or len(stored) == size else self._unpack(stored, max_output_size=int(size))


@F.arrow_udf(BinaryType())
def compress_block(data: pa.Array) -> pa.Array:
    """The block in zstd if that is smaller, else as it is; null stays null."""
    z = Codec()
    return _each(lambda rows: [z.stored(b) for (b,) in rows], pa.binary(), data)


@F.arrow_udf(BinaryType())
def decompress_block(stored: pa.Array, size: pa.Array) -> pa.Array:
    """The block of ``size`` bytes: stored as it is where the lengths are equal."""
    z = Codec()
    return _each(lambda rows: [z.block(b, n) for b, n in rows], pa.binary(), stored, size)


def coded(df: DataFrame, key: str, data: str) -> DataFrame:
    """``key`` (a long), size, same, no_larger for every row: the bytes of ``data``, whether they
    come back from the codec as they were, and whether they are stored in no more bytes. Null
    comes back as null. Each block goes there and back in one worker, a bounded part of a
    batch at a time, and none is sent back to Spark."""
    kind = pa.schema([(key, pa.int64()), ("size", pa.int64()), ("same", pa.bool_()), ("no_larger", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = Codec()
        for batch in batches:
            for rows in _parts(*batch.columns):
                out: list[tuple] = []
                for k, b in rows:
                    size = 0 if b is None else len(b)
                    stored = z.stored(b)
                    out.append((k, None if b is None else size, z.block(stored, size) == b, b is None or len(stored) <= size))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)

    small_batches(df.sparkSession)
    return df.select(F.col(key).cast("long").alias(key), F.col(data).cast("binary").alias("data")).mapInArrow(run, f"{key} long, size long, same boolean, no_larger boolean")
