"""File sources: archives, Parquet footers, file metadata, binary files."""

from __future__ import annotations

import io
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.tables import folder
from ..registry import query, table

MEMBERS = "archive string, name string, size long, crc32 long, method int, content binary"


def clean_name(name: str) -> str | None:
    """A member's name, or None for folders and names that leave the archive."""
    name = name.replace("\\", "/")
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if not parts or name.endswith("/") or name.startswith("/") or "\0" in name or ".." in parts or ":" in parts[0]:
        return None
    return "/".join(parts)


#: Fixed value: the method number of Zstandard in a ZIP.
ZSTD = 93


def zip_member(z: zipfile.ZipFile, i: zipfile.ZipInfo) -> bytes:
    """A member's bytes; the checksum is compared."""
    if i.compress_type != ZSTD:
        return z.read(i)
    import zstandard

    z.fp.seek(i.header_offset)
    head = z.fp.read(30)
    z.fp.seek(i.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    data = zstandard.ZstdDecompressor().decompressobj().decompress(z.fp.read(i.compress_size))
    if zlib.crc32(data) != i.CRC:
        raise zipfile.BadZipFile(f"{i.filename}: wrong checksum")
    return data


def members_of(archive: str, source: BinaryIO, content: bool = True) -> list[tuple]:
    """Sorted members of a ZIP or TAR that can be sought in: only its directory, or its
    headers, and the members are read. Of equal names the first stays. A TAR has no
    checksums of content, so a member's is that of its name, place and size."""
    found: dict[str, tuple] = {}
    start = source.read(2)
    source.seek(0)
    if start == b"PK":
        with zipfile.ZipFile(source) as z:
            for i in z.infolist():
                if (n := clean_name(i.filename)) and n not in found:
                    found[n] = (archive, n, i.file_size, i.CRC, i.compress_type, zip_member(z, i) if content else None)
    else:
        with tarfile.open(fileobj=source) as t:
            for m in t:
                if m.isfile() and (n := clean_name(m.name)) and n not in found:
                    found[n] = (archive, n, m.size, zlib.crc32(f"{n}:{m.offset_data}:{m.size}".encode()), 0, t.extractfile(m).read() if content else None)
    return [found[n] for n in sorted(found)]


#: Stores that a task can read parts of files from by itself.
SEEKABLE = ("file", "s3", "s3a", "hdfs", "gs", "abfs", "abfss")


def seekable(path: str) -> bool:
    return path.split(":", 1)[0] in SEEKABLE


def opened(path: str) -> BinaryIO:
    """A file in one of these stores; what is read of it is what is asked for."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1) if not path.startswith("file:") else "file://" + re.sub("^file:/*", "/", path))
    return store.open_input_file(name)


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of files; content is null, and not read, where a task can open the file itself."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    first = files.select("path").first()
    return files.select("path", F.lit(None).cast("binary").alias("content") if first and seekable(first.path) else F.col("content"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each member of the archives at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("archive", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("crc32", pa.int64()), ("method", pa.int32()), ("content", pa.binary())])
        for batch in batches:
            for archive, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(archive) if data is None else io.BytesIO(data) as source:
                    rows = members_of(archive, source)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

    return listed(spark, path).mapInArrow(run, MEMBERS)


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(folder)``: the members of the archives in a
    folder, a partition for each archive. Register it with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri("file://" + re.sub("^file:/*", "/", self.path) if self.path.startswith(("file:", "/")) else self.path)
        scheme = self.path.split(":", 1)[0] if ":" in self.path else "file"
        files = store.get_file_info(fs.FileSelector(name))
        return [InputPartition(f"{scheme}://{f.path}") for f in sorted(files, key=lambda f: f.path) if f.is_file and not f.base_name.startswith((".", "_"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with opened(partition.value) as source:
            yield from members_of(partition.value, source)


class ArchiveEntries:
    """The members of an archive without their content, as a table function: one row each."""

    def eval(self, path: str) -> Iterator[tuple]:
        with opened(path) as source:
            for _, name, size, crc32, method, _ in members_of(path, source, content=False):
                yield name, size, crc32, method


def archive_entries(spark: SparkSession) -> None:
    """Registers the table function ``archive_entries(path)`` for SQL."""
    spark.udtf.register("archive_entries", F.udtf(ArchiveEntries, returnType="name string, size long, crc32 long, method int"))


def write_binary(spark: SparkSession, path: str, data: bytes) -> None:
    """A file in any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(data)
    out.close()


def stored_archives(spark: SparkSession) -> str:
    """A folder with a ZIP (deflated, stored, Zstandard, ZIP64, unsafe names) and a TAR with a long name."""
    import zstandard

    root, z, t = folder(spark), io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        for n, data in (("y.txt", "abc"), ("d/x.txt", "hello"), ("../evil", "no"), ("d/", "")):
            f.writestr(n, data)
        with f.open(zipfile.ZipInfo("big64.txt"), "w", force_zip64=True) as m:
            m.write(b"sixty-four")
        packed = zipfile.ZipInfo("z.zst.txt")
        body, raw = zstandard.ZstdCompressor().compress(b"packed by zstd"), b"packed by zstd"
        f.writestr(packed, body)  # stored, then its headers say what it is
        packed.compress_type, packed.file_size, packed.CRC = ZSTD, len(raw), zlib.crc32(raw)
    with tarfile.open(fileobj=t, mode="w", format=tarfile.PAX_FORMAT) as f:
        for name, data in (("t.txt", b"data"), ("deep/" * 30 + "long-" + "n" * 120 + ".txt", b"longer")):
            i = tarfile.TarInfo(name)
            i.size = len(data)
            f.addfile(i, io.BytesIO(data))
    write_binary(spark, f"{root}/a.zip", z.getvalue())
    write_binary(spark, f"{root}/b.tar", t.getvalue())
    return root


_MEMBERS = "('a.zip', 'big64.txt', 10, md5('sixty-four')), ('a.zip', 'd/x.txt', 5, md5('hello')), ('a.zip', 'y.txt', 3, md5('abc')), ('a.zip', 'z.zst.txt', 14, md5('packed by zstd')), ('b.tar', 't.txt', 4, md5('data')), ('b.tar', repeat('deep/', 30) || 'long-' || repeat('n', 120) || '.txt', 6, md5('longer'))"


@query(f"SELECT * FROM (VALUES {_MEMBERS}) v(archive, name, size, md5)")
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of archives (SC19, SC20, SC22)."""
    rows = read_archives(spark, stored_archives(spark))
    return rows.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "name", F.col("size").cast("int").alias("size"), F.md5("content").alias("md5"))


@query(f"SELECT archive, count(*) AS members, CAST(sum(size) AS BIGINT) AS bytes FROM (VALUES {_MEMBERS}) v(archive, name, size, md5) GROUP BY archive")
def archive_listing(spark: SparkSession, d: str) -> DataFrame:
    """Archives and what they hold, by a table function; no member is read (SC19, OB11)."""
    archive_entries(spark)
    files = spark.read.format("binaryFile").load(stored_archives(spark)).select("path")
    rows = spark.sql("SELECT element_at(split(path, '/'), -1) AS archive, e.size FROM {files}, LATERAL archive_entries(path) e", files=files)
    return rows.groupBy("archive").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"))


#: The magic numbers of a skippable frame that holds a seek table, and of the table's end.
SKIPPABLE, SEEK_END = 0x184D2A5E, 0x8F92EAB1


def seekable_zstd(parts: list[bytes]) -> bytes:
    """Frames of ``parts`` and a table of their sizes at the end."""
    import zstandard

    frames = [zstandard.ZstdCompressor().compress(p) for p in parts]
    entries = b"".join(struct.pack("<II", len(f), len(p)) for f, p in zip(frames, parts, strict=True))
    end = struct.pack("<IBI", len(parts), 0, SEEK_END)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(end)) + entries + end


def seek_table(source: BinaryIO) -> list[tuple[int, int, int, int]]:
    """(place, size, first byte, bytes) of each frame, read from the file's end alone; empty if it has no table."""
    size = source.seek(0, 2)
    if size < 17:
        return []
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    each = 12 if flags & 0x80 else 8
    whole = n * each + 17
    if magic != SEEK_END or whole > size:
        return []
    source.seek(size - whole)
    head, body = source.read(8), source.read(n * each)
    if struct.unpack("<II", head) != (SKIPPABLE, n * each + 9):
        return []
    out, at, first = [], 0, 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", body, k * each)
        out.append((at, packed, first, plain))
        at, first = at + packed, first + plain
    return out if at + whole == size else []


def frames_of(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, place, size, first, bytes of all frames of seekable files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("frame", "place", "size", "first", "bytes")
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(name) if data is None else io.BytesIO(data) as source:
                    rows = [(k, *f) for k, f in enumerate(seek_table(source))]
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(rows), pa.string())} | {c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)})

    return listed(spark, path).mapInArrow(run, "file string, frame long, place long, size long, first long, bytes long")


def read_span(frames: DataFrame, start: int, end: int) -> DataFrame:
    """file, part: the bytes ``start`` to ``end`` (excluded) of each file's content. Only frames that meet them are read and unpacked."""
    met = frames.filter((F.col("first") < end) & (F.col("first") + F.col("bytes") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            parts = []
            for name, place, size, first in zip(*(batch.column(c).to_pylist() for c in ("file", "place", "size", "first")), strict=True):
                with opened(name) as source:
                    source.seek(place)
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(source.read(size))
                parts.append(data[max(0, start - first) : max(0, end - first)])
            yield pa.RecordBatch.from_pydict({"file": batch.column("file"), "frame": batch.column("frame"), "part": pa.array(parts, pa.binary())})

    rows = met.select("file", "frame", "place", "size", "first").mapInArrow(run, "file string, frame long, part binary")
    whole = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("frame", "part"))).alias("p"))  # of one asked span
    return whole.select("file", F.aggregate(F.col("p.part"), F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x)).alias("part"))


@query("""SELECT 20::BIGINT AS frames, 40000::BIGINT AS bytes, md5(substr(string_agg(repeat(chr(97 + (i % 26)::INT), 2000), '' ORDER BY i), 3001, 5000)) AS md5 FROM range(20) t(i)""")
def zstd_range(spark: SparkSession, d: str) -> DataFrame:
    """A range of a seekable Zstandard file by its table of frames (SC21, X20)."""
    root = folder(spark)
    write_binary(spark, f"{root}/s.zst", seekable_zstd([bytes([97 + i % 26]) * 2000 for i in range(20)]))
    frames = frames_of(spark, f"{root}/s.zst")
    sums = frames.agg(F.count(F.lit(1)).alias("frames"), F.sum("bytes").alias("bytes"))
    return sums.crossJoin(read_span(frames, 3000, 8000).select(F.md5("part").alias("md5")))  # one file


@query("SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table as CSV with a header, read by its schema (SC23)."""
    root = folder(spark)
    nation = table(spark, d, "nation")
    nation.write.option("header", True).csv(f"{root}/nation")
    rows = spark.read.schema(nation.schema).option("header", True).csv(f"{root}/nation")
    return rows.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT o_orderstatus AS part, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def glob_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of a pattern, with the folder that each row is from (SC23)."""
    root = folder(spark)
    table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s")).write.partitionBy("s").parquet(f"{root}/parts")
    rows = spark.read.parquet(f"{root}/parts/s=[FO]")
    return rows.groupBy(F.regexp_extract(F.input_file_name(), "/s=([A-Z])/", 1).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query()
def binary_files(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{d}/nation.parquet").select("length", F.md5("content").alias("md5"))


@query()
def files_meta(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("_metadata.file_path", "_metadata.file_size")
    return rows.groupBy("file_path").agg(F.first("file_size").alias("size"), F.count(F.lit(1)).alias("rows"))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """file, row_group, rows, columns, compression of Parquet files. Only their ends are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(name) if data is None else io.BytesIO(data) as source:
                    m = pq.read_metadata(source)
                groups = [m.row_group(i) for i in range(m.num_row_groups)]
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([name] * len(groups), pa.string()), "row_group": pa.array(range(len(groups)), pa.int32()), "rows": pa.array([g.num_rows for g in groups], pa.int64()),
                    "columns": pa.array([g.num_columns for g in groups], pa.int32()), "compression": pa.array([g.column(0).compression for g in groups], pa.string()),
                })

    return listed(spark, path, "*.parquet").mapInArrow(run, "file string, row_group int, rows long, columns int, compression string")


@query("SELECT count(*) AS rows FROM orders")
def parquet_rows(spark: SparkSession, d: str) -> DataFrame:
    """The number of rows that the footers of a table's files name (SC24)."""
    return footers(spark, f"{d}/orders.parquet").agg(F.sum("rows").alias("rows"))


@query()
def parquet_meta(spark: SparkSession, d: str) -> DataFrame:
    return footers(spark, f"{d}/orders.parquet")
