"""Checksums and the codec of stored blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.bytes import coded, crc32c, crc64nvme
from ..registry import query, table


@query()
def checksums_wide(spark: SparkSession, d: str) -> DataFrame:
    """CRC32C and CRC64NVME of every text, in hex digits."""
    small_batches(spark)
    data = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", crc32c(data).alias("crc32c"), crc64nvme(data).alias("crc64nvme"))


@query("SELECT doc_id, octet_length(encode(text)) AS size, true AS same, true AS no_larger FROM documents")
def block_codec(spark: SparkSession, d: str) -> DataFrame:
    """Every text goes through the codec and comes back."""
    return coded(table(spark, d, "documents"), "doc_id", "text")
