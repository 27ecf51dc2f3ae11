"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one Arrow batch: bounds what a Python worker holds at once when texts are long.
BATCH_ROWS = 4000
# Places of a one-hash filter, and how many of them one row of Spark's bitmap functions covers
BITMAP_BITS, BITMAP_PART = 1 << 22, 32_768
# White space of the word rules: space and tab to carriage return. ``bytes.split`` splits on exactly these.
WORDS = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession, batch_rows: int = BATCH_ROWS) -> SparkSession:
    """Session settings the operators rely on: small Arrow batches, so long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    return spark


def give_back_memory() -> None:
    """Return what this worker has freed to the system: it lives on, and its allocators would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, which at the end of a task gives back what it has freed: later stages in the same worker need the memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back_memory()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Partitions of an explicit layout: what the session uses for its shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def narrowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), so further columns of any name cannot clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` and, as ``row``, each whole row of ``docs``: whatever its columns are called, they cannot clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[column.alias(name) for name, column in columns.items()])


def remainder(key: str, n: int) -> Column:
    """crc32 of a key written as text, modulo n: the fixed folds of the held-out rows."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(n)


def byte_list(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def seen_bitmap(values: DataFrame, column: str) -> dict[int, bytes]:
    """A one-hash filter of ``column``: BITMAP_BITS bits at most, however many rows there are; it may pass values that are not there."""
    spot = F.lit(1) + bitmap_spot(column)
    rows = values.select(F.bitmap_bucket_number(spot).alias("part"), F.bitmap_bit_position(spot).alias("bit"))
    return {row.part: bytes(row.bits) for row in rows.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()}


def bitmap_spot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))


def in_bitmap(bitmap: dict[int, bytes], spot: int) -> bool:
    """Whether the place of a value, its ``bitmap_spot``, is marked."""
    part, bit = divmod(spot, BITMAP_PART)
    bits = bitmap.get(part + 1)  # Spark counts the parts of positive numbers from 1
    return bits is not None and bool(bits[bit // 8] >> (bit % 8) & 1)


def words_of(text: bytes) -> list[bytes]:
    """Words between white space, A-Z in lower case (bytes.lower leaves all other code points alone)."""
    return text.lower().split()


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))
