"""Helpers shared by the operators of this subpackage.

Rows without a ``doc_id`` are ordered after all others (``LAST_ID``), so they
can repeat another document but never be the earlier one.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import ensure_checkpoint_dir

LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (bigint) and ``text`` (null: empty), whatever else the table holds."""
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def order_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(LAST_ID))


def whole_row(docs: DataFrame, names: list[str] | None = None) -> Column:
    """All (or the named) columns as one struct ``__tw_row``: names with dots or clashes stay out of the way."""
    return F.struct(*(docs["`" + c.replace("`", "``") + "`"] for c in names or docs.columns)).alias("__tw_row")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def reliable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared checkpoint folder: a fraction of a checkpoint's size for wide rows."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What empties the caches of this Python worker.
FORGET: list[Callable[[], None]] = []


def forget() -> None:
    """Drops what a task has learned and gives the memory back, as a Python worker outlives its tasks and stages."""
    for clear in FORGET:
        clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def forgetting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as the function of a task: with its last batch the worker forgets what it has learned."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
    return task


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to ``limit`` words."""

    limit = 600_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


WORD_HASHES = WordHashes()
FORGET.append(WORD_HASHES.clear)
