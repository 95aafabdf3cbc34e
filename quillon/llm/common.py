"""What the operators of this subpackage share: stored tables, seeded draws, row keys and byte-bounded batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import checkpoint_dir, tidy

# Bytes of text that one numpy step works on: small enough for the processor's cache, whatever the row count.
SLICE_BYTES = 1 << 18


class Shelf:
    """Tables stored in the shared folder, so that a lost executor never loses more than its running tasks.

    ``put`` writes a table and reads it back, and the shuffle files of that write go with its end; ``drop`` deletes one that no later step reads; ``folder`` names a new
    folder for files that tasks write themselves.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/llm-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def put(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.folder(name)
        with tidy(self.spark):
            df.select("*").write.parquet(path)  # a new plan, made under the setting
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(stored)] = (stored, path)
        return stored

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                self.remove(path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from ``taken``; Spark does not tell upper from lower case."""
    lower, out = {t.lower() for t in taken}, []
    for n in names:
        while n in lower:
            n += "_"
        out.append(n)
    return out


def remainder(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def draw(seed, *columns: str) -> Column:
    """Uniform double in [0, 1) with 52 bits from md5 of the seed and the columns as text (a null as 'null')."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def row_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Each batch with a number per row that is unique over all tasks (stable once the result is stored)."""
    at = TaskContext.get().partitionId() << 40
    for batch in batches:
        yield np.arange(at, at + batch.num_rows, dtype=np.int64), batch
        at += batch.num_rows


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and its offsets; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (data[:0], np.zeros(1, np.int64))


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def local_rows(df: DataFrame, most: int) -> list:
    """Collect a table whose size the caller has bounded; refuse if the bound does not hold."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a table that must stay small")
    return rows
