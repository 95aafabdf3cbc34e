"""Restartable incremental work as Structured Streaming and idempotent chunk output."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import spatial
from quillon.runtime import cut_lineage, discard
from quillon.sources import writers

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MEMORY = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


@contextmanager
def _state_on_disk(spark: SparkSession):
    """Keep keyed state in RocksDB unless the session names a provider: the finished ids need not fit the executors' memory."""
    chosen = spark.conf.get(PROVIDER, None)
    if chosen in (None, MEMORY):
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, chosen or MEMORY)


def run_incremental(
    spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame],
    result_schema: T.StructType, files_per_batch: int = 1, expiry: str | None = None,
) -> DataFrame:
    """Process new files of a folder, each key once, and append each batch's result.

    Finished keys live in the stream's keyed state store, so a batch looks up its own keys only: its cost follows the batch, not the output. With an
    ``expiry`` ('30 days') a key is kept for that long after its batch and forgotten once a later batch than that is done; it is then taken again if it comes
    again. Without one it is kept for good. Marks are the batches' own times, so no row counts as late. The checkpoint holds finished files and keys together: a batch that is replayed after a
    failure sees the same keys and overwrites its own partition. State and output belong together; a new checkpoint needs a new output.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        work(batch.select(*schema.names)).select(*result_schema.names).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    if expiry is None:
        fresh = stream.dropDuplicates([key])
    else:
        fresh = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", expiry).dropDuplicatesWithinWatermark([key])
    with _state_on_disk(spark):
        q = fresh.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return _read_or_empty(spark, out, result_schema)


def incremental_match(
    spark: SparkSession, source: str, schema: T.StructType, refs: DataFrame, out: str, checkpoint: str, target_id: str, ref_id: str, radius_arcsec: float,
    keep_all: bool = False, expiry: str | None = None,
) -> DataFrame:
    """Sky matching of arriving target files, each target once. Unmatched targets leave a marker row with a NULL reference."""
    result = T.StructType([schema[target_id], refs.schema[ref_id], T.StructField("sep", T.DoubleType())])

    def work(fresh: DataFrame) -> DataFrame:
        if keep_all:
            return spatial.sky_all(fresh, refs, target_id, ref_id, radius_arcsec)
        return spatial.sky_nearest(fresh, refs, target_id, ref_id, radius_arcsec, keep_unmatched=True)

    return run_incremental(spark, source, schema, out, checkpoint, target_id, work, result, expiry=expiry)


def _beyond(source: DataFrame, mark: str, key: str, last) -> DataFrame:
    """Rows after the compound mark (mark, key); rows that share the mark are told apart by the key. Rows with a NULL mark or key never come."""
    rows = source.where(F.col(mark).isNotNull() & F.col(key).isNotNull())
    if last is None:
        return rows
    m, k = F.lit(last[0]), F.lit(last[1])
    return rows.where((F.col(mark) > m) | ((F.col(mark) == m) & (F.col(key) > k)))


def continue_from(source: DataFrame, done: DataFrame, mark: str, target: int, key: str | None = None) -> DataFrame:
    """Next rows after the output's high-water mark, in (mark, key) order, up to the number still missing.

    ``key`` makes rows of one mark distinct (the mark itself, if it is unique); a cut among equal marks loses none of them.
    """
    key = key or mark
    top = done.agg(F.max(F.struct(mark, F.col(key).alias("_key"))).alias("last"), F.count(F.lit(1)).alias("n")).first()
    return _beyond(source, mark, key, top["last"]).orderBy(mark, key).limit(max(0, target - top["n"]))


def run_marked(source: DataFrame, out: str, mark: str, key: str, target: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Take the next rows in (mark, key) order up to ``target`` in all, append the work's result, and return the whole output.

    A one-row table beside the output keeps the mark, the number of rows taken and the run's number, so a run never reads what earlier runs
    wrote. The result is written to a partition of its own run before the row moves on: a run that broke off in between is repeated and replaces itself.
    """
    spark = source.sparkSession
    state = T.StructType([T.StructField("run", T.LongType()), T.StructField("taken", T.LongType()), source.schema[mark], T.StructField("_key", source.schema[key].dataType)])
    steps = sorted(_runs(spark, f"{out}/_marks"))
    now = spark.read.schema(state).parquet(f"{out}/_marks/run={steps[-1]}").first() if steps else None
    taken, run = (now["taken"], steps[-1]) if now else (0, 0)
    if target > taken:
        rows = cut_lineage(_beyond(source, mark, key, (now[mark], now["_key"]) if now else None).orderBy(mark, key).limit(target - taken))
        top = rows.agg(F.max(F.struct(F.col(mark), F.col(key).alias("_key"))).alias("last"), F.count(F.lit(1)).alias("n")).first()
        if top["n"]:
            work(rows).write.mode("overwrite").parquet(f"{out}/run={run + 1}")
            row = [(run + 1, taken + top["n"], top["last"][0], top["last"][1])]
            spark.createDataFrame(row, state).coalesce(1).write.mode("overwrite").parquet(f"{out}/_marks/run={run + 1}")
        discard(rows)
    return spark.read.parquet(out) if run or _runs(spark, out) else source.limit(0)


def _runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs whose output is committed."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    found = [int(n[4:]) for n in names if n.startswith("run=")]
    return [n for n in found if fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f"{path}/run={n}/_SUCCESS"))]


def run_chunks(df: DataFrame, chunk_col: str, work: Callable[[DataFrame], DataFrame], path: str, key: Sequence[str]) -> DataFrame:
    """Process only chunks without output yet, store them by chunk, and return all of them in key order."""
    spark = df.sparkSession
    try:
        finished = spark.read.parquet(path).select(chunk_col).distinct()
        todo = df.join(finished, chunk_col, "left_anti")
    except AnalysisException:
        todo = df
    if not todo.isEmpty():
        writers.write_chunks(work(todo), path, chunk_col)
    return spark.read.parquet(path).orderBy(*key)
