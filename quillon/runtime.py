"""Session set-up, table loading, lineage cutting and the size checks the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that one range of an ordered column aims at, and the most ranges whose edges are searched for.
RANGE_ROWS = 50_000
MOST_RANGES = 65_536
# Row bound for broadcasting a counted side. Override with spark.quillon.broadcastRows.
BROADCAST_ROWS = 100_000
# Applications whose executors have this package.
_SHIPPED: set[str] = set()
# Stored tables by identity, with the folder of each.
_STORED: dict[int, tuple[DataFrame, str]] = {}
# Whether Spark deletes the shuffle files of a query with its end, not when the driver's garbage is collected.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "quillon", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it from anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "quillon.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(folder):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(folder)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.quillon.broadcastRows", str(BROADCAST_ROWS)))


def bucket_count(rows: int, spark: SparkSession | None = None) -> int:
    """Ranges to cut an ordered column into: about RANGE_ROWS rows each (spark.quillon.rangeRows), one for a short column."""
    size = int(spark.conf.get("spark.quillon.rangeRows", str(RANGE_ROWS))) if spark else RANGE_ROWS
    return int(min(MOST_RANGES, max(1, -(-rows // size))))


def broadcast_checked(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only when the counted side is under the bound; otherwise leave the choice to Spark."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= broadcast_rows(df.sparkSession) else df


def spread(df: DataFrame) -> DataFrame:
    """Even out a table before its rows are multiplied many times over, so that the work uses every core."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned and run in here leave no shuffle files."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for a local session with nothing configured (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured and current is None:
        sc.setCheckpointDir(configured)
    elif current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return configured or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store the rows as a table in the shared folder and read them back.

    Lost executors cost nothing, the stored size is known to the optimizer, and iterative operators start every
    round from a plain scan (a checkpointed plan would carry its inferred constraints from round to round).
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _STORED[id(stored)] = (stored, path)
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` stored and that no later step reads."""
    for t in tables:
        _, path = _STORED.pop(id(t), (None, None))
        if path:
            sc = t.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
