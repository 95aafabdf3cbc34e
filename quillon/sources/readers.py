"""Reading tables: projections, fallbacks, aligned sets, catalogue extracts and shards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import runtime
from quillon.functions import vectors


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def first_readable(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """First of several candidate locations that holds a readable table."""
    errors = []
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as ex:
            errors.append(f"{path}: {str(ex).splitlines()[0]}")
    raise FileNotFoundError("no readable source: " + "; ".join(errors))


def resolve_columns(df: DataFrame, candidates: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> dict:
    """Map each wanted name to the first candidate present in the table, ignoring case."""
    present = {c.lower(): c for c in df.columns}
    found = {
        want: next((present[c.lower()] for c in names if c.lower() in present), None)
        for want, names in candidates.items()
    }
    missing = [w for w in required if found.get(w) is None]
    if missing:
        raise KeyError(f"no candidate column for {missing} in {df.columns}")
    return found


def select_resolved(df: DataFrame, candidates: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """The wanted columns under their wanted names; an optional column without a candidate becomes NULL."""
    found = resolve_columns(df, candidates, required)
    return df.select(*[(F.col(src) if src else F.lit(None).cast("double")).alias(w) for w, src in found.items()])


def aligned_set(base: DataFrame, key: str, sides: Sequence[DataFrame], verify: bool = True) -> DataFrame:
    """Left-join side tables, one row each per key, onto the base table; the row count must not change."""
    out = base
    for side in sides:
        out = out.join(side.dropDuplicates([key]), key, "left")
    if verify:
        before, after = base.count(), out.count()
        if before != after:
            raise ValueError(f"alignment changed the row count from {before} to {after}")
    return out


def extract(
    df: DataFrame,
    keep: Column,
    columns: Sequence[str],
    scaled: Mapping[str, float] | None = None,
    flatten: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Filter a catalogue, scale units and flatten small vector columns into named scalars.

    The row index of the source must be one of ``columns``: it is stored data, never generated at read time.
    """
    out = [F.col(c) for c in columns]
    out += [(F.col(c).cast("double") * F.lit(f)).alias(c) for c, f in (scaled or {}).items()]
    for c, names in (flatten or {}).items():
        out += [F.element_at(c, i + 1).cast("double").alias(n) for i, n in enumerate(names)]
    return df.where(keep).select(*out)


def shard_of(row_index, n_rows, shards: int) -> Column:
    """Shard s holds the rows [s*N//T, (s+1)*N//T) of a stored row index."""
    i = F.col(row_index) if isinstance(row_index, str) else row_index
    n = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    # Row i lies in the last shard whose start floor(s*N/T) is <= i: s = ceil((i+1)*T/N) - 1.
    return (F.ceil((i + 1) * F.lit(shards) / n) - 1).cast("int")


def shard_report(found: DataFrame, shard_col: str, expected: int) -> DataFrame:
    """Rows present per expected shard; a missing shard is reported with zero rows."""
    spark = found.sparkSession
    counts = found.groupBy(shard_col).agg(F.count(F.lit(1)).alias("n_rows"))
    spine = spark.range(expected).select(F.col("id").cast("int").alias(shard_col))
    return spine.join(counts, shard_col, "left").select(
        shard_col,
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        F.col("n_rows").isNull().alias("missing"),
    )


def gather_shards(spark: SparkSession, root: str, shard_col: str, expected: int) -> tuple[DataFrame, DataFrame]:
    """All shard files under a root as one table, with the report of missing shards."""
    df = spark.read.parquet(root)
    return df, shard_report(df, shard_col, expected)


def status_of(values) -> Column:
    """1 when any element is non-zero, else 2."""
    return F.when(F.exists(vectors.as_double(values), lambda x: x != 0), F.lit(1)).otherwise(F.lit(2))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh location in the shared folder for tables a query has to write."""
    import uuid

    return f"{runtime.checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
