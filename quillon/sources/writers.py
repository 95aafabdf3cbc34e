"""Writing tables: units in column metadata, tidy JSON results, restartable chunk output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_units(df: DataFrame, units: Mapping[str, str]) -> DataFrame:
    return df.select(
        *[F.col(c).alias(c, metadata={"unit": units[c]}) if c in units else F.col(c) for c in df.columns]
    )


def write_table(df: DataFrame, path: str, units: Mapping[str, str] | None = None, mode: str = "overwrite") -> None:
    """Parquet keeps the column metadata, so units travel with the file."""
    with_units(df, units or {}).write.mode(mode).parquet(path)


def read_units(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["unit"] for f in df.schema.fields if "unit" in (f.metadata or {})}


def tidy(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Numeric result columns as rows (keys..., metric, value), every number coerced to double."""
    keys = list(keys)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in keys]
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.metric", "_p.value")


def write_json(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    tidy(df, keys).write.mode("overwrite").json(path)


def write_chunks(df: DataFrame, path: str, chunk_col: str) -> None:
    """Partition overwrite keyed by chunk: re-running a chunk replaces only that chunk."""
    (
        df.repartition(chunk_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(chunk_col).parquet(path)
    )
