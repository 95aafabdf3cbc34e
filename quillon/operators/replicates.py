"""Replicate matrices: hashed weights of a block of rows for all replicates at once, multiplied with the rows' statistics inside the task.

A row is never copied per replicate. A weight depends on (seed, replicate, key) alone, so a retried task makes the same matrix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import runtime
from quillon.functions import hashing
from quillon.operators import ranking

# Rows whose weights are made at once, and partial sums that a task holds before it passes them on.
BLOCK = 1024
HELD = 1 << 21
# Ranges that a group's values are cut into, and the values of one range that a task sorts.
GRID = 1000
SORTED = 20_000
POISSON = np.array(hashing.POISSON1_CDF)


def poisson(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts of hashes: the weights of a bootstrap."""
    return np.searchsorted(POISSON, u / hashing.SPAN, side="right").astype(np.float64)


def positive(u: np.ndarray) -> np.ndarray:
    """One where a hashed sign is plus."""
    return (u % 2 == 0).astype(np.float64)


def negative(u: np.ndarray) -> np.ndarray:
    return (u % 2 == 1).astype(np.float64)


def hashes(seed, reps: Sequence[int], keys: Sequence[str | None]) -> np.ndarray:
    """hash32(seed, replicate, key) of every key (row) and replicate (column)."""
    md5, out = hashlib.md5, np.empty((len(keys), len(reps)), np.float64)
    tails = [b"" if k is None else b":" + k.encode() for k in keys]
    for j, rep in enumerate(reps):
        head = f"{seed}:{rep}".encode()
        digests = b"".join([md5(head + t, usedforsecurity=False).digest() for t in tails])
        out[:, j] = np.frombuffer(digests, ">u4")[::4]
    return out


def _groups(batch: pa.RecordBatch, by: Sequence[str]) -> tuple[np.ndarray, pa.RecordBatch]:
    """Group number of every row, and one row of key columns per group."""
    codes = np.zeros(batch.num_rows, np.int64)
    for c in by:
        e = batch.column(c).dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * max(1, len(e.dictionary)) + e.indices.to_numpy(), return_inverse=True)[1]
    _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    return inverse, batch.select(list(by)).take(pa.array(first))


def _weighted(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of w * x per replicate and statistic; values that are not finite count only where their weight is not zero."""
    fine = np.isfinite(x)
    out = w.T @ np.where(fine, x, 0.0)
    for i, j in zip(*np.nonzero(~fine)):
        out[:, j] += np.where(w[i] > 0, x[i, j], 0.0)
    return out


def replicate_sums(df: DataFrame, key: str, sums: Sequence[Column], n_boot: int, seed, by: Sequence[str] = (), weigh: Column | None = None) -> DataFrame:
    """(by, rep, w, s0, s1, ...): total weight and weighted sums of the columns per group and replicate; replicates without weight have no row.

    NULL values count nowhere, and a sum of none is NULL. ``weigh`` names the kind of weight per row ('poisson', the default, 'positive' or
    'negative'). A task emits one row per group and replicate whenever it holds HELD numbers, and at its end; Spark adds these up.
    """
    by, m = list(by), len(sums)
    src = df.select(*by, F.col(key).cast("string").alias("_key"), (F.lit("poisson") if weigh is None else weigh).alias("_kind"), *[c.cast("double").alias(f"_s{i}") for i, c in enumerate(sums)])
    numbers = ["w", *[f"s{i}" for i in range(m)], *[f"c{i}" for i in range(m)]]
    schema = T.StructType([df.schema[c] for c in by] + [T.StructField("rep", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in numbers])
    reps = list(range(n_boot))

    def emit(held: dict, types: list) -> Iterator[pa.RecordBatch]:
        for k, total in held.items():
            keys = [pa.array([v] * n_boot, type=t) for v, t in zip(k, types)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(reps, pa.int32()), *[pa.array(total[:, i]) for i in range(total.shape[1])]], names=[*by, "rep", *numbers])

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        types: list = []
        for whole in batches:
            types = [whole.schema.field(c).type for c in by]
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                w = weights(seed, reps, b.column("_key").to_pylist(), b.column("_kind"))
                codes, keys = _groups(b, by)
                x = np.empty((b.num_rows, m))
                there = np.empty((b.num_rows, m))
                for i in range(m):
                    c = b.column(f"_s{i}")
                    there[:, i] = c.is_valid().to_numpy(zero_copy_only=False)
                    x[:, i] = pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                cuts = np.searchsorted(codes[order], np.arange(keys.num_rows + 1) if by else [0, b.num_rows])
                names = list(zip(*[keys.column(c).to_pylist() for c in by])) if by else [()]
                for k, low, high in zip(names, cuts, cuts[1:]):
                    part = order[low:high]
                    wp = w[part]
                    total = np.column_stack([wp.sum(0), _weighted(wp, x[part]), wp.T @ there[part]])
                    held[k] = held[k] + total if k in held else total
                if len(held) * n_boot * (1 + 2 * m) > HELD:
                    yield from emit(held, types)
                    held = {}
        yield from emit(held, types)

    parts = runtime.spread(src).mapInArrow(run, schema)
    total = [F.when(F.sum(f"c{i}") > 0, F.sum(f"s{i}")).alias(f"s{i}") for i in range(m)]
    return parts.groupBy(*by, "rep").agg(F.sum("w").alias("w"), *total).where(F.col("w") > 0)


def weights(seed, reps: Sequence[int], keys: Sequence[str | None], kinds: pa.Array) -> np.ndarray:
    """Weight of every key (row) in every replicate (column), by the row's kind of weight."""
    u, kind = hashes(seed, reps, keys), kinds.to_numpy(zero_copy_only=False)
    out = np.empty_like(u)
    for name, fn in (("poisson", poisson), ("positive", positive), ("negative", negative)):
        mine = kind == name
        if mine.all():
            return fn(u)
        out[mine] = fn(u[mine])
    return out


def replicate_quantile(df: DataFrame, key: str, value: str, prob: float, n_boot: int, seed, by: Sequence[str] = (), weigh: Column | None = None) -> DataFrame:
    """(by, rep, value): the exact linear-interpolated percentile of the weighted values in every replicate.

    Values are cut into ranges at sketched percentiles, close together where the percentile can fall; the sketch's own points are ranges of one value.
    Weights per (group, range, replicate) tell which range holds the wanted ranks. Ranges with more than SORTED rows are cut again; then each is sorted
    in one task and the ranks are read off. Ranges cover the whole line, so the result does not depend on the sketch. NULL values are left out; NaN is the largest.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(key).cast("string").alias("_key"), F.col(value).cast("double").alias("_v"), (F.lit("poisson") if weigh is None else weigh).alias("_kind"), F.lit(0).cast("long").alias("_path"))
    groups, wanted, found, level = [*by, "_path"], None, [], 0
    if (rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= SORTED:
        return _ends(_sorted_whole(rows, by, prob, n_boot, seed), by, value)
    while True:
        edges = runtime.cut_lineage(_range_edges(rows, groups, prob if wanted is None else None))
        known = ranking.null_safe_join(rows, edges, groups)
        n_edges, first, last = F.size("_e"), F.get("_e", F.lit(0)), F.get("_e", F.size("_e") - 1)
        below = F.size(F.filter("_e", lambda e: e < F.col("_v")))
        spot = F.when((n_edges == 0) | (F.col("_v") < first), F.lit(0)).when(F.col("_v") > last, 2 * n_edges).otherwise(2 * below + F.array_contains("_e", F.col("_v")).cast("int"))
        known = known.withColumn("_bin", spot)
        table = replicate_sums(known, "_key", [], n_boot, seed, [*groups, "_bin"], F.col("_kind"))
        over = Window.partitionBy(*groups, "rep")
        before = F.coalesce(F.sum("w").over(over.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        table = table.select("*", before.alias("_before"), (F.lit(float(prob)) * (F.sum("w").over(over) - 1)).alias("_whole"))
        if wanted is None:
            table = runtime.cut_lineage(table.withColumnRenamed("_whole", "_pos"))
            sides = [table.withColumns({"_side": F.lit(i), "_at": fn("_pos").cast("double")}) for i, fn in enumerate((F.floor, F.ceil))]
            asked = sides[0].union(sides[1])
        else:
            asked = ranking.null_safe_join(table, wanted, [*groups, "rep"])
        asked = asked.where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("w")))
        value_of = F.when(F.col("_bin") % 2 == 1, F.get("_e", F.expr("(_bin - 1) div 2").cast("int")))
        hit = ranking.null_safe_join(asked, edges, groups).select(*groups, "rep", "_side", "_pos", "_bin", (F.col("_at") - F.col("_before")).alias("_at"), value_of.alias("_found"))
        hit = runtime.cut_lineage(hit)
        found.append(hit.where("_found is not null").select(*by, "rep", "_side", "_pos", "_found"))
        left = hit.where("_found is null")
        path = F.col("_path") * (2 * GRID + 3) + F.col("_bin")
        keep = left.select(*groups, "_bin").distinct()
        rows = ranking.null_safe_join(known.select(*rows.columns, "_bin"), keep, [*groups, "_bin"], "left_semi").withColumn("_path", path).drop("_bin")
        rows = runtime.cut_lineage(rows)
        wanted = left.withColumn("_path", path).drop("_bin", "_found")
        level += 1
        largest = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= SORTED or level >= 5:
            break
    found.append(_sorted_ranks(rows, wanted, groups, by, seed))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return _ends(out, by, value)


def _ends(found: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Interpolate between the values below and above the wanted position."""
    ends = found.groupBy(*by, "rep").agg(F.max("_pos").alias("_pos"), *[F.max(F.when(F.col("_side") == i, F.col("_found"))).alias(f"_v{i}") for i in (0, 1)])
    return ends.select(*by, "rep", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_pos") - F.floor("_pos"))).alias(value))


def _range_edges(rows: DataFrame, groups: Sequence[str], prob: float | None) -> DataFrame:
    """Distinct sketched percentiles per group; with ``prob`` only those that its replicates can reach (eight deviations), else all."""
    v = F.when(~F.isnan("_v"), F.col("_v"))
    s = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(v, [i / GRID for i in range(GRID + 1)], ranking.SKETCH).alias("_g"))
    if prob is not None:
        reach = 4 / F.sqrt("_n") + 4 / GRID
        low = F.greatest(F.lit(0), F.floor((F.lit(float(prob)) - reach) * GRID)).cast("int")
        high = F.least(F.lit(GRID), F.ceil((F.lit(float(prob)) + reach) * GRID)).cast("int")
        s = s.withColumn("_g", F.slice("_g", low + 1, high - low + 1))
    return s.select(*groups, F.array_distinct(F.coalesce("_g", F.array().cast("array<double>"))).alias("_e"))


def _sorted_ranks(rows: DataFrame, wanted: DataFrame, groups: Sequence[str], by: Sequence[str], seed) -> DataFrame:
    """Read the wanted ranks (_at) of every replicate out of the sorted rows of its range."""
    def read(values: pa.Table, asked: pa.Table) -> pa.Table:
        v = values.column("_v").to_numpy()
        order = np.argsort(v, kind="stable")
        reps, column = np.unique(asked.column("rep").to_numpy(), return_inverse=True)
        total = np.cumsum(weights(seed, reps.tolist(), values.column("_key").to_pylist(), values.column("_kind").combine_chunks())[order], axis=0)
        got = np.array([v[order[np.searchsorted(total[:, c], a, side="right")]] for c, a in zip(column, asked.column("_at").to_numpy())])
        return asked.select([*by, "rep", "_side", "_pos"]).append_column("_found", pa.array(got, pa.float64()))

    return _tagged(rows, groups).cogroup(_tagged(wanted, groups)).applyInArrow(read, _found_schema(rows, by))


def _sorted_whole(rows: DataFrame, by: Sequence[str], prob: float, n_boot: int, seed) -> DataFrame:
    """Read the percentile of every replicate out of whole groups of at most SORTED rows."""

    def read(values: pa.Table) -> pa.Table:
        v = values.column("_v").to_numpy()
        order = np.argsort(v, kind="stable")
        total = np.cumsum(weights(seed, list(range(n_boot)), values.column("_key").to_pylist(), values.column("_kind").combine_chunks())[order], axis=0)
        reps = np.flatnonzero(total[-1] > 0)
        pos = prob * (total[-1, reps] - 1)
        out = []
        for side, at in enumerate((np.floor(pos), np.ceil(pos))):
            got = np.array([v[order[np.searchsorted(total[:, r], a, side="right")]] for r, a in zip(reps, at)], float)
            keys = {c: values.column(c).take(pa.array(np.zeros(len(reps), np.int64))) for c in by}
            out.append(pa.table({**keys, "rep": pa.array(reps, pa.int32()), "_side": pa.array(np.full(len(reps), side), pa.int32()), "_pos": pa.array(pos), "_found": pa.array(got)}))
        return pa.concat_tables(out)

    return _tagged(rows, by).applyInArrow(read, _found_schema(rows, by))


def _tagged(t: DataFrame, groups: Sequence[str]):
    """Group by the text of all keys: a NULL or NaN key is a group like any other."""
    return t.withColumn("_tag", F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(c).cast("string").alias(c) for c in groups]), {"ignoreNullFields": "false"})).groupBy("_tag")


def _found_schema(rows: DataFrame, by: Sequence[str]) -> T.StructType:
    return T.StructType([rows.schema[c] for c in by] + [T.StructField("rep", T.IntegerType()), T.StructField("_side", T.IntegerType()), T.StructField("_pos", T.DoubleType()), T.StructField("_found", T.DoubleType())])
