"""Seeded draws: quotas per bin, one entry per chain, histogram-matched, importance-weighted, inverse-CDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import runtime
from quillon.functions import cosmology, hashing
from quillon.operators import joins, ranking


def quota_draw(df: DataFrame, key: str, bin_col: str, quotas: DataFrame | int, seed=0) -> DataFrame:
    """Up to ``quota`` rows per bin in seeded hash order. ``quotas`` is one number or a table (bin, quota)."""
    numbered = ranking.hash_order(df, key, seed, [bin_col])
    if isinstance(quotas, int):
        return numbered.where(F.col("rn") <= quotas).drop("rn")
    return numbered.join(runtime.broadcast_checked(quotas), bin_col).where(F.col("rn") <= F.col("quota")).drop("rn", "quota")


def draw_report(quotas: DataFrame, drawn: DataFrame, bin_col: str) -> DataFrame:
    """Wanted and drawn rows per bin with the share that could not be filled and its binomial interval."""
    got = drawn.groupBy(bin_col).agg(F.count(F.lit(1)).alias("n_drawn"))
    j = quotas.join(got, bin_col, "left").withColumn("n_drawn", F.coalesce("n_drawn", F.lit(0)).cast("long"))
    s = F.when(F.col("quota") > 0, 1 - F.col("n_drawn") / F.col("quota")).otherwise(F.lit(0.0))
    j = j.withColumn("starvation", s)
    half = 1.959963984540054 * F.sqrt(F.col("starvation") * (1 - F.col("starvation")) / F.greatest("quota", F.lit(1)))
    return j.withColumns({"ci_lo": F.greatest(F.col("starvation") - half, F.lit(0.0)), "ci_hi": F.least(F.col("starvation") + half, F.lit(1.0))})


def one_entry_draw(pools: DataFrame, key: str, bin_col: str, chain: str, quotas: Mapping, order: Sequence, seed=0) -> tuple[DataFrame, DataFrame]:
    """Draw bin by bin in the given order; a chain used by an earlier bin is out for the later ones.

    The loop runs over the short list of bins. Each step is an anti join of the pool and a quota draw, stored
    before the next one. Returns (drawn rows, report with the rows available to each bin).
    """
    spark = pools.sparkSession
    drawn, report = None, []
    for b in order:
        avail = pools.where(F.col(bin_col) == F.lit(b))
        if drawn is not None:
            avail = avail.join(drawn.select(chain), chain, "left_anti").select(*pools.columns)
        avail = runtime.cut_lineage(avail)
        n_avail = avail.count()
        pick = runtime.cut_lineage(ranking.sample_n(avail, key, int(quotas[b]), seed) if quotas[b] <= ranking.TAKE_ROWS else quota_draw(avail, key, bin_col, int(quotas[b]), seed))
        drawn = pick if drawn is None else runtime.cut_lineage(drawn.unionByName(pick))
        report.append((b, int(quotas[b]), n_avail))
    t = pools.schema[bin_col].dataType.simpleString()
    rep = spark.createDataFrame(report, f"{bin_col} {t}, quota long, n_avail long")
    return drawn, draw_report(rep, drawn, bin_col)


def histogram_target(df: DataFrame, value: str, lo: float, width: float, n_bins: int, scale: float, shift: float = 0.0) -> DataFrame:
    """Scaled target count per cell of a shifted value (half-even rounding, last edge closed): (cell, quota)."""
    x = F.col(value) + F.lit(shift)
    top = lo + n_bins * width
    cell = F.when(x == F.lit(top), F.lit(n_bins - 1)).otherwise(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"))
    inside = df.where((x >= lo) & (x <= top)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return inside.select("cell", F.bround(F.col("n") * F.lit(scale), 0).cast("long").alias("quota")).where(F.col("quota") > 0)


def histogram_matched_draw(pool: DataFrame, key: str, value: str, target: DataFrame, lo: float, width: float, seed=0) -> tuple[DataFrame, DataFrame]:
    """Draw to a target histogram (half-open cells on the pool side); the report lists the starved cells."""
    cell = F.floor((F.col(value) - F.lit(lo)) / F.lit(width)).cast("int")
    drawn = quota_draw(pool.withColumn("cell", cell), key, "cell", target, seed)
    got = drawn.groupBy("cell").agg(F.count(F.lit(1)).alias("got"))
    starved = target.join(got, "cell", "left").select("cell", F.col("quota").alias("want"), F.coalesce("got", F.lit(0)).cast("long").alias("got"))
    return drawn, starved.where(F.col("got") < F.col("want"))


def level_cap(counts: Sequence[int], total: int) -> int:
    """The largest common cap whose capped counts add up to no more than the total (the largest count, if all fit).

    With the counts in order, the cap lies above the j smallest when these are taken whole and the rest of the total, shared by the
    others, is not less than the j-th: cap = (total - sum of the j smallest) // (shells - j) for the largest such j.
    """
    if sum(counts) <= total:
        return max(counts, default=0)
    filled, shells = 0, len(counts)
    for j, c in enumerate(sorted(counts)):
        if filled + c * (shells - j) > total:
            return (total - filled) // (shells - j)
        filled += c
    return 0


def importance_draw(selected: DataFrame, key: str, shell: str, chain: str, volumes: Mapping, total: int, order: Sequence, seed=0) -> DataFrame:
    """Take all rows of scarce shells, cap the abundant ones, one entry per chain; the weight is volume x selected
    over drawn, scaled to mean one. ``selected`` counts are taken before used chains are removed."""
    spark = selected.sparkSession
    n_sel = {r[shell]: r["n"] for r in selected.groupBy(shell).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per shell
    cap = level_cap([n_sel.get(s, 0) for s in order], total)
    drawn, report = one_entry_draw(selected, key, shell, chain, {s: cap for s in order}, order, seed)
    meta = spark.createDataFrame([(s, float(volumes[s]), int(n_sel.get(s, 0))) for s in order], f"{shell} {selected.schema[shell].dataType.simpleString()}, volume double, n_selected long")
    w = report.select(shell, "n_drawn").join(meta, shell).select(shell, (F.col("volume") * F.col("n_selected") / F.greatest("n_drawn", F.lit(1))).alias("_w"))
    j = drawn.join(F.broadcast(w), shell)  # one row per shell
    mean = j.agg(F.avg("_w").alias("_mean"))
    return j.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("_w") / F.col("_mean")).drop("_w", "_mean")


def cdf_table(density: DataFrame, x: str, f: str) -> DataFrame:
    """Cumulative trapezoid of a density on a short grid, scaled to one: (x, cdf)."""
    from pyspark.sql import Window

    w = Window.orderBy(x)  # grid rows only
    part = F.coalesce(0.5 * (F.col(f) + F.lag(f).over(w)) * (F.col(x) - F.lag(x).over(w)), F.lit(0.0))
    c = density.withColumn("_p", part).withColumn("_c", F.sum("_p").over(w))
    return c.withColumn("cdf", F.col("_c") / F.max("_c").over(Window.partitionBy(F.lit(1)))).select(x, "cdf")


def inverse_cdf_draw(df: DataFrame, key: str, table: DataFrame, x: str, out: str, seed=0) -> DataFrame:
    """Draw a value per row from a tabulated distribution: hash uniform, node search, linear interpolation.

    The table has as many rows as the grid (hundreds); its node edges go to a JVM bucket search and its values to
    a broadcast equi-join on the node.
    """
    from pyspark.ml.feature import Bucketizer

    nodes = [(r[x], r["cdf"]) for r in table.orderBy(x).collect()]  # the grid
    rising = [nodes[0]] + [b for a, b in zip(nodes, nodes[1:]) if b[1] > a[1]]
    splits = [c for _, c in rising]
    seg = [(float(i), a[0], a[1], b[0], b[1]) for i, (a, b) in enumerate(zip(rising, rising[1:]))]
    lut = df.sparkSession.createDataFrame(seg, "_b double, x0 double, c0 double, x1 double, c1 double")
    u = df.withColumn("_u", hashing.uniform(seed, key) * F.lit(splits[-1]))
    j = Bucketizer(splits=splits, inputCol="_u", outputCol="_b").transform(u).join(F.broadcast(lut), "_b")
    return j.withColumn(out, F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("_u") - F.col("c0")) / (F.col("c1") - F.col("c0"))).drop("_u", "_b", "x0", "c0", "x1", "c1")


def volume_density(spark, z_lo: float, z_hi: float, h0: float, omega_m: float, nodes: int = 500, grid_steps: int = 4000) -> DataFrame:
    """Comoving shell volume per redshift on a grid: distance^2 / E(z)."""
    grid = cosmology.distance_grid(spark, h0, omega_m, z_hi * 1.01, grid_steps)
    z = spark.range(nodes).select((F.lit(z_lo) + F.col("id") * F.lit((z_hi - z_lo) / (nodes - 1))).alias("z"))
    d = joins.grid_interpolate(z, "z", grid, "node", "dc_mpc", 0.0, z_hi * 1.01 / grid_steps, "dc")
    return d.select("z", (F.col("dc") * F.col("dc") / cosmology.hubble_ratio("z", omega_m)).alias("f"))


def pool_draw(df: DataFrame, key: str, pool: DataFrame, pool_key: str, value: str, out: str, seed=0, by: Sequence[str] = ()) -> DataFrame:
    """Draw with replacement from an observed pool (per stratum): a hash picks a rank, the pool row with it answers."""
    by = list(by)
    ranked = ranking.hash_order(pool.select(*by, pool_key, value), pool_key, f"{seed}p", by, out="_r").select(*by, F.col("_r").cast("long").alias("_r"), F.col(value).alias(out))
    size = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(runtime.broadcast_checked(size), by) if by else df.crossJoin(F.broadcast(size))  # one row without strata
    d = d.withColumn("_r", (F.floor(hashing.uniform(seed, key) * F.col("_n")) + 1).cast("long"))
    return d.join(ranked, [*by, "_r"]).drop("_r", "_n")


def matching_target(df: DataFrame, bin_col: Column, value: str, total: int) -> DataFrame:
    """Per bin: rows, scaled quota (half-even) and value percentiles 5, 25, 50, 75, 95."""
    b = df.withColumn("bin", bin_col).where(F.col("bin").isNotNull())
    n = b.agg(F.count(F.lit(1)).alias("_n"))
    q = ranking.quantiles(b, value, [0.05, 0.25, 0.5, 0.75, 0.95], ["bin"], names=["p5", "p25", "p50", "p75", "p95"])
    g = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n_real")).crossJoin(F.broadcast(n))  # one row
    return g.select("bin", "n_real", F.bround(F.col("n_real") * F.lit(float(total)) / F.col("_n"), 0).cast("long").alias("quota")).join(q, "bin")


def percentile_picks(df: DataFrame, key: str, value: str, probs: Sequence[float]) -> DataFrame:
    """The row nearest to each requested percentile, a row at most once: later percentiles skip picked rows."""
    spark = df.sparkSession
    targets = [float(x) for x in ranking.quantiles(df, value, list(probs)).first()]
    # Each target needs at most one row more than the picks before it, so its len(probs) nearest are enough.
    k = len(targets)
    plan = F.array(*[F.struct(F.lit(float(p)).alias("q"), F.lit(t).alias("t")) for p, t in zip(probs, targets)])
    near = df.select(key, value, F.explode(plan).alias("p")).select("p.q", key, F.abs(F.col(value) - F.col("p.t")).alias("gap"))
    best = ranking.top_k(near, ["q"], ["gap", key], k).collect()  # k x k rows
    used, out = set(), []
    for p in probs:
        for r in sorted((r for r in best if r["q"] == float(p)), key=lambda r: r["rank"]):
            if r[key] not in used:
                used.add(r[key])
                out.append((float(p), r[key]))
                break
    return spark.createDataFrame(out, f"q double, {key} {df.schema[key].dataType.simpleString()}")


def flag_deviation(df: DataFrame, a: str, b: str, cut: float, out: str = "mismatch") -> DataFrame:
    """Flag rows whose relative deviation |a - b| / b is above a cut; missing counts as unflagged."""
    return df.withColumn(out, F.coalesce(F.abs(F.col(a) - F.col(b)) / F.col(b) > F.lit(cut), F.lit(False)))
