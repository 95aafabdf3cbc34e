"""Linking objects across snapshots: calibrated displacement, mutual matches, chains and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.angles import min_image
from quillon.operators import graph, profiles, ranking, spatial
from quillon.runtime import cut_lineage

AXES = ("x", "y", "z")

# Calibration mass floor, separation and mass window; tolerances and mass windows by mass.
CALIBRATION = {"log_mass": 10.5, "max_sep": 300.0, "mass_window": 0.15}
TOLERANCES = [(11.0, 600.0), (10.8, 400.0), (None, 150.0)]
MASS_WINDOWS = [(10.8, 0.35), (None, 0.25)]


def _by_mass(table, mass):
    out = F.lit(table[-1][1])
    for edge, value in reversed(table[:-1]):
        out = F.when(mass > edge, F.lit(value)).otherwise(out)
    return out


def _positions(df: DataFrame, name: str, tag: str) -> DataFrame:
    return df.select(F.col("id").alias(name), *[F.col(c).alias(f"{tag}{c}") for c in ("x", "y", "z", "vx", "vy", "vz", "log_mass") if c in df.columns])


def calibrate(early: DataFrame, late: DataFrame, box: float, cal=CALIBRATION) -> DataFrame:
    """Least-squares scale k of displacement = k velocity on confident heavy matches, with residual medians."""
    heavy = lambda d: d.where(F.col("log_mass") > cal["log_mass"])
    a, b = heavy(early).select(F.col("id").alias("a_id"), *AXES), heavy(late).select(F.col("id").alias("b_id"), *AXES)
    m = spatial.mutual_nearest_periodic(a, b, "a_id", "b_id", box, cal["max_sep"])
    j = m.join(_positions(early, "a_id", "e"), "a_id").join(_positions(late, "b_id", "l"), "b_id")
    j = j.where(F.abs(F.col("elog_mass") - F.col("llog_mass")) < cal["mass_window"])
    d = {c: min_image(F.col(f"l{c}") - F.col(f"e{c}"), box) for c in AXES}
    dv = sum((d[c] * F.col(f"ev{c}") for c in AXES[1:]), d["x"] * F.col("evx"))
    vv = sum((F.col(f"ev{c}") * F.col(f"ev{c}") for c in AXES[1:]), F.col("evx") * F.col("evx"))
    j = cut_lineage(j.select(*[d[c].alias(f"d{c}") for c in AXES], "evx", "evy", "evz", dv.alias("dv"), vv.alias("vv")))
    k = j.agg(F.count(F.lit(1)).alias("n"), (F.sum("dv") / F.sum("vv")).alias("k"))
    r = j.crossJoin(F.broadcast(k))  # one row
    r0 = F.sqrt(sum((F.col(f"d{c}") * F.col(f"d{c}") for c in AXES[1:]), F.col("dx") * F.col("dx")))
    step = lambda c: F.col(f"d{c}") - F.col("k") * F.col(f"ev{c}")
    r1 = F.sqrt(sum((step(c) * step(c) for c in AXES[1:]), step("x") * step("x")))
    q = ranking.quantiles_of(r.select(r0.alias("r0"), r1.alias("r1")), ["r0", "r1"], [0.5], ["m"])
    wide = q.agg(F.max(F.when(F.col("metric") == "r0", F.col("m"))).alias("residual_still"), F.max(F.when(F.col("metric") == "r1", F.col("m"))).alias("residual_moved"))
    return k.crossJoin(F.broadcast(wide))


def link_pair(early: DataFrame, late: DataFrame, box: float, k: float, tolerances=TOLERANCES, windows=MASS_WINDOWS) -> DataFrame:
    """Links (a_id, b_id, sep): positions moved by k velocity, mutual nearest, then tolerance and mass window by mass."""
    moved = early.select(F.col("id").alias("a_id"), *[F.pmod(F.col(c) + F.lit(k) * F.col(f"v{c}"), F.lit(box)).alias(c) for c in AXES])
    b = late.select(F.col("id").alias("b_id"), *AXES)
    m = spatial.mutual_nearest_periodic(moved, b, "a_id", "b_id", box, max(t for _, t in tolerances))
    j = m.join(early.select(F.col("id").alias("a_id"), F.col("log_mass").alias("ma")), "a_id").join(late.select(F.col("id").alias("b_id"), F.col("log_mass").alias("mb")), "b_id")
    ok = (F.col("sep") < _by_mass(tolerances, F.col("ma"))) & (F.abs(F.col("ma") - F.col("mb")) < _by_mass(windows, F.col("ma")))
    return j.where(ok).select("a_id", "b_id", "sep")


def chains(catalogue: DataFrame, links: DataFrame) -> DataFrame:
    """Connected components over links between (snap, id) nodes: every catalogue row with its chain and length.

    ``links`` has columns a_snap, a_id, b_snap, b_id. Nodes are packed strings so one join key names a row.
    """
    name = lambda s, i: F.concat_ws(":", F.col(s), F.col(i))
    e = links.select(name("a_snap", "a_id").alias("u"), name("b_snap", "b_id").alias("v"))
    c = catalogue.withColumn("_n", name("snap", "id"))
    comp = graph.components(e).withColumnsRenamed({"node": "_n", "component": "_c"})
    rows = c.join(comp, "_n", "left").withColumn("chain", F.coalesce("_c", "_n")).drop("_c", "_n")
    return profiles.with_distinct_count(rows, "chain", "snap", "chain_len")


def chain_length_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chain").agg(F.max("chain_len").alias("chain_len")).groupBy("chain_len").agg(F.count(F.lit(1)).alias("n_chains"))


def recurrence_by_bin(rows: DataFrame, value: str, edges: Sequence[float], length: str = "chain_len") -> DataFrame:
    """Rows, share in a multi-snapshot chain and mean chain length per value bin."""
    b = rows.withColumn("bin", profiles.edge_bin(value, edges)).where(F.col("bin").isNotNull())
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(length) >= 2).cast("double")).alias("share_in_chain"), F.avg(length).alias("mean_length"))


def shared_id_chains(catalogue: DataFrame, id_col: str, snap: str, pool: Sequence[str]) -> DataFrame:
    """Rows with the number of snapshots their id occurs in, over all and over the pool snapshots only."""
    all_n = profiles.with_distinct_count(catalogue, id_col, snap, "chain_len")
    inside = F.col(snap).isin(list(pool))
    counts = catalogue.where(inside).select(id_col, snap).distinct().groupBy(id_col).agg(F.count(snap).alias("_p"))
    out = all_n.join(counts, id_col, "left")
    return out.withColumn("pool_len", F.when(inside, F.col("_p"))).drop("_p")
