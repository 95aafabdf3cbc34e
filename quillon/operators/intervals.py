"""Row-index interval joins and the aggregation of member rows per owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import runtime
from quillon.functions.angles import min_image


def block_size(owners: DataFrame, n_col: str, lo: int = 16, hi: int = 1 << 20) -> int:
    """Block length near the mean interval length, so a block meets about two intervals; never so short that the
    longest interval spans more than 100,000 blocks."""
    row = owners.agg(F.avg(n_col).alias("mean"), F.max(n_col).alias("most")).first()
    return int(max(min(max(row["mean"] or lo, lo), hi), (row["most"] or 0) // 100_000))


def interval_join(rows: DataFrame, owners: DataFrame, row_idx: str, offset: str, n: str, block: int | None = None) -> DataFrame:
    """Rows whose index lies in [offset, offset + n) of an owner, with the owner's columns; gap rows drop out.

    Disjoint intervals become blocks of the index, so the join is an equi-join on the block whose keys hold at
    most ``block`` rows each: an owner of a third of all rows is spread over its blocks.
    """
    block = block or block_size(owners, n)
    first = F.floor(F.col(offset) / F.lit(block))
    last = F.floor((F.col(offset) + F.col(n) - 1) / F.lit(block))
    spans = owners.where(F.col(n) > 0).withColumn("_block", F.explode(F.sequence(first, last)))
    keyed = rows.withColumn("_block", F.floor(F.col(row_idx) / F.lit(block)))
    inside = (F.col(row_idx) >= F.col(offset)) & (F.col(row_idx) < F.col(offset) + F.col(n))
    return keyed.join(spans, "_block").where(inside).drop("_block")


def radius2(box: float | None) -> Column:
    """Squared distance of a member (px, py, pz) from its owner (x, y, z), by minimum image when a box is given."""
    parts = []
    for c in ("x", "y", "z"):
        d = F.col(f"p{c}") - F.col(c)
        parts.append(F.pow(min_image(d, box) if box else d, 2))
    return parts[0] + parts[1] + parts[2]


def member_aggregates(
    members: DataFrame, owners: DataFrame, owner: str, mass: str, age: str, metal: str, radius: str, box: float
) -> DataFrame:
    """Per owner: mass and counts inside one and two radii, mass-weighted means, windowed rates and a flag.

    ``members`` comes from :func:`interval_join`. Strict ``<`` on the radius; an owner without a positive radius
    gets NULL apertures and a flag, never zeros.
    """
    m = members.withColumn("_r2", radius2(box))
    w, a, r = F.col(mass), F.greatest(F.col(age), F.lit(0.0)), F.col(radius)
    in2, in1 = F.col("_r2") < F.pow(2 * r, 2), F.col("_r2") < F.pow(r, 2)
    take = lambda cond, v: F.sum(F.when(cond, v).otherwise(F.lit(0.0)))
    sums = m.groupBy(owner).agg(
        F.sum(w).alias("mass_total"), take(in2, w).alias("_m2"), take(in1, w).alias("_m1"), F.count_if(in2).alias("_n2"),
        F.sum(w * a).alias("_age"), take(in2, w * a).alias("_age2"), take(in2, w * F.col(metal)).alias("_met2"),
        take(in2 & (a < 0.1), w).alias("_s100"), take(in2 & (a < 0.01), w).alias("_s10"),
    )
    out = owners.select(owner, radius).join(sums, owner, "left")
    ok = F.col(radius) > 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n2 = F.coalesce("_n2", F.lit(0))
    pos2 = ok & (F.col("_m2") > 0)
    return out.select(
        owner, zero("mass_total").alias("mass_total"),
        F.when(ok, zero("_m2")).alias("mass_in2"), F.when(ok, zero("_m1")).alias("mass_in1"), n2.cast("long").alias("n_in2"),
        F.when(F.col("mass_total") > 0, F.col("_age") / F.col("mass_total")).alias("mean_age"),
        F.when(pos2, F.col("_age2") / F.col("_m2")).alias("mean_age_in2"), F.when(pos2, F.col("_met2") / F.col("_m2")).alias("mean_metal_in2"),
        F.when(ok, zero("_s100") / 1e8).alias("rate_100"), F.when(ok, zero("_s10") / 1e7).alias("rate_10"),
        F.when(~ok, "radius<=0").when(n2 == 0, "empty").otherwise("").alias("flag"),
    )


def face_candidates(owners: DataFrame, radius: str, box: float) -> DataFrame:
    """Owners whose centre is within one radius of a box face."""
    near = F.least(*[F.least(F.col(c), F.lit(box) - F.col(c)) for c in ("x", "y", "z")])
    return owners.withColumn("dist_face", near).where((F.col("dist_face") < F.col(radius)) & (F.col(radius) > 0))


def naive_versus_wrapped(members: DataFrame, owner: str, mass: str, radius: str, box: float) -> DataFrame:
    """Aperture mass and largest radius with and without the periodic minimum image."""
    m = members.withColumn("_p2", radius2(box)).withColumn("_q2", radius2(None))
    lim = F.pow(2 * F.col(radius), 2)
    return m.groupBy(owner).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("_p2") - F.col("_q2")) > 1e-6).alias("n_wrapped"),
        F.sqrt(F.max("_q2")).alias("naive_max_r"), F.sqrt(F.max("_p2")).alias("wrapped_max_r"),
        F.sum(F.when(F.col("_q2") < lim, F.col(mass)).otherwise(0.0)).alias("naive_mass"),
        F.sum(F.when(F.col("_p2") < lim, F.col(mass)).otherwise(0.0)).alias("wrapped_mass"),
    )
