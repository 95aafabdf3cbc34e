"""Positional matching: sky crossmatch and periodic mutual nearest neighbours on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.angles import chord_to_arcsec, min_image, unit_vector
from quillon.operators.joins import salt_hot_keys
from quillon.runtime import cut_lineage

ARCSEC = 3600.0


class SkyGrid:
    """Declination bands split into right-ascension cells about ``height`` degrees on a side."""

    def __init__(self, radius_arcsec: float, height_deg: float | None = None):
        self.radius = radius_arcsec / ARCSEC
        self.height = max(height_deg or 0.0, 2.0 * self.radius, 1.0 / 120.0)

    def band(self, dec: Column) -> Column:
        return F.floor((dec + 90.0) / self.height).cast("int")

    def cells_in(self, band: Column) -> Column:
        """Cells of a band: the circle at the band edge nearest the equator, in steps of the cell height."""
        lo = band * self.height - 90.0
        near = F.when((lo <= 0) & (lo + self.height >= 0), F.lit(0.0)).otherwise(F.least(F.abs(lo), F.abs(lo + self.height)))
        return F.greatest(F.floor(360.0 * F.cos(F.radians(near)) / self.height), F.lit(1)).cast("int")

    def cell(self, ra: Column, band: Column) -> Column:
        n = self.cells_in(band)
        return F.least(F.floor(F.pmod(ra, F.lit(360.0)) / 360.0 * n).cast("int"), n - 1)

    def place(self, df: DataFrame) -> DataFrame:
        d = df.withColumn("_band", self.band(F.col("dec")))
        return d.withColumn("_cell", self.cell(F.col("ra"), F.col("_band")))

    def spread(self, df: DataFrame) -> DataFrame:
        """Repeat each target for every cell its match circle can touch; right ascension wraps."""
        r = math.radians(self.radius)
        half = F.when(
            F.abs(F.col("dec")) + self.radius < 90.0,
            F.degrees(F.asin(F.least(F.lit(math.sin(r)) / F.cos(F.radians(F.col("dec"))), F.lit(1.0)))),
        ).otherwise(F.lit(180.0))
        lo_band = self.band(F.greatest(F.col("dec") - self.radius, F.lit(-90.0)))
        hi_band = self.band(F.least(F.col("dec") + self.radius, F.lit(90.0)))
        d = df.withColumn("_half", half * (1 + 1e-9)).withColumn("_band", F.explode(F.sequence(lo_band, hi_band)))
        n = self.cells_in(F.col("_band"))
        first = F.floor((F.col("ra") - F.col("_half")) / 360.0 * n).cast("int")
        last = F.floor((F.col("ra") + F.col("_half")) / 360.0 * n).cast("int")
        last = F.least(last, first + n - 1)
        cells = F.array_distinct(F.transform(F.sequence(first, last), lambda c: F.pmod(c, n)))
        return d.withColumn("_cell", F.explode(cells)).drop("_half")


def separation_arcsec(ra1, dec1, ra2, dec2, metric: str = "sphere") -> Column:
    """Great-circle separation through the unit-vector chord, or the planar one with cos(dec)."""
    if metric == "planar":
        dra = F.pmod(ra2 - ra1 + 180.0, F.lit(360.0)) - 180.0
        return F.hypot(dra * F.cos(F.radians(dec1)), dec2 - dec1) * ARCSEC
    a, b = unit_vector(ra1, dec1), unit_vector(ra2, dec2)
    chord = F.sqrt(sum((F.pow(x - y, 2) for x, y in zip(a[1:], b[1:])), F.pow(a[0] - b[0], 2)))
    return chord_to_arcsec(chord)


def _candidates(targets: DataFrame, refs: DataFrame, ref_id: str, radius_arcsec: float, metric: str) -> DataFrame:
    """(target position, ref_id, sep) for pairs inside the radius; ``targets`` holds positions only."""
    grid = SkyGrid(radius_arcsec)
    t = grid.spread(targets.select(F.col("ra"), F.col("dec")))
    r = grid.place(refs.select(ref_id, "ra", "dec")).withColumnsRenamed({"ra": "_ra", "dec": "_dec"})
    t, r, keys = salt_hot_keys(t, r, ["_band", "_cell"], ref_id)
    sep = separation_arcsec(F.col("ra"), F.col("dec"), F.col("_ra"), F.col("_dec"), metric)
    pairs = t.join(r, keys).withColumn("sep", sep)
    return pairs.where(F.col("sep") <= radius_arcsec).select("ra", "dec", ref_id, "sep")


def sky_nearest(
    targets: DataFrame, refs: DataFrame, target_id: str, ref_id: str, radius_arcsec: float, metric: str = "sphere",
    keep_unmatched: bool = False,
) -> DataFrame:
    """Nearest reference within the radius per target (ties by reference id).

    Copies at one position are matched once: repeated reference positions are represented by their smallest id,
    and the answer of a target position is joined back to every target there.
    """
    refs_once = refs.groupBy("ra", "dec").agg(F.min(ref_id).alias(ref_id))
    places = targets.select("ra", "dec").distinct()
    best = _candidates(places, refs_once, ref_id, radius_arcsec, metric).groupBy("ra", "dec").agg(
        F.min(F.struct("sep", ref_id)).alias("_m")
    )
    out = targets.join(best, ["ra", "dec"], "left" if keep_unmatched else "inner")
    return out.select(*[c for c in targets.columns if c not in ("ra", "dec")], F.col(f"_m.{ref_id}").alias(ref_id), F.col("_m.sep").alias("sep"))


def sky_all(
    targets: DataFrame, refs: DataFrame, target_id: str, ref_id: str, radius_arcsec: float, metric: str = "planar"
) -> DataFrame:
    """Every reference within the radius per target, and one row with a NULL reference where there is none."""
    grid = SkyGrid(radius_arcsec)
    t = grid.spread(targets.select(target_id, "ra", "dec"))
    r = grid.place(refs.select(ref_id, "ra", "dec")).withColumnsRenamed({"ra": "_ra", "dec": "_dec"})
    t, r, keys = salt_hot_keys(t, r, ["_band", "_cell"], ref_id)
    sep = separation_arcsec(F.col("ra"), F.col("dec"), F.col("_ra"), F.col("_dec"), metric)
    hits = t.join(r, keys).withColumn("sep", sep).where(F.col("sep") <= radius_arcsec).select(target_id, ref_id, "sep")
    return targets.select(target_id).join(hits, target_id, "left")


AXES = ("x", "y", "z")


# Rows that a cell of the first round aims at; fewer settle less in the round, more cost more pairs.
CELL_ROWS = 2.0


def _nearest_within(spots: DataFrame, once: DataFrame, b_id: str, box: float, reach: float) -> DataFrame:
    """Per position in ``spots`` the nearest row of ``once`` closer than ``reach``: (x, y, z, b_id, sep).

    The merge hint matters: the planner sizes the positions as if they had not been repeated for 27 cells and would
    send all of them through the driver.
    """
    n = max(1, int(box // reach))
    side = box / n
    cell = lambda c: F.least(F.floor(F.pmod(F.col(c), F.lit(box)) / side).cast("long"), F.lit(n - 1))
    steps = sorted({s % n for s in (-1, 0, 1)}) if n < 3 else [-1, 0, 1]
    near, at = spots.withColumn("_cell", F.lit(0).cast("long")), F.lit(0).cast("long")
    for c in AXES:
        near = near.withColumn("_s", F.explode(F.array(*[F.lit(s) for s in steps]))).withColumn("_cell", F.col("_cell") * n + F.pmod(cell(c) + F.col("_s"), F.lit(n))).drop("_s")
        at = at * n + cell(c)
    placed = once.select(b_id, *[F.col(c).alias(f"_{c}") for c in AXES], at.alias("_cell"))
    near, placed, keys = salt_hot_keys(near, placed, ["_cell"], b_id)
    d2 = sum((F.pow(min_image(F.col(f"_{c}") - F.col(c), box), 2) for c in AXES[1:]), F.pow(min_image(F.col("_x") - F.col("x"), box), 2))
    pairs = near.join(placed.hint("merge"), keys).withColumn("sep", F.sqrt(d2)).where(F.col("sep") < reach)
    best = pairs.groupBy(*AXES).agg(F.min(F.struct("sep", b_id)).alias("_m"))
    return best.select(*AXES, F.col(f"_m.{b_id}").alias(b_id), F.col("_m.sep").alias("sep"))


def _nearest_periodic(a: DataFrame, b: DataFrame, b_id: str, box: float, tolerance: float) -> DataFrame:
    """Per distinct position in ``a`` the nearest ``b`` closer than the tolerance: (x, y, z, b_id, sep).

    In a dense box the first round reaches a part of the tolerance only, over cells of about CELL_ROWS rows; what it
    finds is nearest for good. Positions without a hit go on at twice the reach, up to the tolerance.
    """
    spots = a.select(*AXES).distinct()
    once = b.groupBy(*AXES).agg(F.min(b_id).alias(b_id))
    rows = b.count() / max(1, int(box // tolerance)) ** 3
    halvings = max(0, math.ceil(math.log2(max(rows / CELL_ROWS, 1.0)) / 3))
    if not halvings:
        return _nearest_within(spots, once, b_id, box, tolerance)
    once, found = cut_lineage(once), None
    for h in range(halvings, -1, -1):
        best = _nearest_within(spots, once, b_id, box, tolerance / 2**h)
        if h:
            best = cut_lineage(best)
            spots = cut_lineage(spots.join(best, [*AXES], "left_anti"))
        found = best if found is None else found.unionByName(best)
        if h and spots.isEmpty():
            break
    return found


def mutual_nearest_periodic(a: DataFrame, b: DataFrame, a_id: str, b_id: str, box: float, tolerance: float) -> DataFrame:
    """Pairs that are each other's nearest in a periodic box and closer than the tolerance.

    Both tables hold x, y, z. Cells are as wide as the tolerance, which is exact: a rival closer than an accepted
    pair would lie within the tolerance too, hence in a neighbouring cell.
    """
    ab = _nearest_periodic(a, b, b_id, box, tolerance)
    ba = _nearest_periodic(b, a, a_id, box, tolerance)
    fwd = a.select(a_id, *AXES).join(ab, [*AXES]).select(a_id, b_id, "sep")
    back = b.select(b_id, *AXES).join(ba, [*AXES]).select(b_id, F.col(a_id).alias("_back"))
    return fwd.join(back, b_id).where(F.col("_back") == F.col(a_id)).select(a_id, b_id, "sep")
