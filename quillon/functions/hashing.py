"""Seeded choices that depend only on row keys, so a re-run of any task makes the same choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = float(2**32)

# Upper limits of the Poisson(1) distribution function for counts 0 to 10.
POISSON1_CDF = [
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.9999167588507119,
    0.9999897508033253,
    0.9999988747974020,
    0.9999998885745217,
    0.9999999899522336,
]


def hash32(seed, *keys) -> Column:
    """Uniform integer in [0, 2^32) from a seed and any number of key columns."""
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def uniform(seed, *keys) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(seed, *keys) / F.lit(SPAN)


def poisson1(u: Column) -> Column:
    """Poisson(1) count whose distribution function first reaches ``u``: the bootstrap weight of one row."""
    out = F.lit(len(POISSON1_CDF))
    for count in range(len(POISSON1_CDF) - 1, -1, -1):
        out = F.when(u < F.lit(POISSON1_CDF[count]), F.lit(count)).otherwise(out)
    return out


def sign(seed, *keys) -> Column:
    """+1 or -1 with equal chance."""
    return F.when(hash32(seed, *keys) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
