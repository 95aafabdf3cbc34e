"""Greedy nearest matching without replacement, solved as proposals, and the contrasts built on matched pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors
from quillon.operators import inference, knn, ranking
from quillon.runtime import cut_lineage, discard

# Candidates that one widening asks for in all; never fewer than ``k`` for each source.
WIDER_ROWS = 2_000_000


def greedy_match(sources: DataFrame, pool: DataFrame, id_col: str, vec: str, priority: str, k: int = 40) -> DataFrame:
    """Pairs (src, dst): sources in descending priority (ties by id) each take the nearest pool row still free.

    With one priority order shared by all pool rows, the greedy result is the stable assignment, so it can be
    computed in rounds: every unmatched source proposes to its nearest candidate not held by a source of higher
    priority, and each candidate keeps its best proposer. A source that runs out of its ``k`` nearest candidates
    is searched again among the pool rows that are free or held by a lower priority than the highest of those sources; what
    others hold is lost to them for good. So the candidate lists never limit the result, and are never as long as the pool.
    Rows without an id or a usable vector take no part.
    """
    there = lambda df: df.where(F.col(id_col).isNotNull() & vectors.usable(F.col(vec)))
    sources, pool = there(sources), there(pool)
    n_pool = pool.select(id_col).distinct().count()
    pri = cut_lineage(sources.select(F.col(id_col).cast("long").alias("src"), F.col(priority).cast("double").alias("pri")))
    rank_key = F.struct(F.col("pri"), -F.col("src"))  # larger wins
    k = min(k, n_pool)
    cand = cut_lineage(knn.knn_join(sources.select(id_col, vec), pool.select(id_col, vec), k, id_col, vec, exclude_self=False).select("src", "rank", "dst").join(pri, "src"))
    held = None
    width = k
    while True:
        free = pri if held is None else pri.join(held.select("src"), "src", "left_anti")
        offers = cand.join(free.select("src"), "src", "left_semi")
        if held is not None:
            now = held.select("dst", F.col("src").alias("hs"), F.col("pri").alias("hp"))
            offers = offers.join(now, "dst", "left").where(F.col("hs").isNull() | (F.struct("hp", -F.col("hs")) < rank_key))
        best = cut_lineage(offers.groupBy("src", "pri").agg(F.min(F.struct("rank", "dst")).alias("b")).select("src", "pri", F.col("b.dst").alias("dst")))
        if best.isEmpty():
            discard(best)
            if held is None:
                break
            stuck, holder = free, F.struct(F.col("pri"), -F.col("src"))
            if held.count() >= n_pool:  # all are taken: only who outranks a holder goes on
                stuck = free.crossJoin(F.broadcast(held.agg(F.min(holder).alias("_low")))).where(rank_key > F.col("_low")).drop("_low")  # one row
            n_stuck = stuck.count()
            if n_stuck == 0:
                break
            lost = held.crossJoin(F.broadcast(stuck.agg(F.max(rank_key).alias("_top")))).where(holder > F.col("_top"))  # one row
            rest = pool.join(lost.select(F.col("dst").alias(id_col)), id_col, "left_anti")
            width = max(k, min(2 * width, n_pool, WIDER_ROWS // n_stuck))
            wider = knn.knn_join(sources.join(stuck.select(F.col("src").alias(id_col)), id_col, "left_semi").select(id_col, vec), rest.select(id_col, vec), width, id_col, vec, exclude_self=False)
            more = wider.select("src", "rank", "dst").join(pri, "src")
            before, cand = cand, cut_lineage(cand.join(stuck.select("src"), "src", "left_anti").unionByName(more))
            discard(before)
            continue
        claims = best if held is None else best.unionByName(held)
        before, held = held, cut_lineage(claims.groupBy("dst").agg(F.max_by(F.struct("src", "pri"), rank_key).alias("w")).select("dst", "w.src", "w.pri"))
        discard(best, *([before] if before is not None else []))
    if held is None:
        return pri.select("src", F.col("src").alias("dst")).limit(0)
    return held.select("src", "dst")


def pair_contrast(pairs: DataFrame, values: DataFrame, id_col: str, value: str) -> DataFrame:
    """(src, dst, delta): value of the source minus value of its match."""
    v = values.select(F.col(id_col).cast("long").alias("_id"), F.col(value).alias("_v"))
    j = pairs.join(v.withColumnsRenamed({"_id": "src", "_v": "vs"}), "src").join(v.withColumnsRenamed({"_id": "dst", "_v": "vd"}), "dst")
    return j.select("src", "dst", "vs", "vd", (F.col("vs") - F.col("vd")).alias("delta"))


def contrast_summary(contrast: DataFrame, n_boot: int = inference.N_BOOT, n_flip: int = inference.N_BOOT, seed=0) -> DataFrame:
    """Paired median with interval, positive share, sign test, and the median under random swaps of the members."""
    rows = contrast.count()
    med = ranking.quantiles(contrast, "delta", [0.5], names=["median"])
    ci = inference.intervals(inference.bootstrap_quantile(contrast, "src", "delta", 0.5, n_boot, seed), ["delta"]).select("ci_lo", "ci_hi")
    flip = inference.sign_flip_null(contrast, "src", "delta", n_flip, f"{seed}f").agg(
        F.percentile("median", 0.025).alias("null_lo"), F.percentile("median", 0.975).alias("null_hi"), F.avg("median").alias("_m"), F.stddev_pop("median").alias("_s")
    )
    st = inference.sign_test(contrast, "delta")
    one = st.crossJoin(F.broadcast(med)).crossJoin(F.broadcast(ci)).crossJoin(F.broadcast(flip))  # one row each
    return one.select(F.lit(rows).alias("n_pairs"), "median", "ci_lo", "ci_hi", (F.col("n_positive") / F.col("n")).alias("share_positive"), "p_value", "null_lo", "null_hi", ((F.col("median") - F.col("_m")) / (F.col("_s") + 1e-12)).alias("sigma_above_null"))


def balance(pairs: DataFrame, values: DataFrame, id_col: str, covariates: Sequence[str]) -> DataFrame:
    """Median of each covariate on both sides of the pairs."""
    out = None
    for c in covariates:
        j = pair_contrast(pairs, values, id_col, c)
        q = ranking.quantiles_of(j, ["vs", "vd"], [0.5], ["m"])
        one = q.agg(F.max(F.when(F.col("metric") == "vs", F.col("m"))).alias("source"), F.max(F.when(F.col("metric") == "vd", F.col("m"))).alias("matched")).withColumn("covariate", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out
