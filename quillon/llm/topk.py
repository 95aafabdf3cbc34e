"""Operator 3: exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Shelf

SAFE = float(2**52)


def usable(vector: Column) -> Column:
    """True for a vector that is not null, not empty and holds finite numbers only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def impacts(vector: Column, scale: int = 256) -> Column:
    """Integer term weights: floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; a shorter vector has no weight in the terms beyond its end."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1], lengths)] = values
    return out


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where every partial sum is exact, else in Python's integers, held to the range of a long."""
    if not len(q) or not len(d) or np.abs(q).sum(axis=1).max() * np.abs(d).max(initial=0) < SAFE:
        return (q @ d.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q).dot(whole(d).T)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bound of a query's score in each block: the sum over terms of its weight times the block's maximum (minimum, for a negative weight)."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, by score, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def top_ids(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best different ids, each by its best score, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def search_shard(qids, q, floor, ids, d, k: int, block: int):
    """Top k of one document shard for some queries: blocks in order of their bounds, until a bound falls below the k-th score.

    ``floor`` is a score that k documents are known to reach for the query; rows that repeat an id are one document. Yields (query position, document positions, scores).
    """
    starts = np.arange(0, len(ids), block)
    high = np.maximum.reduceat(d, starts, axis=0)
    low = np.minimum.reduceat(d, starts, axis=0)
    limit = bounds(q, high, low)
    order = np.argsort(-limit, axis=1, kind="stable")
    pick = top if len(np.unique(ids)) == len(ids) else top_ids
    kth, found = floor.astype(float).copy(), [[] for _ in qids]
    slack = 1e-9 * (1 + np.abs(limit).max(initial=0))  # the bounds are sums of doubles
    for step in range(len(starts)):
        at = order[:, step]
        open_ = np.flatnonzero(limit[np.arange(len(qids)), at] + slack >= kth)
        if not len(open_):
            break
        for b in np.unique(at[open_]):
            who = open_[at[open_] == b]
            s, e = starts[b], min(len(ids), starts[b] + block)
            scores = products(q[who], d[s:e])
            for row, i in zip(scores, who):
                good = np.flatnonzero((row >= kth[i]) & (ids[s:e] != qids[i]))
                if len(good):
                    mine = found[i]
                    mine += zip(row[good].tolist(), (s + good).tolist())
                    if len(mine) >= k:
                        sc = np.array([m[0] for m in mine], dtype=np.int64)
                        pos = np.array([m[1] for m in mine])
                        best = pick(sc, ids[pos], k)
                        found[i] = [mine[j] for j in best]
                        if len(best) == k:
                            kth[i] = max(kth[i], found[i][-1][0])
    for i, mine in enumerate(found):
        if mine:
            sc = np.array([m[0] for m in mine], dtype=np.int64)
            pos = np.array([m[1] for m in mine])
            best = pick(sc, ids[pos], k)
            yield i, pos[best], sc[best]


def search(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, block: int = 128, shard_rows: int = 8192, query_rows: int = 1024, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k best documents of every query row by integer inner product, exactly.

    Rows are put in an order where like vectors are neighbours (by strongest term), cut into shards of about
    ``shard_rows`` and these into blocks of ``block``. Query groups of about ``query_rows`` meet every shard: a shard is a
    forward index, scored block by block in the order of the query's bounds. A first pass over each query's own
    shard gives a score that k documents reach, so that most blocks elsewhere are never scored. A row that
    is null, empty or holds null or non-finite components takes no part; a shorter vector has no weight beyond its
    end; a query never returns rows of its own key; of
    candidate rows that repeat a key the best is one result, of query rows that repeat one the smallest vector asks. Returns query_id, rank (int from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    shelf = Shelf(spark)
    base = vectors.filter(usable(F.col(column)) & F.col(key).isNotNull()).withColumn("__q", F.coalesce(queries, F.lit(False))).select(F.col(key).alias("id"), impacts(F.col(column), scale).alias("v"), F.col("__q").alias("is_query"))
    size = F.transform("v", lambda x: F.abs(x))
    strong = F.array_position(size, F.array_max(size))
    base = base.withColumn("term", strong * F.when(F.element_at("v", strong.cast("int")) < 0, -1).otherwise(1))
    base = shelf.put(base, "base")
    rows = shelf.put(base.select("id", "v", "term").distinct(), "rows")  # rows that repeat an id and its weights are one
    facts = base.agg(F.max(F.size("v")).alias("width"), F.sum(F.col("is_query").cast("long")).alias("nq")).first()
    n, width, nq = rows.count(), facts["width"] or 1, facts["nq"] or 0
    out_schema = "query_id long, vec_id long, score long"
    if not n or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, groups = -(-n // shard_rows), -(-nq // query_rows)
    docs = rows.repartitionByRange(shards, "term", "id", F.xxhash64("v")).withColumn("shard", F.spark_partition_id())
    docs = shelf.put(docs, "shards")
    homes = base.filter("is_query").groupBy("id").agg(F.min("v").alias("v")).withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    homes = shelf.put(homes.select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("grp").alias("qgrp")), "queries")

    def solve(left: DataFrame, right: DataFrame) -> DataFrame:
        """Query rows (grp, shard, id, v, floor) against the rows of their shard."""

        def run(key_, q, d):
            qi, di = q.column("qid").to_numpy(), d.column("id").to_numpy()
            qv, dv = (matrix(t.combine_chunks(), width) for t in (q.column("qv"), d.column("v")))
            order = np.lexsort((di, d.column("term").to_numpy()))
            di, dv = di[order], dv[order]
            floor = q.column("floor").to_numpy()
            if not len(qi) or not len(di):
                return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
            parts = list(search_shard(qi, qv, floor, di, dv, k, block))
            return pa.table({
                "query_id": pa.array(np.concatenate([np.full(len(p), qi[i]) for i, p, _ in parts]) if parts else [], pa.int64()),
                "vec_id": pa.array(np.concatenate([di[p] for _, p, _ in parts]) if parts else [], pa.int64()),
                "score": pa.array(np.concatenate([s for _, _, s in parts]) if parts else [], pa.int64()),
            })

        return left.groupBy("qgrp", "qshard").cogroup(right.groupBy("grp", "shard")).applyInArrow(run, out_schema)

    def best(found: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)

    low = F.lit(-float(2**63))
    own = docs.select(F.col("id").alias("own_id"), F.col("shard").alias("qshard")).join(homes, F.col("own_id") == F.col("qid"))
    own = own.select("qid", "qv", "qgrp", "qshard", low.alias("floor")).distinct()
    pairs = own.select(F.col("qgrp").alias("grp"), F.col("qshard").alias("own_shard")).distinct()
    first = solve(own, docs.join(pairs, F.col("shard") == F.col("own_shard")).select("grp", "shard", "id", "v", "term"))
    kth = best(first).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    known = homes.join(kth, F.col("qid") == F.col("query_id"), "left").select("qid", "qv", "qgrp", F.coalesce(F.col("kth").cast("double"), low).alias("floor"))
    known = shelf.put(known, "floors")
    left = known.withColumn("qshard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = docs.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return best(solve(left, right)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
