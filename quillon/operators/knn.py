"""Exact nearest neighbours between vector tables as a tiled equi-join.

Rows of both sides are cut into blocks of bounded bytes. A tile (query block, base block) is a join key; both
sides are repeated for the tiles they belong to, and each tile keeps k rows per query through BLAS, so no pair
table is ever emitted. Large tables are first grouped around pivots, and tiles that the triangle inequality shows
cannot hold a neighbour are never formed; the result stays exact.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import runtime
from quillon.functions import hashing, vectors
from quillon.operators import kernels, ranking

BLOCK_BYTES = 32 << 20
PAIR_BUDGET = 4_000_000  # distances held at once inside a tile
SLICE_ROWS = 4_096  # rows of a side that are turned at once
ROUND_BYTES = 4 << 30  # rows and hits that a search moves at once, if four times the vectors themselves are less
FEW_ROWS = 1_024  # a shorter base is searched in double precision from the start


def _exact(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of chosen pairs by direct differences, in slices of bounded size."""
    out = np.empty(len(r))
    step = max(1, 1_000_000 // max(1, q.shape[1]))
    for s in range(0, len(r), step):
        diff = q[r[s : s + step]] - x[c[s : s + step]]
        out[s : s + step] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


class _Base:
    """Base rows of a tile, ready for slices of queries. Single-precision products, centred and scaled, name the rows that can be among the
    k nearest (more than their rounding is allowed for); these are compared by their exact distances."""

    def __init__(self, x: np.ndarray, xid: np.ndarray):
        self.x, self.xid, self.order = x, xid, np.argsort(xid, kind="stable")
        self.sorted_ids = xid[self.order]
        with np.errstate(over="ignore", invalid="ignore"):
            self.mid = x.mean(0) if len(x) else np.zeros(x.shape[1])
            self.scale = max((float(np.abs(x[s : s + SLICE_ROWS] - self.mid).max(initial=0.0)) for s in range(0, len(x), SLICE_ROWS)), default=0.0) * math.sqrt(x.shape[1] or 1)
        if not 1e-140 < self.scale < np.inf:  # squares of such distances would be no numbers
            self.mid, self.scale = np.zeros(x.shape[1]), 1.0
        self.sides: dict = {}

    def side(self, kind):
        """(-2 x, |x|^2) as columns, for a product with (q, 1), and the greatest |x|^2."""
        if kind not in self.sides:
            out = np.empty((self.x.shape[1] + 1, len(self.x)), kind)
            top = 0.0
            for s in range(0, len(self.x), SLICE_ROWS):
                part = (self.x[s : s + SLICE_ROWS] - self.mid) / self.scale
                norm = np.einsum("ij,ij->i", part, part)
                out[:-1, s : s + SLICE_ROWS] = -2.0 * part.T
                out[-1, s : s + SLICE_ROWS] = norm
                top = max(top, float(norm.max(initial=0.0)))
            self.sides[kind] = out, top
        return self.sides[kind]

    def candidates(self, part: np.ndarray, own: tuple, k: int, kind):
        """(query, base row) pairs of a slice that can be among the k nearest; None if single precision leaves too many."""
        side, top = self.side(kind)
        q = (part - self.mid) / self.scale
        norm = np.einsum("ij,ij->i", q, q)
        d = np.column_stack([q, np.ones(len(q))]).astype(kind) @ side
        d[own] = np.inf
        # The k-th least of the minima of many groups is never below the k-th least of all.
        wide = d.shape[1] // (8 * k)
        if wide >= 4:
            wide = min(wide, 64)
            each = d.shape[1] // wide
            low = d[:, : wide * each].reshape(len(d), wide, each).min(1)
        else:
            low = d
        kk = min(k, low.shape[1])
        kth = np.partition(low, kk - 1, axis=1)[:, kk - 1].astype(float)
        slack = (2 * (len(side) + 8) * np.finfo(kind).eps) * (norm + 2.0 * top)
        most = np.nextafter(np.where(np.isfinite(kth), kth + slack, np.finfo(kind).max).astype(kind), kind(np.inf))
        near = d <= np.where(np.isfinite(most), most, np.finfo(kind).max)[:, None]
        if kind is np.float32 and np.count_nonzero(near) > 4 * k * len(d):  # close pairs, for the scale of all: more digits tell them apart
            return None
        return np.divmod(np.flatnonzero(near.ravel()), d.shape[1])

    def nearest(self, q: np.ndarray, qid: np.ndarray, k: int, exclude_self: bool):
        rows, cols, dist = [], [], []
        step = max(1, PAIR_BUDGET // (2 * max(1, len(self.x))))
        for s in range(0, len(q) if len(self.x) else 0, step):
            part = q[s : s + step]
            own = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if exclude_self:
                at = np.minimum(np.searchsorted(self.sorted_ids, qid[s : s + step]), len(self.xid) - 1)
                hit = np.flatnonzero(self.sorted_ids[at] == qid[s : s + step])
                own = hit, self.order[at[hit]]
            with np.errstate(over="ignore", invalid="ignore"):
                found = None
                if len(self.x) > FEW_ROWS and float(np.abs(part - self.mid).max(initial=0.0)) < 1e15 * self.scale:
                    found = self.candidates(part, own, k, np.float32)
                r, c = found or self.candidates(part, own, k, np.float64)
                d = _exact(part, self.x, r, c)
            sure = np.isfinite(d)
            r, c, d = r[sure], c[sure], d[sure]
            o = np.lexsort((self.xid[c], d, r))
            r, c, d = r[o], c[o], d[o]
            keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(part)))[r] < k
            rows.append(r[keep] + s)
            cols.append(self.xid[c[keep]])
            dist.append(d[keep])
        cat = lambda a, t: np.concatenate(a) if a else np.zeros(0, t)
        return cat(rows, np.int64), cat(cols, np.int64), cat(dist, np.float64)


def _nearest(q, qid, x, xid, k, exclude_self):
    """(query position, base id, distance) of the k nearest, ties by base id."""
    return _Base(x, xid).nearest(q, qid, k, exclude_self)


def _assign(df: DataFrame, id_: str, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot and the distance to it."""
    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_dp", T.DoubleType())])
    pn = np.einsum("ij,ij->i", pivots, pivots)

    def fn(batches):
        for b in batches:
            x = kernels.matrix(b.column("_v"))
            if len(x) == 0:
                continue
            cell = (pn[None, :] - 2.0 * (x @ pivots.T)).argmin(1)
            diff = x - pivots[cell]
            dp = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell.astype(np.int32)), pa.array(dp)], names=[*b.schema.names, "_cell", "_dp"]
            )

    return df.mapInArrow(fn, schema)


def candidate_cells(q_radius: dict, b_radius: dict, b_count: dict, pivots: np.ndarray, need: int) -> list[tuple[int, int]]:
    """(query cell, base cell) pairs that may hold neighbours.

    A query in cell i reaches every row of cell j within U_i + D_ij + U_j, so the cells taken in that order until
    they hold ``need`` rows bound its neighbour distance; a cell whose lower bound D_ij - U_i - U_j is beyond that
    cannot contribute.
    """
    d = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(-1), 0.0)) if len(pivots) <= 64 else None
    if d is None:
        pn = (pivots**2).sum(1)
        d = np.sqrt(np.maximum(pn[:, None] + pn[None, :] - 2.0 * pivots @ pivots.T, 0.0))
    cells = sorted(b_count)
    out = []
    for i, ui in q_radius.items():
        upper = sorted((ui + d[i, j] + b_radius[j], b_count[j]) for j in cells)
        seen, theta = 0, math.inf
        for bound, count in upper:
            seen += count
            if seen >= need:
                theta = bound
                break
        out += [(i, j) for j in cells if d[i, j] - ui - b_radius[j] <= theta * (1 + 1e-9) + 1e-9]
    return out


def _copies(df: DataFrame, by: list[str]) -> int:
    """Rows in the largest group of identical vectors (grouped by hash: only 8 bytes per row move)."""
    return df.groupBy(*by, F.xxhash64("_v").alias("_hv")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _collapsed(queries: DataFrame, base: DataFrame, k: int, by: list[str], exclude_self: bool, **kw) -> DataFrame:
    """Neighbours when large groups of identical vectors exist, still exact.

    Among copies only the k + 1 smallest ids can be anyone's neighbour, so the base keeps those; identical query
    vectors share one search, whose k + 1 answers are handed to every copy, minus the copy itself.
    """
    same = [*by, F.xxhash64("_v"), "_v"]
    few = ranking.top_k(base, same, ["_id"], k + 1, "_c").drop("_c")
    reps = queries.groupBy(*by, F.xxhash64("_v").alias("_hv"), "_v").agg(F.min("_id").alias("_rep"))
    near = knn_join(reps.select(*by, F.col("_rep").alias("_id"), "_v"), few, k + 1, "_id", "_v", exclude_self=False, by=by, collapse=False, **kw)
    who = queries.withColumn("_hv", F.xxhash64("_v")).join(reps, [*by, "_hv", "_v"]).select(*by, "_id", "_rep")
    hits = near.select(*by, F.col("src").alias("_rep"), "dst", "dist").groupBy(*by, "_rep").agg(
        F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("_n")  # k + 1 entries per group
    )
    mine = F.filter("_n", lambda e: e["dst"] != F.col("_id")) if exclude_self else F.col("_n")
    out = who.join(hits, [*by, "_rep"]).select(*by, F.col("_id").alias("src"), F.posexplode(F.slice(mine, 1, k)).alias("_p", "_e"))
    return out.select(*by, "src", F.col("_e.dst").alias("dst"), F.col("_e.dist").alias("dist"), (F.col("_p") + 1).alias("rank"))


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    id_col: str,
    vec: str,
    metric: str = "euclidean",
    exclude_self: bool = True,
    by: Sequence[str] = (),
    block_bytes: int = BLOCK_BYTES,
    pivots: int | None = None,
    collapse: bool | None = None,
    round_bytes: int | None = None,
) -> DataFrame:
    """Edges (by..., src, dst, rank, dist): the k nearest base rows of every query row, ties by id.

    ``exclude_self`` drops the base row that has the query's own id. ``by`` restricts neighbours to one stratum.
    Vectors that are NULL or hold NULL, NaN or infinite components take no part on either side. A query meets every block of the base, so what
    is moved grows with their number; beyond ``round_bytes`` the queries are searched in rounds, each stored before its shuffle files are deleted.
    """
    spark = base.sparkSession
    by = list(by)
    v = vectors.normalise(vec) if metric == "cosine" else F.col(vec).cast("array<double>")
    prep = lambda df: df.select(*by, F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where(vectors.usable("_v"))
    q, b = prep(queries), prep(base)
    info = b.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d")).first()
    n_b, dim = info["n"], info["d"] or 1
    n_q = n_b if queries is base else q.count()
    rows_per_block = max(1, block_bytes // (8 * dim))
    if collapse is None:
        collapse = n_b > rows_per_block and max(_copies(b, by), 0 if queries is base else _copies(q, by)) > rows_per_block // 4
    if collapse:
        out = _collapsed(q, b, k, by, exclude_self, block_bytes=block_bytes, pivots=pivots)
        return out.withColumn("dist", F.col("dist") * F.col("dist") / 2.0) if metric == "cosine" else out
    n_bb = max(1, math.ceil(n_b / rows_per_block))
    workers = spark.sparkContext.defaultParallelism
    n_pivots = pivots if pivots is not None else (min(256, 2 * n_bb) if n_bb > 4 and not by else 1)
    need = k + (1 if exclude_self else 0)

    if n_pivots > 1:
        chosen = b.withColumn("_h", hashing.hash32("pivot", "_id")).orderBy("_h", "_id").limit(n_pivots)
        p = np.array([r["_v"] for r in chosen.select("_v").collect()])  # at most 256 vectors
        q, b = _assign(q, "_id", p), _assign(b, "_id", p)
        stat = lambda df: {r["_cell"]: (r["n"], r["u"]) for r in df.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_dp").alias("u")).collect()}
        bs = stat(b)
        qs = bs if queries is base else stat(q)
        pairs = candidate_cells({c: u for c, (_, u) in qs.items()}, {c: u for c, (_, u) in bs.items()}, {c: n for c, (n, _) in bs.items()}, p, need)
        sub_b = {c: max(1, math.ceil(n / rows_per_block)) for c, (n, _) in bs.items()}
        sub_q = {c: max(1, math.ceil(n / rows_per_block)) for c, (n, _) in qs.items()}
        met = sum(qs[i][0] * sub_b[j] for i, j in pairs)
        if pivots is None and met >= n_q * n_bb:  # the cells rule out less than they add
            q, b, n_pivots = q.drop("_cell", "_dp"), b.drop("_cell", "_dp"), 1
    if n_pivots == 1:
        q, b = q.withColumn("_cell", F.lit(0)), b.withColumn("_cell", F.lit(0))
        pairs = [(0, 0)]
        sub_b, sub_q = {0: n_bb}, {0: max(1, math.ceil(n_q / rows_per_block), min(workers, math.ceil(n_q / 256)))}
        met, qs, bs = n_q * n_bb, {0: (n_q, 0.0)}, {0: (n_b, 0.0)}
    moved = 8 * dim * (met + sum(bs[j][0] * sub_q[i] for i, j in pairs)) + 32 * k * met
    rounds = min(256, math.ceil(moved / (round_bytes or max(ROUND_BYTES, 4 * 8 * dim * (n_q + n_b)))))
    if rounds > 1:
        at = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit("round")), F.lit(rounds))
        options = {"metric": metric, "exclude_self": exclude_self, "by": by, "block_bytes": block_bytes, "pivots": n_pivots, "collapse": False, "round_bytes": 1 << 62}
        with runtime.tidy(spark):
            found = [runtime.cut_lineage(knn_join(queries.where(at == i), base, k, id_col, vec, **options)) for i in range(rounds)]
        return functools.reduce(DataFrame.unionByName, found)

    # One row per cell pair, at most 256 x 256: a bounded broadcast.
    plan = spark.createDataFrame([(i, j, sub_q[i], sub_b[j]) for i, j in pairs], "qc int, bc int, nq int, nb int")
    plan = F.broadcast(plan)
    q_sub = F.pmod(F.xxhash64("_id"), F.col("nq")).cast("int")
    b_sub = F.pmod(F.xxhash64("_id"), F.col("nb")).cast("int")
    tile = ["qc", "qs", "bc", "bs"]
    qt = q.withColumnRenamed("_cell", "qc").join(plan, "qc").withColumn("qs", q_sub).withColumn("bs", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    bt = b.withColumnRenamed("_cell", "bc").join(plan, "bc").withColumn("bs", b_sub).withColumn("qs", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    keys = [*by, *tile]
    # Fresh column identities: both sides may come from one table.
    bt = bt.select(*[F.col(c).alias(c) for c in [*keys, "_id", "_v"]])
    n_tiles = sum(sub_q[i] * sub_b[j] for i, j in pairs)
    parts = max(1, min(n_tiles if not by else 4 * workers, 20_000))
    qt = qt.select(*keys, "_id", "_v").repartition(parts, *keys)
    bt = bt.select(*keys, "_id", "_v").repartition(parts, *keys)
    fields = [base.schema[c] for c in by]
    schema = T.StructType([*fields, T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("dist", T.DoubleType())])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*by, "src", "dst", "dist"]
        out = []
        if left.num_rows and right.num_rows:
            base = _Base(kernels.matrix(right.column("_v")), right.column("_id").to_numpy())
            for s in range(0, left.num_rows, SLICE_ROWS):
                part = left.slice(s, SLICE_ROWS)
                qid = part.column("_id").to_numpy()
                qi, ci, di = base.nearest(kernels.matrix(part.column("_v")), qid, k, exclude_self)
                dist = di * di / 2.0 if metric == "cosine" else di
                out.append([*[pa.array([key[i].as_py()] * len(qi), type=key[i].type) for i in range(len(by))], pa.array(qid[qi]), pa.array(ci), pa.array(dist)])
        kinds = [*[key[i].type for i in range(len(by))], pa.int64(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays([pa.chunked_array([o[i] for o in out], type=t) for i, t in enumerate(kinds)], names=names)

    near = qt.groupBy(*keys).cogroup(bt.groupBy(*keys)).applyInArrow(run, schema)
    return ranking.top_k(near, [*by, "src"], ["dist", "dst"], k)


# Rows of a block of the pair statistics and of a slice of a tile, leading bits that the first pass counts by, bits of a later pass, and values below which all remaining bits are counted.
PAIR_BLOCK, PAIR_SLICE = 32_768, 128
FIRST_BITS, NEXT_BITS = 20, 16
ALL_BITS_BELOW = 1_000_000
# Rows and columns of a piece of a tile (as much as stays in the processor's cache), rows of a group that the brackets are drawn from, ranges that its distances
# are counted in, and distances inside the brackets that a tile holds at most.
PIECE_ROWS, PIECE_COLUMNS = 128, 1_024
GROUP_ROWS, GROUP_RANGES = 1_024, 4_096
MOST_INSIDE = 4_000_000


def _pair_distances(q: np.ndarray, x: np.ndarray):
    """(first row, distances of a slice of rows to all of ``x``). Pairs that are close for their norms, where the expanded form would
    cancel, are computed again from their differences. The same rows in the same order give the same bits."""
    width = q.shape[1]
    qn, xn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
    for s in range(0, len(q), PAIR_SLICE):
        part = q[s : s + PAIR_SLICE]
        if width <= 16:
            d2 = np.zeros((len(part), len(x)))
            for i in range(width):
                diff = part[:, i, None] - x[None, :, i]
                diff *= diff
                d2 += diff
            yield s, np.sqrt(d2, out=d2)
            continue
        d2 = part @ x.T
        d2 *= -2.0
        norms = qn[s : s + PAIR_SLICE, None] + xn
        d2 += norms
        norms *= 1e-3
        r, c = np.nonzero(~(d2 >= norms))
        d2[r, c] = 0.0
        np.sqrt(d2, out=d2)
        d2[r, c] = _exact(part, x, r, c)
        yield s, d2


class _Side:
    """Rows around a middle, with their squared lengths, as one side of a matrix product that gives squared distances (halved for the cosine)."""

    def __init__(self, x: np.ndarray, middle: np.ndarray, cosine: bool, left: bool):
        self.x, rows = x, x - middle
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = np.einsum("ij,ij->i", rows, rows) * (0.5 if cosine else 1.0)
        one, side = np.ones((len(x), 1)), self.norm[:, None]
        self.a = np.hstack([rows * (-1.0 if cosine else -2.0), side, one]) if left else np.ascontiguousarray(np.hstack([rows, one, side]).T)


def _fill(q: _Side, x: _Side, rows: slice, columns: slice, cosine: bool, out: np.ndarray) -> np.ndarray:
    """Squared distances (halved for the cosine) of a piece. Pairs that are close for their norms, where the expanded form would cancel, are computed from their differences."""
    np.matmul(q.a[rows], x.a[:, columns], out=out)
    near = 1e-2 * (q.norm[rows] + x.norm[columns].max())
    if (out.min(1) >= near).all():
        return out
    close = ~(out >= 1e-2 * (q.norm[rows, None] + x.norm[columns]))
    many = np.count_nonzero(close)
    if many > out.size // 20:
        out[:] = 0.0
        for i in range(q.x.shape[1]):
            diff = q.x[rows, i, None] - x.x[None, columns, i]
            diff *= diff
            out += diff
        if cosine:
            out *= 0.5
    elif many:
        r, c = np.nonzero(close)
        d = _exact(q.x[rows], x.x[columns], r, c)
        out[r, c] = d * d * (0.5 if cosine else 1.0)
    return out


def _pieces(q: np.ndarray, x: np.ndarray, same: bool, cosine: bool):
    """(first row, first column, squared distances) of all pairs of a tile, piece by piece; if both sides are one block each pair once, its own triangles with infinite places."""
    middle = np.median(x[: 4 * GROUP_ROWS], axis=0)
    left, right = _Side(q, middle, cosine, True), _Side(x, middle, cosine, False)
    held = np.empty(PIECE_ROWS * PIECE_COLUMNS)
    for s in range(0, len(q), PIECE_ROWS):
        e = min(s + PIECE_ROWS, len(q))
        if same:
            d = _fill(left, right, slice(s, e), slice(s, e), cosine, held[: (e - s) ** 2].reshape(e - s, e - s))
            d[np.tril_indices(e - s)] = np.inf
            yield s, s, d
        for f in range(e if same else 0, len(x), PIECE_COLUMNS):
            g = min(f + PIECE_COLUMNS, len(x))
            yield s, f, _fill(left, right, slice(s, e), slice(f, g), cosine, held[: (e - s) * (g - f)].reshape(e - s, g - f))


class _Pairs:
    """All pairs of rows as tiles of two blocks, computed again in every pass and never stored."""

    def __init__(self, df: DataFrame, id_col: str, vec: str, metric: str, block: int = PAIR_BLOCK):
        v = vectors.normalise(vec) if metric == "cosine" else F.col(vec).cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where(vectors.usable("_v"))
        self.rows, self.cosine = runtime.cut_lineage(rows), metric == "cosine"
        self.n = self.rows.count()
        spark = df.sparkSession
        few = min(spark.sparkContext.defaultParallelism, math.ceil(self.n / 256))  # a short table is cut for the cores' sake
        self.blocks = max(1, few, math.ceil(self.n / block))

    def groups(self, fn, schema: str) -> DataFrame:
        """``fn`` of the distances inside groups of about GROUP_ROWS rows, dealt by hash: a sample of pairs in which every row has the same share."""
        count, cosine = max(1, self.n // GROUP_ROWS), self.cosine

        def run(group: pa.Table) -> pa.Table:
            x = kernels.matrix(group.column("_v"))
            found = [d[np.isfinite(d)] for _, _, d in _pieces(x, x, True, cosine)]
            v = np.concatenate(found) if found else np.zeros(0)
            return fn(v if cosine else np.sqrt(v))

        g = F.pmod(F.xxhash64("_id", F.lit("group")), F.lit(count)).cast("int")
        return self.rows.select(g.alias("_g"), "_v").groupBy("_g").applyInArrow(run, schema)

    def tiles(self, fn, schema: str, whole: bool = False) -> DataFrame:
        """``fn`` of every tile's (ids, ids, slices); a slice is (first row, distances, distances of pairs): the matrix is infinite
        where rows and columns of one block make no pair, and the flat array leaves these out. ``whole``: ``fn`` of (ids, ids, vectors, vectors, one block)."""
        nb, cosine = self.blocks, self.cosine
        blk = F.pmod(F.xxhash64("_id"), F.lit(nb)).cast("int")
        left = self.rows.withColumn("qs", blk).withColumn("bs", F.explode(F.sequence(F.col("qs"), F.lit(nb - 1))))
        right = self.rows.withColumn("bs", blk).withColumn("qs", F.explode(F.sequence(F.lit(0), F.col("bs"))))
        parts = min(20_000, 2 * nb * (nb + 1))

        def run(key, q: pa.Table, x: pa.Table) -> pa.Table:
            a, c, qv, xv = q.column("_id").to_numpy(), x.column("_id").to_numpy(), kernels.matrix(q.column("_v")), kernels.matrix(x.column("_v"))
            same = key[0].as_py() == key[1].as_py()
            # The same order in every pass, so that every pass sees the same bits.
            o, p = np.lexsort((*qv.T[:1], a)), np.lexsort((*xv.T[:1], c))
            a, qv, c, xv = a[o], qv[o], c[p], xv[p]
            if whole:
                return fn(a, c, qv, xv, same)

            def slices():
                if not len(a) or not len(c):
                    return
                for s, d in _pair_distances(qv, xv):
                    if cosine:
                        d *= d
                        d /= 2.0
                    flat = d.ravel()
                    if same:  # both sides are one block: each pair once
                        pair = np.arange(s, s + len(d))[:, None] < np.arange(len(c))
                        flat = d[pair]
                        d = np.where(pair, d, np.inf)
                    yield s, d, flat

            return fn(a, c, slices())

        sides = [t.select("qs", "bs", F.col("_id").alias("_id"), F.col("_v").alias("_v")).repartition(parts, "qs", "bs").groupBy("qs", "bs") for t in (left, right)]
        return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def _count_bits(bits: np.ndarray, counts: dict) -> None:
    """Add up small integers by value."""
    if not len(bits):
        return
    least = int(bits.min())
    if int(bits.max()) - least < 1 << FIRST_BITS:
        many = np.bincount(bits - least)
        key = np.flatnonzero(many)
        many, key = many[key], key + least
    else:
        key, many = np.unique(bits, return_counts=True)
    for k, m in zip(key.tolist(), many.tolist()):
        counts[k] = counts.get(k, 0) + m


def _squeeze(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal values once, with their counts."""
    v, at = np.unique(values, return_inverse=True)
    return v, np.bincount(at, counts, len(v)).astype(np.int64)


def _pair_totals(a, c, q, x, same: bool, cosine: bool, middle: float, brackets: Sequence[tuple[float, float]], most: int) -> pa.Table:
    """What a tile adds: its moments around ``middle`` (kind 0), each node's nearest (1), distances below each bracket (2) and those inside it (3).

    A tile with more than ``most`` different distances inside a bracket tells so by a NULL and lists none."""
    near_a, near_c = np.full(len(a), np.inf), np.full(len(c), np.inf)
    n, s1, s2, hi = 0, 0.0, 0.0, 0.0
    below, inside, size, full = [0] * len(brackets), [[] for _ in brackets], [0] * len(brackets), [False] * len(brackets)
    for s, f, d in _pieces(q, x, same, cosine) if len(a) and len(c) else ():
        rows, columns = slice(s, s + len(d)), slice(f, f + d.shape[1])
        near_a[rows] = np.minimum(near_a[rows], d.min(1))
        near_c[columns] = np.minimum(near_c[columns], d.min(0))
        if same and s == f:
            d = d[np.triu_indices(len(d), 1)]
            if not len(d):
                continue
        d = d.reshape(-1)
        if not cosine:
            np.sqrt(d, out=d)
        hi = max(hi, float(d.max()))
        for i, (low, high) in enumerate(brackets):
            under, to = d < low, d < high
            few = int(np.count_nonzero(under))
            below[i] += few
            if not full[i] and np.count_nonzero(to) > few:
                to &= ~under
                inside[i].append((d[to], np.ones(int(np.count_nonzero(to)), np.int64)))
                size[i] += len(inside[i][-1][0])
                if size[i] > most:
                    inside[i] = [_squeeze(*(np.concatenate(z) for z in zip(*inside[i])))]
                    size[i] = len(inside[i][0][0])
                    if size[i] > most // 2:
                        full[i], inside[i] = True, []
        d -= middle
        n, s1, s2 = n + len(d), s1 + float(d.sum()), s2 + float(d @ d)
    near, node = np.r_[near_a, near_c], np.r_[a, c]
    met = np.isfinite(near)
    near = near[met] if cosine else np.sqrt(near[met])
    few = [[np.concatenate(z) for z in zip(*rows)] if rows else [np.zeros(0), np.zeros(0, np.int64)] for rows in inside]
    kind = np.repeat([0, 1, 2, 3], [1, len(near), len(brackets), sum(len(v) for v, _ in few)]).astype(np.int32)
    key = np.r_[0, node[met], np.arange(len(brackets)), np.repeat(np.arange(len(brackets)), [len(v) for v, _ in few])].astype(np.int64)
    count = pa.array([n, *[None] * len(near), *[None if z else m for z, m in zip(full, below)]], pa.int64())
    rest = pa.array(np.concatenate([k for _, k in few]).astype(np.int64))
    value = np.r_[s1, near, np.zeros(len(brackets)), np.concatenate([v for v, _ in few])].astype(float)
    more = np.zeros((2, len(kind)))
    more[:, 0] = s2, hi
    return pa.table({"kind": pa.array(kind), "key": pa.array(key), "n": pa.concat_arrays([count, rest]), "value": pa.array(value), "s2": pa.array(more[0]), "hi": pa.array(more[1])})


def _brackets(pairs: _Pairs, shares: Sequence[float]) -> tuple[float, list[tuple[float, float]]]:
    """The mean of a sample of the distances, and for each share a narrow pair of values around that percentile; whether it is inside is only known once all pairs are counted."""
    if pairs.n * (pairs.n - 1) // 2 <= ALL_BITS_BELOW:
        return 0.0, [(-math.inf, math.inf)]
    around = [max(0.0, min(1.0, p + side)) for p in shares for side in (-0.01, 0.01)]

    def first(v: np.ndarray) -> pa.Table:
        row = np.r_[len(v), v.sum(), np.quantile(v, around) * len(v)] if len(v) else np.zeros(2 + len(around))
        return pa.table({"row": kernels.lists(row[None, :])})

    add = lambda t: np.array(t.agg(Summarizer.sum(array_to_vector("row"))).first()[0].toArray())
    total = add(pairs.groups(first, "row array<double>"))
    if not total[0]:
        return 0.0, [(-math.inf, math.inf)] * len(shares)
    edges = [(low * (1 - 1e-9), high * (1 + 1e-9) + 1e-300) for low, high in (total[2:] / total[0]).reshape(-1, 2).tolist()]

    def counts(v: np.ndarray) -> pa.Table:
        rows = [np.bincount(np.clip((v - low) / (high - low) * GROUP_RANGES + 1, 0, GROUP_RANGES + 1).astype(np.int64), minlength=GROUP_RANGES + 2) for low, high in edges]
        return pa.table({"row": kernels.lists(np.concatenate(rows)[None, :])})

    out = []
    for p, (low, high), row in zip(shares, edges, add(pairs.groups(counts, "row array<double>")).reshape(len(edges), -1)):
        m, upto = row.sum(), np.cumsum(row)
        slack = 5 * math.sqrt(p * (1 - p) / m) + 2 / m
        at = int(np.searchsorted(upto, (p - slack) * m)), int(np.searchsorted(upto, (p + slack) * m))
        edge = lambda i: -math.inf if i < 0 else math.inf if i > GROUP_RANGES else low + (high - low) * i / GROUP_RANGES
        out.append((edge(at[0] - 2), edge(at[1] + 1)))
    return float(total[1] / total[0]), out


def _inside(parts: DataFrame, brackets: list[tuple[float, float]], ranks: Sequence[int]) -> dict[int, float] | None:
    """The distances of these ranks among those inside the brackets; None if one is outside, or a bracket was not listed."""
    below = {r["key"]: (r["n"], r["missed"]) for r in parts.where("kind = 2").groupBy("key").agg(F.sum("n").alias("n"), F.count_if(F.col("n").isNull()).alias("missed")).collect()}
    values = parts.where("kind = 3").select("key", "value", "n")
    ends = {r["key"]: (r["low"], r["high"], r["n"]) for r in values.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("n")).collect()}
    where = {}
    for rank in ranks:
        for i, (_, _, n) in ends.items():
            if not below[i][1] and below[i][0] <= rank < below[i][0] + n:
                where[rank] = i, rank - below[i][0]
    if len(where) < len(ranks):
        return None
    # Counts of equal ranges tell in which range a rank is; the values of these few ranges are ranked.
    low, width = F.lit(0.0), F.lit(1.0)
    for i, (a, b, _) in ends.items():
        low, width = F.when(F.col("key") == i, a).otherwise(low), F.when(F.col("key") == i, (b - a) or 1.0).otherwise(width)
    binned = values.withColumn("bin", F.floor((F.col("value") - low) / width * GROUP_RANGES))
    sizes: dict[int, list] = {}
    for r in binned.groupBy("key", "bin").agg(F.sum("n").alias("n")).collect():  # GROUP_RANGES rows a bracket
        sizes.setdefault(r["key"], []).append((r["bin"], r["n"]))
    chosen = {}
    for rank, (i, at) in where.items():
        for b, n in sorted(sizes[i]):
            if at < n:
                chosen[rank] = i, b, at
                break
            at -= n
    picked = F.lit(False)
    for i, b, _ in chosen.values():
        picked = picked | ((F.col("key") == i) & (F.col("bin") == b))
    ranked = runtime.cut_lineage(ranking.value_ranks(binned.where(picked), "value", ["key", "bin"], weight=F.col("n")))
    hits = {}
    for rank, (i, b, at) in chosen.items():
        hits[rank] = ranked.where((F.col("key") == i) & (F.col("bin") == b) & (F.col("before") <= at) & (F.col("before") + F.col("n") > at)).first()["value"]
    runtime.discard(ranked)
    return hits


def _leading_bits(slices, lead: int) -> pa.Table:
    """Counts of a tile's distances by their leading bits."""
    counts: dict[int, int] = {}
    for _, _, flat in slices:
        _count_bits(flat.view(np.int64) >> (64 - lead), counts)
    return pa.table({"key": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})


def _pair_ranks(pairs: _Pairs, counts: DataFrame, ranks: Sequence[int]) -> list[float]:
    """Exact order statistics: distances of equal leading bits are an interval, so counts tell which bits a rank has, and a further pass counts the next ones inside."""
    found = {rank: (0, rank) for rank in ranks}  # leading bits so far, and the rank among the pairs that share them
    known, width, table = 0, FIRST_BITS, counts.withColumn("prefix", F.lit(0).cast("long"))
    while True:
        ranked = runtime.cut_lineage(ranking.value_ranks(table, "key", ["prefix"], weight=F.col("n")))
        sizes = {}
        for rank, (prefix, at) in found.items():
            hit = ranked.where((F.col("prefix") == prefix) & (F.col("before") <= at) & (F.col("before") + F.col("n") > at)).first()
            found[rank] = ((prefix << width) | hit["key"], at - hit["before"])
            sizes[found[rank][0]] = hit["n"]
        known += width
        if known == 64:
            return [float(np.array(found[rank][0], np.int64).view(np.float64)) for rank in ranks]
        width = 64 - known if sum(sizes.values()) <= ALL_BITS_BELOW else min(NEXT_BITS, 64 - known)
        wanted, keep, cut = sorted(sizes), 64 - known, 64 - known - width

        def next_bits(a, c, slices, wanted=tuple(wanted), keep=keep, cut=cut):
            found = {prefix: {} for prefix in wanted}
            for _, _, flat in slices:
                bits = flat.view(np.int64)
                for prefix in wanted:
                    inside = bits[(bits >= prefix << keep) & (bits < (prefix + 1) << keep)]
                    _count_bits((inside >> cut) & ((1 << (keep - cut)) - 1), found[prefix])
            rows = [(prefix, key, n) for prefix, counts in found.items() for key, n in counts.items()]
            return pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("prefix", "key", "n"))})

        table = pairs.tiles(next_bits, "prefix long, key long, n long").groupBy("prefix", "key").agg(F.sum("n").alias("n"))


def distance_concentration(df: DataFrame, id_col: str, vec: str, metric: str = "euclidean", block: int = PAIR_BLOCK) -> DataFrame:
    """Number of pairs, relative contrast, nearest over mean, coefficient of variation and p95/p5 of the distances of all pairs of rows.

    One pass over the tiles returns moments, nearest distances, and the few distances inside the brackets that a sample puts around the
    percentiles, with the numbers of those below. They prove the percentiles, which are exact order statistics; if one is outside its bracket,
    all pairs are counted by their bits (:func:`_pair_ranks`). Vectors that are NULL or hold NULL, NaN or infinite components take no part; without a pair all but n_pairs is NULL.
    """
    pairs = _Pairs(df, id_col, vec, metric, block)
    spark, names = df.sparkSession, "n_pairs long, relative_contrast double, nn_over_mean double, distance_cv double, p95_over_p5 double"
    n = pairs.n * (pairs.n - 1) // 2
    if not n:
        return spark.createDataFrame([(0, None, None, None, None)], names)
    middle, brackets = _brackets(pairs, (0.05, 0.95))
    cosine, most = pairs.cosine, MOST_INSIDE
    parts = runtime.cut_lineage(pairs.tiles(lambda *tile: _pair_totals(*tile, cosine, middle, brackets, most), "kind int, key long, n long, value double, s2 double, hi double", whole=True))
    total = parts.where("kind = 0").agg(F.sum("value").alias("s1"), F.sum("s2").alias("s2"), F.max("hi").alias("hi")).first()
    near = parts.where("kind = 1").groupBy("key").agg(F.min("value").alias("nn")).agg(F.avg("nn").alias("nearest"), F.min("nn").alias("lo")).first()
    mean, spread = middle + total["s1"] / n, math.sqrt(max(total["s2"] / n - (total["s1"] / n) ** 2, 0.0))
    at = [p * (n - 1) for p in (0.05, 0.95)]
    ranks = sorted({int(f(x)) for x in at for f in (math.floor, math.ceil)})
    value = _inside(parts, brackets, ranks)
    if value is None:
        lead = FIRST_BITS
        counts = pairs.tiles(lambda a, c, slices: _leading_bits(slices, lead), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        value = dict(zip(ranks, _pair_ranks(pairs, counts, ranks)))
    p5, p95 = (value[math.floor(x)] + (value[math.ceil(x)] - value[math.floor(x)]) * (x - math.floor(x)) for x in at)
    runtime.discard(parts)
    over = lambda x, y: x / y if y else None
    row = (n, over(total["hi"] - near["lo"], near["lo"]), over(near["nearest"], mean), over(spread, mean), over(p95, p5))
    return spark.createDataFrame([row], names)


def concentration_of_pairs(pairs: DataFrame) -> DataFrame:
    """The same summary for any pair table (a, b, d) with a < b."""
    basic = pairs.agg(
        ((F.max("d") - F.min("d")) / F.min("d")).alias("relative_contrast"), F.avg("d").alias("_mean"),
        (F.stddev_pop("d") / F.avg("d")).alias("distance_cv"), F.count(F.lit(1)).alias("n_pairs"),
    )
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "d").groupBy("node").agg(F.min("d").alias("nn"))
    nn = ends.agg(F.avg("nn").alias("_nn"))
    q = ranking.quantiles(pairs, "d", [0.05, 0.95], names=["_p5", "_p95"])
    one = basic.crossJoin(F.broadcast(nn)).crossJoin(F.broadcast(q))  # one row each
    return one.select("n_pairs", "relative_contrast", (F.col("_nn") / F.col("_mean")).alias("nn_over_mean"), "distance_cv", (F.col("_p95") / F.col("_p5")).alias("p95_over_p5"))


def self_match_share(probe: DataFrame, reference: DataFrame, id_col: str, vec: str) -> DataFrame:
    """Share of probe rows whose most similar reference row (cosine) is the row with the same id."""
    top = knn_join(probe, reference, 1, id_col, vec, metric="cosine", exclude_self=False)
    return top.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("src") == F.col("dst")).cast("double")).alias("self_share"))
