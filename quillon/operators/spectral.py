"""Diffusion maps: self-tuned kernels as edge joins and leading eigenpairs by a distributed block Krylov method."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import graph, kernels, ranking
from quillon.operators.vector_stats import moment_matrix, project
from quillon.runtime import cut_lineage, discard, tidy


def self_tuned_kernel(edges: DataFrame, scale_rank: int = 7) -> DataFrame:
    """exp(-d^2 / (s_u s_v)) with s the distance to the ``scale_rank``-th neighbour, largest of both directions."""
    s = edges.where(F.col("rank") == scale_rank).select(F.col("src").alias("n"), (F.col("dist") + 1e-9).alias("s"))
    w = edges.join(s.select(F.col("n").alias("src"), F.col("s").alias("su")), "src").join(s.select(F.col("n").alias("dst"), F.col("s").alias("sv")), "dst")
    w = w.select("src", "dst", F.exp(-F.col("dist") * F.col("dist") / (F.col("su") * F.col("sv"))).alias("w"))
    return graph.symmetrise(w, "w", "max")


def median_kernel(edges: DataFrame) -> DataFrame:
    """exp(-d^2 / eps) with eps the squared median edge length of the symmetric graph."""
    g = cut_lineage(graph.symmetrise(edges, "dist", "max"))
    eps = ranking.quantiles(g, "w", [0.5], names=["m"]).first()["m"] ** 2
    return g.withColumn("w", F.exp(-F.col("w") * F.col("w") / F.lit(eps)))


def _degree(w: DataFrame, name: str) -> DataFrame:
    return w.groupBy("u").agg(F.sum("w").alias(name))


def _scaled(w: DataFrame, per_node: DataFrame, factor) -> DataFrame:
    d = per_node.toDF("n", "f")
    return (
        w.join(d.select(F.col("n").alias("u"), F.col("f").alias("fu")), "u").join(d.select(F.col("n").alias("v"), F.col("f").alias("fv")), "v")
        .select("u", "v", factor(F.col("w"), F.col("fu"), F.col("fv")).alias("w"))
    )


def normalised_operator(w: DataFrame, alpha_one: bool = True) -> tuple[DataFrame, DataFrame]:
    """Symmetric diffusion operator and node degrees; ``alpha_one`` divides out the sampling density first."""
    if alpha_one:
        w = cut_lineage(_scaled(w, _degree(w, "q"), lambda x, a, b: x / (a * b)))
    deg = cut_lineage(_degree(w, "deg"))
    s = cut_lineage(_scaled(w, deg, lambda x, a, b: x / F.sqrt(a * b)))
    return s, deg


# Most rows of a block of the operator.
BLOCK_ROWS = 65_536
# What a block sends: rows of the newest vectors that another block multiplies (0), its own last two vectors (1) or its part of the basis (2).
SENT = "key int, kind int, source int, x binary"
STATE = "key int, ids binary, receivers binary, counts binary, rows binary, basis binary, product binary, gram array<double>"
PIECE, OWN, BASIS = 0, 1, 2


def _array(value: pa.Scalar, kind, *shape) -> np.ndarray:
    out = np.frombuffer(value.as_buffer(), kind)
    return out.reshape(shape) if shape else out


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _messages(found: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["key", "kind", "source", "x"])


def _pieces(key: int, receivers: np.ndarray, counts: np.ndarray, rows: np.ndarray, x: np.ndarray) -> list:
    """The rows of ``x`` that each other block needs."""
    ends = np.cumsum(counts)
    return [(int(to), PIECE, key, _bytes(x[rows[end - n : end]])) for to, n, end in zip(receivers, counts, ends)]


def _product(ptr: np.ndarray, col: np.ndarray, weight: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of a sparse matrix times ``x``, a thousand rows at a time; every row has an entry."""
    out = np.empty((len(ptr) - 1, x.shape[1]))
    for i in range(0, len(out), 1_024):
        j = min(i + 1_024, len(out))
        lo, hi = ptr[i], ptr[j]
        out[i:j] = np.add.reduceat(x[col[lo:hi]] * weight[lo:hi, None], ptr[i:j] - lo, axis=0)
    return out


def _start(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Uniform numbers in [-0.5, 0.5) from (seed, node, column)."""
    z = ids.astype(np.uint64)[:, None] * np.uint64(width + 1) + np.arange(1, width + 1, dtype=np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z >> np.uint64(11)).astype(float) / 2**53 - 0.5


def _state(key: int, ids, receivers, counts, rows, basis: np.ndarray, product: np.ndarray) -> pa.Table:
    both = np.hstack([basis, product])
    blobs = [pa.array([b], pa.binary()) for b in (ids, receivers, counts, rows, _bytes(basis), _bytes(product))]
    names = ["key", "ids", "receivers", "counts", "rows", "basis", "product", "gram"]
    return pa.Table.from_arrays([pa.array([key], pa.int32()), *blobs, kernels.lists((both.T @ both).reshape(1, -1))], names=names)


class _Blocks:
    """A symmetric edge table cut into blocks of rows, a record each. A block knows which of its rows every other block multiplies, so that
    a product sends a row once to each block that needs it, whatever the number of edges, and no edge is moved after the first time."""

    def __init__(self, s: DataFrame):
        spark = s.sparkSession
        self.n = n = s.agg(F.count_distinct("u")).first()[0]
        self.count = count = max(1, -(-n // BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // 2_048)))
        # Numbers that fall into partitions of their own.
        part = F.pmod(F.hash("key"), F.lit(count))
        found = spark.range(64 * count).select(F.col("id").cast("int").alias("key")).groupBy(part.alias("part")).agg(F.min("key").alias("key")).collect()
        keys = F.array(*[F.lit(k) for k in sorted(r["key"] for r in found)])
        key = lambda c: F.get(keys, F.pmod(F.xxhash64(c), F.lit(len(found))).cast("int"))

        def build(group: tuple[pa.Scalar, ...], edges: pa.Table) -> pa.Table:
            u, v, to, w = (edges.column(c).to_numpy() for c in ("u", "v", "to", "w"))
            ids, row = np.unique(u, return_inverse=True)
            there, col = np.unique(v, return_inverse=True)
            owner = np.empty(len(there), to.dtype)
            owner[col] = to
            place = np.empty(len(there), np.int32)
            place[np.lexsort((there, owner))] = np.arange(len(there), dtype=np.int32)  # pieces come by owner, rows of a piece by id
            o = np.lexsort((v, row))
            receivers = np.unique(to)
            sent = np.unique(np.searchsorted(receivers, to) * len(ids) + row)
            counts = np.bincount(sent // len(ids), minlength=len(receivers))
            arrays = [ids.astype(np.int64), np.searchsorted(row[o], np.arange(len(ids) + 1)).astype(np.int64), place[col[o]], w[o].astype(float), receivers.astype(np.int32), counts.astype(np.int64), (sent % len(ids)).astype(np.int32)]
            return pa.Table.from_arrays([pa.array([group[0].as_py()], pa.int32()), *[pa.array([_bytes(a)], pa.binary()) for a in arrays]], names=["key", "ids", "ptr", "col", "weight", "receivers", "counts", "rows"])

        edges = s.select(key("u").alias("key"), "u", "v", key("v").alias("to"), "w").repartition(count, "key")
        schema = "key int, ids binary, ptr binary, col binary, weight binary, receivers binary, counts binary, rows binary"
        self.stored = cut_lineage(edges.groupBy("key").applyInArrow(build, schema))
        # Kept in its partitions, so that a product does not move the edges again; a lost part is read from the stored table.
        self.table = self.stored.repartition(count, "key").persist()

    def start(self, width: int, seed: int) -> DataFrame:
        def draw(batches):
            for b in batches:
                for r in range(b.num_rows):
                    ids, *rest = (b.column(c)[r].as_buffer().to_pybytes() for c in ("ids", "receivers", "counts", "rows"))
                    basis = _start(np.frombuffer(ids, np.int64), width, seed)
                    yield from _state(b.column("key")[r].as_py(), ids, *rest, basis, np.zeros((len(basis), 0))).to_batches()

        return cut_lineage(self.table.mapInArrow(draw, STATE))

    def step(self, state: DataFrame, change: np.ndarray, first: int, factors: list[tuple]) -> DataFrame:
        """The next state: the basis is (basis, product) times ``change``, the product a polynomial of the operator times its columns from ``first`` on."""
        count, width = self.count, change.shape[1] - first

        def send(basis: bool):
            def fn(batches):
                for b in batches:
                    for r in range(b.num_rows):
                        key = b.column("key")[r].as_py()
                        receivers, counts, rows = (_array(b.column(c)[r], t) for c, t in (("receivers", np.int32), ("counts", np.int64), ("rows", np.int32)))
                        n = len(b.column("ids")[r].as_buffer()) // 8
                        q = np.hstack([_array(b.column(c)[r], float).reshape(n, -1) for c in ("basis", "product")]) @ change
                        if basis:
                            yield _messages([(key, BASIS, key, _bytes(q))])
                        else:
                            x = q[:, first:]
                            yield _messages([*_pieces(key, receivers, counts, rows, x), (key, OWN, key, _bytes(np.hstack([np.zeros_like(x), x])))])

            return fn

        sent = state.mapInArrow(send(False), SENT)
        for f in factors[:-1]:
            sent = _multiply(self.table, sent.repartition(count, "key"), f, False, width)
        sent = sent.unionByName(state.mapInArrow(send(True), SENT)).repartition(count, "key")
        return cut_lineage(_multiply(self.table, sent, factors[-1], True, width))

    def discard(self) -> None:
        self.table.unpersist()
        discard(self.stored)


def _multiply(table: DataFrame, sent: DataFrame, factor: tuple, last: bool, width: int) -> DataFrame:
    """(a S + b) x + c y for the block x of ``width`` columns and the block y before it: what the blocks send next, or the new state."""
    a, b, c = factor

    def run(group: tuple[pa.Scalar, ...], block: pa.Table, got: pa.Table) -> pa.Table:
        key = group[0].as_py()
        ids, receivers, counts, rows = (block.column(name)[0] for name in ("ids", "receivers", "counts", "rows"))
        ptr, col, weight = _array(block.column("ptr")[0], np.int64), _array(block.column("col")[0], np.int32), _array(block.column("weight")[0], float)
        by = sorted(zip(got.column("kind").to_pylist(), got.column("source").to_pylist(), range(got.num_rows)))
        take = lambda kind: [_array(got.column("x")[at], float) for k, _, at in by if k == kind]
        x = np.concatenate([piece.reshape(-1, width) for piece in take(PIECE)])
        if len(col) and int(col.max()) + 1 != len(x):
            raise ValueError("the edge table is not symmetric")
        own = take(OWN)[0].reshape(len(ptr) - 1, 2 * width)
        y = a * _product(ptr, col, weight, x) + b * own[:, width:] + c * own[:, :width]
        if last:
            basis = take(BASIS)[0].reshape(len(y), -1)
            return _state(key, *(v.as_buffer().to_pybytes() for v in (ids, receivers, counts, rows)), basis, y)
        pieces = _pieces(key, _array(receivers, np.int32), _array(counts, np.int64), _array(rows, np.int32), y)
        return pa.Table.from_batches([_messages([*pieces, (key, OWN, key, _bytes(np.hstack([own[:, width:], y])))])])

    return table.groupBy("key").cogroup(sent.groupBy("key")).applyInArrow(run, STATE if last else SENT)


def _gram(state: DataFrame) -> np.ndarray:
    """Inner products of the columns of (basis, product), added up over the blocks."""
    g = np.array(state.agg(Summarizer.sum(array_to_vector("gram"))).first()[0].toArray())
    return g.reshape(int(np.sqrt(len(g))), -1)


class Eigenpairs:
    """values (descending), a table (node, vector array<double>) and the residual norms |S v - value v|."""

    def __init__(self, values, vectors: DataFrame, residuals):
        self.values, self.vectors, self.residuals = values, vectors, residuals


# Blocks that the basis may hold before it is cut back to its best Ritz vectors and the newest block, steps before the spectrum is known well
# enough to be filtered, and the (odd) degree of the filter.
MOST_BLOCKS, PLAIN_STEPS, DEGREE = 10, 5, 7


def _ritz(t: np.ndarray, qq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs (descending) of the projected matrix in the metric of the basis."""
    li = np.linalg.inv(np.linalg.cholesky((qq + qq.T) / 2))
    w, z = np.linalg.eigh(li @ ((t + t.T) / 2) @ li.T)
    return w[::-1], li.T @ z[:, ::-1]


def _filter(low: float, cut: float, top: float) -> list[tuple]:
    """Factors of the Chebyshev polynomial that is small between ``low`` and ``cut`` and 1 at ``top``. It is odd: values below ``low`` become negative."""
    e, h = (cut + low) / 2, (cut - low) / 2
    at = [1.0, (top - e) / h]
    while len(at) <= DEGREE:
        at.append(2 * at[1] * at[-1] - at[-2])
    return [((1 + (i > 1)) / h * at[i - 1] / at[i], -(1 + (i > 1)) * e / h * at[i - 1] / at[i], 0.0 if i == 1 else -at[i - 2] / at[i]) for i in range(1, DEGREE + 1)]


def _rayleigh(blocks: _Blocks, state: DataFrame, best: np.ndarray) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """Eigenvalues, vectors and residual norms |S v - value v| from one multiplication of the vectors by the operator itself."""
    m = best.shape[1]
    done = blocks.step(state, best, 0, [(1.0, 0.0, 0.0)])
    g = _gram(done)
    vv, vs, ss = g[:m, :m], g[:m, m:], g[m:, m:]
    w, z = _ritz(vs, vv)
    z = z * np.where(z[np.abs(z).argmax(0), np.arange(m)] < 0, -1.0, 1.0)
    square = np.einsum("ij,ij->j", z, ss @ z) - 2 * w * np.einsum("ij,ij->j", z, vs @ z) + w**2 * np.einsum("ij,ij->j", z, vv @ z)

    def rows(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids = _array(b.column("ids")[r], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), kernels.lists(_array(b.column("basis")[r], float).reshape(len(ids), -1) @ z)], names=["node", "vector"])

    vectors = cut_lineage(done.mapInArrow(rows, "node long, vector array<double>"))
    discard(done)
    return w, vectors, np.sqrt(np.maximum(square, 0.0))


def top_eigenpairs(s: DataFrame, m: int, steps: int = 5, max_steps: int = 600, tol: float = 1e-5, seed=0) -> Eigenpairs:
    """Leading eigenpairs of a symmetric edge table by block Krylov with Rayleigh-Ritz and thick restarts.

    Each step multiplies the newest block only and orthogonalises it with coefficients from a small Gram matrix; only that
    matrix reaches the driver. The same matrix holds the new rows of the projected operator, and what the newest block
    leaves outside the basis bounds the residuals, so the basis is never multiplied again. After PLAIN_STEPS steps the
    operator's place is taken by its polynomial that damps all but the highest Ritz values: it has the same vectors in
    the same order, needs fewer steps, and its products follow each other in one job. The vectors returned, their values
    and residuals are those of the operator itself.
    """
    with tidy(s.sparkSession):
        blocks = _Blocks(s)
        try:
            return _eigenpairs(blocks, m, steps, max_steps, tol, seed)
        finally:
            blocks.discard()


def _eigenpairs(blocks: _Blocks, m: int, steps: int, max_steps: int, tol: float, seed: int) -> Eigenpairs:
    n = blocks.n
    m = min(m, n)
    b = min(m + 2, n)
    state = blocks.start(b, seed)
    g = _gram(state)
    lam, u = np.linalg.eigh(g)
    keep = lam > lam[-1] * 1e-12
    change, first, known, factors = u[:, keep] / np.sqrt(lam[keep]), 0, np.zeros((0, 0)), [(1.0, 0.0, 0.0)]
    step = 0
    while True:
        step += 1
        before, state = state, blocks.step(state, change, first, factors)
        discard(before)
        p = change.shape[1]
        g = _gram(state)
        qq, qy, yy = g[:p, :p], g[:p, p:], g[p:, p:]
        t = np.zeros((p, p))
        t[:first, :first] = known
        t[:, first:] = qy
        t[first:, :first] = qy[:first].T
        w, z = _ritz(t, qq)
        c = np.linalg.solve(qq, qy)
        rest = yy - qy.T @ c
        rest = (rest + rest.T) / 2
        lam, u = np.linalg.eigh(rest)
        fresh = min(int((lam > max(1e-13 if len(factors) == 1 else 0.0, 1e-11 * np.trace(yy) / len(yy))).sum()), n - p)
        outside = np.sqrt(np.maximum(np.einsum("ij,ij->j", z[first:, :m], rest @ z[first:, :m]), 0.0))
        if len(factors) > 1:
            outside = gap * outside / np.abs(w[:m])  # about that of the operator
        if not fresh or (step >= steps and p >= m and outside.max() <= tol):
            values, vectors, res = _rayleigh(blocks, state, np.vstack([z[:, :m], np.zeros((len(yy), min(m, p)))]))
            if not fresh or res.max() <= tol:
                discard(state)
                return Eigenpairs(values, vectors, res)
            discard(vectors)
        if step >= max_steps:
            raise RuntimeError(f"eigenpairs did not settle in {max_steps} steps: largest residual {outside.max():.2e}, tolerance {tol:.0e}")
        if len(factors) == 1 and step == PLAIN_STEPS and p > 2 * b:
            low, cut = w[-1] - 0.05 * (w[0] - w[-1]), w[2 * b]  # at least 2 b values are not below the cut
            if cut > low and w[0] > cut:
                factors, gap, first, known = _filter(low, cut, w[0]), w[0] - cut, 0, np.zeros((0, 0))
                change = np.vstack([z[:, :b], np.zeros((len(yy), b))])
                continue
        r = u[:, -fresh:] / np.sqrt(lam[-fresh:])
        kept = p if p + fresh <= MOST_BLOCKS * b else min(p, max(m + 2 * b, MOST_BLOCKS // 2 * b))
        change = np.zeros((g.shape[0], kept + fresh))
        change[:p, :kept] = np.eye(p) if kept == p else z[:, :kept]
        known = t if kept == p else np.diag(w[:kept])
        change[:p, kept:] = -c @ r
        change[p:, kept:] = r
        first = kept


def diffusion_map(edges: DataFrame, m: int, scale_rank: int = 7, kernel: str = "self_tuned", **kw) -> tuple[Eigenpairs, DataFrame]:
    """Eigenpairs of the diffusion operator and coordinates value_j phi_j (j >= 1) per node."""
    w = cut_lineage(self_tuned_kernel(edges, scale_rank) if kernel == "self_tuned" else median_kernel(edges))
    s, deg = normalised_operator(w, alpha_one=kernel == "self_tuned")
    pairs = top_eigenpairs(s, m, **kw)
    scale = np.diag(pairs.values)[:, 1:]
    phi = project(pairs.vectors, "vector", scale, "coords").join(deg.withColumnRenamed("u", "node"), "node")
    root = F.sqrt("deg") if kernel == "self_tuned" else F.lit(1.0)
    coords = phi.select("node", F.transform("coords", lambda x: x / root).alias("coords"))
    return pairs, cut_lineage(coords)


def spectrum_table(spark, pairs: Eigenpairs) -> DataFrame:
    v = pairs.values
    rows = [(i, float(x), float(v[i] - v[i + 1]) if i + 1 < len(v) else None, float(r)) for i, (x, r) in enumerate(zip(v, pairs.residuals))]
    return spark.createDataFrame(rows, "i int, eigenvalue double, gap double, residual double")


def k_sensitivity(edges: DataFrame, ks: Sequence[int], m: int, **kw) -> DataFrame:
    """Components and the largest non-trivial spectral gap for several neighbour counts of one edge table."""
    spark = edges.sparkSession
    rows = []
    for k in ks:
        e = edges.where(F.col("rank") <= k)
        pairs, _ = diffusion_map(e, m, **kw)
        gaps = pairs.values[1:-1] - pairs.values[2:]
        n_comp = graph.components(e, u="src", v="dst").select("component").distinct().count()
        rows.append((int(k), int(n_comp), int(gaps.argmax()) + 1, float(gaps.max()), float(pairs.values[1])))
    return spark.createDataFrame(rows, "k int, n_components int, gap_index int, gap double, second_eigenvalue double")


def harmonic_r2(coords: DataFrame, vec: str) -> DataFrame:
    """R^2 of each further coordinate on the quadratics of the first three, from one moment matrix."""
    x = [F.col(vec)[i] for i in range(3)]
    feats = F.array(*x, *[a * a for a in x], x[0] * x[1], x[0] * x[2], x[1] * x[2])
    t = coords.select(F.concat(feats, F.col(vec)).alias("a"))
    mom = moment_matrix(t, "a")
    n = mom[0, 0]
    d = mom.shape[0] - 1 - 9
    mu = mom[0] / n
    cov = mom / n - np.outer(mu, mu)
    p = cov[1:10, 1:10]
    scale = np.sqrt(np.maximum(np.diag(p), 1e-300))
    rows = []
    for j in range(3, d):
        c = cov[1:10, 10 + j]
        sol = np.linalg.lstsq(p / np.outer(scale, scale), c / scale, rcond=None)[0]
        rows.append((j, float((c / scale) @ sol / cov[10 + j, 10 + j])))
    return coords.sparkSession.createDataFrame(rows, "coordinate int, r2 double")
