import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import graph, knn, spectral, vector_stats as V
from quillon.runtime import cut_lineage


def frame(spark, m, **extra):
    rows = [(i, [float(x) for x in v], *[int(e[i]) for e in extra.values()]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id long, v array<double>" + "".join(f", {k} int" for k in extra))


def brute(q, b, k, skip=True, gq=None, gb=None):
    out = {}
    for i, x in enumerate(q):
        d = np.sqrt(((b - x) ** 2).sum(1))
        c = sorted((d[j], j) for j in range(len(b)) if not (skip and i == j) and (gq is None or gq[i] == gb[j]))
        out[i] = [j for _, j in c[:k]]
    return out


def edges_of(e):
    out = {}
    for r in e.orderBy("src", "rank").collect():
        out.setdefault(r["src"], []).append(r["dst"])
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    m = np.concatenate([rng.normal(c, 0.3, (120, 5)) for c in (0, 4, 9)])
    m[200:260] = m[200]  # a block of copies
    return m


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 2000, "pivots": 1, "collapse": False}, {"block_bytes": 2000, "pivots": 12, "collapse": False}, {"block_bytes": 2000, "collapse": True}])
def test_neighbours_are_exact(spark, clustered, kw):
    df = frame(spark, clustered)
    e = cut_lineage(knn.knn_join(df, df, 4, "id", "v", **kw))
    want = brute(clustered, clustered, 4)
    assert edges_of(e) == want
    assert e.where((F.col("src") == F.col("dst"))).count() == 0


@pytest.mark.parametrize("kind", ["plain", "copies", "far", "one far"])
def test_tile_search_is_exact_and_small(kind):
    """Rows chosen in single precision are those of a plain search in doubles, ties by id, and few matrices are held at once."""
    rng = np.random.default_rng(3)
    x, ids = rng.standard_normal((20_000, 16)), rng.permutation(60_000)[:20_000]
    if kind == "copies":
        x = np.repeat(x[:400], 50, 0)
    elif kind == "far":
        x = 1e-4 * x + 1e4
    elif kind == "one far":
        x[0] *= 1e9
    tracemalloc.start()
    row, found, dist = knn._nearest(x[:400], ids[:400], x, ids, 5, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in range(0, 400, 20):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        best = np.lexsort((ids, d))[:5]
        assert found[row == i].tolist() == ids[best].tolist() and np.allclose(dist[row == i], d[best], rtol=1e-12)
    assert peak < (64e6 if kind in ("plain", "far") else 256e6)  # several matrices of 32 MB before


def test_pivots_prune_far_cells():
    p = np.array([[0.0], [100.0], [200.0]])
    pairs = knn.candidate_cells({0: 1.0, 1: 1.0, 2: 1.0}, {0: 1.0, 1: 1.0, 2: 1.0}, {0: 50, 1: 50, 2: 50}, p, 5)
    assert sorted(pairs) == [(0, 0), (1, 1), (2, 2)]


def test_neighbours_inside_strata(spark, clustered):
    g = np.arange(len(clustered)) % 2
    df = frame(spark, clustered, g=g)
    e = knn.knn_join(df, df, 3, "id", "v", by=["g"])
    assert edges_of(e) == brute(clustered, clustered, 3, gq=g, gb=g)


def test_moments_components_whitening(spark, clustered):
    df = frame(spark, clustered)
    a = np.hstack([np.ones((len(clustered), 1)), clustered])
    assert np.allclose(V.moment_matrix(df, "v"), a.T @ a)
    c = V.Components(df, "v")
    w = np.sort(np.linalg.eigvalsh(np.cov(clustered.T)))[::-1]
    assert np.allclose(c.variances, w) and np.isclose(c.participation(), w.sum() ** 2 / (w**2).sum())
    k = V.whitening_matrix(df, "v", 1e-6)
    assert np.allclose(np.cov((clustered @ k).T), np.eye(5), atol=1e-3)


def test_axis_statistics_tell_three_clouds_apart(spark):
    rng = np.random.default_rng(2)
    c = rng.standard_normal(16)
    c /= np.linalg.norm(c)
    sign = rng.choice([-1, 1], 400)
    clouds = {"sign": np.outer(sign, c) * 5, "offset": np.outer(np.ones(400), c) * 5, "noise": np.zeros((400, 16))}
    got = {k: V.axis_structure(frame(spark, m + rng.standard_normal((400, 16)) * 0.5), "v").first() for k, m in clouds.items()}
    assert abs(got["sign"]["sign_balance"] - 0.5) < 0.1 and got["sign"]["mean_over_median"] < 0.2 and got["sign"]["leading_share"] > 0.7
    assert got["offset"]["sign_balance"] in (0.0, 1.0) and got["offset"]["mean_over_median"] > 0.8
    assert got["noise"]["leading_share"] < 0.2


def test_dimension_of_known_shapes(spark):
    rng = np.random.default_rng(0)
    s = rng.standard_normal((1500, 6))
    s /= np.linalg.norm(s, axis=1, keepdims=True)
    e = cut_lineage(knn.knn_join(frame(spark, s), frame(spark, s), 32, "id", "v"))
    assert abs(graph.twonn(e).first()["mle"] - 5) < 0.5
    assert abs({r["scale"]: r["dimension"] for r in graph.gride(e, [1, 16]).collect()}[16] - 5) < 0.7
    assert abs(graph.local_mle_pooled(e, [20]).first()["dimension"] - 5) < 0.7


def _random_graph(rng, n, m):
    e = {tuple(sorted(rng.choice(n, 2, replace=False))) for _ in range(m)}
    return sorted((int(a), int(b)) for a, b in e)


def test_components_forest_and_paths(spark):
    rng = np.random.default_rng(4)
    n = 120
    e = _random_graph(rng, n, 100)
    w = {p: round(float(rng.random()), 3) for p in e}
    df = spark.createDataFrame([(a, b, w[a, b]) for a, b in e] + [(b, a, w[a, b]) for a, b in e], "u long, v long, w double")
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total, picked = 0.0, 0
    for (a, b), x in sorted(w.items(), key=lambda kv: (kv[1], kv[0])):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            total += x
            picked += 1
    want = {i: min(j for j in range(n) if find(j) == find(i)) for i in range(n)}
    got = {r["node"]: r["component"] for r in graph.components(df, spark.range(n)).collect()}
    assert got == want
    f = graph.spanning_forest(df).collect()
    assert len(f) == picked and abs(sum(r["w"] for r in f) - total) < 1e-9
    adj = {}
    for (a, b), x in w.items():
        adj.setdefault(a, []).append((b, x))
        adj.setdefault(b, []).append((a, x))
    src = e[0][0]
    dist, todo = {src: 0.0}, {src}
    while todo:
        u = min(todo, key=dist.get)
        todo.discard(u)
        for v, x in adj[u]:
            if dist[u] + x < dist.get(v, 1e9) - 1e-12:
                dist[v] = dist[u] + x
                todo.add(v)
    lm = spark.createDataFrame([(src,)], "landmark long")
    p = {r["node"]: r["d"] for r in graph.geodesics(df, lm, require_connected=False).collect()}
    assert set(p) == set(dist) and all(abs(p[k] - dist[k]) < 1e-9 for k in p)
    with pytest.raises(ValueError):
        graph.geodesics(df, lm)


def test_triangles_of_a_hub(spark):
    e = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(1, 39)]
    df = spark.createDataFrame([(a, b) for a, b in e] + [(b, a) for a, b in e], "u long, v long")
    assert graph.triangles(df).count() == 38
    t = {(r["u"], r["v"]): r["tri"] for r in graph.forman(df).collect()}
    assert t[(0, 1)] == 1 and t[(0, 5)] == 2 and t[(5, 6)] == 1


def test_ollivier_of_several_sizes_joins_once(spark):
    df = frame(spark, np.random.default_rng(5).standard_normal((60, 4)))
    e = cut_lineage(knn.knn_join(df, df, 6, "id", "v"))
    got = graph.ollivier(e, df, "id", "v", ks=(3, 6)).collect()
    for k in (3, 6):
        want = {(r["u"], r["v"]): r["curvature"] for r in graph.ollivier(e.where(F.col("rank") <= k), df, "id", "v").collect()}
        one = {(r["u"], r["v"]): r["curvature"] for r in got if r["k"] == k}
        assert len(want) == 60 * k and one.keys() == want.keys()
        assert all(abs(one[p] - want[p]) < 1e-12 for p in want)


def test_ollivier_of_exact_cases(spark):
    """Two far pairs of twins: transport between identical neighbourhoods costs nothing, so curvature is known."""
    p = np.array([[0.0], [1.0], [2.0], [3.0], [4.0], [5.0]])
    df = frame(spark, p)
    e = cut_lineage(knn.knn_join(df, df, 2, "id", "v"))
    got = {(r["u"], r["v"]): r["curvature"] for r in graph.ollivier(e, df, "id", "v").collect()}
    nb = edges_of(e)

    def w1(u, v):
        mass = np.zeros(6)
        mass[u] += 0.5
        mass[v] -= 0.5
        for x in nb[u]:
            mass[x] += 0.25
        for x in nb[v]:
            mass[x] -= 0.25
        return np.abs(np.cumsum(mass))[:-1].sum()

    for (u, v), k in got.items():
        assert abs(k - (1 - w1(u, v) / abs(u - v))) < 1e-9


def test_transport_is_exact():
    """Against all assignments of equal parcels, and against the distance of distribution functions on a line."""
    rng = np.random.default_rng(5)
    cost, mu, nu, want = [], [], [], []
    for _ in range(40):
        c = np.round(rng.exponential(1, (4, 5)), 1)
        m, v = rng.multinomial(6, np.ones(4) / 4), rng.multinomial(6, np.ones(5) / 5)
        rows, cols = np.repeat(np.arange(4), m), np.repeat(np.arange(5), v)
        want.append(min(c[rows, cols[list(p)]].sum() for p in itertools.permutations(range(6))) / 6)
        cost.append(c), mu.append(m / 6), nu.append(v / 6)
    assert np.allclose(graph._transport(np.array(cost), np.array(mu), np.array(nu)), want, atol=1e-10)
    x, y = rng.standard_normal((300, 16)), rng.standard_normal((300, 16)) + rng.normal(0, 1, (300, 1))
    w = np.r_[0.5, np.full(15, 0.5 / 15)]
    y[:50, 3:] = x[:50, 3:]  # shared neighbours
    got = graph._transport(np.abs(x[:, :, None] - y[:, None, :]), np.tile(w, (300, 1)), np.tile(w, (300, 1)))
    for g, a, b in zip(got, x, y):
        p = np.concatenate([a, b])
        o = np.argsort(p)
        assert abs(g - (np.abs(np.cumsum(np.concatenate([w, -w])[o]))[:-1] * np.diff(p[o])).sum()) < 1e-9


def test_diffusion_eigenpairs(spark, clustered):
    df = frame(spark, clustered[:150] + np.random.default_rng(1).normal(0, 1e-3, (150, 5)))
    e = cut_lineage(knn.knn_join(df, df, 12, "id", "v"))
    w = cut_lineage(spectral.self_tuned_kernel(e))
    s, deg = spectral.normalised_operator(w)
    m = np.zeros((150, 150))
    for r in s.collect():
        m[r["u"], r["v"]] = r["w"]
    assert np.allclose(m, m.T)
    got = spectral.top_eigenpairs(s, 4)
    want = np.sort(np.linalg.eigvalsh(m))[::-1][:4]
    assert np.allclose(got.values, want, atol=1e-6) and max(got.residuals) < 1e-4


def test_eigenpairs_multiply_the_newest_block_only(spark, monkeypatch):
    """A ring of close eigenvalues takes many steps and restarts; no multiplication is wider than a block."""
    n, m = 40, 3
    rows = [(i, (i + d) % n, 0.5) for i in range(n) for d in (-1, 1)]
    s = cut_lineage(spark.createDataFrame(rows, "u long, v long, w double"))
    widths, multiply = [], spectral._multiply
    monkeypatch.setattr(spectral, "_multiply", lambda *a: widths.append(a[-1]) or multiply(*a))
    monkeypatch.setattr(spectral, "MOST_BLOCKS", 4)
    got = spectral.top_eigenpairs(s, m)
    want = np.sort(np.cos(2 * np.pi * np.arange(n) / n))[::-1][:m]
    assert np.allclose(got.values, want, atol=1e-8) and max(got.residuals) <= 1e-5
    assert max(widths) <= m + 2 and len(widths) > 5
    v = np.zeros((n, m))
    for r in got.vectors.collect():
        v[r["node"]] = r["vector"]
    a = np.zeros((n, n))
    for i, j, x in rows:
        a[i, j] = x
    assert np.allclose(a @ v, v * got.values, atol=1e-4) and np.allclose(v.T @ v, np.eye(m), atol=1e-6)


def test_eigenpairs_of_a_long_ring_take_few_steps(spark, monkeypatch):
    """Close eigenvalues, in several blocks: products of one step follow each other in one job, and a block is sent a row once however many edges it has there."""
    n, m = 400, 3
    rows = [(i, (i + d) % n, 0.25) for i in range(n) for d in (-2, -1, 1, 2)]
    s = cut_lineage(spark.createDataFrame(rows, "u long, v long, w double"))
    monkeypatch.setattr(spectral, "BLOCK_ROWS", 64)
    got = spectral.top_eigenpairs(s, m, max_steps=30)
    k = 2 * np.pi * np.arange(n) / n
    want = np.sort((np.cos(k) + np.cos(2 * k)) / 2)[::-1][:m]
    assert np.allclose(got.values, want, atol=1e-8) and max(got.residuals) <= 1e-5
    blocks = spectral._Blocks(s)
    records = blocks.stored.collect()
    assert blocks.count == len(records) == 7 and sum(len(r["ids"]) // 8 for r in records) == n
    assert sum(len(r["weight"]) // 8 for r in records) == len(rows) > sum(len(r["rows"]) // 4 for r in records)
    blocks.discard()


def test_eigenpairs_need_a_symmetric_table(spark):
    s = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (3, 0, 1.0)], "u long, v long, w double")
    with pytest.raises(Exception, match="not symmetric"):
        spectral.top_eigenpairs(s, 2)


def test_neighbours_in_rounds(spark, monkeypatch):
    """What a search moves beyond its bytes is moved in rounds, stored one after another, and cells that rule nothing out are not used."""
    rng = np.random.default_rng(7)
    df = frame(spark, rng.standard_normal((400, 8)))
    want = sorted(tuple(r) for r in knn.knn_join(df, df, 5, "id", "v").collect())
    stored, store, asked = [], knn.runtime.cut_lineage, []
    join = knn.knn_join
    monkeypatch.setattr(knn.runtime, "cut_lineage", lambda d: stored.append(1) or store(d))
    monkeypatch.setattr(knn, "knn_join", lambda *a, **kw: asked.append(kw["pivots"]) or join(*a, **kw))
    got = join(df, df, 5, "id", "v", block_bytes=8 * 8 * 50, round_bytes=150_000)
    assert len(stored) > 1 and asked == [1] * len(stored)
    assert sorted(tuple(r) for r in got.collect()) == want
    monkeypatch.setattr(knn, "ROUND_BYTES", 1)
    assert join(df, df, 5, "id", "v", block_bytes=8 * 8 * 50).count() == 2000
