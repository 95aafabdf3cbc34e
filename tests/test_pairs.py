"""Statistics of all pairs of rows, recomputed tile by tile, against NumPy."""

import numpy as np
import pytest

from quillon.operators import knn


def numbers(x):
    d = np.linalg.norm(x[:, None] - x[None, :], axis=2)
    i = np.triu_indices(len(x), 1)
    near = (d + np.diag(np.full(len(x), np.inf))).min(1)
    p = np.quantile(d[i], [0.05, 0.95])
    return len(i[0]), (d[i].max() - d[i].min()) / d[i].min(), near.mean() / d[i].mean(), d[i].std() / d[i].mean(), p[1] / p[0]


@pytest.mark.parametrize("block, few, first", [(2048, 1_000_000, 20), (50, 30, 14), (37, 0, 8)])
def test_all_pairs_match_numpy(spark, monkeypatch, block, few, first):
    """Also with many blocks, and with distances told apart a few bits at a time."""
    monkeypatch.setattr(knn, "ALL_BITS_BELOW", few)
    monkeypatch.setattr(knn, "FIRST_BITS", first)
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((230, 4)) * np.exp(rng.normal(size=(230, 1))), 3)
    rows = [(int(i), [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (901, [1.0, float("nan"), 0.0, 0.0])]
    got = knn.distance_concentration(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), "id", "v", block=block).first()
    assert got["n_pairs"] == 230 * 229 // 2 and np.allclose(tuple(got), numbers(x), rtol=1e-12)


def test_equal_rows_and_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i // 2), 0.0]) for i in range(6)], "id long, v array<double>")
    got = knn.distance_concentration(df, "id", "v").first()
    assert got["n_pairs"] == 15 and got["relative_contrast"] is None and got["nn_over_mean"] == 0.0
    for some in (df.limit(1), df.limit(0)):
        assert tuple(knn.distance_concentration(some, "id", "v").first()) == (0, None, None, None, None)


def test_wide_rows_close_together_far_from_zero():
    """The expanded form would lose these distances; the same rows give the same bits again."""
    rng = np.random.default_rng(3)
    x = 1e4 + rng.standard_normal((300, 40))
    x[1] = x[0]
    x[200:] = rng.standard_normal((100, 40))
    got = np.vstack([d for _, d in knn._pair_distances(x, x)])
    assert np.allclose(got, np.linalg.norm(x[:, None] - x[None, :], axis=2), rtol=1e-11, atol=0) and got[0, 1] == 0.0
    assert (got == np.vstack([d for _, d in knn._pair_distances(x, x.copy())])).all()


def test_a_tile_is_never_listed_pair_by_pair(spark):
    """A block of the pair statistics is taken in slices: what is held at once does not grow with the block."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((knn.PAIR_SLICE * 3 + 5, 20))
    taken = [(s, d.shape) for s, d in knn._pair_distances(x, x)]
    assert [s for s, _ in taken] == [0, knn.PAIR_SLICE, 2 * knn.PAIR_SLICE, 3 * knn.PAIR_SLICE] and max(len(x) * n for _, (n, _) in taken) <= len(x) * knn.PAIR_SLICE
    got = knn.distance_concentration(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", block=200).first()
    assert np.allclose(tuple(got), numbers(x), rtol=1e-11)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_all_pairs_are_met_once(spark, monkeypatch, metric):
    """Brackets from a sample prove the percentiles in one pass over the tiles; brackets that miss them, or hold too much, only cost more passes."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 20)) + 3.0
    x[700:760] = x[:60]
    x[800:] += 40.0 * rng.standard_normal((1, 20))  # two clusters that are far from each other
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    y = x / np.linalg.norm(x, axis=1)[:, None] if metric == "cosine" else x
    d = np.linalg.norm(y[:, None] - y[None, :], axis=2)
    d = d * d / 2 if metric == "cosine" else d
    i = np.triu_indices(len(x), 1)
    p = np.quantile(d[i], [0.05, 0.95])
    want = (d + np.diag(np.full(len(x), np.inf))).min(1).mean() / d[i].mean(), d[i].std() / d[i].mean(), p[1] / p[0]
    passes, tiles = [], knn._Pairs.tiles
    monkeypatch.setattr(knn._Pairs, "tiles", lambda self, *a, **kw: passes.append(1) or tiles(self, *a, **kw))
    found = knn._brackets

    def check(n):
        passes.clear()
        got = knn.distance_concentration(df, "id", "v", metric, block=600).first()
        assert got["n_pairs"] == len(i[0]) and got["relative_contrast"] is None and np.allclose(tuple(got)[2:], want, rtol=1e-10) and (len(passes) == n if n else len(passes) > 1)

    check(1)
    monkeypatch.setattr(knn, "_brackets", lambda *a: (1.0, [(0.0, 1e-3), (1e9, 1e10)]))
    check(None)
    monkeypatch.setattr(knn, "_brackets", lambda *a: (found(*a)[0], [(-np.inf, np.inf)] * 2))
    monkeypatch.setattr(knn, "MOST_INSIDE", 50)
    check(None)
