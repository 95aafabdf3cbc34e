import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import special
from quillon.operators import probes as L, shifts


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 6))
    th = rng.uniform(-np.pi / 2, np.pi / 2, 400)
    x[:, 0] = np.cos(2 * th) + rng.normal(0, 0.3, 400)
    x[:, 1] = np.sin(2 * th) + rng.normal(0, 0.3, 400)
    y = x @ np.array([1.0, -2.0, 0.5, 0, 0, 0]) + rng.normal(0, 0.5, 400) + 3
    rows = [(i, [float(a) for a in x[i]], float(y[i]), float(th[i]), float(rng.uniform(-np.pi / 2, np.pi / 2))) for i in range(400)]
    return spark.createDataFrame(rows, "id long, v array<double>, y double, theta double, noise double").cache(), x, y


def test_ridge_and_leave_one_out(data):
    df, x, y = data
    m = L.Moments(L.V.moment_matrix(df, "v", ["y"]), 1)
    xc, yc = x - x.mean(0), y - y.mean()
    for a in (0.1, 100.0):
        w = np.linalg.solve(xc.T @ xc + a * np.eye(6), xc.T @ yc)
        assert np.allclose(m.fit([a]).coef[:, 0], w)
    err = L.loo_errors(df, "v", ["y"], m, L.ALPHAS)
    for k in (1, 5):
        tot = 0.0
        for i in range(0, 400):
            keep = np.arange(400) != i
            xm, ym = x[keep].mean(0), y[keep].mean()
            xs = x[keep] - xm
            w = np.linalg.solve(xs.T @ xs + L.ALPHAS[k] * np.eye(6), xs.T @ (y[keep] - ym))
            tot += (y[i] - ym - (x[i] - xm) @ w) ** 2
        assert abs(err[k, 0] - tot) / tot < 1e-6


def test_circular_probe_recovers_and_nulls(data):
    df, _, _ = data
    good = L.circular_probe(df, "id", "v", "theta", 2, n_boot=30).first()
    assert good["med_err"] < 12 and good["med_err_lo"] <= good["med_err"] <= good["med_err_hi"] and good["chance"] == 45.0
    null = L.circular_probe(df, "id", "v", "noise", 2, n_boot=30).first()
    assert 33 < null["med_err"] < 57 and null["loop_radius"] < 0.4
    # Shrinkage identity: mean square radius equals the mean R2 of the two coordinates.
    assert abs(good["radius_rms"] ** 2 - (good["r2_cos"] + good["r2_sin"]) / 2) < 0.12


def test_direction_replicates_agree_with_refits(data):
    df, x, y = data
    r = {t["rep"]: np.array(t["direction"]) for t in L.direction_replicates(df, "id", "v", "y", 6, "s", budget=8 * 64 * 2).collect()}
    assert sorted(r) == list(range(6))
    w = L.direction(df, "v", "y")
    assert all(v @ w > 0.98 for v in r.values()) and not np.allclose(r[0], r[1])


def test_intervention_slope_and_wrap(spark, data):
    df, _, _ = data
    fit = L.fit_circular(df, "v", "theta", 2)
    c, s = np.cos(np.radians(60.0)), np.sin(np.radians(60.0))
    a, b = F.col("v")[0], F.col("v")[1]
    turned = df.withColumn("v", F.transform("v", lambda t, i: F.when(i == 0, a * c - b * s).when(i == 1, a * s + b * c).otherwise(t)))
    out = L.intervention_summary(L.readout_shift(fit, df, turned, "id", "v", "theta"), 30.0).first()
    assert abs(out["median_shift"] - 30) < 2 and out["median_error"] < 3
    one = spark.createDataFrame([(179.0,), (1.0,)], "a double").select(*L.axial_mean(F.col("a"))).first()
    assert abs(one[0]) < 1e-9 and one[1] > 0.99


def test_component_sweep_and_strata(data):
    df, _, _ = data
    d = df.withColumn("g", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    sweep = {r["n_components"]: r["med_err"] for r in L.component_sweep(d, "id", "v", "theta", 2, [1, 6]).collect()}
    assert sweep[6] < sweep[1]
    assert L.per_stratum_circular(d, "id", "v", "theta", 2, "g", 1.0).count() == 2


def brute_strata(rows, alpha):
    """Median error per stratum of ridge fits by the normal equations."""
    out = {}
    for g in {r["g"] for r in rows}:
        mine = [r for r in rows if r["g"] == g]
        x, y, t = (np.array([r[c] for r in mine], float) for c in ("v", "theta", "test"))
        y, t = np.column_stack([np.cos(2 * y), np.sin(2 * y)]), t.astype(bool)
        if t.all() or not t.any():
            continue
        mx, my = x[~t].mean(0), y[~t].mean(0)
        xc = x[~t] - mx
        p = (x[t] - mx) @ np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y[~t] - my)) + my
        d = np.angle(np.exp(1j * (np.arctan2(p[:, 1], p[:, 0]) - np.arctan2(y[t, 1], y[t, 0]))))
        out[g] = (int(t.sum()), float(np.median(np.degrees(np.abs(d)) / 2)))
    return out


@pytest.mark.parametrize("stratum", ["cast(id % 3 AS int)", "id % 2", "if(id % 4 = 0, NULL, concat('s', id % 4))", "if(id % 5 = 0, NULL, cast(id % 5 AS double))"])
def test_stratum_refits_match_normal_equations(data, stratum):
    df = data[0].withColumn("g", F.expr(stratum))
    want = brute_strata(df.select("v", "theta", "g", L.is_test("id").alias("test")).collect(), 1.0)
    got = {r["g"]: (r["n"], r["med_err"]) for r in L.per_stratum_circular(df, "id", "v", "theta", 2, "g", 1.0).collect()}
    assert got.keys() == want.keys() and (None in want) == ("NULL" in stratum)
    assert all(got[g][0] == want[g][0] and np.isclose(got[g][1], want[g][1]) for g in want)


def test_ten_thousand_strata_take_one_plan(spark):
    v = F.array(*[F.cos(F.col("id") * (i + 1)) for i in range(3)])
    df = spark.range(60_000).select("id", v.alias("v"), (F.col("id") % 180 / 60.0).alias("theta"), (F.col("id") % 10_000).cast("int").alias("g"))
    out = L.per_stratum_circular(df, "id", "v", "theta", 2, "g", 1.0)
    n = df.where(L.is_test("id")).select("g").distinct().join(df.where(~L.is_test("id")).select("g").distinct(), "g").count()
    assert out.count() == n > 7000


def test_tail_probabilities():
    assert abs(special.t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert abs(special.t_two_sided(1.96, 1e6) - 0.0499960) < 1e-5
    assert abs(special.binomial_two_sided(3, 10) - 0.34375) < 1e-9 and special.binomial_two_sided(5, 10) == 1.0
    assert abs(special.lower_gamma(3.0, 2.0) - 0.3233236) < 1e-6 and abs(special.gamma_quantile(0.5, 10.0) - 9.668715) < 1e-5
    assert abs(special.kolmogorov_tail(0.05, 1000) - 0.0131) < 2e-3


def test_planted_shift_is_found(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(a) for a in rng.standard_normal(4)], "a" if i % 2 else "b") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v array<double>, sample string")
    null = shifts.two_sample_auc(df, "id", "v", "sample").first()["auc"]
    d = np.array([1.0, 0, 0, 0])
    moved = shifts.plant_shift(df.where("sample = 'a'"), "id", "v", d, 2.0).drop("planted").unionByName(df.where("sample = 'b'"))
    found = shifts.two_sample_auc(moved, "id", "v", "sample").first()["auc"]
    assert abs(null - 0.5) < 0.12 and found > 0.85
    assert shifts.plant_deletion(df, "id", F.col("sample") == "a", 0.5).where("sample = 'b'").count() == 300


def test_invariance_joins_its_sides_once(spark):
    """The statistics read stored rows: no prediction is made, and neither side sent, once per statistic."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((400, 3))
    base = spark.createDataFrame([(i, r.tolist(), float(r[0] - r[1])) for i, r in enumerate(x)], "id long, v array<double>, y double")
    moved = spark.createDataFrame([(i, (r + 0.01).tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    out = L.invariance(base, moved, "id", "v", "y")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "score" not in plan and "ArrowEvalPython" not in plan
    one = out.first()
    assert 40 < one["n"] < 160 and one["r2_before"] > 0.999 and abs(one["median_change"]) < 1e-3


def test_polynomial_report_alone_makes_no_second_fit(spark, monkeypatch):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, float(a), float(b), float(a * b + a)) for i, (a, b) in enumerate(rng.standard_normal((200, 2)))], "id long, a double, b double, y double")
    fits, fit = [], L.fit_ridge
    monkeypatch.setattr(L, "fit_ridge", lambda *x, **kw: fits.append(1) or fit(*x, **kw))
    report, applied = L.polynomial_ridge(df, "id", ["a", "b"], "y", [0.001], apply=False)
    assert applied is None and len(fits) == 1 and report.first()["r2"] > 0.99
