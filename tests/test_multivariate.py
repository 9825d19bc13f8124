"""Screening, factor analysis, register means: algebra and brute force."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from registrum.operators import centroids, multivariate as M

RNG = np.random.default_rng(7)
N, P = 400, 6
LATENT = RNG.standard_normal((N, 2))
X = LATENT @ RNG.standard_normal((2, P)) + 0.6 * RNG.standard_normal((N, P))
NAMES = [f"x{i}" for i in range(P)]


@pytest.fixture(scope="module")
def table(spark):
    frame = pd.DataFrame(X, columns=NAMES)
    frame["doc_id"], frame["label"] = [str(i) for i in range(N)], ["a", "b", "c", "d"] * (N // 4)
    return spark.createDataFrame(frame).select("doc_id", "label", *NAMES)


@pytest.fixture(scope="module")
def m(table):
    return M.moments(table, NAMES)


def test_moments(m):
    assert m.n == N
    assert np.allclose(m.mean, X.mean(axis=0)) and np.allclose(m.std, X.std(axis=0, ddof=1))
    assert np.allclose(m.corr, np.corrcoef(X, rowvar=False))


def test_moments_of_parts_and_constants(spark):
    """Columns are reduced in Arrow batches; parts of any size merge, constants have no deviation at all, gaps are refused."""
    x = np.column_stack([X[:, :3] + 1e6, np.full(N, 0.1)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))).repartition(7)
    m = M.moments(df, list("abcd"))
    assert m.n == N and m.std[3] == 0.0 and m.mean[3] == 0.1
    assert np.allclose(m.mean, x.mean(axis=0), rtol=1e-14) and np.allclose(m.std[:3], x[:, :3].std(axis=0, ddof=1), rtol=1e-9)
    assert np.allclose(m.corr[:3, :3], np.corrcoef(X[:, :3].T), atol=1e-8) and np.isnan(m.corr[3, 0])
    with pytest.raises(Exception, match="null or NaN"):
        M.moments(df.withColumn("a", F.when(F.col("a") > 1e6, F.col("a"))), list("abcd"))


def test_smc_is_regression_r2(m):
    for j, value in enumerate(M.smc(m.corr)):
        A = np.column_stack([np.ones(N), np.delete(X, j, 1)])
        fit = A @ np.linalg.lstsq(A, X[:, j], rcond=None)[0]
        assert value == pytest.approx(1 - ((X[:, j] - fit) ** 2).sum() / ((X[:, j] - X[:, j].mean()) ** 2).sum())


def test_collinear_pruning():
    corr = np.array([[1, 0.999, 0.2], [0.999, 1, -0.995], [0.2, -0.995, 1]])
    m = M.Moments(["a", "b", "c"], 10, np.zeros(3), np.array([1.0, 2.0, 2.0]), corr)
    assert M.prune_collinear(m, 0.98) == ["b"]
    m.std[:] = 1.0
    assert M.prune_collinear(m, 0.98) == ["a", "c"]


def test_screening(spark, table):
    wide = table.withColumn("flat", F.lit(3.0)).withColumn("noise", F.randn(1)).withColumn("twin", F.col("x0") * 2)
    result = M.screen(wide, ["doc_id", "label"], log_transform=False)
    assert "flat" not in result.kept and "noise" not in result.kept
    assert ("x0" in result.kept) != ("twin" in result.kept)
    assert result.data.columns == ["doc_id", "label", *result.kept]
    assert [v for _, v in result.report] == sorted((v for _, v in result.report), reverse=True)


def test_full_rank_loadings_reproduce_correlations(m):
    full = M.principal_loadings(m.corr, P)
    assert np.allclose(full @ full.T, m.corr)


@pytest.mark.parametrize("rotation", M.ROTATIONS)
@pytest.mark.parametrize("method", ["principal", "principal_axis"])
def test_rotations_keep_the_common_part(m, rotation, method):
    plain, turned = M.factor(m, 2, None, method), M.factor(m, 2, rotation, method)
    phi = np.eye(2) if turned.phi is None else turned.phi
    assert np.allclose(np.diag(phi), 1.0)
    assert np.allclose(turned.loadings @ phi @ turned.loadings.T, plain.loadings @ plain.loadings.T, atol=1e-6)
    assert (turned.loadings.sum(axis=0) >= 0).all()
    if turned.phi is None:
        assert ((turned.communalities >= 0) & (turned.communalities <= 1 + 1e-9)).all()


def test_varimax_improves_and_is_orthogonal(m):
    loadings = M.principal_loadings(m.corr, 2)
    turned, rotation = M.varimax(loadings)
    unit = loadings / np.sqrt((loadings**2).sum(axis=1, keepdims=True))
    simple = lambda a: (a**4).sum() - ((a**2).sum(axis=0) ** 2).sum() / P
    assert np.allclose(rotation.T @ rotation, np.eye(2))
    for angle in np.linspace(0, np.pi, 50):
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        assert simple(unit @ rotation) >= simple(unit @ turn) - 1e-6


def test_scores(spark, table, m):
    solution = M.factor(m, 2)
    got = M.scores(table, m, solution, ["doc_id", "label"]).toPandas()
    order = got["doc_id"].astype(int).argsort()
    z = (X - X.mean(axis=0)) / X.std(axis=0)
    want = z @ np.linalg.solve(np.corrcoef(X, rowvar=False), solution.structure)
    assert np.allclose(got.loc[order, ["F1", "F2"]].to_numpy(), want)
    assert np.allclose(got[["F1", "F2"]].mean(), 0, atol=1e-10)


def test_kmo_and_bartlett(spark, m):
    per, total = M.kmo(m.corr)
    assert 0 < total < 1 and len(per) == P
    assert M.bartlett(spark, m)["p_value"] < 1e-6
    flat = M.Moments(NAMES, N, m.mean, m.std, np.eye(P))
    assert M.bartlett(spark, flat)["p_value"] == pytest.approx(1.0)


def test_simulated_eigenvalues_follow_the_direct_draw():
    n, p, draws = 60, 5, 400
    fast = np.array([M.simulated_eigenvalues(n, p, np.random.default_rng(i)) for i in range(draws)])
    direct = []
    for i in range(draws):
        R = np.random.default_rng(10_000 + i).standard_normal((n, p))
        direct.append(np.linalg.eigvalsh(np.corrcoef(R, rowvar=False))[::-1])
    assert np.allclose(fast.mean(axis=0), np.mean(direct, axis=0), atol=0.02)
    assert np.allclose(np.percentile(fast, 95, axis=0), np.percentile(direct, 95, axis=0), atol=0.05)
    assert np.isclose(fast.sum(axis=1), p).all()


def test_parallel_analysis(spark, m):
    table = M.scree(spark, m, simulations=200)
    draws = [np.corrcoef(RNG.standard_normal((N, P)), rowvar=False) for _ in range(200)]
    direct = np.percentile([np.linalg.eigvalsh(c)[::-1] for c in draws], 95, axis=0)
    got = [r["parallel_threshold"] for r in table.orderBy("factor").collect()]
    assert np.allclose(got, direct, atol=0.04)
    real = np.linalg.eigvalsh(m.corr)[::-1]
    assert M.suggested_factors(table) == (max(1, (real > np.array(got)).sum()), (real > 1).sum())
    again = M.scree(spark, m, simulations=200)
    assert {tuple(r) for r in table.collect()} == {tuple(r) for r in again.collect()}


def test_compare_k_and_poles(spark, m):
    rows = {r["k"]: r for r in M.compare_k(spark, m, [2, 3, 99]).collect()}
    assert set(rows) == {2, 3} and rows[3]["cumulative_var"] >= rows[2]["cumulative_var"] - 0.2
    solution = M.factor(m, 2)
    long = M.unpivot_loadings(M.loadings_table(spark, solution))
    d = M.diagnostics(long).first()
    assert list(d["feats_per_factor"]) == list(rows[2]["feats_per_factor"])
    assert (d["salient_features"], d["complex_features"]) == (rows[2]["salient_features"], rows[2]["complex_features"])
    poles = M.salient_poles(M.loadings_table(spark, solution)).collect()
    assert len(poles) == sum(rows[2]["feats_per_factor"])


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(
        {"id": range(900), "lang": rng.choice(["u", "v"], 900), "label": rng.choice(["a", "b", "c"], 900), "F1": rng.gamma(2, size=900)}
    )
    frame.loc[len(frame)] = [900, "w", "a", 1.0]
    return frame


def test_register_means(spark, scores):
    df = spark.createDataFrame(scores)
    raw = centroids.register_means(centroids.register_moments(df, "F1"), False).toPandas().set_index(["lang", "label"])
    assert raw.loc[("w", "a"), "ci_lo"] == raw.loc[("w", "a"), "ci_hi"] == 1.0
    z = centroids.register_means(centroids.register_moments(df, "F1"), True).toPandas().set_index(["lang", "label"])
    assert "w" not in z.index.get_level_values(0)
    two = scores[scores["lang"] != "w"].copy()
    two["F1"] = two.groupby("lang")["F1"].transform(lambda s: (s - s.mean()) / s.std())
    for key, group in two.groupby(["lang", "label"])["F1"]:
        se = group.std() / np.sqrt(len(group))
        assert z.loc[key, "mean"] == pytest.approx(group.mean())
        assert z.loc[key, "ci_lo"] == pytest.approx(group.mean() - 1.96 * se)


def test_order_and_pairs(spark, scores):
    df = spark.createDataFrame(scores)
    table = centroids.dimension(df, "F1", False, sort_by="w").collect()
    assert {r["label"] for r in table} == {"a"}
    assert centroids.dimension(df, "F1", False, sort_by="nope").count() == 7
    assert centroids.parse_pairs(["1,2", "F1,3"]) == [("F1", "F2"), ("F1", "F3")]
    assert centroids.parse_pairs(["all"], ["F10", "F2", "label"]) == [("F10", "F2")]
    assert centroids.shared_factors([["F1", "F2"], ["F2", "x"]]) == ["F2"]
    with pytest.raises(ValueError):
        centroids.parse_pairs(["1"])


def test_bootstrap_matches_direct_resampling(spark, scores):
    df = spark.createDataFrame(scores)
    found = centroids.bootstrap(df, ["label"], "F1", ["id"], n_boot=1000)
    got = found.toPandas().set_index("label")
    again = centroids.bootstrap(df.repartition(5), ["label"], "F1", ["id"], n_boot=1000).toPandas().set_index("label")
    other = centroids.bootstrap(df, ["label"], "F1", ["id"], n_boot=1000, seed=1).toPandas().set_index("label")
    for label, group in scores.groupby("label")["F1"]:
        rng = np.random.default_rng(0)
        means = [rng.choice(group.to_numpy(), len(group)).mean() for _ in range(1000)]
        for table in (got, other):
            assert table.loc[label, "lo"] == pytest.approx(np.percentile(means, 2.5), abs=0.03)
            assert table.loc[label, "hi"] == pytest.approx(np.percentile(means, 97.5), abs=0.03)
        assert got.loc[label, "lo"] == pytest.approx(again.loc[label, "lo"], abs=1e-12)
        assert got.loc[label, "n"] == len(group)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Scores are summed up before the first exchange, and no Python runs.
    assert "Python" not in plan and "Pandas" not in plan
    for exchange in re.findall(r"Exchange[^\n]*\n[^\n]*", plan):
        assert "partial_" in exchange or "Broadcast" in exchange or "ENSURE" in exchange


def test_resample_weights_are_poisson(spark):
    pairs = centroids.resampled(centroids.with_key_words(spark.range(500), ["id"]).join(spark.range(200).toDF("rep")), F.col("rep"), "w", 3)
    counts = {r["w"]: r["count"] / 100_000 for r in pairs.groupBy("w").count().collect()}
    for k in range(5):
        assert counts[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.006)
    spread = pairs.groupBy("rep").agg(F.sum("w").alias("n")).agg(F.avg("n"), F.stddev("n")).first()
    assert spread[0] == pytest.approx(500, abs=6) and spread[1] == pytest.approx(500**0.5, rel=0.2)
