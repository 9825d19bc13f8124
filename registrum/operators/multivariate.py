"""Feature screening and factor analysis.

Spark reduces the rows to means, deviations and one correlation matrix, whose
size depends on the number of features alone. Everything after that works on
the matrix. Factor scores go back to the rows as one matrix product per Arrow
batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.operators.features import Widened
from registrum.schemas import FEATURE_META, STRUCTURAL_FEATURES
from registrum.session import materialise

# The matrix lives on the driver: 4096 features are 128 MB.
MAX_FEATURES = 4096

# Defaults of the screening and factor stages.
MIN_STD = 1e-6
COLLINEAR = 0.99
MIN_SMC = 0.20
SIMULATIONS = 100
SIMULATION_PERCENTILE = 95.0
SALIENT = 0.35
MIN_FEATURES_PER_FACTOR = 3
K_VALUES = [3, 4, 5, 6, 7, 8, 10]
PROMAX_POWER = 4


def feature_columns(df: DataFrame, meta: list[str] = FEATURE_META) -> list[str]:
    columns = [c for c in df.columns if c not in meta]
    if len(columns) > MAX_FEATURES:
        raise ValueError(f"{len(columns)} features; at most {MAX_FEATURES} fit one matrix")
    return columns


def _logged(column: str, columns: list[str]) -> Column:
    if column in columns and column not in STRUCTURAL_FEATURES:
        return F.log1p(F.greatest(F.col(column), F.lit(0.0)))
    return F.col(column)


def log_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """log1p of rate features, negative values as 0; structural features stay."""
    return df.select(*[_logged(c, columns).alias(c) for c in df.columns])


@dataclass
class Moments:
    """What the linear algebra needs of a table."""

    columns: list[str]
    n: int
    mean: np.ndarray
    std: np.ndarray  # sample deviation
    corr: np.ndarray

    def restrict(self, columns: list[str]) -> Moments:
        at = [self.columns.index(c) for c in columns]
        return Moments(columns, self.n, self.mean[at], self.std[at], self.corr[np.ix_(at, at)])


@dataclass
class Numbers:
    """Columns of numbers as matrices in the workers: the rows that are read, and what makes matrices of them."""

    width: int
    rows: DataFrame
    matrices: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]

    def reduced(self, run: Callable[[Iterator[np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        matrices = self.matrices
        return self.rows.mapInArrow(lambda batches: run(x for x in matrices(batches) if len(x)), schema)


def _matrix(columns: list[pa.Array], n: int) -> np.ndarray:
    x = np.empty((n, len(columns)))
    for i, column in enumerate(columns):
        x[:, i] = column.to_numpy(zero_copy_only=False)
    if np.isnan(x).any():
        raise ValueError("features hold null or NaN")
    return x


def _numbers(df: DataFrame, columns: list[Column]) -> Numbers:
    rows = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    return Numbers(len(columns), rows, lambda batches: (_matrix(b.columns, b.num_rows) for b in batches))


def _widened_numbers(table: Widened, plain: list[str], logged: list[str]) -> Numbers:
    """The ``plain`` columns as they are, then the ``logged`` ones as :func:`log_rates` has them."""
    widen = table.widen
    rates = [len(plain) + i for i, c in enumerate(logged) if c not in STRUCTURAL_FEATURES]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in widen(batches):
            x = _matrix([batch.column(c) for c in [*plain, *logged]], batch.num_rows)
            x[:, rates] = np.log1p(np.maximum(x[:, rates], 0.0))
            yield x

    return Numbers(len(plain) + len(logged), table.blocks, matrices)


def _deviations(numbers: Numbers) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and sample deviations: of each task's rows in Arrow batches, then merged column by column."""

    p = numbers.width

    def run(matrices: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(p), np.zeros(p)
        for x in matrices:
            k, first = len(x), x[0].copy()  # sums of differences, so that a constant column has no deviation at all
            x -= first
            at = x.mean(axis=0)
            x -= at
            step = first + at - mean
            m2 += np.square(x).sum(axis=0) + np.square(step) * (n * k / (n + k))
            mean += step * (k / (n + k))
            n += k
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(p), pa.int32()), pa.array(np.full(p, n)), pa.array(mean), pa.array(m2)],
                ["i", "n", "mean", "m2"],
            )

    def merged(a: Column, b: Column) -> Column:
        n, step = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"),
            (a["mean"] + step * (b["n"] / n)).alias("mean"),
            (a["m2"] + b["m2"] + step * step * (a["n"] * b["n"] / n)).alias("m2"),
        )

    parts = numbers.reduced(run, "i int, n long, mean double, m2 double")
    each = parts.groupBy("i").agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), "mean", "m2")).alias("x"))
    none = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "m2")])
    rows = each.select("i", F.aggregate("x", none, merged).alias("x")).select("i", "x.*").orderBy("i").collect()
    if not rows:
        raise ValueError("no rows to take means of")
    n, m2 = int(rows[0]["n"]), np.array([r["m2"] for r in rows])
    return n, np.array([r["mean"] for r in rows]), np.sqrt(m2 / max(n - 1, 1))


def deviations(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and sample deviations in one pass."""
    return _deviations(_numbers(df, [F.col(c) for c in columns]))


def _correlations(numbers: Numbers, mean: np.ndarray) -> np.ndarray:
    """Correlation matrix from the products of differences from the means: a row of it per task and column, then sums."""

    def run(matrices: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for x in matrices:
            x -= mean
            total += x.T @ x
        for i, row in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row], pa.list_(pa.float64()))], ["i", "row"])

    parts = numbers.reduced(run, "i int, row array<double>")
    rows = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).orderBy("i").collect()
    products = np.array([r["row"].toArray() for r in rows])
    length = np.sqrt(np.diag(products))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = products / np.outer(length, length)
    corr = (corr + corr.T) / 2
    np.fill_diagonal(corr, 1.0)
    return corr


def correlations(df: DataFrame, columns: list[str], mean: np.ndarray) -> np.ndarray:
    """Correlation matrix of columns with known means in one pass."""
    return _correlations(_numbers(df, [F.col(c) for c in columns]), mean)


def moments(df: DataFrame, columns: list[str]) -> Moments:
    n, mean, std = deviations(df, columns)
    return Moments(list(columns), n, mean, std, correlations(df, columns, mean))


def low_variance(columns: list[str], std: np.ndarray, threshold: float = MIN_STD) -> list[str]:
    return [c for c, s in zip(columns, std) if s < threshold]


def prune_collinear(m: Moments, threshold: float = COLLINEAR) -> list[str]:
    """Features left when of each too-correlated pair the one varying less goes.

    Pairs are taken from the strongest down, ties by name backwards; a pair
    with a member already gone is settled. Equal deviations drop the second.
    """
    rows, cols = np.nonzero(np.triu(np.abs(m.corr) > threshold, 1))
    pairs = sorted(((abs(m.corr[i, j]), m.columns[i], m.columns[j]) for i, j in zip(rows, cols)), reverse=True)
    std, gone = dict(zip(m.columns, m.std)), set()
    for _, a, b in pairs:
        if a not in gone and b not in gone:
            gone.add(a if std[a] < std[b] else b)
    return [c for c in m.columns if c not in gone]


def smc(corr: np.ndarray) -> np.ndarray:
    """Squared multiple correlation of each feature with all others."""
    try:
        inverse = np.linalg.inv(corr)
    except np.linalg.LinAlgError:
        inverse = np.linalg.pinv(corr)
    return np.clip(1.0 - 1.0 / np.maximum(np.diag(inverse), 1.0), 0.0, 1.0)


@dataclass
class Screening:
    kept: list[str]
    report: list[tuple[str, float]]  # (feature, SMC), strongest first, before the SMC filter
    data: DataFrame
    moments: Moments


def screen(features: DataFrame | Widened, meta: list[str] = FEATURE_META, smc_threshold: float = MIN_SMC,
           collinearity: float = COLLINEAR, log_transform: bool = True, min_std: float = MIN_STD) -> Screening:
    """Variance filter, log1p, collinearity pruning, SMC filter.

    Features are written once and read for the deviations on both scales,
    the correlation matrix of what varies, and the result. Of a table that workers
    widen, its blocks are read instead, and its rows never become Spark's before the result.
    """
    table = features.data if isinstance(features, Widened) else materialise(features)
    columns = feature_columns(table, meta)

    def numbers(plain: list[str], logged: list[str]) -> Numbers:
        if isinstance(features, Widened):
            return _widened_numbers(features, plain, logged)
        return _numbers(table, [F.col(c) for c in plain] + [_logged(c, logged) for c in logged])

    n, means, stds = _deviations(numbers(columns, columns if log_transform else []))
    flat = set(low_variance(columns, stds[: len(columns)], min_std))
    at = [i for i, c in enumerate(columns) if c not in flat]
    mean, std = (x[len(columns) if log_transform else 0 :][at] for x in (means, stds))
    columns = [columns[i] for i in at]
    data = log_rates(table, columns) if log_transform else table
    m = Moments(columns, n, mean, std, _correlations(numbers([], columns) if log_transform else numbers(columns, []), mean))
    m = m.restrict(prune_collinear(m, collinearity))
    values = smc(m.corr)
    kept = [c for c, v in zip(m.columns, values) if v >= smc_threshold]
    report = sorted(zip(m.columns, map(float, values)), key=lambda r: -r[1])
    present = [c for c in meta if c in table.columns]
    return Screening(kept, report, data.select(*present, *kept), m.restrict(kept))


def zscores(df: DataFrame, m: Moments, meta: list[str] = FEATURE_META) -> DataFrame:
    """Columns in units of their sample deviation; constant columns are dropped."""
    present = [c for c in meta if c in df.columns]
    return df.select(
        *present,
        *[
            ((F.col(c) - F.lit(float(mu))) / F.lit(float(sd))).alias(c)
            for c, mu, sd in zip(m.columns, m.mean, m.std)
            if sd > 0
        ],
    )


def bartlett(spark: SparkSession, m: Moments) -> dict[str, float]:
    """Test that the correlation matrix is an identity matrix."""
    p = len(m.columns)
    chi2 = -(m.n - 1 - (2 * p + 5) / 6) * np.linalg.slogdet(m.corr)[1]
    df = p * (p - 1) / 2
    # The upper tail itself: one less the distribution function is 0 for any real sample.
    tail = spark._jvm.org.apache.commons.math3.special.Gamma.regularizedGammaQ(float(df) / 2, float(chi2) / 2)
    return {"chi2": float(chi2), "df": df, "p_value": tail}


def kmo(corr: np.ndarray) -> tuple[np.ndarray, float]:
    """Sampling adequacy, per feature and overall."""
    inverse = np.linalg.inv(corr)
    scale = np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    partial = np.square(inverse / scale)
    simple = np.square(corr)
    np.fill_diagonal(partial, 0.0)
    np.fill_diagonal(simple, 0.0)
    per = simple.sum(axis=0) / (simple.sum(axis=0) + partial.sum(axis=0))
    return per, float(simple.sum() / (simple.sum() + partial.sum()))


def eigenvalues(corr: np.ndarray) -> np.ndarray:
    return np.linalg.eigvalsh(corr)[::-1]


def simulated_eigenvalues(n: int, p: int, rng: np.random.Generator) -> np.ndarray:
    """Eigenvalues of the correlation matrix of ``n`` rows of ``p`` independent normals.

    The centred cross-product of such rows is Wishart with n - 1 degrees of
    freedom, drawn through its triangular factor (Bartlett). The cost does not
    depend on n. With fewer rows than features the rows are drawn themselves.
    """
    df = n - 1
    if df >= p:
        factor = np.tril(rng.standard_normal((p, p)), -1)
        factor[np.diag_indices(p)] = np.sqrt(rng.chisquare(df - np.arange(p)))
    else:
        factor = rng.standard_normal((p, df))
    cross = factor @ factor.T
    scale = np.sqrt(np.diag(cross))
    return eigenvalues(cross / np.outer(scale, scale))


def parallel_analysis(spark: SparkSession, n: int, p: int, simulations: int = SIMULATIONS,
                      percentile: float = SIMULATION_PERCENTILE, seed: int = 0) -> DataFrame:
    """(factor, parallel_threshold): the percentile of simulated eigenvalues at each position."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                values = simulated_eigenvalues(n, p, np.random.default_rng([seed, int(i)]))
                yield pd.DataFrame({"factor": np.arange(1, p + 1), "ev": values})

    draws = spark.range(simulations).mapInPandas(draw, "factor int, ev double")
    return draws.groupBy("factor").agg(F.percentile("ev", F.lit(percentile / 100)).alias("parallel_threshold"))


def scree(spark: SparkSession, m: Moments, **kwargs) -> DataFrame:
    """Observed eigenvalues beside the simulated thresholds, with both retention rules."""
    observed = spark.createDataFrame(
        [(i + 1, float(v)) for i, v in enumerate(eigenvalues(m.corr))], "factor int, eigenvalue double"
    )
    thresholds = parallel_analysis(spark, m.n, len(m.columns), **kwargs)
    return observed.join(thresholds, "factor").select(
        "factor",
        "eigenvalue",
        "parallel_threshold",
        (F.col("eigenvalue") > F.col("parallel_threshold")).alias("retain_parallel"),
        (F.col("eigenvalue") > 1.0).alias("retain_kaiser"),
    )


def suggested_factors(scree_table: DataFrame) -> tuple[int, int]:
    """(parallel, Kaiser): how many eigenvalues exceed their threshold; parallel keeps at least one."""
    row = scree_table.agg(
        F.greatest(F.count_if("retain_parallel"), F.lit(1)).alias("parallel"), F.count_if("retain_kaiser").alias("kaiser")
    ).first()
    return int(row["parallel"]), int(row["kaiser"])


# --- Extraction and rotation ------------------------------------------------


def principal_loadings(corr: np.ndarray, k: int) -> np.ndarray:
    """Correlations of features with the first ``k`` principal components."""
    values, vectors = np.linalg.eigh(corr)
    top = np.argsort(values)[::-1][:k]
    return vectors[:, top] * np.sqrt(np.maximum(values[top], 0.0))


def principal_axis_loadings(corr: np.ndarray, k: int, iterations: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Iterated principal axis factoring, started from squared multiple correlations."""
    reduced, communality = corr.copy(), smc(corr)
    for _ in range(iterations):
        np.fill_diagonal(reduced, communality)
        loadings = principal_loadings(reduced, k)
        new = np.square(loadings).sum(axis=1)
        done = np.max(np.abs(new - communality)) < tolerance
        communality = new
        if done:
            break
    return loadings


def varimax(loadings: np.ndarray, iterations: int = 1000, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal rotation of unit-length rows; returns rotated loadings and the rotation."""
    length = np.sqrt(np.square(loadings).sum(axis=1, keepdims=True))
    length[length == 0] = 1.0
    unit, rotation, criterion = loadings / length, np.eye(loadings.shape[1]), 0.0
    for _ in range(iterations):
        turned = unit @ rotation
        u, s, vt = np.linalg.svd(unit.T @ (turned**3 - turned * np.square(turned).mean(axis=0)))
        rotation = u @ vt
        if s.sum() < criterion * (1 + tolerance):
            break
        criterion = s.sum()
    return unit @ rotation * length, rotation


def promax(loadings: np.ndarray, power: int = PROMAX_POWER) -> tuple[np.ndarray, np.ndarray]:
    """Oblique rotation towards powered varimax loadings; returns loadings and factor correlations."""
    length = np.sqrt(np.square(loadings).sum(axis=1, keepdims=True))
    length[length == 0] = 1.0
    start, _ = varimax(loadings / length)
    target = start * np.abs(start) ** (power - 1)
    transform = np.linalg.lstsq(start, target, rcond=None)[0]
    transform = transform @ np.diag(np.sqrt(np.diag(np.linalg.inv(transform.T @ transform))))
    inverse = np.linalg.inv(transform)
    return start @ transform * length, inverse @ inverse.T


def quartimin(loadings: np.ndarray, iterations: int = 1000, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Oblique gradient projection on the quartimin criterion (direct oblimin at 0)."""
    k = loadings.shape[1]
    others = np.ones((k, k)) - np.eye(k)

    def value(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        inverse = np.linalg.inv(t)
        turned = loadings @ inverse.T
        cross = np.square(turned) @ others
        gradient = -(turned.T @ (turned * cross) @ inverse).T
        return float((np.square(turned) * cross).sum() / 4), turned, gradient

    turn, step = np.eye(k), 1.0
    criterion, turned, gradient = value(turn)
    for _ in range(iterations):
        projected = gradient - turn * (turn * gradient).sum(axis=0)
        size = np.sqrt(np.square(projected).sum())
        if size < tolerance:
            break
        step *= 2
        for _ in range(11):
            moved = turn - step * projected
            moved = moved / np.sqrt(np.square(moved).sum(axis=0))
            new, new_turned, new_gradient = value(moved)
            if new < criterion - 0.5 * size**2 * step:
                break
            step /= 2
        turn, criterion, turned, gradient = moved, new, new_turned, new_gradient
    return turned, turn.T @ turn


@dataclass
class Solution:
    """Rotated factors of a correlation matrix."""

    columns: list[str]
    loadings: np.ndarray
    phi: np.ndarray | None = None
    factors: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.factors = [f"F{i + 1}" for i in range(self.loadings.shape[1])]

    @property
    def structure(self) -> np.ndarray:
        return self.loadings if self.phi is None else self.loadings @ self.phi

    @property
    def communalities(self) -> np.ndarray:
        return np.square(self.loadings).sum(axis=1)

    def variance(self) -> list[tuple[str, float, float, float]]:
        """(factor, SS loadings, proportion, cumulative) per factor."""
        ss = np.square(self.loadings).sum(axis=0)
        share = ss / len(self.columns)
        return [(f, float(a), float(b), float(c)) for f, a, b, c in zip(self.factors, ss, share, np.cumsum(share))]


ROTATIONS = ("promax", "varimax", "oblimin", "quartimin", None)


def factor(m: Moments, k: int, rotation: str | None = "promax", method: str = "principal") -> Solution:
    """Extract ``k`` factors and rotate them; each column's loadings sum to a positive value."""
    if rotation not in ROTATIONS:
        raise ValueError(f"unknown rotation {rotation!r}")
    if not 1 <= k <= len(m.columns):
        raise ValueError(f"{k} factors of {len(m.columns)} features")
    extract = {"principal": principal_loadings, "principal_axis": principal_axis_loadings}[method]
    loadings, phi = extract(m.corr, k), None
    if k > 1:
        if rotation == "varimax":
            loadings, _ = varimax(loadings)
        elif rotation == "promax":
            loadings, phi = promax(loadings)
        elif rotation in ("oblimin", "quartimin"):
            loadings, phi = quartimin(loadings)
    signs = np.where(loadings.sum(axis=0) < 0, -1.0, 1.0)
    if phi is not None:
        phi = phi * np.outer(signs, signs)
    return Solution(list(m.columns), loadings * signs, phi)


def score_weights(m: Moments, solution: Solution) -> np.ndarray:
    """Regression weights: what turns standardised features into factor scores."""
    return np.linalg.solve(m.corr, solution.structure)


def scores(df: DataFrame, m: Moments, solution: Solution, meta: list[str] = FEATURE_META) -> DataFrame:
    """Factor scores per row beside its metadata.

    Features are standardised by their population deviation. The affine map is
    folded into one matrix and one offset, which travel with the task.
    """
    scale = m.std * np.sqrt((m.n - 1) / m.n)
    weights = score_weights(m, solution) / scale[:, None]
    offset = m.mean @ weights

    @F.pandas_udf("array<double>")
    def project(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(features.to_numpy()) @ weights - offset))

    present = [c for c in meta if c in df.columns]
    projected = df.select(*present, project(F.array(*m.columns)).alias("_scores"))
    return projected.select(*present, *[F.col("_scores")[i].alias(f) for i, f in enumerate(solution.factors)])


# --- Small result tables ----------------------------------------------------


def loadings_table(spark: SparkSession, solution: Solution) -> DataFrame:
    schema = "feature string, " + ", ".join(f"{f} double" for f in solution.factors)
    rows = [(c, *map(float, row)) for c, row in zip(solution.columns, solution.loadings)]
    return spark.createDataFrame(rows, schema)


def communalities_table(spark: SparkSession, solution: Solution) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(solution.columns, solution.communalities)]
    return spark.createDataFrame(rows, "feature string, communality double")


def variance_table(spark: SparkSession, solution: Solution) -> DataFrame:
    return spark.createDataFrame(
        solution.variance(), "factor string, SS_loadings double, proportion_var double, cumulative_var double"
    )


def correlations_table(spark: SparkSession, solution: Solution) -> DataFrame | None:
    """Factor correlations; there are none for orthogonal factors."""
    if solution.phi is None:
        return None
    schema = "factor string, " + ", ".join(f"{f} double" for f in solution.factors)
    return spark.createDataFrame([(f, *map(float, r)) for f, r in zip(solution.factors, solution.phi)], schema)


def correlation_pairs(spark: SparkSession, m: Moments) -> DataFrame:
    """Upper triangle of the correlation matrix in long form."""
    i, j = np.triu_indices(len(m.columns), 1)
    frame = pd.DataFrame(
        {"a": np.array(m.columns)[i], "b": np.array(m.columns)[j], "r": m.corr[i, j]}
    )
    return spark.createDataFrame(frame, "a string, b string, r double")


def smc_table(spark: SparkSession, screening: Screening) -> DataFrame:
    return spark.createDataFrame(screening.report, "feature string, SMC double")


def unpivot_loadings(loadings: DataFrame) -> DataFrame:
    factors = [c for c in loadings.columns if c != "feature"]
    return loadings.unpivot("feature", factors, "factor", "loading")


def salient_poles(loadings: DataFrame, threshold: float = SALIENT) -> DataFrame:
    """Features loading at or beyond the threshold, strongest first within factor and pole."""
    return (
        unpivot_loadings(loadings)
        .where(F.abs("loading") >= threshold)
        .select("factor", F.when(F.col("loading") > 0, "+").otherwise("-").alias("pole"), "feature", "loading")
        .orderBy("factor", "pole", F.abs("loading").desc(), "feature")
    )


def diagnostics(long: DataFrame, by: list[str] = [], threshold: float = SALIENT,
                min_features: int = MIN_FEATURES_PER_FACTOR) -> DataFrame:
    """Salient, interpretable and complex counts of solutions in long form (feature, factor, loading)."""
    hit = F.abs("loading") >= threshold
    per_factor = long.groupBy(*by, "factor").agg(F.count_if(hit).alias("size")).groupBy(*by).agg(
        F.count_if(F.col("size") >= min_features).alias("interpretable_factors"),
        F.min("size").alias("min_factor_size"),
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(F.regexp_extract("factor", r"(\d+)$", 1).try_cast("int").alias("at"), "size")
                )
            ),
            lambda x: x["size"],
        ).alias("feats_per_factor"),
    )
    per_feature = long.groupBy(*by, "feature").agg(F.count_if(hit).alias("hits")).groupBy(*by).agg(
        F.count_if(F.col("hits") >= 1).alias("salient_features"),
        F.count_if(F.col("hits") >= 2).alias("complex_features"),
    )
    return per_factor.join(per_feature, by) if by else per_factor.join(per_feature)


def compare_k(spark: SparkSession, m: Moments, k_values: list[int] = K_VALUES, rotation: str | None = "promax",
              threshold: float = SALIENT, min_features: int = MIN_FEATURES_PER_FACTOR) -> DataFrame:
    """Diagnostics of solutions with different numbers of factors, all from one correlation matrix.

    Numbers of factors that cannot be fitted are left out.
    """
    rows = []
    for k in k_values:
        try:
            solution = factor(m, k, rotation)
        except (ValueError, np.linalg.LinAlgError):
            continue
        salient = np.abs(solution.loadings) >= threshold
        sizes = salient.sum(axis=0)
        rows.append(
            (
                k,
                round(solution.variance()[-1][3], 3),
                int(salient.any(axis=1).sum()),
                int((sizes >= min_features).sum()),
                int((salient.sum(axis=1) >= 2).sum()),
                int(sizes.min()),
                [int(s) for s in sizes],
            )
        )
    return spark.createDataFrame(
        rows,
        "k int, cumulative_var double, salient_features int, interpretable_factors int, "
        "complex_features int, min_factor_size int, feats_per_factor array<int>",
    )


@dataclass
class FactorResult:
    moments: Moments
    solution: Solution
    scree: DataFrame
    k_parallel: int
    k_kaiser: int
    bartlett: dict[str, float] | None
    kmo_total: float | None
    warnings: list[str]
    scores: DataFrame


def analyse(filtered: DataFrame, meta: list[str] = FEATURE_META, n_factors: int | None = None,
            simulations: int = SIMULATIONS, percentile: float = SIMULATION_PERCENTILE,
            rotation: str | None = "promax", seed: int = 0, method: str = "principal") -> FactorResult:
    """Factor analysis of a filtered feature table; without ``n_factors`` parallel analysis picks them."""
    spark = filtered.sparkSession
    m = moments(filtered, feature_columns(filtered, meta))
    m = m.restrict([c for c, s in zip(m.columns, m.std) if s > 0])
    warnings = []
    if m.n < 10 * len(m.columns):
        warnings.append(f"{m.n / len(m.columns):.1f} rows per feature")
    try:
        sphericity = bartlett(spark, m)
        if sphericity["p_value"] > 0.05:
            warnings.append("correlations do not differ from chance")
    except Exception:
        sphericity = None
    try:
        adequacy = kmo(m.corr)[1]
        if adequacy < 0.5:
            warnings.append("sampling adequacy below 0.5")
    except np.linalg.LinAlgError:
        adequacy = None
    table = scree(spark, m, simulations=simulations, percentile=percentile, seed=seed)
    rows = [tuple(r) for r in table.orderBy("factor").collect()]
    table = spark.createDataFrame(rows, table.schema)
    k_parallel, k_kaiser = suggested_factors(table)
    solution = factor(m, n_factors or k_parallel, rotation, method)
    return FactorResult(
        m, solution, table, k_parallel, k_kaiser, sphericity, adequacy, warnings, scores(filtered, m, solution, meta)
    )


def summary_text(name: str, result: FactorResult, rotation: str | None) -> str:
    """Plain-text account of a factor analysis."""
    lines = [
        f"Factor analysis: {name}",
        "",
        f"Segments: {result.moments.n}",
        f"Features: {len(result.moments.columns)}",
        f"Rotation: {rotation}",
        "",
        f"k by parallel analysis: {result.k_parallel}",
        f"k by Kaiser's rule:     {result.k_kaiser}",
        f"k used:                 {len(result.solution.factors)}",
        "",
        "Variance explained:",
        f"{'factor':>8} {'SS_loadings':>12} {'proportion':>12} {'cumulative':>12}",
    ]
    lines += [f"{f:>8} {a:12.6f} {b:12.6f} {c:12.6f}" for f, a, b, c in result.solution.variance()]
    if result.solution.phi is not None:
        lines += ["", "Factor correlations:"]
        for f, row in zip(result.solution.factors, result.solution.phi):
            lines.append(f"{f:>8} " + " ".join(f"{v:8.3f}" for v in row))
    return "\n".join(lines) + "\n"
