"""Which slices of the data move which benchmark: ridge regression, bootstrap, checks and ablations.

Runs and slices are few: Gram matrices come from aggregates, solving and resampling uses NumPy, and resamples are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def solve_ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, float, float]:
    """Coefficients, intercept and R² of a ridge regression on columns as they are; the intercept matches the means."""
    coef = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)
    fitted = x @ coef
    intercept = float(y.mean() - fitted.mean())
    total = float(((y - y.mean()) ** 2).sum())
    return coef, intercept, 1 - float(((y - fitted - intercept) ** 2).sum()) / total if total > 0 else 0.0


def design(compositions: DataFrame, scores: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Slice names in order, one row of token fractions per run, and the scores; runs in both tables only, in order of id.

    ``compositions``: run_id, slice, token_fraction; ``scores``: run_id, score.
    """
    from loamworks.operators.slices import feature_matrix

    wide = feature_matrix(compositions).join(scores.select("run_id", "score"), "run_id").orderBy("run_id").toPandas()
    names = [c for c in wide.columns if c not in ("run_id", "score")]
    return names, wide[names].to_numpy(float), wide["score"].to_numpy(float)


def bootstrap(spark: SparkSession, x: np.ndarray, y: np.ndarray, alpha: float = 1.0, n: int = 1000, seed: int = 42) -> np.ndarray:
    """Coefficients of ``n`` resamples of the rows; each resample has its own seed, so tasks may be repeated."""

    def run(batches):
        for batch in batches:
            out = []
            for b in batch.column(0).to_pylist():
                rows = np.random.default_rng([seed, b]).integers(0, len(y), len(y))
                out.append(solve_ridge(x[rows], y[rows], alpha)[0].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["b", "coef"])

    got = spark.range(n).select(F.col("id").alias("b")).mapInArrow(run, "b bigint, coef array<double>").orderBy("b").toPandas()
    return np.array(got["coef"].tolist()).reshape(n, -1)


def ridge_attribution(compositions: DataFrame, scores: DataFrame, alpha: float = 1.0, n: int = 1000, seed: int = 42) -> DataFrame:
    """``benchmark, slice, value, ci_low, ci_high, significant, intercept, r_squared, n_runs`` for every benchmark of ``scores`` (run_id, benchmark, score)."""
    spark, rows = compositions.sparkSession, []
    for r in scores.select("benchmark").distinct().orderBy("benchmark").collect():
        names, x, y = design(compositions, scores.where(F.col("benchmark") == r["benchmark"]))
        if not len(y) or not names:
            continue
        coef, intercept, r2 = solve_ridge(x, y, alpha)
        low, high = np.percentile(bootstrap(spark, x, y, alpha, n, seed), [2.5, 97.5], axis=0)
        rows += [(r["benchmark"], s, float(c), float(a), float(b), bool(a > 0 or b < 0), intercept, r2, len(y)) for s, c, a, b in zip(names, coef, low, high, strict=True)]
    return spark.createDataFrame(rows, "benchmark string, slice string, value double, ci_low double, ci_high double, significant boolean, intercept double, r_squared double, n_runs int")


def permutation_test(spark: SparkSession, x: np.ndarray, y: np.ndarray, alpha: float = 1.0, n: int = 1000, seed: int = 42) -> float:
    """Share of random orders of the scores, and the given one, whose R² is at least that of the given order."""
    observed = solve_ridge(x, y, alpha)[2]

    def run(batches):
        for batch in batches:
            hit = [solve_ridge(x, np.random.default_rng([seed, 1, b]).permutation(y), alpha)[2] >= observed for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hit)], names=["hit"])

    hits = spark.range(n).mapInArrow(run, "hit boolean").agg(F.count_if("hit").alias("n")).first()["n"]
    return (hits + 1) / (n + 1)


def seed_stability(spark: SparkSession, x: np.ndarray, y: np.ndarray, alpha: float = 1.0, seeds: int = 5, n: int = 200) -> float:
    """Mean correlation of the bootstrap's mean coefficients between pairs of seeds."""
    means = [bootstrap(spark, x, y, alpha, n, s).mean(axis=0) for s in range(seeds)]
    pairs = [np.corrcoef(means[i], means[j])[0, 1] for i in range(seeds) for j in range(i)] if x.shape[1] > 1 else [1.0]
    return float(np.nan_to_num(np.mean(pairs), nan=1.0))


def negative_control(spark: SparkSession, x: np.ndarray, y: np.ndarray, alpha: float = 1.0, n: int = 1000, seed: int = 42) -> bool:
    """Whether a column of random numbers gets an interval that holds zero, as it should."""
    noise = np.random.default_rng(seed).uniform(0, 1, (len(y), 1))
    low, high = np.percentile(bootstrap(spark, np.hstack([x, noise - noise.mean()]), y, alpha, n, seed)[:, -1], [2.5, 97.5])
    return bool(low <= 0 <= high)


def sanity_report(spark: SparkSession, x: np.ndarray, y: np.ndarray, alpha: float = 1.0, n: int = 200) -> dict:
    p, s, c = permutation_test(spark, x, y, alpha, n), seed_stability(spark, x, y, alpha, n=n), negative_control(spark, x, y, alpha, n)
    return {"p_value": p, "stability": s, "negative_control": c, "valid": p < 0.05 and s > 0.7 and c}


def correlations(compositions: DataFrame, scores: DataFrame) -> DataFrame:
    """``benchmark, slice, correlation`` (4 decimals) of token fraction and score over runs; 0 if either does not vary, no row under two runs."""
    pairs = compositions.select("run_id", "slice", "token_fraction").join(scores.select("run_id", "benchmark", "score"), "run_id")
    out = pairs.groupBy("benchmark", "slice").agg(F.corr("token_fraction", "score").alias("c"), F.count("*").alias("n"))
    return out.where("n > 1").select("benchmark", "slice", F.round(F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0)), 4).alias("correlation"))


def ablation_study(weights: dict[str, float], evaluate: Callable[[dict[str, float]], float], top: int | None = None) -> list[dict]:
    """Score with each of the heaviest slices set to weight 0 against the full mix, largest change first. A run that raises scores 0."""

    def safe(w: dict[str, float]) -> float:
        try:
            return float(evaluate(w))
        except Exception:
            return 0.0

    base = safe(weights)
    rows = []
    for s, _ in sorted(weights.items(), key=lambda kv: (-kv[1], kv[0]))[:top]:
        score = safe({**weights, s: 0.0})
        rows.append({"slice": s, "baseline": base, "score": score, "delta": score - base, "relative_delta": (score - base) / base if base else 0.0})
    return sorted(rows, key=lambda r: (-abs(r["delta"]), r["slice"]))
