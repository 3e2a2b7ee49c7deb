"""Scores of evaluation tasks: parsing harness results, aggregation and confidence intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order in which a task's main metric is looked for.
METRICS = ("acc_norm", "acc", "exact_match", "f1")


def weighted_mean(score: Column, weight: Column) -> Column:
    total = F.sum(F.when(score.isNotNull(), weight))
    return F.when(total > 0, F.sum(score * weight) / total).otherwise(0.0)


def geometric_mean(score: Column, weight: Column) -> Column:
    """Unweighted; scores below 1e-10 count as that."""
    return F.exp(F.avg(F.ln(F.greatest(score, F.lit(1e-10)))))


AGGREGATORS: dict[str, Callable[[Column, Column], Column]] = {"weighted_mean": weighted_mean, "geometric_mean": geometric_mean}


def register_aggregator(name: str, f: Callable[[Column, Column], Column]) -> None:
    AGGREGATORS[name] = f


def aggregate_scores(scores: DataFrame, weights: DataFrame | None = None, method: str = "weighted_mean") -> DataFrame:
    """Per run: ``score_total, ci_low, ci_high, num_tasks``. ``scores``: run_id, task, score, ci_low, ci_high; ``weights``: task, weight (else 1).

    The interval adds the tasks' standard errors, weighted, as independent ones; null if no task has an interval.
    """
    rows = scores if weights is None else scores.join(weights.select("task", "weight"), "task", "left")
    w = F.lit(1.0) if weights is None else F.coalesce("weight", F.lit(1.0))
    rows = rows.withColumn("_w", w).withColumn("_se", (F.col("ci_high") - F.col("ci_low")) / (2 * 1.96))
    out = rows.groupBy("run_id").agg(
        AGGREGATORS[method](F.col("score"), F.col("_w")).alias("score_total"), F.sum("_w").alias("_sw"), F.sum(F.pow(F.col("_w") * F.col("_se"), 2)).alias("_v"), F.count("*").alias("num_tasks")
    )
    half = 1.96 * F.sqrt("_v") / F.col("_sw")
    return out.select("run_id", "score_total", (F.col("score_total") - half).alias("ci_low"), (F.col("score_total") + half).alias("ci_high"), "num_tasks")


def parse_harness(results: DataFrame, column: str = "results") -> DataFrame:
    """``run_id, task, score, ci_low, ci_high`` from JSON of task to metrics (under ``results`` or at the top)."""
    kind = "map<string,map<string,string>>"
    inner = F.coalesce(F.get_json_object(column, "$.results"), F.col(column))
    tasks = results.select("run_id", F.explode(F.from_json(inner, kind)).alias("task", "m"))
    name = F.coalesce(*[F.when(F.map_contains_key("m", x), F.lit(x)) for x in METRICS])
    rows = tasks.withColumn("metric", name).where("metric IS NOT NULL")
    score = F.try_element_at("m", F.col("metric")).try_cast("double")
    error = F.try_element_at("m", F.concat(F.col("metric"), F.lit("_stderr"))).try_cast("double")
    return rows.select("run_id", "task", score.alias("score"), (score - 1.96 * error).alias("ci_low"), (score + 1.96 * error).alias("ci_high"))


def flops(params: int, tokens: Column) -> Column:
    """Floating-point operations of training: six per parameter and token."""
    return 6.0 * params * tokens


def compute_summary(steps: DataFrame, params: int, max_hours: float | None = None) -> DataFrame:
    """Per run from ``run_id, tokens, seconds`` of steps: tokens, steps, FLOPs, throughput, hours and whether the budget holds."""
    out = steps.groupBy("run_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("steps"), F.sum("seconds").alias("seconds"))
    hours = F.col("seconds") / 3600
    within = F.lit(True) if max_hours is None else hours <= max_hours
    return out.select("run_id", "tokens", "steps", flops(params, F.col("tokens")).alias("flops"), F.when(F.col("seconds") > 0, F.col("tokens") / F.col("seconds")).otherwise(0.0).alias("tokens_per_second"), hours.alias("hours"), within.alias("within_budget"))


def section_profile(sections: DataFrame) -> DataFrame:
    """Per name from ``name, seconds, memory_mb``: total, mean, calls and greatest memory."""
    return sections.groupBy("name").agg(F.sum("seconds").alias("total_s"), F.avg("seconds").alias("mean_s"), F.count("*").alias("calls"), F.max("memory_mb").alias("max_memory_mb"))
