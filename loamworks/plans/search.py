"""Policy search: spaces, constraints, rankings, Pareto frontiers, promotion and pruning of trials.

Trials are a data frame: trial_id, score, compute_cost, dataset_tokens, contamination_rate, diversity_score.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks import storage
from loamworks.session import shuffle_partitions


@dataclass(frozen=True)
class Parameter:
    """``kind``: categorical (``choices``), int or float (``low``, ``high``, both included; ``log`` for a log scale)."""

    name: str
    kind: str
    choices: tuple = ()
    low: float = 0.0
    high: float = 1.0
    log: bool = False

    def draw(self, rng: random.Random):
        if self.kind == "categorical":
            return rng.choice(self.choices)
        if self.kind not in ("int", "float"):
            raise ValueError(f"unknown kind: {self.kind}")
        x = math.exp(rng.uniform(math.log(self.low), math.log(self.high))) if self.log else rng.uniform(self.low, self.high)
        return min(int(self.high), max(int(self.low), round(x))) if self.kind == "int" else x


@dataclass(frozen=True)
class Constraints:
    max_compute_hours: float = 100.0
    max_contamination_rate: float = 0.01
    min_dataset_tokens: int = 1_000_000_000
    min_diversity_score: float = 0.5


def _violations(c: Constraints) -> list[tuple[str, Column, float]]:
    """name, amount over or under the limit (positive: violated), limit."""
    return [
        ("compute_hours", F.coalesce("compute_cost", F.lit(0.0)) - c.max_compute_hours, c.max_compute_hours),
        ("contamination_rate", F.coalesce("contamination_rate", F.lit(0.0)) - c.max_contamination_rate, c.max_contamination_rate),
        ("dataset_tokens", (c.min_dataset_tokens - F.coalesce("dataset_tokens", F.lit(0))).cast("double"), float(c.min_dataset_tokens)),
        ("diversity_score", c.min_diversity_score - F.coalesce("diversity_score", F.lit(1.0)), c.min_diversity_score),
    ]


def with_violations(trials: DataFrame, c: Constraints = Constraints()) -> DataFrame:
    """Add ``violations`` (array of constraint and amount), ``is_feasible``, ``total_violation`` and ``normalized_violation``.

    Amounts of different units are summed as they are; the normalized sum divides each by its limit.
    """
    each = [F.when(x > 0, F.struct(F.lit(n).alias("constraint"), x.alias("amount"), F.lit(float(limit)).alias("limit"))) for n, x, limit in _violations(c)]
    out = trials.withColumn("violations", F.filter(F.array(*each), lambda v: v.isNotNull()))
    total = F.aggregate("violations", F.lit(0.0), lambda a, v: a + v["amount"])
    normal = F.aggregate("violations", F.lit(0.0), lambda a, v: a + F.when(v["limit"] != 0, v["amount"] / F.abs(v["limit"])).otherwise(v["amount"]))
    return out.withColumn("is_feasible", F.size("violations") == 0).withColumn("total_violation", total).withColumn("normalized_violation", normal)


def feasibility_first(trials: DataFrame, c: Constraints = Constraints(), normalized: bool = False) -> DataFrame:
    """Feasible trials by score, then the others by violation; ties by id."""
    by = F.col("normalized_violation" if normalized else "total_violation")
    key = F.when(F.col("is_feasible"), -F.col("score")).otherwise(by)
    return with_violations(trials, c).orderBy(F.desc("is_feasible"), key, "trial_id")


def penalized(trials: DataFrame, c: Constraints = Constraints(), weight: float = 1.0) -> DataFrame:
    return with_violations(trials, c).withColumn("penalized_score", F.col("score") - weight * F.col("normalized_violation"))


def feasible(trials: DataFrame, c: Constraints = Constraints()) -> DataFrame:
    return with_violations(trials, c).where("is_feasible")


def top_trials(trials: DataFrame, k: int) -> DataFrame:
    return trials.orderBy(F.desc_nulls_last("score"), "trial_id").limit(k)


def pareto(trials: DataFrame) -> DataFrame:
    """``trial_id, is_pareto``: no other trial is as good in score, cost and tokens and better in one. Equal ones both stay.

    A skyline by merging: every partition drops the trials that its own rows dominate, and the survivors, which hold every trial
    of the frontier, are compared among themselves. Trials with a missing objective are dominated by none and dominate none.
    """
    goals = trials.select("trial_id", F.col("score").cast("double").alias("s"), (-F.col("compute_cost").cast("double")).alias("c"), F.col("dataset_tokens").cast("double").alias("t"))
    whole = goals.where("s IS NOT NULL AND c IS NOT NULL AND t IS NOT NULL")
    first = whole.groupBy("s", "c", "t").agg(F.count("*").alias("n")).select("s", "c", "t")

    def local(batches):
        import numpy as np

        best = np.empty((0, 3))
        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            best = skyline(np.vstack([best, rows]))
        yield pa.RecordBatch.from_arrays([pa.array(best[:, k]) for k in range(3)], names=["s", "c", "t"])

    schema = "s double, c double, t double"
    front = first.mapInArrow(local, schema)
    # what is left of all partitions meets in fewer and fewer tasks
    parts = shuffle_partitions(trials.sparkSession)
    while parts > 1:
        parts = max(1, parts // 8)
        front = front.repartition(parts).mapInArrow(local, schema)
    front = front.withColumn("_f", F.lit(True))
    return goals.join(front, ["s", "c", "t"], "left").select("trial_id", F.coalesce("_f", F.lit(False)).alias("is_pareto"))


def skyline(points):
    """The rows of three columns that no other row dominates.

    In descending order of the first column only earlier rows can dominate; of their other two columns a staircase is kept, in which
    one search tells.
    """
    import numpy as np

    points = np.unique(points, axis=0)[::-1]
    kept, c, t = [], [], []  # c rises, t falls
    for k, (_, x, y) in enumerate(points.tolist()):
        i = bisect_left(c, x)
        if i < len(c) and t[i] >= y:
            continue
        kept.append(k)
        j = bisect_right(c, x)
        i = j
        while i and t[i - 1] <= y:
            i -= 1
        c[i:j], t[i:j] = [x], [y]
    return points[kept]


def save_frontier(trials: DataFrame, path: str) -> dict:
    """``objectives, frontier, all_points`` of trials as a JSON file; ``config`` (a JSON string) goes along if there is such a column."""
    config = ["config"] if "config" in trials.columns else []
    rows = trials.select("trial_id", "score", "compute_cost", "dataset_tokens", *config).join(pareto(trials), "trial_id").orderBy("trial_id").collect()
    point = lambda r: {"trial_id": r["trial_id"], "objectives": {k: r[k] for k in ("score", "compute_cost", "dataset_tokens")}}
    out = {
        "objectives": {"score": "max", "compute_cost": "min", "dataset_tokens": "max"},
        "frontier": [point(r) | ({"config": json.loads(r["config"] or "{}")} if config else {}) for r in rows if r["is_pareto"]],
        "all_points": [point(r) | {"is_pareto": r["is_pareto"]} for r in rows],
    }
    storage.write_text(path, json.dumps(out, indent=2))
    return out


def load_frontier(spark: SparkSession, path: str) -> DataFrame:
    """``trial_id, score, compute_cost, dataset_tokens, is_pareto`` of a saved frontier and all its points."""
    rows = json.loads(storage.read_text(path))["all_points"]
    flat = [(r["trial_id"], r["objectives"]["score"], r["objectives"]["compute_cost"], r["objectives"]["dataset_tokens"], r["is_pareto"]) for r in rows]
    return spark.createDataFrame(flat, "trial_id bigint, score double, compute_cost double, dataset_tokens bigint, is_pareto boolean")


def frontier_summary(frontier: dict) -> str:
    if not frontier["frontier"]:
        return "no trials on the frontier\n"
    lines = [f"{len(frontier['frontier'])} of {len(frontier['all_points'])} trials on the frontier"]
    lines += [f"- {p['trial_id']}: " + ", ".join(f"{k} {v}" for k, v in p["objectives"].items()) for p in frontier["frontier"]]
    return "\n".join(lines) + "\n"


def promote(trials: DataFrame, fraction: float, level: str = "level") -> DataFrame:
    """Per level the best ``max(1, int(n * fraction))`` trials by score; ties by id."""
    size = trials.groupBy(level).agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(fraction) + 1e-9)).alias("_most"))
    rank = F.row_number().over(Window.partitionBy(level).orderBy(F.desc_nulls_last("score"), "trial_id"))
    return trials.withColumn("_rank", rank).join(size, level).where("_rank <= _most").drop("_rank", "_most")


def pruned(reports: DataFrame, fraction: float = 0.5, min_steps: int = 100) -> DataFrame:
    """Add ``prune``: a report after ``min_steps`` below ``fraction`` of the best score reported so far by any trial.

    ``reports``: report_ord (unique), trial_id, step, score. The best so far is a running maximum over ranges of the order.
    """
    from loamworks.operators.prefix import ranged

    split = ranged(reports, ["report_ord"])
    tops = split.groupBy("_range").agg(F.max("score").alias("_top"))
    # one row per range
    ahead = tops.select(F.col("_range"), F.max("_top").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max("score").over(Window.partitionBy("_range").orderBy("report_ord").rowsBetween(Window.unboundedPreceding, 0))
    best = F.greatest(F.col("_inside"), F.col("_before"))
    out = split.withColumn("_inside", inside).join(ahead, "_range").withColumn("best_so_far", best)
    return out.withColumn("prune", (F.col("step") >= min_steps) & (F.col("score") < F.col("best_so_far") * fraction)).drop("_range", "_inside", "_before")


def early_stops(reports: DataFrame, patience: int = 3, delta: float = 0.01) -> DataFrame:
    """``trial_id, stop_step``: the first step at which the loss has not fallen by more than ``delta`` below its best for ``patience`` reports; null if never.

    ``reports``: trial_id, step, loss. A scan in order within each trial; a trial's reports are as many as its steps.
    """

    def scan(key, table):
        rows = sorted(zip(table.column("step").to_pylist(), table.column("loss").to_pylist(), strict=True))
        best, bad, stop = math.inf, 0, None
        for step, loss in rows:
            if loss < best - delta:
                best, bad = loss, 0
            else:
                bad += 1
            if bad >= patience:
                stop = step
                break
        return pa.table({"trial_id": pa.array([key[0].as_py()], pa.int64()), "stop_step": pa.array([stop], pa.int64())})

    return reports.select(F.col("trial_id").cast("bigint").alias("trial_id"), F.col("step").cast("bigint").alias("step"), "loss").groupBy("trial_id").applyInArrow(scan, "trial_id bigint, stop_step bigint")


@dataclass
class Trial:
    trial_id: int
    config: dict
    score: float = -math.inf
    compute_cost: float = 0.0
    dataset_tokens: int = 0
    metrics: dict = field(default_factory=dict)
    is_feasible: bool = True


def violations_of(t: Trial, c: Constraints) -> float:
    m = t.metrics
    over = (t.compute_cost - c.max_compute_hours, m.get("contamination_rate", 0.0) - c.max_contamination_rate, float(c.min_dataset_tokens - t.dataset_tokens), c.min_diversity_score - m.get("diversity_score", 1.0))
    return sum(x for x in over if x > 0)


def random_search(space: list[Parameter], objective: Callable[[dict], dict], n: int, c: Constraints = Constraints(), seed: int = 42) -> list[Trial]:
    """``n`` trials of drawn configurations, best first: feasible by score, then by least violation.

    ``objective`` returns score, compute_cost, dataset_tokens and metrics; one that raises gives an infeasible trial.
    """
    rng = random.Random(seed)
    return _best_first([_tried(k, {p.name: p.draw(rng) for p in space}, objective, c) for k in range(n)])


def _tried(k: int, config: dict, objective: Callable[[dict], dict], c: Constraints) -> Trial:
    try:
        r = objective(config)
        t = Trial(k, config, r["score"], r.get("compute_cost", 0.0), r.get("dataset_tokens", 0), r.get("metrics", {}))
        t.is_feasible = violations_of(t, c) == 0
        return t
    except Exception as e:
        return Trial(k, config, metrics={"error": str(e)}, is_feasible=False)


def _best_first(trials: list[Trial], c: Constraints = Constraints()) -> list[Trial]:
    return sorted(trials, key=lambda t: (not t.is_feasible, -t.score if t.is_feasible else ("error" in t.metrics, violations_of(t, c)), t.trial_id))


def successive_halving(space: list[Parameter], objective: Callable[[dict, float], float], n: int, budgets: tuple[float, ...] = (0.1, 0.3, 1.0), keep: tuple[float, ...] = (0.3, 0.5), seed: int = 42) -> list[Trial]:
    """Trials at rising budgets; after each level the best share goes on. Returns those of the last level, best first."""
    rng = random.Random(seed)
    live = [Trial(k, {p.name: p.draw(rng) for p in space}) for k in range(n)]
    for level, budget in enumerate(budgets):
        for t in live:
            t.score = objective(t.config, budget)
        live.sort(key=lambda t: (-t.score, t.trial_id))
        if level < len(keep):
            live = live[: max(1, int(len(live) * keep[level]))]
    return live


def config_id(config: dict) -> str:
    from loamworks.plans.policy import canonical

    return hashlib.sha256(canonical(config).encode()).hexdigest()[:16]
