"""Slice tags of documents and statistics per slice."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks import storage
from loamworks.functions.text import authority


def _tag(name: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}="), value))


# Names, edges and labels of the bins below.


def _bins(name: str, value: Column, edges: list[tuple[float, str]], last: str, least: bool) -> Column:
    """The label of the first edge that the value is below (or, with ``least``, not below)."""
    c = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in edges:
        c = c.when(value >= edge if least else value < edge, F.lit(f"{name}={label}"))
    return c.otherwise(F.lit(f"{name}={last}"))


def domain_tags(url: Column) -> Column:
    """The network location as written, and its type for academic and government hosts."""
    host = authority(url)
    bare = F.lower(host)
    kind = F.when(bare.endswith(".edu"), F.lit("domain_type=edu")).when(bare.endswith(".gov"), F.lit("domain_type=gov"))
    return F.array(_tag("domain", host), kind)


def token_bin(n: Column) -> Column:
    return _bins("token_bin", n, [(128, "tiny"), (512, "small"), (2048, "medium")], "large", False)


def quality_bin(q: Column) -> Column:
    return _bins("quality_bin", q, [(0.8, "high"), (0.5, "medium")], "low", True)


def language_score_bin(s: Column) -> Column:
    return _bins("lang_score_bin", s, [(0.95, "very_high"), (0.85, "high"), (0.7, "medium")], "low", True)


def toxicity_bin(t: Column) -> Column:
    return _bins("toxicity_bin", t, [(0.1, "safe"), (0.3, "low_risk"), (0.5, "medium_risk")], "high_risk", False)


class SliceRegistry:
    """Named rules, each from a data frame to a column of one tag or an array of tags."""

    def __init__(self) -> None:
        self.rules: dict[str, Callable[[set[str]], Column | None]] = {}

    def register(self, name: str, rule: Callable[[set[str]], Column | None]) -> None:
        """``rule`` gets the names of the columns and returns a column, or None where it does not apply."""
        if name in self.rules:
            raise ValueError(f"slice rule {name} exists")
        self.rules[name] = rule

    def tags(self, columns: set[str]) -> Column:
        made = [c for c in (rule(columns) for rule in self.rules.values()) if c is not None]
        return F.array_sort(F.array_distinct(F.filter(F.concat(*made), lambda t: t.isNotNull()))) if made else F.array().cast("array<string>")

    def version(self) -> str:
        """Hash of the rules' definitions, 12 digits."""
        return hashlib.sha256("\n".join(f"{k}:{v.__code__.co_code.hex()}:{v.__code__.co_consts}" for k, v in sorted(self.rules.items())).encode()).hexdigest()[:12]


def default_registry() -> SliceRegistry:
    def on(column: str, make: Callable[[Column], Column], many: bool = False):
        return lambda columns: (make(F.col(column)) if many else F.array(make(F.col(column)))) if column in columns else None

    r = SliceRegistry()
    r.register("dump", on("dump", lambda c: _tag("dump", c)))
    r.register("language", on("language", lambda c: _tag("lang", c)))
    r.register("domain", on("url", domain_tags, many=True))
    r.register("token_bin", on("token_count", token_bin))
    r.register("quality_bin", on("mean_quality", quality_bin))
    r.register("lang_score_bin", on("language_score", language_score_bin))
    r.register("toxicity_bin", on("toxicity_score", toxicity_bin))
    return r


def assign_slices(df: DataFrame, registry: SliceRegistry | None = None) -> DataFrame:
    """Add ``slice_tags`` (sorted, each once) and ``slice_version``."""
    registry = registry or default_registry()
    return df.withColumn("slice_tags", registry.tags(set(df.columns))).withColumn("slice_version", F.lit(registry.version()))


def _stats(df: DataFrame, *keys: str) -> DataFrame:
    dropped = F.coalesce("dedup_dropped", F.lit(False)) | F.coalesce("decontam_dropped", F.lit(False))
    kept = F.coalesce("kept", F.lit(True)) & ~dropped
    out = df.groupBy(*keys).agg(
        F.count_if(kept).alias("doc_count"),
        F.coalesce(F.sum(F.when(kept, F.coalesce("token_count", F.lit(0)))), F.lit(0)).cast("bigint").alias("token_count"),
        F.coalesce(F.sum(F.when(kept, F.coalesce("mean_quality", F.lit(0.0)))), F.lit(0.0)).alias("_quality"),
        F.count_if(F.coalesce("dedup_dropped", F.lit(False))).alias("dedup_dropped"),
        F.count_if(F.coalesce("decontam_dropped", F.lit(False))).alias("decontam_dropped"),
    )
    rate = lambda c: F.when(F.col(c) + F.col("doc_count") > 0, F.round(F.col(c) / (F.col(c) + F.col("doc_count")), 4)).otherwise(0.0)
    quality = F.when(F.col("doc_count") > 0, F.round(F.col("_quality") / F.col("doc_count"), 4)).otherwise(0.0)
    return out.select(*keys, "doc_count", "token_count", quality.alias("avg_quality_score"), "dedup_dropped", "decontam_dropped", rate("dedup_dropped").alias("dedup_drop_rate"), rate("decontam_dropped").alias("decontam_drop_rate"))


def _complete(df: DataFrame) -> DataFrame:
    for name, kind in (("kept", "boolean"), ("dedup_dropped", "boolean"), ("decontam_dropped", "boolean"), ("token_count", "bigint"), ("mean_quality", "double")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def slice_stats(df: DataFrame) -> DataFrame:
    """Per tag: documents and tokens kept, mean quality, drops and their rates (4 decimals)."""
    tagged = _complete(df).withColumn("slice", F.explode("slice_tags"))
    return _stats(tagged, "slice")


def total_stats(df: DataFrame) -> DataFrame:
    """The same over all documents, each counted once."""
    return _stats(_complete(df))


def composition(stats: DataFrame, total: DataFrame) -> DataFrame:
    """``slice, token_fraction, doc_fraction, avg_quality`` of a run; no rows if the total has no tokens."""
    row = total.select("doc_count", "token_count").first()
    docs, tokens = (row["doc_count"] or 0, row["token_count"] or 0) if row else (0, 0)
    part = lambda c, n: F.lit(0.0) if not n else F.col(c) / F.lit(n)
    out = stats.select("slice", part("token_count", tokens).alias("token_fraction"), part("doc_count", docs).alias("doc_fraction"), F.col("avg_quality_score").alias("avg_quality"))
    return out if tokens else out.limit(0)


def feature_matrix(compositions: DataFrame, run: str = "run_id", most: int = 2000) -> DataFrame:
    """One row per run with a column for each slice, in the order of names, 0 where a run lacks it.

    For tags of which there is one per host or the like, use the long form; more than ``most`` slices are an error.
    """
    names = [r["slice"] for r in compositions.select("slice").distinct().orderBy("slice").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} slices; leave out tags without a bounded number of values")
    return compositions.groupBy(run).pivot("slice", names).agg(F.sum("token_fraction")).na.fill(0.0)


def diversity(stats: DataFrame) -> DataFrame:
    """Entropy of the tokens' shares over slices, divided by its greatest value; 0 for fewer than two slices."""
    shares = stats.where("token_count > 0")
    agg = shares.agg(F.sum("token_count").alias("t"), F.sum(F.col("token_count") * F.ln("token_count")).alias("tl"), F.count("*").alias("k"))
    entropy = F.ln("t") - F.col("tl") / F.col("t")
    return agg.select(F.when(F.col("k") > 1, entropy / F.ln("k")).otherwise(0.0).alias("diversity_score"))


def save_stats(stats: DataFrame, total: DataFrame, path: str) -> None:
    """Statistics as one JSON document with ``total`` and ``by_slice``."""
    by = {r["slice"]: {k: v for k, v in r.asDict().items() if k != "slice"} for r in stats.orderBy("slice").toLocalIterator()}
    storage.write_text(path, json.dumps({"total": total.first().asDict(), "by_slice": by}, indent=2, sort_keys=True))


_STATS_SCHEMA = "slice string, doc_count bigint, token_count bigint, avg_quality_score double, dedup_dropped bigint, decontam_dropped bigint, dedup_drop_rate double, decontam_drop_rate double"


def _rows(spark: SparkSession, by: dict[str, dict]) -> DataFrame:
    names = [n.split()[0] for n in _STATS_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({"slice": k, **v}[n] for n in names) for k, v in by.items()], _STATS_SCHEMA)


def load_stats(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """What ``save_stats`` wrote, with all its fields."""
    data = json.loads(storage.read_text(path))
    return _rows(spark, data["by_slice"]), data["total"]


def manifest_composition(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The dataset id of a saved manifest, and its composition from ``slice_stats.json`` beside it; no rows without that file."""
    run = json.loads(storage.read_text(path)).get("dataset_id", "unknown")
    beside = storage.join(path.rsplit("/", 1)[0], "slice_stats.json")
    if not storage.exists(beside):
        return run, composition(_rows(spark, {}), spark.createDataFrame([(0, 0)], "doc_count bigint, token_count bigint"))
    stats, total = load_stats(spark, beside)
    return run, composition(stats, spark.createDataFrame([(total["doc_count"], total["token_count"])], "doc_count bigint, token_count bigint"))


def collect_compositions(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``run_id, slice, token_fraction, doc_fraction, avg_quality`` of all folders that hold a ``manifest.json``; others are passed over."""
    out = spark.createDataFrame([], "run_id string, slice string, token_fraction double, doc_fraction double, avg_quality double")
    for folder in folders:
        if storage.exists(storage.join(folder, "manifest.json")):
            run, rows = manifest_composition(spark, storage.join(folder, "manifest.json"))
            out = out.unionByName(rows.withColumn("run_id", F.lit(run)))
    return out


def composition_ratios(df: DataFrame, key: str) -> DataFrame:
    """``key, n, share``: documents of each value (missing: ``unknown``) and their share of all."""
    by = df.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key)).agg(F.count("*").alias("n")).withColumn("_k", F.lit(1))
    return by.join(df.agg(F.count("*").alias("_all")).withColumn("_k", F.lit(1)), "_k").select(key, "n", (F.col("n") / F.col("_all")).alias("share"))
