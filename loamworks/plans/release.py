"""Releases and reports: run stamps, dataset cards, exports, rebuilds, policy diffs and the tables behind plots."""

from __future__ import annotations

import html
import json
import os
import platform
import subprocess
from datetime import UTC, datetime
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks import storage
from loamworks.plans.policy import Policy, canonical
from loamworks.sources import tables


def run_stamp(packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas")) -> dict:
    """Commit, dependencies and machine of this run."""

    def git(*args: str) -> str:
        try:
            return subprocess.run(["git", *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return ""

    versions = {}
    for p in packages:
        try:
            versions[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            versions[p] = None
    return {
        "created_at": datetime.now(UTC).isoformat(),
        "code": {"commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain"))},
        "python": platform.python_version(),
        "packages": versions,
        "machine": {"system": platform.system(), "cpus": os.cpu_count(), "processor": platform.machine()},
    }


def dataset_card(manifest: dict, policy: Policy, stats: DataFrame | None = None, slices: int = 50) -> str:
    """Markdown: what the dataset is, how it was made, and its largest slices, ``slices`` of them; the card says if there are more."""
    n = sum(s.get("doc_count", 0) for s in manifest["shards"])
    out = [f"# {manifest['dataset_id']}", "", f"Created {manifest['created_at']}, {n} documents in {len(manifest['shards'])} shards ({manifest['format']}).", "", "## Policy", ""]
    out += [f"- {k}: {json.dumps(v)}" for k, v in policy.to_dict().items()]
    out += ["", f"Policy hash: `{policy.digest()}`", ""]
    if stats is not None:
        out += ["## Slices", "", "| slice | documents | tokens | mean quality |", "| --- | --- | --- | --- |"]
        rows = stats.orderBy(F.desc("token_count"), "slice").limit(slices + 1).collect()
        out += [f"| {r['slice']} | {r['doc_count']} | {r['token_count']} | {r['avg_quality_score']} |" for r in rows[:slices]]
        out += ["", f"The {slices} slices of most tokens; there are more."] * (len(rows) > slices)
    return "\n".join(out) + "\n"


def export_dataset(df: DataFrame, path: str, dataset_id: str, license_name: str = "", per_shard: int = 10_000) -> dict:
    """Parquet shards with ``dataset_info.json`` and ``state.json`` beside them."""
    tables.write_shards(df, storage.join(path, "data"), per_shard, "parquet")
    shards = tables.shard_manifest(df.sparkSession, storage.join(path, "data"), "parquet")
    manifest = tables.make_manifest(dataset_id, shards, fmt="parquet")
    info = {"dataset_name": dataset_id, "license": license_name, "features": {f.name: f.dataType.simpleString() for f in df.schema.fields}, "splits": {"train": {"num_examples": sum(s["doc_count"] for s in manifest["shards"])}}}
    for name, data in (("dataset_info.json", info), ("state.json", {"_data_files": [{"filename": f"data/{s['path']}"} for s in manifest["shards"]], "_split": "train"}), ("manifest.json", manifest)):
        storage.write_text(storage.join(path, name), json.dumps(data, indent=2, sort_keys=True, default=str))
    return manifest


def verify_release(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """``path, problem`` of shards of a saved manifest that are missing, or whose checksum or count differs; no rows if all is well."""
    manifest = tables.load_manifest(storage.join(path, "manifest.json"))
    want = spark.createDataFrame([(s["path"], s["checksum"], s["doc_count"]) for s in manifest["shards"]], "path string, want_sum string, want_count bigint")
    have = tables.shard_manifest(spark, storage.join(path, "data"), fmt)
    joined = want.join(have, "path", "full_outer")
    problem = F.when(F.col("checksum").isNull(), "missing").when(F.col("want_sum").isNull(), "unknown").when(F.col("checksum") != F.col("want_sum"), "checksum").when(F.col("doc_count") != F.col("want_count"), "count")
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def rebuild(spark: SparkSession, manifest: dict, read, out: str, evaluation: DataFrame | None = None) -> dict:
    """Carry the manifest's policy out again on ``read(spark, input)`` and report whether the documents' ids and texts agree.

    ``contents_match`` is null if the manifest has no hash of its contents.
    """
    from loamworks.plans.policy import execute

    policy = Policy.from_dict(manifest["policy_config"])
    curated = execute(read(spark, manifest["input_sources"]), policy, evaluation)
    tables.write_shards(curated.documents.select("doc_id", "text").orderBy("doc_id"), out)
    new = tables.shard_manifest(spark, out)
    old = sum(s["doc_count"] for s in manifest["shards"])
    known = manifest.get("content_hash")
    same = tables.content_hash(spark, out) == known if known else None
    return {"policy_matches": manifest["policy_config_hash"] == policy.digest(), "contents_match": same, "documents": new.agg(F.sum("doc_count")).first()[0], "expected": old}


def policy_diff(a: Policy, b: Policy, tolerance: float = 1e-6) -> list[dict]:
    """``path, change, old, new`` of every leaf that was added, removed or changed; numbers within the tolerance are equal."""

    def leaves(x, at=""):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from leaves(v, f"{at}.{k}" if at else str(k))
        else:
            yield at, x

    old, new = dict(leaves(a.to_dict())), dict(leaves(b.to_dict()))
    out = []
    for k in sorted(old.keys() | new.keys()):
        if k not in old or k not in new:
            out.append({"path": k, "change": "added" if k not in old else "removed", "old": old.get(k), "new": new.get(k)})
        elif canonical({"v": old[k]}) != canonical({"v": new[k]}):
            number = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (old[k], new[k]))
            if not number or abs(old[k] - new[k]) > tolerance:
                out.append({"path": k, "change": "changed", "old": old[k], "new": new[k]})
    return out


def diff_report(a: Policy, b: Policy) -> str:
    rows = [f"| {d['path']} | {d['change']} | {d['old']} | {d['new']} |" for d in policy_diff(a, b)]
    return "\n".join([f"# {a.name} against {b.name}", "", "| field | change | old | new |", "| --- | --- | --- | --- |", *rows]) + "\n"


def experiment_report(title: str, scores: DataFrame, coefficients: DataFrame | None = None, as_html: bool = False) -> str:
    """Scores, best first, and the five highest and three lowest coefficients of each benchmark."""
    out = [f"# {title}", "", "| benchmark | score |", "| --- | --- |"]
    out += [f"| {r['benchmark']} | {r['score']:.4f} |" for r in scores.orderBy(F.desc("score"), "benchmark").toLocalIterator()]
    if coefficients is not None:
        up = F.row_number().over(Window.partitionBy("benchmark").orderBy(F.desc("value"), "slice"))
        down = F.row_number().over(Window.partitionBy("benchmark").orderBy("value", "slice"))
        ends = coefficients.withColumn("_u", up).withColumn("_d", down).where("_u <= 5 OR _d <= 3").orderBy("benchmark", F.desc("value"))
        out += ["", "| benchmark | slice | value | interval |", "| --- | --- | --- | --- |"]
        out += [f"| {r['benchmark']} | {r['slice']} | {r['value']:.4f} | {r['ci_low']:.4f} to {r['ci_high']:.4f} |" for r in ends.collect()]
    text = "\n".join(out) + "\n"
    return f"<html><body><pre>{html.escape(text)}</pre></body></html>" if as_html else text


def slices_for_plot(stats: DataFrame, least: float = 0.02) -> DataFrame:
    """``slice, token_count, share``: slices under ``least`` of all tokens together as ``other``."""
    total = stats.agg(F.sum("token_count").alias("t")).first()["t"] or 0
    share = F.col("token_count") / F.lit(float(total)) if total else F.lit(0.0)
    named = stats.select(F.when(share < least, F.lit("other")).otherwise(F.col("slice")).alias("slice"), "token_count")
    out = named.groupBy("slice").agg(F.sum("token_count").alias("token_count"))
    return out.withColumn("share", F.col("token_count") / F.lit(float(total)) if total else F.lit(0.0))
