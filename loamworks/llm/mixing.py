"""Selections of documents in which each source holds a target share of the tokens.

For each plan the weights are scaled to shares over its sources that have tokens; a repeated plan row counts
once, rows whose weight is null, NaN or not positive and sources without tokens are left out. ``max_repeats``
says how often a document may be taken (null or below 1: once). The total is the plan's budget, or less if some source
cannot fill its share: then all shrink together, so that the shares hold. A null budget is no limit.

Within a source documents come in the order of a seeded hash of their id, and are taken up to the source's exact
part of the total, in as many whole rounds as needed and one last cut. Documents that are null, empty
or without source are in no selection; a null plan or source in the plan table is ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamworks.operators.prefix import running_total

BUCKETS = 1024


def targets(sizes: DataFrame, plans: DataFrame) -> DataFrame:
    """plan, source, share, max_repeats, tokens (of the source), target_tokens. ``sizes``: source, tokens."""
    rows = plans.select(
        "plan", F.lower(F.trim("source")).alias("source"), F.col("weight").cast("double").alias("weight"),
        F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(1)).cast("bigint").alias("max_repeats"), "budget_tokens",
    )
    rows = rows.where("plan IS NOT NULL AND source IS NOT NULL AND source <> '' AND weight > 0 AND NOT isnan(weight)")
    rows = rows.groupBy("plan", "source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("budget_tokens").alias("budget_tokens"))
    rows = rows.join(sizes.where("tokens > 0"), "source")
    plan = Window.partitionBy("plan")
    rows = rows.withColumn("share", F.col("weight") / F.sum("weight").over(plan))
    most = F.min(F.col("tokens") * F.col("max_repeats") / F.col("share")).over(plan)
    total = F.least(most, F.max("budget_tokens").over(plan).cast("double"))
    rows = rows.withColumn("target_tokens", F.least(F.floor(total * F.col("share") + 1e-6), F.col("tokens") * F.col("max_repeats")).cast("bigint"))
    return rows.select("plan", "source", "share", "max_repeats", "tokens", "target_tokens")


def mix(counted: DataFrame, plans: DataFrame, seed: int = 0) -> DataFrame:
    """plan, doc_id, source, token_count, repeats: the documents of each plan and how often each is taken.

    ``counted``: doc_id (unique), source, token_count. Plans are few; documents are joined to those of their source.
    """
    docs = counted.select("doc_id", F.lower(F.trim("source")).alias("source"), "token_count")
    docs = docs.where("source IS NOT NULL AND source <> '' AND token_count > 0 AND doc_id IS NOT NULL")
    # 48 bits of a hash as the order, the upper ones as the bucket of the running total
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("bigint")
    docs = docs.withColumn("_key", key).withColumn("_bucket", F.shiftright("_key", 48 - BUCKETS.bit_length() + 1))
    placed = running_total(docs, ["source"], "_bucket", ["_key", "doc_id"], F.col("token_count"), "_ahead")
    wanted = targets(docs.groupBy("source").agg(F.sum("token_count").alias("tokens")), plans)
    joined = placed.join(wanted, "source")
    rounds = F.floor(F.col("target_tokens") / F.col("tokens"))
    rest = F.col("target_tokens") - rounds * F.col("tokens")
    repeats = (rounds + (F.col("_ahead") + F.col("token_count") <= rest).cast("bigint")).cast("bigint")
    return joined.select("plan", "doc_id", "source", "token_count", repeats.alias("repeats")).where("repeats > 0")


def mix_report(counted: DataFrame, plans: DataFrame, seed: int = 0) -> DataFrame:
    """plan, source, target_share, actual_share, target_tokens, actual_tokens, n_docs, most_repeats."""
    docs = counted.select("doc_id", F.lower(F.trim("source")).alias("source"), "token_count").where("source <> '' AND token_count > 0 AND doc_id IS NOT NULL")
    wanted = targets(docs.groupBy("source").agg(F.sum("token_count").alias("tokens")), plans)
    got = mix(counted, plans, seed).groupBy("plan", "source").agg(
        F.sum(F.col("token_count") * F.col("repeats")).alias("actual_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats")
    )
    out = wanted.join(got, ["plan", "source"], "left").na.fill(0, ["actual_tokens", "n_docs", "most_repeats"])
    whole = F.sum("actual_tokens").over(Window.partitionBy("plan"))
    share = F.when(whole > 0, F.col("actual_tokens") / whole).otherwise(0.0)
    return out.select("plan", "source", F.col("share").alias("target_share"), share.alias("actual_share"), "target_tokens", "actual_tokens", "n_docs", "most_repeats")
