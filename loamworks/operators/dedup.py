"""Exact duplicates, keep rules within clusters, and scoped deduplication.

Every rule that depends on an order takes it as a column (``order``, unique). The winners are partial aggregates over ids, hashes
and scores, so a cluster of any size is safe and no text is shuffled to find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.functions.text import content_hash, words

METHODS = ("exact", "minhash", "semantic")


def with_scope(df: DataFrame, scope: str = "global", dump: str = "dump") -> DataFrame:
    """Add ``dedup_scope``: one for all, or the dump (missing: ``unknown``)."""
    if scope not in ("global", "per_dump"):
        raise ValueError(f"unknown scope: {scope}")
    return df.withColumn("dedup_scope", F.lit("global") if scope == "global" else F.coalesce(F.nullif(F.col(dump), F.lit("")), F.lit("unknown")))


def mark_exact(df: DataFrame, order: str = "doc_id", scope: str = "global", normalize: bool = True, text: str = "text", dump: str = "dump") -> DataFrame:
    """Add ``content_hash``, ``dedup_cluster_id`` (its first 16 digits), ``dedup_method`` and ``dedup_dropped``.

    The first document of each text in a scope is kept. A null text counts as an empty one.
    """
    hashed = with_scope(df, scope, dump).withColumn("content_hash", content_hash(F.coalesce(F.col(text), F.lit("")), normalize))
    first = hashed.groupBy("dedup_scope", "content_hash").agg(F.min(order).alias("_first"))
    out = hashed.join(first, ["dedup_scope", "content_hash"])
    return out.withColumns(
        {"dedup_cluster_id": F.substring("content_hash", 1, 16), "dedup_method": F.lit("exact"), "dedup_dropped": F.col(order) != F.col("_first")}
    ).drop("_first")


def exact_dedup(df: DataFrame, order: str = "doc_id", scope: str = "global", normalize: bool = True, text: str = "text", dump: str = "dump") -> DataFrame:
    """Keep the first document of each text in a scope.

    One pass and one shuffle, of the columns that are used later; each input partition passes on one row per text (window group limit).
    """
    hashed = with_scope(df, scope, dump).withColumn("content_hash", content_hash(F.coalesce(F.col(text), F.lit("")), normalize))
    rank = F.row_number().over(Window.partitionBy("dedup_scope", "content_hash").orderBy(order))
    kept = hashed.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return kept.withColumn("dedup_cluster_id", F.substring("content_hash", 1, 16)).withColumn("dedup_method", F.lit("exact"))


def keep_score(rule: str, columns: list[str]) -> Column:
    """What a rule prefers most of (for ``first`` a constant); columns that are missing count as null."""
    has = lambda c, kind: F.col(c) if c in columns else F.lit(None).cast(kind)
    return {
        "first": lambda: F.lit(0),
        "longest": lambda: F.length("text"),
        "most_tokens": lambda: F.coalesce(has("token_count", "bigint"), F.size(words(F.coalesce(F.col("text"), F.lit(""))))),
        "highest_quality": lambda: F.coalesce(has("mean_quality", "double"), has("quality_score", "double"), F.lit(0.0)),
        "lowest_toxicity": lambda: -F.coalesce(has("toxicity_score", "double"), F.lit(0.0)),
        "most_recent": lambda: F.coalesce(has("timestamp", "timestamp").cast("timestamp"), F.timestamp_seconds(F.lit(0))),
    }[rule]()


KEEP_RULES = ("first", "longest", "most_tokens", "highest_quality", "lowest_toxicity", "most_recent")


def keep_one(df: DataFrame, rule: str = "first", cluster: str = "dedup_cluster_id", order: str = "doc_id", score: Column | None = None, scope: str | None = None) -> DataFrame:
    """One document per cluster by a keep rule, with ``cluster_size`` and ``kept_id``; a missing cluster is the document's own.

    ``scope``: a column within whose values clusters count apart. Ties keep the last document, except for ``first``. Only order,
    cluster and score are ranked; the rows of the winners are then fetched.
    """
    if rule not in KEEP_RULES:
        raise ValueError(f"unknown keep rule: {rule}")
    score = score if score is not None else keep_score(rule, df.columns)
    own = F.coalesce(F.col(cluster).cast("string"), F.concat(F.lit("#"), F.col(order).cast("string")))
    slim = df.select(F.col(order).alias("o"), own.alias("c"), (F.col(scope) if scope else F.lit(None).cast("string")).alias("s"), score.alias("v"))
    # the greatest score and then the last place, or the first place; partial aggregates, so a cluster of any size is safe
    best = F.min(F.col("o")) if rule == "first" else F.max(F.struct("v", "o"))["o"]
    kept = slim.groupBy("s", "c").agg(best.alias(order), F.count("*").alias("cluster_size"))
    return df.join(kept.select(order, "cluster_size"), order).withColumn("kept_id", F.col(order))


def raw_dedup(df: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep the first document of each text, byte for byte; by md5 of the text."""
    rank = F.row_number().over(Window.partitionBy(F.md5(F.coalesce(F.col(text), F.lit("")))).orderBy(order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def dedup_stats(marked: DataFrame) -> DataFrame:
    """Per scope and method: documents, clusters, kept and dropped."""
    dropped = F.coalesce(F.col("dedup_dropped"), F.lit(False))
    return marked.groupBy("dedup_scope", "dedup_method").agg(
        F.count("*").alias("n_docs"), F.countDistinct("dedup_cluster_id").alias("n_clusters"), F.count_if(~dropped).alias("kept"), F.count_if(dropped).alias("dropped")
    )
