"""One surviving record for each duplicate group, ranked or built field by field.

Deliveries of one record (same record id) count once: the one ingested last stands for it. A group is the
set of records that share a cluster id once trimmed and lower-cased; records with a null or blank
cluster id, and null record ids, take part in none. NaN counts as missing, and a missing value ranks lowest.
Ties are broken by the least record id. Columns that are not named here are ignored.

A group may hold a third of all rows: ranking keeps the best of each input partition before the shuffle
(Spark's window group limit), the other figures are partial aggregates, so no task sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILLED = ("url", "dump", "language", "language_score", "token_count", "toxicity_score", "dedup_method")
CRITERIA = ("completeness", "fetched_at", "trust", "token_count", "overall")
FIELDS = ("source", "url", "dump", "language", "language_score", "token_count", "toxicity_score", "dedup_method")


def _number(c: str) -> Column:
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c))


def _filled(c: str, kind: str) -> Column:
    if kind == "string":
        return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return F.col(c).isNotNull()


def clean_records(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per record id of a cluster: cluster_id, record_id, the fields, and the five criteria."""
    typed = records.where("record_id IS NOT NULL").select(
        "record_id",
        F.nullif(F.lower(F.trim("dedup_cluster_id")), F.lit("")).alias("cluster_id"),
        "source", "url", "dump", "language", _number("language_score").alias("language_score"), "token_count",
        _number("toxicity_score").alias("toxicity_score"), "dedup_method", "fetched_at", "ingested_at",
        F.try_element_at("quality_scores", F.lit("overall")).alias("overall"),
    )
    typed = typed.withColumn("overall", _number("overall"))
    rest = [c for c in typed.columns if c not in ("record_id", "ingested_at")]
    last = typed.groupBy("record_id").agg(F.max(F.struct("ingested_at", *rest)).alias("r")).select("record_id", "r.*").where("cluster_id IS NOT NULL")
    kinds = dict(last.dtypes)
    trust = catalog.where("source IS NOT NULL").groupBy(F.lower(F.trim("source")).alias("_s")).agg(F.max("trust").alias("trust"))
    full = last.withColumn("completeness", sum((_filled(c, kinds[c]).cast("int") for c in FILLED), F.lit(0)))
    return full.withColumn("_s", F.lower(F.trim("source"))).join(trust, "_s", "left").drop("_s")


def _order() -> list[Column]:
    """Completeness, trust and recency first; the same five values as the criteria."""
    return [F.col(c).desc_nulls_last() for c in ("completeness", "trust", "fetched_at", "token_count", "overall")] + [F.col("record_id").asc()]


def _ranked(cleaned: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(*_order()))
    return cleaned.withColumn("rank", rank).where(F.col("rank") <= most)


def dominant_records(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """``cluster_id, record_id``: the record that is at least as good as every other of its cluster in all
    criteria and better than each in one. Clusters of one record, and those without such a record, have no row.

    Such a record comes first in any ranking that compares the criteria one after the other, so only the
    first of the ranking can be one: it must reach the cluster's best value of each criterion, and the
    second must differ from it.
    """
    cleaned = clean_records(records, catalog)
    best = cleaned.groupBy("cluster_id").agg(F.count("*").alias("n"), *[F.max(c).alias(f"best_{c}") for c in CRITERIA])
    best = best.where("n > 1")
    top = _ranked(cleaned, 2).groupBy("cluster_id").agg(
        F.min(F.struct("rank", "record_id", *CRITERIA)).alias("first"), F.max(F.struct("rank", *CRITERIA)).alias("second")
    )
    reaches, differs = F.lit(True), F.lit(False)
    for c in CRITERIA:
        reaches &= F.col(f"first.{c}").eqNullSafe(F.col(f"best_{c}"))
        differs |= ~F.col(f"first.{c}").eqNullSafe(F.col(f"second.{c}"))
    return top.join(best, "cluster_id").where(reaches & differs).select("cluster_id", F.col("first.record_id").alias("record_id"))


def surviving_records(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """One record per cluster, built field by field.

    ``record_id`` is the best of the ranking; each field comes from the best record that has it filled.
    """
    cleaned = clean_records(records, catalog)
    kinds = dict(cleaned.dtypes)

    def key(c: str) -> Column:  # greater is better; nulls sort lowest in a struct
        return F.struct("completeness", "trust", "fetched_at", "token_count", "overall", (-F.col("record_id")).alias("k"))

    values = [F.max_by(c, F.when(_filled(c, kinds[c]), key(c))).alias(c) for c in FIELDS]
    first = F.max_by("record_id", key("record_id")).alias("record_id")
    return cleaned.groupBy("cluster_id").agg(first, F.count("*").alias("n_records"), F.max("fetched_at").alias("fetched_at"), F.max("overall").alias("overall"), *values)
