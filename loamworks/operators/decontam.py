"""Overlap of documents with evaluation sets by word n-grams, and what to do about it.

The index holds one row per distinct n-gram hash with the source that registered it first. It meets the exploded hashes of
the documents in an equi-join. An index of at most ``broadcast_rows`` rows, which are counted, is sent to all workers, so that the documents'
n-grams stay where they are; a larger one meets them by a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.functions.text import bound, ngram_hashes, ngrams, words

MODES = ("drop", "tag", "downweight", "redact")


@dataclass(frozen=True)
class DecontamConfig:
    n: int = 13
    threshold: float = 0.8
    mode: str = "drop"
    sample: int = 10
    redact_all: bool = False
    broadcast_rows: int = 1_000_000


def _tokens(column: str):
    return words(F.lower(F.coalesce(F.col(column), F.lit(""))))


def build_index(items: DataFrame, config: DecontamConfig = DecontamConfig(), text: str = "text", source: str = "source", order: str = "item_id") -> DataFrame:
    """``gram, eval_source``: each distinct n-gram and its first source, in the order of the items."""
    grams = items.select(F.col(source).alias("eval_source"), F.col(order).alias("_o"), F.explode(F.array_distinct(ngram_hashes(_tokens(text), config.n))).alias("gram"))
    return grams.groupBy("gram").agg(F.min_by("eval_source", F.struct("_o", "eval_source")).alias("eval_source"))


def overlaps(docs: DataFrame, index: DataFrame, config: DecontamConfig = DecontamConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document that shares an n-gram: overlap score, source of the first match, sample of matches in text order.

    The score is the number of distinct n-grams matched over the number of all n-grams of the document. The sample, of the
    first ``sample`` matches (all with ``redact_all``), has the n-grams themselves, lower-cased.
    """
    known = index if index.limit(config.broadcast_rows + 1).count() > config.broadcast_rows else F.broadcast(index)
    hashed = docs.select(F.col(id_col), ngram_hashes(_tokens(text), config.n).alias("_grams"))
    total = F.size("_grams")
    hits = hashed.select(id_col, total.alias("total"), F.posexplode("_grams").alias("pos", "gram")).join(known, "gram")
    sample = F.array_sort(F.collect_list("pos")) if config.redact_all else F.slice(F.array_sort(F.collect_list("pos")), 1, config.sample)
    matched = F.size(F.collect_set("gram")).cast("bigint")
    by = hits.groupBy(id_col).agg((matched / F.max("total")).alias("overlap_score"), matched.alias("matched"), F.min_by("eval_source", "pos").alias("eval_source"), sample.alias("_pos"))
    texts = docs.select(id_col, F.col(text).alias("_text")).join(by, id_col)
    found = bound(ngrams(_tokens("_text"), config.n), lambda all_: F.transform("_pos", lambda p: F.element_at(all_, p + 1)))
    return texts.withColumn("matched_ngrams", found).drop("_text", "_pos")


def decontaminate(docs: DataFrame, index: DataFrame, config: DecontamConfig = DecontamConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Apply the mode to documents whose overlap reaches the threshold.

    Adds ``contamination`` (action, overlap_score, eval_source, matched_ngrams; null for clean documents) and ``sample_weight``.
    ``drop`` removes; ``tag`` marks; ``downweight`` sets the weight to 1 - overlap, at least 0.1; ``redact`` replaces the
    sampled n-grams where the text has them literally.
    """
    return with_flags(docs, overlaps(docs, index, config, id_col, text).where(F.col("overlap_score") >= config.threshold), config, id_col, text)


def with_flags(docs: DataFrame, flagged: DataFrame, config: DecontamConfig = DecontamConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``decontaminate`` with the documents' overlaps at hand (rows of ``overlaps`` that reach the threshold)."""
    if config.mode not in MODES:
        raise ValueError(f"unknown mode: {config.mode}")
    if config.mode == "drop":
        return docs.join(flagged.select(id_col), id_col, "left_anti").withColumn("contamination", F.lit(None).cast(_FLAG)).withColumn("sample_weight", F.lit(1.0))
    flag = F.struct(F.lit(config.mode).alias("action"), "overlap_score", "eval_source", "matched_ngrams")
    out = docs.join(flagged.select(id_col, flag.alias("contamination")), id_col, "left")
    weight = F.when(F.col("contamination").isNotNull() & F.lit(config.mode == "downweight"), F.greatest(F.lit(0.1), 1 - F.col("contamination.overlap_score"))).otherwise(1.0)
    out = out.withColumn("sample_weight", weight)
    if config.mode == "redact":
        redacted = F.aggregate(F.coalesce("contamination.matched_ngrams", F.array().cast("array<string>")), F.col(text), lambda t, g: F.replace(t, g, F.lit("[REDACTED]")))
        out = out.withColumn(text, redacted)
    return out


_FLAG = "struct<action:string,overlap_score:double,eval_source:string,matched_ngrams:array<string>>"


def audit(docs: DataFrame, index: DataFrame, config: DecontamConfig = DecontamConfig(), id_col: str = "doc_id", text: str = "text", preview: int = 200) -> DataFrame:
    """One row per flagged document: source, score, matches, action and the beginning of its text."""
    flagged = overlaps(docs, index, config, id_col, text).where(F.col("overlap_score") >= config.threshold)
    return flagged.join(docs.select(id_col, F.left(F.col(text), F.lit(preview)).alias("doc_preview")), id_col).withColumn("action_taken", F.lit(config.mode))


def contamination_stats(docs: DataFrame, index: DataFrame, config: DecontamConfig = DecontamConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``eval_source`` (null: all), documents checked, contaminated, the rate, and the number by action: dropped, tagged, downweighted, redacted."""
    flagged = overlaps(docs, index, config, id_col, text).where(F.col("overlap_score") >= config.threshold)
    # documents are few to many, sources a handful: one row of the count meets them
    by = flagged.rollup("eval_source").agg(F.count("*").alias("docs_contaminated")).withColumn("_k", F.lit(1))
    by = by.join(docs.agg(F.count("*").alias("docs_checked")).withColumn("_k", F.lit(1)), "_k")
    rate = F.col("docs_contaminated") / F.greatest(F.lit(1), F.col("docs_checked"))
    done = [F.when(F.lit(m == config.mode), F.col("docs_contaminated")).otherwise(F.lit(0)).cast("bigint").alias(n) for m, n in zip(MODES, ("dropped", "tagged", "downweighted", "redacted"), strict=True)]
    return by.select("eval_source", "docs_checked", "docs_contaminated", rate.alias("contamination_rate"), *done)


def flagged_ids(flagged: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the ids of flagged documents as text, one per line."""
    flagged.select(F.col(id_col).cast("string")).write.mode("overwrite").text(path)


def contains_item(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 8) -> DataFrame:
    """``doc, item`` where the normalized text of the item stands in that of the document, word for word.

    Candidates share the item's first ``n`` words; only they are searched.
    """
    d = docs.select(id_col, F.explode(F.array_distinct(ngram_hashes(_tokens(text), n))).alias("g"))
    first = F.element_at(ngram_hashes(_tokens(item_text), n), 1)
    padded = lambda c: F.concat(F.lit(" "), F.array_join(_tokens(c), " "), F.lit(" "))
    i = items.where(F.size(_tokens(item_text)) >= n).select(F.col(item), padded(item_text).alias("_item"), first.alias("g"))
    met = d.join(i, "g").drop("g")
    bodies = docs.join(met.select(id_col).distinct(), id_col, "left_semi").select(id_col, padded(text).alias("_body"))
    return met.join(bodies, id_col).where(F.contains("_body", "_item")).select(id_col, item).distinct()
