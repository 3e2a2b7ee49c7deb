"""Curation policies: their schema, hashes and files, and the plan that carries one out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks import storage
from loamworks.operators import annotate, budget, dedup, masking, minhash, quality, semantic, slices
from loamworks.operators import decontam as decon
from loamworks.session import materialize


# Names and defaults of the fields, so that policies of other tools can be read. The one difference: no targets are named by default.


@dataclass
class QualityPolicy:
    min_words: int = 50
    max_words: int = 100_000
    min_avg_word_length: float = 3.0
    max_word_rep_ratio: float = 0.2
    min_alpha_ratio: float = 0.6
    enabled_rules: list[str] = field(default_factory=lambda: ["word_rep", "min_words", "max_words", "alpha_ratio"])


@dataclass
class DedupPolicy:
    method: str = "minhash"
    scope: str = "per_dump"
    ngram_size: int = 5
    num_bands: int = 14
    rows_per_band: int = 8
    keep_rule: str = "first"


@dataclass
class DecontamPolicy:
    enabled: bool = True
    mode: str = "drop"
    ngram_size: int = 13
    overlap_threshold: float = 0.8
    targets: list[str] = field(default_factory=list)


@dataclass
class Policy:
    name: str
    version: str = "1.0"
    input_source: str = ""
    input_config: dict = field(default_factory=dict)
    language: str = "en"
    min_language_score: float = 0.65
    quality: QualityPolicy = field(default_factory=QualityPolicy)
    dedup: DedupPolicy = field(default_factory=DedupPolicy)
    decontam: DecontamPolicy = field(default_factory=DecontamPolicy)
    slice_weights: dict[str, float] = field(default_factory=dict)
    max_tokens: int = 10_000_000_000
    max_tokens_per_slice: dict[str, int] = field(default_factory=dict)
    seed: int = 42

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> Policy:
        """Missing fields get their defaults; unknown ones are an error."""
        return _build(cls, data)

    def digest(self) -> str:
        """Hash of the policy's content, whatever the order of its keys; 16 digits."""
        return hashlib.sha256(canonical(self.to_dict()).encode()).hexdigest()[:16]


def _build(kind, data: dict):
    known = {f.name: f for f in fields(kind)}
    if extra := set(data) - set(known):
        raise ValueError(f"unknown fields: {sorted(extra)}")
    nested = {"quality": QualityPolicy, "dedup": DedupPolicy, "decontam": DecontamPolicy}
    return kind(**{k: _build(nested[k], v) if k in nested and kind is Policy and not is_dataclass(v) else v for k, v in data.items()})


def canonical(data: dict) -> str:
    return json.dumps(data, sort_keys=True, separators=(",", ":"))


def same_policy(a: Policy, b: Policy) -> bool:
    return a.digest() == b.digest()


def reproducibility_key(policy: Policy, input_signature: str, code_version: str) -> str:
    return hashlib.sha256(f"{policy.digest()}:{input_signature}:{code_version}".encode()).hexdigest()[:16]


def save_policy(policy: Policy, path: str) -> None:
    import yaml

    storage.write_text(path, yaml.safe_dump(policy.to_dict(), sort_keys=True))


def load_policy(path: str) -> Policy:
    import yaml

    return Policy.from_dict(yaml.safe_load(storage.read_text(path)))


@dataclass
class Curated:
    """The outcome of a policy: documents kept, and ids and figures of all documents that statistics count, with what became of them."""

    documents: DataFrame
    marked: DataFrame

    def slice_stats(self) -> DataFrame:
        return slices.slice_stats(self.marked)

    def total_stats(self) -> DataFrame:
        return slices.total_stats(self.marked)


def quality_config(p: QualityPolicy) -> quality.QualityConfig:
    return quality.QualityConfig(
        max_word_rep=p.max_word_rep_ratio, min_words=p.min_words, max_words=p.max_words, min_avg_word_length=p.min_avg_word_length,
        min_alpha_ratio=p.min_alpha_ratio, rules=tuple(p.enabled_rules),
    )


def annotated(docs: DataFrame, policy: Policy, language: Callable[[Column], Column] = annotate.stop_word_language, tokens: Callable[[Column], Column] = annotate.word_count) -> DataFrame:
    """The stages that look at one document at a time: language, tokens, quality, masks and slices."""
    known = {"language", "language_score"} <= set(docs.columns)
    out = annotate.language_filter(docs if known else annotate.with_language(docs, language), policy.language, policy.min_language_score)
    out = annotate.with_token_count(out, tokens)
    config = quality_config(policy.quality)
    out = quality.quality_filter(out, config).withColumn("mean_quality", quality.mean_quality(rules=config.rules))
    return slices.assign_slices(masking.mask_addresses(out))


def held_out(c: DecontamPolicy, evaluation: DataFrame | None) -> DataFrame:
    """The evaluation items that a policy decontaminates against."""
    if evaluation is None:
        raise ValueError("decontamination is enabled but there is no evaluation table; give one or set decontam.enabled to false")
    source, targets = F.lower(F.trim("source")), sorted({t.strip().lower() for t in c.targets})
    items = evaluation.where(source.isin(*targets)) if targets else evaluation
    if items.isEmpty():
        raise ValueError(f"the evaluation table has no items{f' of {targets}' if targets else ''}")
    if missing := set(targets) - {r["s"] for r in items.select(source.alias("s")).distinct().collect()}:
        raise ValueError(f"the evaluation table has no items of {sorted(missing)}")
    return items


def _marks(rows: DataFrame, d: DedupPolicy, order: str, seed: int, embeddings: DataFrame | None) -> DataFrame:
    """order, dedup_scope, dedup_cluster_id, dedup_dropped by the method, where the first document of a cluster stays."""
    if d.method == "exact":
        marks = dedup.mark_exact(rows.select(order, "dump", "text"), order, d.scope)
    elif d.method == "minhash":
        marks = minhash.minhash_marks(rows.select(order, "dump", "text"), order, d.scope, minhash.MinHashConfig(d.ngram_size, d.num_bands, d.rows_per_band, seed))
    elif d.method == "semantic":
        if embeddings is None:
            raise ValueError("semantic deduplication needs embeddings")
        found = semantic.semantic_marks(embeddings.join(rows.select(order, "dump"), order), order, d.scope)
        # documents without an embedding are like no other
        scoped = dedup.with_scope(rows.select(order, "dump"), d.scope).join(found.drop("dedup_scope"), order, "left")
        marks = scoped.withColumns({"dedup_dropped": F.coalesce("dedup_dropped", F.lit(False)), "dedup_cluster_id": F.coalesce("dedup_cluster_id", F.col(order).cast("string"))})
    else:
        raise ValueError(f"unknown method: {d.method}")
    return marks.select(order, "dedup_scope", F.col("dedup_cluster_id").cast("string").alias("dedup_cluster_id"), "dedup_dropped")


def execute(docs: DataFrame, policy: Policy, evaluation: DataFrame | None = None, order: str = "doc_id", embeddings: DataFrame | None = None, **scorers) -> Curated:
    """Carry out a policy: filter, annotate, deduplicate, decontaminate, and cut to the budget and the caps.

    ``evaluation``: item_id, source, text of held-out material; only the policy's targets count, if it names any (any case).
    If decontamination is enabled, it is an error if there is none, or none of one of the targets. A keep rule other than ``first``
    chooses one document of each cluster of a scope. Statistics count documents that deduplication or decontamination dropped, up to the
    document that ends the budget. ``embeddings``: order and ``embedding``.

    Filtered texts are written once. All decisions are made on ids, hashes and counts; the texts of the documents kept are joined at the end.
    """
    items = held_out(policy.decontam, evaluation) if policy.decontam.enabled else None
    if policy.dedup.keep_rule not in dedup.KEEP_RULES:
        raise ValueError(f"unknown keep rule: {policy.dedup.keep_rule}")
    docs = docs if "dump" in docs.columns else docs.withColumn("dump", F.lit(None).cast("string"))
    rows = materialize(annotated(docs.drop("dedup_scope", "dedup_cluster_id", "dedup_dropped", "dedup_method", "decontam_dropped"), policy, **scorers))
    d, c = policy.dedup, policy.decontam
    marks = _marks(rows, d, order, policy.seed, embeddings)
    if d.keep_rule != "first":
        score = rows.select(order, dedup.keep_score(d.keep_rule, rows.columns).alias("_score"))
        best = dedup.keep_one(marks.join(score, order), d.keep_rule, order=order, score=F.col("_score"), scope="dedup_scope").select(order).withColumn("_best", F.lit(True))
        marks = marks.join(best, order, "left").withColumn("dedup_dropped", F.col("_best").isNull()).drop("_best")
    marks = materialize(marks)

    config = decon.DecontamConfig(c.ngram_size, c.overlap_threshold, c.mode)
    flagged = None
    if items is not None:
        left = rows.select(order, "text").join(marks.where("dedup_dropped").select(order), order, "left_anti")
        flagged = materialize(decon.overlaps(left, decon.build_index(items, config), config, order).where(F.col("overlap_score") >= c.overlap_threshold))
    slim = rows.select(order, "token_count", "slice_tags", "mean_quality").join(marks, order).withColumn("dedup_method", F.lit(d.method))
    if flagged is not None and c.mode == "drop":
        slim = slim.join(flagged.select(order).withColumn("_hit", F.lit(True)), order, "left").withColumn("decontam_dropped", F.coalesce("_hit", F.lit(False))).drop("_hit")
    else:
        slim = slim.withColumn("decontam_dropped", F.lit(False))
    slim = materialize(slim)

    live = slim.where("NOT dedup_dropped AND NOT decontam_dropped")
    chosen, end = budget.selection(live, policy.max_tokens, policy.max_tokens_per_slice, order)
    kept, dropped = live.where(chosen), slim.where("dedup_dropped OR decontam_dropped")
    if end is not None:
        dropped = dropped.where(F.col(order) < F.lit(end))
    documents = rows.join(kept.drop("token_count", "slice_tags", "mean_quality"), order)
    if flagged is not None and c.mode != "drop":
        documents = decon.with_flags(documents, flagged, config, order)
    return Curated(documents, kept.unionByName(dropped))


def sampled(curated: Curated, policy: Policy, n: int, order: str = "doc_id") -> DataFrame:
    """Draw ``n`` of the documents kept by the policy's slice weights."""
    return budget.weighted_sample(curated.documents, n, policy.slice_weights, seed=policy.seed, id_col=order)


def dry_run(docs: DataFrame, policy: Policy, n: int = 1000, order: str = "doc_id", **scorers) -> DataFrame:
    """Estimate from the first ``n`` documents: how many pass each stage, the share retained, mean tokens, projected documents.

    ``projected_tokens`` is the retained share of the budget over the mean number of tokens, which is a number of documents.
    """
    first = docs.orderBy(order).limit(n)
    language = scorers.get("language", annotate.stop_word_language)
    known = {"language", "language_score"} <= set(docs.columns)
    rows = annotate.with_token_count(first if known else annotate.with_language(first, language), scorers.get("tokens", annotate.word_count))
    rows = quality.with_quality(rows, quality_config(policy.quality))
    spoken = F.col("language").eqNullSafe(F.lit(policy.language)) & (F.coalesce("language_score", F.lit(0.0)) >= policy.min_language_score)
    good = spoken & (F.size("quality_failed") == 0)
    out = rows.agg(F.count("*").alias("docs"), F.count_if(spoken).alias("after_language"), F.count_if(good).alias("after_quality"), F.avg(F.when(good, F.col("token_count"))).alias("mean_tokens"))
    share = F.when(F.col("docs") > 0, F.col("after_quality") / F.col("docs")).otherwise(0.0)
    return out.withColumn("retention", F.round(share, 4)).withColumn("projected_tokens", F.when(F.col("mean_tokens") > 0, F.floor(share * policy.max_tokens / F.col("mean_tokens"))).otherwise(0))
