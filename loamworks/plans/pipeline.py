"""Pipelines from configuration: named blocks that each turn one data frame into another."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.operators import annotate, budget, decontam, dedup, masking, minhash, quality, semantic, slices, urls

TYPES = ("reader", "filter", "mapper", "dedup", "decontam", "writer", "stats")
Block = Callable[..., DataFrame]


class Registry:
    """Blocks by type and name."""

    def __init__(self) -> None:
        self.blocks: dict[tuple[str, str], Block] = {}

    def register(self, kind: str, name: str, block: Block) -> None:
        if kind not in TYPES:
            raise ValueError(f"unknown block type: {kind}")
        self.blocks[kind, name] = block

    def get(self, kind: str, name: str) -> Block:
        if kind not in TYPES:
            raise ValueError(f"unknown block type: {kind}")
        if (kind, name) not in self.blocks:
            raise ValueError(f"unknown {kind}: {name}")
        return self.blocks[kind, name]


def _read(fmt: str) -> Block:
    def block(spark: SparkSession, **params) -> DataFrame:
        from loamworks.sources.tables import read_documents

        return read_documents(spark, fmt=fmt, **params)

    return block


def _warc(spark: SparkSession, **params) -> DataFrame:
    from loamworks.sources.warc import read_warc

    return read_warc(spark, **params)


def _write(df: DataFrame, **params) -> DataFrame:
    from loamworks.sources.tables import write_shards

    write_shards(df, **params)
    return df


def _table(df: DataFrame, given: DataFrame | str) -> DataFrame:
    return df.sparkSession.read.parquet(given) if isinstance(given, str) else given


def _semantic(df: DataFrame, embeddings: DataFrame | str, id_col: str = "doc_id", embedding_id: str | None = None, **params) -> DataFrame:
    """``embeddings``: a data frame or the path of a Parquet table. Documents without an embedding are kept."""
    rows = _table(df, embeddings).withColumnRenamed(embedding_id or id_col, id_col).join(df.select(id_col), id_col, "left_semi")
    dropped = semantic.semantic_dedup(rows, id_col=id_col, **params).where("NOT kept").select(F.col("node").alias(id_col))
    return df.join(dropped, id_col, "left_anti")


def _ngram_overlap(df: DataFrame, index: DataFrame | str | None = None, evaluation: DataFrame | str | None = None, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``index``: gram, eval_source, or ``evaluation``: item_id, source, text; data frames or paths of Parquet tables."""
    config = decontam.DecontamConfig(**params)
    if (index is None) == (evaluation is None):
        raise ValueError("decontam needs either an index or an evaluation table")
    grams = _table(df, index) if index is not None else decontam.build_index(_table(df, evaluation), config)
    return decontam.decontaminate(df, grams, config, id_col, text)


def _extract_text(df: DataFrame, html: str = "html", **params) -> DataFrame:
    from loamworks.sources.html import extract_text

    return extract_text(df, html, **params)


def default_registry() -> Registry:
    r = Registry()
    for fmt in ("parquet", "json", "csv", "orc", "text"):
        r.register("reader", {"json": "jsonl"}.get(fmt, fmt), _read(fmt))
    r.register("reader", "commoncrawl", _warc)
    r.register("filter", "language", annotate.language_filter)
    r.register("filter", "quality", lambda df, **p: quality.quality_filter(df, quality.QualityConfig(**p)))
    r.register("filter", "length", quality.length_filter)
    r.register("filter", "url", urls.url_filter)
    r.register("filter", "label_quality", quality.label_quality_filter)
    r.register("mapper", "language", annotate.with_language)
    r.register("mapper", "token_count", annotate.with_token_count)
    r.register("mapper", "pii_mask", masking.mask_addresses)
    r.register("mapper", "slices", slices.assign_slices)
    r.register("mapper", "extract_text", _extract_text)
    r.register("dedup", "exact", dedup.exact_dedup)
    r.register("dedup", "minhash", minhash.minhash_dedup)
    r.register("dedup", "semantic", _semantic)
    r.register("decontam", "ngram_overlap", _ngram_overlap)
    r.register("stats", "slices", lambda df: slices.slice_stats(df))
    r.register("writer", "jsonl", _write)
    r.register("filter", "budget", budget.within_budget)
    return r


def validate(config: dict, registry: Registry | None = None) -> list[dict]:
    """The blocks of ``{pipeline: {blocks: [{type, name, params}]}}``; wrong keys, types and names are errors."""
    registry = registry or default_registry()
    blocks = config.get("pipeline", {}).get("blocks") if isinstance(config.get("pipeline"), dict) else None
    if not isinstance(blocks, list):
        raise ValueError("pipeline.blocks is missing")
    for b in blocks:
        if not isinstance(b, dict) or not {"type", "name"} <= b.keys():
            raise ValueError(f"a block needs type and name: {b}")
        registry.get(b["type"], b["name"])
    return blocks


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def run_pipeline(spark: SparkSession, config: dict, df: DataFrame | None = None, registry: Registry | None = None) -> DataFrame:
    """Chain the blocks; the first reads, unless a data frame is given. Nothing runs before the result is used, but for writers and semantic deduplication."""
    registry = registry or default_registry()
    for b in validate(config, registry):
        block, params = registry.get(b["type"], b["name"]), b.get("params") or {}
        if b["type"] == "reader":
            new = block(spark, **params)
            df = new if df is None else df.unionByName(new, allowMissingColumns=True)
        elif df is None:
            raise ValueError("the first block must be a reader")
        else:
            df = block(df, **params)
    if df is None:
        raise ValueError("the pipeline has no blocks")
    return df


def run_shards(spark: SparkSession, shards: dict[str, str], transform: Callable[[DataFrame], DataFrame], out: str, fmt: str = "parquet") -> dict[str, str]:
    """Run a transform shard by shard (name to input path) and write each under ``out``; shards already written are left alone.

    Returns ``done``, ``skipped`` or ``failed: …`` by name. A shard counts as written once Spark has committed it, so an
    interrupted run may simply be started again.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    state = {}
    for name, path in shards.items():
        target = f"{out}/{name}"
        marker = hadoop(f"{target}/_SUCCESS")
        if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            state[name] = "skipped"
            continue
        try:
            transform(spark.read.format(fmt).load(path)).write.mode("overwrite").format(fmt).save(target)
            state[name] = "done"
        except Exception as e:
            state[name] = f"failed: {e.__class__.__name__}"
    return state
