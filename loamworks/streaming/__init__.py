"""Streaming forms of the operators that need no global order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.functions.text import content_hash
from loamworks.operators import decontam, minhash, slices


def stream_exact_dedup(docs: DataFrame, time: str = "crawled_at", delay: str = "1 hour", text: str = "text") -> DataFrame:
    """Drop texts seen before within the watermark; state is one hash per text until the watermark passes it."""
    hashed = docs.withColumn("content_hash", content_hash(F.coalesce(F.col(text), F.lit(""))))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def stream_slice_stats(docs: DataFrame) -> DataFrame:
    """Running statistics per slice tag, for output mode ``update`` or ``complete``."""
    return slices.slice_stats(docs)


def stream_decontaminate(docs: DataFrame, index: DataFrame, config: decontam.DecontamConfig = decontam.DecontamConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep documents of a micro-batch whose overlap with a static index stays below the threshold.

    Each document is decided on its own rows, so no state is kept between batches. For use inside ``foreachBatch``
    (``curate_stream``): the overlap is an aggregate per document, which an append-mode stream cannot give.
    """
    if docs.isStreaming:
        raise ValueError("apply this to the batches of foreachBatch")
    hit = decontam.overlaps(docs, index, config, id_col, text).where(F.col("overlap_score") >= config.threshold)
    return docs.join(hit.select(id_col), id_col, "left_anti")


def stream_within_caps(docs: DataFrame, key: str, cap: int, id_col: str = "doc_id", tokens: str = "token_count") -> DataFrame:
    """``key, id, tokens, tokens_before`` of the documents of each key, in the order of their arrival, while the total before them is below ``cap``.

    The one that reaches the cap is the last. State is one number for each key; the documents of a micro-batch come in the order of their ids.
    """
    import pandas as pd

    kinds = dict(docs.dtypes)

    def run(group, frames, state):
        total = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(id_col)
        n = rows[tokens].fillna(0).astype("int64")
        before = total + n.cumsum() - n
        ok = before < cap
        state.update((int(total + n[ok].sum()),))
        yield pd.DataFrame({key: group[0], id_col: rows[id_col][ok], tokens: n[ok], "tokens_before": before[ok]})

    slim = docs.select(key, id_col, tokens)
    return slim.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, {tokens} bigint, tokens_before bigint", "total bigint", "append", "NoTimeout")


def stream_minhash_dedup(docs: DataFrame, store: str, sink, config: minhash.MinHashConfig = minhash.MinHashConfig(), order: str = "doc_id", text: str = "text"):
    """A writer that drops documents which share a MinHash band with one that came before, dropped or not; ``sink(batch, epoch)`` stores the rest.

    The bands seen are kept as Parquet under ``store``, a folder for each micro-batch, so a batch that is tried again meets only those before it.
    Within a batch documents come in their order.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        path = f"{store}/epoch={epoch}"
        minhash.band_hashes(batch, order, config, text).write.mode("overwrite").parquet(path)
        bands = spark.read.parquet(path)
        first = bands.groupBy("band", "band_hash").agg(F.min(order).alias("_first"))
        late = bands.join(first, ["band", "band_hash"]).where(F.col(order) > F.col("_first")).select(order)
        if epoch:
            seen = spark.read.option("basePath", store).parquet(store).where(F.col("epoch") < epoch).select("band", "band_hash")
            late = late.union(bands.join(seen, ["band", "band_hash"], "left_semi").select(order))
        sink(batch.join(late.distinct(), order, "left_anti"), epoch)

    return docs.writeStream.foreachBatch(run)


def windowed_tokens(docs: DataFrame, time: str = "crawled_at", width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Documents and tokens per window of event time and source, late rows up to the watermark."""
    return docs.withWatermark(time, delay).groupBy(F.window(time, width), "source").agg(F.count("*").alias("n_docs"), F.sum("token_count").alias("n_tokens"))


def curate_stream(docs: DataFrame, index: DataFrame, sink, config: decontam.DecontamConfig = decontam.DecontamConfig(), time: str = "crawled_at", delay: str = "1 hour"):
    """A writer that deduplicates a stream and decontaminates each micro-batch; ``sink(batch, epoch)`` stores it, idempotent by epoch."""
    clean = stream_exact_dedup(docs, time, delay)
    return clean.writeStream.foreachBatch(lambda batch, epoch: sink(stream_decontaminate(batch, index, config), epoch))
