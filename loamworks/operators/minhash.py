"""Near-duplicate removal by MinHash bands, with the rule that an earlier document in any shared band drops a later one.

Signatures are built for whole batches at once: mixed 64-bit hashes of all character runs, for each signature value one multiplication by an odd
number modulo 2^64 and the least result of each document. Bands meet by aggregation, not by pairs: a band shared by a third of all documents costs one row each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.operators.components import follow_parents
from loamworks.operators.dedup import with_scope
from loamworks.session import materialize

@dataclass(frozen=True)
class MinHashConfig:
    chars: int = 5
    bands: int = 14
    rows: int = 8
    seed: int = 42


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (the splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(texts: list[str | None], config: MinHashConfig, most: int = 200_000) -> np.ndarray:
    """One row per text with ``bands * rows`` values. Runs of ``chars`` characters of the lower-cased text; a shorter text is one run, a null one an empty text.

    Texts are hashed in groups of about ``most`` characters, longer ones in parts, so that arrays stay in the cache.
    """
    n, k = max(1, config.chars), config.bands * config.rows
    rng = np.random.default_rng(config.seed)
    factors, shifts = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)
    out = np.full((len(texts), k), np.iinfo(np.uint64).max, np.uint64)
    group: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        points = np.frombuffer("".join(t for _, t in group).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        length = np.array([len(t) for _, t in group])
        ends = np.cumsum(length)
        hashes = np.zeros(len(points) - n + 1, np.uint64)
        for j in range(n):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + points[j : len(points) - n + 1 + j]
        whole = np.ones(len(hashes), bool)
        cut = (ends[:-1, None] - np.arange(1, n)[None, :]).ravel()
        whole[cut[cut < len(whole)]] = False
        hashes = _mix(hashes[whole])
        starts = np.concatenate([[0], np.cumsum(length - n + 1)[:-1]])
        owner = np.array([i for i, _ in group])
        for j in range(k):
            least = np.minimum.reduceat(hashes * factors[j] + shifts[j], starts)
            np.minimum.at(out[:, j], owner, least)

    for i, t in enumerate(texts):
        t = (t or "").lower().ljust(n, "\0")
        for at in range(0, max(1, len(t) - n + 1), most):
            part = t[at : at + most + n - 1]
            group.append((i, part))
            size += len(part)
            if size >= most:
                flush()
                group, size = [], 0
    if group:
        flush()
    return out


def band_hashes(df: DataFrame, order: str, config: MinHashConfig = MinHashConfig(), text: str = "text") -> DataFrame:
    """``order, band, band_hash``: one row per document and band, next to ``dedup_scope`` if there is one."""
    keep = [order] + ["dedup_scope"] * ("dedup_scope" in df.columns)
    mixers = np.random.default_rng([config.seed, 1]).integers(0, 2**63, config.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(len(keep)).to_pylist()
                found = signatures(texts, config).reshape(len(texts), config.bands, config.rows)
                out = _mix((found * mixers).sum(axis=2, dtype=np.uint64))
                index = pa.array(np.repeat(np.arange(len(texts)), config.bands))
                columns = [part.column(j).take(index) for j in range(len(keep))]
                columns += [pa.array(np.tile(np.arange(config.bands, dtype=np.int32), len(texts))), pa.array(out.ravel().view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "band", "band_hash"])

    wanted = df.select(*keep, F.col(text).alias("_text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1]]
    return wanted.mapInArrow(run, ", ".join([*kinds, "band int", "band_hash bigint"]))


def minhash_marks(df: DataFrame, order: str = "doc_id", scope: str = "global", config: MinHashConfig = MinHashConfig(), text: str = "text", dump: str = "dump") -> DataFrame:
    """``order, dedup_scope, dedup_dropped, dedup_cluster_id``: the rule's outcome for each document.

    A document is dropped if an earlier one of its scope, kept or not, shares a band. Its cluster is that of the earliest
    document in its lowest shared band; a document that shares none is its own cluster.
    """
    scoped = with_scope(df, scope, dump)
    bands = materialize(band_hashes(scoped, order, config, text))
    first = bands.groupBy("dedup_scope", "band", "band_hash").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    # buckets of one document drop nobody
    shared = first.where("_n > 1").drop("_n")
    met = bands.join(shared, ["dedup_scope", "band", "band_hash"]).where(F.col("_first") < F.col(order))
    parent = met.groupBy(order).agg(F.min_by("_first", "band").alias("parent"))
    roots = follow_parents(parent.select(F.col(order).alias("node"), "parent"))
    ids = scoped.select(order, "dedup_scope")
    out = ids.join(roots.select(F.col("node").alias(order), "root"), order, "left")
    return out.select(order, "dedup_scope", F.col("root").isNotNull().alias("dedup_dropped"), F.coalesce("root", order).alias("dedup_cluster_id"))


def minhash_dedup(df: DataFrame, order: str = "doc_id", scope: str = "global", config: MinHashConfig = MinHashConfig(), text: str = "text", dump: str = "dump") -> DataFrame:
    """Keep the documents that no earlier one drops."""
    kept = minhash_marks(df, order, scope, config, text, dump).where("NOT dedup_dropped").select(order, "dedup_cluster_id")
    return df.drop("dedup_cluster_id", "dedup_method").join(kept, order).withColumn("dedup_method", F.lit("minhash"))
