"""Duplicates by similarity of embeddings or of word shingles, with the greedy rule of keeping the earliest.

The greedy rule, a document is dropped if it is similar to an earlier kept one, is decided on the edges alone: a document
is kept once all its earlier neighbours are dropped, and dropped once one of them is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.functions.text import ngram_hashes, words
from loamworks.operators.dedup import with_scope
from loamworks.operators.setjoin import distinct_sets
from loamworks.operators.similar_sets import JoinConfig, SetKind, similar_sets
from loamworks.session import materialize

#: Shingles that a task turns into sets at a time.
_MOST_HASHES = 2_000_000


def greedy_keep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, kept``. ``nodes``: node; ``edges``: a < b.

    Each round settles at least the earliest open node of every chain, so it ends; edges of settled later nodes are set aside, so
    the work of a round shrinks with what is left. There are as many rounds as the longest chain of documents that depend on each other.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    all_nodes = nodes.select("node").distinct()
    # nodes without an earlier neighbour are kept
    later = edges.select(F.col("b").alias("node")).distinct()
    known = all_nodes.union(edges.select("a")).distinct()
    settled = materialize(known.join(later, "node", "left_anti").withColumn("kept", F.lit(True)))
    done, live = [settled], edges
    while not live.isEmpty():
        told = live.join(settled.select(F.col("node").alias("a"), F.col("kept").alias("_k")), "a", "left")
        votes = told.groupBy(F.col("b").alias("node")).agg(F.max(F.coalesce("_k", F.lit(False))).alias("hit"), F.count_if(F.col("_k").isNull()).alias("open"))
        settled = materialize(votes.where("hit OR open = 0").select("node", (~F.col("hit")).alias("kept")))
        # an edge whose earlier node is settled, or whose later node is, says nothing more
        live = materialize(told.where("_k IS NULL").join(settled.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))
        done.append(settled)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return materialize(all_nodes.join(out, "node", "left").select("node", F.coalesce("kept", F.lit(True)).alias("kept")))


def greedy_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, kept, cluster``: a kept node is its own cluster, a dropped one belongs to its earliest kept neighbour."""
    state = greedy_keep(nodes, edges)
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("node"))
    near = ends.join(state.where("kept").select(F.col("node").alias("a")), "a").groupBy("node").agg(F.min("a").alias("_first"))
    out = state.join(near, "node", "left")
    return out.select("node", "kept", F.when(F.col("kept"), F.col("node")).otherwise(F.col("_first")).alias("cluster"))


def similar_embeddings(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", block_rows: int = 4000) -> DataFrame:
    """``a, b, cosine`` of all pairs at or above the threshold, exactly.

    Rows are dealt into blocks of about ``block_rows`` by a hash of their id; each pair of blocks is compared once, as one
    product of matrices, so a task holds two blocks however many rows there are.
    The work is quadratic in the number of rows, which is what exactness costs; ``hyperplane_candidates`` avoids it.
    Null vectors and vectors of length zero are similar to nothing.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(8, -(-df.count() // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least("block", k).alias("x"), F.greatest("block", k).alias("y")))
    dealt = rows.select("id", "v", "block", F.explode(mates).alias("pair")).select("id", "v", "block", "pair.x", "pair.y")

    def compare(key, batch):
        x, y = key[0].as_py(), key[1].as_py()
        ids, block = batch.column("id").to_numpy(), batch.column("block").to_numpy()
        v = np.array(batch.column("v").to_pylist(), float) if len(ids) else np.empty((0, 1))
        norm = np.linalg.norm(v, axis=1)
        ok = norm > 0
        ids, block, v = ids[ok], block[ok], v[ok] / norm[ok, None]
        left, right = block == x, block == y
        sim = v[left] @ v[right].T
        i, j = np.nonzero(sim >= threshold - 1e-12)
        a, b, s = ids[left][i], ids[right][j], sim[i, j]
        once = (a < b) if x == y else (a != b)
        return pa.table({"a": np.minimum(a, b)[once], "b": np.maximum(a, b)[once], "cosine": s[once]})

    return dealt.groupBy("x", "y").applyInArrow(compare, "a bigint, b bigint, cosine double")


def index_size(rows: int, threshold: float, recall: float = 0.99, bits: int | None = None) -> tuple[int, int]:
    """Tables and bits of a hyperplane index that finds a pair exactly at ``threshold`` with a chance of ``recall`` at least.

    Two vectors at an angle lie on the same side of a plane with chance ``1 - angle / pi``, so of t tables of b bits one holds them
    together with chance ``1 - (1 - side ** b) ** t``. Of the sizes that reach the recall, the one with the least work is taken:
    a copy of a row in a table counts as 200 comparisons, strangers meet in one of ``2 ** bits`` buckets.
    """
    side = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi

    def needed(b: int) -> int:
        met = side**b
        return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log1p(-met))

    if not 0 < recall < 1 or not side > 0:
        raise ValueError(f"no index has a recall of {recall} at a cosine of {threshold}")
    sizes = [(needed(b), b) for b in ([bits] if bits else range(1, 21)) if side**b > 1e-12]
    if not sizes:
        raise ValueError(f"{bits} bits are too many for a cosine of {threshold}")
    return min(sizes, key=lambda x: x[0] * (200 + rows / 2 ** x[1]))


def hyperplane_candidates(
    df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", tables: int | None = None, bits: int | None = None, seed: int = 42, most: int = 1000, recall: float = 0.99
) -> DataFrame:
    """``a, b, cosine`` at or above the threshold among vectors that share a bucket of random hyperplanes in some table.

    An index for collections too large for all pairs: every row is indexed. Tables and bits follow from the threshold, so that
    a pair exactly at it is found with a chance of ``recall`` and closer ones with a higher one (``index_size``); ``tables`` given as
    a number is used as it is. Buckets of more than ``most`` rows are split further by ``most``-sized exact blocks, so no bucket is skipped.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    if tables is None:
        tables, bits = index_size(rows.count(), threshold, recall, bits)
    elif bits is None:
        bits = 12
    rng_seed = seed

    def sign(batches):
        planes = None
        for whole in batches:
            # signs of some four million planes at a time
            for at in range(0, len(whole), step := max(1, 4_000_000 // (tables * bits))):
                batch = whole.slice(at, step)
                v = np.array(batch.column(1).to_pylist(), float)
                if planes is None:
                    planes = np.random.default_rng(rng_seed).standard_normal((v.shape[1], tables * bits))
                code = ((v @ planes > 0).reshape(len(v), tables, bits) * (1 << np.arange(bits))).sum(axis=2)
                index = pa.array(np.repeat(np.arange(len(v)), tables))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(index), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(v))), pa.array(code.ravel().astype(np.int64))], names=["id", "t", "code"]
                )

    signed = rows.mapInArrow(sign, "id bigint, t int, code bigint")
    sizes = signed.groupBy("t", "code").agg(F.count("*").alias("n")).where("n > 1")
    cells = signed.join(sizes, ["t", "code"]).withColumn("parts", F.ceil(F.col("n") / most).cast("int")).withColumn("part", F.pmod(F.xxhash64("id", "t"), F.col("parts")).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("part", k).alias("x"), F.greatest("part", k).alias("y")))
    dealt = cells.select("id", "t", "code", F.explode(mates).alias("p")).select("id", "t", "code", "p.*").join(rows, "id")

    def compare(key, batch):
        ids, v = batch.column("id").to_numpy(), np.array(batch.column("v").to_pylist(), float)
        norm = np.linalg.norm(v, axis=1)
        ok = norm > 0
        ids, v = ids[ok], v[ok] / norm[ok, None]
        sim = v @ v.T
        i, j = np.nonzero(np.triu(sim >= threshold - 1e-12, 1))
        return pa.table({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "cosine": sim[i, j]})

    found = dealt.groupBy("t", "code", "x", "y").applyInArrow(compare, "a bigint, b bigint, cosine double")
    return found.where("a <> b").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def semantic_pairs(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", exact: bool | None = None, most_exact: int = 200_000) -> DataFrame:
    """``a, b, cosine``: by the index, or with ``exact`` by all pairs. Without a choice all pairs are compared up to ``most_exact`` rows, where that is cheap."""
    if exact is None:
        exact = df.count() <= most_exact
    return similar_embeddings(df, threshold, id_col, vector) if exact else hyperplane_candidates(df, threshold, id_col, vector)


def semantic_dedup(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", exact: bool | None = None) -> DataFrame:
    """``node, kept`` by the greedy rule over cosine similarity."""
    return greedy_keep(df.select(F.col(id_col).cast("bigint").alias("node")), semantic_pairs(df, threshold, id_col, vector, exact))


def semantic_marks(df: DataFrame, order: str, scope: str = "global", threshold: float = 0.9, vector: str = "embedding", dump: str = "dump", exact: bool | None = None) -> DataFrame:
    """``order, dedup_scope, dedup_dropped, dedup_cluster_id`` of rows with an embedding; a row is only like rows of its scope."""
    scoped = with_scope(df, scope, dump).select(order, "dedup_scope", vector)
    pairs = semantic_pairs(scoped, threshold, order, vector, exact)
    if scope != "global":
        of = lambda end: scoped.select(F.col(order).alias(end), F.col("dedup_scope").alias(f"s{end}"))
        pairs = pairs.join(of("a"), "a").join(of("b"), "b").where("sa = sb").select("a", "b")
    found = greedy_clusters(scoped.select(F.col(order).alias("node")), materialize(pairs.select("a", "b")))
    out = scoped.select(order, "dedup_scope").join(found.withColumnRenamed("node", order), order)
    return out.select(order, "dedup_scope", (~F.col("kept")).alias("dedup_dropped"), F.col("cluster").cast("string").alias("dedup_cluster_id"))


def shingle_links(df: DataFrame, threshold: float = 0.8, n: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``a, b`` of documents whose sets of word shingles have a Jaccard similarity of at least ``threshold``; copies of a set are linked to its first document, which stands for them."""
    links, copies = _shingle_links(df, threshold, n, id_col, text)
    return links.union(copies)


def _shingle_links(df: DataFrame, threshold: float, n: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Links between the first documents of different sets, and of each copy to the first document of its set."""
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    classes, links = similar_sets(texts, _shingles(n), JoinConfig(threshold))
    copies = classes.where("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    return links.where("class_a < class_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), copies


def _shingles(n: int) -> SetKind:
    """Runs of ``n`` words; a text of fewer words is one run."""

    def hashed(texts: DataFrame) -> DataFrame:
        return texts.select("doc_id", ngram_hashes(words(F.lower(F.coalesce("text", F.lit("")))), n).alias("s"))

    def sets(batches, rows):
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            hashes = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(ids):
                # a larger set is alone
                end = int(np.searchsorted(ends, ends[at] - lengths[at] + _MOST_HASHES, side="right"))
                end = min(max(end, at + 1), at + rows, len(ids))
                part = hashes[ends[at] - lengths[at] : ends[end - 1]]
                yield ids[at:end], *distinct_sets(np.repeat(np.arange(end - at), lengths[at:end]), part, end - at)
                at = end

    return SetKind(hashed, sets)


def shingle_dedup(df: DataFrame, threshold: float = 0.8, n: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``node, kept`` by the greedy rule over shingle similarity.

    A copy is dropped in any case: by the first document of its set, or by what dropped that one.
    """
    links, copies = _shingle_links(df, threshold, n, id_col, text)
    later = copies.select(F.col("b").alias("node"))
    nodes = df.select(F.col(id_col).cast("bigint").alias("node"))
    return greedy_keep(nodes.join(later, "node", "left_anti"), links).unionByName(later.withColumn("kept", F.lit(False)))
