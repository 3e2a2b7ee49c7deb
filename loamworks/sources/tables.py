"""Document readers and writers, shards and their manifest, block lists, caches, artifacts and logs."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks import storage
from loamworks.functions.text import words
from loamworks.operators.prefix import running_total, running_total_by_order
from loamworks.session import materialize


def with_row_index(df: DataFrame, name: str = "id") -> DataFrame:
    """Number the rows 0, 1, … in the order of partitions, without bringing them together."""
    kept = materialize(df.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    return running_total(kept, [], "_p", ["_m"], F.lit(1), name).withColumn(name, F.col(name).cast("bigint")).drop("_p", "_m")


def read_documents(
    spark: SparkSession, path: str, fmt: str = "parquet", text_field: str = "text", id_field: str | None = None, source: str | None = None, limit: int | None = None, schema: str | None = None
) -> DataFrame:
    """``id, text, source`` and the remaining columns of a Parquet, JSON lines, CSV, ORC or text dataset.

    Without ``id_field`` the id is the number of the row. ``limit`` 0 or None is no limit.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.format(fmt).load(path)
    df = df.limit(limit) if limit else df
    if id_field is None:
        df = with_row_index(df.drop("id") if "id" in df.columns else df, "id")
    elif id_field != "id":
        df = df.withColumnRenamed(id_field, "id")
    df = df.withColumn("id", F.col("id").cast("string"))
    if text_field != "text":
        df = df.drop("text").withColumnRenamed(text_field, "text") if "text" in df.columns else df.withColumnRenamed(text_field, "text")
    if source is not None:
        df = df.withColumn("source", F.lit(source))
    return df


def write_shards(df: DataFrame, path: str, per_shard: int = 10_000, fmt: str = "json", compression: str | None = None) -> None:
    """Write shards of at most ``per_shard`` documents. Files are committed whole, so a lost executor leaves no half shard."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", per_shard)
    if compression:
        writer = writer.option("compression", compression)
    writer.format(fmt).save(path)


def shard_manifest(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """``path, checksum, doc_count, size_bytes`` of each shard of a dataset."""
    rows = spark.read.format("text" if fmt == "json" else fmt).load(path)
    counts = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("doc_count"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select("path", F.sha2("content", 256).alias("checksum"), F.col("length").alias("size_bytes"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    joined = files.select(name(F.col("path")).alias("path"), "checksum", "size_bytes").join(counts.select(name(F.col("path")).alias("path"), "doc_count"), "path", "left")
    return joined.select("path", "checksum", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), "size_bytes")


def content_hash(spark: SparkSession, path: str, fmt: str = "json") -> str:
    """Hash of the ids and texts of a dataset's documents, whatever their order, shards and other columns."""
    rows = spark.read.schema("doc_id string, text string").json(path) if fmt == "json" else spark.read.format(fmt).load(path)
    one = F.sha2(F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "text")), 256)
    part = lambda k: F.sum(F.conv(F.substring(one, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = rows.agg(F.count("*").alias("n"), *[part(k).alias(f"s{k}") for k in range(4)]).first()
    return hashlib.sha256(":".join(map(str, sums)).encode()).hexdigest()


def make_manifest(dataset_id: str, shards: DataFrame, policy: dict | None = None, inputs: list | None = None, fmt: str = "jsonl", seed: int = 42, stats: dict | None = None, code: dict | None = None, content: str | None = None) -> dict:
    """The manifest of a dataset. There are as many shard rows as files."""
    from loamworks.plans.policy import canonical

    return {
        "dataset_id": dataset_id,
        "created_at": datetime.now(UTC).isoformat(),
        "input_sources": inputs or [],
        "policy_config": policy or {},
        "policy_config_hash": hashlib.sha256(canonical(policy or {}).encode()).hexdigest()[:16],
        "code": code or {},
        "random_seed": seed,
        "format": fmt,
        "shards": [r.asDict() for r in shards.orderBy("path").collect()],
        "stats": stats or {},
    } | ({"content_hash": content} if content else {})


def save_manifest(manifest: dict, path: str) -> None:
    storage.write_text(path, json.dumps(manifest, indent=2, sort_keys=True, default=str))


def load_manifest(path: str) -> dict:
    return json.loads(storage.read_text(path))


def read_manifest(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The documents of all shards of a saved manifest, which lies beside them."""
    base = path.rsplit("/", 1)[0]
    return spark.read.format(fmt).load([storage.join(base, s["path"]) for s in load_manifest(path)["shards"]])


def training_order(df: DataFrame, seed: int, key: str = "id", most_words: int | None = None, text: str = "text") -> DataFrame:
    """All documents with ``position``, their place in the order of md5 of ``seed:key``; with ``most_words`` also ``tokens``, the first words of the text.

    Places are running counts over ranges of the hash, so no task sorts everything.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    placed = running_total_by_order(df.select(h.alias("_h"), F.col(key)), ["_h", key], F.lit(1), "position").select(key, F.col("position").cast("bigint").alias("position"))
    out = df.join(placed, key)
    return out if most_words is None else out.withColumn("tokens", F.slice(words(F.coalesce(F.col(text), F.lit(""))), 1, most_words))


def streaming_order(df: DataFrame, seed: int, shard: str = "shard_id", key: str = "id") -> DataFrame:
    """Shards in the order of a hash, documents in that of another within each shard; sorted by partition ranges."""
    h = lambda *c: F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(x).cast("string") for x in c]))
    return df.orderBy(h(shard), shard, h(shard, key), key)


def load_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """``domain`` of a file or of all ``*.txt`` files of a directory: one per line, ``#`` begins a comment. No file: no rows."""
    files = [f for f in storage.list_files(path) if f.endswith(".txt") or not storage.list_names(path)]
    if not files:
        return spark.createDataFrame([], "domain string")
    lines = spark.read.text(files).select(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("domain"))
    return lines.where("domain <> ''").distinct()


def validate_shards(spark: SparkSession, path: str, schema: str, fmt: str = "json", wanted: list[str] | None = None) -> DataFrame:
    """``file, rows, corrupt, problem`` by shard: null if all is well, else ``missing`` (of the ``wanted`` names), ``empty`` or ``corrupt``.

    A JSON row is corrupt if it does not parse as the schema; of Parquet, shards without rows are found.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select(name("path").alias("file"))
    if fmt == "json":
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        lines = spark.read.text(path).where("trim(value) <> ''")
        parsed = lines.select(name("_metadata.file_path").alias("file"), F.from_json("value", f"{schema}, _corrupt string", options)["_corrupt"].isNotNull().alias("bad"))
    else:
        parsed = spark.read.schema(schema).format(fmt).load(path).select(name("_metadata.file_path").alias("file"), F.lit(False).alias("bad"))
    counts = parsed.groupBy("file").agg(F.count("*").alias("rows"), F.count_if("bad").alias("corrupt"))
    if wanted is not None:
        files = files.join(spark.createDataFrame([(w, True) for w in wanted], "file string, _wanted boolean"), "file", "full_outer")
        there = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select(name("path").alias("file"), F.lit(True).alias("_there"))
        files = files.join(there, "file", "left").withColumn("_gone", F.col("_there").isNull())
    else:
        files = files.withColumn("_gone", F.lit(False))
    out = files.join(counts, "file", "left").na.fill(0, ["rows", "corrupt"])
    problem = F.when(F.col("_gone"), "missing").when(F.col("rows") == 0, "empty").when(F.col("corrupt") > 0, "corrupt")
    return out.select("file", "rows", "corrupt", problem.alias("problem"))


def recover_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON shards that parse; others are left out. ``recovered_counts`` tells how many."""
    return _parsed(spark, path, schema).where("_bad IS NULL").select("r.*").drop("_corrupt")


def recovered_counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, recovered, lost``: lines of each JSON shard that parse and that do not."""
    by = _parsed(spark, path, schema).groupBy("file")
    return by.agg(F.count_if(F.col("_bad").isNull()).alias("recovered"), F.count("_bad").alias("lost"))


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).where("trim(value) <> ''")
    out = lines.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.from_json("value", f"{schema}, _corrupt string", options).alias("r"))
    return out.withColumn("_bad", F.col("r._corrupt"))


class FeatureCache:
    """Values of features by document in Parquet: only documents without a value are computed, and then added."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id"):
        self.spark, self.root, self.key = spark, root, key

    def _path(self, feature: str) -> str:
        return storage.join(self.root, hashlib.sha256(feature.encode()).hexdigest()[:16])

    def get(self, feature: str) -> DataFrame | None:
        return self.spark.read.parquet(self._path(feature)) if storage.exists(self._path(feature)) else None

    def get_or_compute(self, df: DataFrame, feature: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``df`` with a column named as the feature. ``compute`` returns key and feature; a null value counts as known."""
        known = self.get(feature)
        todo = df if known is None else df.join(known.select(self.key), self.key, "left_anti")
        compute(todo).select(self.key, feature).write.mode("append").parquet(self._path(feature))
        return df.join(self.spark.read.parquet(self._path(feature)), self.key, "left")

    def clear(self, feature: str) -> None:
        storage.delete(self._path(feature))


class ArtifactStore:
    """Datasets by a hash of policy, code and input; one exists once its manifest does."""

    def __init__(self, root: str):
        self.root = root

    @staticmethod
    def key(policy: str, code: str, inputs: str) -> str:
        return hashlib.sha256(f"{policy}:{code}:{inputs}".encode()).hexdigest()[:16]

    def path(self, key: str) -> str:
        return storage.join(self.root, key)

    def exists(self, key: str) -> bool:
        return storage.exists(storage.join(self.path(key), "manifest.json"))

    def put(self, key: str, df: DataFrame, manifest: dict | None = None, per_shard: int = 10_000) -> str:
        write_shards(df, storage.join(self.path(key), "data"), per_shard)
        shards = shard_manifest(df.sparkSession, storage.join(self.path(key), "data"))
        save_manifest((manifest or {}) | {"key": key, "shards": [r.asDict() for r in shards.orderBy("path").collect()]}, storage.join(self.path(key), "manifest.json"))
        return self.path(key)

    def list(self) -> list[str]:
        return [k for k in storage.list_names(self.root) if self.exists(k)]

    def delete(self, key: str) -> None:
        storage.delete(self.path(key))


class RunLog:
    """Events of a run as JSON lines, a file for each event (object stores cannot append); read back with ``read``."""

    def __init__(self, path: str, run_id: str):
        self.path, self.run_id = path, run_id

    def log(self, event: str, **values) -> None:
        now = datetime.now(UTC).isoformat()
        line = json.dumps({"timestamp": now, "run_id": self.run_id, "event": event, **values}, default=str) + "\n"
        storage.write_text(storage.join(self.path, f"{now.replace(':', '')}-{uuid.uuid4().hex[:8]}.json"), line)

    def config(self, config: dict) -> None:
        self.log("config", config=config)

    def metric(self, name: str, value: float, step: int | None = None) -> None:
        self.log("metric", name=name, value=value, step=step)

    def artifact(self, name: str, path: str) -> None:
        self.log("artifact", name=name, path=path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.json(path)
