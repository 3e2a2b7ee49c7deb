"""Tables, lineage cuts and partition counts of a session."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks import storage

#: Folders of steps by the process that wrote them; the innermost open ``scratch`` comes last.
_STEPS: list[set[str]] = [set()]
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data directory.

    Documents, whose texts are the work, are dealt out to all cores if their files give less than half of them something to do.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and 2 * df.rdd.getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local session (tests) gets a temporary folder; on a cluster that is an error, since executors
    would each write to a disk of their own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not is_local(sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all workers of {sc.master} share")
        named = "file://" + tempfile.mkdtemp(prefix="loamworks-")
        _STEPS[0].add(named)
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def step_path(spark: SparkSession, name: str = "step") -> str:
    """A new path in the shared folder, deleted at the end of the innermost ``scratch`` or of the process."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STEPS[-1].add(path)
    return path


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder, or to a ``step_path`` made before, and read it back.

    Survives the loss of executors, unlike a local checkpoint, and lets later
    steps prune columns. The folder is deleted at the end of the innermost ``scratch`` or of the process; what was shuffled
    for it is deleted at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = path or step_path(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete the steps written inside once the block ends. Results must be written or collected before."""
    _STEPS.append(set())
    try:
        yield
    finally:
        _clear(_STEPS.pop())


def _clear(paths: set[str]) -> None:
    for path in paths:
        try:
            storage.delete(path)
        except OSError:  # the file system may be gone at the end of a process
            pass
    paths.clear()


_OWNER = os.getpid()
atexit.register(lambda: os.getpid() == _OWNER and _clear(_STEPS[0]))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, key: str, n: int, total: int | None = None) -> DataFrame:
    """All rows if there are at most ``n``, else about ``n``, chosen by a hash of ``key``. ``total``: the number of rows, if it is known.

    A row is kept or not by itself, so no task sends more than its part, and the choice does not depend on partitions.
    """
    total = df.count() if total is None else total
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(2**40)) < int(2**40 * n / total))


def bounded_texts(df: DataFrame, key: str, text: str, most_bytes: int) -> DataFrame:
    """A written sample whose texts have about ``most_bytes`` in all at most.

    Rows of a text longer than a hundredth of that are left out first, then rows are chosen by a hash of ``key`` that differs from ``bounded_sample``'s.
    """
    rows = materialize(df.where(F.coalesce(F.octet_length(text), F.lit(0)) <= most_bytes // 100))
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return rows if size <= most_bytes else rows.where(F.pmod(F.xxhash64(F.lit("texts"), F.col(key)), F.lit(2**40)) < int(2**40 * most_bytes / size))
