"""Session defaults and the two ways a job cuts its lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vecloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may go without one; it gets a fresh temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="vecloom-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: the result survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; ``drop_scratch`` removes what was written there."""
    _SCRATCH.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write to a fresh Parquet folder and read it back: later reads prune columns.

    ``codec`` is the compression, else the session's. The folder stays for as long as results may read it; ``drop_scratch``
    removes it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most about ``most`` bytes for the jobs inside: a worker of Python holds two of them at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``materialize`` as a table that is bucketed by ``key``: later joins on it don't shuffle these rows again.

    As many buckets as shuffle partitions, compressed by zstd, as texts take most of the room. The catalog entry is of this
    session; ``drop_scratch`` removes the files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"scratch_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").bucketBy(n, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: Spark deletes them when the driver's JVM collects what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``materialize`` table that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        for path in [p for p in _SCRATCH if folder.endswith(p.rpartition("/")[2])]:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(hadoop).delete(target, True)
            _SCRATCH.remove(path)


def materialize_all(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """``materialize`` several tables that don't need each other, at the same time."""
    spark = tables[0][0].sparkSession
    with ThreadPoolExecutor(len(tables)) as pool:
        return [j.result() for j in [pool.submit(inheritable_thread_target(spark)(lambda t=t: materialize(*t))) for t in tables]]


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables of this session, once their results are no longer needed."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while _SCRATCH:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        dropped += bool(target.getFileSystem(hadoop).delete(target, True))
    return dropped


def spread(df: DataFrame) -> DataFrame:
    """Rows of a source with fewer splits than cores, dealt out evenly for costly per-row work.

    A source with enough splits stays as it is, so a large table is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
