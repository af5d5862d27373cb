"""Session settings, and the shared folder that lineage cuts and stream tables go to."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that may change on a running session; every one is safe to repeat.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more (pre-aggregated) shuffle after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Keyed stream state outgrows the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def shuffle_partitions(input_bytes: int, target_bytes: int = 512 << 20) -> int:
    """Partitions for a shuffle of that much data; adaptive execution merges those that turn out small."""
    return max(8, -(-input_bytes // target_bytes))


def build_session(
    app: str = "salesloom", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the project's settings; ``conf`` keys use ``__`` for dots.

    ``input_bytes`` sizes the shuffles for the tables to be read.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites cost more than planning
    )
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    if input_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes)))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def small_tasks(spark: SparkSession, most: int = 32 << 20) -> SparkSession:
    """Lets no task after a shuffle be merged or split to more than that much compressed data: the joins of lines sort and
    hash 10 to 20 times as much in memory. A smaller setting stays."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))
    return spark


def find_package(spark: SparkSession) -> None:
    """Lets Python workers find this package.

    On a cluster the package is installed or shipped with the job; the path added here serves a checkout.
    """
    root = str(Path(__file__).resolve().parents[1])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_root(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    There is no other: a folder of one machine would be missing on the others.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def run_folder(spark: SparkSession) -> str:
    """Where this application's stage tables and stream tables lie."""
    return f"{shared_root(spark).rstrip('/')}/salesloom/{spark.sparkContext.applicationId}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if there, in whatever store the path names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in whatever store the path names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """What ``write_text`` wrote; None if the file isn't there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def folders_in(spark: SparkSession, path: str, with_file: str | None = None) -> list[str]:
    """Names of the folders right below a path, in order; with ``with_file`` those that hold a file of that name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(f.getName() for f in found if not with_file or fs.exists(jvm.org.apache.hadoop.fs.Path(f, with_file)))


def release(spark: SparkSession) -> None:
    """Removes the application's stage tables; for whoever ends it, when no frame made from them is used any more."""
    remove_folder(spark, run_folder(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the run's folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes the rows to a new table in the shared folder and reads that from there on.

    Later passes see the same rows even after executor loss, read only the columns they need, and are
    planned with the table's true size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
