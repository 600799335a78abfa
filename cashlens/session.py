"""Session settings and the shared working folder."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(name="cashlens", cores="*", **conf):
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # above this size the JVM interprets a generated method instead of compiling it
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark):
    """Folder for written intermediate tables: spark.checkpoint.dir, which every executor sees.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = _local_roots.get(spark.sparkContext.applicationId)
    if root is None or not os.path.isdir(root):
        root = tempfile.mkdtemp(prefix="cashlens-")
        _local_roots[spark.sparkContext.applicationId] = root
    return root


def unsorted_writes(spark):
    """A session of its own whose partitioned writes keep the files of a few partitions open instead of sorting all rows.

    For rows that are read from a table partitioned in the same way: a task reads a few of its files, each
    of one partition. A task that meets more partitions sorts the rows that are left.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.maxConcurrentOutputFileWriters", "8")
    own.conf.set("spark.sql.files.maxPartitionBytes", "32m")
    return own


def small_batches(spark, rows):
    """A session of its own, otherwise set as the given one, that hands ``rows`` rows at a time to Python."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return own


def written(df, name, reader=None):
    """The frame written to the shared folder and read back: cuts lineage, survives lost executors.

    ``reader`` is the session that reads it, if not the frame's own.
    """
    path = f"{shared_dir(df.sparkSession)}/cashlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)


_local_roots = {}
