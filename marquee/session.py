"""Session settings, and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

import marquee
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Python workers receive the few Arrow functions by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(marquee)

# Settings the operators rely on. All of them can be changed at run time, so they are
# applied to sessions created elsewhere as well.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app_name: str = "marquee", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above. Shuffle width stays with the cluster unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def state_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints, read from the session.

    A temporary folder is made only for a local master, as in tests; on a cluster a missing
    setting is an error because executors could not read a driver-local path.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marquee-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp")))
    return spark.sparkContext.getCheckpointDir()


def run_folder(spark: SparkSession) -> str:
    """The run's own folder in the shared one; it is removed when the session's JVM ends."""
    context = spark.sparkContext
    path = f"{state_folder(spark).rstrip('/')}/marquee-{context.applicationId}"
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the run's folder and continue from the files.

    This cuts the lineage: the loss of an executor repeats nothing that came before, and later reads take only the columns they need.
    """
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    known = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if t == "void" else F.col(f"`{c}`") for c, t in df.dtypes])
    known.write.parquet(path)
    return df.sparkSession.read.schema(known.schema).parquet(path)
