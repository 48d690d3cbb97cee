"""Session settings shared by the bench, the tests and ad-hoc use.

On a cluster the submitter's settings win; these are only the ones the
operators rely on (UTC clock fields, AQE, Arrow transfer, RocksDB state).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no Python call sites in plans: plan building is half as long
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(app: str = "tallywatt", cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.host", "localhost")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


# The profile's aggregation state is 122 columns wide; above this setting's
# default of 100 Spark interprets such an aggregate instead of compiling it.
CODEGEN_FIELDS = "spark.sql.codegen.maxFields"


def tune(spark: SparkSession) -> SparkSession:
    """Raise the compiled-width limit of a running session, never lower it."""
    if int(spark.conf.get(CODEGEN_FIELDS, "100")) < 256:
        spark.conf.set(CODEGEN_FIELDS, "256")
    return spark


def stateful(spark: SparkSession) -> SparkSession:
    """Stateful Python processors need the RocksDB state store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, SETTINGS[key])
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names.

    A temporary folder is chosen only where the session names none and runs
    in local mode; a cluster without the setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read by all."""
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a reused intermediate through the shared folder, so
    that a lost executor costs a re-read and not a recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()
