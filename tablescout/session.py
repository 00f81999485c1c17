"""Session set-up and durable materialisation."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablescout")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the Python call site of every column expression slows down building large plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only local runs may fall back to a private one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablescout-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def forget_on_exit(spark: SparkSession) -> None:
    """Remove this application's checkpoint files when it ends."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder, so later plans read the same rows after any retry."""
    ensure_checkpoint_dir(df.sparkSession)
    forget_on_exit(df.sparkSession)
    return df.checkpoint(eager=True)
