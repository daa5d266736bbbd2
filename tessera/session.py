"""Session and table helpers shared by every part of the package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "tessera", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes from which a table of few splits is worth dealing out.
SMALL = 2_000_000


def spread(rows: DataFrame) -> DataFrame:
    """A table read from so few splits that they leave most cores idle, such as one row group, dealt out to all of them.
    Splits and size are known from the files' listing; a table of many splits stays as it is."""
    spark = rows.sparkSession
    cores, plan = spark.sparkContext.defaultParallelism, rows._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < SMALL or 2 * rows._jdf.rdd().getNumPartitions() > cores:
        return rows
    return rows.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder; works on any path that Spark can read."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Where that is unset and all runs on
    this machine, as in tests, a temporary folder stands in; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
