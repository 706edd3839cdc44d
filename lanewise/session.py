"""Session settings used by tests and the benchmark, and checkpoint handling."""

import os
import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lanewise", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session. On a cluster the caller brings its own session instead."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.sql.shuffle.partitions", shuffle_partitions)
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("LANEWISE_DRIVER_MEMORY", "16g"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one, as in tests, gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="lanewise-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in spark.checkpoint.dir.

    A local folder is set only where the session names none, as in tests.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder, read again with its size known."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lanewise-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, jobs: dict[str, Callable], at_once: int = 4) -> dict:
    """Results of several jobs that share the cluster: while one fit waits for its last tasks, others use the free cores."""
    run = inheritable_thread_target(spark)(lambda job: job())
    with ThreadPool(at_once) as pool:
        return dict(zip(jobs, pool.map(run, jobs.values(), chunksize=1)))
