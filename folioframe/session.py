"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session that is there."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioframe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; a folder of our own only on a single machine where none is set."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or _local_folder())


def _local_folder() -> str:
    """A checkpoint folder for a local session, removed at the end."""
    path = tempfile.mkdtemp(prefix="folioframe-checkpoint-")
    atexit.register(shutil.rmtree, path, True)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_plan(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, without the optimiser's size estimate, for frames that go from round to round of a loop.

    A checkpoint keeps the estimate of the plan behind it. Joins multiply estimates, so that in a loop the number
    itself doubles its digits with every round.
    """
    done = cut_lineage(df)
    spark = df.sparkSession
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, for the checks before a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
