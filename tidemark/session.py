"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a table is a parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir; raises RuntimeError on a cluster where there is none.

    A folder of one machine would lose what it holds with that machine, so none is chosen on a cluster.  Only where
    the whole of Spark is one process (master local), as in tests, a temporary folder serves.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(given or os.path.join(tempfile.gettempdir(), "tidemark-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write a reused intermediate once to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of a cluster on which it is not installed (Arrow functions import it there)."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    d = tempfile.mkdtemp()  # on the driver only; Spark serves the file from there as long as the session lives
    spark.sparkContext.addPyFile(shutil.make_archive(f"{d}/tidemark", "zip", root, "tidemark"))


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings used by tests and bench."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
