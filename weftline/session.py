"""Session, table loading and lineage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weftline", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with. On a cluster use the session you are given."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session, once, wherever they run and whatever their path is."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="weftline-ship-"), "weftline.zip")  # on the driver; Spark sends it on
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("weftline", os.path.relpath(full, root)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that every machine sees: below spark.checkpoint.dir; in a temporary one only where driver and workers are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        return tempfile.mkdtemp(prefix=f"weftline-{purpose}-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to: what spark.checkpoint.dir names, a folder of our own only where nothing is set and all runs in one process."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark, "checkpoints")
        sc.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in the shared checkpoint folder, so that lost executors lose nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def parallelism(spark: SparkSession, least: int = 8) -> int:
    """Number of tasks for a stage whose work is CPU bound."""
    return max(least, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
