"""Session helpers: the package on the executors, and tables in the folder that all of them share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a context, for functions that run in Python workers."""
    sc = spark.sparkContext
    if not getattr(sc, "_lakeseek_shipped", False):
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="lakeseek-")) / "lakeseek.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(to))
        sc._lakeseek_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local master, else an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakeseek-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def app_dir(spark: SparkSession) -> str:
    """Below the shared folder, where this application writes what it reads again."""
    return f"{shared_dir(spark)}/lakeseek-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_written(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder: once its results are stored, as they read from there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(app_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor costs a reread only."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(), with a folder for it."""
    base, sc = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A table read from fewer files than there are cores, dealt to all of them: a file of one row group is one task. Others as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df
