"""Tables, and intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        _own[app] = where
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def local_folder(name: str) -> Path:
    """A folder of the driver for files that Spark sends to the executors; removed when the driver ends."""
    folder = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, folder, True)
    return Path(folder)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: cuts the lineage and survives the loss of executors.

    The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, f"stage-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = local_folder("ship") / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def per_value(fn: Callable, kind: str) -> Callable[[Column], Column]:
    """A Python helper for single values, applied to Arrow batches of a column; nulls pass."""
    ship(SparkSession.active())

    def run(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore")

    return F.pandas_udf(run, kind)
