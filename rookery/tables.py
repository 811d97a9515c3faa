"""Tables written in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own where it is unset and the master local, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rookery-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def list_names(spark: SparkSession, path: str) -> list[str]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)]


def rename_path(spark: SparkSession, old: str, new: str) -> bool:
    """Moves a folder to a name that is not taken; False if it is."""
    source, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(target) and fs.rename(source, target)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    top = f"{shared_dir(spark)}/rookery-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            delete_path(spark, top)
        except Exception:  # noqa: BLE001  the session has ended
            return

    atexit.register(remove)
    return f"{top}/{name}"


def stored(spark: SparkSession, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and go on from the files: what follows sees one fixed result and short lineage.

    ``by`` names the columns that the files are partitioned by.
    """
    path = new_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
