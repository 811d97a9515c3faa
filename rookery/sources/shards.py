"""Train and test shards: Parquet partitioned by split and shard, numbered from the files there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.tables import path_exists


def next_number(names: DataFrame, name_col: str = "name", pattern: str = r"_(\d+)(\.|$)") -> DataFrame:
    """One row ``next_number, postfix``: 0 if no name has a number, else the largest plus 1; at least three digits."""
    number = F.nullif(F.regexp_extract(name_col, pattern, 1), F.lit("")).cast("int")
    return names.agg(F.coalesce(F.max(number) + 1, F.lit(0)).alias("next_number")).select("next_number", shard_postfix(F.col("next_number")).alias("postfix"))


def shard_postfix(number: Column) -> Column:
    """Three digits, more if needed."""
    text = number.cast("string")
    return F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)


def next_shard(spark: SparkSession, path: str) -> int:
    """The number after the largest shard of either split."""
    if not path_exists(spark, path):
        return 0
    last = spark.read.parquet(path).agg(F.max("shard")).first()[0]
    return 0 if last is None else int(last) + 1


def write_shard(df: DataFrame, path: str, *, shard: int | None = None) -> int:
    """Append rows that have a ``split`` column as one shard; returns its number."""
    number = next_shard(df.sparkSession, path) if shard is None else shard
    df.withColumn("shard", F.lit(number)).write.mode("append").option("compression", "zstd").partitionBy("split", "shard").parquet(path)
    return number


def read_shards(spark: SparkSession, path: str, *, split: str | None = None, shard: int | None = None) -> DataFrame:
    """Rows of the shards asked for; both conditions prune partitions."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
    if shard is not None:
        df = df.filter(F.col("shard") == shard)
    return df


def read_train_test(spark: SparkSession, path: str, shard: int | None = None) -> tuple[DataFrame, DataFrame]:
    return read_shards(spark, path, split="train", shard=shard), read_shards(spark, path, split="test", shard=shard)


def shard_for_epoch(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """One shard for each epoch, the last first, and again from the start when all were seen."""
    shards = sorted(r[0] for r in spark.read.parquet(path).select("shard").distinct().collect())
    return read_shards(spark, path, shard=shards[-1 - epoch % len(shards)])


def batch_path(split: Column, number: Column, name: Column) -> Column:
    return F.concat(split, F.format_string("/batch_%04d_", number), name, F.lit(".parquet"))


def next_batch_number(names: DataFrame, name_col: str = "name") -> DataFrame:
    """As ``next_number``, for ``batch_NNNN_name`` paths."""
    return next_number(names, name_col, r"batch_(\d+)_")


def write_batch(df: DataFrame, root: str, split: str, number: int, name: str, *, dry_run: bool = False) -> str:
    """Write a numbered batch; a dry run only returns the path."""
    path = f"{root}/{split}/batch_{number:04d}_{name}.parquet"
    if not dry_run:
        df.write.mode("errorifexists").parquet(path)
    return path


def read_dataset(spark: SparkSession, path: str, split: str, *, streaming: bool = False, schema=None) -> DataFrame:
    """All batches of a split, as a table or as a stream of files."""
    where = f"{path}/{split}/*.parquet"
    if not streaming:
        return spark.read.parquet(where)
    return spark.readStream.schema(schema if schema is not None else spark.read.parquet(where).schema).parquet(where)


def dataset_card(name: str, encoding: str, shape: tuple[int, ...], path: str) -> str:
    """A short description in Markdown."""
    size = " x ".join(map(str, shape))
    return f'# {name}\n\nPositions encoded as `{encoding}` of shape {size}.\n\n```python\nspark.read.parquet("{path}/train/*.parquet")\n```\n'


def tag_version(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Writes ``tag, file`` for every data file there is now and returns it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(F.lit(tag).alias("tag"), F.col("path").alias("file"))
    where = f"{path}/_versions/{tag}"
    files.write.mode("errorifexists").json(where)
    return spark.read.schema("tag string, file string").json(where)
