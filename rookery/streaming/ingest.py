"""File-stream ingest of vectors and games; every micro-batch is one commit of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rookery.operators.store import VectorStore
from rookery.sources.games import parsed_games, read_games, replayed


def vector_stream(spark: SparkSession, directory: str, schema: str = "id long, embedding array<float>", max_files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(directory)


def ingest_vectors(stream: DataFrame, store: VectorStore, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch, so a batch that is run again after a failure changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.insert(batch.dropDuplicates(["id"]), mode="upsert")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_games(spark: SparkSession, directory: str, output: str, checkpoint: str, max_files: int = 1_000) -> StreamingQuery:
    """Replays new game files into a table of positions; each batch writes its own folder, so a retry replaces it."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files).schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pgn").load(directory).select("path")

    def put(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # names of at most max_files files
        if paths:
            replayed(parsed_games(read_games(spark, paths))).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
