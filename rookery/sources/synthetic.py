"""Synthetic rows by seeded hashes: the same on any cluster and partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.encoding import pack_bits
from rookery.functions.sampling import hash_uniform


def synthetic_vectors(spark: SparkSession, n: int, dim: int, kind: str = "float", seed: int = 42) -> DataFrame:
    """``id, embedding``: uniform floats, or bits (uniform > 0.5) packed into bytes."""
    u = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: hash_uniform(seed, F.col("id"), i))
    rows = spark.range(n)
    if kind == "float":
        return rows.select("id", u.cast("array<float>").alias("embedding"))
    if kind == "binary":
        return rows.select("id", pack_bits(F.transform(u, lambda x: x > 0.5)).alias("embedding"))
    raise ValueError(f"unknown vector type {kind!r}")


def synthetic_entities(spark: SparkSession, n: int = 3000, dim: int = 8, seed: int = 19530) -> DataFrame:
    """``pk, random, embeddings`` with a text key."""
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: hash_uniform(seed, F.lit("v"), F.col("id"), i)).cast("array<float>")
    return spark.range(n).select(F.col("id").cast("string").alias("pk"), hash_uniform(seed, F.lit("r"), "id").alias("random"), vector.alias("embeddings"))


def random_boards(spark: SparkSession, n: int, max_pieces: int = 1, seed: int = 42) -> DataFrame:
    """``id, fen``: legal positions of two kings and 1 to ``max_pieces`` further pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import random

        from rookery.functions.board_rules import random_board

        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "fen": [random_board(random.Random(f"{seed}:{i}"), max_pieces).fen() for i in batch["id"]]})

    return spark.range(n).mapInPandas(run, "id long, fen string")
