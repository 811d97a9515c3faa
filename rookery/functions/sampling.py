"""Seeded draws as hash-uniform columns, and the gates and splits made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.tables import stored


def hash_uniform(seed: int | str, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the seed and the keys only."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def parse_elo(header: Column, default: int | None = 1500) -> Column:
    """An integer rating; anything else gives ``default``."""
    value = header.try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def elo_probability(white: Column, black: Column, centre: float = 2000.0, slope: float = 0.005) -> Column:
    """Logistic in the lower rating."""
    return 1.0 / (1.0 + F.exp(-F.lit(slope) * (F.least(white, black) - F.lit(centre))))


def elo_gate(u: Column, white: Column, black: Column, centre: float = 2000.0) -> Column:
    return u < elo_probability(white, black, centre)


def ply_probability(ply: Column, rate: float = 0.33, mode: str = "linear") -> Column:
    """``linear``: min(ply / 900, 1) * rate; ``squared``: min((ply / 30)^2, 1) * rate."""
    if mode == "linear":
        return F.least(ply / F.lit(900.0), F.lit(1.0)) * rate
    if mode == "squared":
        return F.least(F.pow(ply / F.lit(30.0), 2), F.lit(1.0)) * rate
    raise ValueError(f"unknown ply mode {mode!r}")


def ply_gate(u: Column, ply: Column, rate: float = 0.33, mode: str = "linear") -> Column:
    return u < ply_probability(ply, rate, mode)


def within_plies(ply: Column, least: int | None = None, most: int | None = None) -> Column:
    keep = F.lit(True)
    if least is not None:
        keep = keep & (ply >= least)
    if most is not None:
        keep = keep & (ply <= most)
    return keep


def split_sequential(df: DataFrame, order: list[str], ratio: float = 0.9, block: list[str] | None = None) -> DataFrame:
    """Adds ``split``: the first int(n * ratio) rows of each block are train, the rest test.

    With ``block`` the rows are numbered inside each block.  Without, rows get
    their place from a range-partitioned sort and per-partition counts, so no
    task sees the whole table.
    """
    if block:
        w = Window.partitionBy(*block)
        place, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
        return df.withColumn("_place", place).withColumn("_n", n).withColumn("split", F.when(F.col("_place") <= F.floor(F.col("_n") * F.lit(ratio)), "train").otherwise("test")).drop("_place", "_n")
    numbered, total = global_rows(df, order)
    return numbered.withColumn("split", F.when(F.col("row") < int(total * ratio), "train").otherwise("test")).drop("row")


def global_rows(df: DataFrame, order: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """Rows numbered from 0 in ``order``, and their count.

    A range-partitioned sort, written once so that its partitions are fixed; a
    count for each partition (a row for each reaches the driver); then the
    partition's offset is added to the row's place inside it.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    # the running number's upper bits are the partition, the lower ones the place in it
    ranged = stored(spark, ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged")
    part = F.shiftrightunsigned("_id", 33).cast("int")
    counts = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets += [F.lit(p), F.lit(total).cast("long")]
        total += n
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long")), 0
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn(name, F.element_at(F.create_map(*offsets), part) + place).drop("_id"), total


def split_by_hash(df: DataFrame, seed: int, keys: list[str], ratio: float = 0.9) -> DataFrame:
    """Adds ``split`` by a seeded hash of the keys: no shuffle."""
    return df.withColumn("split", F.when(hash_uniform(seed, *keys) < ratio, "train").otherwise("test"))


def shuffled(df: DataFrame, seed: int, epoch: int, keys: list[str]) -> DataFrame:
    """Rows in a seeded order that changes with the epoch."""
    return df.orderBy(hash_uniform(seed, F.lit(epoch), *keys), *keys)


def numbered_shuffle(df: DataFrame, seed: int, epoch: int, keys: list[str], name: str = "place") -> DataFrame:
    """All rows with their place, from 0, in the order of ``shuffled``; no task sees the whole table."""
    rows, _ = global_rows(df.withColumn("_u", hash_uniform(seed, F.lit(epoch), *keys)), ["_u", *keys], name)
    return rows.drop("_u")


def limited(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)
