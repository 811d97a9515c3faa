"""Batches, masks, windows and pairs of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions import vocabulary as V
from rookery.functions.encoding import let
from rookery.functions.sampling import global_rows, hash_uniform


# -- batches
def batch_count(df: DataFrame, size: int) -> DataFrame:
    """One row ``n_rows, n_batches``."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_batches", F.ceil(F.col("n_rows") / size))


def with_batch_ids(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds ``batch_id`` from 0 in a total order; the last batch may be short."""
    rows, _ = global_rows(df, order, "_row")
    return rows.withColumn("batch_id", F.floor(F.col("_row") / size)).drop("_row")


def batch(df: DataFrame, order: list[str], size: int, index: int) -> DataFrame:
    return with_batch_ids(df, order, size).filter(F.col("batch_id") == index).drop("batch_id")


def grouped_batches(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each batch: its rows as an array, in the order of the columns."""
    return df.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"), F.count("*").alias("n"))


def apply_model(df: DataFrame, predict: Callable, in_cols: list[str], schema: str) -> DataFrame:
    """``predict`` gets and gives pandas frames, batch by batch; ``schema`` names its columns."""

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            yield predict(frame)

    return df.select(*in_cols).mapInPandas(run, schema)


# -- masks
def masked_indices(seed: int, epoch: int, key: Column, size: int, k: int) -> Column:
    """k of 0..size-1 without replacement: the indices of least hash."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), key, i)).alias("h"), i.alias("i")))
    return F.slice(F.sort_array(drawn), 1, k)["i"]


def mask_tokens(tokens: Column, key: Column, k: int = 10, *, seed: int = 42, epoch: int = 0) -> Column:
    """k of the 69 tokens become the mask id; any index may be drawn."""
    masked = lambda chosen: F.transform(tokens, lambda t, i: F.when(F.array_contains(chosen, i), F.lit(V.MASK)).otherwise(t.cast("int")))
    return let(masked_indices(seed, epoch, key, V.TOKENS, k), masked).cast("array<tinyint>")


def mask_squares(tensor: Column, key: Column, k: int = 10, *, seed: int = 42, epoch: int = 0, squares: int = 64) -> Column:
    """All planes of k squares become the mask id; the labels are another column and stay."""
    masked = lambda chosen: F.transform(tensor.cast("array<double>"), lambda x, i: F.when(F.array_contains(chosen, (i / V.PLANES).cast("int")), F.lit(float(V.MASK))).otherwise(x))
    return let(masked_indices(seed, epoch, key, squares, k), masked)


def reconstruction_pairs(df: DataFrame, column: str, mode: str = "token_sequence", k: int = 10, *, id_col: str = "id", seed: int = 42, epoch: int = 0) -> DataFrame:
    """``id, x, y``: masked input and untouched label; another epoch draws other masks."""
    if mode not in ("token_sequence", "tensor"):
        raise ValueError(f"unknown mode {mode!r}")
    mask = mask_tokens if mode == "token_sequence" else mask_squares
    return df.select(F.col(id_col).alias("id"), mask(F.col(column), F.col(id_col), k, seed=seed, epoch=epoch).alias("x"), F.col(column).alias("y"))


# -- windows
def temporal_windows(df: DataFrame, game: str, order: list[str], values: list[str], size: int = 8) -> DataFrame:
    """Sliding lists of ``size`` consecutive rows of a game, at every row that has as many before it."""
    w = Window.partitionBy(game).orderBy(*order).rowsBetween(-(size - 1), 0)
    return df.withColumn("window", F.collect_list(F.struct(*values)).over(w)).filter(F.size("window") == size)


def future(df: DataFrame, game: str, order: list[str], value: str, ahead: int = 5, name: str = "future") -> DataFrame:
    """The value ``ahead`` rows later in the same game, null at the end."""
    return df.withColumn(name, F.lead(value, ahead).over(Window.partitionBy(game).orderBy(*order)))


def plies(df: DataFrame, game: str, order: list[str], name: str = "ply") -> DataFrame:
    """Adds the place in the game, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(game).orderBy(*order)) - 1)


# -- pairs
def ply_distances(df: DataFrame, game: str, ply: str, id_col: str, most: int) -> DataFrame:
    """``game, a, b, distance`` for the pairs of a game that are at most ``most`` plies apart.

    A row meets the ``most`` rows after it by key, so the pairs grow with the
    rows and not with the square of a game.
    """
    left = df.select(F.col(game).alias("game"), F.col(id_col).alias("a"), F.explode(F.sequence(F.col(ply) + 1, F.col(ply) + most)).alias("p"), F.col(ply).alias("pa"))
    right = df.select(F.col(game).alias("game"), F.col(id_col).alias("b"), F.col(ply).alias("p"))
    return left.join(right, ["game", "p"]).select("game", "a", "b", (F.col("p") - F.col("pa")).alias("distance"))


def transpositions(df: DataFrame, game: str, key: str) -> DataFrame:
    """``key, game_a, game_b``: equal positions of different games, each game linked to the next one that has the position.

    The chain through a position's games holds every game that has it, in as
    many rows as games, where all pairs would be their square.  All rows are
    numbered in the order of key and game and each meets the one after, so a
    position that all games have is dealt over as many tasks as any.
    """
    each, _ = global_rows(df.select(F.col(key).alias("key"), F.col(game).alias("game_a")).distinct(), ["key", "game_a"], "_row")
    after = each.select((F.col("_row") - 1).alias("_row"), F.col("key").alias("_key"), F.col("game_a").alias("game_b"))
    return each.join(after, "_row").filter(F.col("key") == F.col("_key")).filter("game_a is not null").select("key", "game_a", "game_b")


def negatives(df: DataFrame, game: str, id_col: str, *, seed: int = 42, bucket_rows: int = 10_000) -> DataFrame:
    """``id, negative``: for each row a row of another game, if there is one.

    Rows are dealt by a hash of the id into buckets of about ``bucket_rows``
    and put in hash order; a row gets the next one of its bucket that is of
    another game, from the bucket's start where there is none after it, and in
    a bucket of one game the first row, by hash, of one of two other games.
    Null is a game of its own.
    """
    u = hash_uniform(seed, id_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(game).alias("game"), u.alias("u"))
    buckets = max(1, rows.count() // bucket_rows)
    rows = rows.withColumn("bucket", F.floor(F.col("u") * buckets))
    # read backwards, so that what comes after a row is a running value
    back = Window.partitionBy("bucket").orderBy(F.desc("u"), F.desc("id"))
    ahead = F.lag(F.struct("id", "game")).over(back)
    rows = rows.withColumn("ahead", ahead)
    turn = F.when(F.col("ahead").isNotNull() & ~F.col("ahead.game").eqNullSafe(F.col("game")), F.col("ahead.id"))
    rows = rows.withColumn("after", F.last(turn, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min(F.struct("u", "id", "game"))
    firsts = rows.groupBy("bucket").agg(start.alias("first"))
    # the first rows of two games in the whole table
    one = rows.agg(start.alias("x"))
    two = rows.join(F.broadcast(one)).filter(~F.col("game").eqNullSafe(F.col("x.game"))).agg(start.alias("y"))
    joined = rows.join(firsts, "bucket").join(F.broadcast(one)).join(F.broadcast(two))
    other = lambda c: F.when(~F.col(f"{c}.game").eqNullSafe(F.col("game")), F.col(f"{c}.id"))
    return joined.select("id", F.coalesce("after", other("first"), other("x"), other("y")).alias("negative")).filter("negative is not null")


# -- ranking
def best_samples(df: DataFrame, loss: str, n: int, id_col: str) -> DataFrame:
    """The n rows of least loss among the first 10 n rows by id."""
    return df.orderBy(id_col).limit(10 * n).orderBy(F.asc(loss), id_col).limit(n)


def worst_samples(df: DataFrame, loss: str, n: int, id_col: str) -> DataFrame:
    return df.orderBy(id_col).limit(10 * n).orderBy(F.desc(loss), id_col).limit(n)
