"""Losses and metrics over columns of arrays, each one aggregation without a shuffle of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.encoding import let

PLANES, PIECE_PLANES = 15, 12


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def squared_difference(t: Column, p: Column) -> Column:
    """Sum of squared differences of two arrays, in doubles."""
    return _sum(F.zip_with(t, p, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))))


def _cells(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def _group_squares(t: Column, p: Column, groups: Column, member) -> Column:
    """Sum over groups of the squared sum of differences of each group's cells."""
    diff = F.zip_with(t, p, lambda a, b: a.cast("double") - b.cast("double"))

    def squares(d: Column) -> Column:
        sums = F.transform(groups, lambda g: F.aggregate(F.filter(d, lambda _, i: member(i, g)), F.lit(0.0), lambda acc, x: acc + x))
        return F.aggregate(sums, F.lit(0.0), lambda acc, s: acc + s * s)

    return let(diff, squares)


def column_squares(t: Column, p: Column) -> Column:
    """Per square: difference of piece sums over the twelve piece planes, squared, summed."""
    squares = F.sequence(F.lit(0), (F.size(t) / PLANES).cast("int") - 1)
    return _group_squares(t, p, squares, lambda i, g: ((i / PLANES).cast("int") == g) & (i % PLANES < PIECE_PLANES))


def plane_squares(t: Column, p: Column) -> Column:
    """Per piece plane: difference of the sums over squares, squared, summed."""
    return _group_squares(t, p, F.sequence(F.lit(0), F.lit(PIECE_PLANES - 1)), lambda i, g: i % PLANES == g)


def loss_sum_squared(t: Column, p: Column) -> Column:
    return F.sum(squared_difference(t, p)) / F.count("*")


def loss_number_of_pieces(t: Column, p: Column) -> Column:
    true, predicted = F.sum(_cells(t)), F.sum(_cells(p))
    return (true - predicted) * (true - predicted) / (F.lit(1e-3) + predicted) / F.count("*")


def loss_piece_columns(t: Column, p: Column) -> Column:
    return F.sum(column_squares(t, p)) / F.count("*")


def loss_piece_planes(t: Column, p: Column) -> Column:
    return F.sum(plane_squares(t, p)) / F.count("*")


def loss_regularised(t: Column, p: Column, number: float = 1.0, columns: float = 0.1, planes: float = 0.1) -> Column:
    return loss_sum_squared(t, p) + number * loss_number_of_pieces(t, p) + columns * loss_piece_columns(t, p) + planes * loss_piece_planes(t, p)


def mismatches(x: Column, y: Column) -> Column:
    """Number of positions at which two arrays differ."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), lambda d: d))


def argmax(a: Column) -> Column:
    """Index from 0 of the first largest element."""
    return F.array_position(a, F.array_max(a)) - 1


def softmax(a: Column) -> Column:
    e = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(e, lambda v: let(_sum(v), lambda total: F.transform(v, lambda x: x / total)))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Of one row, from logits and an index label; shifted by the largest logit."""

    def entropy(z: Column) -> Column:
        return let(F.array_max(z), lambda top: F.ln(_sum(F.transform(z, lambda x: F.exp(x - top)))) + top - F.get(z, label.cast("int")))

    return let(logits.cast("array<double>"), entropy)


def accuracy(logits: Column, label: Column) -> Column:
    return F.avg(F.when(argmax(logits) == label, 1.0).otherwise(0.0))


def mean_squared(t: Column, p: Column) -> Column:
    return F.sum(squared_difference(t, p)) / F.sum(F.size(t))


def binary_cross_entropy(t: Column, logits: Column) -> Column:
    """Mean over all elements, from logits, in the overflow-free form."""
    each = F.zip_with(t.cast("array<double>"), logits.cast("array<double>"), lambda y, x: F.greatest(x, F.lit(0.0)) - x * y + F.ln(1 + F.exp(-F.abs(x))))
    return F.sum(_sum(each)) / F.sum(F.size(t))


def perplexity(entropy: Column, label: Column, ignored: int = 0) -> Column:
    """exp of the mean cross-entropy over rows whose label is not ``ignored``."""
    return F.exp(F.avg(F.when(label != ignored, entropy)))


def all_close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal lengths and no element further off than the tolerance."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))), lambda x: x)


def any_equal(a: Column, value: Column) -> Column:
    return F.exists(a, lambda x: x == value)


def positions_where(a: Column, predicate) -> Column:
    """Indices from 0 at which the predicate holds."""
    return F.filter(F.transform(a, lambda x, i: F.when(predicate(x), i)), lambda i: i.isNotNull())


def piece_counts(tokens: DataFrame, id_col: str, token_col: str) -> DataFrame:
    """``id, token, n``: how often each piece stands on each board."""
    return tokens.select(id_col, F.explode(F.slice(token_col, 1, 64)).alias("token")).filter("token between 17 and 28").groupBy(id_col, "token").agg(F.count("*").alias("n"))


def training_rules(log: DataFrame, *, stop_delta: float = 0.01, stop_patience: int = 15, start: int = 3, rate: float = 1e-3, factor: float = 0.3, plateau_delta: float = 0.02, plateau_patience: int = 5, floor: float = 1e-6) -> DataFrame:
    """``epoch, metric, stop, rate`` of an epoch log: early stop and rate cuts on plateaus.

    An epoch log is a short ordered list (one row an epoch), so it is folded
    in one row as an array.
    """
    state = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("wait"), F.lit(False).alias("stop"), F.lit(float("-inf")).alias("top"), F.lit(0).alias("flat"), F.lit(rate).alias("rate"), F.expr("cast(array() as array<struct<epoch:int,metric:double,stop:boolean,rate:double>>)").alias("out"))

    def step(s: Column, row: Column) -> Column:
        counts = row["epoch"] >= start
        better = row["metric"] > s["best"] + stop_delta
        wait = F.when(counts & ~better, s["wait"] + 1).otherwise(0)
        stop = s["stop"] | (wait >= stop_patience)
        higher = row["metric"] > s["top"] + plateau_delta
        flat = F.when(higher, 0).otherwise(s["flat"] + 1)
        cut = flat >= plateau_patience
        now = F.when(cut, F.greatest(s["rate"] * factor, F.lit(floor))).otherwise(s["rate"])
        return F.struct(
            F.when(counts & better, row["metric"]).otherwise(s["best"]).alias("best"),
            wait.alias("wait"),
            stop.alias("stop"),
            F.when(higher, row["metric"]).otherwise(s["top"]).alias("top"),
            F.when(cut, 0).otherwise(flat).alias("flat"),
            now.alias("rate"),
            F.concat(s["out"], F.array(F.struct(row["epoch"].alias("epoch"), row["metric"].alias("metric"), stop.alias("stop"), now.alias("rate")))).alias("out"),
        )

    rows = log.agg(F.sort_array(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("metric").cast("double").alias("metric")))).alias("rows"))
    return rows.select(F.explode(F.aggregate("rows", state, step)["out"]).alias("r")).select("r.*")


def info_nce(pairs: DataFrame, *, query: str = "query_id", similarity: str = "similarity", positive: str = "positive", temperature: float = 0.1, most: float = 1.0) -> DataFrame:
    """``query, loss``: -log of the positive's softmax share among a query's candidates; similarities are ``most`` or less."""
    e = F.exp((F.col(similarity) - most) / temperature)
    return pairs.withColumn("_e", e).groupBy(query).agg((-F.ln(F.sum(F.when(F.col(positive), F.col("_e"))) / F.sum("_e"))).alias("loss"))
