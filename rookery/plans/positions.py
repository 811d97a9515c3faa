"""The position pipeline: game files to encoded, split, numbered batches, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.encoding import get_encoder
from rookery.functions.sampling import hash_uniform, ply_gate, shuffled, split_sequential, within_plies
from rookery.operators.batches import mask_tokens, temporal_windows, with_batch_ids
from rookery.plans.settings import DatasetSettings, EncoderSettings, PreprocessingSettings
from rookery.sources import games as G
from rookery.sources import shards as S
from rookery.tables import path_exists, stored


def sampled_positions(spark: SparkSession, directory: str, settings: PreprocessingSettings) -> DataFrame:
    """``game_id, ply, fen, white_elo, black_elo, result`` of the sampled positions.

    Headers are gated before any move is replayed.
    """
    filters = settings.filters
    games = G.elo_gated(G.parsed_games(G.read_games(spark, directory)), settings.seed, centre=filters.min_elo)
    kept = within_plies(F.col("ply"), filters.min_ply, filters.max_ply)
    drawn = ply_gate(hash_uniform(settings.seed, "game_id", "ply"), F.col("ply"), filters.subsample_rate, filters.ply_mode)
    moves = G.positions(G.replayed(games)).filter(kept & drawn).drop("san")
    return moves.join(games.select("game_id", "white_elo", "black_elo", "result").dropDuplicates(["game_id"]), "game_id")


class PositionDataset:
    """Writes batches of encoded positions and lists, tags and describes them."""

    def __init__(self, spark: SparkSession, dataset: DatasetSettings, preprocessing: PreprocessingSettings | None = None):
        self.spark, self.dataset, self.preprocessing = spark, dataset, preprocessing or PreprocessingSettings()

    def encoded(self) -> DataFrame:
        """``encoded, ply, white_elo, black_elo, result`` beside ``game_id`` and ``fen``."""
        rows = sampled_positions(self.spark, self.dataset.data_path, self.preprocessing)
        return rows.withColumn("encoded", get_encoder(self.dataset.encoding)[0](F.col("fen")))

    def next_batch_number(self) -> int:
        root = self.dataset.output_path
        found = [f"{root}/{split}" for split in ("train", "test") if path_exists(self.spark, f"{root}/{split}")]
        if not found:
            return 0
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(found).select(F.col("path").alias("name"))
        return S.next_batch_number(files).first()["next_number"]

    def generate(self, num_batches: int | None = None, *, resume: bool = True, dry_run: bool = False) -> Iterator[tuple[DataFrame, DataFrame]]:
        """Yields ``(train, test)`` for each batch of ``batch_size`` positions after writing it; a dry run writes nothing.

        The encoded positions are cut into batches in the order of game and
        ply, split, and written once by batch and split, so that each batch
        is read from its own files; the last batch may be short.
        """
        first = self.next_batch_number() if resume else 0
        rows = with_batch_ids(self.encoded(), ["game_id", "ply"], self.dataset.batch_size)
        rows = split_sequential(rows, ["game_id", "ply"], self.dataset.train_ratio, ["batch_id"])
        rows = stored(self.spark, rows.hint("rebalance", "batch_id"), "encoded", ("batch_id", "split"))
        last = rows.agg(F.max("batch_id")).first()[0]
        count = 0 if last is None else int(last) + 1
        for k in range(count if num_batches is None else min(count, num_batches)):
            parts = []
            for name in ("train", "test"):
                part = rows.filter((F.col("batch_id") == k) & (F.col("split") == name)).drop("split", "batch_id")
                S.write_batch(part, self.dataset.output_path, name, first + k, self.dataset.name, dry_run=dry_run)
                parts.append(part)
            yield parts[0], parts[1]

    def card(self) -> str:
        return S.dataset_card(self.dataset.name, self.dataset.encoding, get_encoder(self.dataset.encoding)[2], self.dataset.output_path)


def write_position_shard(spark: SparkSession, directory: str, path: str, *, encoding: str = "token_sequence", ratio: float = 0.9, preprocessing: PreprocessingSettings | None = None) -> int:
    """Games to one new shard of train and test rows; returns its number."""
    rows = sampled_positions(spark, directory, preprocessing or PreprocessingSettings())
    encoded = rows.select("game_id", "ply", get_encoder(encoding)[0](F.col("fen")).alias("data"))
    return S.write_shard(split_sequential(encoded, ["game_id", "ply"], ratio), path)


@dataclass(frozen=True)
class TrainingReader:
    """Reads a split as masked windows; the ``with_`` methods return changed readers."""

    spark: SparkSession
    path: str
    split: str = "train"
    encoder: EncoderSettings = EncoderSettings()
    mask_count: int = 0
    seed: int = 42
    epoch: int = 0
    transformation: Callable[[DataFrame], DataFrame] | None = None

    def with_transformation(self, transformation: Callable[[DataFrame], DataFrame]) -> TrainingReader:
        return replace(self, transformation=transformation)

    def with_masking(self, mask_count: int) -> TrainingReader:
        return replace(self, mask_count=mask_count)

    def with_split(self, split: str) -> TrainingReader:
        return replace(self, split=split)

    def next_epoch(self) -> TrainingReader:
        """Other masks and another order."""
        return replace(self, epoch=self.epoch + 1)

    def rows(self) -> DataFrame:
        """``id, x, y`` of single positions, shuffled for the epoch."""
        df = S.read_dataset(self.spark, self.path, self.split)
        if self.transformation is not None:
            df = self.transformation(df)
        df = df.withColumn("id", F.xxhash64("game_id", "ply"))
        x = mask_tokens(F.col("encoded"), F.col("id"), self.mask_count, seed=self.seed, epoch=self.epoch) if self.mask_count else F.col("encoded")
        return shuffled(df.select("id", "game_id", "ply", x.alias("x"), F.col("encoded").alias("y")), self.seed, self.epoch, ["id"])

    def windows(self) -> DataFrame:
        """``game_id, ply, window, scalars``: the last positions of a game up to each one."""
        df = S.read_dataset(self.spark, self.path, self.split)
        out = temporal_windows(df, "game_id", ["ply"], ["encoded"], self.encoder.window_size)
        return out.select("game_id", "ply", F.col("window.encoded").alias("window"), F.struct("ply", "white_elo", "black_elo").alias("scalars"))
