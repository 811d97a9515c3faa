"""Positions in linked collections: bitboards, embeddings and tokens under one id, searched by board."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions import vocabulary as V
from rookery.functions.encoders import Encoder, RandomProjection, encode_with
from rookery.functions.encoding import bitboard_to_fen, fen_to_bitboard, fen_to_tokens, pack_bits, padded, unpack_bits
from rookery.operators.search import lookup_hits
from rookery.operators.store import VectorStore


@dataclass
class PositionIndex:
    """Three stores that share ids; embeddings are those of ``encoder`` over 773 bits."""

    spark: SparkSession
    root: str
    encoder: Encoder
    overwrite: bool = False

    def __post_init__(self) -> None:
        make = lambda name, kind, dim: VectorStore(self.spark, self.root, name, kind, dim, overwrite=self.overwrite)
        self.bitboards = make("bitboard", "binary", V.PACKED_BITS)
        self.embeddings = make("embedding", "float", self.encoder.out_size)
        self.tokens = make("token", "float", V.TOKENS)

    def _embedded(self, positions: DataFrame) -> DataFrame:
        bits = positions.select("id", fen_to_bitboard(F.col("fen")).cast("array<int>").alias("bits"))
        return encode_with(bits, self.encoder, "bits")

    def insert(self, positions: DataFrame, id_col: str | None = None) -> DataFrame:
        """Adds positions (``fen``) and returns their ids; without ``id_col`` the id is a hash of the text."""
        rows = positions.select((F.xxhash64("fen") if id_col is None else F.col(id_col).cast("long")).alias("id"), "fen").dropDuplicates(["id"])
        self.bitboards.insert(rows.select("id", pack_bits(padded(fen_to_bitboard(F.col("fen")))).alias("embedding")), mode="upsert")
        self.embeddings.insert(self._embedded(rows), mode="upsert")
        self.tokens.insert(rows.select("id", fen_to_tokens(F.col("fen")).cast("array<float>").alias("embedding")), mode="upsert")
        return rows.select("id")

    def create_indexes(self) -> list[str]:
        return [store.create_default_index() for store in (self.bitboards, self.embeddings, self.tokens)]

    def search(self, boards: DataFrame, top_k: int = 10, *, by: str = "embedding", nprobe: int = 10, exact: bool = False) -> DataFrame:
        """``query_id, rank, id, distance, fen`` for boards ``query_id, fen``; positions are read back from their bits."""
        asked = boards.select("query_id", "fen")
        if by == "embedding":
            vectors = self._embedded(asked.select(F.col("query_id").alias("id"), "fen")).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
            hits = self.embeddings.search(vectors, top_k, nprobe, exact=exact, output_fields=())
        elif by == "bitboard":
            packed = asked.select("query_id", pack_bits(padded(fen_to_bitboard(F.col("fen")))).alias("query"))
            hits = self.bitboards.search(packed, top_k, nprobe, exact=exact, output_fields=())
        elif by == "token":
            hits = self.tokens.search(asked.select("query_id", fen_to_tokens(F.col("fen")).cast("array<float>").alias("query")), top_k, nprobe, exact=exact, output_fields=())
        else:
            raise ValueError(f"unknown collection {by!r}")
        boards_of = self.bitboards.rows().select("id", bitboard_to_fen(unpack_bits(F.col("embedding"))).alias("fen"))
        return lookup_hits(hits, boards_of)


def position_index(spark: SparkSession, root: str, encoder: Encoder | None = None, *, overwrite: bool = False) -> PositionIndex:
    return PositionIndex(spark, root, encoder or RandomProjection(), overwrite)
