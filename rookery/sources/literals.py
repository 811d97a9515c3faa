"""Named positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Positions by name.
NAMED_POSITIONS = {
    "game_1_catalan_opening": "r1bqr1k1/pp1nnpbp/2p3p1/4p3/4P3/4BNP1/PPPQ1PBP/RN2R1K1 w - - 2 11",
    "game_1_one_move_later": "r1bqr1k1/pp1nnpbp/2p3pB/4p3/4P3/5NP1/PPPQ1PBP/RN2R1K1 b - - 3 11",
    "game_1_few_moves_later": "r3r3/ppq1npkp/2p3p1/2n1p2P/4P1b1/5NP1/PPPQ1PB1/RN2R1K1 w - - 1 15",
    "game_1_middle_game": "7r/p3npk1/2p4r/1p2N1p1/1P2P3/2P3P1/P4PK1/3RR3 w - - 0 28",
    "game_1_end_game": "8/8/8/1N3k2/1n3Pp1/6P1/5K2/8 w - - 0 43",
    "game_2_catalan_opening": "rn1qk2r/pp2bppp/2p5/3p1b2/3PnB2/2N2NP1/PP2PPBP/R2Q1RK1 b kq - 1 9",
    "game_2_middle_game": "r2r2k1/pQ3ppp/3q4/3P1b2/2R5/6P1/P4PBP/5RK1 b - - 0 21",
    "debug_board": "r3k2r/1p1b1ppp/nq2pn2/pN6/PbBP4/4P3/1B3PPP/R2Q1KNR w kq - 3 13",
    "search_board": "2kr4/pp1q3r/4ppp1/2p1b2p/3pP1n1/1P1P1QPN/P1P2P1P/R1B1R1K1 w - - 2 18",
}


def named_positions(spark: SparkSession) -> DataFrame:
    """``name, fen``."""
    return spark.createDataFrame(list(NAMED_POSITIONS.items()), "name string, fen string")


def names_by_vector(named: DataFrame, vector_col: str, name_col: str = "name") -> DataFrame:
    """The inverse of name -> vector: ``vector, names`` with the names of equal vectors in order."""
    return named.groupBy(F.col(vector_col).alias("vector")).agg(F.sort_array(F.collect_list(name_col)).alias("names"))
