"""The token vocabulary of positions and its maps."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token ids.
EMPTY, MASK = 15, 16
PIECES = "PNBRQKpnbrqk"  # ids 17 to 28
TURN_WHITE, TURN_BLACK = 29, 30
NO_CASTLING, CASTLING = 31, 32
VOCABULARY_SIZE = 33

FIRST_PIECE, LAST_PIECE = 17, 28
SQUARES, TOKENS = 64, 69
BITBOARD_BITS, PACKED_BITS = 773, 776
PLANES, TENSOR_CELLS = 15, 960

TOKEN_IDS: dict[str, int] = (
    {"empty": EMPTY, "mask": MASK} | {p: FIRST_PIECE + k for k, p in enumerate(PIECES)} | {"turn_white": TURN_WHITE, "turn_black": TURN_BLACK, "no_castling": NO_CASTLING, "castling": CASTLING}
)
PLANE_NAMES = [f"{side}_{name}" for side in ("white", "black") for name in ("pawn", "knight", "bishop", "rook", "queen", "king")] + ["castling", "en_passant", "turn"]


def vocabulary_map() -> Column:
    """Map of token name to id."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(TOKEN_IDS.items())])


def inverse_map(m: Column) -> Column:
    """Map with keys and values exchanged."""
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def is_piece(token: Column) -> Column:
    return token.between(FIRST_PIECE, LAST_PIECE)


def piece_symbol(token: Column) -> Column:
    """The piece letter of a token id, null for any other id."""
    return F.when(is_piece(token), F.substring(F.lit(PIECES), token.cast("int") - FIRST_PIECE + 1, F.lit(1)))
