"""Encodings of positions as column expressions: tokens, bitboards, tensors, packed bytes.

Square 0 is a1, 1 is b1, 63 is h8.  All functions stay in the JVM but
``legal_en_passant``, which needs the move rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rookery.functions import vocabulary as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    What a lambda of a higher-order function mentions is computed anew for
    each element, unless it is itself a lambda's variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fen_field(fen: Column, k: int) -> Column:
    return F.get(F.split(F.trim(fen), r"\s+"), F.lit(k))


def fen_squares(fen: Column) -> Column:
    """64 characters from a1 to h8; an empty square is a dot."""
    ranks = F.array_join(F.reverse(F.split(fen_field(fen, 0), "/")), "")
    for n in range(8, 0, -1):
        ranks = F.replace(ranks, F.lit(str(n)), F.lit("." * n))
    return ranks


def square_tokens(fen: Column) -> Column:
    return F.transform(F.split(fen_squares(fen), ""), lambda c: F.when(c == ".", F.lit(V.EMPTY)).otherwise(F.instr(F.lit(V.PIECES), c) + V.EMPTY + 1))


def castling_flags(fen: Column) -> Column:
    """Array of the WK, WQ, BK, BQ rights, each only with king and rook at home."""
    return let(fen_squares(fen), lambda squares: _rights(squares, F.coalesce(fen_field(fen, 2), F.lit("-"))))


def _rights(squares: Column, letters: Column) -> Column:
    def at(square: int, piece: str) -> Column:
        return F.substring(squares, square + 1, 1) == piece

    homes = [("K", 4, "K", 7, "R"), ("Q", 4, "K", 0, "R"), ("k", 60, "k", 63, "r"), ("q", 60, "k", 56, "r")]
    return F.array(*[F.contains(letters, F.lit(letter)) & at(king, k) & at(rook, r) for letter, king, k, rook, r in homes])


def white_to_move(fen: Column) -> Column:
    return F.coalesce(fen_field(fen, 1), F.lit("w")) == "w"


def fen_to_tokens(fen: Column) -> Column:
    """Token sequence of 69 bytes: squares, turn, castling WK, WQ, BK, BQ."""
    turn = F.when(white_to_move(fen), V.TURN_WHITE).otherwise(V.TURN_BLACK)
    rights = F.transform(castling_flags(fen), lambda f: F.when(f, V.CASTLING).otherwise(V.NO_CASTLING))
    return F.concat(square_tokens(fen), F.array(turn), rights).cast("array<tinyint>")


def checked_length(a: Column, n: int, what: str) -> Column:
    """``a``, or an error if it has not ``n`` elements."""
    return F.when(F.size(a) == n, a).otherwise(F.raise_error(F.concat(F.lit(f"{what}: expected {n} elements, got "), F.size(a).cast("string"))))


def _placement(symbols: Column) -> Column:
    """FEN placement of 64 one-character strings."""
    board = let(symbols, lambda s: F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda r: F.array_join(F.slice(s, r * 8 + 1, 8), "")), "/"))
    for n in range(8, 0, -1):
        board = F.replace(board, F.lit("." * n), F.lit(str(n)))
    return board


def _fen(symbols: Column, white: Column, rights: list[Column], en_passant: Column | None = None) -> Column:
    letters = F.concat(*[F.when(r, F.lit(c)).otherwise(F.lit("")) for c, r in zip("KQkq", rights)])
    ep = F.coalesce(en_passant, F.lit("-")) if en_passant is not None else F.lit("-")
    return F.concat_ws(" ", _placement(symbols), F.when(white, F.lit("w")).otherwise(F.lit("b")), F.when(letters == "", F.lit("-")).otherwise(letters), ep, F.lit("0"), F.lit("1"))


def tokens_to_fen(tokens: Column) -> Column:
    def fen(t: Column) -> Column:
        symbols = F.transform(F.slice(t, 1, V.SQUARES), lambda x: F.coalesce(V.piece_symbol(x), F.lit(".")))
        return _fen(symbols, F.get(t, F.lit(64)) == V.TURN_WHITE, [F.get(t, F.lit(65 + k)) == V.CASTLING for k in range(4)])

    return let(checked_length(tokens, V.TOKENS, "token sequence"), fen)


def tokens_to_bitboard(tokens: Column) -> Column:
    """773 booleans: 12 planes of 64 squares, turn, castling WK, WQ, BK, BQ."""

    def bits(t: Column) -> Column:
        planes = F.flatten(F.transform(F.sequence(F.lit(V.FIRST_PIECE), F.lit(V.LAST_PIECE)), lambda p: F.transform(F.slice(t, 1, V.SQUARES), lambda x: x == p)))
        return F.concat(planes, F.array(F.get(t, F.lit(64)) == V.TURN_WHITE, *[F.get(t, F.lit(65 + k)) == V.CASTLING for k in range(4)]))

    return let(tokens, bits)


def fen_to_bitboard(fen: Column) -> Column:
    return tokens_to_bitboard(fen_to_tokens(fen))


def _plane_symbol(bit: Callable[[Column, int], Column], square: Column) -> Column:
    return F.coalesce(*[F.when(bit(square, p), F.lit(c)) for p, c in enumerate(V.PIECES)], F.lit("."))


def bitboard_to_fen(bits: Column, compat_castling_swap: bool = False) -> Column:
    """FEN of a bitboard (longer, padded ones are cut to 773 bits).

    ``compat_castling_swap`` reads the castling bits in the order Q, K, q, k,
    as a known faulty decoder does.
    """
    order = (1, 0, 3, 2) if compat_castling_swap else (0, 1, 2, 3)

    def fen(b: Column) -> Column:
        symbols = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda s: _plane_symbol(lambda q, p: F.get(b, q + 64 * p), s))
        return _fen(symbols, F.get(b, F.lit(768)), [F.get(b, F.lit(769 + k)) for k in order])

    return let(checked_length(F.slice(bits, 1, V.BITBOARD_BITS), V.BITBOARD_BITS, "bitboard"), fen)


def fen_to_tensor(fen: Column, en_passant: Column | None = None) -> Column:
    """960 booleans, index ``(rank * 8 + file) * 15 + plane``.

    ``en_passant`` is the square (0-63) of a legal en-passant capture, or null.
    """
    ep = F.lit(None).cast("int") if en_passant is None else en_passant.cast("int")
    known = F.struct(square_tokens(fen).alias("tokens"), castling_flags(fen).alias("rights"), white_to_move(fen).alias("white"), ep.alias("ep"))
    corners = ((7, 0), (0, 1), (63, 2), (56, 3))

    def cell(i: Column, k: Column) -> Column:
        square, plane = (i / V.PLANES).cast("int"), i % V.PLANES
        right = F.coalesce(*[F.when(square == at, F.get(k["rights"], F.lit(flag))) for at, flag in corners], F.lit(False))
        return (
            F.when(plane < 12, F.get(k["tokens"], square) == plane + V.FIRST_PIECE)
            .when(plane == 12, right)
            .when(plane == 13, F.coalesce(square == k["ep"], F.lit(False)))
            .otherwise((square == 0) & k["white"])
        )

    return let(known, lambda k: F.transform(F.sequence(F.lit(0), F.lit(V.TENSOR_CELLS - 1)), lambda i: cell(i, k)))


def tensor_to_fen(tensor: Column, threshold: float = 0.5) -> Column:
    """FEN of 960 booleans or numbers; numbers are set where above ``threshold``."""

    def fen(b: Column) -> Column:
        symbols = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda s: _plane_symbol(lambda q, p: F.get(b, q * V.PLANES + p), s))
        set_ep = F.get(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda s: F.get(b, s * V.PLANES + 13)), F.lit(0))
        rights = [F.get(b, F.lit(square * V.PLANES + 12)) for square in (7, 0, 63, 56)]
        return _fen(symbols, F.get(b, F.lit(14)), rights, square_name(set_ep))

    return let(checked_length(binarised(tensor.cast("array<double>"), threshold), V.TENSOR_CELLS, "tensor"), fen)


def nested_tensor(tensor: Column) -> Column:
    """``array[8][8][15]`` view of a flat tensor."""
    eight = F.sequence(F.lit(0), F.lit(7))
    return let(tensor, lambda t: F.transform(eight, lambda r: F.transform(eight, lambda f: F.slice(t, (r * 8 + f) * V.PLANES + 1, V.PLANES))))


def plane(tensor: Column, k: int) -> Column:
    """The 64 cells of one plane."""
    return F.filter(tensor, lambda _, i: i % V.PLANES == k)


def planes_by_name(tensor: Column) -> Column:
    """Map of plane name to its 64 cells."""
    return F.create_map(*[x for k, name in enumerate(V.PLANE_NAMES) for x in (F.lit(name), plane(tensor, k))])


def square_name(square: Column) -> Column:
    """``e3`` for 20; null for null."""
    return F.concat(F.substring(F.lit("abcdefgh"), (square % 8 + 1).cast("int"), F.lit(1)), (F.floor(square / 8) + 1).cast("string"))


def legal_en_passant(fen: Column) -> Column:
    """The en-passant square (0-63) if a legal capture there exists, else null; an Arrow function over the move rules."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def squares(fens):
        import pandas as pd

        from rookery.functions.board_rules import Board

        def one(text):
            if text is None or len(text.split()) < 4 or text.split()[3] == "-":
                return None
            return Board.from_fen(text).legal_en_passant()

        return pd.Series([one(f) for f in fens], dtype="Int32")

    return squares(fen)


def binarised(a: Column, threshold: float = 0.5) -> Column:
    """Elements strictly above ``threshold``."""
    return F.transform(a, lambda x: x > threshold)


def padded(bits: Column, multiple: int = 8) -> Column:
    """Booleans followed by falses up to a multiple of ``multiple``."""
    return let(bits, lambda b: F.concat(b, F.array_repeat(F.lit(False), F.pmod(-F.size(b), F.lit(multiple)))))


def pack_bits(bits: Column) -> Column:
    """Booleans as bytes, first bit highest, zero-padded at the end."""
    def hexed(b: Column) -> Column:
        byte_at = lambda i: F.aggregate(F.slice(b, i * 8 + 1, 8), F.lit(0), lambda s, x: s * 2 + x.cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), (F.size(b) / 8).cast("int") - 1), lambda i: F.lpad(F.hex(byte_at(i)), 2, "0")), "")

    return F.when(F.size(bits) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(let(padded(bits), hexed)))


def unpack_bits(packed: Column, n: int | None = None) -> Column:
    """Bytes as booleans, cut to ``n`` bits."""
    digits = F.split(F.hex(packed), "")
    bits = F.flatten(F.transform(digits, lambda d: F.transform(F.split(F.lpad(F.conv(d, 16, 2), 4, "0"), ""), lambda b: b == "1")))
    bits = F.when(F.length(packed) == 0, F.expr("cast(array() as array<boolean>)")).otherwise(bits)
    return bits if n is None else F.slice(bits, 1, n)


def bit_words(bits: Column) -> Column:
    """Booleans as signed 64-bit words, first bit highest, for Hamming distances."""
    def words(b: Column) -> Column:
        word = lambda i: F.aggregate(F.slice(b, i * 64 + 1, 64), F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x.cast("bigint")))
        return F.transform(F.sequence(F.lit(0), (F.size(b) / 64).cast("int") - 1), word)

    return let(padded(bits, 64), words)


def vector_key(vector: Column) -> Column:
    """A key that is equal for equal vectors."""
    return F.md5(F.to_json(vector))


#: Name -> (FEN to encoding, encoding to FEN, shape).
ENCODERS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], tuple[int, ...]]] = {}


def register_encoder(name: str, encode: Callable[[Column], Column], decode: Callable[[Column], Column], shape: tuple[int, ...]) -> None:
    ENCODERS[name] = (encode, decode, shape)


def get_encoder(name: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column], tuple[int, ...]]:
    if name not in ENCODERS:
        raise ValueError(f"unknown encoding {name!r}; known: {sorted(ENCODERS)}")
    return ENCODERS[name]


register_encoder("token_sequence", fen_to_tokens, tokens_to_fen, (V.TOKENS,))
register_encoder("bitboard", fen_to_bitboard, bitboard_to_fen, (V.BITBOARD_BITS,))
register_encoder("tensor", fen_to_tensor, tensor_to_fen, (8, 8, V.PLANES))


def board_text(fen: Column) -> Column:
    """Eight lines from rank 8 to rank 1, squares parted by blanks."""
    ranks = lambda squares: F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda r: F.array_join(F.slice(squares, r * 8 + 1, 8), " "))
    return F.array_join(let(F.split(fen_squares(fen), ""), ranks), "\n")


def marked_difference(text: Column, predicted: Column, mark: str = "*") -> Column:
    """``predicted`` with every character that differs from ``text`` followed by a mark."""
    return F.array_join(F.zip_with(F.split(text, ""), F.split(predicted, ""), lambda a, b: F.when(a.eqNullSafe(b), b).otherwise(F.concat(F.coalesce(b, F.lit("")), F.lit(mark)))), "")


def side_by_side(fen: Column, predicted_fen: Column, mark: str = "*") -> Column:
    """The lines of two boards beside each other, differences of the second one marked."""
    left, right = F.split(board_text(fen), "\n"), F.split(board_text(predicted_fen), "\n")
    return F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, F.lit("   "), marked_difference(a, b, mark))), "\n")
