"""Encodings, move rules and game files."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rookery.functions import encoding as E
from rookery.functions import vocabulary as V
from rookery.functions.board_rules import START_FEN, Board, IllegalMove, perft, random_board
from rookery.sources import games as G
from rookery.sources.literals import NAMED_POSITIONS, named_positions, names_by_vector

DEBUG_TOKENS = (
    "20 15 15 21 15 22 18 20 15 19 15 15 15 17 17 17 15 15 15 15 17 15 15 15 17 25 19 17 15 15 15 15 "
    "23 18 15 15 15 15 15 15 24 27 15 15 23 24 15 15 15 23 15 25 15 23 23 23 26 15 15 15 28 15 15 26 29 31 31 32 32"
)
EXTRA = {
    "start": START_FEN,
    "only_K": "r3k2r/8/8/8/8/8/8/R3K2R w K - 0 1",
    "only_Q": "r3k2r/8/8/8/8/8/8/R3K2R w Q - 0 1",
    "only_k": "r3k2r/8/8/8/8/8/8/R3K2R b k - 0 1",
    "only_q": "r3k2r/8/8/8/8/8/8/R3K2R b q - 0 1",
    "legal_ep": "4k3/8/8/3pP3/8/8/8/4K3 w - d6 0 2",
    "ep_without_capture": "4k3/8/8/3p4/8/8/4P3/4K3 w - d6 0 2",
    "pinned_ep": "8/8/8/K2pP2r/8/8/8/4k3 w - d6 0 2",
    "rook_away": "r3k3/8/8/8/8/8/8/R3K3 w KQkq - 0 1",
    "empty": "8/8/8/8/8/8/8/8 w - - 0 1",
}


def boards(spark, named=None):
    return spark.createDataFrame(list((named or NAMED_POSITIONS | EXTRA).items()), "name string, fen string")


def fen_core(fen, rights=None):
    fields = fen.split()
    return " ".join([fields[0], fields[1], fields[2] if rights is None else rights, "-", "0", "1"])


def test_debug_board_tokens(spark):
    got = named_positions(spark).filter("name = 'debug_board'").select(E.fen_to_tokens(F.col("fen"))).first()[0]
    assert list(got) == [int(x) for x in DEBUG_TOKENS.split()]


@pytest.mark.parametrize("name", sorted(E.ENCODERS))
def test_round_trips(spark, name):
    encode, decode, _ = E.get_encoder(name)
    rows = boards(spark).withColumn("e", encode(F.col("fen"))).select("name", decode(F.col("e")).alias("back")).collect()
    for r in rows:
        want = (NAMED_POSITIONS | EXTRA)[r["name"]]
        assert r["back"] == fen_core(want, Board.from_fen(want).rights or "-")


def test_castling_swap_is_opt_in(spark):
    bits = boards(spark, {"k": EXTRA["only_K"]}).select(E.fen_to_bitboard(F.col("fen")).alias("b"))
    row = bits.select(E.bitboard_to_fen(F.col("b")).alias("good"), E.bitboard_to_fen(F.col("b"), compat_castling_swap=True).alias("swapped")).first()
    assert row["good"].split()[2] == "K" and row["swapped"].split()[2] == "Q"


def test_tensor_layout_and_en_passant(spark):
    rows = boards(spark).withColumn("ep", E.legal_en_passant(F.col("fen"))).withColumn("t", E.fen_to_tensor(F.col("fen"), F.col("ep")))
    by = {r["name"]: r for r in rows.select("name", "ep", "t", E.tensor_to_fen(F.col("t")).alias("back"), E.nested_tensor(F.col("t")).alias("n")).collect()}
    assert by["legal_ep"]["ep"] == 43 and by["legal_ep"]["t"][43 * 15 + 13] and by["legal_ep"]["back"].split()[3] == "d6"
    assert by["ep_without_capture"]["ep"] is None and by["pinned_ep"]["ep"] is None
    assert by["start"]["n"][0][7][12] and by["start"]["n"][0][0][14] and not by["start"]["n"][3][3][14]
    assert len(by["empty"]["t"]) == 960 and sum(by["empty"]["t"]) == 1


def test_wrong_lengths_fail(spark):
    for decode in (E.tokens_to_fen, E.bitboard_to_fen, E.tensor_to_fen):
        with pytest.raises(Exception, match="expected"):
            spark.range(1).select(decode(F.array(F.lit(True), F.lit(False)) if decode is not E.tokens_to_fen else F.array(F.lit(1))).alias("x")).collect()
    with pytest.raises(ValueError, match="unknown encoding"):
        E.get_encoder("nothing")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.booleans(), max_size=80))
def test_packing_round_trip(spark, bits):
    import numpy as np

    df = spark.createDataFrame([(bits,)], "b array<boolean>")
    row = df.select(E.pack_bits(F.col("b")).alias("p"), E.unpack_bits(E.pack_bits(F.col("b")), len(bits)).alias("u")).first()
    assert bytes(row["p"]) == np.packbits(np.array(bits, bool)).tobytes()
    assert list(row["u"]) == bits


def test_vocabulary_and_names(spark):
    m = spark.range(1).select(V.inverse_map(V.vocabulary_map()).alias("m"), V.piece_symbol(F.lit(22)).alias("k"), V.piece_symbol(F.lit(15)).alias("none")).first()
    assert m["m"][28] == "k" and m["m"][15] == "empty" and m["k"] == "K" and m["none"] is None
    named = boards(spark, {"a": START_FEN, "b": START_FEN, "c": EXTRA["empty"]}).withColumn("v", E.fen_to_tokens(F.col("fen")))
    assert sorted(r["names"] for r in names_by_vector(named, "v").collect()) == [["a", "b"], ["c"]]


def test_rendering(spark):
    row = boards(spark, {"s": START_FEN}).select(E.board_text(F.col("fen")).alias("t"), E.side_by_side(F.col("fen"), F.lit(START_FEN.replace("P", "p", 1))).alias("d"), E.planes_by_name(E.fen_to_tensor(F.col("fen"))).alias("p")).first()
    assert row["t"].split("\n")[7] == "R N B Q K B N R" and row["d"].split("\n")[6].endswith("p* P P P P P P P")
    assert sum(row["p"]["white_pawn"]) == 8 and row["p"]["turn"][0]


PERFT = [
    (START_FEN, [20, 400, 8902]),
    ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", [48, 2039]),
    ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", [14, 191, 2812]),
    ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", [6, 264]),
]


@pytest.mark.parametrize(("fen", "counts"), PERFT)
def test_move_counts(fen, counts):
    assert [perft(Board.from_fen(fen), d + 1) for d in range(len(counts))] == counts


def test_move_text():
    b = Board.from_fen("4k3/P7/8/8/8/8/8/R3K2R w KQ - 0 1")
    for san in ("a8", "Ke3", "O-O-O-O", "Nf3", ""):
        with pytest.raises(IllegalMove):
            b.find_san(san)
    b.push_san("a8=Q+")
    assert b.squares[56] == "Q" and Board.from_fen(b.fen()).fen() == b.fen()
    two = Board.from_fen("4k3/8/8/8/8/8/8/R3K2R w KQ - 0 1")
    with pytest.raises(IllegalMove):
        Board.from_fen("4k3/8/8/8/R6R/8/8/4K3 w - - 0 1").find_san("Rd4")
    two.push_san("0-0-0")
    assert two.squares[2] == "K" and two.squares[3] == "R"


def test_random_boards_are_legal():
    for seed in range(50):
        b = random_board(random.Random(seed), 5)
        assert b.valid() and 3 <= 64 - b.squares.count(".") <= 7


def test_games(spark, tmp_path):
    from rookery.catalogue import GAME_TEXT

    (tmp_path / "a.pgn").write_bytes(GAME_TEXT.replace("\n", "\r\n").encode())
    (tmp_path / "b.txt").write_text("[Event \"no\"]\n")
    assert G.list_files(spark, str(tmp_path), ".pgn").count() == 1 and G.read_binary(spark, str(tmp_path)).count() == 1
    parsed = G.parsed_games(G.read_games(spark, str(tmp_path)).select("game_text"))
    by = {r["event"]: r for r in parsed.collect()}
    assert set(by) == {"First", "Second", "Third", "Fourth"}
    assert list(by["First"]["moves"]) == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6", "O-O", "Nf6", "Re1"]
    assert by["First"]["white_elo"] == 2500 and by["Second"]["white_elo"] is None and by["Fourth"]["white_elo"] is None
    replay = G.replayed(parsed)
    assert [r["error"] for r in G.bad_records(replay).collect()] == ["illegal move Ke3"]
    last = G.positions(replay).filter(F.col("game_id") == by["First"]["game_id"]).orderBy(F.desc("ply")).first()
    assert last["fen"].startswith("r1bqkb1r/1ppp1ppp/p1n2n2/1B2p3/4P3/5N2/PPPP1PPP/RNBQR1K1 b kq -")
    promoted = G.positions(replay).filter(F.col("game_id") == by["Second"]["game_id"]).orderBy(F.desc("ply")).first()
    assert promoted["fen"].split()[0].startswith("rQbqkbnr")
    stats = {r["reason"]: r["n"] for r in G.discard_statistics(parsed, replay, 42).collect()}
    assert stats["illegal move"] == 1 and stats["no moves"] == 1


def test_deep_variations_and_bad_starts(spark):
    """Variations of any depth are left out; a start that no game can have ends it with an error row."""
    deep = "(1. d4 " * 9 + ")" * 9
    text = f'[Event "a"]\n\n1. e4 {deep} e5 (2. c4) 2. Nf3 *'
    bad = '[Event "b"]\n[FEN "P3k3/8/8/8/8/8/8/4K3 w - - 0 1"]\n\n1. b8 *'
    parsed = G.parsed_games(G.games_from_text(spark.createDataFrame([(text + "\n\n" + bad,)], "text string"), "text"))
    moves = {r["event"]: r["moves"] for r in parsed.collect()}
    assert moves["a"] == ["e4", "e5", "Nf3"]
    errors = [(r["san"], r["fen"], r["error"]) for r in G.bad_records(G.replayed(parsed)).collect()]
    assert errors == [(None, None, "bad start P3k3/8/8/8/8/8/8/4K3 w - - 0 1")]
