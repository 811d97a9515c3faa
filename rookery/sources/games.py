"""Game files (PGN): scan, headers, moves, replay.

A file is read as text cut at games, so one large file is still split over
tasks; headers are matched in the JVM and the gate on them comes before the
replay, which is the only step in Python (Arrow batches).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.encoding import let
from rookery.functions.sampling import elo_gate, hash_uniform, parse_elo

POSITION_SCHEMA = "game_id long, ply int, san string, fen string, error string"
EVENT = "[Event "


def list_files(spark: SparkSession, directory: str, ending: str = "") -> DataFrame:
    """``path, length, modified`` of the files whose name ends with ``ending``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(directory)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def read_binary(spark: SparkSession, directory: str, ending: str = ".pgn") -> DataFrame:
    """``path, content``: whole files as bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(directory).select("path", "content")


def read_games(spark: SparkSession, directory: str | list[str], ending: str = ".pgn") -> DataFrame:
    """One row ``file, game_text`` for each game of the matching files.

    Records are cut before each Event tag at a line's start.
    """
    rows = spark.read.option("lineSep", "\n" + EVENT).option("pathGlobFilter", f"*{ending}").text(directory)
    text = F.regexp_replace("value", "\r", "")
    text = F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit(EVENT), text))
    return rows.select(F.col("_metadata.file_path").alias("file"), text.alias("game_text")).filter(F.trim("game_text") != "")


def games_from_text(df: DataFrame, text_col: str) -> DataFrame:
    """Games of texts that hold whole files, with the same result as ``read_games``."""
    cut = F.split(F.concat(F.lit("\n"), F.regexp_replace(text_col, "\r", "")), r"\n(?=\[Event )")
    return df.select(*[c for c in df.columns if c != text_col], F.explode(cut).alias("game_text")).filter(F.trim("game_text") != "")


def headers(game_text: Column) -> Column:
    """Map of header names to values; of a repeated name the first counts."""
    names, values = (F.regexp_extract_all(game_text, F.lit(r'(?m)^\s*\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]'), F.lit(k)) for k in (1, 2))
    pairs = lambda k: F.filter(F.zip_with(k, values, lambda a, b: F.struct(a.alias("k"), b.alias("v"))), lambda p, i: F.array_position(k, p["k"]) == i + 1)
    return F.map_from_entries(let(names, pairs))


def move_texts(game_text: Column) -> Column:
    """Mainline moves: headers, comments, variations, glyphs, numbers and the result are removed."""
    body = F.regexp_replace(game_text, r'(?m)^\s*\[\w+\s+"(?:[^"\\]|\\.)*"\]\s*$', " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)\{.*?\}", " "), r"(?m);.*$", " ")
    for _ in range(4):  # innermost variations first
        body = F.regexp_replace(body, r"\([^()]*\)", " ")
    # deeper ones, which are rare, by counting: a token is kept where as many variations ended as began
    tokens = F.filter(F.split(F.regexp_replace(body, r"([()])", " $1 "), r"\s+"), lambda t: t != "")
    count = lambda t, i, sign: F.size(F.filter(F.slice(t, 1, i), lambda x: x == sign))
    outside = lambda t: F.filter(t, lambda x, i: ~x.isin("(", ")") & (count(t, i, "(") <= count(t, i, ")")))
    body = F.when(F.contains(body, F.lit("(")), F.array_join(let(tokens, outside), " ")).otherwise(body)
    body = F.regexp_replace(F.regexp_replace(body, r"\$\d+", " "), r"\d+\.+", " ")
    return F.filter(F.split(F.trim(body), r"\s+"), lambda m: (m != "") & ~m.isin("1-0", "0-1", "1/2-1/2", "*", "..."))


def parsed_games(games: DataFrame) -> DataFrame:
    """``game_id, headers, white_elo, black_elo, result, opening, event, date, moves`` beside the other columns.

    ``game_id`` is a hash of the game's text, so it does not depend on the split.
    """
    out = games.withColumn("headers", headers(F.col("game_text")))
    get = lambda k: F.try_element_at("headers", F.lit(k))
    return out.select(
        *[c for c in games.columns if c != "game_text"],
        F.xxhash64("game_text").alias("game_id"),
        "headers",
        parse_elo(get("WhiteElo"), None).alias("white_elo"),
        parse_elo(get("BlackElo"), None).alias("black_elo"),
        get("Result").alias("result"),
        get("Opening").alias("opening"),
        get("Event").alias("event"),
        get("Date").alias("date"),
        move_texts(F.col("game_text")).alias("moves"),
    )


def elo_gated(games: DataFrame, seed: int, centre: float = 2000.0, default: int = 1500) -> DataFrame:
    """Games that pass the logistic gate on their own lower rating."""
    white, black = F.coalesce("white_elo", F.lit(default)), F.coalesce("black_elo", F.lit(default))
    return games.filter(elo_gate(hash_uniform(seed, "game_id"), white, black, centre))


def replayed(games: DataFrame) -> DataFrame:
    """``game_id, ply, san, fen, error``: the position after each mainline move.

    A move that is not legal ends its game with one row whose ``error`` names
    it and whose ``fen`` is null; games without moves give no row.  A ``FEN``
    header sets the start.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from rookery.functions.board_rules import START_FEN, Board, IllegalMove

        for batch in batches:
            out = []
            for game, start, moves in zip(batch["game_id"], batch["start"], batch["moves"]):
                try:
                    board = Board.from_fen(start or START_FEN)
                except (ValueError, IndexError):
                    out.append((game, 0, None, None, f"bad start {start}"))
                    continue
                for ply, san in enumerate(moves if moves is not None else []):
                    try:
                        board.push_san(san)
                    except IllegalMove:
                        out.append((game, ply, san, None, f"illegal move {san}"))
                        break
                    out.append((game, ply, san, board.fen(), None))
            yield pd.DataFrame(out, columns=["game_id", "ply", "san", "fen", "error"]).astype({"game_id": "int64", "ply": "int32"})

    return games.select("game_id", F.try_element_at("headers", F.lit("FEN")).alias("start"), "moves").mapInPandas(run, POSITION_SCHEMA)


def positions(replay: DataFrame) -> DataFrame:
    return replay.filter("error is null").drop("error")


def bad_records(replay: DataFrame) -> DataFrame:
    return replay.filter("error is not null")


def discard_statistics(games: DataFrame, replay: DataFrame, seed: int) -> DataFrame:
    """``reason, n``: games gated out, games without moves, games cut at an illegal move."""
    passed = elo_gated(games, seed).select("game_id")
    rows = games.join(passed, "game_id", "left_anti").select(F.lit("elo gate").alias("reason"))
    rows = rows.unionByName(games.filter(F.size("moves") == 0).select(F.lit("no moves").alias("reason")))
    rows = rows.unionByName(bad_records(replay).select(F.lit("illegal move").alias("reason")))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))
