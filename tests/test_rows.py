"""Sampling, splits, masks, batches, windows, shards, metrics, plans, streams."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rookery.functions import metrics as M
from rookery.functions import sampling as S
from rookery.functions.encoding import fen_to_tokens, fen_to_tensor
from rookery.operators import batches as B
from rookery.plans.positions import PositionDataset, TrainingReader, write_position_shard
from rookery.plans.settings import DatasetSettings, EncoderSettings, PreprocessingSettings, SamplingFilters
from rookery.sources import shards
from rookery.sources.literals import named_positions


def test_hash_uniform(spark):
    assert spark.range(7, 8).select(S.hash_uniform(1, "id").alias("u")).first()["u"] == int(__import__("hashlib").md5(b"1:7").hexdigest()[:8], 16) / 2**32
    n = 20_000
    kept = spark.range(n).filter(S.elo_gate(S.hash_uniform(3, "id"), F.lit(2100), F.lit(2400))).count()
    p = 1 / (1 + math.exp(-0.5))
    assert abs(kept / n - p) < 4 * math.sqrt(p * (1 - p) / n)
    plies = spark.range(n).filter(S.ply_gate(S.hash_uniform(4, "id"), F.lit(450))).count()
    assert abs(plies / n - 0.165) < 4 * math.sqrt(0.165 * 0.835 / n)
    assert spark.range(n).filter(S.ply_gate(S.hash_uniform(4, "id"), F.lit(0))).count() == 0
    with pytest.raises(ValueError, match="ply mode"):
        S.ply_probability(F.lit(1), mode="cubed")


def test_parse_elo(spark):
    rows = spark.createDataFrame([("2500",), ("?",), ("",), (None,)], "e string").select(S.parse_elo(F.col("e")).alias("a"), S.parse_elo(F.col("e"), None).alias("b")).collect()
    assert [tuple(r) for r in rows] == [(2500, 2500), (1500, None), (1500, None), (1500, None)]


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 60), st.sampled_from([0.5, 0.9, 0.33]))
def test_split_sizes(spark, n, ratio):
    got = {r["split"]: r["n"] for r in S.split_sequential(spark.range(n), ["id"], ratio).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got.get("train", 0) == int(n * ratio) and sum(got.values()) == n


def test_split_in_blocks_and_rows(spark):
    rows = spark.range(100).withColumn("b", F.col("id") % 3)
    got = S.split_sequential(rows, ["id"], 0.9, block=["b"]).filter("split = 'train'").groupBy("b").count().collect()
    assert sorted((r["b"], r["count"]) for r in got) == [(0, 30), (1, 29), (2, 29)]
    numbered, n = S.global_rows(rows.repartition(5), ["id"])
    assert n == 100 and numbered.filter("row != id").count() == 0
    assert S.shuffled(rows, 1, 0, ["id"]).collect() != S.shuffled(rows, 1, 1, ["id"]).collect()
    assert [r["id"] for r in S.limited(rows, 2, ["id"]).collect()] == [0, 1]


@pytest.mark.parametrize("k", [0, 1, 10, 69])
def test_token_masks(spark, k):
    rows = named_positions(spark).select(F.col("name").alias("id"), fen_to_tokens(F.col("fen")).alias("t"))
    for r in B.reconstruction_pairs(rows, "t", k=k).collect():
        assert sum(a != b for a, b in zip(r["x"], r["y"])) == k and all(a in (16, b) for a, b in zip(r["x"], r["y"]))
    with pytest.raises(ValueError, match="unknown mode"):
        B.reconstruction_pairs(rows, "t", mode="other")


def test_square_masks_and_epochs(spark):
    rows = named_positions(spark).select(F.col("name").alias("id"), fen_to_tensor(F.col("fen")).cast("array<int>").alias("t"))
    a, b = (B.reconstruction_pairs(rows, "t", "tensor", 10, epoch=e).orderBy("id").collect() for e in (0, 1))
    for r in a:
        masked = [s for s in range(64) if all(v == 16 for v in r["x"][s * 15 : s * 15 + 15])]
        assert len(masked) == 10 and max(r["y"]) == 1
    assert [r["x"] for r in a] != [r["x"] for r in b]


def test_batches(spark):
    rows = spark.range(25)
    assert tuple(B.batch_count(rows, 10).first()) == (25, 3)
    assert [r["id"] for r in B.batch(rows, ["id"], 10, 2).orderBy("id").collect()] == [20, 21, 22, 23, 24]
    grouped = B.grouped_batches(B.with_batch_ids(rows, ["id"], 10), ["id"]).orderBy("batch_id").collect()
    assert [r["n"] for r in grouped] == [10, 10, 5] and grouped[0]["rows"][0]["id"] == 0
    twice = B.apply_model(rows, lambda f: f.assign(y=f["id"] * 2)[["y"]], ["id"], "y long")
    assert twice.agg(F.sum("y")).first()[0] == 600


def test_windows_and_pairs(spark):
    rows = spark.createDataFrame([(g, i, 10 * g + i) for g in (0, 1) for i in range(4)], "g int, ply int, id int")
    w = B.temporal_windows(rows, "g", ["ply"], ["id"], 3)
    assert w.count() == 4
    assert B.ply_distances(rows, "g", "ply", "id", 2).count() == 2 * (3 + 2)
    assert B.future(rows, "g", ["ply"], "id", 3).filter("future is not null").count() == 2
    same = rows.withColumn("k", F.lit("x"))
    assert [tuple(r) for r in B.transpositions(same, "g", "k").collect()] == [("x", 0, 1)]


@pytest.mark.parametrize("bucket_rows", [3, 40, 10_000])
def test_every_row_gets_a_negative(spark, bucket_rows):
    """One game holds 80 % of the rows; null is a game of its own; a table of one game has none."""
    games = {i: (None if i % 50 == 0 else 1 if i % 5 else i % 7 + 2) for i in range(400)}
    rows = spark.createDataFrame(list(games.items()), "id int, g int")
    pairs = B.negatives(rows, "g", "id", bucket_rows=bucket_rows).collect()
    assert sorted(p["id"] for p in pairs) == sorted(games) and all(games[p["id"]] != games[p["negative"]] for p in pairs)
    if bucket_rows == 10_000:  # one game's rows do not all get the same negative
        assert len({p["negative"] for p in pairs if games[p["id"]] == 1}) > 20
    assert B.negatives(rows.filter("g = 1"), "g", "id").count() == 0 and B.negatives(rows.limit(0), "g", "id").count() == 0


def test_transpositions_of_one_position(spark):
    rows = spark.range(500).select(F.lit("x").alias("k"), (F.col("id") % 100).alias("g"))
    chain = sorted(map(tuple, B.transpositions(rows, "g", "k").collect()))
    assert chain == [("x", g, g + 1) for g in range(99)]
    assert B.transpositions(rows.limit(0), "g", "k").count() == 0


def test_shards(spark, tmp_path):
    path = str(tmp_path / "s")
    assert shards.next_shard(spark, path) == 0
    for _ in range(2):
        shards.write_shard(S.split_sequential(spark.range(10), ["id"], 0.9), path)
    assert shards.next_shard(spark, path) == 2
    train, test = shards.read_train_test(spark, path, 1)
    assert train.count() == 9 and test.count() == 1
    assert {r["shard"] for r in shards.shard_for_epoch(spark, path, 1).collect()} == {0}
    names = spark.createDataFrame([], "name string")
    assert tuple(shards.next_number(names).first()) == (0, "000")
    row = spark.range(1).select(shards.batch_path(F.lit("train"), F.lit(7), F.lit("x"))).first()[0]
    assert row == "train/batch_0007_x.parquet"
    assert shards.tag_version(spark, path, "v1").count() == 4 or shards.read_shards(spark, path).count() == 20


def test_losses(spark):
    t, p = [0.0] * 60, [0.0] * 60
    t[0], t[16], p[0], p[31] = 1.0, 1.0, 0.5, 2.0
    df = spark.createDataFrame([(t, p), (t, t)], "t array<double>, p array<double>")
    row = df.agg(*[f(F.col("t"), F.col("p")).alias(n) for n, f in (("a", M.loss_sum_squared), ("b", M.loss_number_of_pieces), ("c", M.loss_piece_columns), ("d", M.loss_piece_planes), ("e", M.loss_regularised), ("m", M.mean_squared))]).first()
    assert row["a"] == pytest.approx((0.25 + 1 + 4) / 2) and row["c"] == pytest.approx((0.25 + 1 + 4) / 2)
    assert row["b"] == pytest.approx((4 - 4.5) ** 2 / 4.501 / 2) and row["d"] == pytest.approx((0.25 + 1) / 2)
    assert row["e"] == pytest.approx(row["a"] + row["b"] + 0.1 * row["c"] + 0.1 * row["d"]) and row["m"] == pytest.approx(row["a"] / 60)


def test_metrics(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([1000.0, 0.0, 0.0], 0)], "z array<double>, label int")
    got = df.select(M.argmax(F.col("z")).alias("a"), M.cross_entropy(F.col("z"), F.col("label")).alias("ce"), M.softmax(F.col("z")).alias("s")).collect()
    assert got[0]["a"] == 1 and got[0]["ce"] == pytest.approx(math.log(2 + math.exp(-2))) and got[1]["ce"] == 0
    assert sum(got[0]["s"]) == pytest.approx(1)
    assert df.select(M.mismatches(F.col("z"), F.array(F.lit(1.0), F.lit(0.0), F.lit(3.0)))).collect()[0][0] == 1
    assert df.select(M.positions_where(F.col("z"), lambda x: x > 2)).first()[0] == [1, 2]
    log = spark.createDataFrame([(e, 0.5) for e in range(25)], "epoch int, metric double")
    curve = M.training_rules(log).collect()
    assert not curve[17]["stop"] and curve[-1]["stop"] and curve[5]["rate"] == pytest.approx(3e-4)
    assert [r["id"] for r in B.worst_samples(spark.range(40).withColumn("loss", F.col("id")), "loss", 2, "id").collect()] == [19, 18]


def test_position_plan(spark, tmp_path):
    from rookery.catalogue import GAME_TEXT

    games = tmp_path / "games"
    games.mkdir()
    for k in range(3):
        (games / f"{k}.pgn").write_text("\n".join(re.sub(r'\[Event "(\w+)', rf'[Event "\1 {k} {g}', GAME_TEXT) for g in range(80)))
    settings_ = PreprocessingSettings(SamplingFilters(min_elo=0, subsample_rate=1.0, ply_mode="squared"), seed=1)
    out = str(tmp_path / "out")
    data = PositionDataset(spark, DatasetSettings("demo", str(games), out, batch_size=4, train_ratio=0.5), settings_)
    dry = list(data.generate(1, dry_run=True))
    assert len(dry) == 1 and data.next_batch_number() == 0
    n = data.encoded().count()
    done = list(data.generate())
    assert len(done) == -(-n // 4) and data.next_batch_number() == len(done)
    reader = TrainingReader(spark, out, encoder=EncoderSettings(window_size=1))
    total = reader.rows().count() + reader.with_split("test").rows().count()
    assert total == n
    row = reader.with_masking(5).rows().first()
    assert sum(a != b for a, b in zip(row["x"], row["y"])) == 5
    assert reader.with_transformation(lambda d: d.limit(1)).next_epoch().rows().count() == 1
    assert len(reader.windows().first()["window"][0]) == 69
    assert "token_sequence" in data.card()
    assert write_position_shard(spark, str(games), str(tmp_path / "shards"), preprocessing=settings_) == 0
    for bad in (lambda: SamplingFilters(subsample_rate=0), lambda: DatasetSettings("", "a", "b"), lambda: EncoderSettings("x"), lambda: DatasetSettings("a", "b", "c", train_ratio=1.0)):
        with pytest.raises(ValueError):
            bad()


def test_streams(spark, tmp_path):
    from rookery.catalogue import GAME_TEXT
    from rookery.operators.store import VectorStore
    from rookery.sources.synthetic import synthetic_vectors
    from rookery.streaming.ingest import ingest_games, ingest_vectors, vector_stream

    source = str(tmp_path / "in")
    store = VectorStore(spark, str(tmp_path), "streamed", overwrite=True)
    for first in (0, 5):
        synthetic_vectors(spark, 10, 4).filter(F.col("id") >= first).coalesce(1).write.mode("append").parquet(source)
        ingest_vectors(vector_stream(spark, source), store, str(tmp_path / "cp")).awaitTermination()
    assert store.num_entities() == 10
    games = tmp_path / "g"
    games.mkdir()
    (games / "a.pgn").write_text(GAME_TEXT)
    ingest_games(spark, str(games), str(tmp_path / "pos"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "pos")).filter("error is null").count() == 20
