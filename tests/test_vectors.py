"""Search, store, inverted file, encoders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.functions.encoders import LayeredEncoder, RandomProjection, encode_with, get_model, pca
from rookery.operators import inverted_file, search
from rookery.operators.store import VectorStore
from rookery.sources.synthetic import synthetic_entities, synthetic_vectors


def brute(rows, q, k):
    d = [(round(float(((np.array(v) - np.array(q)) ** 2).sum()), 9), i) for i, v in rows]
    return [i for _, i in sorted(d)[:k]]


@pytest.mark.parametrize("kind", ["float", "binary"])
def test_insert_and_search(spark, tmp_path, kind):
    """Rows in two shapes, a default index, two queries, five hits each: the true nearest."""
    data = synthetic_vectors(spark, 42, 128, kind).collect()
    convert = list if kind == "float" else bytes
    store = VectorStore(spark, str(tmp_path), "t", kind, 128, overwrite=True)
    store.insert([[r["id"] for r in data[:20]], [convert(r["embedding"]) for r in data[:20]]])
    store.insert([{"id": r["id"], "embedding": convert(r["embedding"])} for r in data[20:40]])
    assert store.num_entities() == 40
    assert store.create_default_index().endswith("_1024")
    queries = [convert(r["embedding"]) for r in data[40:]]
    hits = store.search(queries, top_k=5, nprobe=1024).orderBy("query_id", "rank").collect()
    assert len(hits) == 10 and hits[0].__fields__ == ["query_id", "rank", "id", "distance", "embedding"]
    stored = {r["id"]: convert(r["embedding"]) for r in data[:40]}
    for q in (0, 1):
        mine = [h for h in hits if h["query_id"] == q]
        assert all(convert(h["embedding"]) == stored[h["id"]] for h in mine)
        if kind == "float":
            assert [h["id"] for h in mine] == brute(stored.items(), queries[q], 5)
        else:
            bits = {i: np.unpackbits(np.frombuffer(v, np.uint8)) for i, v in stored.items()}
            assert [h["id"] for h in mine] == brute([(i, v.astype(float)) for i, v in bits.items()], np.unpackbits(np.frombuffer(queries[q], np.uint8)).astype(float), 5)


@pytest.mark.parametrize("kind", ["float", "binary"])
def test_search_by_ids(spark, tmp_path, kind):
    data = synthetic_vectors(spark, 4, 128, kind)
    store = VectorStore(spark, str(tmp_path), "t", kind, overwrite=True)
    store.insert(data)
    want = {r["id"]: r["embedding"] for r in data.collect()}
    got = {r["id"]: r["embedding"] for r in store.search_by_ids([1, 3]).collect()}
    assert got == {i: want[i] for i in (1, 3)}


def test_store_modes(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), "m", dim=2)
    assert store.num_entities() == 0 and not store.exists()
    store.insert([{"id": 1, "embedding": [0, 1]}, {"id": 2, "embedding": [1, 1]}])
    store.insert([{"id": 1, "embedding": [5, 5]}])
    assert store.num_entities() == 3
    store.insert([{"id": 1, "embedding": [7, 7]}], mode="upsert")
    assert sorted((r["id"], list(r["embedding"])) for r in store.rows().collect()) == [(1, [7, 7]), (2, [1, 1])]
    assert [r["id"] for r in store.query("id == 2 || id in [9]").collect()] == [2]
    again = VectorStore(spark, str(tmp_path), "m", dim=2)
    assert again.num_entities() == 2
    hits = again.search([[1.0, 1.0]], top_k=1, offset=1, expr="id > 0", exact=True).collect()
    assert [(h["rank"], h["id"]) for h in hits] == [(1, 1)]
    again.delete("id == 2")
    assert again.num_entities() == 1
    with pytest.raises(Exception, match="expected 2 dimensions"):
        again.insert([{"id": 3, "embedding": [1.0]}])
    with pytest.raises(ValueError, match="vector type"):
        VectorStore(spark, str(tmp_path), "x", "text")
    with pytest.raises(ValueError, match="insert mode"):
        again.insert([], mode="other")
    assert VectorStore(spark, str(tmp_path), "m", overwrite=True).num_entities() == 0


def test_store_commits(spark, tmp_path):
    """A write leaves what is there alone; two writers of one number do not lose rows; compaction and the index are kept on disk."""
    import os

    rows = synthetic_vectors(spark, 40, 6)
    store, other = (VectorStore(spark, str(tmp_path), "c") for _ in range(2))
    store.insert(rows.filter("id < 30"))
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "c") for f in fs}
    before = files()
    taken = store.commits
    store.commits = lambda: [] if not os.path.exists(tmp_path / "c" / "commit=1") else taken()
    other.insert(rows.filter("id >= 30"))  # takes number 1
    store.commits = taken
    store.insert(rows.filter("id = 0").select("id", F.slice("embedding", 1, 2).alias("embedding")))
    assert store.commits() == [0, 1, 2] and before.items() <= files().items() and store.num_entities() == 41
    store.delete(F.size("embedding") == 2)
    store.delete([39])
    store.insert(rows.filter("id = 39"))
    store.insert(rows.filter("id in (1, 39)"), mode="upsert")
    want = sorted((r["id"], list(r["embedding"])) for r in rows.collect())
    assert sorted((r["id"], list(r["embedding"])) for r in other.rows().collect()) == want
    store.compact()
    assert sorted((r["id"], list(r["embedding"])) for r in other.rows().collect()) == want and len(store.commits()) == 1
    assert store.create_index(nlist=4) == "embedding_IVF_FLAT_L2_4"
    again = VectorStore(spark, str(tmp_path), "c")
    assert again.index_name == "embedding_IVF_FLAT_L2_4" and again.index() is not None
    query = [want[7][1]]
    assert [r["id"] for r in again.search(query, 3, 4).collect()] == [r["id"] for r in again.search(query, 3, exact=True).collect()]
    store.delete([7])
    assert again.index() is None and 7 not in [r["id"] for r in again.search(query, 3, 4).collect()]
    again.drop()
    assert not store.exists()


def test_a_probe_reads_its_cells_only(spark):
    rows = synthetic_vectors(spark, 400, 4)
    index = inverted_file.build_float(rows, nlist=10)
    q = rows.filter("id = 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    hits = inverted_file.search(index, q, 5, nprobe=2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    cells = {r["cell"] for r in index.cells.join(hits, "id").select("cell").collect()}
    assert len(cells) <= 2 and len(index.cells.inputFiles()) >= 10
    with pytest.raises(ValueError, match="cells"):
        inverted_file.build_from(rows, spark.range(70_000).select(F.col("id").cast("int").alias("cell"), F.array(F.lit(0.0)).alias("centroid")))


def test_entities_demo(spark):
    rows = synthetic_entities(spark, 300)
    q = rows.filter(search.filter_expression('pk in ["298","299"]')).select(F.col("pk").cast("int").alias("query_id"), F.col("embeddings").alias("query"))
    hits = search.knn(rows.withColumn("id", F.col("pk").cast("long")), q, 3, where=search.filter_expression("random > 0.5"), vector_col="embeddings", output_fields=("random",))
    assert hits.count() == 6 and hits.filter("random <= 0.5").count() == 0
    with pytest.raises(ValueError, match="vector type"):
        synthetic_vectors(spark, 1, 1, "text")


def test_grid_equals_broadcast(spark):
    rows = synthetic_vectors(spark, 200, 6)
    q = rows.filter("id < 50").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    for metric in ("l2", "cosine"):
        a = {(r["query_id"], r["rank"]): r["id"] for r in search.knn(rows, q, 4, metric=metric).collect()}
        b = {(r["query_id"], r["rank"]): r["id"] for r in search.knn_grid(rows, q, 4, metric=metric, query_block=7, block=30).collect()}
        assert a == b and len(a) == 200
    words = rows.select("id", F.array(search.sign_word(F.transform("embedding", lambda x: x - 0.5)), F.col("id") * 77).alias("embedding"))
    q = words.filter("id < 20").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    a, b = (df.orderBy("query_id", "rank").collect() for df in (search.knn(words, q, 3, metric="hamming"), search.knn_grid(words, q, 3, metric="hamming", query_block=7, block=30)))
    assert a == b and len(a) == 60


def test_highest_bit_of_a_word_counts_once(spark):
    """Words that differ in their sign bit: on the grid, as by broadcast, and in cells."""
    words = [(i, [w]) for i, w in enumerate((0, 1, -1, -2, -(2**63), 2**63 - 1, 5, -8))]
    rows = spark.createDataFrame(words, "id long, embedding array<bigint>")
    q = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = [(i, rank, j, d) for i, (v,) in words for rank, (d, j) in enumerate(sorted((bits(v, w), j) for j, (w,) in words)[:3], 1)]
    for hits in (search.knn(rows, q, 3, metric="hamming"), search.knn_grid(rows, q, 3, metric="hamming", query_block=3, block=3)):
        assert [tuple(r) for r in hits.orderBy("query_id", "rank").collect()] == want
    centroids = spark.createDataFrame([(0, [0]), (1, [-1])], "cell int, centroid array<bigint>")
    cells = {r["id"]: r["cell"] for r in inverted_file.build_from(rows, centroids, "hamming").cells.collect()}
    assert cells == {i: min((bits(v, c), n) for n, c in enumerate((0, -1)))[1] for i, (v,) in words}


def test_ties_and_duplicates(spark):
    rows = spark.createDataFrame([(3, [1.0]), (1, [1.0]), (2, [1.0]), (2, [1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0])], "query_id int, query array<float>")
    assert [r["id"] for r in search.knn(rows, q, 3).orderBy("rank").collect()] == [1, 2, 2]
    assert search.knn(rows.limit(0), q, 3).count() == 0


@pytest.mark.parametrize("n", [1, 3, 60])
def test_full_probe_is_exact(spark, n):
    rows = synthetic_vectors(spark, n, 5)
    q = rows.limit(5).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    index = inverted_file.build_float(rows, nlist=6)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert key(inverted_file.search(index, q, 4, nprobe=6)) == key(search.knn(rows, q, 4))
    assert inverted_file.recall(inverted_file.search(index, q, 4, nprobe=6), search.knn(rows, q, 4)).first()["recall"] == 1.0
    assert abs(inverted_file.cell_sizes(index).agg(F.sum("share")).first()[0] - 1) < 1e-9


def test_encoders(spark):
    rows = synthetic_vectors(spark, 20, 960)
    for name, size in (("vanilla_dense", 256), ("random_projection", 256)):
        model = get_model(name)
        if name == "random_projection":
            model = RandomProjection(960, 256)
        got = encode_with(rows, model, "embedding").orderBy("id").collect()
        want = model(np.array([r["embedding"] for r in rows.orderBy("id").collect()], np.float32))
        assert len(got) == 20 and np.allclose([r["embedding"] for r in got], want, atol=1e-4) and want.shape[1] == size
    heads = LayeredEncoder((8, 4), head=3, in_size=5)
    assert heads(np.ones((2, 5), np.float32)).shape == (2, 3)
    assert LayeredEncoder((4, 4), sums="residual", in_size=5)(np.ones((2, 5), np.float32)).shape == (2, 4)
    with pytest.raises(ValueError, match="unknown model"):
        get_model("nothing")
    with pytest.raises(NotImplementedError):
        get_model("cnn_dense")


def test_pca(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5)) * [5, 3, 1, 0.5, 0.1]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    got = np.array([r["components"] for r in pca(rows, "embedding").orderBy("id").collect()])
    c = x - x.mean(axis=0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_position_index(spark, tmp_path):
    from rookery.plans.position_search import position_index
    from rookery.sources.literals import NAMED_POSITIONS, named_positions

    index = position_index(spark, str(tmp_path), overwrite=True)
    assert index.insert(named_positions(spark)).count() == index.insert(named_positions(spark)).count() == len(NAMED_POSITIONS)
    assert index.bitboards.num_entities() == index.tokens.num_entities() == len(NAMED_POSITIONS)
    index.create_indexes()
    fen = NAMED_POSITIONS["game_1_catalan_opening"]
    ask = spark.createDataFrame([(1, fen)], "query_id long, fen string")
    for by in ("embedding", "bitboard", "token"):
        hits = index.search(ask, 2, by=by, nprobe=1024).collect()
        assert [h["fen"].split()[0] for h in hits] == [NAMED_POSITIONS[n].split()[0] for n in ("game_1_catalan_opening", "game_1_one_move_later")]
    with pytest.raises(ValueError, match="unknown collection"):
        index.search(ask, by="other")


def test_save_model(spark, tmp_path):
    from pyspark.ml.feature import PCA, PCAModel
    from pyspark.ml.functions import array_to_vector

    from rookery.functions.encoders import save_model

    rows = synthetic_vectors(spark, 20, 4).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    path = save_model(PCA(k=2, inputCol="x", outputCol="y").fit(rows), str(tmp_path), "pca")
    assert path.endswith("_pca") and PCAModel.load(path).getK() == 2
