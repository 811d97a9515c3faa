"""The queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.functions import encoding as E
from rookery.functions import metrics as M
from rookery.functions import sampling as S
from rookery.functions import vocabulary as V
from rookery.operators import batches as B
from rookery.operators import inverted_file, search
from rookery.sources.literals import NAMED_POSITIONS, named_positions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


#: Every search asks for the rows whose id is divisible by this.
ASKED = 50


def asked(rows: DataFrame) -> DataFrame:
    """The rows whose id is divisible by 50 as queries."""
    return rows.filter(F.col("id") % ASKED == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def six(c: Column) -> Column:
    return F.round(c, 6)


# -- search -----------------------------------------------------------------
_L2 = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i]::double - v.embedding[i]::double) ** 2))"
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::double * {b}[i]::double))"
_COSINE = f"1 - {_DOT.format(a='q.embedding', b='v.embedding')} / sqrt({_DOT.format(a='q.embedding', b='q.embedding')} * {_DOT.format(a='v.embedding', b='v.embedding')})"


def _knn_sql(distance: str, k: int, where: str = "true", columns: str = "query_id, rank, id, distance") -> str:
    return f"""
WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label AS label, {distance} AS d FROM embeddings q JOIN embeddings v ON q.vec_id % {ASKED} = 0 AND {where}),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::int AS rank, id, label, round(d, 6) AS distance FROM p)
SELECT {columns} FROM r WHERE rank <= {k}"""


@query(_knn_sql(_L2, 3))
def knn_l2_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return search.knn(rows, asked(rows), 3).withColumn("distance", six(F.col("distance")))


@query(_knn_sql(_L2, 10))
def knn_l2_batch(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return search.knn(rows, asked(rows), 10).withColumn("distance", six(F.col("distance")))


@query(_knn_sql(_L2, 5))
def knn_l2_grid(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return search.knn_grid(rows, asked(rows), 5).withColumn("distance", six(F.col("distance")))


@query(
    """
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::int) AS s FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_sum(list_transform(range(1, len(q.s) + 1), lambda i: abs(q.s[i] - v.s[i])))::int AS distance FROM b q JOIN b v ON q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::int AS rank, id, distance FROM p)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10"""
)
def knn_hamming_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("embedding", F.array(search.sign_word(F.col("embedding"))))
    return search.knn(rows, asked(rows), 10, metric="hamming")


@query(_knn_sql(_L2, 5, "v.label = 3"))
def knn_hybrid_filter(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return search.knn(rows, asked(rows), 5, where=F.col("label") == 3).withColumn("distance", six(F.col("distance")))


@query(_knn_sql(_COSINE, 5))
def knn_cosine_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return search.knn(rows, asked(rows), 5, metric="cosine").withColumn("distance", six(F.col("distance")))


@query(f"SELECT query_id, string_agg(rank || ':' || id, ',' ORDER BY rank) AS hits FROM ({_knn_sql(_L2, 5)}) GROUP BY query_id")
def knn_nested_hits(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    hits = search.nested(search.knn(rows, asked(rows), 5))
    return hits.select("query_id", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["rank"], h["id"])), ",").alias("hits"))


@query(_knn_sql(_L2, 5, columns="query_id, rank, id, distance, label"))
def search_then_lookup(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    hits = search.knn(rows, asked(rows), 5).withColumn("distance", six(F.col("distance")))
    return search.lookup_hits(hits, rows.select("id", "label"))


@query(_knn_sql(_L2, 10))
def ivf_full_probe(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    index = inverted_file.build_float(rows, nlist=8)
    return inverted_file.search(index, asked(rows), 10, nprobe=8).withColumn("distance", six(F.col("distance")))


_NEAREST = f"list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::double - c.embedding[i]::double) ** 2))"


@query(
    f"""WITH c AS (SELECT vec_id AS cell, embedding FROM embeddings WHERE vec_id < 16),
d AS (SELECT e.vec_id, c.cell, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_NEAREST}, c.cell) AS place FROM embeddings e JOIN c ON true),
x AS ({_knn_sql(_L2, 10)}),
f AS (SELECT x.query_id, x.id, p.cell FROM x JOIN d a ON a.vec_id = x.id AND a.place = 1 LEFT JOIN d p ON p.vec_id = x.query_id AND p.place <= 13 AND p.cell = a.cell)
SELECT count(*) AS n_exact, count(cell) AS n_found, count(cell) / count(*) AS recall FROM f"""
)
def ivf_probe_recall(spark, sf_dir):
    """Recall of 13 of 16 cells around given centroids; vectors without structure need as many for 0.9."""
    rows = vectors(spark, sf_dir)
    centroids = rows.filter("id < 16").select(F.col("id").cast("int").alias("cell"), F.col("embedding").cast("array<double>").alias("centroid"))
    index = inverted_file.build_from(rows, centroids)
    return inverted_file.recall(inverted_file.search(index, asked(rows), 10, nprobe=13), search.knn(rows, asked(rows), 10))


@query(
    """
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::int) AS s FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_sum(list_transform(range(1, len(q.s) + 1), lambda i: abs(q.s[i] - v.s[i])))::int AS distance FROM b q JOIN b v ON q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::int AS rank, id, distance FROM p)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 5"""
)
def ivf_binary_full_probe(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("embedding", F.array(search.sign_word(F.col("embedding"))))
    index = inverted_file.build_binary(rows, nlist=16)
    return inverted_file.search(index, asked(rows), 5, nprobe=16)


# -- store, lookup ----------------------------------------------------------
@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (3, 5, 7, 11, 100000000)")
def lookup_ids(spark, sf_dir):
    return search.search_by_ids(vectors(spark, sf_dir).select("id", "label"), [3, 5, 7, 11, 100_000_000])


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id = 7")
def lookup_pk_eq(spark, sf_dir):
    return vectors(spark, sf_dir).filter(search.filter_expression("id == 7")).select("id", "label")


@query("SELECT vec_id::varchar AS pk, label FROM embeddings WHERE vec_id::varchar IN ('0', '1')")
def lookup_text_keys(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").cast("string").alias("pk"), "label").filter(search.filter_expression('pk in ["0","1"]'))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE l_discount > 0.09 AND l_quantity < 3")
def filter_range(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.filter(search.filter_expression("l_discount > 0.09 && l_quantity < 3")).select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id LIMIT 10 OFFSET 20")
def offset_page(spark, sf_dir):
    return search.page(vectors(spark, sf_dir).select("id", "label"), ["id"], 20, 10)


def _store(spark, name: str):
    from rookery.operators.store import VectorStore
    from rookery.tables import new_path

    return VectorStore(spark, new_path(spark, "store"), name, overwrite=True)


@query("SELECT count(*) + 2 AS n FROM embeddings")
def insert_count(spark, sf_dir):
    store = _store(spark, "inserted")
    store.insert(vectors(spark, sf_dir))
    store.insert([{"id": -1, "embedding": [0.0, 1.0]}, {"id": -2, "embedding": [1.0, 0.0]}])
    return store.rows().agg(F.count("*").alias("n"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN 1 ELSE len(embedding) END::int AS dim FROM embeddings")
def upsert_store(spark, sf_dir):
    store, rows = _store(spark, "upserted"), vectors(spark, sf_dir)
    store.insert(rows)
    store.insert(rows.filter("id % 10 = 0").select("id", F.slice("embedding", 1, 1).alias("embedding")), mode="upsert")
    return store.rows().select("id", F.size("embedding").alias("dim"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (0, 1, 2)")
def delete_by_pk(spark, sf_dir):
    store = _store(spark, "deleted")
    store.insert(vectors(spark, sf_dir))
    store.delete("id in [0, 1]")
    store.delete([2])
    return store.rows().select("id")


@query(_knn_sql(_L2, 5, columns="query_id::int AS query_id, rank, id, distance"))
def store_search(spark, sf_dir):
    store, rows = _store(spark, "searched"), vectors(spark, sf_dir)
    store.insert(rows)
    store.create_index(nlist=8)
    queries = asked(rows).select(F.col("query_id").cast("int").alias("query_id"), "query")
    return store.search(queries, top_k=5, nprobe=8, output_fields=()).withColumn("distance", six(F.col("distance")))


# -- positions ----------------------------------------------------------------
_FENS = ", ".join(f"('{n}', '{f}')" for n, f in NAMED_POSITIONS.items())
_TOKENS = f"""
f AS (SELECT name, fen, string_split(fen, ' ') AS p FROM (VALUES {_FENS}) v(name, fen)),
g AS (SELECT name, fen, p, array_to_string(list_reverse(string_split(p[1], '/')), '') AS b FROM f),
h AS (SELECT name, fen, p, replace(replace(replace(replace(replace(replace(replace(replace(b, '8', '........'), '7', '.......'), '6', '......'), '5', '.....'), '4', '....'), '3', '...'), '2', '..'), '1', '.') AS b FROM g),
t AS (SELECT name, fen, list_concat(list_transform(string_split(b, ''), lambda c: CASE WHEN c = '.' THEN 15 ELSE instr('PNBRQKpnbrqk', c) + 16 END),
  [CASE WHEN p[2] = 'w' THEN 29 ELSE 30 END,
   CASE WHEN contains(p[3], 'K') AND b[5] = 'K' AND b[8] = 'R' THEN 32 ELSE 31 END, CASE WHEN contains(p[3], 'Q') AND b[5] = 'K' AND b[1] = 'R' THEN 32 ELSE 31 END,
   CASE WHEN contains(p[3], 'k') AND b[61] = 'k' AND b[64] = 'r' THEN 32 ELSE 31 END, CASE WHEN contains(p[3], 'q') AND b[61] = 'k' AND b[57] = 'r' THEN 32 ELSE 31 END]) AS tokens FROM h)"""
_BOARD = f"""{_TOKENS},
bb AS (SELECT name, fen, tokens, list_concat(flatten(list_transform(range(17, 29), lambda k: list_transform(tokens[1:64], lambda x: (x = k)::int))),
  [(tokens[65] = 29)::int, (tokens[66] = 32)::int, (tokens[67] = 32)::int, (tokens[68] = 32)::int, (tokens[69] = 32)::int]) AS bits FROM t)"""


def _text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("int").cast("string")), ",")


@query(f"WITH {_TOKENS} SELECT name, array_to_string(tokens, ',') AS tokens FROM t")
def fen_tokens(spark, sf_dir):
    return named_positions(spark).select("name", _text(E.fen_to_tokens(F.col("fen"))).alias("tokens"))


@query(f"WITH {_BOARD} SELECT name, array_to_string(bits, ',') AS bits FROM bb")
def fen_bitboard(spark, sf_dir):
    return named_positions(spark).select("name", _text(E.fen_to_bitboard(F.col("fen"))).alias("bits"))


@query(
    f"""WITH {_BOARD}, k AS (SELECT name, unnest(range(0, 12)) AS plane, bits FROM bb)
SELECT name, plane::int AS plane, list_sum(bits[plane * 64 + 1 : plane * 64 + 64])::int AS n FROM k
UNION ALL SELECT name, 12, list_sum(bits[770:773])::int FROM bb UNION ALL SELECT name, 13, 0 FROM bb UNION ALL SELECT name, 14, bits[769] FROM bb"""
)
def fen_tensor_plane_counts(spark, sf_dir):
    tensors = named_positions(spark).withColumn("tensor", E.fen_to_tensor(F.col("fen"), E.legal_en_passant(F.col("fen"))))
    planes = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.size(F.filter("tensor", lambda x, i: (i % 15 == k) & x)))
    return tensors.select("name", F.posexplode(planes).alias("plane", "n"))


@query(
    f"""WITH {_BOARD}, y AS (SELECT name, list_concat(bits, [0, 0, 0]) AS b FROM bb)
SELECT name, array_to_string(list_transform(range(0, 97), lambda k: upper(lpad(to_hex(b[8*k+1]*128 + b[8*k+2]*64 + b[8*k+3]*32 + b[8*k+4]*16 + b[8*k+5]*8 + b[8*k+6]*4 + b[8*k+7]*2 + b[8*k+8]), 2, '0'))), '') AS packed FROM y"""
)
def pack_bits(spark, sf_dir):
    return named_positions(spark).select("name", F.hex(E.pack_bits(E.fen_to_bitboard(F.col("fen")))).alias("packed"))


@query(f"WITH {_BOARD} SELECT name, array_to_string(bits, ',') AS bits FROM bb")
def unpack_bits(spark, sf_dir):
    packed = named_positions(spark).withColumn("packed", E.pack_bits(E.fen_to_bitboard(F.col("fen"))))
    return packed.select("name", _text(E.unpack_bits(F.col("packed"), V.BITBOARD_BITS)).alias("bits"))


_NORMAL = f"SELECT name, p[1] || ' ' || p[2] || ' ' || p[3] || ' - 0 1' AS fen FROM (SELECT name, string_split(fen, ' ') AS p FROM (VALUES {_FENS}) v(name, fen))"


@query(_NORMAL)
def tokens_to_fen(spark, sf_dir):
    return named_positions(spark).select("name", E.tokens_to_fen(E.fen_to_tokens(F.col("fen"))).alias("fen"))


@query(_NORMAL)
def bitboard_to_fen(spark, sf_dir):
    return named_positions(spark).select("name", E.bitboard_to_fen(E.padded(E.fen_to_bitboard(F.col("fen")))).alias("fen"))


@query(_NORMAL)
def tensor_to_fen(spark, sf_dir):
    return named_positions(spark).withColumn("t", E.fen_to_tensor(F.col("fen"))).select("name", E.tensor_to_fen(F.col("t")).alias("fen"))


@query(
    f"""WITH {_TOKENS} SELECT name, array_to_string(list_transform([8,7,6,5,4,3,2,1], lambda r: array_to_string(list_transform(tokens[(r-1)*8+1 : r*8], lambda x: CASE WHEN x = 15 THEN '.' ELSE substr('PNBRQKpnbrqk', x - 16, 1) END), ' ')), chr(10)) AS board FROM t"""
)
def board_text(spark, sf_dir):
    return named_positions(spark).select("name", E.board_text(F.col("fen")).alias("board"))


@query(f"WITH {_TOKENS}, u AS (SELECT name, unnest(tokens[1:64]) AS token FROM t) SELECT name, token::int AS token, count(*) AS n FROM u WHERE token BETWEEN 17 AND 28 GROUP BY ALL")
def piece_counts(spark, sf_dir):
    return M.piece_counts(named_positions(spark).withColumn("tokens", E.fen_to_tokens(F.col("fen"))), "name", "tokens").withColumn("token", F.col("token").cast("int"))


@query("SELECT k AS id, n AS token FROM (VALUES ('empty', 15), ('mask', 16), ('P', 17), ('N', 18), ('B', 19), ('R', 20), ('Q', 21), ('K', 22), ('p', 23), ('n', 24), ('b', 25), ('r', 26), ('q', 27), ('k', 28), ('turn_white', 29), ('turn_black', 30), ('no_castling', 31), ('castling', 32)) v(k, n)")
def vocabulary(spark, sf_dir):
    inverse = V.inverse_map(V.inverse_map(V.vocabulary_map()))
    return spark.range(1).select(F.explode(inverse).alias("id", "token"))


_NUMBERED = f"{_BOARD}, nb AS (SELECT name, bits, tokens, row_number() OVER (ORDER BY name) AS id FROM bb)"


def _position_index(spark):
    from rookery.plans.position_search import position_index
    from rookery.tables import new_path

    index = position_index(spark, new_path(spark, "positions"), overwrite=True)
    rows = [(k + 1, NAMED_POSITIONS[name]) for k, name in enumerate(sorted(NAMED_POSITIONS))]
    boards = spark.createDataFrame(rows, "number long, fen string")
    index.insert(boards, id_col="number")
    return index, boards.select(F.col("number").alias("query_id"), "fen")


def _position_sql(distance: str) -> str:
    return f"""WITH {_NUMBERED}, d AS (SELECT q.id AS query_id, v.id AS id, {distance} AS distance FROM nb q JOIN nb v ON true),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::int AS rank, id, distance FROM d)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 3"""


@query(_position_sql("list_sum(list_transform(range(1, 774), lambda i: abs(q.bits[i] - v.bits[i])))::int"))
def position_search_bits(spark, sf_dir):
    index, boards = _position_index(spark)
    return index.search(boards, 3, by="bitboard", exact=True).drop("fen")


@query(_position_sql("list_sum(list_transform(range(1, 70), lambda i: (q.tokens[i] - v.tokens[i]) ** 2))::double"))
def position_search_tokens(spark, sf_dir):
    index, boards = _position_index(spark)
    return index.search(boards, 3, by="token", exact=True).drop("fen")


@query()
def position_search_embeddings(spark, sf_dir):
    index, boards = _position_index(spark)
    index.create_indexes()
    return index.search(boards, 3)


# -- sampling -----------------------------------------------------------------
def _u(seed: int, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::bigint / 4294967296.0)"


@query(f"SELECT event_id FROM events WHERE {_u(42, 'event_id')} < 1 / (1 + exp(-0.005 * (least(1800 + value * 10, 2600) - 2000)))")
def elo_gate(spark, sf_dir):
    elo = F.least(1800 + F.col("value") * 10, F.lit(2600.0))
    return table(spark, sf_dir, "events").filter(S.elo_gate(S.hash_uniform(42, "event_id"), elo, elo)).select("event_id")


_PLIES = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ply FROM events"


def _plies(spark, sf_dir) -> DataFrame:
    return B.plies(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


@query(f"SELECT event_id, ply::int AS ply FROM ({_PLIES}) WHERE {_u(42, 'event_id')} < least(ply / 900.0::double, 1) * 0.33::double")
def ply_sample(spark, sf_dir):
    return _plies(spark, sf_dir).filter(S.ply_gate(S.hash_uniform(42, "event_id"), F.col("ply"))).select("event_id", "ply")


@query(f"SELECT event_id, ply::int AS ply FROM ({_PLIES}) WHERE {_u(42, 'event_id')} < least((ply / 30.0::double) ** 2, 1) * 0.33::double")
def ply_sample_squared(spark, sf_dir):
    return _plies(spark, sf_dir).filter(S.ply_gate(S.hash_uniform(42, "event_id"), F.col("ply"), mode="squared")).select("event_id", "ply")


@query(f"SELECT event_id, ply::int AS ply FROM ({_PLIES}) WHERE ply BETWEEN 3 AND 7")
def ply_range(spark, sf_dir):
    return _plies(spark, sf_dir).filter(S.within_plies(F.col("ply"), 3, 7)).select("event_id", "ply")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor(count(*) OVER () * 0.9::double) THEN 'train' ELSE 'test' END AS split FROM orders")
def split_sequential(spark, sf_dir):
    return S.split_sequential(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.9)


@query(f"SELECT o_orderkey, CASE WHEN {_u(7, 'o_orderkey')} < 0.9 THEN 'train' ELSE 'test' END AS split FROM orders")
def split_hash(spark, sf_dir):
    return S.split_by_hash(table(spark, sf_dir, "orders").select("o_orderkey"), 7, ["o_orderkey"], 0.9)


@query("SELECT event_id, coalesce(try_cast(substr(event_type, 1, 2) AS int), 1500) AS elo FROM events")
def parse_elo(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.parse_elo(F.substring("event_type", 1, 2)).alias("elo"))


# -- masks, batches, windows ----------------------------------------------------
@query(
    f"""WITH {_TOKENS}, i AS (SELECT name, tokens, unnest(range(0, 69)) AS i FROM t),
r AS (SELECT name, tokens, i, row_number() OVER (PARTITION BY name ORDER BY md5('42:0:' || name || ':' || i), i) AS k FROM i)
SELECT name, string_agg(CASE WHEN k <= 10 THEN 16 ELSE tokens[i + 1] END::varchar, ',' ORDER BY i) AS x FROM r GROUP BY name"""
)
def mask_tokens(spark, sf_dir):
    rows = named_positions(spark).withColumn("tokens", E.fen_to_tokens(F.col("fen")))
    return rows.select("name", _text(B.mask_tokens(F.col("tokens"), F.col("name"), 10)).alias("x"))


@query(
    """WITH c AS (SELECT vec_id, list_transform(embedding[1:60], lambda x: x::double) AS e FROM embeddings), i AS (SELECT vec_id, e, unnest(range(0, 4)) AS i FROM c),
r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY md5('42:1:' || vec_id || ':' || i), i) AS k FROM i),
m AS (SELECT vec_id, list(i) AS chosen FROM r WHERE k <= 2 GROUP BY vec_id)
SELECT vec_id AS id, round(list_sum(list_transform(range(0, 60), lambda p: CASE WHEN list_contains(chosen, p // 15) THEN 16 ELSE e[p + 1] END)), 6) AS total FROM c JOIN m USING (vec_id)"""
)
def mask_squares(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", F.slice("embedding", 1, 60).alias("t"))
    x = B.mask_squares(F.col("t"), F.col("id"), 2, epoch=1, squares=4)
    return rows.select("id", six(F.aggregate(x, F.lit(0.0), lambda s, v: s + v)).alias("total"))


_LINES = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query("SELECT count(*) AS n_rows, ceil(count(*) / 1000.0)::bigint AS n_batches FROM lineitem")
def batch_count(spark, sf_dir):
    return B.batch_count(table(spark, sf_dir, "lineitem"), 1000)


@query(f"WITH r AS (SELECT l_quantity, (row_number() OVER ({_LINES}) - 1) // 1000 AS batch_id FROM lineitem) SELECT batch_id::bigint AS batch_id, count(*) AS n, sum(l_quantity) AS quantity FROM r GROUP BY batch_id")
def batch_ids(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = B.with_batch_ids(table(spark, sf_dir, "lineitem").select(*order), order, 1000)
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT event_id, (event_id % 4)::bigint AS shard FROM events WHERE event_id % 4 = 3 - 6 % 4")
def epoch_shard(spark, sf_dir):
    from rookery.sources import shards
    from rookery.tables import new_path

    path = new_path(spark, "shards")
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("train").alias("split"), (F.col("event_id") % 4).alias("shard"))
    rows.write.partitionBy("split", "shard").parquet(path)
    return shards.shard_for_epoch(spark, path, 6).select("event_id", F.col("shard").cast("long").alias("shard"))


@query("SELECT 1001 AS next_number, '1001' AS postfix")
def next_shard_number(spark, sf_dir):
    from rookery.sources.shards import next_number

    return next_number(spark.createDataFrame([("train_000.npz",), ("train_999.npz",), ("test_1000.npz",), ("notes.txt",)], "name string"))


@query("SELECT 12 AS next_number, '012' AS postfix")
def next_batch(spark, sf_dir):
    from rookery.sources.shards import next_batch_number

    return next_batch_number(spark.createDataFrame([("train/batch_0003_part.parquet",), ("test/batch_0011_part.parquet",)], "name string"))


_WINDOW = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"SELECT event_id, array_to_string(w, ',') AS ids FROM (SELECT event_id, list(event_id) OVER ({_WINDOW} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS w FROM events) WHERE len(w) = 8")
def temporal_windows(spark, sf_dir):
    out = B.temporal_windows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id"], 8)
    return out.select("event_id", F.array_join(F.col("window.event_id"), ",").alias("ids"))


@query(f"SELECT event_id, lead(event_id, 5) OVER ({_WINDOW}) AS future FROM events")
def future_lead5(spark, sf_dir):
    return B.future(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", 5).select("event_id", "future")


@query(f"WITH p AS ({_PLIES}) SELECT a.user_id AS game, a.event_id AS a, b.event_id AS b, (b.ply - a.ply)::int AS distance FROM p a JOIN p b ON a.user_id = b.user_id AND b.ply - a.ply BETWEEN 1 AND 5")
def ply_distance_pairs(spark, sf_dir):
    return B.ply_distances(_plies(spark, sf_dir), "user_id", "ply", "event_id", 5)


@query("WITH e AS (SELECT DISTINCT event_type || ':' || floor(value)::bigint AS key, user_id AS game_a FROM events) SELECT * FROM (SELECT key, game_a, lead(game_a) OVER (PARTITION BY key ORDER BY game_a) AS game_b FROM e) WHERE game_b IS NOT NULL")
def transposition_pairs(spark, sf_dir):
    keyed = table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "event_type", F.floor("value").cast("string")))
    return B.transpositions(keyed, "user_id", "key")


@query(
    f"""WITH r AS (SELECT event_id AS id, user_id AS game, {_u(42, 'event_id')} AS u FROM events), b AS (SELECT *, floor(u * (SELECT greatest(1, count(*) // 1000) FROM events)) AS bucket FROM r),
w AS (SELECT *, CASE WHEN lead(game) OVER x IS DISTINCT FROM game THEN lead(id) OVER x END AS turn, first(id) OVER x AS first_id, first(game) OVER x AS first_game FROM b WINDOW x AS (PARTITION BY bucket ORDER BY u, id)),
a AS (SELECT *, first(turn IGNORE NULLS) OVER (PARTITION BY bucket ORDER BY u, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM w),
one AS (SELECT id, game FROM r ORDER BY u, id LIMIT 1), two AS (SELECT r.id, r.game FROM r, one WHERE r.game IS DISTINCT FROM one.game ORDER BY u, r.id LIMIT 1)
SELECT a.id, coalesce(after, CASE WHEN first_game IS DISTINCT FROM a.game THEN first_id END, CASE WHEN one.game IS DISTINCT FROM a.game THEN one.id END, CASE WHEN two.game IS DISTINCT FROM a.game THEN two.id END) AS negative
FROM a, one LEFT JOIN two ON true"""
)
def negative_sample(spark, sf_dir):
    return B.negatives(table(spark, sf_dir, "events"), "user_id", "event_id", bucket_rows=1_000)


# -- losses and metrics ---------------------------------------------------------
_PAIR = "p AS (SELECT t.vec_id, list_transform(t.embedding[1:60], lambda x: abs(x::double)) AS t, list_transform(n.embedding[1:60], lambda x: abs(x::double) * 0.9::double) AS p FROM embeddings t JOIN embeddings n ON n.vec_id = t.vec_id + 1)"
_DIFF = "d AS (SELECT vec_id, t, p, list_transform(range(1, 61), lambda i: t[i] - p[i]) AS d FROM p)"
_A1 = "(SELECT sum(list_sum(list_transform(d, lambda x: x * x))) / count(*) FROM d)"
_A2 = "(SELECT (sum(list_sum(t)) - sum(list_sum(p))) ** 2 / (1e-3::double + sum(list_sum(p))) / count(*) FROM d)"
_A3 = "(SELECT sum(list_sum(list_transform(range(0, 4), lambda s: list_sum(d[s * 15 + 1 : s * 15 + 12]) ** 2))) / count(*) FROM d)"
_A4 = "(SELECT sum(list_sum(list_transform(range(1, 13), lambda k: (d[k] + d[k + 15] + d[k + 30] + d[k + 45]) ** 2))) / count(*) FROM d)"


def _pairs(spark, sf_dir) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", F.transform(F.slice("embedding", 1, 60), lambda x: F.abs(x.cast("double"))).alias("t"))
    moved = rows.select((F.col("id") - 1).alias("id"), F.transform("t", lambda x: x * 0.9).alias("p"))
    return rows.join(moved, "id")


def _loss(name: str, sql: str, loss: Callable[[Column, Column], Column]) -> None:
    def run(spark, sf_dir):
        return _pairs(spark, sf_dir).agg(six(loss(F.col("t"), F.col("p"))).alias("loss"))

    run.__name__ = name
    query(f"WITH {_PAIR}, {_DIFF} SELECT round({sql}, 6) AS loss")(run)


_loss("loss_sum_squared", _A1, M.loss_sum_squared)
_loss("loss_num_pc", _A2, M.loss_number_of_pieces)
_loss("loss_pc_column", _A3, M.loss_piece_columns)
_loss("loss_pc_plane", _A4, M.loss_piece_planes)
_loss("loss_regularized", f"{_A1} + {_A2} + 0.1::double * {_A3} + 0.1::double * {_A4}", M.loss_regularised)
_loss("mse", "(SELECT sum(list_sum(list_transform(d, lambda x: x * x))) / (60 * count(*)) FROM d)", M.mean_squared)
_loss("bce", "(SELECT sum(list_sum(list_transform(range(1, 61), lambda i: greatest(p[i], 0) - p[i] * t[i] + ln(1 + exp(-abs(p[i])))))) / (60 * count(*)) FROM d)", M.binary_cross_entropy)

_LOGITS = "l AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: x::double * 10) AS z FROM embeddings)"
_CE = "ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) - z[label + 1]"


def _logits(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).select("id", "label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10).alias("z"))


@query("SELECT a.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: ((a.embedding[i] > 0) <> (b.embedding[i] > 0))::int))::int AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def token_mismatch(spark, sf_dir):
    signs = vectors(spark, sf_dir).select("id", E.binarised(F.col("embedding"), 0.0).alias("x"))
    return signs.join(signs.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id").select("id", M.mismatches(F.col("x"), F.col("y")).alias("n"))


@query(f"WITH {_LOGITS} SELECT vec_id AS id, (list_position(z, list_max(z)) - 1)::bigint AS predicted, round(1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS share FROM l")
def argmax_label(spark, sf_dir):
    return _logits(spark, sf_dir).select("id", M.argmax(F.col("z")).alias("predicted"), six(F.array_max(M.softmax(F.col("z")))).alias("share"))


@query(f"WITH {_LOGITS} SELECT round(avg({_CE}), 6) AS loss FROM l")
def cross_entropy(spark, sf_dir):
    return _logits(spark, sf_dir).agg(six(F.avg(M.cross_entropy(F.col("z"), F.col("label")))).alias("loss"))


@query(f"WITH {_LOGITS} SELECT round(avg(CASE WHEN list_position(z, list_max(z)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l")
def accuracy(spark, sf_dir):
    return _logits(spark, sf_dir).agg(six(M.accuracy(F.col("z"), F.col("label"))).alias("accuracy"))


@query(f"WITH {_LOGITS} SELECT round(exp(avg({_CE}) FILTER (label <> 0)), 6) AS perplexity FROM l")
def perplexity(spark, sf_dir):
    rows = _logits(spark, sf_dir).withColumn("ce", M.cross_entropy(F.col("z"), F.col("label")))
    return rows.agg(six(M.perplexity(F.col("ce"), F.col("label"))).alias("perplexity"))


def _samples(spark, sf_dir) -> DataFrame:
    return _pairs(spark, sf_dir).select("id", six(M.squared_difference(F.col("t"), F.col("p"))).alias("loss"))


def _samples_sql(order: str) -> str:
    return f"WITH {_PAIR}, {_DIFF}, l AS (SELECT vec_id AS id, round(list_sum(list_transform(d, lambda x: x * x)), 6) AS loss FROM d ORDER BY vec_id LIMIT 50) SELECT id, loss FROM l ORDER BY loss {order}, id LIMIT 5"


@query(_samples_sql("ASC"))
def best_samples(spark, sf_dir):
    return B.best_samples(_samples(spark, sf_dir), "loss", 5, "id")


@query(_samples_sql("DESC"))
def worst_samples(spark, sf_dir):
    return B.worst_samples(_samples(spark, sf_dir), "loss", 5, "id")


@query(
    f"""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, (v.vec_id = q.vec_id + 1) AS positive, (1 - ({_COSINE})) / 0.1::double AS s FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
m AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS top FROM p)
SELECT query_id, round(-ln(sum(CASE WHEN positive THEN exp(s - top) END) / sum(exp(s - top))), 6) AS loss FROM m GROUP BY query_id"""
)
def infonce(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    pairs = search.block_pairs(rows, asked(rows)).filter(F.col("id") != F.col("query_id"))
    pairs = pairs.select("query_id", (1 - search.cosine_distance(F.col("query"), F.col("embedding"))).alias("similarity"), (F.col("id") == F.col("query_id") + 1).alias("positive"))
    return M.info_nce(pairs).withColumn("loss", six(F.col("loss")))


@query("SELECT vec_id AS id, list_min(embedding) >= -1 AND list_max(embedding) <= 1 AS close, list_contains(embedding, embedding[1]) AS found FROM embeddings")
def array_checks(spark, sf_dir):
    zero = F.transform("embedding", lambda x: x * 0)
    return vectors(spark, sf_dir).select("id", M.all_close(F.col("embedding"), zero, 1.0).alias("close"), M.any_equal(F.col("embedding"), F.get("embedding", F.lit(0))).alias("found"))


@query()
def pca_2d(spark, sf_dir):
    from rookery.functions.encoders import pca

    return pca(vectors(spark, sf_dir), "embedding")


@query()
def encode_positions(spark, sf_dir):
    from rookery.functions.encoders import RandomProjection, encode_with

    rows = named_positions(spark).select(F.xxhash64("fen").alias("id"), E.fen_to_bitboard(F.col("fen")).cast("array<int>").alias("bits"))
    return encode_with(rows, RandomProjection(), "bits")


@query("SELECT e::int AS epoch, round(least(e * 0.03::double, 0.3::double), 6) AS metric, e >= 25 AS stop, round(CASE WHEN e < 15 THEN 1e-3 WHEN e < 20 THEN 3e-4 WHEN e < 25 THEN 9e-5 ELSE 2.7e-5 END, 9)::double AS rate FROM range(30) r(e)")
def training_curve(spark, sf_dir):
    log = spark.range(30).select(F.col("id").alias("epoch"), F.least(F.col("id") * 0.03, F.lit(0.3)).alias("metric"))
    return M.training_rules(log).withColumn("metric", six(F.col("metric"))).withColumn("rate", F.round("rate", 9))


# -- games --------------------------------------------------------------------------
GAME_TEXT = """[Event "First"]
[WhiteElo "2500"]
[BlackElo "2450"]
[Result "1-0"]

1. e4 e5 2. Nf3 {a comment} Nc6 3. Bb5 (3. Bc4 Bc5) a6 $1 4. O-O Nf6 5. Re1 1-0

[Event "Second"]
[WhiteElo "?"]
[Result "*"]

1. e4 a6 2. e5 d5 3. exd6 Ra7 4. dxc7 Ra8 5. cxb8=Q *

[Event "Third"]
[WhiteElo "2600"]
[BlackElo "2700"]

1. e4 e5 2. Ke3 *

[Event "Fourth"]
[WhiteElo "x"]
[BlackElo "2700"]
"""


def _games(spark) -> DataFrame:
    from rookery.sources import games

    return games.parsed_games(games.games_from_text(spark.createDataFrame([(GAME_TEXT,)], "text string"), "text"))


@query("SELECT * FROM (VALUES ('First', 2500, 2450, '1-0', 9), ('Second', NULL, NULL, '*', 9), ('Third', 2600, 2700, NULL, 3), ('Fourth', NULL, 2700, NULL, 0)) v(event, white_elo, black_elo, result, n_moves)")
def pgn_headers(spark, sf_dir):
    return _games(spark).select("event", "white_elo", "black_elo", "result", F.size("moves").alias("n_moves"))


# The positions of the games above.
_REPLAYED = """
SELECT event, ply::int AS ply, san, fen, error FROM (VALUES
    ('First', 0, 'e4', 'rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1', NULL),
    ('First', 1, 'e5', 'rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq e6 0 2', NULL),
    ('First', 2, 'Nf3', 'rnbqkbnr/pppp1ppp/8/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R b KQkq - 1 2', NULL),
    ('First', 3, 'Nc6', 'r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq - 2 3', NULL),
    ('First', 4, 'Bb5', 'r1bqkbnr/pppp1ppp/2n5/1B2p3/4P3/5N2/PPPP1PPP/RNBQK2R b KQkq - 3 3', NULL),
    ('First', 5, 'a6', 'r1bqkbnr/1ppp1ppp/p1n5/1B2p3/4P3/5N2/PPPP1PPP/RNBQK2R w KQkq - 0 4', NULL),
    ('First', 6, 'O-O', 'r1bqkbnr/1ppp1ppp/p1n5/1B2p3/4P3/5N2/PPPP1PPP/RNBQ1RK1 b kq - 1 4', NULL),
    ('First', 7, 'Nf6', 'r1bqkb1r/1ppp1ppp/p1n2n2/1B2p3/4P3/5N2/PPPP1PPP/RNBQ1RK1 w kq - 2 5', NULL),
    ('First', 8, 'Re1', 'r1bqkb1r/1ppp1ppp/p1n2n2/1B2p3/4P3/5N2/PPPP1PPP/RNBQR1K1 b kq - 3 5', NULL),
    ('Second', 0, 'e4', 'rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1', NULL),
    ('Second', 1, 'a6', 'rnbqkbnr/1ppppppp/p7/8/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2', NULL),
    ('Second', 2, 'e5', 'rnbqkbnr/1ppppppp/p7/4P3/8/8/PPPP1PPP/RNBQKBNR b KQkq - 0 2', NULL),
    ('Second', 3, 'd5', 'rnbqkbnr/1pp1pppp/p7/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6 0 3', NULL),
    ('Second', 4, 'exd6', 'rnbqkbnr/1pp1pppp/p2P4/8/8/8/PPPP1PPP/RNBQKBNR b KQkq - 0 3', NULL),
    ('Second', 5, 'Ra7', '1nbqkbnr/rpp1pppp/p2P4/8/8/8/PPPP1PPP/RNBQKBNR w KQk - 1 4', NULL),
    ('Second', 6, 'dxc7', '1nbqkbnr/rpP1pppp/p7/8/8/8/PPPP1PPP/RNBQKBNR b KQk - 0 4', NULL),
    ('Second', 7, 'Ra8', 'rnbqkbnr/1pP1pppp/p7/8/8/8/PPPP1PPP/RNBQKBNR w KQk - 1 5', NULL),
    ('Second', 8, 'cxb8=Q', 'rQbqkbnr/1p2pppp/p7/8/8/8/PPPP1PPP/RNBQKBNR b KQk - 0 5', NULL),
    ('Third', 0, 'e4', 'rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1', NULL),
    ('Third', 1, 'e5', 'rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq e6 0 2', NULL),
    ('Third', 2, 'Ke3', NULL, 'illegal move Ke3')
) v(event, ply, san, fen, error)"""


@query(_REPLAYED)
def pgn_positions(spark, sf_dir):
    from rookery.sources import games

    parsed = _games(spark)
    return games.replayed(parsed).join(parsed.select("game_id", "event"), "game_id").drop("game_id")


@query("SELECT * FROM (VALUES ('elo gate', 3::bigint), ('no moves', 1), ('illegal move', 1)) v(reason, n)")
def discard_stats(spark, sf_dir):
    from rookery.sources import games

    parsed = _games(spark)
    return games.discard_statistics(parsed, games.replayed(parsed), 42)


@query("SELECT f::int AS file, event, n_moves::int AS n_moves FROM range(3) r(f), (VALUES ('First', 9), ('Second', 9), ('Third', 3), ('Fourth', 0)) v(event, n_moves)")
def pgn_files(spark, sf_dir):
    """Games of files in a folder, read game by game, a file of another ending left out."""
    from rookery.sources import games
    from rookery.tables import new_path

    path = new_path(spark, "games")
    for k in range(3):
        spark.createDataFrame([(GAME_TEXT,)], "text string").coalesce(1).write.text(f"{path}/file={k}")
    spark.createDataFrame([("x",)], "x string").write.json(f"{path}/file=9")
    parsed = games.parsed_games(games.read_games(spark, [f"{path}/file={k}" for k in (0, 1, 2, 9)], ending=".txt"))
    return parsed.select(F.regexp_extract("file", r"file=(\d)", 1).cast("int").alias("file"), "event", F.size("moves").alias("n_moves"))


@query("SELECT f::int AS file FROM range(2) r(f)")
def list_files(spark, sf_dir):
    from rookery.sources import games
    from rookery.tables import new_path

    path = new_path(spark, "listed")
    for k, kind in enumerate(("text", "text", "json")):
        spark.createDataFrame([("x",)], "x string").coalesce(1).write.format(kind).save(f"{path}/file={k}")
    found = games.list_files(spark, f"{path}/*", ".txt").filter("length > 0")
    return found.select(F.regexp_extract("path", r"file=(\d)", 1).cast("int").alias("file"))


# -- shards -------------------------------------------------------------------------
_SHARDED = "s AS (SELECT k.shard, o_orderkey, row_number() OVER (PARTITION BY k.shard ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY k.shard) AS n FROM orders, range(2) k(shard) WHERE o_orderkey % 2 = k.shard)"


@query(f"WITH {_SHARDED} SELECT shard::int AS shard, CASE WHEN place <= floor(n * 0.9) THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(o_orderkey)::bigint AS keys FROM s GROUP BY ALL")
def shard_round_trip(spark, sf_dir):
    """Two shards of train and test rows written one after the other and read back in pairs."""
    from rookery.sources import shards
    from rookery.tables import new_path

    path, rows = new_path(spark, "shards"), table(spark, sf_dir, "orders").select("o_orderkey")
    for k in range(2):
        shards.write_shard(S.split_sequential(rows.filter(F.col("o_orderkey") % 2 == k), ["o_orderkey"], 0.9), path)
    parts = [part for k in range(2) for part in shards.read_train_test(spark, path, k)]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return found.groupBy("shard", "split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT v.version, count(*) AS files, (SELECT count(*) FROM orders)::bigint AS n FROM (VALUES ('v1'), ('v1')) v(version) GROUP BY v.version")
def dataset_round_trip(spark, sf_dir):
    """Two numbered batches written, tagged and read back as one split; a dry run writes nothing."""
    from rookery.sources import shards
    from rookery.tables import new_path

    path, rows = new_path(spark, "dataset"), table(spark, sf_dir, "orders").select("o_orderkey").coalesce(1)
    for k in range(2):
        shards.write_batch(rows.filter(F.col("o_orderkey") % 2 == k), path, "train", k, "orders")
    shards.write_batch(rows, path, "train", 2, "orders", dry_run=True)
    tagged = shards.tag_version(spark, path, "v1").groupBy(F.col("tag").alias("version")).agg(F.count("*").alias("files"))
    return tagged.withColumn("n", F.lit(shards.read_dataset(spark, path, "train").count()))


@query()
def random_boards(spark, sf_dir):
    from rookery.sources.synthetic import random_boards as boards

    return boards(spark, 100, 5)


@query(
    """WITH r AS (SELECT unnest(range(0, 200)) AS id), c AS (SELECT id, unnest(range(0, 8)) AS i FROM r)
SELECT id, round(sum(('0x' || substr(md5('42:' || id || ':' || i), 1, 8))::bigint / 4294967296.0), 4) AS total FROM c GROUP BY id"""
)
def synthetic_vectors(spark, sf_dir):
    from rookery.sources.synthetic import synthetic_vectors as made

    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return made(spark, 200, 8).select("id", F.round(total, 4).alias("total"))


@query("SELECT count(*) AS n, 0 AS outside FROM range(3000)")
def synthetic_entities(spark, sf_dir):
    from rookery.sources.synthetic import synthetic_entities as made

    inside = F.forall("embeddings", lambda x: (x >= 0) & (x < 1)) & F.col("random").between(0, 1)
    return made(spark).agg(F.count("*").alias("n"), F.count_if(~inside).cast("int").alias("outside"))


@query("SELECT event_type AS reason, count(*) AS n, ceil(count(*) / 2) AS pages, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def grouped_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("reason"))
    return rows.agg(F.count("*").alias("n"), F.ceil(F.count("*") / 2).cast("double").alias("pages"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_u(5, chr(39) + '1:' + chr(39) + ' || o_orderkey')}, o_orderkey) - 1 AS place FROM orders")
def epoch_shuffle(spark, sf_dir):
    return S.numbered_shuffle(table(spark, sf_dir, "orders").select("o_orderkey"), 5, 1, ["o_orderkey"])
