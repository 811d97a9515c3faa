"""Benchmark decontamination with one Aho-Corasick automaton.

All windows of ``window`` consecutive words of the benchmark items (an item
with fewer words, but some, is one window) go into one automaton over the
normalised text; each document is scanned once, and every occurrence is
mapped back through the word positions.  A document word inside any
occurrence is hit.

Words: A-Z lower-cased, then maximal runs of 0-9, a-z and anything beyond
ASCII.  Normalisation works on UTF-8 bytes, where one table lower-cases and
blanks separators; the automaton sees each byte as one Latin-1 character.

Edge cases: null and empty texts have no words, hence no hit; a benchmark
without words hits nothing; repeated items all count as occurring; a null
item id is left out; further columns are ignored.

Size: the automaton holds at most ``max_chars`` characters of benchmark text.
A larger benchmark is cut into blocks of items by hash; the documents then
pass one scan for each block, in a chain, carrying merged hits along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import small_batches

_KEPT = bytes(b"0123456789abcdefghijklmnopqrstuvwxyz") + bytes(range(0x80, 0x100))
_TABLE = bytes(i if i in _KEPT else (i + 32 if 0x41 <= i <= 0x5A else 0x20) for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if text else []


def normalise(text: str | None) -> tuple[str, int]:
    """`` word word ... word `` with one blank around each word, and the number of words."""
    words = [w for w in words_of(text) if w]
    return (f" {b' '.join(words).decode('latin-1')} " if words else ""), len(words)


def windows_of(text: str | None, window: int) -> list[tuple[str, int]]:
    words = [w for w in words_of(text) if w]
    if not words:
        return []
    n = min(window, len(words))
    return [(f" {b' '.join(words[i : i + n]).decode('latin-1')} ", n) for i in range(len(words) - n + 1)]


def build_automaton(items: list[tuple[str, str | None]], window: int):
    """Pattern -> (length in words, item ids)."""
    import ahocorasick

    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        for pattern, n in windows_of(text, window):
            found.setdefault(pattern, (n, set()))[1].add(item)
    automaton = ahocorasick.Automaton()
    for pattern, (n, ids) in found.items():
        automaton.add_word(pattern, (len(pattern), n, tuple(ids)))
    if found:
        automaton.make_automaton()
    return automaton if found else None


def scan(automaton, text: str) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged [first, last) word ranges that are hit, and the items that occur."""
    spans, items = [], set()
    for end, (size, n, ids) in automaton.iter(text):
        spans.append((end - size + 1, n))
        items.update(ids)
    if not spans:
        return [], items
    blanks = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 0x20)
    firsts = np.searchsorted(blanks, [s for s, _ in spans])
    return merged([(int(f), int(f) + n) for f, (_, n) in zip(firsts, spans)]), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_built: dict[str, object] = {}


def _automaton(key: str, items: list[tuple[str, str | None]], window: int):
    if key not in _built:
        _built.clear()
        _built[key] = build_automaton(items, window)
    return _built[key]


#: The columns that ``find_hits`` adds; those of the table that have such a name are replaced.
HITS = ("n_words", "hit_first", "hit_last", "hit_items")


def find_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_chars: int = 4_000_000, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_first``/``hit_last`` (merged word ranges) and ``hit_items`` (sorted as text)."""
    return _hits(spark, docs.select(*[c for c in docs.columns if c not in HITS]), benchmark, HITS, window, max_chars, text_col, item_col, item_text)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_chars: int = 4_000_000, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns, whatever the names."""
    names = tuple(next(n for n in (f"_{k}_{h}" for k in range(len(docs.columns) + 1)) if n not in docs.columns) for h in HITS)
    found = _hits(spark, docs, benchmark, names, window, max_chars, text_col, item_col, item_text)
    return found.filter(F.size(names[1]) == 0).select(*docs.columns)


def _hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, names: tuple[str, ...], window: int, max_chars: int, text_col: str, item_col: str, item_text: str) -> DataFrame:
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).filter("i is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // max_chars))
    out = docs.select("*", F.lit(0).cast("long").alias(names[0]), *(F.expr("cast(array() as array<int>)").alias(c) for c in names[1:3]), F.expr("cast(array() as array<string>)").alias(names[3]))
    schema = out.schema
    where = docs.columns.index(text_col)
    for block in range(blocks):
        # at most about max_chars characters come to the driver at once
        rows = [(r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect()]
        key = hashlib.sha256(repr((window, sorted(rows, key=repr))).encode("utf-8", "surrogatepass")).hexdigest()
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, shared.value, window)
            for batch in batches:
                old = [c.to_pylist() for c in batch.columns[-3:]]
                n_words, firsts, lasts, found = [], [], [], []
                for k, text in enumerate(batch.column(where)):
                    norm, n = normalise(text.as_py())
                    spans, ids = scan(automaton, norm) if automaton and n else ([], set())
                    if old[0][k]:
                        spans = merged(spans + list(zip(old[0][k], old[1][k])))
                    n_words.append(n)
                    firsts.append([a for a, _ in spans])
                    lasts.append([b for _, b in spans])
                    found.append(sorted(ids | set(old[2][k])))
                made = [pa.array(n_words, pa.int64()), pa.array(firsts, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(batch.columns[:-4] + made, names=batch.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def digest(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate(F.zip_with("hit_first", "hit_last", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return hits.select(F.col(id_col), "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_first") > 0).alias("contaminated"))
