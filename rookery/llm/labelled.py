"""Bounded labelled samples of documents, for models that are trained on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import map_rows


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, *, max_rows: int, keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``max_rows`` rows ``id, label, text``: the labelled ids of least hash.

    Rows with a null id or label take no part.  An id labelled twice gets its
    largest label, an id with several texts the least of them.
    """
    rows = labels.select(F.col(id_col).alias("id"), label.alias("label")).filter("id is not null and label is not null")
    if keep is not None:
        rows = rows.filter(keep)
    ids = rows.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the broadcast side has max_rows rows of two numbers at most
    joined = texts.join(F.broadcast(ids), "id")
    return joined.groupBy("id", "label").agg(F.min("text").alias("text"))


def collect_features(sample: DataFrame, features: Callable[[str], np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature ids (uint32) of each sampled text, computed on the executors, and the labels; in id order."""

    def rows(batch):
        made = [features(t.as_py() or "").astype("<u4").tobytes() for t in batch.column(2)]
        return [batch.column(0), batch.column(1), made]

    # as Arrow buffers, which are given back as a whole
    got = map_rows(sample.select("id", F.col("label").cast("double"), "text"), "id long, label double, f binary", rows).toArrow().combine_chunks().sort_by("id")
    return [np.frombuffer(f.as_buffer(), "<u4") for chunk in got.column("f").chunks for f in chunk], got.column("label").to_numpy()


class Vocabulary:
    """The feature ids that enough sampled rows have, renumbered from 0."""

    def __init__(self, rows: list[np.ndarray], least: int, dims: int):
        df = np.zeros(dims, np.int32)
        for r in rows:
            df[r] += 1  # ids are unique within a row
        self.size = int((df >= least).sum())
        self.index = np.full(dims, -1, np.int32)
        self.index[df >= least] = np.arange(self.size)

    def __call__(self, row: np.ndarray) -> np.ndarray:
        at = self.index[row]
        return at[at >= 0]


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)), counts
