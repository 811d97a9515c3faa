"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams of the whole text: words (one and two) and
shapes of the white-space chunks (one to three).  A word is a chunk in lower
case without the signs around it.  A shape has case, digits and punctuation,
with runs collapsed, and a mark for a chunk that repeats the one before.
Chunks of more than 64 characters are read in pieces of twelve, words and
shapes alike, to their end.  Each indicator is scaled by its class log-count
ratio, and a linear hinge-loss model is fitted by dual coordinate descent.
Margins become probabilities by a logistic fit on out-of-fold margins.

Edge cases: null and empty texts have no feature and get the score of the
bias alone; if the labelled rows are none or of one class, every score is
that class's smoothed share; repeated rows are scored alike.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import Memo, fold, map_rows, mix64, sums_by_row, tidy
from rookery.llm.labelled import Vocabulary, collect_features, flat, labelled_sample

DIMS = 1 << 19
MAX_ROWS = 12_000


class _Kinds(dict):
    """What each character is in a shape, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
        return kind


_KINDS, _RUNS = _Kinds(), re.compile(r"([Aa9])\1+")


def shape(chunk: str) -> str:
    """``Hello,`` -> ``Aa,``; ``ABC!!`` -> ``A!!``; ``2024-01`` -> ``9-9``; letters beyond ASCII count alike; the whole chunk is read."""
    return _RUNS.sub(r"\1", chunk.translate(_KINDS))


_SIGNS = ".,;:!?\"'()[]{}<>&%$#*|+=-_/\\~^`…–—«»„“”‚‘’"


def _pieces(whole: str) -> list[str]:
    return [whole[at : at + 12] for at in range(0, len(whole), 12)]


def _hashed(parts: list[str], seed: int) -> bytes:
    return struct.pack(f"<{len(parts)}Q", *(zlib.crc32(p.encode("utf-8", "replace"), seed) << 1 for p in parts))


def _chunk_ids(chunk: str) -> tuple[bytes, bytes]:
    """Ids of the shape's pieces of twelve signs, and of the word (of its pieces, if it is long)."""
    word, whole = chunk.lower().strip(_SIGNS), shape(chunk)
    if len(whole) <= 12 and len(chunk) <= 64:  # nearly all chunks
        own = (zlib.crc32(whole.encode("utf-8", "replace")) << 1).to_bytes(8, "little")
        return own, (zlib.crc32(word.encode("utf-8", "replace"), 1) << 1).to_bytes(8, "little") if word else b""
    return _hashed(_pieces(whole), 0), _hashed(([word] if len(chunk) <= 64 else _pieces(word)) if word else [], 1)


_ids = Memo(_chunk_ids)


def ngram_ids(text: str) -> np.ndarray:
    """Unique hashed ids of the word and shape n-grams of a whole text."""
    chunks = text.split()
    if not chunks:
        return np.zeros(0, np.uint32)
    # a long chunk is not kept in the cache
    made = [_ids[c] if len(c) <= 64 else _chunk_ids(c) for c in chunks]
    shapes, words = (np.frombuffer(b"".join(parts), "<u8") for parts in zip(*made))
    same = np.fromiter(itertools.chain((False,), map(str.__eq__, chunks[1:], chunks)), bool, len(chunks))
    if len(shapes) != len(chunks):  # a mark for each piece of a chunk
        same = np.repeat(same, np.fromiter((len(m) for m, _ in made), np.int64, len(made)) // 8)
    shapes = mix64(shapes + same.astype(np.uint64))
    words = mix64(words + np.uint64(1 << 40))
    grams = [shapes, mix64(shapes[:-1] * np.uint64(3) + shapes[1:]), mix64(shapes[:-2] * np.uint64(9) + shapes[1:-1] * np.uint64(5) + shapes[2:]), words, mix64(words[:-1] * np.uint64(3) + words[1:])]
    ids = (np.concatenate(grams) >> np.uint64(45)).astype(np.uint32)
    ids.sort()
    return ids[np.concatenate(([True], ids[1:] != ids[:-1]))]


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Linear support vectors with hinge loss; the bias is one more constant feature."""
    w, b = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float((scale[r] ** 2).sum()) + 1.0 for r in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            r = rows[i]
            s = scale[r]
            grad = y[i] * (float(w[r] @ s) + b) - 1.0
            new = min(max(alpha[i] - grad / norms[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * s
                b += step
                alpha[i] = new
    return w, b


class NaiveBayesSupportVectors:
    """``fit`` on rows of unique feature ids and 0/1 labels; ``margins``/``probability`` for others."""

    def __init__(self, dims: int = DIMS, least: int = 3, c: float = 0.1, rounds: int = 8, smooth: float = 1.0, seed: int = 7):
        self.dims, self.least, self.c, self.rounds, self.smooth, self.seed = dims, least, c, rounds, smooth, seed

    def _train(self, rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
        counts = [np.full(self.vocabulary.size, self.smooth) for _ in range(2)]
        for r, label in zip(rows, y):
            counts[int(label > 0)][r] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        # rows are scaled to unit length by the largest norm, so that c means the same at any length
        scale = ratio / max(1.0, np.sqrt(max((float((ratio[r] ** 2).sum()) for r in rows), default=1.0)) / 10)
        w, b = dual_descent(rows, scale, np.where(y > 0, 1.0, -1.0), self.c, self.rounds, self.seed)
        return w * scale, b

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> NaiveBayesSupportVectors:
        self.vocabulary = Vocabulary(rows, self.least, self.dims)
        rows = [self.vocabulary(r) for r in rows]
        self.weights, self.bias, self.slope, self.shift = np.zeros(self.vocabulary.size), 0.0, 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        if len(rows) >= 6 and 0 < y.sum() < len(y):
            part = np.arange(len(rows)) % 3
            out = np.zeros(len(rows))
            for k in range(3):
                inside = np.flatnonzero(part != k)
                if 0 < y[inside].sum() < len(inside):
                    w, b = self._train([rows[i] for i in inside], y[inside])
                    for i in np.flatnonzero(part == k):
                        out[i] = w[rows[i]].sum() + b
            self.slope, self.shift = logistic_fit(out, y)
            self.weights, self.bias = self._train(rows, y)
        self.table = np.zeros(self.dims)
        kept = self.vocabulary.index >= 0
        self.table[kept] = self.weights[self.vocabulary.index[kept]]
        return self

    def probability(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        margin = sums_by_row(self.table[ids], counts) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a one-dimensional logistic fit by damped Newton steps on smoothed targets."""
    n1 = y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - target) * x).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.0)), float(b)


def train_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, label_col: str = "quality", id_col: str = "doc_id") -> NaiveBayesSupportVectors:
    """Learn from at most ``max_rows`` labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, F.col(label_col), max_rows=max_rows, keep=fold(F.col("id")) != 0, id_col=id_col)
    model = NaiveBayesSupportVectors().fit(*collect_features(sample, ngram_ids))
    tidy(docs.sparkSession)
    return model


def score_quality(docs: DataFrame, model: NaiveBayesSupportVectors, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers

    def rows(batch):
        ids, counts = flat([ngram_ids(t.as_py() or "") for t in batch.column(2)])
        score = shared.value.probability(ids, counts)
        return [batch.column(0), batch.column(1), score, (score >= threshold).astype(np.int32)]

    return map_rows(docs.select(F.col(id_col), (fold(F.col(id_col)) == 0).alias("held_out"), F.col(text_col)), f"{id_col} {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int", rows)
