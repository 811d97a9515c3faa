"""Toxicity: a factorisation machine over hashed terms.

Terms are the words of the whole text (lower-cased, letters only) and their
first four and five letters, hashed.  The machine adds to a linear model one
weight for every pair of present terms, the inner product of two short
vectors, so that pairs such as an insult with a group mention count beyond
their parts.  It is trained on a bounded labelled sample by Adam steps on
the logistic loss.  Terms that tell the classes of the sample apart neither
alone nor in a pair are left out: pairs of the ``pair_terms`` most frequent
terms are counted jointly, so that a group's name as usual in clean texts as
in toxic ones stays if it does so beside another word.

Edge cases: null and empty texts have no term and get the bias's score; if
the labelled rows are none or of one class, every score is that class's
smoothed share; repeated rows are scored alike.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import Memo, fold, map_rows, small_batches, sums_by_row, tidy
from rookery.llm.labelled import collect_features, flat, labelled_sample

DIMS = 1 << 20
MAX_ROWS = 16_000
_LETTERS = re.compile(r"[^\W\d_]+")


def _terms(chunk: str) -> bytes:
    ids = []
    for word in (chunk,) if chunk.isalpha() else _LETTERS.findall(chunk):
        ids.append(zlib.crc32(word.encode("utf-8", "replace")) % DIMS)
        if len(word) >= 4:
            ids.append(zlib.crc32(word[:4].encode("utf-8", "replace"), 4) % DIMS)
            if len(word) >= 5:
                ids.append(zlib.crc32(word[:5].encode("utf-8", "replace"), 5) % DIMS)
    return struct.pack(f"<{len(ids)}I", *ids)


_chunk_terms = Memo(_terms)


def term_ids(text: str) -> np.ndarray:
    """Unique hashed terms of a whole text."""
    return np.unique(np.frombuffer(b"".join(map(_chunk_terms.__getitem__, set(text.lower().split()))), "<u4"))


class FactorisationMachine:
    """``fit`` on rows of unique term ids and 0/1 labels.

    The value of a present term is fixed before training: by how many standard
    errors its share differs between the classes, over ``full``, 1 at most, and
    0 under ``least_z`` (a term that says nothing would only be memorised).
    A term counts as much as its best pair does, if the pair differs by
    ``pair_z`` errors, and by ``beyond`` more than either of its terms.
    """

    def __init__(self, dims: int = DIMS, factors: int = 4, least: int = 4, least_z: float = 4.0, full: float = 8.0, epochs: int = 20, batch: int = 128, rate: float = 0.03, decay: float = 1e-4, seed: int = 11, pair_terms: int = 1_500, pair_z: float = 7.0, beyond: float = 3.0):
        self.dims, self.factors, self.least, self.least_z, self.full, self.epochs, self.batch, self.rate, self.decay, self.seed = dims, factors, least, least_z, full, epochs, batch, rate, decay, seed
        self.pair_terms, self.pair_z, self.beyond = pair_terms, pair_z, beyond

    def _raw(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """bias + sum of weights + half of (squared sums less sums of squares) of the factors, for places in ``kept``."""
        w, v = self.weights[places], self.vectors[places]
        sums = sums_by_row(v, counts)
        return self.bias + sums_by_row(w, counts) + 0.5 * (sums**2 - sums_by_row(v**2, counts)).sum(axis=1)

    def raw(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """As ``_raw``, for rows of term ids; only the terms kept count."""
        if not len(self.kept):
            return np.full(len(counts), self.bias)
        places = np.minimum(np.searchsorted(self.kept, ids), len(self.kept) - 1)
        found = self.kept[places] == ids
        return self._raw(places[found], np.bincount(np.repeat(np.arange(len(counts)), counts)[found], minlength=len(counts)))

    @staticmethod
    def _errors(in_toxic: np.ndarray, in_clean: np.ndarray, n1: float, n0: float) -> np.ndarray:
        """By how many standard errors the share among toxic rows is above that among clean ones."""
        share = (in_toxic + in_clean + 0.5) / (n0 + n1 + 1)
        return (in_toxic / n1 - in_clean / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))

    def _values(self, rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        seen = np.zeros((2, self.dims), np.int32)
        for r, label in zip(rows, y):
            seen[int(label > 0)][r] += 1
        n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
        n = seen.sum(axis=0)
        out = np.zeros(self.dims)
        common = np.flatnonzero(n >= self.least)
        z = self._errors(seen[1, common], seen[0, common], n1, n0)
        out[common] = np.where(np.abs(z) >= self.least_z, np.minimum(1.0, np.abs(z) / self.full), 0.0)
        # the most frequent terms, but those that most rows have
        some = np.flatnonzero(n[common] <= len(rows) / 2)
        some = np.sort(some[np.lexsort((common[some], -n[common[some]]))[: self.pair_terms]])
        place = np.full(self.dims, -1, np.int32)
        place[common[some]] = np.arange(len(some))
        both = np.zeros((2, len(some), len(some)), np.float32)
        for k in (0, 1):
            mine = np.flatnonzero((y > 0) == k)
            for at in range(0, len(mine), 256):
                part = np.zeros((len(mine[at : at + 256]), len(some)), np.float32)
                for i, row in enumerate(mine[at : at + 256]):
                    r = place[rows[row]]
                    part[i, r[r >= 0]] = 1
                both[k] += part.T @ part
        alone = np.abs(z[some])
        for at in range(0, len(some), 128):  # a few rows of the pairs at a time
            joint = self._errors(both[1, at : at + 128], both[0, at : at + 128], n1, n0)
            enough = both[:, at : at + 128].sum(axis=0) >= 2 * self.least
            joint = np.where(enough & (np.abs(joint) >= self.pair_z) & (np.abs(joint) >= self.beyond + np.maximum(alone[at : at + 128, None], alone[None, :])), np.abs(joint), 0.0)
            of = common[some[at : at + 128]]
            out[of] = np.maximum(out[of], np.minimum(1.0, joint.max(axis=1, initial=0.0) / self.full))
        return out

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> FactorisationMachine:
        rng, values = np.random.default_rng(self.seed), self._values(rows, y)
        kept = np.flatnonzero(values)
        n, place = len(kept), np.full(self.dims, -1, np.int32)
        place[kept] = np.arange(n)
        x = values[kept]
        self.kept = kept.astype(np.uint32)
        self.bias, weights, vectors = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros(n), rng.normal(0, 0.01, (n, self.factors))
        if n and 0 < y.sum() < len(y):
            rows = [at[at >= 0] for at in (place[r] for r in rows)]
            cost = np.where(y > 0, np.sqrt(max(1.0, (len(y) - y.sum()) / y.sum())), 1.0)  # the rarer class is the toxic one
            params, m, s, step = [weights, vectors], [np.zeros(n), np.zeros((n, self.factors))], [np.zeros(n), np.zeros((n, self.factors))], 0
            for _ in range(self.epochs):
                order = rng.permutation(len(rows))
                for at in range(0, len(order), self.batch):
                    pick = order[at : at + self.batch]
                    ids, counts = flat([rows[i] for i in pick])
                    step += 1
                    row = np.repeat(np.arange(len(pick)), counts)
                    self.weights, self.vectors = weights * x, vectors * x[:, None]
                    error = (1 / (1 + np.exp(-np.clip(self._raw(ids, counts), -30, 30))) - y[pick]) * cost[pick] / len(pick)
                    self.bias -= self.rate * float(error.sum())
                    v = self.vectors[ids]
                    gv = (error[row] * x[ids])[:, None] * (sums_by_row(v, counts)[row] - v)
                    grads = [np.bincount(ids, error[row] * x[ids], n), np.stack([np.bincount(ids, gv[:, f], n) for f in range(self.factors)], axis=1)]
                    for k, (param, g) in enumerate(zip(params, grads)):
                        g += self.decay * param
                        m[k] += 0.1 * (g - m[k])
                        s[k] += 0.001 * (g * g - s[k])
                        param -= self.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8) * (0.2 if k else 1.0)
        else:
            vectors[:] = 0
        self.weights, self.vectors = weights * x, vectors * x[:, None]
        return self

    def probability(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, counts), -30, 30)))


def train_toxicity(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, label_col: str = "toxic", id_col: str = "doc_id") -> FactorisationMachine:
    """Learn from at most ``max_rows`` labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, F.col(label_col), max_rows=max_rows, keep=fold(F.col("id")) != 0, id_col=id_col)
    model = FactorisationMachine().fit(*collect_features(sample, term_ids))
    tidy(docs.sparkSession)
    return model


def _scores(model, texts) -> np.ndarray:
    ids, counts = flat([term_ids(t.as_py() or "") for t in texts])
    return model.probability(ids, counts)


def score_toxicity(docs: DataFrame, model: FactorisationMachine, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the terms kept, at most those that ``least`` sampled rows have

    def rows(batch):
        score = _scores(shared.value, batch.column(2))
        return [batch.column(0), batch.column(1), score, (score >= threshold).astype(np.int32)]

    return map_rows(docs.select(F.col(id_col), (fold(F.col(id_col)) == 0).alias("held_out"), F.col(text_col)), f"{id_col} {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int", rows, size=256)


def drop_toxic(docs: DataFrame, model: FactorisationMachine, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = pa.array(_scores(shared.value, part.column(names.index(text_col))) < threshold)
                yield part.filter(keep)

    return docs.mapInArrow(run, docs.schema)
