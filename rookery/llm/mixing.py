"""Mixing sources to target weights with soft domain membership.

A classifier learnt from a labelled table gives every document a posterior
over domains.  A document's expected tokens of a domain are its words times
the posterior; nonnegative rates per document are fitted so that the rated
totals of all domains match ``budget * weight``:

    minimise  sum_d ((sum_i r_i n_i p_id - t_d) / T_d)^2,   r >= least_rate, near r = 1

by projected Newton steps.  Of the rates that reach the totals, those nearest
to 1 (squares weighted by words, a millionth of the aim) are the projection
``max(least_rate, 1 - p . step)`` for one vector ``step`` with a number for each
domain, the least point of a convex function.  A Newton step with its line
search is one pass over the posteriors, summed where they lie; only domain
totals and domain x domain sums reach the driver.  The steps end when every
total is reached, or no step comes nearer (a warning gives the totals); a fit
that ends otherwise is an error.

``least_rate`` is 0 or more; with 1 every document stays and scarce domains
are repeated.  Unless given, the budget is the least total at which no domain
must shrink, with ``headroom`` beside it for documents between domains.

Classifier: multinomial logistic regression on the shares of hashed words
of at most ``max_rows`` labelled rows, trained on the driver.

Edge cases: null and empty texts have no words, the prior as posterior and
rate 1; without labelled rows there is one domain (null label) and all
rates are the budget over the total; a target for an unknown domain is left
out and the weights are scaled to 1; repeated rows get equal rates and equal
copies; columns of the table that have the names of the results are replaced.
"""

from __future__ import annotations

import struct
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import Memo, map_rows, small_batches, stored, sums_by_row
from rookery.llm.labelled import flat

DIMS = 1 << 16
MAX_ROWS = 6_000

_word_id = Memo(lambda w: struct.pack("<I", zlib.crc32(w.strip(".,;:!?\"'()&%$#*|").encode("utf-8", "replace")) % DIMS))


def word_ids(text: str) -> np.ndarray:
    """Hashed lower-cased words of a whole text, as often as they occur."""
    return np.frombuffer(b"".join(map(_word_id.__getitem__, text.lower().split())), "<u4")


@dataclass
class DomainModel:
    domains: list
    weights: np.ndarray  # DIMS x domains
    bias: np.ndarray

    def posteriors(self, rows: list[np.ndarray]) -> np.ndarray:
        ids, counts = flat(rows)
        z = sums_by_row(self.weights[ids], counts) / np.maximum(counts, 1)[:, None] + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_domains(rows: list[np.ndarray], labels: list, epochs: int = 30, rate: float = 0.5, decay: float = 1e-5, least: int = 3, seed: int = 3) -> DomainModel:
    """Full-batch Adam on the softmax loss over words that ``least`` rows have."""
    domains = sorted(set(labels), key=str)
    y = np.array([domains.index(x) for x in labels], np.int64)
    df = np.zeros(DIMS, np.int32)
    for r in rows:
        df[np.unique(r)] += 1
    keep = np.flatnonzero(df >= least)
    place = np.full(DIMS, -1, np.int64)
    place[keep] = np.arange(len(keep))
    prior = np.log(np.bincount(y, minlength=len(domains)) / max(1, len(y)))
    model = DomainModel(domains, np.zeros((DIMS, len(domains)), np.float32), prior.astype(np.float32))
    if len(domains) < 2 or not len(keep):
        return model
    cells, values = [], []
    for k, r in enumerate(rows):
        at, n = np.unique(place[r], return_counts=True)
        cells.append(np.stack([np.full((at >= 0).sum(), k), at[at >= 0]]))
        values.append(n[at >= 0] / max(1, len(r)))
    (row, col), value = np.concatenate(cells, axis=1), np.concatenate(values)
    w = np.zeros((len(keep), len(domains)))
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        z = np.stack([np.bincount(row, value * w[col, d], len(rows)) for d in range(len(domains))], axis=1) + prior
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = z / z.sum(axis=1, keepdims=True)
        error[np.arange(len(rows)), y] -= 1
        g = np.stack([np.bincount(col, value * error[row, d], len(keep)) for d in range(len(domains))], axis=1) / len(rows) + decay * w
        m += 0.1 * (g - m)
        s += 0.02 * (g * g - s)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-9)
    model.weights[keep] = w
    return model


def train_domains(docs: DataFrame, labelled: DataFrame, *, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DomainModel:
    """Learn from the texts of the ``max_rows`` labelled ids of least hash; null ids and labels take no part."""
    ids = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).filter("id is not null and domain is not null")
    ids = ids.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # the broadcast side has max_rows short rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").groupBy("id", "domain").agg(F.min("text").alias("text"))
    got = map_rows(rows.select("domain", F.xxhash64("id").alias("h"), "text"), "domain string, h long, ids binary", lambda b: [b.column(0), b.column(1), [word_ids(t.as_py() or "").tobytes() for t in b.column(2)]]).collect()
    got = sorted(got, key=lambda r: (r["h"], r["domain"]))
    if not got:
        return DomainModel([None], np.zeros((DIMS, 1), np.float32), np.zeros(1, np.float32))
    return fit_domains([np.frombuffer(r["ids"], "<u4") for r in got], [r["domain"] for r in got])


def fold_rates(p: np.ndarray, steps: np.ndarray, least_rate: float = 0.0) -> np.ndarray:
    """Rates after projected steps from 1: ``r <- max(least_rate, r - p . step)``."""
    r = np.maximum(least_rate, np.ones(len(p)))
    for step in steps:
        r = np.maximum(least_rate, r - p @ step)
    return r


def _posterior_rows(docs: DataFrame, model: DomainModel, text_col: str, schema) -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x domains numbers
    where, names = docs.columns.index(text_col), [f.name for f in schema]
    kept = [k for k, c in enumerate(docs.columns) if c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_ids(t.as_py() or "") for t in batch.column(where)]
            p = shared.value.posteriors(words)
            n = np.array([len(w) for w in words], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], names=names)

    return docs.mapInArrow(run, schema)


def _totals(table: DataFrame, points: np.ndarray, least_rate: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each point: the sum of n h(1 - p . point), the rated token totals of the domains, and the sum of n p p' of the free rows.

    ``h`` has the rate as its slope; a row is free unless its rate is held at ``least_rate``.
    """
    domains, start = points.shape[1], max(1.0, least_rate)
    width = 1 + domains + domains * domains

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(points), width))
        for batch in batches:
            if batch.num_rows:
                n = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
                p = batch.column(1).flatten().to_numpy().reshape(-1, domains)
                for k, point in enumerate(points):
                    z = start - p @ point
                    free = z >= least_rate
                    total[k, 0] += (n * np.where(free, z * z / 2, least_rate * (z - least_rate / 2))).sum()
                    total[k, 1 : 1 + domains] += p.T @ (n * np.where(free, z, least_rate))
                    total[k, 1 + domains :] += ((p * (n * free)[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["k", "x"])

    got = table.select("_n_words", "_posterior").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(points) * width)
    for r in got:
        out[r["k"]] = r["x"]
    return [(float(row[0]), row[1 : 1 + domains], row[1 + domains :].reshape(domains, domains)) for row in out.reshape(-1, width)]


def project_rates(table: DataFrame, domains: list, targets: dict, budget: float | None, *, least_rate: float = 0.0, headroom: float = 0.05, most_steps: int = 40, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(steps, totals reached, totals wanted)``; at most ``most_steps`` passes after the first."""
    step = np.zeros(len(domains))
    value, now, gram = _totals(table, step[None, :], least_rate)[0]
    have = now / max(1.0, least_rate)
    weights = np.array([float(targets.get(d, 0.0)) for d in domains])
    weights = weights / weights.sum() if weights.sum() > 0 else np.full(len(domains), 1 / len(domains))
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.nanmax(np.where(weights > 0, have / weights, 0.0))
    want = weights * (float(budget) if budget is not None else float(least) * (1 + headroom))
    scale = np.maximum(have, 1e-9)
    near_one = 1e-6 / max(1.0, float(have.sum())) * scale**2
    reached = lambda x: bool((np.abs(x - want) <= tolerance * np.maximum(want, tolerance * want.max())).all())
    rest = lambda x, at: want - x + near_one * at  # noqa: E731  the slope of the convex function
    flat = lambda slope: float(np.abs(slope / scale).max()) <= 1e-6
    lengths = 0.25 ** np.arange(8)
    for _ in range(most_steps):
        slope = rest(now, step)
        if reached(now) or flat(slope):
            break
        curve = gram + np.diag(near_one)
        unit = 1 / np.sqrt(np.diag(curve))
        move = -unit * np.linalg.solve(unit[:, None] * curve * unit[None, :], unit * slope)
        points = step + lengths[:, None] * move
        tried = _totals(table, points, least_rate)
        values = [t[0] + p @ want + near_one @ (p * p) / 2 for t, p in zip(tried, points)]
        best = int(np.argmin(values))
        if np.abs(rest(tried[0][1], points[0]) / scale).max() < np.abs(slope / scale).max() / 2 and values[0] <= value + 1e-9 * abs(value):
            best = 0  # near the least point the values differ by rounding only
        step, value, (_, now, gram) = points[best], values[best], tried[best]
    if not reached(now):
        said = "; ".join(f"{d}: {x:.0f} of {w:.0f}" for d, x, w in zip(domains, now, want))
        if not flat(rest(now, step)):
            raise RuntimeError(f"the rates have not converged in {most_steps} steps; tokens reached of wanted: {said}")
        warnings.warn(f"no rates of at least {least_rate} reach the wanted tokens; the nearest, reached of wanted: {said}", stacklevel=2)
    return (step[None, :] if step.any() else np.zeros((0, len(domains)))), now, want


def mix(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict, *, budget: float | None = None, least_rate: float = 1.0, headroom: float = 0.05, max_rows: int = MAX_ROWS, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", seed: int = 42) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) plus ``n_words, posterior, rate, copies``.

    ``labelled`` has ``id_col`` and ``domain_col``.  ``copies`` rounds the rate
    up or down by a hash of id and text.
    """
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    own = ("_n_words", "_posterior", "_u", "n_words", "posterior", "rate", "copies")
    docs = docs.select(*[c for c in docs.columns if c not in own])
    model = train_domains(docs, labelled, max_rows=max_rows, id_col=id_col, text_col=text_col, domain_col=domain_col)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = docs.withColumn("_u", u)
    fields = [f for f in drawn.schema.fields if keep_text or f.name != text_col]
    schema = StructType([*fields, StructField("_n_words", LongType()), StructField("_posterior", ArrayType(DoubleType()))])
    table = stored(spark, _posterior_rows(drawn, model, text_col, schema), "posteriors")
    steps, _, _ = project_rates(table, model.domains, targets, budget, least_rate=least_rate, headroom=headroom)
    names = [*(f.name for f in fields), "n_words", "posterior", "rate"]
    out_schema = StructType([*fields, StructField("n_words", LongType()), StructField("posterior", ArrayType(DoubleType())), StructField("rate", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(batch.num_rows, -1)
            n = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            rate = np.where(n > 0, fold_rates(p, steps, least_rate), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=names)

    return table.mapInArrow(run, out_schema).withColumn("copies", F.floor(F.col("rate") + F.col("_u")).cast("int")).drop("_u")


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` as often as their copies say, without its columns."""
    kept = [c for c in mixed.columns if c not in ("n_words", "posterior", "rate", "copies")]
    return mixed.filter("copies > 0").select(*kept, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def mixed_rows(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict, **options) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` says, with all their columns, whatever the names; options as in ``mix``."""
    text_col = options.get("text_col", "text")
    ids = [options.get("id_col", "doc_id"), text_col]
    plain = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c not in ids}
    out = repeated(mix(spark, docs.select(*[F.col(c).alias(plain.get(c, c)) for c in docs.columns]), labelled, targets, **options))
    return out.select(*[F.col(plain.get(c, c)).alias(c) for c in docs.columns])
