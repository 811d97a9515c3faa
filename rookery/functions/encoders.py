"""Vector encoders: an interface, seeded projections and layered networks, PCA.

No trained weights exist, so networks get seeded weights unless weights are
given; their shapes are the interface.  Weights are a fixed size and are
broadcast; rows go through in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TENSOR_CELLS, BITBOARD_BITS = 960, 773


class Encoder(Protocol):
    in_size: int
    out_size: int

    def __call__(self, x: np.ndarray) -> np.ndarray: ...


@dataclass
class RandomProjection:
    """A seeded Gaussian projection: distances are kept roughly, without training."""

    in_size: int = BITBOARD_BITS
    out_size: int = 256
    seed: int = 42

    def __post_init__(self) -> None:
        self.weights = np.random.default_rng(self.seed).normal(0, 1 / np.sqrt(self.out_size), (self.in_size, self.out_size)).astype(np.float32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float32) @ self.weights


@dataclass
class LayeredEncoder:
    """Rectified dense layers; ``sums`` names the kind of skip connections.

    ``none``: the last layer is the vector.  ``heads``: every layer feeds a
    head of the output size, and the heads are added.  ``residual``: every
    layer after the first is added to its input.
    """

    widths: tuple[int, ...]
    sums: str = "none"
    head: int = 0
    in_size: int = TENSOR_CELLS
    seed: int = 42
    weights: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.out_size = self.head or self.widths[-1]
        if not self.weights:
            draw, size = np.random.default_rng(self.seed), self.in_size
            for width in self.widths:
                self.weights.append(self._layer(draw, size, width))
                if self.head:
                    self.weights.append(self._layer(draw, width, self.head))
                size = width

    @staticmethod
    def _layer(draw: np.random.Generator, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
        limit = np.sqrt(6 / (rows + columns))
        return draw.uniform(-limit, limit, (rows, columns)).astype(np.float32), np.zeros(columns, np.float32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        dense = lambda v, layer: np.maximum(v @ layer[0] + layer[1], 0)
        v, total = x.astype(np.float32), 0
        layers = iter(self.weights)
        for k in range(len(self.widths)):
            new = dense(v, next(layers))
            v = v + new if self.sums == "residual" and k else new
            if self.head:
                total = total + dense(v, next(layers))
        return total if self.head else v


_FACTORIES: dict[str, Callable[[], Encoder]] = {
    "random_projection": RandomProjection,
    "vanilla_dense": lambda: LayeredEncoder((2048, 1024, 512, 256)),
    "skip_dense": lambda: LayeredEncoder((6144, 3072, 1536), head=768),
    "skip_equi_dense": lambda: LayeredEncoder((2560, 2560, 2560), sums="residual"),
    "trivial": lambda: LayeredEncoder((5120,)),
}
#: Named, but not runnable without trained weights and a tensor library.
UNAVAILABLE = ("cnn_dense", "encoder_decoder_transformer")


def get_model(name: str) -> Encoder:
    if name in UNAVAILABLE:
        raise NotImplementedError(f"{name} needs trained weights; give an Encoder of your own to encode_with")
    if name not in _FACTORIES:
        raise ValueError(f"unknown model {name!r}; known: {sorted(_FACTORIES)}")
    return _FACTORIES[name]()


def register_model(name: str, factory: Callable[[], Encoder]) -> None:
    _FACTORIES[name] = factory


def encode_with(df: DataFrame, encoder: Encoder, column: str, *, id_col: str = "id", name: str = "embedding") -> DataFrame:
    """``id, embedding`` of an array column, batch by batch."""
    shared = df.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                x = np.stack([np.asarray(v, np.float32) for v in part["x"]]) if len(part) else np.zeros((0, shared.value.in_size), np.float32)
                yield pd.DataFrame({"id": part["id"].to_numpy(), name: list(shared.value(x))})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<float>").alias("x"))
    return rows.mapInPandas(run, f"id long, {name} array<float>")


def pca(df: DataFrame, column: str, k: int = 2, *, id_col: str = "id") -> DataFrame:
    """``id, components``: the first k principal components of the centred vectors; each sign is arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(F.col(id_col).alias("id"), array_to_vector(F.col(column).cast("array<double>")).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="x").fit(rows).transform(rows)
    return PCA(k=k, inputCol="x", outputCol="pc").fit(centred).transform(centred).select("id", vector_to_array("pc").alias("components"))


def artefact_name(label: str):
    """``yyyyMMddHHmmss_label`` of now, as a column."""
    return F.concat(F.date_format(F.current_timestamp(), "yyyyMMddHHmmss"), F.lit(f"_{label}"))


def save_model(model, root: str, label: str) -> str:
    """Writes a fitted MLlib model under a time-stamped name and returns its path."""
    from datetime import UTC, datetime

    path = f"{root}/{datetime.now(UTC):%Y%m%d%H%M%S}_{label}"
    model.write().save(path)
    return path
