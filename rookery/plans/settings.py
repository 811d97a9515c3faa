"""Settings of the position pipeline, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from rookery.functions.encoding import ENCODERS


def _need(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


@dataclass(frozen=True)
class SamplingFilters:
    min_elo: int = 2000
    min_ply: int = 0
    max_ply: int | None = None
    subsample_rate: float = 0.33
    ply_mode: str = "linear"

    def __post_init__(self) -> None:
        _need(self.min_ply >= 0, "min_ply is 0 or more")
        _need(self.max_ply is None or self.max_ply >= self.min_ply, "max_ply is at least min_ply")
        _need(0 < self.subsample_rate <= 1, "subsample_rate is in (0, 1]")
        _need(self.ply_mode in ("linear", "squared"), "ply_mode is linear or squared")


@dataclass(frozen=True)
class DatasetSettings:
    name: str
    data_path: str
    output_path: str
    batch_size: int = 100_000
    encoding: str = "token_sequence"
    train_ratio: float = 0.9

    def __post_init__(self) -> None:
        _need(bool(self.name), "a dataset needs a name")
        _need(self.batch_size > 0, "batch_size is positive")
        _need(0 < self.train_ratio < 1, "train_ratio is between 0 and 1")
        _need(self.encoding in ENCODERS, f"unknown encoding {self.encoding!r}")


@dataclass(frozen=True)
class EncoderSettings:
    encoding: str = "token_sequence"
    window_size: int = 8

    def __post_init__(self) -> None:
        _need(self.encoding in ENCODERS, f"unknown encoding {self.encoding!r}")
        _need(self.window_size > 0, "window_size is positive")


@dataclass(frozen=True)
class PreprocessingSettings:
    filters: SamplingFilters = field(default_factory=SamplingFilters)
    seed: int = 42
    debug: bool = False
