"""Settings with defaults, from the session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """All have a spark.galleria.<name> key."""

    embedding_dim: int = 512
    model_version: str = "default"
    threshold: float = 0.6
    top_k: int = 5
    target_active_photos: int = 1_000_000
    workers: int = 2
    soft_error_limit: float = 0.03
    batch_rows: int = 1024


def settings(spark: SparkSession) -> Settings:
    """The session's settings; texts are converted to each default's type."""
    given = {f.name: spark.conf.get(f"spark.galleria.{f.name}", None) for f in fields(Settings)}
    return Settings(**{f.name: type(f.default)(given[f.name]) for f in fields(Settings) if given[f.name] is not None})
