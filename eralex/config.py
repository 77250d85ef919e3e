"""Settings with defaults, from the environment or the session."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    cut_over: str = "2024-07-01"
    demotion: float = 0.05
    pool: int = 50
    rrf_k: int = 60
    embedding_dim: int = 256
    rerank_head: int = 20
    chunk_words: int = 512
    max_configs: int = 36

    @classmethod
    def read(cls, spark: SparkSession | None = None) -> Settings:
        """``eralex.NAME`` of the session, else ``ERALEX_NAME`` of the environment, else the default."""
        got = {}
        for f in fields(cls):
            v = spark.conf.get(f"eralex.{f.name}", None) if spark else None
            v = os.environ.get(f"ERALEX_{f.name.upper()}") if v is None else v
            if v is not None:
                got[f.name] = type(f.default)(v)
        return cls(**got)
