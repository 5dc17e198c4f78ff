"""Settings of retrieval and prompt assembly."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConf:
    """top_n chunks are retrieved; admitted ones must fit context_window less prompt_buffer tokens. batch: texts an embedding call takes."""

    top_n: int = 15
    context_window: int = 8000
    prompt_buffer: int = 1500
    order_from_source: bool = False
    embedding_model: str = "multilingual-e5"
    batch: int = 10
    ram_watts_per_gb: float = 0.375
    seconds_to_first_token: int = 40
    seconds_per_request: int = 40

    @property
    def budget(self) -> int:
        return self.context_window - self.prompt_buffer

    @classmethod
    def of(cls, spark: SparkSession) -> EngineConf:
        """Defaults, overridden by lodestone.<field> in the session's settings."""
        found = {}
        for f in fields(cls):
            if (v := spark.conf.get(f"lodestone.{f.name}", None)) is not None:
                found[f.name] = v.strip().lower() in {"1", "true", "t", "yes", "y", "on"} if f.type == "bool" else {"int": int, "float": float}.get(f.type, str)(v)
        return cls(**found)
