"""Settings of a run, from the environment or given; and the snapshot that is kept with its results."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field

PREFIX = "EVAL_"


@dataclass(frozen=True)
class Settings:
    """What a run depends on. Names with a route or a store must tell that they are for evaluation."""

    store_path: str = "eval-store"
    collection_name: str = "eval_chunks"
    vector_buckets: int = 16
    user_id: int = 990001
    dense_model: str = ""
    dense_dimension: int = 1024
    dense_batch: int = 10
    sparse_provider: str = "stub"
    sparse_top_k: int = 256
    sparse_min_weight: float = 0.0
    bm25_mode: str = "on"
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    bm25_coarse_length: float = 200.0
    bm25_fine_length: float = 220.0
    bm25_coarse_boost: float = 2.0
    top_k: int = 10
    score_threshold: float = 0.0
    enabled_sources: tuple[str, ...] = ("bm25", "dense", "sparse")
    rrf_k: int = 60
    route_top_ks: dict[str, int] = field(default_factory=dict)
    route_score_thresholds: dict[str, float] = field(default_factory=dict)
    fusion_strategy: str = "rrf"
    fusion_weights: dict[str, float] = field(default_factory=lambda: {"dense": 0.9, "sparse": 0.1})
    rerank_top_n: int = 0
    chat_model: str = ""
    judge_model: str = ""
    generator_model: str = ""
    judge_retries: int = 6
    judge_longest_wait: float = 30.0
    sparse_model: str = ""
    sparse_batch: int = 1
    ingest_batch: int = 25
    retries: int = 3
    git_sha: str = ""

    def __post_init__(self) -> None:
        if "eval" not in self.collection_name:
            raise ValueError(f"collection_name {self.collection_name!r} must name what it is for: eval")
        for name, value, allowed in (("sparse_provider", self.sparse_provider, ("stub", "ark", "bge")), ("fusion_strategy", self.fusion_strategy, ("rrf", "weighted_score")), ("bm25_mode", self.bm25_mode, ("on", "off", "stub"))):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")

    @property
    def routes(self) -> tuple[str, ...]:
        """The routes that are assembled: without BM25 where it is off or a stub."""
        return tuple(s for s in self.enabled_sources if s != "bm25" or self.bm25_mode == "on")

    @classmethod
    def read(cls, environment: dict[str, str] | None = None, **given) -> Settings:
        """Fields from EVAL_ variables, lists and maps as JSON; what is given stands above them."""
        found, environment = {}, dict(os.environ) if environment is None else environment
        defaults = cls()
        for f in dataclasses.fields(cls):
            raw = environment.get(PREFIX + f.name.upper())
            if raw is not None:
                like = getattr(defaults, f.name)
                found[f.name] = raw if isinstance(like, str) else type(like)(json.loads(raw)) if isinstance(like, tuple | dict) else type(like)(raw)
        return cls(**found | given)

    def snapshot(self, spark):
        """One row of all fields but the store's path, beside a run's results."""
        rows = {k: list(v) if isinstance(v, tuple) else v for k, v in dataclasses.asdict(self).items() if k != "store_path"}
        rows["sparse_vector_provider"] = rows.pop("sparse_provider")
        kinds = {str: "string", int: "long", float: "double", list: "array<string>"}
        of = {"route_top_ks": "map<string,long>", "route_score_thresholds": "map<string,double>", "fusion_weights": "map<string,double>"}
        return spark.createDataFrame([tuple(rows.values())], ", ".join(f"{k} {of.get(k) or kinds[type(v)]}" for k, v in rows.items()))

    def shown(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2, ensure_ascii=False, sort_keys=True)
