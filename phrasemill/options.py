"""Options of search, index and evaluation, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Per-dataset evaluation: how answers are matched, and whether candidates restrict them.
DATASETS = {"trec": {"match": "regex"}, "webq": {"candidates": True}}


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 10
    probes: int = 256
    max_answer_length: int = 10
    unit: str = "phrase"
    strategy: str | None = None
    truecase: bool = False

    def __post_init__(self):
        from .operators.search import STRATEGY

        if self.unit not in STRATEGY:
            raise ValueError(f"unit must be one of {sorted(STRATEGY)}")
        if self.top_k < 1 or self.probes < 1 or self.max_answer_length < 1:
            raise ValueError("top_k, probes and max_answer_length must be positive")

    @property
    def merge(self) -> str:
        from .operators.search import STRATEGY

        return self.strategy or STRATEGY[self.unit]

    @property
    def fetch(self) -> int:
        """Hits to fetch: more than are asked for, as merging drops some."""
        return self.top_k if self.unit == "phrase" else 2 * self.top_k


@dataclass(frozen=True)
class IndexOptions:
    clusters: int = 256
    parts: int = 96
    rotate: bool = True
    threshold: float = 0.0
    norm_limit: float | None = None
    sample: float = 0.2
    seed: int = 29
    first_passage: bool = False


@dataclass(frozen=True)
class EvaluationOptions:
    dataset: str = "nq"
    top_k: int = 10
    ks: tuple[int, ...] = field(default=(1, 5, 20, 100))

    @property
    def match(self) -> str:
        return DATASETS.get(self.dataset, {}).get("match", "exact")

    @property
    def restricted(self) -> bool:
        return DATASETS.get(self.dataset, {}).get("candidates", False)
