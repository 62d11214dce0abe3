"""Registered settings of the analyses, with a hash that names them."""

from __future__ import annotations

import dataclasses
import hashlib
import json


@dataclasses.dataclass(frozen=True)
class Settings:
    """Defaults of every operator that is tuned; the values are fixed by the published configuration."""

    rare_corpus_frequency: int = 3
    high_df_ratio: float = 0.1
    formulaic_df_ratio: float = 0.05
    formulaic_corpus_count: int = 20
    proposal_df_ratio: float = 0.25
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rrf_k: int = 60
    proposal_k: int = 250
    persisted_k: int = 100
    rerank_k: int = 25
    penalties: tuple[float, float, float] = (0.5, 0.5, 0.75)
    nearby_verses: int = 5
    short_passage: int = 5
    null_iterations: int = 100
    permutation_iterations: int = 1000
    bootstrap_iterations: int = 1000
    maximum_fdr: float = 0.2
    maximum_q: float = 0.05
    score_decimals: int = 12
    tier_b_size: int = 100
    seeds: tuple[tuple[str, int], ...] = (("within_book_reassignment", 7101), ("frequency_preserving_synthetic", 7102), ("bootstrap", 7201), ("stratified_permutation", 9113))

    def digest(self) -> str:
        """SHA-256 of the typed values; equal settings have equal digests."""
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def load(path: str) -> Settings:
    """Settings from a JSON object of overrides; unknown names and wrong types fail."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    known = {x.name: x for x in dataclasses.fields(Settings)}
    if extra := set(given) - set(known):
        raise ValueError(f"unknown settings: {sorted(extra)}")
    base = Settings()
    for n, v in given.items():
        if isinstance(getattr(base, n), tuple):
            given[n] = tuple(tuple(x) if isinstance(x, list) else x for x in v)
        elif type(v) is not type(getattr(base, n)):
            raise ValueError(f"{n}: {v!r} has the wrong type")
    return dataclasses.replace(base, **given)
