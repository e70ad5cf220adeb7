"""Tunable values of chunking, search and answering, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    chunk_chars: int = 2400
    chunk_overlap: int = 200
    top_k: int = 5
    rrf_k: int = 60
    candidates: int = 12
    w_vector: float = 1.0
    w_lexical: float = 1.0
    w_number: float = 3.0
    df_limit: float = 0.12
    rare_terms: int = 3
    relevance_min: float = 0.42
    context_ratio: float = 0.70
    context_min: int = 2
    answer_chars: int = 700
    loop_tail: int = 48
    loop_times: int = 3
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


DEFAULT = Params()
