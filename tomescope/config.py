"""Parameters of the recommendation funnel and of the index builders.

Defaults are the values the reference uses; tests pass smaller cuts so that every stage
really cuts on the small fixtures.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # --- candidate funnel (cut sizes per query) ---
    k_retrieve: int = 5000  # ANN / exact top-k on the expanded query
    k_filtered: int = 300  # metadata-filtered candidates that get reranked
    k_rerank: int = 50  # best by blended score, before author dedup
    k_dedup: int = 30  # after best-per-author
    k_final: int = 5  # MMR picks
    # --- rerank blend ---
    w_semantic: float = 0.85
    w_rating: float = 0.15
    # --- MMR ---
    mmr_lambda: float = 0.7
    # --- filters ---
    floor_default: float = 3.0  # "Any rating" still means >= 3.0
    floor_acclaimed: float = 4.0
    max_pages_default: int = 800
    # --- encoder ---
    dim: int = 256
    chunk_tokens: int = 0  # retrieval vectors are of chunks of so many tokens, a book counts by its best one (0: of whole texts)
    # --- BM25 ---
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    # --- index ---
    nlist: int = 1024
    pq_m: int = 96
    pq_bits: int = 8
    nprobe: int = 256
    refine: int = 1  # code hits per kept hit that are fetched and ranked by exact score (1: code scores as they are)
    kmeans_iter: int = 20
    seeding: str = "parallel"  # start of k-means: "parallel" (k-means||, empty lists refilled) or "hash" (rows of smallest md5)
    seed: int = 42
    # --- search path of recommend: "exact" or "ivfpq" ---
    search: str = "exact"
    # Scores are ranked as they are; a number rounds them first (SQL comparison: 6).
    score_decimals: int | None = None
    # --- physical knobs ---
    # Largest query block (bytes of query vectors) shipped to executors in one broadcast.
    # Query tables above it are processed in several blocks.
    max_broadcast_bytes: int = 64 * 1024 * 1024

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
