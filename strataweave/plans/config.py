"""What the engine does, in one object."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    contextual_embeddings: bool = False
    hybrid_search: bool = False
    agentic_rag: bool = False
    reranking: bool = False
    knowledge_graph: bool = False
    chunk_size: int = 5000
    code_block_least: int = 1000
    requests_per_minute: int = 60
    burst: int = 10

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConfig:
        """Switches are on for 'true' in any case."""
        held = os.environ if env is None else env
        on = lambda name: held.get(name, "").strip().lower() == "true"
        return cls(
            on("USE_CONTEXTUAL_EMBEDDINGS"), on("USE_HYBRID_SEARCH"), on("USE_AGENTIC_RAG"), on("USE_RERANKING"), on("USE_KNOWLEDGE_GRAPH"),
            requests_per_minute=int(held.get("REQUESTS_PER_MINUTE", "60")),
        )
