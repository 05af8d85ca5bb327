"""Effective parameters; presets for the two benchmark styles. No environment is read by operators."""

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class MemoryConfig:
    decay_rate: float = 0.995
    learning_rate: float = 0.01
    alpha: float = 0.1
    spread_threshold: float = 0.4
    max_flipped: int = 5
    keyword_weight: float = 0.5
    use_keywords: bool = True
    decay_mode: str = "constant"  # retrieval never decays; "exponential" is what is documented
    tau: float = 1e7
    top_k: int = 20
    kb_top_k: int = 5
    buffer_turns: int = 10
    hub_degree: int = 3
    max_clusters: int = 20
    cluster_size: int = 8
    min_similarity: float = 0.5
    similarity_gain: float = 0.3
    neighbours: int = 5
    flipped_in_context: bool = True


DEFAULT = MemoryConfig()
LONGMEMEVAL = replace(DEFAULT, learning_rate=0.02, max_flipped=3, keyword_weight=0.7, top_k=15, flipped_in_context=False)
LOCOMO = replace(DEFAULT, learning_rate=0.02, spread_threshold=0.6, top_k=10, tau=5184000.0)
