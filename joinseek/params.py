"""Settings of a join search."""

from __future__ import annotations

from dataclasses import dataclass

# The defaults a user of the two-table search expects.
LEVENSHTEIN_MIN = 0.5
JARO_MIN = 0.8
SEMANTIC_MIN = 0.5


@dataclass(frozen=True)
class Params:
    """Thresholds and methods; every one can be overridden per search."""

    name_methods: tuple[tuple[str, float], ...] = (
        ("Levenshtein", LEVENSHTEIN_MIN),
        ("Jaro", JARO_MIN),
        ("Semantic", SEMANTIC_MIN),
    )
    min_join: float = 0.45
    min_key_ratio: float = 0.95
    max_missing: float = 0.3
    max_avg_chars: float = 70
    hier_max_matches: int = 1
    eval_method: str = "SortedNeighborhood"
    score_method: str = "jaccard"
    combination_sizes: tuple[int, ...] = (2, 3)
    max_key_columns: int = 3
    counter_min_uniqueness: float = 0.99
    counter_max_miss: float = 0.1
    length_scope: str = "string"
