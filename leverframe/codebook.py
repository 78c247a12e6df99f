"""The eight ordinal factors and the adjustment sets of the causal graph (fixed values)."""

from __future__ import annotations

FACTORS = ["S1", "S2", "S3", "S4", "O1", "O2", "O3", "O4"]
#: Highest level of each factor; the lowest is 0 for all.
TOP = {"S1": 2, "S2": 1, "S3": 1, "S4": 1, "O1": 1, "O2": 1, "O3": 1, "O4": 2}
SEMANTIC, STRUCTURAL = FACTORS[:4], FACTORS[4:]
DOMAINS = ["consumer_product", "health", "finance", "academic_qa", "travel"]
PROMPT_STYLES = 4
#: Standard normal quantile at 0.975.
Z = 1.959963984540054


def adjustment_set(treatment: str) -> list[str]:
    """Columns to adjust for: the question for content factors, the question and the content factors for structure ones."""
    if treatment in SEMANTIC:
        return ["query_id"]
    return ["query_id", *SEMANTIC] if treatment in STRUCTURAL else []
