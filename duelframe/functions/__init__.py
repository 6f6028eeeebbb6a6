from duelframe.functions.expressions import (
    bout_label,
    confidence,
    confidence_tier,
    gap_days,
    is_below,
    millionths,
    predicted_winner,
    r6,
    safe_ratio,
)

__all__ = [
    "bout_label",
    "confidence",
    "confidence_tier",
    "gap_days",
    "is_below",
    "millionths",
    "predicted_winner",
    "r6",
    "safe_ratio",
]
