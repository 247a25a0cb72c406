from paylens.functions.numeric import (
    grid_mean,
    grid_total,
    growth_pct,
    mean,
    percent_of,
    plain_mean,
    ratio,
    relative_growth_pct,
    total,
)
from paylens.functions.text import canonical_pincode, title_case

__all__ = [
    "canonical_pincode",
    "grid_mean",
    "grid_total",
    "growth_pct",
    "mean",
    "percent_of",
    "plain_mean",
    "ratio",
    "relative_growth_pct",
    "title_case",
    "total",
]
