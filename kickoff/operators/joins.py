"""Join helpers: broadcast only behind a size check, shuffle join beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lookup tables up to this many rows are broadcast; bigger ones are shuffle-joined.
BROADCAST_MAX_ROWS = 1_000_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows + 1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left",
               max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join with ``small`` broadcast when its row count is proven bounded,
    otherwise a plain (sort-merge / AQE-chosen) join."""
    side = F.broadcast(small) if is_small(small, max_rows) else small
    return big.join(side, on, how)
