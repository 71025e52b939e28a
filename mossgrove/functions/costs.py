"""Prices of model calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars for a million tokens in, out and read from a cache
RATES = {"small": (0.80, 4.00, 0.08), "mid": (3.00, 15.00, 0.30), "large": (15.00, 75.00, 1.50)}


def cost(model: Column, tokens_in: Column, cached: Column, tokens_out: Column, rates: dict[str, tuple[float, float, float]] = RATES, default: str = "mid") -> Column:
    """Dollars of a call, to six places. Tokens in include the cached ones; an unknown model costs what ``default`` does."""

    def rate(k: int) -> Column:
        out = F.lit(rates[default][k])
        for name, r in rates.items():
            out = F.when(model == name, F.lit(r[k])).otherwise(out)
        return out

    return F.round(((tokens_in - cached) / 1e6) * rate(0) + (cached / 1e6) * rate(2) + (tokens_out / 1e6) * rate(1), 6)
