"""A small portable mixing hash for reproducible sampling and A/B order.

Spark's ``xxhash64`` cannot be reproduced by other SQL engines, so every
seeded random choice that must be checkable against an oracle uses this
integer mix instead: bigint arithmetic modulo the prime 2^31-1, kept below
2^63 at every step so ANSI overflow checks never fire.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647  # 2^31 - 1


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mix(a, b, seed: int = 0) -> Column:
    """Deterministic pseudo-random bigint in [0, P) from two integer keys."""
    a_, b_ = F.pmod(_c(a).cast("bigint"), F.lit(P)), F.pmod(_c(b).cast("bigint"), F.lit(P))
    h1 = F.pmod(a_ * 48271 + b_ * 69621 + F.lit(seed % P), F.lit(P))
    h2 = F.pmod(h1 * h1 + 12345, F.lit(P))
    return F.pmod(h2 * 16807 + h1, F.lit(P))


def mix62(a, b, seed: int = 0) -> Column:
    """Two mixes side by side: a pseudo-random bigint in [0, P^2), wide enough
    to draw from more than 2^31 rows."""
    return mix(a, b, seed) * F.lit(P) + mix(b, a, seed + 1)


def mix_sql(a: str, b: str, seed: int = 0) -> str:
    """The same function as DuckDB SQL text (for oracles)."""
    def pm(x):
        return f"((({x}) % {P} + {P}) % {P})"
    h1 = pm(f"{pm(a)} * 48271 + {pm(b)} * 69621 + {seed % P}")
    h2 = f"(({h1}) * ({h1}) + 12345) % {P}"
    return f"((({h2}) * 16807 + {h1}) % {P})"


def mix62_sql(a: str, b: str, seed: int = 0) -> str:
    """``mix62`` as DuckDB SQL text (for oracles)."""
    return f"({mix_sql(a, b, seed)} * {P} + {mix_sql(b, a, seed + 1)})"
