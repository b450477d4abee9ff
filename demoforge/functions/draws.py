"""Seeded draw rule (replaces the unseeded ``random`` calls).

draw = first 48 bits of md5('seed|a|b|...') as an integer, modulo n.
It is a pure function of its arguments, so a retried task redraws the same
values, and it is portable: any SQL engine with md5 reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_hash(*parts) -> Column:
    cols = [F.lit(p) if not isinstance(p, Column) else p for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def draw(*parts, n) -> Column:
    """Uniform integer in [0, n) (``n`` int or column)."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(draw_hash(*parts), n_col.cast("bigint"))


def draw_between(lo, hi, *parts) -> Column:
    """Uniform integer in [lo, hi] inclusive."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return lo_c + draw(*parts, n=hi_c - lo_c + 1)
