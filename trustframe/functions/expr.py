"""Small Column helpers shared by every operator.

Everything here is a pure Column expression, so it stays inside whole-stage
codegen.  ``round_half`` is written with ``floor`` instead of ``round`` so the
same IEEE arithmetic can be written in SQL (see ``plans/oracle.py``) and the
two engines agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_d(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clip into [lo, hi]; null stays null (greatest/least alone skip nulls)."""
    d = c.cast("double")
    return F.when(d.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(lit_d(lo), F.least(lit_d(hi), d)))


def safe_div(num: Column, den: Column, default: float | Column = 0.0) -> Column:
    """``num/den`` when ``den`` is non-zero and non-null, else ``default``."""
    d = default if isinstance(default, Column) else lit_d(default)
    return F.when((den.isNotNull()) & (den != 0), num.cast("double") / den).otherwise(d)


def round_half(c: Column, n: int) -> Column:
    """Half-away-from-zero rounding to ``n`` places, engine independent."""
    p = float(10 ** n)
    return F.signum(c) * F.floor(F.abs(c) * p + 0.5) / p


def uniform01(*cols: Column | str) -> Column:
    """Deterministic U[0,1) from the md5 of the key columns (first 32 bits)."""
    key = F.concat_ws("|", *[F.col(c) if isinstance(c, str) else c for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def range_of(c: Column) -> Column:
    return F.max(c) - F.min(c)
