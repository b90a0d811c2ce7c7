"""Small Column helpers shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(v) -> Column:
    """A DOUBLE literal (SQL decimals would change the arithmetic type)."""
    return F.lit(float(v))


def finite(c: ColumnLike) -> Column:
    """NaN and infinities become NULL, so ``IS NOT NULL`` means finite from here on."""
    x = col(c)
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, x)


def num(c: ColumnLike) -> Column:
    """Text or number to finite DOUBLE; anything unreadable becomes NULL."""
    return finite(col(c).try_cast("double"))


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """``a / b`` with a zero denominator giving NULL instead of an ANSI error."""
    return col(a) / F.nullif(col(b), dbl(0.0))


def clip(c: ColumnLike, lo=None, hi=None) -> Column:
    """NULL-preserving clip (``greatest``/``least`` alone would skip the NULL)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else dbl(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else dbl(hi))
    return F.when(x.isNotNull(), out)


def is_true(c: Column) -> Column:
    """Three-valued to two-valued: NULL counts as false."""
    return F.coalesce(c, F.lit(False))


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, list(conds), F.lit(True))


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, list(conds), F.lit(False))


def present(cols) -> Column:
    return all_of(col(c).isNotNull() for c in cols)


def share_pct(part: Column, whole: Column) -> Column:
    return dbl(100.0) * part / F.nullif(whole, F.lit(0))


def seconds(ts: ColumnLike = "ts") -> Column:
    """Epoch seconds as DOUBLE, keeping the fraction."""
    return F.unix_micros(col(ts)) / dbl(1e6)


def unpivot(df, keys, roles, name="role", value="value"):
    """Wide roles to long ``(keys, role, value)``; NULL cells are dropped at once."""
    pairs = F.array(*[F.struct(F.lit(r).alias(name), col(r).cast("double").alias(value)) for r in roles])
    out = df.select(*keys, F.explode(F.filter(pairs, lambda p: p[value].isNotNull())).alias("_p"))
    return out.select(*keys, F.col(f"_p.{name}").alias(name), F.col(f"_p.{value}").alias(value))
