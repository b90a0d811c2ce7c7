"""Least squares from moment sums.

The rows of a device are reduced to a k-by-k Gram matrix by one ordinary
``groupBy().agg(sum...)``; only that matrix reaches Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _solver():
    """The k-by-k solve as a self-contained function, so workers need no package on their path."""
    def solve(gram: pd.Series, rhs: pd.Series) -> pd.Series:
        out = []
        for g, h in zip(gram, rhs):
            h = np.asarray(h, float)
            a = np.asarray(g, float).reshape(len(h), len(h))
            if not (np.isfinite(a).all() and np.isfinite(h).all()):
                out.append(None)
                continue
            # unit diagonal first: mixed physical units would spoil the rank decision
            d = np.sqrt(np.maximum(np.diag(a), 1e-300))
            x, *_ = np.linalg.lstsq(a / np.outer(d, d), h / d, rcond=1e-14)
            out.append((x / d).tolist())
        return pd.Series(out)
    return F.pandas_udf(solve, T.ArrayType(T.DoubleType()))


def gram_sums(features: list[Column], target: Column, prefix: str = "") -> list[Column]:
    """Aggregates for the upper triangle of X'X and for X'y."""
    k = len(features)
    sums = [F.sum(features[i] * features[j]).alias(f"{prefix}g{i}_{j}") for i in range(k) for j in range(i, k)]
    return sums + [F.sum(features[i] * target).alias(f"{prefix}h{i}") for i in range(k)]


def solve_columns(k: int, prefix: str = "") -> Column:
    """Coefficients (ARRAY) from the columns produced by :func:`gram_sums`."""
    gram = F.array(*[F.col(f"{prefix}g{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    return _solver()(gram, F.array(*[F.col(f"{prefix}h{i}") for i in range(k)]))


def solve_moments(s: list[Column], t: list[Column], degree: int) -> Column:
    """Polynomial coefficients from power sums ``s[k] = sum u^k`` and ``t[k] = sum u^k w``."""
    n = degree + 1
    return _solver()(F.array(*[s[i + j] for i in range(n) for j in range(n)]), F.array(*t[:n]))
