"""Registered queries: a Spark callable and, where one exists, its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def r(c, d=6):
    """Round for comparison between engines.

    The engines break exact decimal ties differently, so both sides are nudged
    off the tie by the same hair; ``+ 0.0`` folds away negative zero.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(float(nudge(d))), d) + F.lit(0.0)


def nudge(d):
    return f"137e-{d + 5}"


def R(expr, d=6):
    return f"(round(({expr})+{nudge(d)},{d})+0e0)"


def rounded(df, **digits):
    """Round the named columns and cast counts to BIGINT."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t == "double":
            out.append(r(f.name, digits.get(f.name, digits.get("_", 6))).alias(f.name))
        elif t in ("int", "smallint", "tinyint"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
