"""Registry of checked queries: a Spark builder and, where SQL can express
it, the DuckDB oracle text over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


NUDGE = 1e-9  # absolute offset: moves exact decimal ties off the rounding boundary


def round6(col) -> F.Column:
    """6-digit rounding done as ``round((x + 1e-9) * 1e6) / 1e6``: the same
    arithmetic the oracle's ``round(x, 6)`` performs, after the same offset,
    so results that differ only in the last bits (sum order) round alike."""
    return F.round((col + F.lit(NUDGE)) * F.lit(1e6)) / F.lit(1e6)


def finish(df: DataFrame) -> DataFrame:
    """Round every floating column to 6 digits (sum order differs between
    engines); the oracle SQL rounds the same columns with ``round(x, 6)``,
    rewritten by ``nudge_sql`` to the same arithmetic."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.FloatType):
            # shortest text form first, so 8393.82f compares as 8393.82
            cols.append(round6(F.col(f.name).cast("string").cast("double")).alias(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            cols.append(round6(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def nudge_sql(sql: str) -> str:
    """Rewrite each ``round(<expr>, 6)`` of an oracle text as
    ``round((<expr>) + NUDGE, 6)`` (matching parentheses)."""
    out, i = [], 0
    low = sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        start = j + 6
        depth, k, comma = 1, start, -1
        while depth:
            ch = sql[k]
            if ch in "([":
                depth += 1
            elif ch in ")]":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        if comma < 0:  # one-argument round(x): keep, rewrite inside
            out.append(f"{sql[i:j]}round({nudge_sql(sql[start:k - 1])})")
            i = k
            continue
        inner, digits = sql[start:comma], sql[comma + 1:k - 1].strip()
        inner = nudge_sql(inner)
        if digits == "6":
            out.append(f"{sql[i:j]}round(({inner}) + {NUDGE!r}, 6)")
        else:
            out.append(f"{sql[i:j]}round({inner}, {digits})")
        i = k


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = nudge_sql(sql.strip())
        return fn

    return deco
