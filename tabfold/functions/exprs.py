"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def safe_div(num, den) -> Column:
    """NULL instead of an ANSI divide-by-zero error."""
    return F.try_divide(c(num), c(den))


def r6(x) -> Column:
    """Round to 6 digits: results are compared after this rounding."""
    return F.round(c(x).cast("double"), 6)


def order_hash(key, seed) -> Column:
    """Repeatable pseudo-random order key: md5 of the key text and the seed.
    Independent of partitioning and of row order, so every rerun (and every
    retried task) picks the same rows."""
    return F.md5(F.concat(c(key).cast("string"), F.lit(str(seed))))


def hash_unit(key, seed) -> Column:
    """Uniform number in [0, 1) from the first 13 hex digits of the md5."""
    h = F.conv(F.substring(order_hash(key, seed), 1, 13), 16, 10).cast("long")
    return h.cast("double") / F.lit(float(16 ** 13))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def melt_one_row(row_df: DataFrame, metrics: dict[str, list[str]], name_col: str = "column") -> DataFrame:
    """Turn a one-row aggregate whose columns are ``<col>__<metric>`` into one
    row per source column. ``metrics`` maps column name -> metric names."""
    structs = []
    metric_names = sorted({m for ms in metrics.values() for m in ms})
    for col_name, ms in metrics.items():
        fields = [F.lit(col_name).alias(name_col)]
        for m in metric_names:
            src = f"{col_name}__{m}"
            fields.append((F.col(src) if m in ms else F.lit(None)).cast("double").alias(m))
        structs.append(F.struct(*fields))
    return row_df.select(F.inline(F.array(*structs)))


# Fixed values of the published rational approximation of the normal quantile
# (central part a/b, tails c/d, relative error below 1.2e-9).
_A = "-3.969683028665376E1 2.209460984245205E2 -2.759285104469687E2 1.383577518672690E2 -3.066479806614716E1 2.506628277459239E0"
_B = "-5.447609879822406E1 1.615858368580409E2 -1.556989798598866E2 6.680131188771972E1 -1.328068155288572E1 1E0"
_C = "-7.784894002430293E-3 -3.223964580411365E-1 -2.400758277161838E0 -2.549732539343734E0 4.374664141464968E0 2.938163982698783E0"
_D = "7.784695709041462E-3 3.224671290700398E-1 2.445134137142996E0 3.754408661907416E0 1E0"


def _horner(coefficients: str, x: str) -> str:
    first, *rest = coefficients.split()
    out = f"({first})"
    for k in rest:
        out = f"({out} * {x} + ({k}))"
    return out


def erfinv_sql(x: str) -> str:
    """Inverse error function of a double column as SQL text that Spark and
    DuckDB evaluate alike; infinite at -1 and 1, NULL for NULL."""
    p = f"(({x} + 1E0) / 2E0)"
    r = f"(({p} - 5E-1) * ({p} - 5E-1))"

    def tail(q: str) -> str:
        t = f"sqrt(-2E0 * ln({q}))"
        return f"({_horner(_C, t)} / {_horner(_D, t)})"

    return (f"(CASE WHEN {x} <= -1E0 THEN CAST('-Infinity' AS DOUBLE) WHEN {x} >= 1E0 THEN CAST('Infinity' AS DOUBLE) "
            f"WHEN {p} < 2.425E-2 THEN {tail(p)} WHEN {p} > 9.7575E-1 THEN -{tail(f'(1E0 - {p})')} "
            f"ELSE ({p} - 5E-1) * {_horner(_A, r)} / {_horner(_B, r)} END / sqrt(2E0))")


def erfinv(col_name: str) -> F.Column:
    """Inverse error function of a column (given by name), JVM-side."""
    return F.expr(erfinv_sql(f"`{col_name}`"))


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or (isinstance(v, float) and math.isnan(v))
                 else math.erfc(v)).astype("float64")


def digamma(col: Column) -> Column:
    """psi(x) for whole x >= 1 as a column expression: six steps of psi(x) = psi(x + 1) - 1 / x,
    then the asymptotic series, whose error at x >= 7 is below 1e-12."""
    x = col.cast("double")
    less = F.lit(0.0)
    for i in range(6):
        less = less + 1 / (x + i)
    z = x + 6
    q = 1 / (z * z)
    # Bernoulli terms 1/12, 1/120, 1/252, 1/240, 1/132, 691/32760 of the series: fixed values
    series = q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q * (1 / 132 - q * (691 / 32760))))))
    return F.log(z) - 1 / (2 * z) - series - less
