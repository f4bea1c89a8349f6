"""Projections, filters and casts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list, numeric_columns, string_columns


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """J1."""
    return df.withColumnsRenamed(mapping)


def with_key(df: DataFrame, key) -> DataFrame:
    """Declare ``key`` as the row key; one aggregation proves it unique
    (distinct keys == rows), otherwise a repeated key is reported."""
    keys = as_list(key)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*[F.col(k) for k in keys]).alias("d")).first()
    if row["n"] != row["d"]:
        dup = df.groupBy(*keys).count().where(F.col("count") > 1).select(*keys).first()
        raise ValueError(f"key {keys} is not unique ({row['n']} rows, {row['d']} keys), e.g. {tuple(dup)}")
    return df


def sanitize_name(name: str) -> str:
    """Collapse blanks, replace quote, ampersand, >, %, ? by '_'."""
    name = re.sub(r"\s+", "_", name.strip())
    return re.sub(r"['&>%?]", "_", name)


def sanitize(df: DataFrame) -> DataFrame:
    return df.toDF(*[sanitize_name(x) for x in df.columns])


def select_cols(df: DataFrame, cols) -> DataFrame:
    """Projection that names every absent column in its error."""
    cols = as_list(cols)
    missing = [x for x in cols if x not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*cols)


def drop_cols(df: DataFrame, cols) -> DataFrame:
    """J4."""
    return df.drop(*as_list(cols))


def feature_cols(df: DataFrame, exclude) -> list[str]:
    """All columns except ``exclude``, in table order."""
    ex = set(as_list(exclude))
    return [x for x in df.columns if x not in ex]


def cols_of_type(df: DataFrame, kind: str) -> list[str]:
    """``"numeric"`` or ``"string"`` columns."""
    return numeric_columns(df) if kind == "numeric" else string_columns(df)


def drop_rows(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """Remove rows whose value is in the list; NULL rows are kept."""
    cond = F.lit(True)
    for col, vals in values.items():
        cond = cond & ~F.coalesce(F.col(col).isin(vals), F.lit(False))
    return df.where(cond)


def drop_any_null(df: DataFrame, cols=None) -> DataFrame:
    """Complete cases."""
    return df.na.drop("any", subset=as_list(cols) or None)


def cast_cols(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts (ANSI: overflow raises instead of wrapping)."""
    return df.withColumns({k: F.col(k).cast(v) for k, v in types.items()})


def to_numeric(df: DataFrame, cols, dtype: str = "double") -> DataFrame:
    """Text that does not parse becomes NULL."""
    return df.withColumns({k: F.expr(f"try_cast(`{k}` as {dtype})") for k in as_list(cols)})


def head(df: DataFrame, n: int, order) -> DataFrame:
    """First ``n`` rows in a stated order (a limit is the feature here)."""
    return df.orderBy(*as_list(order)).limit(n)
