"""Joins of fitted tables onto rows (JO1-JO8).

Strategy: a fitted table (one row per level) is small in practice but its
size depends on the data, so it is never broadcast blindly, and it is not
left to a shuffle join either (that would shuffle the whole big side just to
meet a few hundred rows). ``bounded`` materialises the fitted table once
(in the shared checkpoint folder), measures it, and adds the broadcast hint only
when its measured bytes are under a budget.
Beyond the budget the join stays a shuffle join (AQE may still convert it).
One-row tables (priors, min/max) are broadcast directly: one row is a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list
from tabfold.session import cut_lineage

MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def measured(table: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a table: 8 bytes a fixed-width field, strings, binaries and
    nested values by the length they have."""
    size = F.lit(16).cast("long")
    for f in table.schema.fields:
        x = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("string", "binary"):
            n = F.octet_length(x)
        elif f.dataType.typeName() in ("array", "map", "struct"):
            n = F.length(F.to_json(F.struct(x)))
        else:
            n = F.lit(8)
        size = size + F.coalesce(n, F.lit(8))
    rows, total = table.agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows, total or 0


def bounded(table: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Materialise a fitted table in the checkpoint folder and broadcast it only if
    its measured bytes are within ``max_bytes``."""
    t = cut_lineage(table)
    return F.broadcast(t) if measured(t)[1] <= max_bytes else t


def checked_broadcast(table: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``table`` only if a count proves it has at most ``max_rows``
    (and it fits the byte budget)."""
    t = cut_lineage(table)
    rows, size = measured(t)
    return F.broadcast(t) if rows <= max_rows and size <= MAX_BROADCAST_BYTES else t


def lookup(df: DataFrame, table: DataFrame, on, defaults: dict | None = None,
           max_rows: int | None = None) -> DataFrame:
    """JO1/JO2: left join a per-level table on one or more keys; columns missing
    for a key get ``defaults`` (a literal or a Column, e.g. the prior)."""
    on = as_list(on)
    t = checked_broadcast(table, max_rows) if max_rows else bounded(table)
    out = df.join(t, on=on, how="left")
    for col_name, value in (defaults or {}).items():
        v = value if isinstance(value, F.Column) else F.lit(value)
        out = out.withColumn(col_name, F.coalesce(F.col(col_name), v))
    return out


def join_group_stats(df: DataFrame, stats: DataFrame, on: str, suffix: str) -> DataFrame:
    """JO3: attach group statistics with a name suffix on every stat column."""
    renamed = stats.select(on, *[F.col(x).alias(f"{x}{suffix}") for x in stats.columns if x != on])
    return df.join(bounded(renamed), on=on, how="left")


def join_features(df: DataFrame, right: DataFrame, on) -> DataFrame:
    """JO5: inner join after de-duplicating the right side on the key."""
    on = as_list(on)
    return df.join(right.dropDuplicates(on), on=on, how="inner")


def flag_if_in(df: DataFrame, keys: DataFrame, on: str, out: str = "flag") -> DataFrame:
    """JO6: 0/1 flag whether the row's key appears in ``keys`` (semi-join)."""
    k = keys.select(on).distinct().withColumn(out, F.lit(1))
    return df.join(bounded(k), on=on, how="left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def align_scores(long: DataFrame, key: str = "key", model: str = "model", value: str = "p",
                 models: list[str] | None = None) -> DataFrame:
    """JO7: one column per model next to each other, aligned by key (never by
    position). Pass ``models`` so the pivot needs no extra job."""
    g = long.groupBy(key)
    g = g.pivot(model, models) if models else g.pivot(model)
    return g.agg(F.first(value))
