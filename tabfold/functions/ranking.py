"""Distributed ranks and running sums without a one-partition window.

A window with no PARTITION BY (or one partitioned by a hot class) puts every
row in one task. The helpers here keep each task bounded:

* ``hashed_rank`` ranks rows inside a group by an md5 order key. The md5 prefix
  splits every group into ``16**prefix`` sub-buckets of near-equal size, so a
  group holding a third of all rows is still spread over many tasks. Bucket
  sizes are counted by a partial (map-side) aggregate, turned into offsets on
  that small table, and added to a row number inside each sub-bucket.
* ``prefix_sums`` computes running totals over a table that is *already
  aggregated* per distinct ordering value (e.g. counts per distinct score). It
  range-partitions that table, checkpoints it (so the partition ids read as
  data are stable), sums each range, offsets the ranges (one row per range)
  and finishes with a window that is partitioned by range id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list, c
from tabfold.operators.joins import bounded
from tabfold.session import cut_lineage


def range_partition(df: DataFrame, order: list, ranges: int | None = None) -> DataFrame:
    """Range-partition by ``order`` and expose the range id as ``_rid``.
    Without ``ranges`` the count is left to adaptive execution, which sizes
    ranges by bytes (coalescing only merges neighbouring ranges, so ids stay
    in order): many ranges for big inputs, one for a tiny table."""
    x = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return x.withColumn("_rid", F.spark_partition_id())


def pin_partitions(df: DataFrame) -> DataFrame:
    """Materialise a range-partitioned frame whose partition ids are used as
    data, so both of its readers see the same ids: a reliable checkpoint in
    the shared checkpoint folder (lineage cut, nothing held in memory)."""
    return cut_lineage(df)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys match NULL keys (group keys may be NULL)."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[F.col(c) for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def hashed_rank(df: DataFrame, hash_col: str, by=None, tiebreak=None, prefix: int = 4,
                out: str = "rank") -> DataFrame:
    """0-based rank of each row inside ``by`` ordered by (hash_col, tiebreak).

    ``hash_col`` must be a lowercase hex string (md5). Exact: equals
    ``row_number() over (partition by by order by hash_col, tiebreak) - 1``.
    With ``prefix`` = 4 hex digits a group is cut into up to 65,536
    sub-buckets: a group of 3e11 rows sorts ~4.6e6 rows per window partition
    (spillable), while the counts/offsets table stays <= 65,536 rows per group.
    Raise ``prefix`` for even larger groups.
    """
    by = as_list(by)
    tiebreak = as_list(tiebreak)
    b = "_hbucket"
    x = df.withColumn(b, F.conv(F.substring(c(hash_col), 1, prefix), 16, 10).cast("int"))
    counts = x.groupBy(*by, b).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    # bounded by |groups| * 16**prefix rows
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    x = join_null_safe(x, offsets, [*by, b])
    w2 = Window.partitionBy(*by, b).orderBy(c(hash_col), *[c(t) for t in tiebreak])
    return x.withColumn(out, (F.row_number().over(w2) - 1 + F.col("_off")).cast("long")).drop(b, "_off")


def prefix_sums(counts: DataFrame, order_cols, sum_cols: list[str], by=None,
                ascending: bool = True, ranges: int | None = None, inclusive: bool = True,
                suffix: str = "_cum") -> DataFrame:
    """Running totals of ``sum_cols`` inside each ``by`` group, over rows sorted
    by ``order_cols``.

    ``counts`` holds one row per distinct (by, order) value. Adds
    ``<col><suffix>`` = total over rows ordered at or before (``inclusive``) or
    strictly before this row.
    """
    by = as_list(by)
    order_cols = as_list(order_cols)
    order = [F.col(o).asc() if ascending else F.col(o).desc() for o in order_cols]
    ranged = range_partition(counts, [F.col(b) for b in by] + order, ranges)
    ranged = pin_partitions(ranged)
    per_range = ranged.groupBy("_rid", *by).agg(*[F.sum(s).alias(f"_r_{s}") for s in sum_cols])
    # at most (#ranges + #groups) rows
    wr = Window.partitionBy(*by).orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_range.select("_rid", *by, *[F.coalesce(F.sum(f"_r_{s}").over(wr), F.lit(0))
                                           .alias(f"_o_{s}") for s in sum_cols])
    # the window first, on its own keys; the offsets then join without moving rows
    end = 0 if inclusive else -1
    w = Window.partitionBy("_rid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    x = ranged.withColumns({f"{s}{suffix}": F.coalesce(F.sum(s).over(w), F.lit(0)) for s in sum_cols})
    x = join_null_safe(x, bounded(offs), ["_rid", *by])
    return x.withColumns({f"{s}{suffix}": F.col(f"{s}{suffix}") + F.col(f"_o_{s}") for s in sum_cols}) \
        .drop("_rid", *[f"_o_{s}" for s in sum_cols])


SKETCH = 2000  # accuracy of the sketches: ranks within n / SKETCH


def _in_brackets(long: DataFrame, brackets: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Order statistics of every (group, column) from rows (keys, _v) and brackets (keys, _n, and per
    probability an interval, an end of which is open where null): ``_lo<i>``, ``_hi<i>``
    and whether one of them lies outside its interval (``_missed``).

    Values inside an interval are counted one by one; all values between two intervals
    are one row, so little more than the intervals' values leaves the map stage."""
    x = join_null_safe(long, bounded(brackets), keys)
    v, n = F.col("_v"), len(probs)
    inside = [F.coalesce(v >= F.col(f"_from{i}"), F.lit(True)) & F.coalesce(v <= F.col(f"_to{i}"), F.lit(True)) for i in range(n)]
    any_inside = inside[0]
    for i in inside[1:]:
        any_inside = any_inside | i
    gap = sum((F.coalesce(v > F.col(f"_to{i}"), F.lit(False)).cast("int") for i in range(n)), F.lit(0))
    counted = x.groupBy(*keys, F.when(any_inside, v).alias("_one"), F.when(~any_inside, gap).alias("_gap")) \
        .agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_v"), F.max("_n").alias("_n")).drop("_one")
    cum = prefix_sums(counted, "_v", ["_c"], by=keys, inclusive=True)
    aggs = [F.max("_n").alias("_n")]
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        at = F.struct("_v", F.col("_gap").isNotNull().alias("_out"))
        aggs.append(F.min(F.when(F.col("_c_cum") >= F.floor(h) + 1, at)).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("_c_cum") >= F.ceil(h) + 1, at)).alias(f"_hi{i}"))
    g = cum.groupBy(*keys).agg(*aggs)
    missed = F.lit(False)
    for i in range(n):
        missed = missed | F.col(f"_lo{i}._out") | F.col(f"_hi{i}._out")
    return g.select(*keys, "_n", *[F.col(f"_{e}{i}._v").alias(f"_{e}{i}") for i in range(n) for e in ("lo", "hi")], missed.alias("_missed"))


def quantiles(df: DataFrame, cols, probs: list[float], by=None) -> DataFrame:
    """Exact quantiles (linear interpolation, like ``quantile_cont`` and
    pandas ``quantile``) of several columns, per ``by`` group, without holding
    any group in one task and without sorting the values: a sketch per group and column
    brackets each quantile, one pass counts what lies between the brackets and sorts
    the brackets' values alone (about 4 / SKETCH of the rows per quantile, range-split
    running counts), and the two order statistics around position (n - 1) p are a
    conditional ``min``. Where a sketch was off (its bound is checked, not
    trusted), that group is counted again without brackets.
    Returns ``(by..., column, q0..q{k-1})``."""
    cols, by, probs = as_list(cols), as_list(by), [float(p) for p in probs]
    keys = [*by, "_col"]
    wide = df.select(*[F.col(b) for b in by], *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(cols)])
    margin = 2.0 / SKETCH
    ends = [e for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = wide.groupBy(*by).agg(*[F.struct(F.lit(x).alias("_col"), F.count(f"_x{i}").alias("_n"), F.percentile_approx(f"_x{i}", ends, SKETCH).alias("_e")).alias(f"_s{i}")
                                     for i, x in enumerate(cols)])
    rows = sketch.select(*by, F.inline(F.array(*[f"_s{i}" for i in range(len(cols))]))).where("_n > 0")
    between = [(F.lit(None).cast("double") if p - margin <= 0 else F.col("_e")[2 * i], F.lit(None).cast("double") if p + margin >= 1 else F.col("_e")[2 * i + 1]) for i, p in enumerate(probs)]
    brackets = cut_lineage(rows.select(*keys, "_n", *[x.alias(f"_{e}{i}") for i, pair in enumerate(between) for e, x in zip(("from", "to"), pair)]))
    long = wide.select(*by, F.explode(F.array(*[F.struct(F.lit(x).alias("_col"), F.col(f"_x{i}").alias("_v")) for i, x in enumerate(cols)])).alias("_s")) \
        .select(*by, "_s._col", "_s._v").where(F.col("_v").isNotNull())
    g = cut_lineage(_in_brackets(long, brackets, keys, probs))  # one row per group and column
    missed = g.where("_missed").select(*keys, "_n")
    if not missed.isEmpty():
        open_ends = missed.withColumns({f"_{e}{i}": F.lit(None).cast("double") for i in range(len(probs)) for e in ("from", "to")})
        g = g.where("not _missed").unionByName(_in_brackets(long, open_ends, keys, probs))
    outs = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1).cast("double") * F.lit(p)
        f = h - F.floor(h)
        outs.append(F.when(f == 0, F.col(f"_lo{i}"))
                    .otherwise(F.col(f"_lo{i}") * (1 - f) + F.col(f"_hi{i}") * f).alias(f"q{i}"))
    return g.select(*by, F.col("_col").alias("column"), *outs)
