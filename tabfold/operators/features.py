"""Feature construction (F1-F26): scalar expressions, group statistics joined
back, dense contingency counts, Box-Cox, ranks to Gaussian, swap noise.

Group statistics are ``groupBy`` aggregates (map-side partial aggregation,
so a hot level costs one partial row per task) joined back on the level, not
windows partitioned by the level (which would put a hot level in one task).
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list, c, erfinv, hash_unit, safe_div
from tabfold.functions.ranking import hashed_rank, join_null_safe, prefix_sums, quantiles
from tabfold.functions.exprs import order_hash
from tabfold.operators.joins import bounded

# ------------------------------------------------------------ scalar


def extract_int(df: DataFrame, col: str, pattern: str = r"(\d+)", out: str | None = None) -> DataFrame:
    """first number inside the text (``region_22`` -> 22); no match -> NULL."""
    v = F.regexp_extract(F.col(col), pattern, 1)
    return df.withColumn(out or col, F.when(v == "", F.lit(None)).otherwise(v).cast("long"))


def startswith_code(df: DataFrame, col: str, prefixes: list[tuple[str, int]], default=None,
                    out: str | None = None) -> DataFrame:
    """code by the first matching prefix."""
    expr = None
    for p, v in prefixes:
        cond = F.col(col).startswith(p)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    if default is not None:
        expr = expr.otherwise(F.lit(default))
    return df.withColumn(out or f"{col}_code", expr)


def between_flag(col, lo, hi) -> Column:
    """1 if lo <= x <= hi."""
    return c(col).between(lo, hi).cast("int")


def flag_above_mean(df: DataFrame, col: str, extra: Column | None = None, out: str = "above_mean") -> DataFrame:
    """X > dataset mean (and an optional extra condition); the mean is
    a one-row aggregate joined by broadcast."""
    m = df.agg(F.avg(col).alias("_mean"))
    x = df.crossJoin(F.broadcast(m))
    cond = F.col(col) > F.col("_mean")
    if extra is not None:
        cond = cond & extra
    return x.withColumn(out, cond.cast("int")).withColumnRenamed("_mean", f"mean_{col}")


def linear_score(weights: dict[str, float]) -> Column:
    """sum of weight * column."""
    return reduce(lambda a, b: a + b, [F.col(k) * F.lit(float(w)) for k, w in weights.items()])


def product(a, b) -> Column:
    """F6."""
    return c(a) * c(b)


def ratio(a, b) -> Column:
    """NULL when the denominator is 0."""
    return safe_div(c(a).cast("double"), c(b).cast("double"))


def add(cols) -> Column:
    """F8."""
    return reduce(lambda x, y: x + y, [c(k) for k in as_list(cols)])


def cross(a: str, b: str, sep: str = "_", na: str = "NA") -> Column:
    """two categories as one text key; NULL written as ``na``."""
    return F.concat_ws(sep, F.coalesce(F.col(a).cast("string"), F.lit(na)),
                       F.coalesce(F.col(b).cast("string"), F.lit(na)))


def interact_when(x, cond: Column) -> Column:
    """x where the condition holds, else 0."""
    return c(x) * cond.cast("int")


def log1p(x) -> Column:
    """F11."""
    return F.log1p(c(x))


def poly2(df: DataFrame, cols) -> DataFrame:
    """squares and pairwise products."""
    cols = as_list(cols)
    exprs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            exprs.append((F.col(a) * F.col(b)).alias(f"{a}_x_{b}" if a != b else f"{a}_sq"))
    return df.select("*", *exprs)


# ------------------------------------------------------------ Box-Cox

def fit_boxcox(df: DataFrame, cols, lambdas: list[float] | None = None, shift: float = 1.0) -> DataFrame:
    """lambda by maximum likelihood over a grid, per column, in ONE pass.

    llf(l) = (l - 1) * sum(ln x) - n/2 * ln(var_pop(boxcox_l(x))), x = value + shift.
    Each value is expanded by the (literal, bounded) lambda grid inside the map
    stage and aggregated per (column, lambda): the partial aggregate collapses
    the expansion before any shuffle. The argmax runs on the small
    (column, lambda, llf) result. Returns ``(column, lambda, llf)``."""
    cols = as_list(cols)
    lambdas = lambdas or [round(-2.0 + 0.05 * i, 2) for i in range(81)]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("column"), (F.col(k).cast("double") + F.lit(shift)).alias("x")) for k in cols
    ])).alias("s")).select("s.column", F.log("s.x").alias("lx")).where(F.col("lx").isNotNull())
    long = long.select("column", "lx", F.explode(F.array(*[F.lit(float(v)) for v in lambdas])).alias("lambda"))
    # x^l = exp(l * ln x): ln x once per value, and exp is cheaper than pow
    t = F.when(F.col("lambda") == 0, F.col("lx")).otherwise((F.exp(F.col("lambda") * F.col("lx")) - 1) / F.col("lambda"))
    g = long.groupBy("column", "lambda").agg(F.var_pop(t).alias("_v"), F.sum("lx").alias("_sl"),
                                             F.count("lx").alias("_n"))
    llf = (F.col("lambda") - 1) * F.col("_sl") - F.col("_n") / 2.0 * F.log(F.col("_v"))
    return g.select("column", "lambda", llf.alias("llf")).groupBy("column").agg(
        F.max_by(F.struct("lambda", "llf"), F.struct("llf", -F.col("lambda"))).alias("b")) \
        .select("column", "b.lambda", "b.llf")


def skewed_columns(df: DataFrame, cols, threshold: float = 0.5) -> list[str]:
    """F12 selection: columns whose |population skewness| exceeds ``threshold``
    (one aggregation pass; the short list comes back to the driver)."""
    cols = as_list(cols)
    row = df.agg(*[F.skewness(F.col(k).cast("double")).alias(k) for k in cols]).first()
    return [k for k in cols if row[k] is not None and abs(row[k]) > threshold]


def apply_boxcox(df: DataFrame, fitted: DataFrame, col: str, out: str | None = None, shift: float = 1.0) -> DataFrame:
    lam = fitted.where(F.col("column") == col).select(F.col("lambda").alias("_lam"))
    x = df.crossJoin(F.broadcast(lam))  # one row
    v = F.col(col).cast("double") + F.lit(shift)
    t = F.when(F.col("_lam") == 0, F.log(v)).otherwise((F.pow(v, F.col("_lam")) - 1) / F.col("_lam"))
    return x.withColumn(out or col, t).drop("_lam")


# ------------------------------------------------------------ group statistics

def group_stats(df: DataFrame, cats, value: str, aggs=("min", "mean", "median", "max", "std")) -> DataFrame:
    """statistics of ``value`` per level of each category, joined back
    with names ``<value>_<agg>_<cat>``."""
    fns = {"min": F.min, "mean": F.avg, "max": F.max, "std": F.stddev_samp, "count": F.count}
    out = df
    for k in as_list(cats):
        t = df.groupBy(k).agg(*[fns[a](F.col(value)).alias(f"{value}_{a}_{k}") for a in aggs if a != "median"])
        if "median" in aggs:  # exact and scale-safe (no group held by one task)
            med = quantiles(df, [value], [0.5], by=k).select(k, F.col("q0").alias(f"{value}_median_{k}"))
            t = join_null_safe(t, med, [k], "left")
        t = t.select(k, *[f"{value}_{a}_{k}" for a in aggs])
        out = out.join(bounded(t), on=k, how="left")
    return out


def group_mean(df: DataFrame, keys, value: str, scale: float = 1.0, out: str | None = None) -> DataFrame:
    """mean of ``value`` per key set (x scale), joined back."""
    keys = as_list(keys)
    name = out or f"{value}_mean_by_{'_'.join(keys)}"
    t = df.groupBy(*keys).agg((F.avg(F.col(value).cast("double")) * scale).alias(name))
    return df.join(bounded(t), on=keys, how="left")


def pairwise_means(df: DataFrame, cats, values) -> DataFrame:
    """for every pair of categories, the mean of each value per pair
    level: one grouped aggregate per pair, joined back."""
    cats, values = as_list(cats), as_list(values)
    out = df
    for i, a in enumerate(cats):
        for b in cats[i + 1:]:
            t = df.groupBy(a, b).agg(*[F.avg(F.col(v).cast("double")).alias(f"{v}_mean_{a}_{b}")
                                       for v in values])
            out = out.join(bounded(t), on=[a, b], how="left")
    return out


def rank_in_group(df: DataFrame, keys, value: str, key: str, out: str | None = None) -> DataFrame:
    """percent rank of ``value`` inside its group,
    (rank - 1) / (group size - 1), rank = 1 + rows with a smaller value.

    Computed from counts per (group, value) with range-split running sums,
    so a hot group is not sorted by one task."""
    keys = as_list(keys)
    name = out or f"{value}_pct_rank"
    cnt = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = prefix_sums(cnt, value, ["_n"], by=keys, inclusive=False)  # rows strictly smaller
    size = cnt.groupBy(*keys).agg(F.sum("_n").alias("_size"))  # one row per group
    t = join_null_safe(cum, bounded(size), keys).select(*keys, value, F.coalesce(
        safe_div(F.col("_n_cum").cast("double"), (F.col("_size") - 1).cast("double")), F.lit(0.0)).alias(name))
    return df.join(bounded(t), on=[*keys, value], how="left")


# ------------------------------------------------------------ dense cube

def dense_counts(df: DataFrame, keys) -> DataFrame:
    """counts over ALL combinations of the keys' levels (zero cells
    included) plus log1p. The level sets are distinct-value tables; their
    product is the output itself, so the caller chooses the keys; a level set
    is broadcast only where its measured size allows."""
    keys = as_list(keys)
    levels = [df.select(k).where(F.col(k).isNotNull()).distinct() for k in keys]
    grid = reduce(lambda a, b: a.crossJoin(bounded(b)), levels)
    cnt = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(cnt, keys, "left").select(
        *keys, F.coalesce(F.col("n"), F.lit(0)).alias("n"), F.log1p(F.coalesce(F.col("n"), F.lit(0))).alias("log1p_n"))


# ------------------------------------------------------------ noise / gauss

def rank_scaled(df: DataFrame, col: str, key: str) -> DataFrame:
    """F25 first half: ordinal rank (ties by key) / N, centred, x 2, in (-1, 1)."""
    one = df.select(col, key).withColumn("_one", F.lit(1))
    ranked = prefix_sums(one, [col, key], ["_one"], inclusive=False)  # 0-based ordinal rank
    n = df.agg(F.count(F.lit(1)).alias("_N"))
    x = ranked.crossJoin(F.broadcast(n))
    r = F.col("_one_cum") / F.col("_N")
    centred = (r - (F.col("_N") - 1) / (2.0 * F.col("_N"))) * 2.0  # mean of rank/N is (N-1)/(2N)
    return x.select(key, centred.alias(f"{col}_rank"))


def rank_gauss(df: DataFrame, col: str, key: str) -> DataFrame:
    """erfinv of the centred scaled rank, centred again."""
    r = rank_scaled(df, col, key)
    g = r.withColumn("_g", erfinv(f"{col}_rank"))
    m = g.agg(F.avg("_g").alias("_m"))
    return g.crossJoin(F.broadcast(m)).select(key, (F.col("_g") - F.col("_m")).alias(f"{col}_gauss"))


def swap_noise(df: DataFrame, cols, key: str, p: float, seed: int = 0) -> DataFrame:
    """each value is replaced, with probability ``p``, by the value of a
    donor row of the same column. Swap decision and donor position are keyed
    by md5(key, seed) so reruns give the same table; donors are found by an
    equi-join on a row position (no pairs are enumerated)."""
    cols = as_list(cols)
    pos = hashed_rank(df.withColumn("_h", order_hash(key, seed)), "_h", tiebreak=key, out="_pos").drop("_h")
    pos = pos.persist(StorageLevel.DISK_ONLY)  # used as row table and as donor table
    n = pos.agg(F.count(F.lit(1)).alias("_N"))
    out = pos.crossJoin(F.broadcast(n))
    for i, k in enumerate(cols):
        s1, s2 = f"{seed}:{k}:swap", f"{seed}:{k}:donor"
        out = out.withColumn(f"_swap_{k}", hash_unit(key, s1) < F.lit(p)) \
                 .withColumn(f"_dpos_{k}", F.floor(hash_unit(key, s2) * F.col("_N")).cast("long"))
        donors = pos.select(F.col("_pos").alias(f"_dpos_{k}"), F.col(k).alias(f"_dval_{k}"))
        out = out.join(donors, f"_dpos_{k}", "left").withColumn(
            k, F.when(F.col(f"_swap_{k}"), F.col(f"_dval_{k}")).otherwise(F.col(k))) \
            .drop(f"_swap_{k}", f"_dpos_{k}", f"_dval_{k}")
    return out.drop("_pos", "_N")
