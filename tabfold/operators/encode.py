"""Category encoders (E1-E19). ``fit_*`` returns a small DataFrame learned on
training rows; ``apply_*`` joins it (or maps it) onto any rows."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list, c, hash_unit, safe_div
from tabfold.functions.ranking import prefix_sums, quantiles
from tabfold.operators.joins import bounded
from tabfold.session import cut_lineage



# ---------------------------------------------------------------- E1-E4 codes

def fit_label(df: DataFrame, cols) -> DataFrame:
    """code = position of the level in sorted order, per column.
    Returns ``(column, level, code)``; levels are compared as text."""
    cols = as_list(cols)
    levels = df.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("level")) for x in cols
    ])).alias("s")).select("s.*").where(F.col("level").isNotNull()).distinct()
    ranked = prefix_sums(levels.withColumn("_one", F.lit(1)), "level", ["_one"], by="column",
                         inclusive=False)
    return ranked.select("column", "level", F.col("_one_cum").cast("int").alias("code"))


def apply_label(df: DataFrame, fitted: DataFrame, cols, null_code: int | None = None,
                suffix: str = "", unseen_code: int | None | str = "as null") -> DataFrame:
    """Replace each column by its code; null levels get ``null_code``,
    levels that the fit did not see ``unseen_code`` (default: like nulls)."""
    unseen_code = null_code if unseen_code == "as null" else unseen_code
    out = df
    fitted = bounded(fitted)
    for x in as_list(cols):
        t = fitted.where(F.col("column") == x).select(
            F.col("level").alias("_lvl"), F.col("code").alias(f"{x}{suffix}__code"))
        out = out.join(t, out[x].cast("string") == t["_lvl"], "left").drop("_lvl")
        other = F.when(F.col(x).isNull(), F.lit(null_code)).otherwise(F.lit(unseen_code)).cast("int")
        out = out.withColumn(f"{x}{suffix}__code", F.coalesce(F.col(f"{x}{suffix}__code"), other))
        out = out.drop(x) if not suffix else out
        out = out.withColumnRenamed(f"{x}{suffix}__code", f"{x}{suffix}")
    return out


def fit_factorize(df: DataFrame, col: str, order) -> DataFrame:
    """Code by first appearance in ``order`` (the level's smallest order
    key), 0-based. Returns ``(level, code)``."""
    first = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("level")) \
        .agg(F.min(c(order)).alias("_first"))
    ranked = prefix_sums(first.withColumn("_one", F.lit(1)), ["_first", "level"], ["_one"],
                         inclusive=False)
    return ranked.select("level", F.col("_one_cum").cast("int").alias("code"))


# ---------------------------------------------------------------- E5/E6 maps

def ordinal(df: DataFrame, col: str, mapping: dict, default=None, out: str | None = None) -> DataFrame:
    """Declared order via a literal map (no join)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    v = m[F.col(col)]
    if default is not None:
        v = F.coalesce(v, F.lit(default))
    return df.withColumn(out or col, v)


# ---------------------------------------------------------------- E7 top-n

def fit_freq_rank(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent levels, coded 0..n-1 by count desc, ties to
    the larger level; other levels get no code. Distributed top-k
    (per-partition top-n, then merge)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("level")).count()
    top = counts.orderBy(F.col("count").desc(), F.col("level").desc()).limit(n)
    w = Window.orderBy(F.col("count").desc(), F.col("level").desc())  # <= n rows
    return top.select("level", "count", (F.row_number().over(w) - 1).cast("int").alias("code"))


def apply_freq_rank(df: DataFrame, fitted: DataFrame, col: str, out: str) -> DataFrame:
    t = fitted.select(F.col("level").alias(col), F.col("code").alias(out))
    return df.join(bounded(t), on=col, how="left")


# ---------------------------------------------------------------- E8/E9 one-hot

def fit_onehot(df: DataFrame, cols) -> dict[str, list]:
    """Fitted level lists (sorted). The schema of the output depends on
    them, so they come to the driver; for columns with very many levels
    ``sparse_onehot`` gives one vector column instead."""
    return {x: sorted(r[0] for r in df.select(x).where(F.col(x).isNotNull()).distinct().collect())
            for x in as_list(cols)}


def sparse_onehot(df: DataFrame, cols, out: str = "onehot") -> PipelineModel:
    """E8 in sparse form, for any number of levels: a fitted pipeline that adds
    one sparse vector column ``out``; unseen levels are all zero."""
    cols = as_list(cols)
    index = StringIndexer(inputCols=cols, outputCols=[f"_i_{x}" for x in cols], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"_i_{x}" for x in cols], outputCols=[f"_h_{x}" for x in cols], dropLast=True)
    join = VectorAssembler(inputCols=[f"_h_{x}" for x in cols], outputCol=out)
    return Pipeline(stages=[index, hot, join]).fit(df)


def dummy_name(col: str, level) -> str:
    return f"{col}_{level}"


def apply_onehot(df: DataFrame, levels: dict[str, list], drop_first: bool = False,
                 dummy_na: bool = False, keep: bool = False) -> DataFrame:
    """One 0/1 column per fitted level (``<col>_<level>``), so train and
    test get the same columns; levels unseen at fit time give all zeros."""
    exprs = []
    for x, lv in levels.items():
        use = lv[1:] if drop_first else lv
        exprs += [F.coalesce((F.col(x) == F.lit(v)).cast("int"), F.lit(0)).alias(dummy_name(x, v))
                  for v in use]
        if dummy_na:
            exprs.append(F.col(x).isNull().cast("int").alias(dummy_name(x, "nan")))
    base = [F.col(n) for n in df.columns if keep or n not in levels]
    return df.select(*base, *exprs)


# ---------------------------------------------------------------- E10 counts

def fit_count_encode(df: DataFrame, col: str, scale: bool = True) -> DataFrame:
    """Level count, optionally min-max scaled over levels."""
    counts = df.groupBy(F.col(col).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    if not scale:
        return counts.withColumn("value", F.col("n").cast("double"))
    mm = counts.agg(F.min("n").alias("_mn"), F.max("n").alias("_mx"))
    return counts.crossJoin(F.broadcast(mm)).select(  # one-row side
        "level", "n", F.coalesce(safe_div(F.col("n") - F.col("_mn"), F.col("_mx") - F.col("_mn")),
                                 F.lit(0.0)).alias("value"))


def apply_count_encode(df: DataFrame, fitted: DataFrame, col: str, out: str, default: float = 0.0) -> DataFrame:
    """Attach the fitted value of each level; unseen and null levels get ``default``."""
    t = bounded(fitted.select(F.col("level").alias(col), F.col("value").alias(out)))
    return df.join(t, on=col, how="left").withColumn(out, F.coalesce(out, F.lit(default)))


# ---------------------------------------------------------------- E11/E12 target

def fit_target_mean(df: DataFrame, keys, y: str) -> DataFrame:
    """Label mean per combination of ``keys``."""
    keys = as_list(keys)
    return df.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("mean"),
                                 F.count(F.lit(1)).alias("n"))


def apply_target_mean(df: DataFrame, fitted: DataFrame, keys, out: str) -> DataFrame:
    """Attach the fitted label mean of each key combination (unseen: null)."""
    keys = as_list(keys)
    return df.join(bounded(fitted.select(*keys, F.col("mean").alias(out))), on=keys, how="left")


def fit_target_encode(df: DataFrame, col: str, y: str, min_samples_leaf: float = 1.0,
                      smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Smoothed target encoding.

    w = 1 / (1 + exp(-(n - min_samples_leaf) / smoothing));
    value = prior * (1 - w) + mean * w. Returns (per-level table, one-row prior).
    """
    # one pass over the rows: the level table, its NULL level included, gives the prior
    st = cut_lineage(df.groupBy(F.col(col).alias("level")).agg(
        F.avg(F.col(y).cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col(y).cast("double")).alias("_s"), F.count(y).alias("_c")))
    prior = cut_lineage(st.agg((F.sum("_s") / F.sum("_c")).alias("prior")))
    st = st.where(F.col("level").isNotNull()).drop("_s", "_c")
    w = 1.0 / (1.0 + F.exp(-(F.col("n") - F.lit(min_samples_leaf)) / F.lit(float(smoothing))))
    table = st.crossJoin(F.broadcast(prior)).select(  # prior: one row
        "level", "mean", "n", (F.col("prior") * (1 - w) + F.col("mean") * w).alias("smoothed"))
    return table, prior


def apply_target_encode(df: DataFrame, table: DataFrame, prior: DataFrame, col: str, out: str,
                        noise_level: float = 0.0, seed: int = 0, key: str | None = None) -> DataFrame:
    """Unseen or null levels get the prior. Optional multiplicative noise
    x * (1 + level * N(0,1)); the normal draw is keyed by md5(key, seed)
    (Box-Muller of two keyed uniforms), so reruns and retries agree."""
    t = table.select(F.col("level").alias(col), F.col("smoothed").alias(out))
    x = df.join(bounded(t), on=col, how="left").crossJoin(F.broadcast(prior))  # prior: one row
    x = x.withColumn(out, F.coalesce(F.col(out), F.col("prior"))).drop("prior")
    if noise_level:
        if key is None:
            raise ValueError("keyed noise needs the row key")
        u1 = F.greatest(hash_unit(key, f"{seed}:n1"), F.lit(1e-300))
        u2 = hash_unit(key, f"{seed}:n2")
        z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)
        x = x.withColumn(out, F.col(out) * (1 + noise_level * z))
    return x


def fit_target_encode_oof(df: DataFrame, col: str, y: str, fold: str, min_samples_leaf: float = 1.0,
                          smoothing: float = 1.0) -> DataFrame:
    """E12 out of fold: a row in fold k is encoded with statistics of the
    rows in the other folds only (no target leakage). One aggregation per
    (level, fold); the other-fold statistics are the level totals minus the
    fold's own, so k folds cost one pass, not k. Returns
    ``(level, fold, smoothed)`` plus ``(fold, prior)`` rows with level NULL."""
    yy = F.col(y).cast("double")
    lf = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("level"), F.col(fold).alias("fold")) \
        .agg(F.sum(yy).alias("_s"), F.count(F.lit(1)).alias("_n"))
    lv = lf.groupBy("level").agg(F.sum("_s").alias("_ls"), F.sum("_n").alias("_ln"))
    fo = df.groupBy(F.col(fold).alias("fold")).agg(F.sum(yy).alias("_fs"), F.count(F.lit(1)).alias("_fn"))
    tot = fo.agg(F.sum("_fs").alias("_ts"), F.sum("_fn").alias("_tn"))
    pri = fo.crossJoin(F.broadcast(tot)).select(  # one row per fold
        "fold", ((F.col("_ts") - F.col("_fs")) / (F.col("_tn") - F.col("_fn"))).alias("prior"))
    # every (level, fold) pair, including folds where the level does not occur
    grid = lv.crossJoin(F.broadcast(pri.select("fold", "prior")))  # levels x k folds
    x = grid.join(lf, ["level", "fold"], "left").fillna(0, ["_s", "_n"])
    n = F.col("_ln") - F.col("_n")
    mean = safe_div(F.col("_ls") - F.col("_s"), n.cast("double"))
    w = 1.0 / (1.0 + F.exp(-(n - F.lit(min_samples_leaf)) / F.lit(float(smoothing))))
    sm = F.when(n > 0, F.col("prior") * (1 - w) + mean * w).otherwise(F.col("prior"))
    return x.select("level", "fold", sm.alias("smoothed")).unionByName(
        pri.select(F.lit(None).cast(x.schema["level"].dataType).alias("level"), "fold",
                   F.col("prior").alias("smoothed")))


def apply_target_encode_oof(df: DataFrame, table: DataFrame, col: str, fold: str, out: str) -> DataFrame:
    """Join the out-of-fold encoding on (level, fold); unseen or null levels
    get the fold's prior."""
    t = bounded(table)
    lvl = t.where(F.col("level").isNotNull()).select(F.col("level").alias(col), F.col("fold").alias(fold),
                                                     F.col("smoothed").alias(out))
    pri = t.where(F.col("level").isNull()).select(F.col("fold").alias(fold), F.col("smoothed").alias("_prior"))
    x = df.join(lvl, [col, fold], "left").join(pri, fold, "left")
    return x.withColumn(out, F.coalesce(F.col(out), F.col("_prior"))).drop("_prior")


# ---------------------------------------------------------------- E13-E15 WOE

def fit_woe(df: DataFrame, col: str, y: str, kind: str = "share") -> DataFrame:
    """E13 (share form): woe = ln((non_i/non) / (ev_i/ev)), infinite -> 0,
    iv_i = (non_i/non - ev_i/ev) * woe.
    E14 (odds form): woe = ln(non_i/ev_i) with shares inside the level; a zero
    count leaves woe null."""
    g = df.groupBy(F.col(col).alias("level")).agg(
        F.sum((F.col(y) == 0).cast("long")).alias("non_event"),
        F.sum((F.col(y) == 1).cast("long")).alias("event"))
    if kind == "odds":
        n = F.col("non_event") + F.col("event")
        return g.select("level", "non_event", "event",
                        safe_div(F.col("non_event"), n).alias("perc_non_event"),
                        safe_div(F.col("event"), n).alias("perc_event"),
                        F.when((F.col("non_event") > 0) & (F.col("event") > 0),
                               F.log(F.col("non_event") / F.col("event"))).alias("woe"))
    tot = df.agg(F.sum((F.col(y) == 0).cast("long")).alias("_non"),
                 F.sum((F.col(y) == 1).cast("long")).alias("_ev"))
    x = g.crossJoin(F.broadcast(tot))  # one-row side
    sn = safe_div(F.col("non_event"), F.col("_non"))
    se = safe_div(F.col("event"), F.col("_ev"))
    woe = F.when((F.col("non_event") > 0) & (F.col("event") > 0), F.log(sn / se)).otherwise(F.lit(0.0))
    return x.select("level", "non_event", "event", sn.alias("perc_non_event"), se.alias("perc_event"),
                    woe.alias("woe"), ((sn - se) * woe).alias("iv"))


def collapse_woe_tail(df: DataFrame, col: str, y: str, k: int) -> DataFrame:
    """E14 with a merged tail: numeric levels >= k are one level (``k``) and
    that level's counts get +1/+1 before the odds."""
    x = df.withColumn(col, F.least(F.col(col), F.lit(k)))
    t = fit_woe(x, col, y, kind="odds")
    bump = (F.col("level") == k).cast("long")
    ne, ev = F.col("non_event") + bump, F.col("event") + bump
    return t.select("level", ne.alias("non_event"), ev.alias("event"),
                    (ne / (ne + ev)).alias("perc_non_event"), (ev / (ne + ev)).alias("perc_event"),
                    F.when((ne > 0) & (ev > 0), F.log(ne / ev)).alias("woe"))


def information_value(df: DataFrame, cols, y: str) -> DataFrame:
    """IV per column, ``(column, iv)``; the per-level tables of all
    columns are computed in one grouped pass over a melted view."""
    cols = as_list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, iv double")
    long = df.select(F.col(y), F.explode(F.array(*[
        F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("level")) for x in cols
    ])).alias("s")).select(F.col(y), "s.*")
    g = long.groupBy("column", "level").agg(
        F.sum((F.col(y) == 0).cast("long")).alias("non_event"),
        F.sum((F.col(y) == 1).cast("long")).alias("event"))
    tot = df.agg(F.sum((F.col(y) == 0).cast("long")).alias("_non"),
                 F.sum((F.col(y) == 1).cast("long")).alias("_ev"))
    x = g.crossJoin(F.broadcast(tot))
    sn = safe_div(F.col("non_event"), F.col("_non"))
    se = safe_div(F.col("event"), F.col("_ev"))
    woe = F.when((F.col("non_event") > 0) & (F.col("event") > 0), F.log(sn / se)).otherwise(0.0)
    return x.groupBy("column").agg(F.sum((sn - se) * woe).alias("iv"))


def apply_woe(df: DataFrame, table: DataFrame, col: str, out: str) -> DataFrame:
    t = bounded(table.select(F.col("level").cast("string").alias("_lvl"), F.col("woe").alias(out)))
    return df.join(t, df[col].cast("string") == t["_lvl"], "left").drop("_lvl")


# ---------------------------------------------------------------- E16-E19 bins

def bin_edges(df: DataFrame, col: str, edges: list[float], labels: list | None = None,
              right: bool = True, include_lowest: bool = False, out: str | None = None) -> DataFrame:
    """Intervals between consecutive ``edges``; right-closed like
    pandas ``cut`` by default. Values outside get null."""
    labels = labels or list(range(1, len(edges)))
    x = F.col(col)
    expr: Column | None = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        if right:
            cond = ((x > lo) | (F.lit(include_lowest and i == 0) & (x == lo))) & (x <= hi)
        else:
            cond = (x >= lo) & ((x < hi) | (F.lit(include_lowest and i == len(edges) - 2) & (x == hi)))
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return df.withColumn(out or f"{col}_bin", expr)


def fit_quantile_edges(df: DataFrame, col: str, probs: list[float], exact: bool = True,
                       accuracy: int = 10000) -> DataFrame:
    """Unique quantile edges, one-row ``edges`` array (exact by default;
    ``exact=False`` uses the bounded-memory sketch)."""
    if exact:
        q = quantiles(df, [col], probs)
        arr = F.array(*[F.col(f"q{i}") for i in range(len(probs))])
        return q.select(F.array_sort(F.array_distinct(arr)).alias("edges"))
    arr = F.array(*[F.lit(float(p)) for p in probs])
    q = F.percentile_approx(F.col(col), arr, accuracy)
    return df.agg(F.array_sort(F.array_distinct(q.cast("array<double>"))).alias("edges"))


def apply_quantile_bins(df: DataFrame, edges: DataFrame, col: str, out: str) -> DataFrame:
    """Right-closed bins over the fitted edges, lowest edge included; bin id is
    1-based, ``lower`` / ``upper`` give the interval. Edges are one broadcast row."""
    x = df.crossJoin(F.broadcast(edges))
    n_le_below = F.size(F.filter(F.col("edges"), lambda e: e < F.col(col)))
    bin_id = F.when(F.col(col) == F.col("edges")[0], F.lit(1)).otherwise(n_le_below)
    inside = (F.col(col) >= F.col("edges")[0]) & (F.col(col) <= F.element_at(F.col("edges"), -1))
    x = x.withColumn(out, F.when(inside & F.col(col).isNotNull(), bin_id))
    return x.withColumn(f"{out}_lower", F.when(F.col(out).isNotNull(), F.col("edges")[F.col(out) - 1])) \
            .withColumn(f"{out}_upper", F.when(F.col(out).isNotNull(), F.col("edges")[F.col(out)])) \
            .drop("edges")


def fit_binned_woe(df: DataFrame, col: str, y: str, probs: list[float]) -> DataFrame:
    """Quantile bins then within-bin odds WOE with the interval bounds."""
    edges = fit_quantile_edges(df, col, probs)
    b = apply_quantile_bins(df, edges, col, "_bin")
    t = fit_woe(b, "_bin", y, kind="odds")
    bounds = b.groupBy(F.col("_bin").alias("level")).agg(F.first("_bin_lower").alias("lower"),
                                                         F.first("_bin_upper").alias("upper"))
    return t.join(bounds, "level")
