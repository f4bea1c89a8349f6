"""End-to-end recipes (Z1-Z9): the reference's notebook chains expressed as
one Spark job each, built only from the library's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfold.operators import clean as C
from tabfold.operators import columns as J
from tabfold.operators import encode as E
from tabfold.operators import ensemble as B
from tabfold.operators import evaluate as V
from tabfold.operators import features as FE
from tabfold.operators import models as M
from tabfold.operators import profile as P
from tabfold.operators import sampling as R
from tabfold.operators import scale as K
from tabfold.operators import select as X
from tabfold.operators import setops as U
from tabfold.operators.joins import bounded
from tabfold.plans.registry import register
from tabfold.session import cut_lineage
from tabfold.sources import files as S
from tabfold.sources.tables import entity, scores_long, train_test

NUM = ["price", "acctbal", "rating", "nation"]


@register("z1_profile_report")
def z1_profile_report(spark: SparkSession, d: str) -> DataFrame:
    """Shape, nulls, distinct counts, describe, class balance and label
    correlations in one long (section, name, metric, value) table."""
    tr, _ = train_test(spark, d)
    parts = [
        P.shape(tr).select(F.lit("shape").alias("section"), F.lit("table").alias("name"),
                           F.inline(F.array(F.struct(F.lit("rows").alias("metric"), F.col("n_rows").cast("double").alias("value")),
                                            F.struct(F.lit("cols").alias("metric"), F.col("n_cols").cast("double").alias("value"))))),
        P.null_report(tr).select(F.lit("nulls"), "column", F.lit("pct"), F.col("pct").cast("double")),
        P.nunique(tr).select(F.lit("nunique"), "column", F.lit("n"), F.col("nunique").cast("double")),
        P.describe(tr, NUM).select(F.lit("describe"), "column", F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in
            ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]]))),
        P.class_balance(tr, "y").select(F.lit("balance"), F.col("y").cast("string"), F.lit("share"), "share"),
        P.corr_with(tr, NUM, "y").select(F.lit("corr_y"), "column", F.lit("corr"), "corr"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("section", "name", "metric", "value")


@register("z2_baseline_submission")
def z2_baseline_submission(spark: SparkSession, d: str) -> DataFrame:
    """CSV in, rename, constant fill, robust scaling, hold-out split,
    boosted trees, hold-out metrics, submission CSV out. Returns the
    hold-out metrics row joined with the number of submitted rows."""
    e = entity(spark, d).select("key", "price", "acctbal", "rating", "nation", "y", "part")
    src = S.write_csv(e, S.scratch_path(spark, "z2-in"))
    raw = S.read_csv(spark, src, "key long, price double, acctbal double, rating int, nation int, y int, part string")
    x = J.rename(raw, {"price": "total_price", "acctbal": "balance"})
    x = C.fill_const(x, {"rating": 0})
    feats = ["total_price", "balance", "rating", "nation"]
    tr = x.where(F.col("part") == "train")
    sc = K.fit_robust(tr, feats)
    x = K.apply_scaler(x, sc, feats, "robust")
    tr = R.split(x.where(F.col("part") == "train"), "key", [0.7, 0.3], seed=42, names=["fit", "hold"])
    m = M.fit("gbt", tr.where(F.col("part") == "fit").drop("part"), feats, "y", maxIter=10, maxDepth=3, seed=1)
    hold = M.score(m, tr.where(F.col("part") == "hold"), ["key", "y"])
    met = V.f1_at(hold, "y", "p", 0.35)
    test = M.score(m, x.where(F.col("part") == "test"), "key").withColumn("is_positive", V.decide("p", 0.35))
    out = S.write_submission(test, S.scratch_path(spark, "z2-out"), "key", "is_positive")
    n = S.read_csv(spark, out, "key long, is_positive int").agg(F.count(F.lit(1)).alias("submitted"))
    return met.crossJoin(n)


@register("z3_group_feature_table")
def z3_group_feature_table(spark: SparkSession, d: str) -> DataFrame:
    """Z3: stack train/test, drop rows with train-only values, cross keys,
    ratios, codes by first sight, count encodings, group statistics, then
    drop constant, no-signal and drifting columns, and apply the IV bounds."""
    tr, te = train_test(spark, d)
    st = U.stack_train_test(tr, te)
    st = st.withColumn("seg_prio", FE.cross("segment", "priority")) \
           .withColumn("price_per_nation", FE.ratio("price", F.col("nation") + 1))
    st = cut_lineage(st)  # read by every fit below
    only_train = U.level_diff(st.where("is_train = 1"), st.where("is_train = 0"), "seg_prio")
    st = st.join(bounded(only_train), "seg_prio", "left_anti")
    codes = E.fit_factorize(st, "seg_prio", "key").select(F.col("level").alias("seg_prio"),
                                                            F.col("code").alias("seg_prio_code"))
    st = st.join(bounded(codes), "seg_prio", "left")
    st = E.apply_count_encode(st, E.fit_count_encode(st, "segment"), "segment", "segment_counts")
    st = FE.group_stats(st, ["segment", "priority"], "acctbal", aggs=("min", "mean", "max", "std"))
    st = C.fill_const(st, {"rating": 0})
    num = [c for c, t in st.dtypes if t in ("int", "bigint", "double") and c not in ("key", "y", "is_train")]
    st = cut_lineage(st.select("key", "y", "is_train", *num))  # read by every test of the columns
    const = {r[0] for r in C.constant_columns(st.select(*num)).collect()}
    lab = st.where(F.col("y").isNotNull())
    same = {r[0] for r in X.same_distribution(lab, [c for c in num if c not in const], "y").collect()}
    drift = {r[0] for r in X.drift_report(st, [c for c in num if c not in const], "y").collect()}
    keep = [c for c in num if c not in const | same | drift]
    iv = E.information_value(lab, keep, "y").withColumnRenamed("column", "feature")
    within = {r["feature"] for r in X.select_by_iv(iv, 1e-4, 0.8).collect()}
    final = [c for c in keep if c in within]
    return st.select("key", "y", "is_train", *final)


@register("z4_target_encoding_cv")
def z4_target_encoding_cv(spark: SparkSession, d: str) -> DataFrame:
    """Fill, stack, smoothed target encoding fitted on train, one-hot,
    stratified folds, 5-fold logistic CV, OOF cutoff sweep; OOF written
    partitioned. Returns the best cutoff row."""
    tr, te = train_test(spark, d)
    tr = C.fill_const(tr, {"rating": 0})
    te = C.fill_const(te, {"rating": 0})
    table, prior = E.fit_target_encode(tr, "nation", "y", min_samples_leaf=100, smoothing=20)
    tr = E.apply_target_encode(tr, table, prior, "nation", "te_nation")
    te = E.apply_target_encode(te, table, prior, "nation", "te_nation")
    lv = E.fit_onehot(tr, ["segment"])
    tr, te = E.apply_onehot(tr, lv, keep=True), E.apply_onehot(te, lv, keep=True)
    feats = ["te_nation", "rating"] + [E.dummy_name("segment", v) for v in lv["segment"][1:]]
    tr = R.add_fold(tr, "key", 5, seed=3, by="y")
    oof, _, _ = M.cv_oof("logistic", tr, te, feats, "y", "key")
    S.write_oof(oof.withColumn("model", F.lit("te_logistic")).withColumn("run", F.lit(1)),
                S.scratch_path(spark, "z4-oof"))
    return V.best_cutoff(V.sweep(oof, "y", "p", 0.0, 0.01, 101))


@register("z5_woe_scorecard")
def z5_woe_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """WOE of categories (odds form), tail-collapsed count feature,
    quantile-binned WOE of a number, constant fill, a ratio, boosted trees,
    decisions. Returns (key, p, decision) for the test rows."""
    tr, te = train_test(spark, d)
    w_seg = E.fit_woe(tr, "segment", "y", kind="odds")
    w_nat = E.collapse_woe_tail(tr, "nation", "y", 20)
    w_price = E.fit_binned_woe(tr, "price", "y", [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99, 1.0])
    edges = E.fit_quantile_edges(tr, "price", [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99, 1.0])

    def prep(x):
        x = E.apply_woe(x, w_seg, "segment", "woe_segment")
        x = C.collapse_tail(x, "nation", 20)
        x = E.apply_woe(x, w_nat, "nation", "woe_nation")
        x = E.apply_quantile_bins(x, edges, "price", "price_bin")
        x = E.apply_woe(x, w_price, "price_bin", "woe_price")
        x = C.fill_const(x, {"woe_segment": 0.0, "woe_nation": 0.0, "woe_price": 0.0})
        return x.withColumn("acct_per_price", F.coalesce(FE.ratio("acctbal", "price"), F.lit(0.0)))

    feats = ["woe_segment", "woe_nation", "woe_price", "acct_per_price"]
    m = M.fit("gbt", prep(tr), feats, "y", maxIter=10, maxDepth=3, seed=1)
    s = M.score(m, prep(te), "key")
    return s.withColumn("decision", V.decide("p", 0.35))


@register("z6_score_blend")
def z6_score_blend(spark: SparkSession, d: str) -> DataFrame:
    """Score files -> long table -> harmonic blend per key -> OOF sweep
    -> best cutoff -> test decisions written. Returns the test decisions."""
    sl = scores_long(spark, d)
    root = S.scratch_path(spark, "z6")
    for m in ("m1", "m2", "m3"):
        for sp in ("oof", "test"):
            S.write_csv(sl.where((F.col("model") == m) & (F.col("split") == sp)).select("key", "y", "p"),
                        f"{root}/{m}_{sp}", compression="gzip")
    long = S.read_scores(spark, f"{root}/*", "key string, y int, p double")
    long = long.withColumn("model", F.regexp_extract("file", r"/(m[0-9]+)_(oof|test)/", 1)) \
        .withColumn("split", F.regexp_extract("file", r"/(m[0-9]+)_(oof|test)/", 2))
    blend = B.blend(long, "hmean", key=["key", "split", "y"])
    best = cut_lineage(V.best_cutoff(V.sweep(blend.where(F.col("split") == "oof"), "y", "p_blend", 0.0, 0.01, 101)))
    test = blend.where(F.col("split") == "test").crossJoin(F.broadcast(best.select("cutoff")))  # one row
    # written once: both the submission and the result read it
    dec = cut_lineage(test.select("key", (F.col("p_blend") > F.col("cutoff")).cast("int").alias("is_positive")))
    S.write_submission(dec, S.scratch_path(spark, "z6-out"), "key", "is_positive")
    return dec


MIN_BASE_F1 = 0.2  # base models below it are left out of the stack


@register("z7_three_level_stack")
def z7_three_level_stack(spark: SparkSession, d: str) -> DataFrame:
    """Pick base models by recorded OOF F1, align by key, level-2 and
    level-3 stacks. Returns the level-3 fold metrics."""
    sl = scores_long(spark, d)
    oof, test = sl.where(F.col("split") == "oof"), sl.where(F.col("split") == "test")
    rec = V.f1_at(oof, "y", "p", 0.25, by="model").select("model", "f1")
    models = [r["model"] for r in B.select_models(rec, "f1", MIN_BASE_F1).collect()]  # small metric table
    o2, t2, _ = M.stack(oof.where(F.col("model").isin(models)), test.where(F.col("model").isin(models)), models, "y")
    o3_in = oof.select("key", "y", "fold", "model", "p").unionByName(
        o2.withColumn("model", F.lit("l2")).select("key", "y", "fold", "model", "p"))
    t3_in = test.select("key", "model", "p").unionByName(t2.withColumn("model", F.lit("l2")).select("key", "model", "p"))
    _, _, met = M.stack(o3_in, t3_in, [*models, "l2"], "y", cutoff=0.3)
    return met


@register("z8_pairwise_target_table")
def z8_pairwise_target_table(spark: SparkSession, d: str) -> DataFrame:
    """Stack, fill, label mean per category pair fitted on train joined on
    both keys, pairwise group means, one-hot."""
    tr, te = train_test(spark, d)
    st = C.fill_const(U.stack_train_test(tr, te), {"rating": 0})
    cats = ["segment", "priority", "nation"]
    out = st
    lab = st.where(F.col("is_train") == 1)
    for i, a in enumerate(cats):
        for b in cats[i + 1:]:
            out = E.apply_target_mean(out, E.fit_target_mean(lab, [a, b], "y"), [a, b], f"tm_{a}_{b}")
    out = FE.pairwise_means(out, cats, ["price", "acctbal"])
    lv = E.fit_onehot(lab, ["segment"])
    return E.apply_onehot(out, lv)


@register("z9_undersampled_voting")
def z9_undersampled_voting(spark: SparkSession, d: str) -> DataFrame:
    """Min-max scaling, 1.5:1 undersampling, three learners, weighted
    hard vote, metrics on a hold-out fold."""
    tr, _ = train_test(spark, d)
    tr = C.fill_const(tr, {"rating": 0})
    feats = ["price", "acctbal", "rating", "nation"]
    sc = K.fit_minmax(tr, feats)
    tr = M.written_once(R.add_fold(K.apply_scaler(tr, sc, feats, "minmax"), "key", 5, seed=8, by="y"), ["key", "y", "fold", *feats])
    fit_rows = cut_lineage(R.undersample(tr.where(F.col("fold") != 0), "y", "key", ratio=1.5, seed=8))
    hold = tr.where(F.col("fold") == 0)
    longs = []
    for name, kind, params in [("lr", "logistic", {}), ("tree", "tree", {"maxDepth": 4}),
                               ("nb", "naive_bayes", {"modelType": "gaussian"})]:
        m = M.fit(kind, fit_rows, feats, "y", **params)
        longs.append(M.score(m, hold, ["key", "y"]).withColumn("model", F.lit(name)))
    long = longs[0].unionByName(longs[1]).unionByName(longs[2])
    votes = B.vote(long, 0.5, weights={"lr": 1, "tree": 2, "nb": 1}, key=["key", "y"])
    return V.f1_at(votes, "y", "vote", 0.5)
