"""Queries at the MLlib edge (rows-only checks: fitted models) and exact
k-NN queries (checked against brute force in SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import clean as C
from tabfold.operators import encode as E
from tabfold.operators import features as FE
from tabfold.operators import linear as L
from tabfold.operators import models as M
from tabfold.operators import neighbors as N
from tabfold.operators import sampling as R
from tabfold.plans.registry import register
from tabfold.plans.q_encode import PRIORITY_ORDER
from tabfold.sources.files import scratch_path
from tabfold.sources.tables import entity, scores_long, table

BASE_FEATS = ["price_k", "acctbal_k", "rating", "nation", "prio_ord"]


def model_frames(spark, d):
    """Train rows (label y, stratified fold 0..4) and test rows, with numeric
    features: rating imputed by the train mode, priority as an ordinal,
    segment one-hot with train levels."""
    e = entity(spark, d)
    tr = e.where(F.col("part") == "train")
    mode = C.fit_mode(tr, ["rating"])
    levels = E.fit_onehot(tr, ["segment"])
    seg = [E.dummy_name("segment", v) for v in levels["segment"]]

    def prep(x):
        x = C.apply_fill(x, mode, ["rating"])
        x = E.ordinal(x, "priority", PRIORITY_ORDER, default=0, out="prio_ord")
        x = E.apply_onehot(x, levels, keep=True)
        return x.withColumn("price_k", F.col("price") / 1000.0).withColumn("acctbal_k", F.col("acctbal") / 1000.0)

    train = R.add_fold(prep(tr), "key", 5, seed=11, by="y")
    test = prep(e.where(F.col("part") == "test")).drop("y")
    return train, test, BASE_FEATS + seg[1:]


def _model_rows(spark, d):
    """Train rows as the queries below read them several times: key, label, fold and
    features, written once."""
    tr, _, feats = model_frames(spark, d)
    return M.written_once(tr, ["key", "y", "fold", *feats]), feats


def _score_query(kind, weight=False, **params):
    def q(spark, d):
        tr, te, feats = model_frames(spark, d)
        if weight:
            tr = R.with_weight(tr, "y", "balanced")
        sized = {"layers": [len(feats), *params["layers"]]} if "layers" in params else {}  # the first layer is the features
        m = M.fit(kind, tr, feats, "y", weight="weight" if weight else None, **{**params, **sized})
        return M.score(m, te, "key")
    q.__doc__ = (f"Fit {kind} ({', '.join(f'{k}={v}' for k, v in params.items()) or 'defaults'}"
                 f"{', balanced class weights' if weight else ''}) on train rows; score test rows.")
    return q


register("m1_logistic_score")(_score_query("logistic", weight=True, regParam=0.01, elasticNetParam=0.0))
register("m2_linear_svm_score")(_score_query("linear_svm", maxIter=30, regParam=0.01))


def _linear_query(loss: str):
    def q(spark, d):
        tr, te, feats = model_frames(spark, d)
        m = L.fit_linear(tr, feats, "y", loss, alpha=1e-3, l1_ratio=0.15)
        return te.select("key", m.probability().alias("p"))

    q.__doc__ = f"Linear model of the {loss} loss with an elastic net, trained on train rows, scored on test rows."
    return q


register("m2b_modified_huber_score")(_linear_query("modified_huber"))
register("m2c_squared_hinge_score")(_linear_query("squared_hinge"))
register("m2d_log_elastic_net_score")(_linear_query("log"))
register("m3_decision_tree_score")(_score_query("tree", maxDepth=5))
register("m4_random_forest_score")(_score_query("forest", numTrees=20, maxDepth=5, seed=1))
register("m5_gbt_weighted_score")(_score_query("gbt", weight=True, maxIter=15, maxDepth=3, seed=1))
register("m6_gbt_regressor_score")(_score_query("gbt_regressor", maxIter=10, maxDepth=3, seed=1))
register("m7_naive_bayes_score")(_score_query("naive_bayes", modelType="gaussian"))
register("m8_mlp_score")(_score_query("mlp", layers=[8, 2], maxIter=40, seed=1))


@register("m10_adaboost_score")
def q_m10(spark, d):
    """Discrete AdaBoost of 5 weighted stumps, lineage cut each round."""
    tr, te, feats = model_frames(spark, d)
    ens, _ = M.adaboost(tr.select("key", "y", *feats), feats, "y", "key", rounds=5)
    return M.adaboost_score(ens, te, "key")


@register("m11_lda_score")
def q_m11(spark, d):
    """Linear discriminant: class moments in one grouped pass, score as a column expression."""
    tr, te, feats = model_frames(spark, d)
    return M.discriminant_score(M.fit_discriminant(tr, feats, "y"), te, "key")


@register("m11b_qda_score")
def q_m11b(spark, d):
    """Quadratic discriminant: one covariance per class."""
    tr, te, feats = model_frames(spark, d)
    return M.discriminant_score(M.fit_discriminant(tr, feats, "y", quadratic=True), te, "key")


@register("m12_compare_learners")
def q_m12(spark, d):
    """Several learners fit on folds 1-4, AUC and F1 on fold 0."""
    tr, feats = _model_rows(spark, d)
    return M.compare_learners(tr.where(F.col("fold") != 0), tr.where(F.col("fold") == 0), feats, "y",
                              {"logistic": {}, "tree": {"maxDepth": 4}, "naive_bayes": {"modelType": "gaussian"}},
                              cutoff=0.35)


@register("m13_grid_search")
def q_m13(spark, d):
    """2 x 2 grid, 5 given folds, F1 of class 1."""
    tr, _, feats = model_frames(spark, d)
    return M.grid_search("tree", tr, feats, "y", {"maxDepth": [2, 4], "minInstancesPerNode": [1, 50]})


@register("m13b_grid_search_best_cutoff")
def q_m13b(spark, d):
    """2-point grid with balanced class weights, F1 at each fold's best cutoff."""
    tr, _, feats = model_frames(spark, d)
    return M.grid_search("logistic", R.with_weight(tr, "y", "balanced"), feats, "y", {"regParam": [0.01, 0.1]},
                         cutoff="best", weight="weight")


@register("m14_random_search")
def q_m14(spark, d):
    """Three seeded random points of a forest space, AUC over the given folds."""
    tr, _, feats = model_frames(spark, d)
    return M.random_search("forest", tr, feats, "y", {"numTrees": [5, 10, 20], "maxDepth": [2, 3, 5]}, 3, seed=4, fold="fold")


@register("m1b_logistic_c_l1")
def q_m1b(spark, d):
    """L1 logistic regression with sklearn-style C = 1.0 mapped to MLlib's regParam = 1 / (C n)."""
    tr, te, feats = model_frames(spark, d)
    m = M.fit("logistic", tr, feats, "y", **M.logistic_params(1.0, tr.count(), l1=True))
    return M.score(m, te, "key")


@register("m15_cv_oof_scores")
def q_m15(spark, d):
    """5-fold CV: every train key scored once by the model that did not see it."""
    tr, te, feats = model_frames(spark, d)
    oof, _, _ = M.cv_oof("logistic", tr, te, feats, "y", "key")
    return oof


@register("m15b_cv_test_mean")
def q_m15b(spark, d):
    """5-fold CV: test scores averaged over the fold models."""
    tr, te, feats = model_frames(spark, d)
    _, test, _ = M.cv_oof("logistic", tr, te, feats, "y", "key")
    return test


@register("m16_cv_fold_metrics")
def q_m16(spark, d):
    """F1 (cutoff 0.35) and AUC per fold (cross_val_score)."""
    tr, _, feats = model_frames(spark, d)
    _, _, met = M.cv_oof("tree", tr, None, feats, "y", "key", cutoff=0.35, maxDepth=4)
    return met


@register("m17_best_rounds")
def q_m17(spark, d):
    """Validation loss after every boosting round and the best round count."""
    tr, _, feats = model_frames(spark, d)
    return M.best_rounds(tr.withColumn("valid", F.col("fold") == 0), feats, "y", "valid", max_iter=12, maxDepth=3)


@register("m17b_best_rounds_cv_refit")
def q_m17b(spark, d):
    """Rounds by the mean validation loss over 5 folds; the refitted learner scores the test rows."""
    tr, te, feats = model_frames(spark, d)
    _, model = M.best_rounds_cv(tr, feats, "y", max_iter=8, maxDepth=3, seed=1)
    return M.score(model, te, "key")


@register("m5b_gbt_early_stopping")
def q_m5b(spark, d):
    """Boosting that stops when the loss on fold 0 no longer falls."""
    tr, te, feats = model_frames(spark, d)
    m = M.fit("gbt", tr.withColumn("valid", F.col("fold") == 0), feats, "y", maxIter=30, maxDepth=3, seed=1,
              validationIndicatorCol="valid", validationTol=0.001)
    return M.score(m, te, "key")


@register("m18_save_load_score")
def q_m18(spark, d):
    """Fit, save to the shared checkpoint folder, load back and score in batch."""
    tr, te, feats = model_frames(spark, d)
    m = M.fit("tree", tr, feats, "y", maxDepth=4)
    path = scratch_path(spark, "m18-tree")
    M.save(m, path)
    return M.score(M.load(path), te, "key")


@register("x6_select_by_importance")
def q_x6(spark, d):
    """Features with forest importance above 1e-6."""
    tr, _, feats = model_frames(spark, d)
    m = M.fit("forest", tr, feats, "y", numTrees=10, maxDepth=4, seed=2)
    return spark.createDataFrame([(f,) for f in M.select_by_importance(m, feats)], "feature string")


@register("x9_forward_selection")
def q_x9(spark, d):
    """Add features in importance order, keep if validation F1 rises."""
    tr, feats = _model_rows(spark, d)
    m = M.fit("tree", tr, feats, "y", maxDepth=4)
    order = [n for n, _ in sorted(M.importances(m, feats), key=lambda t: (-t[1], t[0]))]
    return M.forward_select("logistic", tr.where(F.col("fold") != 0), tr.where(F.col("fold") == 0), order, "y",
                            cutoff=0.35)


@register("x10_permutation_importance")
def q_x10(spark, d):
    """AUC drop on fold 0 after a keyed permutation of each column."""
    tr, feats = _model_rows(spark, d)
    m = M.fit("tree", tr.where(F.col("fold") != 0), feats, "y", maxDepth=4)
    return M.permutation_importance(m, tr.where(F.col("fold") == 0), feats, "y", "key", seed=5)


@register("x11_importance_table")
def q_x11(spark, d):
    """Importances averaged over fold models, with percent of the total."""
    tr, feats = _model_rows(spark, d)
    models = [M.fit("tree", tr.where(F.col("fold") != k), feats, "y", maxDepth=4)
              for k in sorted(r["fold"] for r in tr.select("fold").distinct().collect())]
    return M.importance_table(models, feats, spark)


@register("c9_fill_by_model")
def q_c9(spark, d):
    """Missing rating predicted by a forest from the other columns, rounded."""
    e = entity(spark, d).select("key", "rating", (F.col("price") / 1000).alias("price_k"),
                                (F.col("acctbal") / 1000).alias("acctbal_k"), "nation")
    return M.fill_by_model(e, "rating", ["price_k", "acctbal_k", "nation"], numTrees=10, maxDepth=4, seed=3)


@register("c10_forest_impute_iterated")
def q_c10(spark, d):
    """Iterative forest imputation of two columns (2 rounds, checkpointed)."""
    e = entity(spark, d).select("key", "rating", (F.col("price") / 1000).alias("price_k"), "nation",
                                F.when(F.col("key") % 7 == 0, F.lit(None)).otherwise(F.col("acctbal") / 1000)
                                .alias("acctbal_k"))
    return M.forest_impute(e, ["rating", "acctbal_k"], ["price_k", "nation"], "key", max_iter=2, numTrees=5,
                           maxDepth=3, seed=3)


@register("c9b_fill_text_by_model")
def q_c9b(spark, d):
    """Missing text level predicted by a forest classifier from the other columns."""
    e = entity(spark, d).select("key", "edu", (F.col("price") / 1000).alias("price_k"), (F.col("acctbal") / 1000).alias("acctbal_k"), "nation")
    return M.fill_by_model(e, "edu", ["price_k", "acctbal_k", "nation"], numTrees=10, maxDepth=4, seed=3)


@register("c10b_forest_impute_mixed")
def q_c10b(spark, d):
    """A nullable text and two nullable numbers imputed in one call by iterated forests."""
    e = entity(spark, d).select("key", "rating", "edu", "segment", (F.col("price") / 1000).alias("price_k"),
                                F.when(F.col("key") % 7 == 0, F.lit(None)).otherwise(F.col("acctbal") / 1000).alias("acctbal_k"))
    return M.forest_impute_mixed(e, ["rating", "acctbal_k", "price_k"], ["edu", "segment"], max_iter=3, numTrees=5, maxDepth=3, seed=3)


@register("b11_stack_level2")
def q_b11(spark, d):
    """Level-2 logistic regression on pivoted base-model OOF scores (5 folds)."""
    s = scores_long(spark, d)
    oof = s.where(F.col("split") == "oof")
    test = s.where(F.col("split") == "test")
    o2, _, _ = M.stack(oof, test, ["m1", "m2", "m3"], "y")
    return o2


@register("b12_stack_level3")
def q_b12(spark, d):
    """A second stacking pass over level-2 OOF scores (stack of stacks)."""
    s = scores_long(spark, d)
    oof = s.where(F.col("split") == "oof")
    test = s.where(F.col("split") == "test")
    o2, t2, _ = M.stack(oof, test, ["m1", "m2", "m3"], "y")
    lvl2 = o2.withColumn("model", F.lit("l2"))
    base = oof.select("key", "y", "fold", "model", "p")
    o3_in = base.unionByName(lvl2.select("key", "y", "fold", "model", "p"))
    t3_in = test.select("key", "model", "p").unionByName(t2.withColumn("model", F.lit("l2")).select("key", "model", "p"))
    o3, _, _ = M.stack(o3_in, t3_in, ["m1", "m2", "m3", "l2"], "y", kind="logistic")
    return o3


@register("f19_fm_level_factors")
def q_f19(spark, d):
    """Factorisation machine on the dense brand x type x size counts:
    bias and two factors per level."""
    p = table(spark, d, "part").select("p_brand", "p_type", "p_size")
    dense = FE.dense_counts(p, ["p_brand", "p_type", "p_size"])
    return M.fm_factors(dense, ["p_brand", "p_type", "p_size"], "log1p_n", factor_size=2, seed=1, maxIter=30)


@register("f20_attach_level_vectors")
def q_f20(spark, d):
    """Level factors joined onto every part row by each key."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    dense = FE.dense_counts(p.drop("p_partkey"), ["p_brand", "p_type", "p_size"])
    t = M.fm_factors(dense, ["p_brand", "p_type", "p_size"], "log1p_n", factor_size=2, seed=1, maxIter=30)
    return M.attach_level_vectors(p, t, ["p_brand", "p_type", "p_size"])


@register("f23_reconstruction_error")
def q_f23(spark, d):
    """Per-row MSE/MAE of a 2-component PCA reconstruction of min-max data."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return M.reconstruction_error(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2,
                                  ["l_orderkey", "l_linenumber", "l_partkey"])


# ------------------------------------------------------------------ k-NN (exact, checked)

KNN_SQL = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
pr AS (SELECT a.vec_id AS q, b.vec_id AS n, b.label AS lab, list_distance(a.v, b.v) AS d
       FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, n) AS j FROM pr)"""


@register("f22_knn_distances", KNN_SQL + """
SELECT q AS vec_id, round(max(d) FILTER (WHERE j = 1), 6) AS d1, round(max(d) FILTER (WHERE j = 2), 6) AS d2,
       round(max(d) FILTER (WHERE j = 3), 6) AS d3 FROM r WHERE j <= 3 GROUP BY q
""")
def q_f22(spark, d):
    """Distance to the 1st..3rd nearest other embedding (exact, blocked)."""
    emb = table(spark, d, "embeddings")
    return N.knn_distances(emb, emb, "vec_id", "embedding", 3)


@register("m9_knn_vote_weighted", KNN_SQL + """,
v AS (SELECT q, lab, sum(1.0 / greatest(d, 1e-12)) AS v FROM r WHERE j <= 5 GROUP BY q, lab),
t AS (SELECT q, sum(v) AS tot, arg_min(lab, (-v, lab)) AS pred, arg_min(v, (-v, lab)) AS best FROM v GROUP BY q)
SELECT q AS vec_id, pred, round(best / tot, 6) AS vote_share FROM t
""")
def q_m9(spark, d):
    """Distance-weighted 5-NN class vote over all other embeddings."""
    emb = table(spark, d, "embeddings")
    return N.knn_vote(emb, emb, "vec_id", "embedding", "label", 5, weighted=True)


@register("r14_smote")
def q_r14(spark, d):
    """One synthetic embedding per row of class 3, between it and a keyed
    choice among its 5 nearest same-class neighbours."""
    emb = table(spark, d, "embeddings")
    return N.smote(emb, "vec_id", "embedding", "label", 3, k=5, seed=9)
