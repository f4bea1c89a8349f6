"""Training and scoring at the MLlib edge (M1-M18, F27, C9/C10, B11/B12,
X6, X9-X11, F19/F20, F23).

One interface: ``fit(kind, df, feats, y, weight=None, **params)`` returns a
``PipelineModel`` (VectorAssembler + estimator), ``score(model, df, key)``
returns ``(key, p)``. Fold loops run one distributed fit per fold over a
persisted feature table; their results are unioned, never collected.
"""

from __future__ import annotations

import itertools
import math
import random
import time

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as RG
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list, order_hash, safe_div
from tabfold.functions.ranking import hashed_rank
from tabfold.operators import evaluate as V
from tabfold.operators.joins import bounded
from tabfold.session import cut_lineage

PROBABILISTIC = {
    "logistic": C.LogisticRegression,       # M1
    "tree": C.DecisionTreeClassifier,        # M3
    "forest": C.RandomForestClassifier,      # M4
    "gbt": C.GBTClassifier,                  # M5
    "naive_bayes": C.NaiveBayes,             # M7
    "mlp": C.MultilayerPerceptronClassifier,  # M8
    "fm_classifier": C.FMClassifier,
}
MARGIN = {"linear_svm": C.LinearSVC}         # M2 (no probability: sigmoid of the margin)
REGRESSORS = {"gbt_regressor": RG.GBTRegressor, "forest_regressor": RG.RandomForestRegressor,  # M6
              "linear_regressor": RG.LinearRegression, "fm_regressor": RG.FMRegressor}
WEIGHTED = {"logistic", "tree", "forest", "gbt", "naive_bayes", "linear_svm", "gbt_regressor",
            "forest_regressor", "linear_regressor"}


def assemble(feats, out: str = "features") -> VectorAssembler:
    """numeric columns side by side in one vector (nulls must be imputed
    before: MLlib rejects them)."""
    return VectorAssembler(inputCols=as_list(feats), outputCol=out, handleInvalid="error")


def estimator(kind: str, y: str, weight: str | None = None, **params):
    cls = {**PROBABILISTIC, **MARGIN, **REGRESSORS}[kind]
    est = cls(featuresCol="features", labelCol=y, **params)
    if weight and kind in WEIGHTED:
        est = est.setWeightCol(weight)
    return est


def fit(kind: str, df: DataFrame, feats, y: str, weight: str | None = None, **params) -> PipelineModel:
    """Fit assembler + learner. The label is cast to double (MLlib label)."""
    data = df.withColumn(y, F.col(y).cast("double"))
    return Pipeline(stages=[assemble(feats), estimator(kind, y, weight, **params)]).fit(data)


def score(model: PipelineModel, df: DataFrame, key, out: str = "p") -> DataFrame:
    """``(key..., p)``; p = P(y=1) for probabilistic learners, the
    sigmoid of the margin for SVM, the clipped prediction for regressors."""
    last = model.stages[-1]
    x = model.transform(df)
    if "probability" in x.columns and not isinstance(last, C.LinearSVCModel):
        p = vector_to_array(F.col("probability"))[1]
    elif isinstance(last, C.LinearSVCModel):
        p = 1.0 / (1.0 + F.exp(-vector_to_array(F.col("rawPrediction"))[1]))
    else:
        p = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return x.select(*as_list(key), p.alias(out))


def written_once(df: DataFrame, cols, *named) -> DataFrame:
    """The named columns of a table that many fits or scorings read, checkpointed: joins and
    shuffles behind it run once, not once per pass. ``named``: parameter values, of which
    those that name a column (weights, validation marks) are kept, too."""
    more = [v for v in named if isinstance(v, str) and v in df.columns]
    return cut_lineage(df.select(*dict.fromkeys([*cols, *more])))


def logistic_params(c: float, n_rows: int, l1: bool = False) -> dict:
    """M1: sklearn-style inverse strength ``C`` as MLlib parameters:
    regParam = 1 / (C * n) (MLlib averages the loss over rows), elastic net 1
    for an L1 penalty, 0 for L2."""
    return {"regParam": 1.0 / (c * n_rows), "elasticNetParam": 1.0 if l1 else 0.0}


def save(model: PipelineModel, path: str) -> None:
    """S9."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel, feats) -> list[tuple[str, float]]:
    """Feature importances named from the assembler's input order (not zipped
    against another list)."""
    names = model.stages[0].getInputCols()
    imp = model.stages[-1].featureImportances.toArray()
    return list(zip(names, [float(v) for v in imp]))


# ------------------------------------------------------------------ CV / OOF

def cv_oof(kind: str, train: DataFrame, test: DataFrame | None, feats, y: str, key, fold: str = "fold",
           weight: str | None = None, cutoff: float = 0.5, parallelism: int = 3,
           **params) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """For each fold k: fit on fold != k, score fold k (out-of-fold)
    and the test rows. Returns (oof (key, fold, p), test (key, p = mean over
    folds), fold metrics (fold, auc, f1)). The training table's columns are written
    once (checkpoint, and persisted for the fits), the scores follow from it in a map step; up to ``parallelism`` fold fits run as concurrent Spark jobs (as
    ``CrossValidator(parallelism=...)`` does)."""
    from concurrent.futures import ThreadPoolExecutor

    keys = as_list(key)
    train = written_once(train, [*keys, y, fold, *as_list(feats)], weight, *params.values()).persist()
    folds = sorted(r[0] for r in train.select(fold).distinct().collect())  # k values
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        models = list(pool.map(lambda k: fit(kind, train.where(F.col(fold) != k), feats, y, weight, **params),
                               folds))
    oofs, tests = [], []
    for k, m in zip(folds, models):
        part = train.where(F.col(fold) == k)
        o = score(m, part, [*keys, y]).withColumn(fold, F.lit(k))
        oofs.append(o)
        if test is not None:
            tests.append(score(m, test, keys).withColumn(fold, F.lit(k)))
    oof = oofs[0]
    for o in oofs[1:]:
        oof = oof.unionByName(o)
    metrics = V.f1_at(oof, y, "p", cutoff, by=fold).select(fold, "f1") \
        .join(V.auc(oof, y, "p", by=fold), fold)
    test_scores = None
    if tests:
        t = tests[0]
        for o in tests[1:]:
            t = t.unionByName(o)
        test_scores = t.groupBy(*keys).agg(F.avg("p").alias("p"))
    train.unpersist()
    return oof.select(*keys, fold, y, "p"), test_scores, metrics


class CutoffF1(Evaluator):
    """F1 of class 1 of the decision ``p > cutoff``; ``"best"``: at the best
    cutoff of a grid from 0 to 1 by 0.01, chosen on the rows it is given."""

    def __init__(self, y: str, cutoff: float | str = 0.5):
        super().__init__()
        self.y, self.cutoff = y, cutoff

    def _evaluate(self, dataset: DataFrame) -> float:
        s = dataset.select(F.col(self.y).cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))
        if self.cutoff == "best":
            found = V.best_cutoff(V.sweep(s, "y", "p", 0.0, 0.01, 101))
        else:
            found = V.f1_at(s, "y", "p", self.cutoff)
        return float(found.first()["f1"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def _evaluator(y: str, metric: str, cutoff: float | str) -> Evaluator:
    return CutoffF1(y, cutoff) if metric == "f1" else BinaryClassificationEvaluator(labelCol=y)


def _search_scores(kind: str, data: DataFrame, y: str, names: list[str], points: list[dict], fold: str | None,
                   metric: str, cutoff: float | str, weight: str | None, parallelism: int,
                   train_ratio: float = 0.75, seed: int = 0) -> list[float]:
    """Metric of each parameter point over assembled rows: its mean over the folds of
    column ``fold``, or that of one split without it."""
    est = estimator(kind, y, weight)
    how = dict(estimator=est, estimatorParamMaps=[{est.getParam(n): p[n] for n in names} for p in points],
               evaluator=_evaluator(y, metric, cutoff), parallelism=parallelism)
    if fold is None:
        return TrainValidationSplit(trainRatio=train_ratio, seed=seed, **how).fit(data).validationMetrics
    k = data.select(fold).distinct().count()  # foldCol needs numFolds = number of folds
    return CrossValidator(foldCol=fold, numFolds=k, **how).fit(data.withColumn(fold, F.col(fold).cast("int"))).avgMetrics


def _search_data(df: DataFrame, feats, y: str, points: list[dict], fold: str | None, weight: str | None) -> DataFrame:
    """Assembled rows of a search, written once for all folds and points (a split at random
    depends on all columns, which are kept then)."""
    cols = df.columns if fold is None else [*as_list(feats), y, fold]
    data = written_once(df, cols, weight, *[v for p in points for v in p.values()])
    return assemble(feats).transform(data.withColumn(y, F.col(y).cast("double")))


def _search_table(df: DataFrame, names: list[str], points: list[dict], scores: list[float], metric: str) -> DataFrame:
    """One row per point, best first."""
    rows = [tuple([str(p[n]) for n in names] + [float(m)]) for p, m in zip(points, scores)]
    out = df.sparkSession.createDataFrame(rows, ", ".join([f"{n} string" for n in names] + [f"{metric} double"]))
    return out.orderBy(F.col(metric).desc(), *names)


def grid_search(kind: str, df: DataFrame, feats, y: str, grid: dict, fold: str = "fold", metric: str = "f1",
                cutoff: float | str = 0.5, weight: str | None = None, parallelism: int = 2) -> DataFrame:
    """Full Cartesian grid, k folds given by ``fold`` (no random split),
    metric f1 (class 1, of ``p > cutoff`` or at the best cutoff) or auc,
    optional class weights; one row per grid point, best first."""
    names = list(grid)
    points = [dict(zip(names, values)) for values in itertools.product(*grid.values())]
    data = _search_data(df, feats, y, points, fold, weight)
    scores = _search_scores(kind, data, y, names, points, fold, metric, cutoff, weight, parallelism)
    return _search_table(df, names, points, scores, metric)


def random_search(kind: str, df: DataFrame, feats, y: str, space: dict, n: int, seed: int = 0,
                  train_ratio: float = 0.75, metric: str = "auc", max_seconds: float | None = None,
                  fold: str | None = None, cutoff: float | str = 0.5, weight: str | None = None,
                  parallelism: int = 2) -> DataFrame:
    """``n`` random points of the parameter space (seeded), best first.
    With ``fold`` each point is scored over the given folds; else each is fit
    on a train part and scored on the rest. With ``max_seconds`` the points are
    tried one at a time, and none is started once the wall-clock budget is spent (the
    first always is). Folds, weight and cutoff hold on every path."""
    rnd = random.Random(seed)
    names = list(space)
    points = [{k: rnd.choice(v) for k, v in space.items()} for _ in range(n)]
    data = _search_data(df, feats, y, points, fold, weight)
    scores: list[float] = []
    start = time.monotonic()
    for some in [points] if max_seconds is None else [[p] for p in points]:
        if scores and time.monotonic() - start > max_seconds:
            break
        scores += _search_scores(kind, data, y, names, some, fold, metric, cutoff, weight, parallelism, train_ratio, seed)
    return _search_table(df, names, points, scores, metric)


def compare_learners(train: DataFrame, valid: DataFrame, feats, y: str, kinds: dict[str, dict],
                     key="key", cutoff: float = 0.5) -> DataFrame:
    """Fit several learners, table of AUC and F1 on the validation rows."""
    train = written_once(train, [*as_list(feats), y], *[v for params in kinds.values() for v in params.values()])
    valid = written_once(valid, [key, y, *as_list(feats)])
    out = None
    for name, params in kinds.items():
        kind = params.get("kind", name)
        m = fit(kind, train, feats, y, **{k: v for k, v in params.items() if k != "kind"})
        s = score(m, valid, [key, y])
        met = V.f1_at(s, y, "p", cutoff).select("f1").crossJoin(V.auc(s, y, "p")) \
            .withColumn("learner", F.lit(name))
        out = met if out is None else out.unionByName(met)
    return out.select("learner", "auc", "f1").orderBy(F.col("auc").desc(), "learner")


def best_rounds(df: DataFrame, feats, y: str, valid_col: str, max_iter: int = 50, **params) -> DataFrame:
    """Boosted trees with a validation indicator: the log-loss after each
    round on the validation rows, and the best round count (first minimum)."""
    df = written_once(df, [*as_list(feats), y, valid_col], *params.values())
    data = assemble(feats).transform(df.withColumn(y, F.col(y).cast("double")))
    est = C.GBTClassifier(featuresCol="features", labelCol=y, maxIter=max_iter, **params)
    model = est.fit(data.where(~F.col(valid_col)))
    losses = model.evaluateEachIteration(data.where(F.col(valid_col)))
    rows = [(i + 1, float(v)) for i, v in enumerate(losses)]
    best = min(rows, key=lambda r: (r[1], r[0]))[0]
    return df.sparkSession.createDataFrame(rows, "rounds int, valid_loss double") \
        .withColumn("is_best", F.col("rounds") == best)


def best_rounds_cv(df: DataFrame, feats, y: str, fold: str = "fold", max_iter: int = 50,
                   **params) -> tuple[DataFrame, PipelineModel]:
    """M17 over given folds: the mean validation loss after each round, the best
    round count (first minimum of the mean), and the learner refitted on all
    rows with it. Returns (round table, model)."""
    df = written_once(df, [*as_list(feats), y, fold], *params.values())
    data = assemble(feats).transform(df.withColumn(y, F.col(y).cast("double")))
    losses = []
    for k in sorted(r[fold] for r in df.select(fold).distinct().collect()):
        est = C.GBTClassifier(featuresCol="features", labelCol=y, maxIter=max_iter, **params)
        model = est.fit(data.where(F.col(fold) != k))
        losses.append(model.evaluateEachIteration(data.where(F.col(fold) == k)))
    mean = np.mean(losses, axis=0)
    best = int(mean.argmin()) + 1
    table = df.sparkSession.createDataFrame([(i + 1, float(v), i + 1 == best) for i, v in enumerate(mean)],
                                            "rounds int, valid_loss double, is_best boolean")
    return table, fit("gbt", df, feats, y, maxIter=best, **params)


# ------------------------------------------------------------------ selection by model

def select_by_importance(model: PipelineModel, feats, min_importance: float = 1e-6) -> list[str]:
    """Features whose importance exceeds ``min_importance``."""
    return [n for n, v in importances(model, feats) if v > min_importance]


def importance_table(models: list[PipelineModel], feats, spark) -> DataFrame:
    """X11: importance per feature, mean over fold models, percent of total (null where no
    model has a split, as all importances are 0 then)."""
    acc: dict[str, list[float]] = {}
    for m in models:
        for n, v in importances(m, feats):
            acc.setdefault(n, []).append(v)
    rows = [(n, float(np.mean(v))) for n, v in acc.items()]
    t = spark.createDataFrame(rows, "feature string, importance double")
    tot = t.agg(F.sum("importance").alias("_t"))
    return t.crossJoin(tot).select("feature", "importance",
                                   safe_div(F.col("importance") * 100, F.col("_t")).alias("pct")) \
        .orderBy(F.col("importance").desc(), "feature")


def forward_select(kind: str, train: DataFrame, valid: DataFrame, ordered_feats: list[str], y: str,
                   key="key", cutoff: float = 0.5, **params) -> DataFrame:
    """Add features in the given (importance) order; keep one only if the
    validation F1 rises. One fit per candidate."""
    train = written_once(train, [*as_list(ordered_feats), y], *params.values())
    valid = written_once(valid, [key, y, *as_list(ordered_feats)])
    kept: list[str] = []
    best = -1.0
    rows = []
    for f in ordered_feats:
        cand = kept + [f]
        m = fit(kind, train, cand, y, **params)
        f1 = V.f1_at(score(m, valid, [key, y]), y, "p", cutoff).first()["f1"]
        keep = f1 > best
        if keep:
            kept, best = cand, f1
        rows.append((f, float(f1), bool(keep)))
    return train.sparkSession.createDataFrame(rows, "feature string, f1 double, kept boolean")


def permute_columns(df: DataFrame, cols, key: str, seed) -> DataFrame:
    """Keyed permutation of columns, as ``_perm_<column>`` beside the old ones: the row at
    md5-rank r receives the values of the row at rank r in a second md5 order (an
    equi-join on rank). The orders depend on the key alone, so one join serves all columns."""
    cols = as_list(cols)
    a = hashed_rank(df.withColumn("_h", order_hash(key, f"{seed}:a")), "_h", tiebreak=key, out="_r").drop("_h")
    b = hashed_rank(df.select(*dict.fromkeys([key, *cols])).withColumn("_h", order_hash(key, f"{seed}:b")), "_h",
                    tiebreak=key, out="_r").select("_r", *[F.col(c).alias(f"_perm_{c}") for c in cols])
    return a.join(b, "_r").drop("_r")


def permute_column(df: DataFrame, col: str, key: str, seed) -> DataFrame:
    """``permute_columns`` of one column, in its place."""
    return permute_columns(df, [col], key, seed).drop(col).withColumnRenamed(f"_perm_{col}", col)


def permutation_importance(model: PipelineModel, df: DataFrame, feats, y: str, key: str, seed=0) -> DataFrame:
    """AUC drop after permuting each column (keyed permutation, joined once for all)."""
    feats = as_list(feats)
    df = cut_lineage(df)  # the join reads it twice
    both = cut_lineage(permute_columns(df, feats, key, seed))
    base = V.auc(score(model, df, [key, y]), y, "p").first()["auc"]
    rows = []
    for f in feats:
        pa = V.auc(score(model, both.withColumn(f, F.col(f"_perm_{f}")), [key, y]), y, "p").first()["auc"]
        rows.append((f, float(base), float(pa), float(base - pa)))
    return df.sparkSession.createDataFrame(rows, "feature string, auc double, auc_permuted double, drop double") \
        .orderBy(F.col("drop").desc(), "feature")


# ------------------------------------------------------------------ imputation by model

def level_codes(df: DataFrame, col: str, max_levels: int = 1000) -> DataFrame:
    """(level, code) of a column's non-null levels, the most frequent first (ties by
    level): class labels of a forest. Over ``max_levels`` levels are an error, which
    bounds the table and the class counts of every tree node."""
    counts = cut_lineage(df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("level")).agg(F.count(F.lit(1)).alias("n")))
    if counts.limit(max_levels + 1).count() > max_levels:
        raise ValueError(f"{col} has over {max_levels} levels")
    rows = sorted(counts.collect(), key=lambda r: (-r.n, r.level))
    schema = f"level {counts.schema['level'].dataType.simpleString()}, code double"
    return df.sparkSession.createDataFrame([(r.level, float(i)) for i, r in enumerate(rows)], schema)


def with_codes(df: DataFrame, codes: DataFrame, col: str, out: str) -> DataFrame:
    """The code of each row's level in column ``out`` (null where it has none)."""
    return df.join(F.broadcast(codes.withColumnRenamed("code", out)), F.col(col) == F.col("level"), "left").drop("level")


def with_levels(df: DataFrame, codes: DataFrame, code: str, out: str) -> DataFrame:
    """The level of each row's code in column ``out``."""
    return df.join(F.broadcast(codes.select(F.col("level").alias(out), F.col("code").alias("_code_of"))), F.col(code) == F.col("_code_of"), "left").drop("_code_of")


def fill_by_model(df: DataFrame, target: str, feats, kind: str | None = None, round_values: bool = True,
                  **params) -> DataFrame:
    """Learn ``target`` from the other columns on complete rows, predict
    it where missing. A text target is learnt by a classifier (default: a forest), its
    most probable level filled in; a number by a regressor, rounded for integer
    columns. A column without any value is left as it is."""
    t = dict(df.dtypes)[target]
    complete, lacking = df.where(F.col(target).isNotNull()), df.where(F.col(target).isNull())
    if complete.isEmpty():
        return df
    if t == "string":
        codes = level_codes(complete, target)
        m = fit(kind or "forest", with_codes(complete, codes, target, "_y"), feats, "_y", **params)
        pred = with_levels(m.transform(lacking), codes, "prediction", "_pred")
    else:
        m = fit(kind or "forest_regressor", complete, feats, target, **params)
        pred = m.transform(lacking).withColumn("_pred", F.round("prediction") if round_values else F.col("prediction"))
    filled = pred.select(*[F.col(c) if c != target else F.col("_pred").cast(t).alias(target) for c in df.columns])
    return complete.unionByName(filled)


def forest_impute_mixed(df: DataFrame, numeric, categorical, max_iter: int = 10, max_levels: int = 1000,
                        **params) -> DataFrame:
    """C10 for numbers and text in one call: iterated forests over both kinds.

    Starts from means and most frequent levels; each round refits the columns, those
    that lack the fewest values first, regressors for numbers and classifiers for
    text, on all the other columns as they are by then, and replaces the values that
    were missing. Stops when the change has risen for every kind that is imputed: squared
    change over squared values for numbers, the share of changed levels for text. The
    round before that is the result; at most ``max_iter`` rounds.

    Other columns are kept. A column without any value stays as it is and is no
    predictor; NaN counts as missing; nothing missing, or no rows: the input. A text
    predictor enters as its frequency code. Integer columns are rounded back."""
    numeric, categorical = as_list(numeric), as_list(categorical)
    types = dict(df.dtypes)
    clean = df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric})
    seen = clean.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in numeric + categorical],
                     *[F.avg(c).alias(f"_avg_{c}") for c in numeric]).first()
    numeric, categorical = ([c for c in cols if seen[c]] for cols in (numeric, categorical))
    todo = sorted((c for c in numeric + categorical if seen[c] < seen["_n"]), key=lambda c: (-seen[c], c))
    if not todo:
        return df
    codes = {c: level_codes(clean, c, max_levels) for c in categorical}
    cur = clean.withColumns({f"_miss_{c}": F.col(c).isNull() for c in todo})
    for c in categorical:
        cur = with_codes(cur, codes[c], c, f"_x_{c}").fillna({f"_x_{c}": 0.0})
    cur = cur.withColumns({f"_x_{c}": F.coalesce(F.col(c), F.lit(seen[f"_avg_{c}"])) for c in numeric})
    cur = cut_lineage(cur)
    every, kinds = numeric + categorical, [k for k in (numeric, categorical) if any(c in todo for c in k)]
    last = [math.inf] * len(kinds)
    for _ in range(max_iter):
        new = cur.withColumns({f"_old_{c}": F.col(f"_x_{c}") for c in todo})
        for c in todo:
            kind = "forest_regressor" if c in numeric else "forest"
            others = [f"_x_{o}" for o in every if o != c]
            if not others:
                continue
            m = fit(kind, new.where(~F.col(f"_miss_{c}")), others, f"_x_{c}", **params)
            new = m.transform(new).withColumn(f"_x_{c}", F.when(F.col(f"_miss_{c}"), F.col("prediction")).otherwise(F.col(f"_x_{c}"))) \
                .drop("features", "rawPrediction", "probability", "prediction")
        new = cut_lineage(new)
        x, old, miss = (lambda c: F.col(f"_x_{c}")), (lambda c: F.col(f"_old_{c}")), (lambda c: F.col(f"_miss_{c}"))
        parts = new.agg(*[F.sum(F.when(miss(c), (x(c) - old(c)) ** 2 if c in numeric else (x(c) != old(c)).cast("double"))).alias(f"d_{c}") for c in todo],
                        *[F.sum(F.when(miss(c), x(c) ** 2 if c in numeric else F.lit(1.0))).alias(f"s_{c}") for c in todo]).first()
        change = [sum(parts[f"d_{c}"] for c in k if c in todo) / max(sum(parts[f"s_{c}"] for c in k if c in todo), 1e-300) for k in kinds]
        if all(a > b for a, b in zip(change, last)):
            break
        cur, last = new.drop(*[f"_old_{c}" for c in todo]), change
        if not any(change):
            break
    for c in [c for c in categorical if c in todo]:
        cur = with_levels(cur, codes[c], f"_x_{c}", f"_level_{c}")
    back = {c: (F.round(f"_x_{c}") if types[c] in ("tinyint", "smallint", "int", "bigint") else F.col(f"_x_{c}")) if c in numeric else F.col(f"_level_{c}") for c in todo}
    return cur.select(*[F.when(F.col(f"_miss_{c}"), back[c]).otherwise(F.col(c)).cast(types[c]).alias(c) if c in back else F.col(c).cast(types[c]).alias(c) for c in df.columns])


def forest_impute(df: DataFrame, cols, feats, key: str, max_iter: int = 3, tol: float = 1e-3,
                  **params) -> DataFrame:
    """Iterative forest imputation: start from column means, then refit
    each column on the others for up to ``max_iter`` rounds, cutting lineage
    (reliable checkpoint) after every round; stop when the mean absolute
    change of imputed values falls below ``tol``. A column without any value stays as it is
    and is no predictor; ``forest_impute_mixed`` takes text columns, too."""
    cols = as_list(cols)
    seen = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    cols = [c for c in cols if seen[c]]
    if not cols:
        return df
    miss = df.select("*", *[F.col(c).isNull().alias(f"_miss_{c}") for c in cols])
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    cur = miss.fillna({c: float(means[c]) for c in cols})
    cur = cur.withColumns({c: F.col(c).cast("double") for c in cols})
    cur = cut_lineage(cur)
    for _ in range(max_iter):
        prev = cur
        for c in cols:
            others = [f for f in as_list(feats) if f != c] + [o for o in cols if o != c]
            m = fit("forest_regressor", cur.where(~F.col(f"_miss_{c}")), others, c, **params)
            cur = m.transform(cur).withColumn(c, F.when(F.col(f"_miss_{c}"), F.col("prediction"))
                                              .otherwise(F.col(c))).drop("features", "prediction")
        cur = cut_lineage(cur)
        change = prev.alias("a").join(cur.alias("b"), key) \
            .agg(*[F.avg(F.when(F.col(f"a._miss_{c}"), F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")))).alias(c)
                   for c in cols]).first()
        if all((change[c] or 0.0) < tol for c in cols):
            break
    return cur.drop(*[f"_miss_{c}" for c in cols])


# ------------------------------------------------------------------ boosting, discriminants

def adaboost(df: DataFrame, feats, y: str, key: str, rounds: int = 10, rate: float = 1.0,
             max_depth: int = 1) -> tuple[list[tuple[PipelineModel, float]], DataFrame]:
    """Discrete AdaBoost (SAMME, two classes) with weighted stumps. Each
    round: weighted tree fit, weighted error, alpha, weights updated by a
    column expression; lineage is cut every round."""
    cur = cut_lineage(df.withColumn("_w", F.lit(1.0)))
    ensemble = []
    for _ in range(rounds):
        m = fit("tree", cur, feats, y, weight="_w", maxDepth=max_depth)
        pr = m.transform(cur).withColumn("_miss", (F.col("prediction") != F.col(y).cast("double")).cast("double"))
        err = pr.agg((F.sum(F.col("_w") * F.col("_miss")) / F.sum("_w")).alias("e")).first()["e"]
        err = min(max(err, 1e-10), 1 - 1e-10)
        if err >= 0.5:
            break
        alpha = rate * math.log((1 - err) / err)
        ensemble.append((m, alpha))
        cur = cut_lineage(pr.select(*df.columns, (F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss"))).alias("_w")))
    return ensemble, cur


def adaboost_score(ensemble, df: DataFrame, key: str) -> DataFrame:
    """Score = sigmoid(2 * sum alpha * (2 * pred - 1) / sum alpha); the
    rounds are applied one after another to the same rows (no joins)."""
    tot = sum(a for _, a in ensemble) or 1.0
    out = df.withColumn("_s", F.lit(0.0))
    for m, a in ensemble:
        out = m.transform(out).withColumn("_s", F.col("_s") + F.lit(a) * (2 * F.col("prediction") - 1)) \
            .drop("features", "prediction", "rawPrediction", "probability")
    return out.select(key, (1 / (1 + F.exp(-2 * F.col("_s") / tot))).alias("p"))


def fit_discriminant(df: DataFrame, feats, y: str, quadratic: bool = False) -> dict:
    """Class priors, means and covariances from one grouped aggregation
    (means and centred covariances per class); the d x d algebra runs on the small
    result. LDA pools the covariance; QDA keeps one per class."""
    feats = as_list(feats)
    d = len(feats)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(F.col(f).cast("double")).alias(f"m_{i}") for i, f in enumerate(feats)]
    aggs += [F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"x_{i}_{j}")
             for i, a in enumerate(feats) for j, b in enumerate(feats) if j >= i]
    rows = {int(r[y]): r for r in df.groupBy(y).agg(*aggs).collect()}  # one row per class
    stats = {}
    for k, r in rows.items():
        n = r["n"]
        mu = np.array([r[f"m_{i}"] for i in range(d)])
        cov = np.array([[r[f"x_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        stats[k] = (n, mu, cov)
    ntot = sum(s[0] for s in stats.values())
    if not quadratic:
        pooled = sum((s[0] - 1) * s[2] for s in stats.values()) / (ntot - len(stats))
        inv = np.linalg.pinv(pooled)
        w = inv @ (stats[1][1] - stats[0][1])
        b = -0.5 * (stats[1][1] @ inv @ stats[1][1] - stats[0][1] @ inv @ stats[0][1]) + \
            math.log(stats[1][0] / stats[0][0])
        return {"feats": feats, "kind": "lda", "w": w, "b": b}
    parts = {}
    for k, (n, mu, cov) in stats.items():
        inv = np.linalg.pinv(cov)
        sign, logdet = np.linalg.slogdet(cov)
        parts[k] = (mu, inv, logdet, math.log(n / ntot))
    return {"feats": feats, "kind": "qda", "parts": parts}


def discriminant_score(model: dict, df: DataFrame, key) -> DataFrame:
    """P(y=1|x) as a column expression (linear for LDA, quadratic for QDA)."""
    xs = [F.col(f).cast("double") for f in model["feats"]]
    if model["kind"] == "lda":
        z = F.lit(float(model["b"]))
        for wi, xi in zip(model["w"], xs):
            z = z + F.lit(float(wi)) * xi
    else:
        def delta(k):
            mu, inv, logdet, lp = model["parts"][k]
            q = F.lit(0.0)
            for i in range(len(xs)):
                for j in range(len(xs)):
                    q = q + F.lit(float(inv[i, j])) * (xs[i] - float(mu[i])) * (xs[j] - float(mu[j]))
            return F.lit(-0.5 * logdet + lp) - 0.5 * q
        z = delta(1) - delta(0)
    return df.select(*as_list(key), (1 / (1 + F.exp(-z))).alias("p"))


# ------------------------------------------------------------------ stacking

def _one_column_per_model(long: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """Scores of the models side by side. One aggregate, so that a key's rows of one map task
    leave it as one row (``pivot`` moves a row per model, then a row per key again)."""
    return long.groupBy(*keys).agg(*[F.first(F.when(F.col("model") == m, F.col("p")), ignorenulls=True).alias(m) for m in models])


def stack(oof_long: DataFrame, test_long: DataFrame, models: list[str], y: str, key: str = "key",
          fold: str = "fold", kind: str = "logistic", **params) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Turn base-model OOF scores into one column per model (joined
    by key, not by position), then cross-validate a level-2 learner on them.
    Feeding the result back in gives the next level."""
    wide = _one_column_per_model(oof_long, [key, y, fold], models)
    test = _one_column_per_model(test_long, [key], models) if test_long is not None else None
    return cv_oof(kind, wide, test, models, y, key, fold=fold, **params)


# ------------------------------------------------------------------ FM factors, PCA error

def fm_factors(df: DataFrame, keys, target: str, factor_size: int = 2, seed: int = 0, **params) -> DataFrame:
    """one-hot the keys, fit a factorisation machine to ``target``, read
    back per level: bias (linear weight) and ``factor_size`` factors.
    Returns ``(key, level, bias, f0, f1, ...)``."""
    keys = as_list(keys)
    indexer = StringIndexer(inputCols=keys, outputCols=[f"_i_{k}" for k in keys], stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"_i_{k}" for k in keys], outputCols=[f"_h_{k}" for k in keys], dropLast=False)
    x = df.select(F.col(target).cast("double").alias(target), *[F.col(k).cast("string").alias(k) for k in keys])
    indexed = indexer.fit(x)
    x = hot.fit(indexed.transform(x)).transform(indexed.transform(x))
    m = fit("fm_regressor", x, [f"_h_{k}" for k in keys], target, factorSize=factor_size, seed=seed, **params)
    fm = m.stages[-1]
    lin = fm.linear.toArray()
    fac = fm.factors.toArray()
    names = [(k, v) for k, labels in zip(keys, indexed.labelsArray) for v in labels]
    rows = [(k, v, float(lin[i]), *[float(fac[i, j]) for j in range(factor_size)])
            for i, (k, v) in enumerate(names)]
    schema = "key string, level string, bias double, " + ", ".join(f"f{j} double" for j in range(factor_size))
    return df.sparkSession.createDataFrame(rows, schema)


def attach_level_vectors(df: DataFrame, table: DataFrame, keys) -> DataFrame:
    """join each key's level vector (bias and factors) onto the rows."""
    out = df
    for k in as_list(keys):
        t = table.where(F.col("key") == k).drop("key")
        t = t.select(F.col("level").alias(f"_{k}_lvl"), *[F.col(c).alias(f"{k}_{c}") for c in t.columns if c != "level"])
        t = bounded(t)
        out = out.join(t, out[k].cast("string") == F.col(f"_{k}_lvl"), "left").drop(f"_{k}_lvl")
    return out


def reconstruction_error(df: DataFrame, feats, k: int, key) -> DataFrame:
    """F23 (re-aimed from an autoencoder to PCA): min-max scale, centre,
    project on k principal components, back-project, per-row MSE and MAE.
    The d x k component matrix is small; projection is column arithmetic."""
    feats = as_list(feats)
    mm = df.agg(*[F.min(f).alias(f"mn_{f}") for f in feats], *[F.max(f).alias(f"mx_{f}") for f in feats]).first()
    scaled = df.select(*as_list(key), *[((F.col(f) - mm[f"mn_{f}"]) /
                                         F.lit((mm[f"mx_{f}"] - mm[f"mn_{f}"]) or 1.0)).alias(f) for f in feats])
    mu = scaled.agg(*[F.avg(f).alias(f) for f in feats]).first()
    centred = scaled.select(*as_list(key), *[(F.col(f) - F.lit(mu[f])).alias(f) for f in feats])
    pca = PCA(k=k, inputCol="features", outputCol="pcs").fit(assemble(feats).transform(centred))
    P = pca.pc.toArray()  # d x k
    proj = [sum(F.col(f) * float(P[i, j]) for i, f in enumerate(feats)) for j in range(k)]
    x = centred.select("*", *[p.alias(f"_z{j}") for j, p in enumerate(proj)])
    err = [F.col(f) - sum(F.col(f"_z{j}") * float(P[i, j]) for j in range(k)) for i, f in enumerate(feats)]
    return x.select(*as_list(key), (sum(e * e for e in err) / len(feats)).alias("mse"),
                    (sum(F.abs(e) for e in err) / len(feats)).alias("mae"))
