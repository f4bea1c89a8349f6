"""Linear models of smooth losses with an elastic net (M2), trained by proximal Newton steps.

One pass over the rows gives the loss, its gradient and its curvature (a d x d matrix), each
summed per Arrow batch with NumPy, per task, and by Spark over the tasks. The elastic-net
problem of that quadratic model is small and solved on the driver by coordinate descent;
the next pass tries several step lengths at once. A handful of passes is enough, where
first-order steps would read the table hundreds of times. Driver and tasks hold
d x d numbers, d features: meant for up to a few thousand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.functions.exprs import as_list

STEPS = (1.0, 0.5, 0.25, 0.0625, 0.0)  # step lengths tried in one pass; 0 is the loss before the step


def _modified_huber(z):
    """Quadratic near the margin, linear far on the wrong side."""
    slope = np.where(z < -1, -4.0, np.where(z < 1, -2 * (1 - z), 0.0))
    return np.where(z < -1, -4 * z, np.maximum(0, 1 - z) ** 2), slope, np.where((z >= -1) & (z < 1), 2.0, 0.0)


def _squared_hinge(z):
    gap = np.maximum(0, 1 - z)
    return gap ** 2, -2 * gap, np.where(z < 1, 2.0, 0.0)


def _log(z):
    p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
    return np.logaddexp(0, -z), -p, p * (1 - p)


#: value, slope and curvature of each loss at the margin z = y f(x), y in {-1, 1}
LOSSES = {"modified_huber": _modified_huber, "squared_hinge": _squared_hinge, "log": _log}


@dataclass
class LinearModel:
    features: list[str]
    weights: np.ndarray
    intercept: float
    loss: str
    passes: int

    def decision(self) -> F.Column:
        """f(x) as a column expression; null where a feature is null."""
        out = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.weights):
            if w:
                out = out + F.col(c).cast("double") * F.lit(float(w))
        return out

    def probability(self) -> F.Column:
        """(clip(f, -1, 1) + 1) / 2 for modified Huber, the sigmoid of f for the others."""
        f = self.decision()
        if self.loss == "modified_huber":
            return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), f)) + 1) / 2
        return 1 / (1 + F.exp(-f))


def _pass(rows: DataFrame, d: int, loss: str, w: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Summed weighted losses at w + t step for the step lengths t, and gradient and curvature at
    the best t (index) of this pass's tasks: (losses, per t a flat [gradient, curvature])."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses, flat = np.zeros(len(STEPS)), np.zeros((len(STEPS), (d + 1) * (d + 2)))
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(d)] + [np.ones(b.num_rows)], axis=1)
            y, weight = (b.column(d + i).to_numpy(zero_copy_only=False) for i in range(2))
            base, move = x @ w, x @ step
            for i, t in enumerate(STEPS):
                value, slope, curve = LOSSES[loss](y * (base + t * move))
                losses[i] += weight @ value
                flat[i, :d + 1] += x.T @ (weight * slope * y)
                flat[i, d + 1:] += (x.T @ (x * (weight * curve)[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(STEPS) * (1 + flat.shape[1])), pa.int32()), pa.array(np.concatenate([losses, flat.ravel()]))], names=["i", "v"])

    # one row per number and task, summed before and after the shuffle: O(d^2) rows reach the driver
    sums = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(len(STEPS) * (1 + (d + 1) * (d + 2)))
    out[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
    return out[:len(STEPS)], list(out[len(STEPS):].reshape(len(STEPS), -1))


def _elastic_step(w: np.ndarray, g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The weights that minimise the quadratic model plus the elastic net, by coordinate
    descent; the last weight is the intercept and not penalised."""
    d = len(w) - 1
    h = h + 1e-9 * (np.trace(h) / len(w) + 1e-12) * np.eye(len(w))
    u, hu = w.copy(), np.zeros(len(w))  # hu = h (u - w)
    for _ in range(1000):
        most = 0.0
        for j in range(d + 1):
            grad = g[j] + hu[j]
            if j < d:
                raw = h[j, j] * u[j] - grad
                new = np.sign(raw) * max(abs(raw) - l1, 0.0) / (h[j, j] + l2)
            else:
                new = u[j] - grad / h[j, j]
            if new != u[j]:
                hu += h[:, j] * (new - u[j])
                most = max(most, abs(new - u[j]) * np.sqrt(h[j, j]))
                u[j] = new
        if most < 1e-12:
            break
    return u - w


def fit_linear(df: DataFrame, feats, y: str, loss: str = "modified_huber", alpha: float = 1e-4, l1_ratio: float = 0.15,
               weight: str | None = None, max_passes: int = 60, tol: float = 1e-8) -> LinearModel:
    """M2: minimise mean loss + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|_2^2 / 2) over a 0/1
    label, the mean weighted by ``weight``. Stops when the objective falls by less than
    ``tol`` times itself.

    Rows with a null label, weight or feature are left out (NaN features, too); no rows
    at all are an error; with one class only the intercept says so."""
    feats = as_list(feats)
    d, rows = len(feats), df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(feats)],
                                    (F.col(y).cast("double") * 2 - 1).alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    rows = rows.dropna()  # nulls and NaN
    total = rows.agg(F.sum("_w")).first()[0]
    if not total:
        raise ValueError("no rows with a label, features and weight")
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    w, step, before = np.zeros(d + 1), np.zeros(d + 1), np.inf
    for passes in range(1, max_passes + 1):
        losses, found = _pass(rows, d, loss, w, step)
        at = [w + t * step for t in STEPS]
        objective = [x / total + l1 * np.abs(v[:d]).sum() + l2 / 2 * (v[:d] ** 2).sum() for x, v in zip(losses, at)]
        best = int(np.argmin(objective))
        w, now = at[best], objective[best]
        if before - now < tol * max(abs(now), 1e-12) and passes > 1:
            break
        g, h = found[best][:d + 1] / total, found[best][d + 1:].reshape(d + 1, d + 1) / total
        step, before = _elastic_step(w, g, h, l1, l2), now
    return LinearModel(feats, w[:d], float(w[d]), loss, passes)
