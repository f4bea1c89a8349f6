"""Embedding near-dedup by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.llm.common import components, set_aside, stored
from tabfold.llm.simhash import Forest

OWN = ["n_links", "component_id", "kept"]
SAMPLE = 1 << 14  #: vectors that the codebooks are fitted on at most
QUERIES = 256  #: sampled vectors, compared with all rows, whose true links set the traversal's reach; four times as many if these are too few
LINKS = 1000  #: true links that the reach is taken from at least
PER_CELL = 32  #: vectors a grid cell holds on average
BLOCK = 2048  #: vectors of a cell that one task compares at once


def unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from ``k`` sampled rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (-2 * x @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def excess(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centre, less that to its nearest."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return d - d.min(axis=1)[:, None]


def cells_in_order(e1: np.ndarray, e2: np.ndarray, reach: float) -> list[int]:
    """Multi-sequence traversal: cells ``i * len(e2) + j`` of the product grid with
    ``e1[i] + e2[j] <= reach``, nearest first. Codewords are sorted by distance in
    each half; row by row, the far end moves in, so no cell beyond reach is touched
    more than once."""
    o1, o2 = np.argsort(e1, kind="stable"), np.argsort(e2, kind="stable")
    s2, found = e2[o2], []
    for i in o1:
        if e1[i] > reach:
            break
        n = np.searchsorted(s2, reach - e1[i], side="right")
        found += zip((e1[i] + s2[:n]).tolist(), (i * len(e2) + o2[:n]).tolist())
    return [c for _, c in sorted(found)]


class MultiIndex:
    """Two codebooks, one for each half of the vectors, and the traversal's reach."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 11):
        self.half = sample.shape[1] // 2
        self.books = codebook(sample[:, :self.half], k, seed), codebook(sample[:, self.half:], k, seed + 1)
        self.reach = float("inf")
        self.apart = 2.0  # distance of two vectors that link, at most

    def excesses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return excess(x[:, :self.half], self.books[0]), excess(x[:, self.half:], self.books[1])

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """Cells each vector visits, its own first."""
        return [cells_in_order(a, b, min(self.reach, r)) for a, b, r in zip(*self.excesses(x), self.farthest(x))]

    def farthest(self, x: np.ndarray) -> np.ndarray:
        """Reach at which each row visits the cells of all that it may link with. In a
        half, with d the distance of two rows and r that of one to its codeword, the
        other's codeword is at most 2 d + r away: an excess of 4 d (d + r)."""
        r2 = sum((((h * h).sum(axis=1)[:, None] - 2 * h @ b.T + (b * b).sum(axis=1)).min(axis=1)) for h, b in zip((x[:, :self.half], x[:, self.half:]), self.books))
        return 4 * self.apart * (self.apart + np.sqrt(np.maximum(r2, 0.0))) + 1e-6

    def needed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Reach at which rows of ``x`` visit the cells of the rows of ``y``."""
        (a1, a2), (b1, b2) = self.excesses(x), self.excesses(y)
        r = np.arange(len(x))
        return a1[r, b1.argmin(axis=1)] + a2[r, b2.argmin(axis=1)]


def fit_index(classes: DataFrame, threshold: float, recall: float) -> MultiIndex | None:
    """Codebooks from a sample of at most ``SAMPLE`` vectors of the commonest length over
    1, picked by hash; none if all are of one component. The reach is calibrated with
    sampled vectors that are compared with all vectors: their links' needed reach at
    quantile ``recall``. More are drawn from the sample until there are ``LINKS`` links;
    if there are too few, the reach is that of ``MultiIndex.farthest``, which loses none."""
    sizes = classes.where("dim > 1")
    most = sizes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if most is None:
        return None
    dim = most["dim"]
    largest = sizes.groupBy("label", "dim").count().agg(F.max("count")).first()[0]
    sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("rep", "label", "vector").toPandas()
    index = MultiIndex(unit(sample["vector"]), max(1, round((largest / PER_CELL) ** 0.5)))
    index.apart = max(0.0, 2 - 2 * threshold) ** 0.5

    def needs(asked: pd.DataFrame) -> DataFrame:
        q, q_label, q_rep = unit(asked["vector"]), asked["label"].to_numpy(), asked["rep"].to_numpy()

        def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x, label, rep = unit(b["vector"]), b["label"].to_numpy()[:, None], b["rep"].to_numpy()[:, None]
                for k in range(0, len(q), QUERIES):
                    s = slice(k, k + QUERIES)
                    i, j = np.nonzero((x @ q[s].T >= threshold) & (label == q_label[s]) & (rep != q_rep[s]))
                    if len(i):
                        # a pair is found if either side visits the other's cell
                        yield pd.DataFrame({"needed": np.minimum(index.needed(x[i], q[j + k]), index.needed(q[j + k], x[i]))})

        return classes.where(F.col("dim") == dim).select("rep", "label", "vector").mapInPandas(links, "needed double")

    n = QUERIES
    while True:
        found, reach = needs(sample.head(n)).agg(F.count("*"), F.percentile("needed", recall)).first()
        if found >= LINKS:
            index.reach = reach + 1e-6
        if found >= LINKS or n >= len(sample):
            return index
        n *= 4


def embedding_groups(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                     threshold: float = 0.93, recall: float = 0.995) -> DataFrame:
    """Each row of ``vectors`` with n_links, component_id and kept.

    Two vectors link if their labels are equal and their cosine, in double
    precision, is at least ``threshold``. Equal vectors of a label form one class
    before anything is compared, and count as linked. Each class lies in one cell
    of a grid of two independent codebooks; it visits the cells nearest to it, in
    multi-sequence order, up to the reach that found the share ``recall`` of the
    true links of sampled queries; every candidate is then verified. A task takes a
    block of at most ``BLOCK`` members of a cell against a block of its visitors and
    returns link counts and a spanning forest, never pairs. A pair that both sides
    find is counted once.

    component_id is the smallest key reachable over links, its own included; kept
    is true where it equals the key. Defined cases: null label, null or empty or zero
    vectors, and vectors with null or non-finite components link with nothing;
    vectors of different lengths do not link, and those of other than the commonest
    length over 1 are compared within one cell; rows with a null key link with
    nothing, have a null component_id and are kept; repeated rows each come back and
    count as links of one another; an empty table gives no rows; input columns named
    like the result's come back as ``<name>_in``.
    """
    vectors = set_aside(vectors, OWN)
    v = F.col(vector).cast("array<double>")
    norm = F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x * x)
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0) & (norm < float("inf")), F.lit(False))
    usable = whole & F.col(label).isNotNull() & F.col(key).isNotNull()
    marked = vectors.withColumn("_ok", usable).withColumn("_vector", F.when(usable, v))
    classes = (marked.where("_ok").groupBy(F.col(label).alias("label"), F.col("_vector").alias("vector"))
               .agg(F.min(F.col(key).cast("long")).alias("rep"), F.count("*").alias("times")))
    classes = stored(classes.withColumn("dim", F.size("vector")), "classes")
    linked = stored(cell_links(classes, fit_index(classes, threshold, recall), threshold), "links")
    counts = linked.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    group = components(linked.where("b is not null"))
    out = (classes.join(counts, classes.rep == counts.a, "left").join(group, classes.rep == group.node, "left")
           .select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("_n"), F.coalesce("component", "rep").alias("_c")))
    out = stored(out, "classes")
    joined = marked.join(out, F.col("_ok") & (marked[label] == out["label"]) & (F.col("_vector") == F.col("vector")), "left")
    return joined.select(*[marked[c] for c in vectors.columns], F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
                         F.coalesce("_c", marked[key].cast("long")).alias("component_id"),
                         F.coalesce(F.coalesce("_c", marked[key].cast("long")) == marked[key], F.lit(True)).alias("kept"))


def cell_links(classes: DataFrame, index: MultiIndex | None, threshold: float) -> DataFrame:
    """Links found through the index: (a, null, n) adds n links to class a, (a, b, 0)
    is an edge of a spanning forest."""
    dim = index.half + index.books[1].shape[1] if index else 0

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            same = (b["dim"] == dim).to_numpy()
            cells = np.full(len(b), None, object)
            for i, c in zip(np.flatnonzero(same), index.visits(unit(b["vector"][same])) if same.any() else []):
                cells[i] = c
            for i, d in zip(np.flatnonzero(~same), b["dim"][~same]):
                cells[i] = [-int(d)]
            yield b.assign(cells=cells)

    placed = classes.select("rep", "label", "vector", "times", "dim").mapInPandas(place, f"rep long, label {dict(classes.dtypes)['label']}, vector array<double>, times long, dim int, cells array<int>")
    placed = stored(placed, "placed").drop("dim")
    members = placed.select("label", F.col("cells")[0].alias("cell")).groupBy("label", "cell").count()
    visitors = placed.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").count()
    # only cells over one block: at most rows / BLOCK of them, times the cells a vector visits
    large = (visitors.withColumnRenamed("count", "v").join(members.withColumnRenamed("count", "m"), ["label", "cell"])
             .select("label", "cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("v") / BLOCK).cast("int").alias("vb")).where("mb > 1 or vb > 1"))
    m = placed.select("label", F.col("cells")[0].alias("cell"), "rep", "vector", "times", "cells", F.lit(0).alias("side")).join(large, ["label", "cell"], "left")
    q = placed.select("label", F.explode("cells").alias("cell"), "rep", "vector", "times", "cells", F.lit(1).alias("side")).join(large, ["label", "cell"], "left")
    one, mine = F.lit(1), lambda n: F.array(F.pmod(F.xxhash64("rep"), F.coalesce(n, F.lit(1))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.coalesce(n, one) - 1)
    m = m.withColumn("i", F.explode(mine("mb"))).withColumn("j", F.explode(every("vb")))
    q = q.withColumn("i", F.explode(every("mb"))).withColumn("j", F.explode(mine("vb")))
    tasks = m.unionByName(q).drop("mb", "vb")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        pm, pq = pdf[side == 0], pdf[side == 1]
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="Int64"), "n": pd.Series(dtype="int64")})
        if not len(pm) or not len(pq):
            return none
        xm, xq = unit(pm["vector"]), unit(pq["vector"])
        idm, idq, tm, tq = (p[c].to_numpy() for c in ("rep", "times") for p in (pm, pq))
        own, of = np.unique([c[0] for c in pq["cells"]], return_inverse=True)
        back = np.array([np.isin(own, c) for c in pm["cells"]]).reshape(len(pm), len(own))  # does the member visit the visitor's cell?
        ids, at = np.unique(np.concatenate([idm, idq]), return_inverse=True)
        at_m, at_q = at[:len(idm)], at[len(idm):]
        n, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for k in range(0, len(xq), 512):
            s = slice(k, k + 512)
            near = xm @ xq[s].T >= threshold
            near &= np.where(back[:, of[s]], idq[s] < idm[:, None], idq[s] != idm[:, None])
            i, j = np.nonzero(near)
            j += k
            np.add.at(n, at_m[i], tq[j])
            np.add.at(n, at_q[j], tm[i])
            forest.join(at_m[i], at_q[j])
        some, child = np.flatnonzero(n), np.flatnonzero(forest.up != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[np.concatenate([some, child])], "b": pd.array([None] * len(some) + ids[forest.up[child]].tolist(), "Int64"), "n": np.concatenate([n[some], np.zeros(len(child), np.int64)])})

    return tasks.groupBy("label", "cell", "i", "j").applyInPandas(verify, "a long, b long, n long")
