"""Exact k nearest neighbours (F22, M9, R14) by pivot cells and triangle-inequality pruning.

Sampled base rows are pivots; each base row belongs to the cell of its nearest pivot. The base is
written once to the shared folder, a file for each block of a cell. A task holds some queries and reads
the files: first those of each query's own cell, which bounds its k-th distance from
above by some r; then the cells that can hold a row within r: those where
its distance to the pivot, less the cell's radius, is at most r, and so is half the
amount by which that pivot is farther than the nearest one; r shrinks as cells are searched. All other cells are left out
without a distance being computed, and nothing is lost. Ties go by key.

No vector is copied for a visit: a base row is shuffled and written once, a query
shuffled once, whatever the numbers of cells and visits; on data without any geometry (hundreds of equal dimensions), bounds exclude
little and every cell is visited, still exactly, by reading. Tasks hold queries, base rows and distances
CHUNK numbers at a time. The shared folder must be one that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfold.functions.exprs import hash_unit, order_hash
from tabfold.session import cut_lineage, ensure_checkpoint_dir

NB_SCHEMA = "qkey long, nkey long, dist double"
MAX_PIVOTS = 4096  # bounds the pivot matrix that every task holds and the per-cell table on the driver
CHUNK = 1 << 21  # numbers of one array in a task (16 MB): distances, differences, copied vectors
TASK_ROWS = 2048  # queries of a task at least, unless there are fewer
SLACK = 1e-9  # relative widening of the bounds: far above rounding errors, so that no tie is lost


def _topk(qv: np.ndarray, qk: np.ndarray, bv: np.ndarray, bk: np.ndarray, k: int, exclude: np.ndarray, within: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the query, key, distance) of base rows among which the k nearest of every query
    are, if at most ``within`` away; base rows of a query's own key are left out where ``exclude`` says so.

    Squared distances come from one BLAS product (|q|^2 + |b|^2 - 2 q.b);
    every pair within a rounding margin of the k-th value is re-measured
    exactly as sqrt(sum((q - b)^2)), and the first k by distance and key
    are emitted: of ties no more than the merge can need. The margin (1e-9 of the squared
    norms) is far above the expansion's float error, so no true neighbour is
    lost."""
    qn, bn = (qv * qv).sum(axis=1), (bv * bv).sum(axis=1)
    step = max(1, CHUNK // bv.shape[0])  # rows of the squared-distance chunk
    pairs = max(1, CHUNK // max(1, bv.shape[1]))  # pairs re-measured at once
    for s in range(0, len(qv), step):
        qs, far = qv[s:s + step], within[s:s + step]
        d2 = qs @ bv.T
        d2 *= -2.0
        d2 += qn[s:s + step, None]
        d2 += bn[None, :]
        own = np.flatnonzero(exclude[s:s + step])
        if len(own):
            order = np.argsort(bk, kind="stable")
            first, last = (np.searchsorted(bk[order], qk[s + own], side) for side in ("left", "right"))
            n = last - first
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            d2[np.repeat(own, n), order[at]] = np.inf
        most = far * far
        if not np.isfinite(far).all():
            kk = min(k, d2.shape[1])
            most = np.fmin(most, np.partition(d2, kk - 1, axis=1)[:, kk - 1])
        margin = 1e-9 * (qn[s:s + step] + bn.max()) + 1e-12
        rows, cols = np.nonzero((d2 <= (most + margin)[:, None]) & np.isfinite(d2))
        if len(rows) == 0:
            continue
        exact = np.empty(len(rows))
        for at in range(0, len(rows), pairs):
            diff = qs[rows[at:at + pairs]] - bv[cols[at:at + pairs]]
            exact[at:at + pairs] = np.sqrt((diff * diff).sum(axis=1))
        # the first k of each row by (distance, key): the merge can need no others
        sel = _first_k(rows, exact, bk[cols], k)
        yield s + rows[sel], bk[cols[sel]], exact[sel]


def _first_k(rows: np.ndarray, dist: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Which are the first k of each row by distance and key, in that order."""
    order = np.lexsort((key, dist, rows))
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return order[place < k]


def _topk_fn(k: int, exclude_self: bool):
    """Exact top-k per query row (``_topk``) of one (query block, base block) pair."""
    def fn(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(b):
            qk = q["key"].to_numpy()
            qv, bv = (np.stack(x["vec"].to_numpy()).astype("float64") for x in (q, b))
            out = [(qk[rows], keys, dist) for rows, keys, dist in _topk(qv, qk, bv, b["key"].to_numpy(), k, np.full(len(q), exclude_self), np.full(len(q), np.inf))]
        if not out:
            return pd.DataFrame({"qkey": [], "nkey": [], "dist": []})
        qkey, nkey, dist = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"qkey": qkey.astype("int64"), "nkey": nkey.astype("int64"), "dist": dist.astype("float64")})

    return fn


def auto_block_rows(n: int) -> int:
    """Rows per cell and block: ~4 sqrt(n), within [500, 50,000]; at most what one task
    holds (two blocks of vectors)."""
    return int(min(50_000, max(500, math.ceil(4 * math.sqrt(max(n, 1))))))


def _vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, vec) of the rows that have a vector."""
    return df.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec")) \
        .where(F.col("vec").isNotNull())


def _narrow(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``_vectors`` as they are shuffled and written: floats stay floats, in half the bytes."""
    if dict(df.dtypes)[vec] != "array<float>":
        return _vectors(df, key, vec)
    return df.select(F.col(key).cast("long").alias("key"), F.col(vec).alias("vec")).where(F.col("vec").isNotNull())


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, keys, whether there is one) of a batch; no key is the least long."""
    vec, key = b.column("vec"), b.column("key")
    flat = vec.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = vec.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(vec), -1), key.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), key.is_valid().to_numpy(zero_copy_only=False)


def _distances(rows: pd.DataFrame, pivots: np.ndarray) -> np.ndarray:
    """Distances of a batch's vectors to all pivots."""
    v = np.stack(rows["vec"].to_numpy()).astype("float64")
    d2 = (v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (v @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _slices(batches: Iterator[pd.DataFrame], n_cells: int) -> Iterator[pd.DataFrame]:
    """Batches cut so that the distances to all pivots stay within CHUNK."""
    step = max(1, CHUNK // max(1, n_cells))
    for rows in batches:
        for at in range(0, len(rows), step):
            yield rows.iloc[at:at + step]


def _slack(pivots: np.ndarray, radius: np.ndarray) -> float:
    """Absolute widening for distances that come from a difference of squares: the
    root of a rounding error relative to the largest squared norm."""
    far = float(np.sqrt((pivots * pivots).sum(axis=1).max())) + float(radius.max())
    return 1e-7 * far + 1e-12


def _assigned(base: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Base rows with the number of their cell and the distance to its pivot."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _slices(batches, len(pivots)):
            d = _distances(rows, pivots)
            cell = d.argmin(axis=1)
            yield rows.assign(cell=cell.astype("int32"), far=d[np.arange(len(rows)), cell])
    return base.mapInPandas(run, "key long, vec array<double>, cell int, far double")


def _visits_fn(pivots: np.ndarray, radius: np.ndarray, n: np.ndarray, slack: float):
    """One copy of a query per cell that can hold a row within its bound. The copies of a
    batch are as many as its rows times the cells: at most CHUNK numbers leave at a time."""
    def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches, len(pivots)):
            d = _distances(part, pivots)
            within = part["within"].fillna(np.inf).to_numpy()[:, None] * (1 + SLACK) + 2 * slack
            lower = np.maximum(d - radius[None, :], (d - d.min(axis=1)[:, None]) / 2)
            row, cell = np.nonzero((lower <= within) & (n > 0)[None, :])
            key, vec = part["key"].to_numpy(), part["vec"].to_numpy()
            step = max(1, CHUNK // max(1, pivots.shape[1]))
            for at in range(0, len(row), step):
                some = row[at:at + step]
                yield pd.DataFrame({"key": key[some], "vec": vec[some], "cell": cell[at:at + step].astype("int32")})

    return visited


def _block_of(key: str, n: np.ndarray, cell: str, seed: str) -> F.Column:
    """Block of a row among its cell's ``n[cell]`` blocks, by a keyed hash."""
    blocks = F.element_at(F.array(*[F.lit(int(x)) for x in n]), F.col(cell) + 1)
    return F.least(F.floor(hash_unit(key, seed) * blocks).cast("int"), blocks - 1)


def _searched(q: DataFrame, b: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Candidates of all (cell, query block, base block) groups."""
    keys = ["cell", "qb", "bb"]
    return q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(_topk_fn(k, exclude_self), NB_SCHEMA)


def _pivots(b: DataFrame, block_rows: int | None) -> tuple[int, np.ndarray]:
    """(rows of a block, pivots): at most ``MAX_PIVOTS`` different vectors of base rows (key, vec), picked by hash."""
    nb = b.count()
    rows = block_rows or auto_block_rows(nb)
    n_cells = max(1, min(MAX_PIVOTS, math.ceil(nb / rows)))
    sample = b.withColumn("_o", order_hash("key", "knn-pivots")).orderBy("_o", "key").limit(n_cells).select("vec")
    return rows, np.unique(np.array([r.vec for r in sample.collect()], dtype="float64"), axis=0)


def knn_plan(query: DataFrame, base: DataFrame, key: str, vec: str, k: int, exclude_self: bool = True,
             block_rows: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Visits of the queries and the copies of base rows they meet: ``(key, vec, cell, qb, bb)``
    twice, and the number of cells. ``block_rows`` bounds a block (default: from the
    number of base rows). It shows which visits the bounds leave, with a copy of a vector for each: ``knn`` makes none."""
    q, b = _vectors(query, key, vec), _vectors(base, key, vec)
    rows, pivots = _pivots(b, block_rows)
    n_cells = len(pivots)
    if n_cells == 0:
        none = q.where("false").withColumns({c: F.lit(0) for c in ("cell", "qb", "bb")})
        return none, none, 0
    b = cut_lineage(_assigned(b, pivots))
    cells = {r.cell: r for r in b.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
    n = np.array([cells[c].n if c in cells else 0 for c in range(n_cells)])
    radius = np.array([cells[c].radius if c in cells else -np.inf for c in range(n_cells)])
    b_blocks = np.maximum(1, -(-n // rows))
    b = b.withColumn("bb", _block_of("key", b_blocks, "cell", "knn-b"))
    slack = _slack(pivots, np.maximum(radius, 0.0))
    if n_cells == 1:
        visits = q.withColumns({"cell": F.lit(0)})
    else:
        # an upper bound from one block of the nearest cell that has over k rows
        full = n > k

        def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in _slices(batches, n_cells):
                d = np.where(full[None, :], _distances(part, pivots), np.inf)
                cell = np.where(full.any(), d.argmin(axis=1), -1)
                yield part.assign(cell=cell.astype("int32"))

        home = q.mapInPandas(at_home, "key long, vec array<double>, cell int").where("cell >= 0")
        per_cell = {r["cell"]: r["count"] for r in home.groupBy("cell").count().collect()}
        home_blocks = np.array([max(1, -(-per_cell.get(c, 0) // rows)) for c in range(n_cells)])
        h = home.withColumns({"qb": _block_of("key", home_blocks, "cell", "knn-h"), "bb": F.lit(0)})
        h_base = b.where("bb = 0").withColumn("qb", F.explode(F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(int(x) - 1) for x in home_blocks]), F.col("cell") + 1))))
        near = _searched(h, h_base, k, exclude_self)
        w = Window.partitionBy("qkey").orderBy("dist", "nkey")
        bound = near.withColumn("j", F.row_number().over(w)).where(F.col("j") == k).select(F.col("qkey").alias("key"), F.col("dist").alias("within"))
        # several query rows may have one key: the widest bound serves them all
        bound = bound.groupBy("key").agg(F.max("within").alias("within"))
        bound = bound.join(q.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1"), "key").drop("_n")

        visits = q.join(bound, "key", "left").select("key", "vec", "within").mapInPandas(_visits_fn(pivots, radius, n, slack), "key long, vec array<double>, cell int")
    per_cell = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    q_blocks = np.array([max(1, -(-per_cell.get(c, 0) // rows)) for c in range(n_cells)])
    upto = lambda x: F.explode(F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(int(v) - 1) for v in x]), F.col("cell") + 1)))
    q_rep = visits.withColumn("qb", _block_of("key", q_blocks, "cell", "knn-q")).withColumn("bb", upto(b_blocks))
    b_rep = b.drop("far").withColumn("qb", upto(q_blocks))
    return q_rep, b_rep, n_cells


def _written_cells(base: DataFrame, pivots: np.ndarray, rows: int) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """(files, numbers of rows, radii) of the cells: base rows (key, vec) in the shared folder, a file for
    each block of about ``rows`` rows of a cell, so that no task and no file grows with a cell."""
    spark = base.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CHUNK // max(1, len(pivots)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                v = _arrays(b)[0]
                d2 = (v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (v @ pivots.T)
                cell = d2.argmin(axis=1)
                far = np.sqrt(np.maximum(d2[np.arange(len(v)), cell], 0.0))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("vec"), pa.array(cell.astype(np.int32)), pa.array(far)], names=["key", "vec", "cell", "far"])

    kind = dict(base.dtypes)["vec"]
    assigned = base.mapInArrow(run, f"key long, vec {kind}, cell int, far double")
    # large cells are known by a pass over their numbers alone
    some = {r["cell"]: r for r in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    n = np.array([some[c]["n"] if c in some else 0 for c in range(len(pivots))])
    radius = np.array([some[c]["far"] if c in some else -np.inf for c in range(len(pivots))])
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/knn-{uuid.uuid4().hex}"
    dealt = assigned.drop("far").withColumn("bb", _block_of("key", np.maximum(1, -(-n // rows)), "cell", "knn-b"))
    dealt.repartition("cell", "bb").write.partitionBy("cell", "bb").option("compression", "zstd").parquet(path)
    files: list[list[str]] = [[] for _ in range(len(pivots))]
    for f in sorted(spark.read.parquet(path).inputFiles()):
        files[int(re.search(r"/cell=(\d+)/", f).group(1))].append(f)
    return files, n, radius


def _read(path: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """A file of the shared folder, as seen by any task, ``rows`` rows at a time."""
    fs, p = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    with fs.open_input_file(p) as f:
        yield from pq.ParquetFile(f, pre_buffer=False).iter_batches(batch_size=rows, columns=columns, use_threads=False)


def _nearest_fn(k: int, exclude_self: bool, pivots: np.ndarray, radius: np.ndarray, n: np.ndarray, files: list[list[str]]):
    """The k nearest base rows of every query: (qkey, nkey, dist). Some queries are held at a time."""
    dims = pivots.shape[1]
    hold = max(1, CHUNK // max(1, dims, k))
    slack, pn, full = _slack(pivots, np.maximum(radius, 0.0)), (pivots * pivots).sum(axis=1), n > k

    def found(qv: np.ndarray, qk: np.ndarray, valid: np.ndarray) -> Iterator[pa.RecordBatch]:
        qn, exclude = (qv * qv).sum(axis=1), valid & exclude_self
        dist, key = np.full((len(qv), k), np.inf), np.zeros((len(qv), k), np.int64)

        def search(cell: int, who: np.ndarray) -> None:
            for file in files[cell]:
                for b in _read(file, ["key", "vec"], max(1, CHUNK // max(1, dims))):
                    bv, bk, _ = _arrays(b)
                    for rows, keys, d in _topk(qv[who], qk[who], bv, bk, k, exclude[who], dist[who, k - 1]):
                        rows = who[rows]
                        some = np.unique(rows)
                        r, at = np.nonzero(np.isfinite(dist[some]))
                        rows, d, keys = (np.concatenate(x) for x in ((some[r], rows), (dist[some[r], at], d), (key[some[r], at], keys)))
                        sel = _first_k(rows, d, keys, k)
                        rows = rows[sel]
                        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
                        dist[rows, place], key[rows, place] = d[sel], keys[sel]

        home, least = np.full(len(qv), -1), np.empty(len(qv))
        step = max(1, CHUNK // max(1, len(pivots)))
        for at in range(0, len(qv), step):
            d = np.sqrt(np.maximum(qn[at:at + step, None] + pn[None, :] - 2.0 * (qv[at:at + step] @ pivots.T), 0.0))
            least[at:at + step] = d.min(axis=1)
            if full.any():
                home[at:at + step] = np.where(full[None, :], d, np.inf).argmin(axis=1)
        for c in np.unique(home[home >= 0]).tolist():
            search(c, np.flatnonzero(home == c))
        for c in np.flatnonzero(n > 0).tolist():
            d = np.sqrt(np.maximum(qn + pn[c] - 2.0 * (qv @ pivots[c]), 0.0))
            lower = np.maximum(d - radius[c], (d - least) / 2)
            who = np.flatnonzero((home != c) & (lower <= dist[:, k - 1] * (1 + SLACK) + 2 * slack))
            if len(who):
                search(c, who)
        r, at = np.nonzero(np.isfinite(dist))
        yield pa.RecordBatch.from_arrays([pa.array(qk[r]), pa.array(key[r, at]), pa.array(dist[r, at])], names=["qkey", "nkey", "dist"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, hold):
                b = whole.slice(at, hold)
                if rows + b.num_rows > hold:
                    yield from found(*(np.concatenate(x) for x in zip(*held)))
                    held, rows = [], 0
                held.append(_arrays(b))
                rows += b.num_rows
        if rows:
            yield from found(*(np.concatenate(x) for x in zip(*held)))

    return run


def knn(query: DataFrame, base: DataFrame, key: str, vec: str, k: int, exclude_self: bool = True,
        block_rows: int | None = None) -> DataFrame:
    """F22 core: the k nearest base rows of every query row by Euclidean
    distance: ``(qkey, j, nkey, dist)``, j = 1..k, ties by neighbour key. The
    row itself is excluded by key (not by skipping rank 0). Rows without a vector
    are neither queries nor neighbours; keys are distinct in each table."""
    q, b = _narrow(query, key, vec), _narrow(base, key, vec)
    rows, pivots = _pivots(_vectors(base, key, vec), block_rows)
    if len(pivots):
        files, n, radius = _written_cells(b, pivots, rows)
        tasks = max(1, min(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(q.count() / TASK_ROWS)))
        cand = q.repartition(tasks, "key").mapInArrow(_nearest_fn(k, exclude_self, pivots, radius, n, files), NB_SCHEMA)
    else:
        cand = q.where("false").select(F.col("key").alias("qkey"), F.col("key").alias("nkey"), F.lit(0.0).alias("dist"))
    w = Window.partitionBy("qkey").orderBy("dist", "nkey")  # k rows per query
    return cand.withColumn("j", F.row_number().over(w)).where(F.col("j") <= k) \
        .select("qkey", "j", "nkey", "dist")


def knn_distances(query: DataFrame, base: DataFrame, key: str, vec: str, k: int, exclude_self: bool = True,
                  block_rows: int | None = None) -> DataFrame:
    """distance to the 1st..k-th nearest base row as columns ``d1..dk``."""
    nb = knn(query, base, key, vec, k, exclude_self, block_rows)
    return nb.groupBy("qkey").pivot("j", list(range(1, k + 1))).agg(F.first("dist")) \
        .select(F.col("qkey").alias(key), *[F.col(str(j)).alias(f"d{j}") for j in range(1, k + 1)])


def knn_vote(query: DataFrame, base: DataFrame, key: str, vec: str, label: str, k: int,
             weighted: bool = False, exclude_self: bool = True, block_rows: int | None = None) -> DataFrame:
    """M9: class by (distance-weighted) vote of the k nearest base rows; ties
    go to the smaller class. Also returns the share of votes for the winner."""
    nb = knn(query, base, key, vec, k, exclude_self, block_rows)
    lab = base.select(F.col(key).cast("long").alias("nkey"), F.col(label).alias("_lab"))
    w = (1.0 / F.greatest(F.col("dist"), F.lit(1e-12))) if weighted else F.lit(1.0)
    votes = nb.join(lab, "nkey").groupBy("qkey", "_lab").agg(F.sum(w).alias("_v"))
    tot = votes.groupBy("qkey").agg(F.sum("_v").alias("_t"),
                                    F.min_by(F.struct("_lab", "_v"), F.struct(-F.col("_v"), F.col("_lab"))).alias("_b"))
    return tot.select(F.col("qkey").alias(key), F.col("_b._lab").alias("pred"),
                      (F.col("_b._v") / F.col("_t")).alias("vote_share"))


def smote(df: DataFrame, key: str, vec: str, label: str, minority, k: int = 5, seed=0,
          block_rows: int | None = None) -> DataFrame:
    """One synthetic row per minority row: x + u * (neighbour - x), with
    the neighbour drawn among its k minority neighbours and u in [0, 1), both
    keyed by md5(key, seed)."""
    mino = df.where(F.col(label) == minority).select(key, vec)
    nb = knn(mino, mino, key, vec, k, True, block_rows)
    pick = (F.floor(hash_unit("qkey", f"{seed}:pick") * k) + 1).cast("int")
    chosen = nb.withColumn("_pick", pick).where(F.col("j") == F.least(F.col("_pick"), F.lit(k)))
    base = mino.select(F.col(key).cast("long").alias("qkey"), F.col(vec).cast("array<double>").alias("_x"))
    other = mino.select(F.col(key).cast("long").alias("nkey"), F.col(vec).cast("array<double>").alias("_n"))
    x = chosen.join(base, "qkey").join(other, "nkey").withColumn("_u", hash_unit("qkey", f"{seed}:u"))
    synth = F.zip_with(F.col("_x"), F.col("_n"), lambda a, b: a + F.col("_u") * (b - a))
    return x.select(F.col("qkey").alias("source_key"), synth.alias(vec), F.lit(minority).alias(label))
