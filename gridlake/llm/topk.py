"""Exact top-k inner products by pivot-table elimination (operator 4).

Inner products become distances: with ``M`` the greatest norm, a candidate ``v`` gets the extra component
``sqrt(M^2 - |v|^2)`` and a query 0, so that ``d(q, v)^2 = |q|^2 + M^2 - 2 q.v``. Distances of all rows to
``PIVOTS`` pivots (a bounded sample of the candidates) are computed once; the triangle inequality gives
``d(q, v) >= max over pivots |d(q, p) - d(v, p)|`` and so an upper bound of the score. A query evaluates its
candidates in bound order and stops when the next bound is below its k-th score, which is exact.

Candidates lie in cells of about ``CELL`` rows, each in one task once; queries stream past every cell in
chunks, and the k best per cell are merged. The bounds are widened by far more than rounding can shift.

Cases: unusable vectors (null, empty, null or non-finite component) take no part; only vectors of one length meet; rows of the
query's own id are not its candidates; repeated query rows count once, repeated candidate ids once per
distinct vector; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import sorted_runs
from gridlake.llm.vectors import finite
from gridlake.session import materialise

PIVOTS = 64
CELL = 8192
CHUNK = 256


def _distances(rows: np.ndarray, last: np.ndarray, pivots: np.ndarray, pivot_last: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * rows @ pivots.T + (last[:, None] - pivot_last[None, :]) ** 2
    return np.sqrt(np.maximum(square, 0.0))


class _Cell:
    """The candidates of a cell with their pivot table."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray, greatest: float):
        self.ids, self.rows, self.greatest = ids, rows, greatest
        own = rows.astype(float)
        self.pivots = pivots.astype(float)
        self.pivot_last = np.sqrt(np.maximum(greatest - (self.pivots**2).sum(1), 0.0))
        self.table = _distances(own, np.sqrt(np.maximum(greatest - (own**2).sum(1), 0.0)), self.pivots, self.pivot_last)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        q = queries.astype(float)
        to = _distances(q, np.zeros(len(q)), self.pivots, self.pivot_last)
        lower = np.zeros((len(q), len(self.ids)))
        for p in range(len(self.pivots)):
            np.maximum(lower, np.abs(to[:, p, None] - self.table[None, :, p]), out=lower)
        joint = (q**2).sum(1)[:, None] + self.greatest
        return (joint - np.maximum(lower - 1e-6 * np.sqrt(joint), 0.0) ** 2) / 2 + 1e-9 * joint + 1e-3

    def best(self, query_id: int, query: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-bound, kind="stable")
        order = order[self.ids[order] != query_id]
        ids, scores, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 64
        while at < len(order) and (len(ids) < k or bound[order[at]] >= scores[-1]):
            part = order[at : at + step]
            ids, scores = np.concatenate([ids, self.ids[part]]), np.concatenate([scores, self.rows[part] @ query])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores, at, step = ids[top], scores[top], at + step, min(step * 2, 2048)
        return ids, scores


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``vec_id, ints`` rows (``ints``: array<bigint>) of both sides."""
    spark = candidates.sparkSession
    rows = materialise(candidates.select("vec_id", "ints").distinct(), "candidates")
    asked = queries.select("vec_id", "ints").distinct()
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("ints", F.lit(0).cast("bigint"), lambda a, x: a + x * x)).alias("m")).first()
    n, greatest = shape["n"], float(shape["m"] or 0)
    picked = [r["ints"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "ints").limit(pivots).collect()]
    shared = spark.sparkContext.broadcast(picked)
    cells = max(1, -(-n // cell))
    own = rows.select(F.xxhash64(F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("long"), F.size("ints")).alias("cell"), F.lit(-1).cast("long").alias("part"), "vec_id", "ints")
    # a chunk holds about `chunk` queries whatever their number
    chunks = max(1, -(-asked.count() // chunk))
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("c"), "vec_id", "ints").select(
        F.xxhash64(F.col("c").cast("long"), F.size("ints")).alias("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("long").alias("part"), "vec_id", "ints")
    both = own.unionByName(every).repartition("cell").sortWithinPartitions("cell", "part").withColumn("run", F.xxhash64("cell", "part"))

    def over(batches):
        held, number = None, None
        for run in sorted_runs(batches, "run"):
            ids, matrix = run["vec_id"].to_numpy(), np.array(run["ints"].tolist(), np.int64)
            if run["part"].iloc[0] < 0:
                fit = np.array([p for p in shared.value if len(p) == matrix.shape[1]], np.int64).reshape(-1, matrix.shape[1])
                held, number = _Cell(ids, matrix, fit, greatest), run["cell"].iloc[0]
            elif held is not None and run["cell"].iloc[0] == number:
                bounds, out = held.bounds(matrix), []
                for q, query, bound in zip(ids, matrix, bounds, strict=True):
                    found, scores = held.best(q, query, bound, k)
                    out.append(pd.DataFrame({"query_id": q, "vec_id": found, "score": scores}))
                yield pd.concat(out)

    best = both.mapInPandas(over, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def as_integers(column: str, scale: int = 256) -> Column:
    return F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))


def search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Queries: ids divisible by ``every``; candidates: all rows."""
    usable = embeddings.where(finite("embedding") & F.col("vec_id").isNotNull()).select("vec_id", as_integers("embedding").alias("ints"))
    return exact_topk(usable, usable.where(F.col("vec_id") % every == 0), k)
