"""Near-duplicate vectors by collision-counting projections (operator 2).

All vectors are projected on ``POOL`` random directions. Two unit vectors of cosine ``c`` differ along a Gaussian
direction by a normal with deviation ``sqrt(2 - 2c)``, so both fall into a window of half-width ``WINDOW``
with a known probability. Sorted projections give every vector's window; pairs that collide in at least a
count calibrated for the wanted recall are verified by their cosine in double precision.

Windows are counted inside cells only: a vector lies in one cell per table, the cell being its label and the buckets
of ``GRAIN`` of the projections (random offsets); a pair meets in some table with probability
``1 - (1 - p^GRAIN)^TABLES``, 0.997 at the threshold itself and 0.9999 at cosine 0.99. A pair counts in its first
common table only, so link counts are sums over cells and no pair ever leaves a task. Equal
vectors are one class from the start; a cell above ``BLOCK`` classes is split into blocks that meet in pairs.

Cases: null label, or a vector that is null, empty, zero or holds null or non-finite components, links with nothing; only
vectors of one length meet; repeated rows of one id count as one vector each (an id repeated with other content
takes its smallest component); empty table, empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import map_runs
from gridlake.llm.vectors import finite
from gridlake.operators.components import connected_components
from gridlake.session import materialise

POOL, TABLES, GRAIN = 120, 20, 12
WIDTH, WINDOW = 1.5, 0.5
BLOCK = 1024
RECALL = 0.9999


def directions(size: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((POOL, size))


def tables(seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Which projections a table buckets, and their offsets."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(POOL)[:GRAIN] for _ in range(TABLES)]), rng.uniform(0, WIDTH, (TABLES, GRAIN))


def least_count(cosine: float, recall: float = RECALL, pool: int = POOL, window: float = WINDOW) -> int:
    """The greatest count that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(window / (math.sqrt(2 - 2 * cosine) * math.sqrt(2)))
    above, n = 0.0, pool
    while n > 0:
        above += math.comb(pool, n) * p**n * (1 - p) ** (pool - n)
        if above >= recall:
            break
        n -= 1
    return n


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their greatest component near one: squares neither over- nor underflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def cell_codes(vectors: np.ndarray) -> np.ndarray:
    """One 64-bit bucket code per row and table."""
    projected, (picked, offset) = unit_rows(vectors) @ directions(vectors.shape[1]).T, tables()
    buckets = np.floor((projected[:, picked] + offset) / WIDTH).astype(np.int64)
    code = np.zeros(buckets.shape[:2], np.int64)
    for i in range(GRAIN):
        code = (code + buckets[:, :, i]) * np.int64(-7046029254386353131)
        code ^= code >> 29
    return code


def window_collisions(projected: np.ndarray, window: float = WINDOW) -> np.ndarray:
    """Per pair, in how many sorted projections one lies in the other's window."""
    n = len(projected)
    counts, place = np.zeros((n, n), np.int16), np.arange(n)
    for j in range(projected.shape[1]):
        order = np.argsort(projected[:, j], kind="stable")
        values = projected[order, j]
        low, high = np.searchsorted(values, values - window, "left"), np.searchsorted(values, values + window, "right")
        rank = np.empty(n, np.int64)
        rank[order] = place
        counts += (rank[None, :] >= low[rank][:, None]) & (rank[None, :] < high[rank][:, None])
    return counts


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the given pairs."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_classes(classes: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """``id, links, root`` rows from ``id, label, n, vector`` classes; sum ``links``, connect ``id`` with ``root``."""

    def keyed(batches):
        for batch in batches:
            matrix = batch["vector"].map(len).to_numpy()
            for size in np.unique(matrix):
                own = batch[matrix == size]
                codes = cell_codes(np.array(own["vector"].tolist(), float))
                yield pd.DataFrame({"id": own["id"].to_numpy(), "label": own["label"].to_numpy(), "size": size, "codes": list(codes)})

    codes = materialise(classes.select("id", "label", "vector").mapInPandas(keyed, "id long, label string, size int, codes array<long>"), "codes")
    cells = codes.select("id", F.posexplode("codes").alias("table", "code"), "label", "size").select(
        "id", "table", F.xxhash64("label", "size", "table", "code").alias("cell"))
    full = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("cell", F.ceil(F.col("_n") / block).cast("int").alias("blocks"))
    met = cells.join(full, "cell").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "table", "sub", F.xxhash64("cell", F.least("sub", "other"), F.greatest("sub", "other")).alias("run"), (F.col("sub") == F.col("other")).alias("same"))
    # a block's own pairs are met in its run with itself
    met = met.join(classes.select("id", "n", "vector"), "id").join(codes.select("id", "codes"), "id")
    least = least_count(cosine)

    def link(run):
        if len(run) < 2:
            return None
        run = run.sort_values("id")
        ids, subs, n = run["id"].to_numpy(), run["sub"].to_numpy(), run["n"].to_numpy()
        vectors, codes = scaled(np.array(run["vector"].tolist(), float)), np.array(run["codes"].tolist(), np.int64)
        units = unit_rows(vectors)
        counts = window_collisions(units @ directions(vectors.shape[1]).T)
        left, right = np.nonzero(np.triu(counts >= least, 1))
        own = (subs[left] == subs[right]) == bool(run["same"].iloc[0])
        left, right, table = left[own], right[own], int(run["table"].iloc[0])
        first = ~(codes[left, :table] == codes[right, :table]).any(1)
        left, right = left[first], right[first]
        near = np.concatenate([(vectors[a] * vectors[b]).sum(1) / np.sqrt((vectors[a] ** 2).sum(1) * (vectors[b] ** 2).sum(1))
                               for a, b in ((left[i : i + 65536], right[i : i + 65536]) for i in range(0, max(1, len(left)), 65536))]) >= cosine
        left, right = left[near], right[near]
        if not len(left):
            return None
        links = np.bincount(left, n[right], len(ids)) + np.bincount(right, n[left], len(ids))
        at = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[at], "links": links[at].astype(np.int64), "root": ids[_roots(len(ids), left, right)[at]]})

    return map_runs(met, "run", link, "id long, links long, root long")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per vector: direct links, component, kept."""
    usable = finite("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    vectors = embeddings.where(usable).select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    # classes have numbers of their own, written once: an id may stand for several vectors
    grouped = vectors.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialise(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    linked = materialise(link_classes(classes, cosine), "links")
    totals = linked.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(linked.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    # only linked classes are in a component of several
    least = components.join(classes.select(F.col("id").alias("node"), "first"), "node")
    least = least.groupBy("component").agg(F.min("first").alias("least")).join(components, "component").select(F.col("node").alias("id"), "least")
    found = classes.join(totals, "id", "left").join(least, "id", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    placed = vectors.join(found, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = embeddings.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
