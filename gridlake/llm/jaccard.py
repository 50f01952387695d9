"""N-gram Jaccard join with signature trees (operator 7).

A document's set holds the hashes of its distinct word shingles. Equal sets become one class first. Sets whose
similarity reaches the threshold share one of their first ``n - ceil(p n) + 1`` tokens in any common order (by hash,
tokens that many sets hold last), so every such token is a cell and all links lie inside cells (this is
exact); cells with the same members are kept once.

In a cell (hot ones are split into blocks that meet in pairs) the sets form a signature tree: leaves are
sets, nodes hold the OR of their bitmaps, the range of their sizes and the greatest number of tokens
that share a bit. Dual traversal drops a node pair when its size ranges are too far apart, when
``popcount(A and B) + shared bits`` cannot reach the overlap the sizes ask for, or when all its sets are
connected already. Surviving leaf pairs are compared exactly, best bound first, and only spanning links
leave the task: a group of a thousand copies costs about a thousand comparisons, not half a million.

Two rounds: first every set joins only its largest cell, which connects big groups of near copies at once; then
all cells that still touch several components. Links are exact up to collisions of 64-bit hashes.

Cases: null or empty text and texts without words have an empty set, link with nothing and are their own component; texts shorter than a
shingle are one shingle; repeated rows fall into one class and keep a row each; rows with a null id
get their class's smallest id (null if there is none); empty table, empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import map_runs, mix, shingle_set, word_memo
from gridlake.operators.components import connected_components
from gridlake.session import materialise

LEAST_BITS = 1024
FAN = 8
#: Words of bitmap looked at together in a traversal.
AT_ONCE = 1 << 22
#: Frequent tokens: held by more than ``HOT`` prefixes; at most ``FREQUENT`` (8 bytes each) are collected and broadcast.
HOT, FREQUENT = 8, 1_000_000
#: Member rows (about 60 bytes each) that are broadcast to bitmaps or texts, so that these are not shuffled by id.
BROADCAST_ROWS = 1_000_000
#: Sets of one run; a cell with more is split.
BLOCK = 512


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    with np.errstate(over="ignore"):
        return int(tokens.sum(dtype=np.uint64).view(np.int64)), int(mix(tokens + np.uint64(0xA5A5)).sum(dtype=np.uint64).view(np.int64))


def prefix_of(tokens: np.ndarray, percent: int, frequent: np.ndarray | None) -> np.ndarray:
    """The first tokens of a set in the common order: by hash, the ``frequent`` ones (sorted) last."""
    n = prefix_length(len(tokens), percent) if len(tokens) else 0
    if frequent is not None and len(frequent) and n:
        common = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
        rare = tokens[~common]
        return rare[:n] if len(rare) >= n else np.concatenate([rare, tokens[common][: n - len(rare)]])
    return tokens[:n]


def document_sets(docs: DataFrame, width: int, percent: int, frequent: np.ndarray | None = None) -> DataFrame:
    """``id, n, d1, d2, head, bits, prefix`` per row of ``id, text``: digests, least token, bitmap and first tokens of its set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def over(batches):
        memo, frequent = word_memo(), shared.value
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part, rows = batch.iloc[start : start + 1000], []
                for key, text in zip(part["id"], part["text"], strict=True):
                    tokens = shingle_set(text if isinstance(text, str) else None, width, memo)
                    rows.append((key, len(tokens), *set_digest(tokens), int(tokens[:1].view(np.int64).sum()), bitmap(tokens).tobytes(), prefix_of(tokens, percent, frequent).view(np.int64)))
                out = pd.DataFrame(rows, columns=["id", "n", "d1", "d2", "head", "bits", "prefix"])
                out["id"] = part["id"].array
                yield out

    return docs.mapInPandas(over, "id long, n long, d1 long, d2 long, head long, bits binary, prefix array<long>")


class _Level:
    """Nodes of one height: bitmaps, size range, shared bits, range of components."""

    def __init__(self, bits, low, high, excess, first, last):
        self.bits, self.low, self.high, self.excess, self.first, self.last = bits, low, high, excess, first, last

    def above(self) -> _Level:
        at = np.arange(0, len(self.low), FAN)
        up = lambda f, x: f.reduceat(x, at)
        return _Level(up(np.bitwise_or, self.bits), up(np.minimum, self.low), up(np.maximum, self.high), up(np.maximum, self.excess),
                      up(np.minimum, self.first), up(np.maximum, self.last))

    def possible(self, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Which node pairs may hold a link, and the overlap left over in the best case."""
        keep = (100 * self.high[a] >= percent * self.low[b]) & (100 * self.high[b] >= percent * self.low[a])
        keep &= ~((self.first[a] == self.last[a]) & (self.first[b] == self.last[b]) & (self.first[a] == self.first[b]))
        at = np.flatnonzero(keep)
        joint = np.bitwise_count(self.bits[a[at]] & self.bits[b[at]]).sum(1, dtype=np.int64) + np.minimum(self.excess[a[at]], self.excess[b[at]])
        spare = (100 + percent) * joint - percent * (self.low[a[at]] + self.low[b[at]])
        at, spare = at[spare >= 0], spare[spare >= 0]
        return at, spare


def dual_traversal(leaves: _Level, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf pairs (i < j) that no bound excludes, with their spare overlap."""
    levels = [leaves]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].above())
    left, right, spare = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    child = np.arange(FAN)
    for level in levels[-2::-1]:
        found = []
        step = max(1, AT_ONCE // (FAN * FAN * level.bits.shape[1]))
        for start in range(0, len(left), step):
            a, b = left[start : start + step], right[start : start + step]
            i = np.broadcast_to((a[:, None] * FAN + child)[:, :, None], (len(a), FAN, FAN)).ravel()
            j = np.broadcast_to((b[:, None] * FAN + child)[:, None, :], (len(b), FAN, FAN)).ravel()
            fits = (i < len(level.low)) & (j < len(level.low)) & ((i < j) if level is leaves else (i <= j))
            i, j = i[fits], j[fits]
            at, left_over = level.possible(i, j, percent)
            found.append((i[at], j[at], left_over))
        left, right, spare = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (left[:0], right[:0], spare[:0])
    return (left, right, spare) if len(levels) > 1 else (left[:0], right[:0], spare[:0])


def bitmap_size(n: int) -> int:
    """Bits of a set's bitmap: a power of two, at least four per token."""
    return max(LEAST_BITS, 1 << (4 * n - 1).bit_length()) if n else LEAST_BITS


def bitmap(tokens: np.ndarray) -> np.ndarray:
    size = bitmap_size(len(tokens))
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits: a token's place is its hash modulo the size."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def leaf_pairs(bits: list[np.ndarray], n: np.ndarray, head: np.ndarray, component: np.ndarray, part: np.ndarray, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs that the trees of these sets do not exclude, with their spare overlap.

    One tree per bitmap size; the sets of the next size that can still be similar join it with folded
    bitmaps. ``part``: the block of each set; ``same``: pairs inside blocks are wanted, else pairs across.
    """
    words, found = np.array([len(b) for b in bits]), [(np.empty(0, np.int64),) * 3]
    for size in np.unique(words):
        own = words == size
        order = np.flatnonzero(own | ((words == 2 * size) & (percent * n <= 100 * n[own].max())))
        if len(order) < 2:
            continue
        order = order[np.lexsort((n[order], head[order]))]
        tree, sizes = np.stack([folded(bits[i], size) for i in order]), n[order]
        leaves = _Level(tree, sizes, sizes, sizes - np.bitwise_count(tree).sum(1, dtype=np.int64), component[order], component[order])
        left, right, spare = dual_traversal(leaves, percent)
        left, right = order[left], order[right]
        wanted = ((part[left] == part[right]) == same) & (own[left] | own[right])
        found.append((left[wanted], right[wanted], spare[wanted]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def spanning_links(sets: list[np.ndarray], component: np.ndarray, part: np.ndarray, same: bool, percent: int) -> list[tuple[int, int]]:
    """Index pairs that connect what is similar and not connected yet."""
    n, head = np.array([len(s) for s in sets], np.int64), np.array([s[0] for s in sets], np.uint64)
    left, right, spare = leaf_pairs([bitmap(s) for s in sets], n, head, component, part, same, percent)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for at in np.argsort(-spare, kind="stable"):
        i, j = int(left[at]), int(right[at])
        a, b = root(int(component[i])), root(int(component[j]))
        if a != b:
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[a] = b
                out.append((i, j))
    return out


def frequent_tokens(texts: DataFrame, width: int, percent: int) -> np.ndarray:
    """The tokens that most prefixes hold: all with more than ``HOT``, or else the ``FREQUENT`` most frequent.

    They come last in the order that picks prefixes, so that shared passages make no cells; which
    tokens these are changes the work but never the links, as any common order is exact.
    """
    held = materialise(
        document_sets(texts, width, percent).select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "tokens"
    )
    # the smallest count at which the list still fits; one row per distinct count reaches the driver
    rows = sorted(((r["c"], r["n"]) for r in held.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, listed = rows[0][0] if rows else HOT, 0
    for c, n in rows:
        listed += n
        if c <= HOT or listed > FREQUENT:
            break
        least = c - 1
    found = held.where(F.col("c") > least).select("token").toPandas()["token"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def _shipped(rows: DataFrame) -> DataFrame:
    """Rows without texts or bitmaps are broadcast while they are few; more of them are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _links(members: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Spanning links ``src, dst`` of all cells of ``cell, rep, component``.

    The trees of bitmaps run first, without texts; only sets of a surviving pair bring their text to the
    exact comparison.
    """
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), F.min("component").alias("_a"), F.max("component").alias("_b"))
    sizes = sizes.where(F.col("_a") < F.col("_b")).select("cell", F.ceil(F.col("_n") / block).cast("int").alias("blocks"))
    met = members.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("rep", "component", "part", (F.col("part") == F.col("other")).alias("same"),
                     F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")).alias("run"))
    met = classes.select("rep", "n", "d1", "head", "bits").join(_shipped(materialise(met, "met")), "rep")

    def survive(run):
        if len(run) < 2:
            return None
        bits = [np.frombuffer(b, np.uint64) for b in run["bits"]]
        left, right, _ = leaf_pairs(bits, run["n"].to_numpy(), run["head"].to_numpy(), run["component"].to_numpy(), run["part"].to_numpy(), bool(run["same"].iloc[0]), percent)
        at = np.union1d(left, right)
        return run.iloc[at][["rep", "n", "d1", "component", "part", "same", "run"]] if len(at) else None

    left = materialise(map_runs(met, "run", survive, "rep long, n long, d1 long, component long, part int, same boolean, run long"), "survivors")
    placed = texts.select(F.col("id").alias("rep"), "text").join(_shipped(left), "rep")
    def link(run):
        memo = word_memo()
        sets, kept = [], []
        for i, (text, n, d1) in enumerate(zip(run["text"], run["n"], run["d1"], strict=True)):
            tokens = shingle_set(text, width, memo)
            if len(tokens) == n and set_digest(tokens)[0] == d1:  # a repeated id may bring another text
                sets.append(tokens)
                kept.append(i)
        run = run.iloc[kept]
        if len(run) < 2:
            return None
        rep = run["rep"].to_numpy()
        found = spanning_links(sets, run["component"].to_numpy(), run["part"].to_numpy(), bool(run["same"].iloc[0]), percent)
        return pd.DataFrame([(rep[i], rep[j]) for i, j in found], columns=["src", "dst"]) if found else None

    return map_runs(placed, "run", link, "src long, dst long")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``key, n_shingles, component_id`` for every row: components of the links with Jaccard similarity of at least ``percent``/100."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    frequent = frequent_tokens(texts, width, percent)
    sets = materialise(document_sets(texts, width, percent, frequent), "sets")
    classes = materialise(
        sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.first(F.struct("head", "bits", "prefix")).alias("s"))
        .select("n", "d1", "d2", "rep", "s.head", "s.bits", "s.prefix"), "classes"
    )
    keys = classes.where(F.col("rep").isNotNull()).select("rep", F.explode("prefix").alias("cell"))
    # cells with the same members are one: two xors of member hashes and their number tell
    cells = keys.groupBy("cell").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x2")
    ).where("c > 1").groupBy("c", "x1", "x2").agg(F.min("cell").alias("cell")).select("cell", "c")
    members = materialise(keys.join(cells, "cell"), "members")
    largest = members.groupBy("rep").agg(F.max_by("cell", F.struct("c", "cell")).alias("cell"))
    first = members.join(largest, ["rep", "cell"]).withColumn("component", F.col("rep"))
    links = materialise(_links(first, classes, texts, width, percent, block), "links")
    found = connected_components(links).select(F.col("node").alias("rep"), "component")
    second = members.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = materialise(_links(second, classes, texts, width, percent, block), "links")
    components = connected_components(links.unionByName(more)).select(F.col("node").alias("rep"), "component")
    placed = classes.select("n", "d1", "d2", "rep").join(components, "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    full = sets.where("n > 0").select("id", "n", "d1", "d2").join(placed, ["n", "d1", "d2"]).select("id", "n", "component")
    empty = sets.where("n = 0").select("id", "n", F.col("id").alias("component"))
    return full.unionByName(empty).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """``docs`` without near copies: of each component one row with its smallest id (null last) stays.

    Rows are told apart by a hash of id and text, as ids may be null or repeated; rows without words all stay.
    """
    rows = docs.withColumn("_row", F.xxhash64(F.col(key), F.col("text")))
    found = materialise(jaccard_components(rows, width, percent, "_row").where("n_shingles > 0").groupBy("_row", "component_id").agg(F.count(F.lit(1)).alias("_n")), "found")
    place = F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("id"), "_row")
    first = found.join(rows.select("_row", key).distinct(), "_row").groupBy("component_id").agg(F.min(place).alias("first")).select(F.col("first._row").alias("_row"))
    kept = materialise(found.join(first, "_row", "left_semi"), "kept")
    left = rows.join(found.join(first, "_row", "left_anti"), "_row", "left_anti")
    # equal rows have one hash; their texts move only where needed
    again = kept.where("_n > 1").select("_row")
    return left.join(again, "_row", "left_anti").unionByName(left.join(again, "_row", "left_semi").dropDuplicates(["_row"])).select(*docs.columns)
