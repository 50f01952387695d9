"""Rooted forests in logarithmically many jobs: distances, orders, subtree sums, ancestors and cuts.

* ``breadth_first`` walks the first hops level by level; what lies deeper is contracted: whole chains at once by
  pointer doubling, then all leaves, until a core without either is left, and expanded again. A network of great depth
  takes a number of jobs that grows with the logarithm of its depth, and the result is exactly that of the search.
* ``subtree_order`` ranks the Euler tour of every tree by pointer doubling, so a subtree is an interval and its sums are
  differences of running totals (``subtree_sums``); no table of (node, ancestor) pairs is made for them.
* ``branch_cuts`` tells for every vertex which of the branches below it lose supply without it, from the number of
  edges outside the forest that leave each branch.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.ordered import previous_row, running_totals
from gridlake.operators.components import connected_components
from gridlake.session import discard, materialise

#: Hops that are walked level by level before the rest is contracted; the result does not depend on it.
SHALLOW = 8
#: A core of which a contraction round would remove less than one in so many nodes is searched as it is.
STUBBORN = 10
FOREST = ["node", "source", "ord", "hops", "parent", "via"]


def adjacency(edges: DataFrame, *extra: str) -> DataFrame:
    """Both directions of each edge: a, b and the extra columns."""
    pair = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
                   F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return edges.select(F.explode(pair).alias("_p"), *extra).select("_p.a", "_p.b", *extra)


# --- distances -----------------------------------------------------------------------------------


def breadth_first(edges: DataFrame, seeds: DataFrame, shallow: int = SHALLOW) -> DataFrame:
    """Breadth-first forest from all seeds at once.

    ``edges``: src, dst, edge_id; ``seeds``: node, source, ord. Result: node, source, ord, hops,
    parent, via. Equal hops go to the smaller ``ord``, then parent, then edge id.

    The adjacency keeps one hash partitioning for the first hops, only the frontier moves; a new
    frontier needs comparing with the last two levels only, because edges never skip a level.
    """
    neighbours = materialise(adjacency(edges.where(F.col("src") != F.col("dst")), "edge_id"), "adjacency")
    placed = neighbours.repartition("a").persist(StorageLevel.MEMORY_AND_DISK)
    start = seeds.groupBy("node").agg(F.min(F.struct("ord", "source")).alias("_s")).select(
        "node", "_s.source", "_s.ord", F.lit(0).alias("hops"),
        F.lit(None).cast(edges.schema["src"].dataType).alias("parent"),
        F.lit(None).cast(edges.schema["edge_id"].dataType).alias("via"),
    )

    def advance(level: DataFrame, before: DataFrame | None, hop: int) -> DataFrame:
        frontier = level.select(F.col("node").alias("a"), "source", "ord")
        reached = placed.join(frontier, "a").groupBy(F.col("b").alias("node")).agg(
            F.min(F.struct("ord", F.col("a").alias("parent"), F.col("edge_id").alias("via"), "source")).alias("_s")
        )
        for known in (level, before):
            if known is not None:
                reached = reached.join(known.select("node"), "node", "left_anti")
        return reached.select("node", "_s.source", "_s.ord", F.lit(hop).alias("hops"), "_s.parent", "_s.via")

    written = [materialise(start, "level")]
    level, before = written[0], None
    try:
        for hop in range(1, shallow, 2):
            # two levels per written table
            first = advance(level, before, hop)
            second = advance(first, level, hop + 1)
            pair = materialise(first.unionByName(second), "level").select(*FOREST)
            written.append(pair)
            before, level = pair.where(F.col("hops") == hop), pair.where(F.col("hops") == hop + 1)
            if level.isEmpty():
                return reduce(DataFrame.unionByName, written)
    finally:
        placed.unpersist()
    found = reduce(DataFrame.unionByName, written)
    # what is left touches the last level only; edges back to it count for the degrees
    inside = found.where(F.col("hops") < level.agg(F.max("hops")).first()[0]).select("node")
    rest = neighbours.join(inside.withColumnRenamed("node", "a"), "a", "left_anti").join(inside.withColumnRenamed("node", "b"), "b", "left_anti")
    return found.unionByName(_contracted(rest, level))


def _collapsed(arcs: DataFrame) -> DataFrame:
    """One arc per direction and pair of nodes: the shortest, then the least last step at either end."""
    return arcs.groupBy("a", "b").agg(
        F.min(F.struct("len", "pb", "vb")).alias("_f"), F.min(F.struct("len", "pa", "va")).alias("_g"),
    ).select("a", "b", "_f.len", "_f.pb", "_f.vb", "_g.pa", "_g.va")


def _flagged(arcs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Arcs with what kind of node either end is: 1 leaf, 2 inner node of a chain, 0 any other."""
    kinds = arcs.groupBy("a").agg(F.count(F.lit(1)).alias("_deg"), F.min("b").alias("lo"), F.max("b").alias("hi")).join(
        seeds.select(F.col("node").alias("a"), F.lit(True).alias("_seed")), "a", "left"
    ).select("a", "lo", "hi", "_deg", F.when(F.col("_seed").isNull() & (F.col("_deg") <= 2), F.col("_deg")).otherwise(0).alias("ka"))
    other = kinds.select(F.col("a").alias("b"), F.col("ka").alias("kb"))
    return materialise(arcs.join(kinds, "a").join(other, "b"), "arcs")


def _walks(flagged: DataFrame) -> DataFrame:
    """Where each inner node's two walks along its chain end, by pointer doubling.

    x, frm (the neighbour the walk leaves behind), tip (end of the chain), d (length), px, vx (last step to x
    when coming from the tip), pt, vt (last step to the tip). Closed chains without an end are left out.
    """
    walk = flagged.where("ka = 2").select(
        F.col("a").alias("x"), F.when(F.col("b") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("frm"), F.col("b").alias("tip"),
        F.col("a").alias("prev"), F.col("len").alias("d"), (F.col("kb") == 2).alias("open"), F.col("pa").alias("px"), F.col("va").alias("vx"),
        F.col("pb").alias("pt"), F.col("vb").alias("vt"),
    )

    def doubled(rows: DataFrame) -> DataFrame:
        onward = rows.select(
            F.col("x").alias("tip"), F.col("frm").alias("prev"), F.col("tip").alias("_t"), F.col("prev").alias("_p"), F.col("d").alias("_d"),
            F.col("open").alias("_o"), F.col("pt").alias("_pt"), F.col("vt").alias("_vt"))
        moved = rows.where("open").join(onward, ["tip", "prev"]).select(
            "x", "frm", F.col("_t").alias("tip"), F.col("_p").alias("prev"), (F.col("d") + F.col("_d")).alias("d"), F.col("_o").alias("open"), "px", "vx",
            F.col("_pt").alias("pt"), F.col("_vt").alias("vt"))
        return rows.where("not open").unionByName(moved)

    left = None
    while True:
        # two doublings per written table
        following = materialise(doubled(doubled(walk)), "walks")
        discard(walk)
        walk, before = following, left
        left = walk.where("open").count()
        # every chain with an end has fewer open walks than before
        if not left or left == before:
            return walk.where("not open")


def _contracted(arcs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Breadth-first rows of the nodes beyond ``seeds`` (forest rows of one level)."""
    current = _collapsed(arcs.select(
        "a", "b", F.lit(1).alias("len"), F.col("a").alias("pb"), F.col("edge_id").alias("vb"), F.col("b").alias("pa"), F.col("edge_id").alias("va")))
    rounds: list[tuple[DataFrame | None, DataFrame]] = []
    while True:
        flagged = _flagged(current, seeds)
        arcs_left, inner, leaves, nodes = flagged.agg(
            F.count(F.lit(1)), F.count_if(F.col("ka") == 2) / 2, F.count_if(F.col("ka") == 1), F.coalesce(F.sum(1 / F.col("_deg")), F.lit(0.0))
        ).first()
        if not arcs_left or (inner + leaves) * STUBBORN < nodes:
            break
        columns = ["a", "b", "len", "pb", "vb", "pa", "va"]
        reduced, walks = flagged.where("ka <> 2 and kb <> 2").select(*columns), None
        if inner:
            walks = _walks(flagged)
            ends = walks.select(F.col("x").alias("b"), F.col("frm").alias("a"), "tip", "d", "pt", "vt")
            whole = flagged.where("ka <> 2 and kb = 2").join(ends, ["a", "b"]).where(F.col("a") != F.col("tip")).select(
                "a", F.col("tip").alias("b"), (F.col("len") + F.col("d")).alias("len"), F.col("pt").alias("pb"), F.col("vt").alias("vb"), "pa", "va")
            reduced = _collapsed(reduced.unionByName(whole))
        reduced = materialise(reduced, "reduced")
        tips = reduced.groupBy("a").agg(F.count(F.lit(1)).alias("_deg")).where("_deg = 1").select(F.col("a").alias("node")).join(
            seeds.select("node"), "node", "left_anti")
        raked = reduced.join(tips.withColumnRenamed("node", "b"), "b", "left_semi")
        rounds.append((walks, raked))
        current = reduced.join(tips.withColumnRenamed("node", "a"), "a", "left_anti").join(tips.withColumnRenamed("node", "b"), "b", "left_anti")
    known = _core(flagged, seeds) if arcs_left else seeds.select(*FOREST)
    for walks, raked in reversed(rounds):
        leaf = raked.join(known.select(F.col("node").alias("a"), "source", "ord", "hops"), "a").select(
            F.col("b").alias("node"), "source", "ord", (F.col("hops") + F.col("len")).alias("hops"), F.col("pb").alias("parent"), F.col("vb").alias("via"))
        new = leaf
        if walks is not None:
            ends = known.unionByName(leaf).select(F.col("node").alias("tip"), "source", "ord", "hops")
            new = new.unionByName(walks.join(ends, "tip").groupBy(F.col("x").alias("node")).agg(
                F.min(F.struct((F.col("hops") + F.col("d")).alias("hops"), "ord", F.col("px").alias("parent"), F.col("vx").alias("via"), "source")).alias("_s")
            ).select("node", "_s.source", "_s.ord", "_s.hops", "_s.parent", "_s.via"))
        known = known.unionByName(materialise(new, "expanded"))
    return known.join(seeds.select("node"), "node", "left_anti").select(*FOREST)


def _core(arcs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Least (hops, ord, parent, via) of each node of the weighted core, by frontier relaxation."""
    best = materialise(seeds.select(*FOREST), "core")
    frontier = best
    value = F.struct("hops", "ord", "parent", "via")
    while True:
        moved = arcs.join(frontier.select(F.col("node").alias("a"), "source", "ord", "hops"), "a").groupBy(F.col("b").alias("node")).agg(
            F.min(F.struct((F.col("hops") + F.col("len")).alias("hops"), "ord", F.col("pb").alias("parent"), F.col("vb").alias("via"), "source")).alias("_s")
        ).select("node", "_s.source", "_s.ord", "_s.hops", "_s.parent", "_s.via")
        known = best.select("node", value.alias("_old"))
        better = materialise(moved.join(known, "node", "left").where(F.col("_old").isNull() | (value < F.col("_old"))).drop("_old"), "better")
        if better.isEmpty():
            return best
        following = materialise(best.join(better.select("node"), "node", "left_anti").unionByName(better), "core")
        discard(best)
        best, frontier = following, better


# --- orders and sums -----------------------------------------------------------------------------


def subtree_order(forest: DataFrame) -> DataFrame:
    """node, root, low, high: the subtree of a node is the nodes of its root with ``high`` in (low, high].

    The tour enters a node, goes through its children and leaves it; ranks are numbers of entries from a step to the
    tour's end, found by pointer doubling.
    """
    kids = forest.where(F.col("parent").isNotNull()).select("node", "parent")
    first = kids.groupBy(F.col("parent").alias("node")).agg(F.max("node").alias("_first"))
    beside = previous_row(kids, ["parent"], ["node"], {"node": "_next"}).select("node", "_next")
    tour = forest.select("node", "parent").join(first, "node", "left").join(beside, "node", "left")
    to = "struct<n:{},s:int>".format(forest.schema["node"].dataType.simpleString())

    def step(node, side):
        return F.struct(node.alias("n"), F.lit(side).alias("s"))

    enter = F.struct(F.lit(0).alias("s"), F.when(F.col("_first").isNotNull(), step(F.col("_first"), 0)).otherwise(step(F.col("node"), 1)).alias("to"), F.lit(1).cast("long").alias("w"))
    leave = F.struct(
        F.lit(1).alias("s"),
        F.when(F.col("_next").isNotNull(), step(F.col("_next"), 0)).when(F.col("parent").isNotNull(), step(F.col("parent"), 1)).otherwise(F.lit(None).cast(to)).alias("to"),
        F.lit(0).cast("long").alias("w"))
    steps = tour.select(F.col("node").alias("n"), F.explode(F.array(enter, leave)).alias("_x")).select(
        "n", "_x.s", F.col("_x.to.n").alias("tn"), F.col("_x.to.s").alias("ts"), "_x.w", F.when(F.col("_x.to").isNull(), F.col("n")).alias("root"))

    def doubled(rows: DataFrame) -> DataFrame:
        onward = rows.select(F.col("n").alias("tn"), F.col("s").alias("ts"), F.col("tn").alias("_n"), F.col("ts").alias("_s"), F.col("w").alias("_w"), F.col("root").alias("_r"))
        moved = rows.where("tn is not null").join(onward, ["tn", "ts"]).select(
            "n", "s", F.col("_n").alias("tn"), F.col("_s").alias("ts"), (F.col("w") + F.col("_w")).alias("w"), F.col("_r").alias("root"))
        return rows.where("tn is null").unionByName(moved)

    steps = materialise(steps, "tour")
    while True:
        following = materialise(doubled(doubled(steps)), "tour")
        discard(steps)
        steps = following
        if steps.where("tn is not null").isEmpty():
            break
    ranks = steps.groupBy(F.col("n").alias("node")).agg(
        F.max("root").alias("root"), F.max(F.when(F.col("s") == 1, F.col("w"))).alias("low"), F.max(F.when(F.col("s") == 0, F.col("w"))).alias("high"))
    return materialise(ranks, "order")


def subtree_sums(order: DataFrame, values: DataFrame, columns: list[str], wanted: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """node, (by,) sums of ``columns`` over the subtree of each wanted node, itself included.

    Values are placed on their tree's order once; each wanted node reads the running total at both ends of its
    interval. With ``by`` there is one row per value of it that the node's whole tree holds.
    """
    kinds = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    sums = [F.col(c).cast("decimal(38,6)" if kinds[c] in ("double", "float") else kinds[c]).alias(c) for c in columns]
    key = [F.lit(0).alias("_by")] if by is None else [F.col(by).alias("_by")]
    events = values.select("node", *key, *sums).join(order.select("node", "root", "high"), "node").select(
        "root", "_by", F.col("high").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast(order.schema["node"].dataType).alias("node"), F.lit(0).alias("sign"), *columns)
    asked = order if wanted is None else order.join(wanted.select("node").distinct(), "node", "left_semi")
    if by is None:
        asked = asked.withColumn("_by", F.lit(0))
    else:
        asked = asked.join(events.select("root", "_by").distinct(), "root")
    ends = F.array(F.struct(F.col("high").alias("pos"), F.lit(1).alias("sign")), F.struct(F.col("low").alias("pos"), F.lit(-1).alias("sign")))
    zeros = [F.lit(0).cast(events.schema[c].dataType).alias(c) for c in columns]
    queries = asked.select("root", "_by", "node", F.explode(ends).alias("_e")).select("root", "_by", "_e.pos", F.lit(1).alias("kind"), "node", "_e.sign", *zeros)
    totals = running_totals(events.unionByName(queries), ["root", "_by", "pos", "kind", "node", "sign"], columns).where("kind = 1")
    out = totals.groupBy("node", "_by").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in columns])
    kept = [F.col(c).cast(kinds[c] if kinds[c] in ("double", "float") else "long").alias(c) for c in columns]
    return out.select("node", *([] if by is None else [F.col("_by").alias(by)]), *kept)


# --- ancestors -----------------------------------------------------------------------------------


def jump_tables(forest: DataFrame) -> list[DataFrame]:
    """Tables of (node, anc, branch) one, two, four, ... steps up; ``branch`` is the ancestor's child on the way."""
    tables = [materialise(forest.where(F.col("parent").isNotNull()).select("node", F.col("parent").alias("anc"), F.col("node").alias("branch")), "jumps")]
    while not tables[-1].isEmpty():
        last = tables[-1]
        onward = last.select(F.col("node").alias("_mid"), "anc", "branch")
        tables.append(materialise(last.select("node", F.col("anc").alias("_mid")).join(onward, "_mid").select("node", "anc", "branch"), "jumps"))
    return tables[:-1]


def ancestors_of(nodes: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """node, anc, branch, dist for every strict ancestor of the given nodes; as many rows as the answer has."""
    rows = nodes.select("node").distinct()
    kind = rows.schema["node"].dataType
    found = rows.select("node", F.col("node").alias("anc"), F.lit(None).cast(kind).alias("branch"), F.lit(0).alias("dist"))
    for k, table in enumerate(jumps):
        further = found.select("node", F.col("anc").alias("_mid"), "dist").join(
            table.select(F.col("node").alias("_mid"), "anc", "branch"), "_mid").select("node", "anc", "branch", (F.col("dist") + (1 << k)).alias("dist"))
        found = found.unionByName(further)
        if k % 3 == 2:
            found = materialise(found, "ancestors")
    return found.where("dist > 0")


def off_tree_edges(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """Edges between reached vertices that the forest does not use."""
    used = forest.where(F.col("via").isNotNull()).select(
        F.col("via").alias("edge_id"), F.least("node", "parent").alias("lo"), F.greatest("node", "parent").alias("hi")
    )
    keyed = edges.where(F.col("src") != F.col("dst")).withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    rest = keyed.join(used, ["edge_id", "lo", "hi"], "left_anti")
    return rest.join(forest.select(F.col("node").alias("src")), "src", "left_semi").select("edge_id", "src", "dst")


def meeting_points(pairs: DataFrame, forest: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``pairs`` (src, dst, both in the forest) with ``meet`` and its children ``bs``, ``bd`` on the way to either end.

    Both ends climb together in steps that halve. A child is null where the end is the meeting point itself;
    ``meet`` is null for ends of different trees, whose children are then the roots.
    """
    depth = forest.select("node", "hops")
    rows = pairs.join(depth.select(F.col("node").alias("src"), F.col("hops").alias("_ds")), "src").join(
        depth.select(F.col("node").alias("dst"), F.col("hops").alias("_dd")), "dst")
    swap = F.col("_ds") < F.col("_dd")
    rows = rows.withColumns({
        "_swap": swap, "_u": F.when(swap, F.col("dst")).otherwise(F.col("src")), "_v": F.when(swap, F.col("src")).otherwise(F.col("dst")),
        "_up": F.greatest(F.abs(F.col("_ds") - F.col("_dd")) - 1, F.lit(0)), "_over": F.col("_ds") != F.col("_dd")})

    def climb(frame: DataFrame, end: str, table: DataFrame, out: str) -> DataFrame:
        return frame.join(table.select(F.col("node").alias(end), F.col("anc").alias(out)), end, "left")

    # the deeper end first comes to one step below the other's depth
    for k in reversed(range(len(jumps))):
        rows = climb(rows, "_u", jumps[k], "_n").withColumn("_go", F.col("_up") >= (1 << k)).withColumns(
            {"_u": F.when(F.col("_go"), F.col("_n")).otherwise(F.col("_u")), "_up": F.when(F.col("_go"), F.col("_up") - (1 << k)).otherwise(F.col("_up"))}).drop("_n", "_go")
        if k % 3 == 0:
            rows = materialise(rows, "climb")
    one = forest.select("node", F.col("parent").alias("anc"))
    rows = climb(rows, "_u", one, "_n").withColumn("_above", F.col("_over") & (F.col("_n") == F.col("_v"))).withColumn(
        "_u", F.when(F.col("_over") & ~F.coalesce("_above", F.lit(False)), F.col("_n")).otherwise(F.col("_u"))).withColumn("_above", F.coalesce("_above", F.lit(False))).drop("_n")
    for k in reversed(range(len(jumps))):
        rows = climb(climb(rows, "_u", jumps[k], "_n"), "_v", jumps[k], "_m").withColumn(
            "_go", ~F.col("_above") & F.coalesce(F.col("_n") != F.col("_m"), F.lit(False))).withColumns(
            {"_u": F.when(F.col("_go"), F.col("_n")).otherwise(F.col("_u")), "_v": F.when(F.col("_go"), F.col("_m")).otherwise(F.col("_v"))}).drop("_n", "_m", "_go")
        rows = materialise(rows, "climb")
    rows = climb(rows, "_u", one, "_n")
    near = F.when(F.col("_above"), F.lit(None)).otherwise(F.col("_v"))
    return rows.withColumns({
        "meet": F.when(F.col("_above"), F.col("_v")).otherwise(F.col("_n")),
        "bs": F.when(F.col("_swap"), near).otherwise(F.col("_u")), "bd": F.when(F.col("_swap"), F.col("_u")).otherwise(near),
    }).drop("_ds", "_dd", "_swap", "_u", "_v", "_up", "_over", "_above", "_n")


# --- cuts ----------------------------------------------------------------------------------------


class Cuts:
    """What loses supply when a vertex or an edge of the forest goes, as branches (whole subtrees).

    ``branches``: cut, branch, piece. Without ``cut`` everything below ``branch`` is without supply; branches of one
    ``piece`` stay connected with each other. ``bridges``: edge_id, branch. Without the edge everything below ``branch`` is.
    """

    def __init__(self, edges: DataFrame, forest: DataFrame, order: DataFrame, jumps: list[DataFrame]):
        below = forest.where(F.col("parent").isNotNull()).select(F.col("parent").alias("cut"), F.col("node").alias("branch"), F.col("via").alias("edge_id"))
        extra = materialise(off_tree_edges(edges, forest), "offtree")
        if extra.isEmpty():
            self.branches = below.select("cut", "branch", F.col("branch").alias("piece"))
            self.bridges = below.select("edge_id", "branch")
            return
        met = materialise(meeting_points(extra, forest, jumps), "met")
        marks = met.select(F.explode(F.array(
            F.struct(F.col("src").alias("node"), F.lit(1).cast("long").alias("n")), F.struct(F.col("dst").alias("node"), F.lit(1).cast("long").alias("n")),
            F.struct(F.col("meet").alias("node"), F.lit(-2).cast("long").alias("n")))).alias("_m")).select("_m.*").where(F.col("node").isNotNull())
        # edges outside the forest with just one end in the branch
        leaving = subtree_sums(order, marks.groupBy("node").agg(F.sum("n").alias("n")), ["n"]).select(F.col("node").alias("branch"), F.col("n").alias("_out"))
        # of these, the ones that end at the cut vertex or in another branch of it
        near = met.where(F.col("meet").isNotNull()).select(F.explode(F.array("bs", "bd")).alias("branch")).where(F.col("branch").isNotNull()).groupBy("branch").agg(
            F.count(F.lit(1)).alias("_near"))
        counted = materialise(below.join(leaving, "branch").join(near, "branch", "left").select(
            "cut", "branch", "edge_id", "_out", (F.col("_out") - F.coalesce("_near", F.lit(0))).alias("_past")), "leaving")
        side = met.where(F.col("meet").isNotNull() & F.col("bs").isNotNull() & F.col("bd").isNotNull()).select(F.col("bs").alias("src"), F.col("bd").alias("dst"))
        pieces = connected_components(side).withColumnRenamed("node", "branch").withColumnRenamed("component", "_piece")
        labelled = counted.join(pieces, "branch", "left").withColumn("piece", F.coalesce("_piece", "branch"))
        supplied = labelled.where("_past > 0").select("piece").distinct()
        self.branches = materialise(labelled.join(supplied, "piece", "left_anti").select("cut", "branch", "piece"), "branches")
        self.bridges = counted.where("_out = 0").select("edge_id", "branch")


def shortest_paths(edges: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """Least total weight per (keys, node) by frontier relaxation, with parent and edge.

    ``edges``: keys, src, dst, weight; ``seeds``: keys, node. Only improved rows are propagated.
    Result: keys, node, length, parent.
    """
    steps = materialise(adjacency(edges, *keys, "weight"), "steps")
    node_type = edges.schema["src"].dataType
    best = materialise(
        seeds.select(*keys, "node", F.lit(0.0).alias("length"), F.lit(None).cast(node_type).alias("parent")).distinct(),
        "paths",
    )
    frontier = best
    for _ in count():
        moved = (
            frontier.select(*keys, F.col("node").alias("a"), "length").join(steps, [*keys, "a"])
            .select(*keys, F.col("b").alias("node"), (F.col("length") + F.col("weight")).alias("length"), F.col("a").alias("parent"))
            .groupBy(*keys, "node").agg(F.min(F.struct("length", "parent")).alias("_s"))
            .select(*keys, "node", "_s.length", "_s.parent")
        )
        known = best.select(*keys, "node", F.col("length").alias("_old"))
        better = materialise(
            moved.join(known, [*keys, "node"], "left")
            .where(F.col("_old").isNull() | (F.col("length") < F.col("_old"))).drop("_old"),
            "paths",
        )
        if better.isEmpty():
            break
        following = materialise(
            best.join(better.select(*keys, "node"), [*keys, "node"], "left_anti").unionByName(better), "paths"
        )
        discard(best)
        best, frontier = following, better
    return best
