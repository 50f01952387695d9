"""Isolation and restoration for every possible faulted zone of the whole network at once.

A *zone* is what no switch divides. The network is contracted to zones joined by switches; a fault
scenario is a zone, and everything a fault does follows from which branches hang below it. Branches are
intervals of the forest's order, so totals are differences of running totals and no scenario is paired with the zones it affects.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.columns import round_to
from gridlake.operators.components import connected_components
from gridlake.operators.forest import (
    Cuts,
    ancestors_of,
    breadth_first,
    jump_tables,
    off_tree_edges,
    shortest_paths,
    subtree_order,
    subtree_sums,
)
from gridlake.operators.network import (
    CUSTOMER_COLUMNS,
    EXTERNAL,
    SEGMENT,
    SWITCH,
    is_external,
    source_table,
    sum_customers,
)
from gridlake.session import discard, materialise

_SEP = "\u0001"
TOTALS = ["n_nodes", *CUSTOMER_COLUMNS]


@dataclass
class ZoneGraph:
    """Contracted network. All frames are written tables, shared by every analysis."""

    zones: DataFrame  # node, zone
    links: DataFrame  # edge_id, gate, kind, src, dst (zones), open, ctmt, tlcd, tip_unid, external
    seeds: DataFrame  # node (zone), source, ord
    forest: DataFrame  # breadth-first forest over closed links
    order: DataFrame  # node, root, low, high
    jumps: list[DataFrame]  # node, anc, branch by powers of two
    cuts: Cuts  # branches without supply per removed zone or link
    below: DataFrame  # node, customers of its whole subtree
    customers: DataFrame  # zone, n_nodes, ucbt, ucmt, trafos, kva
    switches: DataFrame  # gate, ctmt_chave, tlcd, tip_unid, externa


def zone_labels(edges: DataFrame) -> DataFrame:
    """node, zone (N9): reachable without crossing a switch, external nodes kept apart."""
    inner = edges.where(F.col("gate").isNull() & ~is_external(F.col("src")) & ~is_external(F.col("dst")))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return connected_components(inner.select("src", "dst"), nodes).withColumnRenamed("component", "zone")


def zone_graph(edges: DataFrame, sources: DataFrame, customers: DataFrame, zones: DataFrame | None = None) -> ZoneGraph:
    """Contract the network to zones (labels may be given) and root it at the sources."""
    zones = zone_labels(edges) if zones is None else zones
    crossing = edges.where(
        F.col("gate").isNotNull() | is_external(F.col("src")) | is_external(F.col("dst"))
    )
    links = materialise(
        crossing.join(zones.select(F.col("node").alias("src"), F.col("zone").alias("_zs")), "src")
        .join(zones.select(F.col("node").alias("dst"), F.col("zone").alias("_zd")), "dst")
        .where(F.col("_zs") != F.col("_zd"))
        .select("edge_id", "gate", "kind", F.col("_zs").alias("src"), F.col("_zd").alias("dst"), "open", "ctmt", "tlcd", "tip_unid", "external"),
        "links",
    )
    seeds = source_table(sources, edges).join(zones, "node").groupBy("zone").agg(
        F.min(F.struct("ord", "source")).alias("_s")
    ).select(F.col("zone").alias("node"), "_s.source", "_s.ord")
    seeds = materialise(seeds, "seeds")
    forest = materialise(breadth_first(links.where(~F.col("open")), seeds), "forest")
    totals = zones.where(~is_external(F.col("node"))).join(customers, "node", "left").groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CUSTOMER_COLUMNS[:3]],
        F.coalesce(F.sum(F.col("kva").cast("decimal(28,6)")).cast("double"), F.lit(0.0)).alias("kva"),
    )
    totals = materialise(totals, "totals")
    switches = edges.where(F.col("kind") == SWITCH).select(
        "gate", F.col("ctmt").alias("ctmt_chave"), "tlcd", "tip_unid", F.col("external").alias("externa")
    )
    order = subtree_order(forest)
    jumps = jump_tables(forest)
    below = subtree_sums(order, totals.withColumnRenamed("zone", "node"), TOTALS)
    cuts = Cuts(links.where(~F.col("open")).select("edge_id", "src", "dst"), forest, order, jumps)
    return ZoneGraph(zones, links, seeds, forest, order, jumps, cuts, materialise(below, "below"), totals, switches)


def boundaries(graph: ZoneGraph) -> DataFrame:
    """zone, gate: the closed switches that leave each zone."""
    closed = graph.links.where(~F.col("open") & F.col("gate").isNotNull())
    return closed.select(F.explode(F.array("src", "dst")).alias("zone"), "gate").distinct()


def _multi_gates(graph: ZoneGraph) -> DataFrame:
    """Closed switches that control more than one link (a ring switch with a gated tie)."""
    closed = graph.links.where(~F.col("open") & F.col("gate").isNotNull())
    return closed.groupBy("gate").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("gate")


def _explicit(graph: ZoneGraph, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact treatment of the few scenarios the cut analysis does not cover.

    ``removals``: scenario, anchor (a zone), gate. The anchor's component is copied once per
    scenario, the gates are opened and supply is searched again. Returns (lost: scenario, lost,
    component) and (fed: scenario, node, source).
    """
    closed = graph.links.where(~F.col("open"))
    labels = connected_components(closed.select("src", "dst"), graph.forest.select("node"))
    home = removals.select("scenario", F.col("anchor").alias("node")).distinct().join(labels, "node").select("scenario", "component")
    members = materialise(home.join(labels, "component").select("scenario", "node"), "members")

    def key(column: str):
        return F.concat(F.col("scenario"), F.lit(_SEP), F.col(column))

    kept = (
        closed.join(members.withColumnRenamed("node", "src"), "src")
        .join(removals.select("scenario", "gate").distinct(), ["scenario", "gate"], "left_anti")
        .select(key("src").alias("src"), key("dst").alias("dst"), "edge_id")
    )
    kept = materialise(kept, "scenario")
    starts = members.join(graph.seeds, "node").select(key("node").alias("node"), "source", "ord")
    after = breadth_first(kept, starts)
    part = F.split("node", _SEP)
    fed = materialise(after.select(part[0].alias("scenario"), part[1].alias("node"), "source"), "fed")
    before = members.join(graph.forest.select("node"), "node", "left_semi")
    dark = materialise(before.join(fed.select("scenario", "node"), ["scenario", "node"], "left_anti"), "dark")
    keyed = dark.select(key("node").alias("node"))
    inner = kept.join(keyed.withColumnRenamed("node", "src"), "src", "left_semi").join(
        keyed.withColumnRenamed("node", "dst"), "dst", "left_semi"
    )
    pieces = connected_components(inner.select("src", "dst"), keyed)
    lost = pieces.select(part[0].alias("scenario"), part[1].alias("lost"), F.split("component", _SEP)[1].alias("component"))
    return lost, fed


def _loop_survivors(graph: ZoneGraph, closed: DataFrame) -> DataFrame:
    """Scenarios where a branch below the fault stays supplied and several sources share the island."""
    fed = graph.forest.select("node", "source")
    loops = off_tree_edges(closed, graph.forest)
    sides = loops.join(fed.select(F.col("node").alias("src"), F.col("source").alias("_a")), "src").join(
        fed.select(F.col("node").alias("dst"), F.col("source").alias("_b")), "dst"
    ).where(F.col("_a") != F.col("_b"))
    shared = sides.select(F.explode(F.array("_a", "_b")).alias("source")).distinct()
    below = graph.forest.where(F.col("parent").isNotNull()).join(shared, "source", "left_semi").select(F.col("parent").alias("scenario"), F.col("node").alias("branch"))
    return below.join(graph.cuts.branches.select("branch"), "branch", "left_anti").where(~is_external(F.col("scenario"))).select("scenario").distinct()


@dataclass
class Isolation:
    """Effect of opening the boundary of each zone."""

    boundary: DataFrame  # zone, gate
    branches: DataFrame  # cut, branch, component: everything below the branch is without supply
    single: DataFrame  # cut, lost, component: zones without supply in the scenarios that are searched one by one
    refed: DataFrame  # cut, node, source: only where the source differs from the normal forest


def isolate_zones(graph: ZoneGraph) -> Isolation:
    """Isolation of every zone."""
    boundary = boundaries(graph)
    closed = graph.links.where(~F.col("open"))
    simple = graph.cuts.branches.where(~is_external(F.col("cut"))).withColumnRenamed("piece", "component")
    # scenarios to search explicitly: a boundary switch that also opens a link elsewhere, and closed
    # loops fed by several sources (the surviving source may change)
    multi = _multi_gates(graph)
    apart = closed.join(multi, "gate", "left_semi").select("gate", F.array("src", "dst").alias("_ends"))
    elsewhere = boundary.join(apart, "gate").where(~F.array_contains("_ends", F.col("zone"))).select(F.col("zone").alias("scenario"))
    special = materialise(elsewhere.unionByName(_loop_survivors(graph, closed)).distinct(), "special")
    kind = graph.forest.schema["node"].dataType.simpleString()
    if special.isEmpty():
        spark = simple.sparkSession
        return Isolation(
            boundary, simple, spark.createDataFrame([], f"cut {kind}, lost {kind}, component {kind}"), spark.createDataFrame([], f"cut {kind}, node {kind}, source string"))
    removals = special.withColumn("anchor", F.col("scenario")).join(
        boundary.withColumnRenamed("zone", "scenario"), "scenario"
    )
    lost, fed = _explicit(graph, removals)
    lost = lost.where(F.col("scenario") != F.col("lost")).withColumnRenamed("scenario", "cut")
    plain = simple.join(special.withColumnRenamed("scenario", "cut"), "cut", "left_anti")
    changed = fed.join(graph.forest.select("node", F.col("source").alias("_was")), "node").where(
        F.col("source") != F.col("_was")
    )
    return Isolation(
        boundary,
        materialise(plain, "branches"),
        materialise(lost.select("cut", "lost", "component"), "lost"),
        materialise(changed.select(F.col("scenario").alias("cut"), "node", "source"), "refed"),
    )


def lost_at(graph: ZoneGraph, isolation: Isolation, zones: DataFrame | None = None) -> DataFrame:
    """cut, lost, component: the scenarios that leave the given zones (``node``) without supply; all zones if none are given."""
    asked = graph.forest.select("node") if zones is None else zones.select("node").distinct()
    above = ancestors_of(asked, graph.jumps).select(F.col("node").alias("lost"), F.col("anc").alias("cut"), "branch")
    simple = above.join(isolation.branches, ["cut", "branch"]).select("cut", "lost", "component")
    return simple.unionByName(isolation.single.join(asked.withColumnRenamed("node", "lost"), "lost", "left_semi").select("cut", "lost", "component"))


def piece_totals(graph: ZoneGraph, isolation: Isolation) -> DataFrame:
    """cut, component, customers: what each piece without supply holds."""
    simple = isolation.branches.join(graph.below.withColumnRenamed("node", "branch"), "branch")
    single = isolation.single.join(graph.customers.withColumnRenamed("zone", "lost"), "lost")
    return simple.select("cut", "component", *TOTALS).unionByName(single.select("cut", "component", *TOTALS)).groupBy("cut", "component").agg(
        *[F.sum(c).alias(c) for c in TOTALS])


def piece_regions(graph: ZoneGraph, isolation: Isolation, regions: DataFrame, by: str = "region", pieces: DataFrame | None = None) -> DataFrame:
    """cut, component, region, n: customers per region of each piece, from ``regions``: node (a zone), region, n; only the ``pieces`` (cut, component) if given."""
    branches, single = isolation.branches, isolation.single
    if pieces is not None:
        asked = pieces.select("cut", "component").distinct()
        branches, single = (df.join(asked, ["cut", "component"], "left_semi") for df in (branches, single))
        branches = materialise(branches, "asked")
    # read three times, by the sampling of ranges too
    counted = materialise(regions.where(F.col(by).isNotNull()).groupBy("node", by).agg(F.sum("n").alias("n")), "counted")
    below = subtree_sums(graph.order, counted, ["n"], wanted=branches.select(F.col("branch").alias("node")), by=by)
    simple = branches.join(below.withColumnRenamed("node", "branch"), "branch").where("n > 0")
    several = single.join(counted.withColumnRenamed("node", "lost"), "lost")
    return simple.select("cut", "component", by, "n").unionByName(several.select("cut", "component", by, "n")).groupBy("cut", "component", by).agg(F.sum("n").alias("n"))


def isolation_table(graph: ZoneGraph, isolation: Isolation) -> DataFrame:
    """One row per zone: switches to open, customers inside, healthy nodes and customers lost."""
    opens = isolation.boundary.groupBy("zone").agg(
        F.array_join(F.array_sort(F.collect_list("gate")), ";").alias("chaves")
    )
    totals = piece_totals(graph, isolation).groupBy(F.col("cut").alias("zone")).agg(
        F.sum("n_nodes").alias("nos_desligados"),
        *[F.sum(c).alias(f"desligados_{c}") for c in CUSTOMER_COLUMNS[:3]],
    )
    return graph.customers.join(opens, "zone", "left").join(totals, "zone", "left").select(
        "zone", F.coalesce("chaves", F.lit("")).alias("chaves"), F.col("n_nodes").alias("nos_zona"),
        *[F.col(c).alias(f"zona_{c}") for c in CUSTOMER_COLUMNS[:3]],
        F.coalesce("nos_desligados", F.lit(0)).alias("nos_desligados"),
        *[F.coalesce(f"desligados_{c}", F.lit(0)).alias(f"desligados_{c}") for c in CUSTOMER_COLUMNS[:3]],
    )


def segment_zones(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """edge_id, ctmt, zone of every segment (U5: both ends lie in the same zone)."""
    return edges.where(F.col("kind") == SEGMENT).join(
        zones.select(F.col("node").alias("src"), "zone"), "src"
    ).select("edge_id", "ctmt", "zone")


def lost_ends(graph: ZoneGraph, isolation: Isolation) -> DataFrame:
    """cut, lost, component: the scenarios that leave an end of an open switch without supply."""
    return materialise(lost_at(graph, isolation, _open_ends(graph).select(F.col("x").alias("node"))), "located")


def recovered_components(graph: ZoneGraph, isolation: Isolation, lost: DataFrame | None = None) -> DataFrame:
    """cut, gate, component: lost pieces each open switch touches, whether or not it helps; ``lost`` as by ``lost_ends``."""
    ends = _open_ends(graph)
    lost = lost_ends(graph, isolation) if lost is None else lost
    return lost.join(ends.withColumnRenamed("x", "lost"), "lost").select("cut", "gate", "component").distinct()


def _open_ends(graph: ZoneGraph) -> DataFrame:
    """Both directions of the open switch links: x, y, gate, order of trial."""
    opened = graph.links.where(F.col("open") & F.col("gate").isNotNull())
    order = F.when(F.col("kind") == SWITCH, 0).otherwise(1)
    sides = F.array(
        F.struct(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(0).alias("side")),
        F.struct(F.col("dst").alias("x"), F.col("src").alias("y"), F.lit(1).alias("side")),
    )
    return opened.select("gate", "edge_id", order.alias("order"), F.explode(sides).alias("_s")).select("gate", "edge_id", "order", "_s.*")


def restoration_options(graph: ZoneGraph, isolation: Isolation, lost: DataFrame | None = None) -> DataFrame:
    """Every open switch that returns supply after isolating a zone (N11), ranked.

    One row per (zone, switch): source, recovered nodes and customers, customers already on that
    source, rank by customers, remote control, code. ``lost`` as by ``lost_ends``.
    """
    ends = materialise(_open_ends(graph), "ends")
    # only the ends of open switches are looked up, both of them
    lost = lost_ends(graph, isolation) if lost is None else lost
    candidates = lost.join(ends.withColumnRenamed("x", "lost"), "lost")
    alive = candidates.join(graph.forest.select(F.col("node").alias("y"), F.col("source").alias("_src")), "y")
    alive = alive.join(lost.select("cut", F.col("lost").alias("y")), ["cut", "y"], "left_anti")
    rooted = graph.seeds.select(F.col("node").alias("cut"), F.lit(True).alias("_rooted"))
    alive = alive.join(rooted, "cut", "left").where((F.col("y") != F.col("cut")) | F.col("_rooted"))
    alive = alive.join(
        isolation.refed.select("cut", F.col("node").alias("y"), F.col("source").alias("_new")), ["cut", "y"], "left"
    ).withColumn("_src", F.coalesce("_new", "_src"))
    chosen = alive.groupBy("cut", "gate").agg(
        F.min(F.struct("order", "edge_id", "side", F.col("_src").alias("fonte"))).alias("_b")
    ).select("cut", "gate", F.col("_b.fonte").alias("fonte"))

    touched = candidates.select("cut", "gate", "component").distinct()
    gained = chosen.join(touched, ["cut", "gate"]).join(piece_totals(graph, isolation), ["cut", "component"])
    totals = gained.groupBy("cut", "gate", "fonte").agg(
        F.sum("n_nodes").alias("nos"), *[F.sum(c).alias(c) for c in CUSTOMER_COLUMNS]
    )
    served = source_load(graph, isolation, chosen.select("cut", "fonte").distinct())
    rows = totals.join(graph.switches, "gate").join(served, ["cut", "fonte"], "left").withColumn(
        "clientes", F.col("ucbt") + F.col("ucmt")
    )
    # the options of one zone are at most the open switches around its island
    best = Window.partitionBy("cut").orderBy(F.col("clientes").desc(), F.col("tlcd").desc(), "gate")
    ranked = rows.withColumn("ordem", F.row_number().over(best).cast("long"))
    return ranked.select(
        F.col("cut").alias("zone"), F.col("gate").alias("chave"), "ctmt_chave", "fonte", "tlcd", "tip_unid", "externa",
        "nos", "ucbt", "ucmt", "clientes", "trafos", "kva", F.coalesce("clientes_fonte", F.lit(0)).alias("clientes_fonte"),
        "ordem",
    )


def source_load(graph: ZoneGraph, isolation: Isolation, wanted: DataFrame) -> DataFrame:
    """cut, fonte, clientes_fonte: customers on a source after the isolation.

    Normal total of the source, minus what the scenario takes away from it, plus what moves to it.
    """
    load = graph.customers.select(F.col("zone").alias("node"), (F.col("ucbt") + F.col("ucmt")).alias("n"))
    fed = graph.forest.join(load, "node").select("node", "source", "n")
    normal = fed.groupBy(F.col("source").alias("fonte")).agg(F.sum("n").alias("_normal"))
    rooted = graph.seeds.select("node")
    own = fed.join(rooted, "node", "left_anti").select(F.col("node").alias("cut"), F.col("source").alias("fonte"), (-F.col("n")).alias("d"))
    # a branch has the source of the zone above it
    source = graph.forest.select(F.col("node").alias("cut"), F.col("source").alias("fonte"))
    fallen = isolation.branches.join(graph.below.withColumnRenamed("node", "branch"), "branch").join(source, "cut").select(
        "cut", "fonte", (-(F.col("ucbt") + F.col("ucmt"))).alias("d"))
    gone = isolation.single.select("cut", F.col("lost").alias("node")).join(fed, "node").select("cut", F.col("source").alias("fonte"), (-F.col("n")).alias("d")).unionByName(fallen)
    moved = isolation.refed.select("cut", "node", F.col("source").alias("_new")).join(fed, "node")
    leave = moved.select("cut", F.col("source").alias("fonte"), (-F.col("n")).alias("d"))
    arrive = moved.select("cut", F.col("_new").alias("fonte"), F.col("n").alias("d"))
    change = own.unionByName(gone).unionByName(leave).unionByName(arrive).groupBy("cut", "fonte").agg(F.sum("d").alias("_d"))
    return wanted.join(normal, "fonte", "left").join(change, ["cut", "fonte"], "left").select(
        "cut", "fonte", (F.coalesce("_normal", F.lit(0)) + F.coalesce("_d", F.lit(0))).alias("clientes_fonte")
    )


def zone_paths(graph: ZoneGraph) -> DataFrame:
    """zone, gate, position: switches between the source and each zone, source first."""
    via = graph.links.select("edge_id", "gate", F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi"))
    steps = graph.forest.where(F.col("via").isNotNull()).select(
        "node", F.col("via").alias("edge_id"), F.least("node", "parent").alias("_lo"), F.greatest("node", "parent").alias("_hi"), "hops"
    ).join(via, ["edge_id", "_lo", "_hi"]).select("node", "gate", "hops")
    own = steps.select(F.col("node").alias("zone"), "gate", "hops")
    above = ancestors_of(graph.forest, graph.jumps).select(F.col("node").alias("zone"), F.col("anc").alias("node")).join(steps, "node").select("zone", "gate", "hops")
    return own.unionByName(above).where(F.col("gate").isNotNull()).withColumnRenamed("hops", "position")


def _gate_branches(graph: ZoneGraph) -> tuple[DataFrame, DataFrame]:
    """(gate, branch) of the closed switches with one link that hold a branch up, and (gate, lost) of those with several links."""
    closed = graph.links.where(~F.col("open"))
    bridges = graph.cuts.bridges.join(closed.where(F.col("gate").isNotNull()).select("edge_id", "gate"), "edge_id").select("gate", "branch")
    multi = materialise(_multi_gates(graph), "multi")
    if multi.isEmpty():
        return bridges, bridges.select("gate", F.col("branch").alias("lost")).where(F.lit(False))
    anchors = closed.join(multi, "gate").select(F.col("gate").alias("scenario"), F.col("src").alias("anchor"), "gate").distinct()
    lost, _ = _explicit(graph, anchors)
    return bridges.join(multi, "gate", "left_anti"), materialise(lost.select(F.col("scenario").alias("gate"), "lost").distinct(), "multi")


def switch_downstream(graph: ZoneGraph) -> DataFrame:
    """gate, lost (zone): zones without supply when a closed switch opens (N7); for totals see ``switch_totals``."""
    branches, several = _gate_branches(graph)
    # whatever hangs on the branch: the branch itself, and zones that have it among their ancestors
    under = ancestors_of(graph.forest, graph.jumps).select(F.col("node").alias("lost"), F.col("anc").alias("branch"))
    under = under.unionByName(graph.forest.select(F.col("node").alias("lost"), F.col("node").alias("branch")))
    return branches.join(under, "branch").select("gate", "lost").unionByName(several).where(~is_external(F.col("lost")))


def switch_totals(graph: ZoneGraph) -> DataFrame:
    """gate, branch (null for a switch with several links), zonas and customer totals of what it holds up."""
    branches, several = _gate_branches(graph)
    real = graph.forest.where(~is_external(F.col("node"))).select("node", F.lit(1).cast("long").alias("zonas"))
    zones = subtree_sums(graph.order, real, ["zonas"], wanted=branches.select(F.col("branch").alias("node")))
    one = branches.join(graph.below.join(zones, "node").withColumnRenamed("node", "branch"), "branch").select("gate", "branch", "zonas", *TOTALS)
    more = several.where(~is_external(F.col("lost"))).join(graph.customers.withColumnRenamed("zone", "lost"), "lost").groupBy("gate").agg(
        F.count(F.lit(1)).alias("zonas"), *[F.sum(c).alias(c) for c in TOTALS])
    return one.unionByName(more.select("gate", F.lit(None).cast(graph.forest.schema["node"].dataType).alias("branch"), "zonas", *TOTALS))


def _rooted(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame], Cuts]:
    closed = edges.where(~F.col("open")).select("edge_id", "src", "dst")
    forest = materialise(breadth_first(closed, source_table(sources, edges)), "forest")
    order, jumps = subtree_order(forest), jump_tables(forest)
    return forest, order, jumps, Cuts(closed, forest, order, jumps)


def node_downstream(edges: DataFrame, sources: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, lost: nodes that have supply only through ``node`` (itself included) (N6); for totals see ``node_totals``."""
    forest, _, jumps, cuts = _rooted(edges, sources)
    below = ancestors_of(forest, jumps).select(F.col("node").alias("lost"), F.col("anc").alias("cut"), "branch")
    below = below.join(cuts.branches.select("cut", "branch"), ["cut", "branch"]).select(F.col("cut").alias("node"), "lost")
    found = below.unionByName(forest.select("node", F.col("node").alias("lost")))
    if nodes is not None:
        found = found.join(nodes.select("node"), "node", "left_semi")
    return found.where(~is_external(F.col("node")) & ~is_external(F.col("lost")))


def node_totals(edges: DataFrame, sources: DataFrame, values: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """node, n (nodes that have supply only through it, itself included) and sums of ``columns`` of ``values`` (node, columns) over them."""
    forest, order, _, cuts = _rooted(edges, sources)
    own = forest.where(~is_external(F.col("node"))).select("node", F.lit(1).cast("long").alias("n"))
    columns = columns or []
    if values is not None:
        own = own.join(values.select("node", *columns), "node", "left").na.fill(0, columns)
    own = materialise(own, "own")
    sums = subtree_sums(order, own, ["n", *columns], wanted=cuts.branches.select(F.col("branch").alias("node")))
    held = cuts.branches.select(F.col("cut").alias("node"), "branch").join(sums.withColumnRenamed("node", "branch"), "branch").drop("branch")
    both = held.unionByName(own.select("node", "n", *columns)).groupBy("node").agg(*[F.sum(c).alias(c) for c in ["n", *columns]])
    return both.where(~is_external(F.col("node")))


def fault_footprint(graph: ZoneGraph) -> DataFrame:
    """Per zone: feeding source, recloser (first switch on the path), indicating switches in order,
    zones and customers without supply while the recloser is open (N14)."""
    paths = zone_paths(graph)
    per_zone = paths.groupBy("zone").agg(
        F.min_by("gate", F.struct("position", "gate")).alias("religador"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "gate"))), lambda s: s["gate"]), ";").alias("indicacoes"),
        F.max_by("gate", F.struct("position", "gate")).alias("ultima_indicacao"),
    )
    dark = switch_totals(graph).select(
        F.col("gate").alias("religador"), F.col("n_nodes").alias("nos_sem_tensao"), (F.col("ucbt") + F.col("ucmt")).alias("clientes_sem_tensao")
    )
    return per_zone.join(graph.forest.select(F.col("node").alias("zone"), F.col("source").alias("fonte")), "zone").join(dark, "religador", "left").select(
        "zone", "fonte", "religador", "indicacoes", "ultima_indicacao",
        F.coalesce("nos_sem_tensao", F.lit(0)).alias("nos_sem_tensao"),
        F.coalesce("clientes_sem_tensao", F.lit(0)).alias("clientes_sem_tensao"),
    )


def reclose_effect(graph: ZoneGraph, isolation: Isolation, footprint: DataFrame) -> DataFrame:
    """Per zone: may the recloser close after isolation, and what that brings back."""
    inside = isolation.boundary.select("zone", F.col("gate").alias("religador"), F.lit(True).alias("_b"))
    base = footprint.select("zone", "religador").join(inside, ["zone", "religador"], "left").withColumn(
        "religar", F.col("_b").isNull()
    ).drop("_b")
    own = graph.customers.select("zone", F.col("n_nodes").alias("_n"), (F.col("ucbt") + F.col("ucmt")).alias("_c"))
    held = switch_totals(graph).select(F.col("gate").alias("religador"), F.col("branch").alias("_top"), F.col("n_nodes").alias("nos"), (F.col("ucbt") + F.col("ucmt")).alias("n"))
    back = base.where("religar").join(held, "religador")
    # behind a switch with one link hang the zone and all that it takes along: the rest comes back
    dark = piece_totals(graph, isolation).groupBy(F.col("cut").alias("zone")).agg(F.sum("n_nodes").alias("_dn"), (F.sum("ucbt") + F.sum("ucmt")).alias("_dc"))
    few = materialise(isolation.single.select(F.col("cut").alias("zone")).distinct().unionByName(
        back.where(F.col("_top").isNull()).select("zone")).distinct(), "few")
    plain = back.join(few, "zone", "left_anti").join(own, "zone").join(dark, "zone", "left").select(
        "zone", (F.col("nos") - F.col("_n") - F.coalesce("_dn", F.lit(0))).alias("nos_religados"), (F.col("n") - F.col("_c") - F.coalesce("_dc", F.lit(0))).alias("clientes_religados"))
    totals = plain
    if not few.isEmpty():
        below = switch_downstream(graph).select(F.col("gate").alias("religador"), "lost")
        listed = back.join(few, "zone", "left_semi").join(below, "religador").where(F.col("lost") != F.col("zone")).join(
            isolation.single.select(F.col("cut").alias("zone"), "lost"), ["zone", "lost"], "left_anti"
        ).join(graph.customers.select(F.col("zone").alias("lost"), "n_nodes", (F.col("ucbt") + F.col("ucmt")).alias("_c")), "lost")
        totals = plain.unionByName(listed.groupBy("zone").agg(F.sum("n_nodes").alias("nos_religados"), F.sum("_c").alias("clientes_religados")))
    return base.join(totals, "zone", "left").select(
        "zone", "religador", "religar", F.coalesce("nos_religados", F.lit(0)).alias("nos_religados"),
        F.coalesce("clientes_religados", F.lit(0)).alias("clientes_religados"),
    )


def _only_paths(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Breadth-first forest of the closed network, and the sources whose island is a tree of its own.

    In such an island no closed edge is left out of the forest, nothing but a switch is open, there is one start node
    and no external node: between any two nodes there is one path, whatever is switched off.
    """
    closed = edges.where(~F.col("open"))
    forest = materialise(breadth_first(closed.select("edge_id", "src", "dst"), source_table(sources, edges)), "forest")
    ends = off_tree_edges(closed.select("edge_id", "src", "dst"), forest).select("src", "dst").unionByName(
        edges.where(F.col("open") & (F.col("kind") != SWITCH)).select("src", "dst"))
    marked = ends.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("_m", F.lit(True))
    islands = forest.join(marked, "node", "left").groupBy("source").agg(
        F.count_if(F.col("_m") | is_external(F.col("node"))).alias("_bad"), F.count_if(F.col("hops") == 0).alias("_starts"))
    return forest, materialise(islands.where("_bad = 0 and _starts = 1").select("source"), "trees")


def _with_end(rows: DataFrame, nodes: DataFrame, end: str, out: str) -> DataFrame:
    return rows.join(nodes.select(F.col("node").alias(end), F.col("zone").alias(out)), end)


def _tree_walks(
    graph: ZoneGraph, isolation: Isolation, edges: DataFrame, forest: DataFrame, plain: DataFrame
) -> DataFrame:
    """zone, chave, node, length of the farthest path of the options (``plain``: zone, chave, fonte) between two trees.

    The way to the closed switch lies in the source's own tree, whose lengths are taken once for all options. Only the
    recovered piece is walked per option, away from the switch; lengths are added in the order of the path.
    """
    keys = ["zone", "chave"]
    weight = F.coalesce("comp", F.lit(0.0)).alias("weight")
    steps = forest.where(F.col("via").isNotNull()).select("node", "parent", F.col("via").alias("edge_id"), "hops", F.least("node", "parent").alias("_lo"), F.greatest("node", "parent").alias("_hi")).join(
        edges.select("edge_id", F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi"), weight), ["edge_id", "_lo", "_hi"])
    own_steps = materialise(steps.select("node", "parent", "hops", "weight"), "steps")

    # the switch has one end without supply and one with it, outside the faulted zone
    gate = edges.where(F.col("kind") == SWITCH).select(F.col("edge_id").alias("chave"), weight, F.explode(F.array(
        F.struct(F.col("src").alias("x"), F.col("dst").alias("y")), F.struct(F.col("dst").alias("x"), F.col("src").alias("y")))).alias("_s")).select("chave", "weight", "_s.*")
    sides = materialise(_with_end(_with_end(plain.join(gate, "chave"), graph.zones, "x", "zx"), graph.zones, "y", "zy").where(F.col("zy") != F.col("zone")), "sides")
    lost = materialise(lost_at(graph, isolation, sides.select(F.explode(F.array("zx", "zy")).alias("node"))).select(F.col("cut").alias("zone"), "lost"), "lost")
    entry = materialise(sides.join(lost.withColumnRenamed("lost", "zx"), ["zone", "zx"], "left_semi").join(
        lost.withColumnRenamed("lost", "zy"), ["zone", "zy"], "left_anti").join(
        forest.select(F.col("node").alias("y"), F.col("source").alias("fonte")), ["y", "fonte"], "left_semi").select(*keys, "x", "y", "weight"), "entry")

    # lengths along the forest, one level after the other
    level = forest.where("hops = 0").select("node", F.lit(0.0).alias("length"))
    deepest = own_steps.agg(F.coalesce(F.max("hops"), F.lit(0))).first()[0]
    lengths = []
    for hop in range(1, deepest + 1):
        lengths.append(level)
        level = own_steps.where(F.col("hops") == hop).join(level.withColumnRenamed("node", "parent"), "parent").select("node", (F.col("length") + F.col("weight")).alias("length"))
        if hop % 4 == 0:
            level = materialise(level, "lengths")
    lengths = materialise(reduce(DataFrame.unionByName, [*lengths, level]), "lengths")

    near = own_steps.select(F.explode(F.array(
        F.struct(F.col("node").alias("a"), F.col("parent").alias("b")), F.struct(F.col("parent").alias("a"), F.col("node").alias("b")))).alias("_p"), "weight").select("_p.*", "weight")
    near = materialise(_with_end(near, graph.zones, "b", "zb"), "near")

    def onward(rows: DataFrame) -> DataFrame:
        return rows.join(near.withColumnRenamed("a", "node"), "node").where((F.col("zb") != F.col("zone")) & (F.col("b") != F.col("parent"))).select(
            *keys, F.col("b").alias("node"), F.col("node").alias("parent"), (F.col("length") + F.col("weight")).alias("length"))

    def farthest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max(F.struct("length", "node")).alias("_t"))

    # of the nodes walked only the farthest stay; a level is dropped when the next is written
    entered = materialise(entry.join(lengths.withColumnRenamed("node", "y"), "y").select(*keys, "x", "y", (F.col("length") + F.col("weight")).alias("start")), "entered")
    frontier, held = entered.select(*keys, F.col("x").alias("node"), F.col("y").alias("parent"), F.col("start").alias("length")), None
    ends = [materialise(farthest(frontier), "ends")]
    while True:
        # two steps per written table
        first = onward(frontier)
        pair = materialise(first.withColumn("_k", F.lit(1)).unionByName(onward(first).withColumn("_k", F.lit(2))), "front")
        discard(held)
        ends.append(materialise(farthest(pair), "ends"))
        frontier, held = pair.where("_k = 2").drop("_k"), pair
        if frontier.isEmpty():
            break
    discard(held)
    far = materialise(reduce(DataFrame.unionByName, ends).groupBy(*keys).agg(F.max("_t").alias("_t")).select(*keys, F.col("_t.node").alias("t")).join(
        entered, keys), "far")

    # the path as ancestors of its ends: up from the switch to the source, and between both ends in the piece
    asked = far.select(F.explode(F.array("x", "y", "t")).alias("node")).distinct()
    up = ancestors_of(asked, jump_tables(forest)).select("node", "anc").unionByName(asked.select("node", F.col("node").alias("anc")))
    up = materialise(up, "up")
    before = far.select(*keys, F.col("y").alias("node")).join(up, "node").select(*keys, F.col("anc").alias("node")).join(lengths, "node").select(*keys, "node", "length")
    both = far.select(*keys, F.explode(F.array(F.struct(F.col("x").alias("node"), F.lit(True).alias("_x")), F.struct(F.col("t").alias("node"), F.lit(False).alias("_x")))).alias("_s")).select(
        *keys, "_s.*").join(up, "node").groupBy(*keys, F.col("anc").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.max("_x").alias("_x"))
    level = forest.select("node", "hops").join(own_steps.select("node", "weight"), "node", "left")
    both = materialise(both.join(level, "node"), "both")
    turn = both.groupBy(*keys).agg(F.max(F.when(F.col("_n") == 2, F.col("hops"))).alias("_turn"), F.max(F.when(F.col("_x"), F.col("hops"))).alias("_first"))
    rise = F.col("_first") - F.col("hops")
    inside = both.join(turn, keys).where("_n = 1 or hops = _turn").withColumn(
        "_at", F.when(F.col("_x"), rise).otherwise(F.col("_first") + F.col("hops") - 2 * F.col("_turn"))).join(far.select(*keys, "start"), keys)
    # one option's path at a time; its lengths are added in the order of the path
    path = Window.partitionBy(*keys).orderBy("_at")
    added = F.when(F.col("_at") == 0, F.col("start")).when(F.col("_x"), F.lag("weight").over(path)).otherwise(F.col("weight"))
    inside = inside.withColumn("_w", added).select(
        *keys, "node", F.sum("_w").over(path.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("length"))
    return before.unionByName(inside)


def _searched_walks(graph: ZoneGraph, isolation: Isolation, edges: DataFrame, sources: DataFrame, chosen: DataFrame) -> DataFrame:
    """zone, chave, node, length of the farthest path of each option, searched in the zones that belong to it."""
    keys = ["zone", "chave"]
    pairs = lost_at(graph, isolation).join(chosen.select(F.col("zone").alias("cut")).distinct(), "cut", "left_semi")
    pairs = materialise(pairs, "pairs")
    recovered = chosen.select(F.col("zone").alias("cut"), F.col("chave").alias("gate")).join(
        recovered_components(graph, isolation), ["cut", "gate"]
    ).join(pairs, ["cut", "component"]).select(F.col("cut").alias("zone"), F.col("gate").alias("chave"), F.col("lost").alias("z"))
    gone = pairs.select(F.col("cut").alias("zone"), F.col("lost").alias("z"))
    own = chosen.join(graph.forest.select(F.col("source").alias("fonte"), F.col("node").alias("z")), "fonte").where(
        F.col("z") != F.col("zone")
    ).join(gone, ["zone", "z"], "left_anti").select(*keys, "z")
    members = own.unionByName(recovered).distinct().join(
        graph.zones.select("node", F.col("zone").alias("z")), "z"
    ).select(*keys, "node")
    members = materialise(members, "members")
    barrier = isolation.boundary.select("zone", F.col("gate").alias("edge_id"), F.lit(True).alias("_cut"))
    usable = (
        edges.select("edge_id", "kind", "src", "dst", F.coalesce("comp", F.lit(0.0)).alias("weight"), "open")
        .join(members.withColumnRenamed("node", "src"), "src")
        .join(members.withColumnRenamed("node", "dst"), [*keys, "dst"])
        .join(barrier, ["zone", "edge_id"], "left")
        .where((F.col("kind") != SWITCH) | (F.col("edge_id") == F.col("chave")) | (~F.col("open") & F.col("_cut").isNull()))
    )
    seeds = chosen.join(sources.select(F.col("ctmt").alias("fonte"), "node"), "fonte").select(*keys, "node")
    paths = shortest_paths(usable.select(*keys, "src", "dst", "weight"), seeds, keys)
    ends = recovered.join(graph.zones.select("node", F.col("zone").alias("z")), "z").join(paths, [*keys, "node"]).groupBy(*keys).agg(
        F.max(F.struct("length", "node", "parent")).alias("_t")
    )
    walked = [materialise(ends.select(*keys, "_t.node", "_t.length", "_t.parent"), "walk")]
    while True:
        above = walked[-1].where(F.col("parent").isNotNull()).select(*keys, F.col("parent").alias("node"))
        step = materialise(above.join(paths, [*keys, "node"]).select(*keys, "node", "length", "parent"), "walk")
        if step.isEmpty():
            break
        walked.append(step)
    return reduce(DataFrame.unionByName, walked).select(*keys, "node", "length")


def voltage_profile(
    graph: ZoneGraph, isolation: Isolation, edges: DataFrame, sources: DataFrame, chosen: DataFrame, voltages: DataFrame
) -> DataFrame:
    """Voltage along the longest path that each chosen option transfers.

    ``chosen``: zone, chave, fonte (a subset of the options); ``voltages``: barra, v_pu of the phase
    nodes. The far end is the recovered node of the greatest length (then name); result: zone, chave,
    barra, distancia_m, v_pu. Options between two tree-shaped islands have one path and are walked along
    the trees; only for the others are the source's own zones and the recovered ones searched.
    """
    keys = ["zone", "chave"]
    chosen = materialise(chosen.select(*keys, "fonte").distinct(), "chosen")
    forest, trees = _only_paths(edges, sources)
    home = graph.forest.select(F.col("node").alias("zone"), "source").join(trees, "source", "left_semi").select("zone")
    odd = isolation.single.select(F.col("cut").alias("zone")).unionByName(isolation.refed.select(F.col("cut").alias("zone"))).distinct()
    alone = edges.where(F.col("gate").isNotNull()).groupBy(F.col("gate").alias("chave")).agg(
        F.count(F.lit(1)).alias("_n"), F.max((F.col("kind") == SWITCH) & (F.col("edge_id") == F.col("gate"))).alias("_own")).where("_n = 1 and _own")
    plain = materialise(chosen.join(trees.withColumnRenamed("source", "fonte"), "fonte", "left_semi").join(home, "zone", "left_semi").join(
        odd, "zone", "left_anti").join(alone, "chave", "left_semi"), "plain")
    rest = materialise(chosen.join(plain.select(*keys), keys, "left_anti"), "searched")
    paths = [_tree_walks(graph, isolation, edges, forest, plain)] if not plain.isEmpty() else []
    if not paths or not rest.isEmpty():
        paths.append(_searched_walks(graph, isolation, edges, sources, rest))
    lowest = voltages.groupBy(F.lower("barra").alias("_b")).agg(F.min("v_pu").alias("v_pu"))
    return reduce(DataFrame.unionByName, paths).withColumn("_b", F.lower("node")).join(lowest, "_b", "left").select(
        *keys, F.col("node").alias("barra"), round_to(F.col("length"), 1).alias("distancia_m"), "v_pu"
    )


def step_sequence(options: DataFrame, isolation: Isolation, footprint: DataFrame | None = None) -> DataFrame:
    """Safe order of steps per option (N13): open the boundary, reclose, close the open switch.

    With ``footprint`` the recloser is treated as tripped by the fault: it is not opened again when
    it is part of the boundary, and closes before the tie only when it is not.
    Result: zone, chave, step, action, switch_id.
    """

    def step(action: str, switch) -> object:
        return F.struct(F.lit(action).alias("action"), switch.alias("switch_id"))

    opens = isolation.boundary
    close = step("fechar", F.col("chave"))
    if footprint is not None:
        trip = footprint.select("zone", "religador")
        opens = opens.join(trip, "zone", "left").where(~F.coalesce(F.col("gate") == F.col("religador"), F.lit(False)))
    listed = opens.groupBy("zone").agg(F.array_sort(F.collect_list("gate")).alias("_open"))
    rows = options.select("zone", "chave").join(listed, "zone", "left")
    opening = F.transform(F.coalesce("_open", F.array().cast("array<string>")), lambda g: F.struct(F.lit("abrir").alias("action"), g.alias("switch_id")))
    if footprint is None:
        sequence = F.concat(opening, F.array(close))
    else:
        inside = isolation.boundary.select("zone", F.col("gate").alias("religador"), F.lit(True).alias("_in"))
        rows = rows.join(trip, "zone", "left").join(inside, ["zone", "religador"], "left")
        again = F.when(
            F.col("religador").isNotNull() & F.col("_in").isNull(), F.array(step("fechar", F.col("religador")))
        ).otherwise(F.array().cast("array<struct<action:string,switch_id:string>>"))
        sequence = F.concat(opening, again, F.array(close))
    return rows.select("zone", "chave", F.posexplode(sequence).alias("step", "_s")).select(
        "zone", "chave", (F.col("step") + 1).alias("step"), "_s.action", "_s.switch_id"
    )


__all__ = [
    "EXTERNAL", "Isolation", "ZoneGraph", "boundaries", "fault_footprint", "isolate_zones", "isolation_table",
    "lost_at", "lost_ends", "node_downstream", "node_totals", "piece_regions", "piece_totals", "reclose_effect", "recovered_components", "restoration_options", "segment_zones",
    "source_load", "step_sequence", "sum_customers", "switch_downstream", "switch_totals", "voltage_profile", "zone_graph", "zone_labels", "zone_paths",
]
