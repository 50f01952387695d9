"""The switch-aware medium-voltage network: nodes, edges, sources, ties, state, customers.

Edge columns: edge_id, kind (``trecho`` segment, ``chave`` switch, ``tie`` bridge), src, dst, ctmt,
ctmt_viz, comp, tip_cnd, normal, open, tlcd, tip_unid, external, gate (the switch that controls the
edge: itself for a switch, the ring switch for a gated tie, null otherwise), dist_m.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.columns import is_open, is_remote, number, round_to, text_or_empty, text_or_null
from gridlake.functions.geo import distance_to_edges, with_shape
from gridlake.functions.keyed import first_per_key
from gridlake.operators.components import connected_components
from gridlake.operators.forest import breadth_first
from gridlake.session import materialise

SEGMENT, SWITCH, TIE = "trecho", "chave", "tie"
EXTERNAL = "EXT:"
EDGE_COLUMNS = [
    "edge_id", "kind", "src", "dst", "ctmt", "ctmt_viz", "comp", "tip_cnd", "normal", "open", "tlcd",
    "tip_unid", "external", "gate", "dist_m",
]
CUSTOMER_COLUMNS = ["ucbt", "ucmt", "trafos", "kva"]


def _optional(df: DataFrame, name: str, kind: str = "string"):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def is_external(node) -> object:
    return F.startswith(node, F.lit(EXTERNAL))


def external_name(node: str) -> Column:
    """The whole name behind the prefix of an external node."""
    return F.substr(F.col(node), F.lit(len(EXTERNAL) + 1))


def candidate_edges(segments: DataFrame, switches: DataFrame) -> DataFrame:
    """Segments and switches as edge candidates, rejects included."""

    def shape(df: DataFrame, kind: str, order: int) -> DataFrame:
        switch = kind == SWITCH
        opened = is_open(_optional(df, "P_N_OPE")) if switch else F.lit(False)
        return df.select(
            text_or_empty(F.col("COD_ID")).alias("edge_id"), F.lit(kind).alias("kind"),
            text_or_empty(F.col("PAC_1")).alias("src"), text_or_empty(F.col("PAC_2")).alias("dst"),
            text_or_empty(F.col("CTMT")).alias("ctmt"), F.lit(None).cast("string").alias("ctmt_viz"),
            (F.lit(0.0) if switch else F.coalesce(number(_optional(df, "COMP")), F.lit(0.0))).alias("comp"),
            (F.lit("") if switch else text_or_empty(_optional(df, "TIP_CND"))).alias("tip_cnd"),
            (F.when(opened, "NA").otherwise("NF") if switch else F.lit(None).cast("string")).alias("normal"),
            opened.alias("open"),
            (is_remote(_optional(df, "TLCD")) if switch else F.lit(False)).alias("tlcd"),
            (text_or_empty(_optional(df, "TIP_UNID")) if switch else F.lit("")).alias("tip_unid"),
            F.lit(False).alias("external"),
            (text_or_empty(F.col("COD_ID")) if switch else F.lit(None).cast("string")).alias("gate"),
            F.lit(None).cast("double").alias("dist_m"), F.lit(order).alias("_order"),
        )

    return shape(segments, SEGMENT, 0).unionByName(shape(switches, SWITCH, 1))


def build_edges(segments: DataFrame, switches: DataFrame) -> DataFrame:
    """Edges of the network (N1): blank or equal ends are dropped; on an unordered node pair the
    first edge wins, segments before switches, then by code."""
    usable = candidate_edges(segments, switches).where(
        (F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))
    )
    paired = usable.withColumn("_lo", F.least("src", "dst")).withColumn("_hi", F.greatest("src", "dst"))
    return first_per_key(paired, ["_lo", "_hi"], ["_order", "edge_id", "src"]).select(*EDGE_COLUMNS)


def rejected_edges(segments: DataFrame, switches: DataFrame) -> DataFrame:
    """Edges left out by :func:`build_edges` with the reason."""
    rows = candidate_edges(segments, switches)
    bad = (F.col("src") == "") | (F.col("dst") == "") | (F.col("src") == F.col("dst"))
    blank = rows.where(bad).select("edge_id", "kind", "ctmt", F.lit("pac_ausente_ou_repetido").alias("reason"))
    paired = rows.where(~bad).withColumn("_lo", F.least("src", "dst")).withColumn("_hi", F.greatest("src", "dst"))
    best = paired.groupBy("_lo", "_hi").agg(F.min(F.struct("_order", "edge_id", "src")).alias("_w"))
    losers = paired.join(best, ["_lo", "_hi"]).where(
        F.struct("_order", "edge_id", "src") != F.col("_w")
    ).select("edge_id", "kind", "ctmt", F.lit("par_de_pac_ja_usado").alias("reason"))
    return blank.unionByName(losers)


def build_nodes(edges: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """node, ctmt (of its first edge), kind ``pac`` / ``externo``, x, y."""
    order = F.when(F.col("kind") == SEGMENT, 0).when(F.col("kind") == SWITCH, 1).otherwise(2)
    ends = edges.select(
        F.explode(F.array("src", "dst")).alias("node"), F.struct(order.alias("o"), "edge_id", "ctmt").alias("_e")
    )
    nodes = ends.groupBy("node").agg(F.min("_e").alias("_e")).select(
        "node",
        F.when(is_external(F.col("node")), external_name("node")).otherwise(F.col("_e.ctmt")).alias("ctmt"),
        F.when(is_external(F.col("node")), F.lit("externo")).otherwise(F.lit("pac")).alias("kind"),
    )
    if positions is None:
        return nodes.select("*", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    return nodes.join(positions, "node", "left")


def node_positions(segments: DataFrame, switches: DataFrame) -> DataFrame:
    """node, x, y: the segment end, else the switch point (first by kind, then code)."""

    def places(df: DataFrame, order: int) -> DataFrame:
        shaped = with_shape(df.select("COD_ID", "PAC_1", "PAC_2", "geometry")).where(F.size("shape.parts") > 0)
        first, last = F.col("shape.parts")[0], F.element_at("shape.parts", -1)
        pair = F.array(
            F.struct(text_or_null(F.col("PAC_1")).alias("node"), first["x1"].alias("x"), first["y1"].alias("y")),
            F.struct(text_or_null(F.col("PAC_2")).alias("node"), last["x2"].alias("x"), last["y2"].alias("y")),
        )
        return shaped.select(F.explode(pair).alias("_p"), F.lit(order).alias("_o"), F.col("COD_ID").cast("string").alias("_c")).select("_p.*", "_o", "_c")

    every = places(segments, 0).unionByName(places(switches, 1)).where(F.col("node").isNotNull())
    return first_per_key(every, ["node"], ["_o", "_c", "x", "y"]).select("node", "x", "y")


def feeder_sources(
    feeders: DataFrame, edges: DataFrame, positions: DataFrame | None = None, substations: DataFrame | None = None
) -> DataFrame:
    """ctmt, node, fallback.

    The declared start node counts when it is in the network; otherwise the feeder's segment node
    nearest to its substation polygon, or the smallest node id without polygon or positions.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    wanted = feeders.select(
        text_or_empty(F.col("COD_ID")).alias("ctmt"), text_or_null(_optional(feeders, "PAC_INI")).alias("node"),
        text_or_null(_optional(feeders, "SUB")).alias("sub"),
    )
    declared = wanted.join(nodes, "node", "left_semi").select("ctmt", "node", F.lit(False).alias("fallback"))
    missing = wanted.join(declared.select("ctmt"), "ctmt", "left_anti")
    own = edges.where(F.col("kind") == SEGMENT).select("ctmt", F.explode(F.array("src", "dst")).alias("node")).distinct()
    candidates = own.join(missing.select("ctmt", "sub"), "ctmt")
    distance = F.lit(None).cast("double")
    if positions is not None and substations is not None:
        polygons = with_shape(substations.select("COD_ID", "geometry")).select(
            F.col("COD_ID").cast("string").alias("sub"), F.col("shape.edges").alias("_edges")
        ).where(F.size("_edges") > 0)
        candidates = candidates.join(positions, "node", "left").join(polygons, "sub", "left")
        distance = F.when(F.col("x").isNotNull() & F.col("_edges").isNotNull(), distance_to_edges(F.col("x"), F.col("y"), F.col("_edges")))
    chosen = candidates.withColumn("_d", distance).groupBy("ctmt").agg(
        F.min(F.struct(F.col("_d").isNull(), F.col("_d"), F.col("node"))).alias("_b")
    ).select("ctmt", F.col("_b.node").alias("node"), F.lit(True).alias("fallback"))
    return declared.unionByName(chosen)


def add_ties(edges: DataFrame, ties: DataFrame, feeders: DataFrame, *, keep_yard: bool = False) -> DataFrame:
    """Network edges plus tie bridges and external switches.

    An own open switch is bridged from its outer node (the end outside its feeder's segment nodes;
    both inside means a gated tie at ``PAC_2``; none inside means ``PAC_2``) to the neighbour's node,
    or to ``EXT:<feeder>`` when the neighbour is not loaded. A switch of a feeder that is not loaded
    becomes one open external switch at its nearest node.
    """
    loaded = feeders.select(text_or_empty(F.col("COD_ID")).alias("_f")).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("_node")).distinct()
    rows = ties.select(
        text_or_empty(F.col("COD_ID")).alias("cod"), text_or_empty(F.col("CTMT")).alias("dono"),
        text_or_empty(F.col("CTMT_VIZ")).alias("viz"), text_or_empty(F.col("PAC_VIZ")).alias("pac_viz"),
        is_remote(_optional(ties, "TLCD")).alias("tlcd"), text_or_empty(_optional(ties, "TIP_UNID")).alias("tip_unid"),
        F.coalesce(_optional(ties, "EM_SUB", "boolean").cast("boolean"), F.lit(False)).alias("em_sub"),
        F.coalesce(number(_optional(ties, "DIST_M")), F.lit(0.0)).alias("dist_m"),
    )
    if not keep_yard:
        rows = rows.where(~F.col("em_sub"))
    flag = F.lit(True)
    rows = (
        rows.join(loaded.select(F.col("_f").alias("dono"), flag.alias("_own")), "dono", "left")
        .join(loaded.select(F.col("_f").alias("viz"), flag.alias("_near")), "viz", "left")
        .join(nodes.select(F.col("_node").alias("pac_viz"), flag.alias("_viz_node")), "pac_viz", "left")
    )
    switches = edges.where(F.col("kind") == SWITCH).select(
        F.col("edge_id").alias("cod"), F.col("src").alias("u"), F.col("dst").alias("v"), F.col("open").alias("_open")
    )
    inside = edges.where(F.col("kind") == SEGMENT).select("ctmt", F.explode(F.array("src", "dst")).alias("_n")).distinct()

    own = rows.where("_own").join(switches, "cod")
    for end, name in (("u", "_u_in"), ("v", "_v_in")):
        own = own.join(
            inside.select(F.col("ctmt").alias("dono"), F.col("_n").alias(end), flag.alias(name)), ["dono", end], "left"
        )
    u_in, v_in = F.coalesce("_u_in", F.lit(False)), F.coalesce("_v_in", F.lit(False))
    ring = u_in & v_in
    own = own.select(
        "cod", "dono", "viz", "pac_viz", "tlcd", "tip_unid", "em_sub", "dist_m", "_open", ring.alias("ring"),
        F.when(v_in & ~u_in, F.col("u")).otherwise(F.col("v")).alias("src"),
        F.when(F.coalesce("_near", F.lit(False)) & F.coalesce("_viz_node", F.lit(False)), F.col("pac_viz"))
        .otherwise(F.concat(F.lit(EXTERNAL), F.col("viz"))).alias("dst"),
    ).where(F.col("src") != F.col("dst"))
    pair = [F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi")]
    taken = edges.select(*pair)
    bridges = first_per_key(own.select("*", *pair), ["_lo", "_hi"], ["dist_m", "cod", "viz"]).join(
        taken, ["_lo", "_hi"], "left_anti"
    )
    none = F.lit(None).cast("string")
    bridge_edges = bridges.select(
        F.concat("cod", F.lit("|"), "viz").alias("edge_id"), F.lit(TIE).alias("kind"), "src", "dst",
        F.col("dono").alias("ctmt"), F.col("viz").alias("ctmt_viz"), F.lit(0.0).alias("comp"), F.lit("").alias("tip_cnd"),
        none.alias("normal"), (F.col("ring") & F.col("_open")).alias("open"), "tlcd", "tip_unid",
        F.lit(False).alias("external"), F.when(F.col("ring"), F.col("cod")).alias("gate"), "dist_m",
    )
    foreign = rows.where(F.col("_own").isNull() & F.col("_near") & F.col("_viz_node")).join(
        switches.select("cod"), "cod", "left_anti"
    )
    nearest = first_per_key(foreign.select("cod", "dono", "viz", "pac_viz", "tlcd", "tip_unid", "dist_m"), ["cod"], ["dist_m", "viz", "pac_viz"])
    external_edges = nearest.select(
        F.col("cod").alias("edge_id"), F.lit(SWITCH).alias("kind"), F.col("pac_viz").alias("src"),
        F.concat(F.lit(EXTERNAL), F.col("dono")).alias("dst"), F.col("dono").alias("ctmt"), F.col("viz").alias("ctmt_viz"),
        F.lit(0.0).alias("comp"), F.lit("").alias("tip_cnd"), F.lit("NA").alias("normal"), F.lit(True).alias("open"),
        "tlcd", "tip_unid", F.lit(True).alias("external"), F.col("cod").alias("gate"), "dist_m",
    )
    return reduce(DataFrame.unionByName, [edges, bridge_edges, external_edges])


def tie_switches(edges: DataFrame) -> DataFrame:
    """Tie listing with state: one row per switch and neighbour."""
    switch_state = edges.where((F.col("kind") == SWITCH) & ~F.col("external")).select(
        F.col("edge_id").alias("chave"), F.col("open").alias("aberta")
    )
    bridges = edges.where(F.col("kind") == TIE).select(
        F.substring_index("edge_id", "|", 1).alias("chave"), "ctmt", "ctmt_viz", F.col("src").alias("pac"),
        F.col("dst").alias("pac_viz"), "tlcd", "tip_unid", F.lit(False).alias("externa"),
        F.col("gate").isNotNull().alias("ambigua"), "dist_m",
    ).join(switch_state, "chave")
    foreign = edges.where(F.col("external")).select(
        F.col("edge_id").alias("chave"), "ctmt", "ctmt_viz", F.col("src").alias("pac"), F.col("src").alias("pac_viz"),
        "tlcd", "tip_unid", F.lit(True).alias("externa"), F.lit(False).alias("ambigua"), "dist_m", F.col("open").alias("aberta"),
    )
    return bridges.unionByName(foreign)


# --- state ---------------------------------------------------------------------------------------


def apply_plan(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """State after a switching plan (N12). ``steps``: step, action (``abrir`` / ``fechar``), switch_id;
    the last action of a switch wins. Gated ties follow their switch."""
    final = steps.groupBy("switch_id").agg(F.max_by("action", "step").alias("_a")).select(
        F.col("switch_id").alias("gate"), (F.col("_a") == "abrir").alias("_to")
    )
    return edges.join(final, "gate", "left").withColumn("open", F.coalesce("_to", "open")).select(*EDGE_COLUMNS)


def reset_plan(edges: DataFrame) -> DataFrame:
    """Back to the normal position; a gated tie takes its switch's position."""
    normal = edges.where(F.col("kind") == SWITCH).groupBy("gate").agg(F.max(F.col("normal") == "NA").alias("_na"))
    return edges.join(normal, "gate", "left").withColumn("open", F.coalesce("_na", F.lit(False))).select(*EDGE_COLUMNS)


def state_difference(edges: DataFrame) -> DataFrame:
    """Steps from the normal position to the current one."""
    moved = edges.where((F.col("kind") == SWITCH) & (F.col("open") != (F.col("normal") == "NA")))
    return moved.select(
        F.col("edge_id").alias("switch_id"), F.when(F.col("open"), "abrir").otherwise("fechar").alias("action")
    )


def source_table(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds of supply: feeder sources first (by feeder), then external neighbours. node, source, ord."""
    inner = sources.select("node", F.col("ctmt").alias("source"), F.concat(F.lit("0"), "ctmt").alias("ord"))
    outer = edges.select(F.explode(F.array("src", "dst")).alias("node")).where(is_external(F.col("node"))).distinct()
    name = external_name("node")
    return inner.unionByName(outer.select("node", name.alias("source"), F.concat(F.lit("1"), name).alias("ord")))


def energised(edges: DataFrame, sources: DataFrame, *, externals: bool = False) -> DataFrame:
    """node, fed_by for every supplied node.

    Components of the closed network come first; only components with several sources pay for a
    breadth-first search, where fewer hops win, then source order.
    """
    seeds = source_table(sources, edges)
    closed = edges.where(~F.col("open")).select("src", "dst", "edge_id")
    labels = connected_components(closed.select("src", "dst"), seeds.select("node"))
    owned = labels.join(seeds, "node").groupBy("component").agg(
        F.count_distinct("source").alias("_k"), F.min("source").alias("_one")
    )
    single = labels.join(owned.where("_k = 1"), "component").select("node", F.col("_one").alias("fed_by"))
    shared = labels.join(owned.where("_k > 1").select("component"), "component", "left_semi")
    shared = materialise(shared.select("node"), "shared")
    if shared.isEmpty():
        fed = single
    else:
        part = closed.join(shared.select(F.col("node").alias("src")), "src", "left_semi")
        forest = breadth_first(part, seeds.join(shared, "node", "left_semi"))
        fed = single.unionByName(forest.select("node", F.col("source").alias("fed_by")))
    return fed if externals else fed.where(~is_external(F.col("node")))


# --- customers -----------------------------------------------------------------------------------


def customers_per_node(
    edges: DataFrame, transformers: DataFrame, lv: DataFrame | None, mv: DataFrame | None
) -> DataFrame:
    """node, ucbt, ucmt, trafos, kva (A23): LV through the transformer, MV at its own node; only
    nodes of the network."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    trafos = transformers.select(
        text_or_empty(F.col("COD_ID")).alias("_t"), text_or_empty(F.col("PAC_1")).alias("node"),
        F.coalesce(number(_optional(transformers, "POT_NOM")), F.lit(0.0)).alias("kva"),
    )
    if lv is not None and "UNI_TR_MT" in lv.columns:
        counts = lv.groupBy(F.trim(F.col("UNI_TR_MT").cast("string")).alias("_t")).agg(F.count(F.lit(1)).alias("ucbt"))
        trafos = trafos.join(counts, "_t", "left")
    else:
        trafos = trafos.withColumn("ucbt", F.lit(0).cast("long"))
    low = trafos.groupBy("node").agg(
        F.coalesce(F.sum("ucbt"), F.lit(0)).alias("ucbt"), F.lit(0).cast("long").alias("ucmt"),
        F.count(F.lit(1)).alias("trafos"), F.sum(F.col("kva").cast("decimal(28,6)")).cast("double").alias("kva"),
    )
    if mv is not None and "PAC" in mv.columns:
        high = mv.groupBy(F.trim(F.col("PAC").cast("string")).alias("node")).agg(F.count(F.lit(1)).alias("ucmt"))
        high = high.select("node", F.lit(0).cast("long").alias("ucbt"), "ucmt", F.lit(0).cast("long").alias("trafos"), F.lit(0.0).alias("kva"))
        low = low.unionByName(high).groupBy("node").agg(
            *[F.sum(c).alias(c) for c in CUSTOMER_COLUMNS]
        )
    return low.join(nodes, "node", "left_semi")


def unmapped_customers(edges: DataFrame, transformers: DataFrame, mv: DataFrame | None) -> DataFrame:
    """Transformers and MV customers whose node is not in the network (A23): kind, id or node, count."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    lost = transformers.select(text_or_empty(F.col("PAC_1")).alias("node")).join(nodes, "node", "left_anti")
    out = lost.groupBy("node").agg(F.count(F.lit(1)).alias("n")).select(F.lit("UNTRMT").alias("layer"), "node", "n")
    if mv is None:
        return out
    high = mv.select(F.trim(F.col("PAC").cast("string")).alias("node")).join(nodes, "node", "left_anti")
    return out.unionByName(
        high.groupBy("node").agg(F.count(F.lit(1)).alias("n")).select(F.lit("UCMT_tab").alias("layer"), "node", "n")
    )


def sum_customers(rows: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """Customer totals per key."""
    return rows.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{prefix}{c}") for c in CUSTOMER_COLUMNS[:3]],
        F.coalesce(round_to(F.sum(F.col("kva").cast("decimal(28,6)")).cast("double"), 3), F.lit(0.0)).alias(f"{prefix}kva"),
    )


def network_summary(
    edges: DataFrame, nodes: DataFrame, fed: DataFrame, customers: DataFrame, cluster: DataFrame | None = None
) -> DataFrame:
    """Numbers per cluster (or per feeder without ``cluster``: ctmt -> cluster_id)."""

    def keyed(df: DataFrame) -> DataFrame:
        if cluster is None:
            return df.withColumn("cluster_id", F.col("ctmt"))
        return df.join(cluster, "ctmt")

    switch = (F.col("kind") == SWITCH) & ~F.col("external")
    from_edges = keyed(edges).groupBy("cluster_id").agg(
        F.count_if(F.col("kind") == SEGMENT).alias("trechos"),
        (F.sum(F.when(F.col("kind") == SEGMENT, F.col("comp").cast("decimal(28,6)"))).cast("double") / 1000).alias("_km"),
        F.count_if(switch).alias("chaves"),
        F.count_if(switch & (F.col("normal") == "NA")).alias("chaves_NA"),
        F.count_if(switch & (F.col("normal") == "NF")).alias("chaves_NF"),
        F.count_if((F.col("kind") == TIE) | F.col("external")).alias("ties"),
        F.count_if(F.col("external")).alias("ties_externas"),
    )
    real = keyed(nodes.where(F.col("kind") != "externo"))
    from_nodes = real.join(fed.select("node", F.lit(1).alias("_fed")), "node", "left").join(customers, "node", "left").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("nos"), F.count("_fed").alias("energizados"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CUSTOMER_COLUMNS[:3]],
        F.coalesce(F.sum(F.col("kva").cast("decimal(28,6)")).cast("double"), F.lit(0.0)).alias("kva"),
    )
    return from_nodes.join(from_edges, "cluster_id", "left").withColumn(
        "km", round_to(F.coalesce("_km", F.lit(0.0)), 3)
    ).drop("_km")


def switch_dossier(edges: DataFrame, fed: DataFrame) -> DataFrame:
    """State, normal position, remote control, both nodes and who feeds each."""
    sides = fed.select(F.col("node").alias("src"), F.col("fed_by").alias("fed_src"))
    other = fed.select(F.col("node").alias("dst"), F.col("fed_by").alias("fed_dst"))
    return edges.where(F.col("kind") == SWITCH).join(sides, "src", "left").join(other, "dst", "left").select(
        F.col("edge_id").alias("chave"), "ctmt", F.when(F.col("open"), "aberta").otherwise("fechada").alias("estado"),
        "normal", "tlcd", "tip_unid", F.col("external").alias("externa"), F.col("src").alias("pac_1"), F.col("dst").alias("pac_2"),
        "fed_src", "fed_dst",
    )


def trunk_segments(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Segments reached first past the closed switches at the source (N16): ctmt, edge_id, comp."""
    closed = edges.where((F.col("kind") == SWITCH) & ~F.col("open")).select("src", "dst")
    labels = connected_components(closed, sources.select("node"))
    heads = labels.join(sources.select("node", F.col("ctmt").alias("fonte")), "node").select("component", "fonte").distinct()
    visited = labels.join(heads, "component").select("node", "fonte")
    ends = edges.where(F.col("kind") == SEGMENT).select("edge_id", "comp", F.explode(F.array("src", "dst")).alias("node"))
    return ends.join(visited, "node").select(F.col("fonte").alias("ctmt"), "edge_id", "comp").distinct()


def longest_trunk(trunk: DataFrame) -> DataFrame:
    """Longest trunk segment per feeder, larger code on equal length; no positive length, no row (T5)."""
    best = trunk.groupBy("ctmt").agg(F.max(F.struct("comp", "edge_id")).alias("_b"))
    return best.select("ctmt", F.col("_b.edge_id").alias("edge_id"), F.col("_b.comp").alias("comp")).where(F.col("comp") > 0)


def connected_to_source(layers: list[DataFrame], feeders: DataFrame) -> DataFrame:
    """Nodes tied to a feeder's start node when every switch counts as closed, LV included.

    ``layers``: frames with PAC_1, PAC_2 (segments, switches, transformers, LV lines, LV switches,
    drops). Result: node, ctmt, connected.
    """
    pairs = reduce(
        DataFrame.unionByName,
        [
            df.select(text_or_empty(F.col("PAC_1")).alias("src"), text_or_empty(F.col("PAC_2")).alias("dst"))
            for df in layers
        ],
    ).where((F.col("src") != "") & (F.col("dst") != ""))
    labels = connected_components(pairs)
    roots = feeders.select(text_or_empty(F.col("PAC_INI")).alias("node"), text_or_empty(F.col("COD_ID")).alias("ctmt"))
    heads = labels.join(roots, "node").groupBy("component").agg(F.min("ctmt").alias("ctmt"))
    return labels.join(heads, "component", "left").select("node", "ctmt", F.col("ctmt").isNotNull().alias("connected"))
