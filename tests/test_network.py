import pytest
from pyspark.sql import functions as F

from gridlake.operators import network as net
from gridlake.operators import restoration as rst
from gridlake.operators.impact import feeder_region, node_asset_regions, node_regions, option_impact, region_totals
from gridlake.operators.forest import breadth_first
from gridlake.session import app_scratch, list_path, materialise


def only(nodes, letter):
    return {n for n in nodes if n.startswith(letter)}


@pytest.fixture(scope="module")
def grid(spark, catalog, ties):
    """The network of the two feeders that can help each other."""
    feeders = catalog.read("CTMT").where("COD_ID in ('AL1', 'BE1')")
    own = {k: catalog.read(k).where("CTMT in ('AL1', 'BE1')") for k in ("SSDMT", "UNSEMT")}
    edges = materialise(net.add_ties(net.build_edges(own["SSDMT"], own["UNSEMT"]), ties, feeders), "edges")
    sources = net.feeder_sources(feeders, edges, net.node_positions(own["SSDMT"], own["UNSEMT"]), catalog.read("SUB"))
    customers = net.customers_per_node(edges, catalog.read("UNTRMT"), catalog.read("UCBT_tab"), catalog.read("UCMT_tab"))
    return {
        "edges": edges, "sources": materialise(sources, "sources"), "customers": materialise(customers, "customers"),
        "segments": own["SSDMT"], "switches": own["UNSEMT"], "feeders": feeders,
    }


@pytest.fixture(scope="module")
def zones(grid):
    graph = rst.zone_graph(grid["edges"], grid["sources"], grid["customers"])
    return graph, rst.isolate_zones(graph)


@pytest.fixture(scope="module")
def zone_of(grid, zones):
    """Zone of every segment."""
    return {r.edge_id: r.zone for r in rst.segment_zones(grid["edges"], zones[0].zones).collect()}


def fed_by(edges, grid):
    return {r.node: r.fed_by for r in net.energised(edges, grid["sources"]).collect()}


def switched(spark, grid, *steps):
    plan = spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate(steps, 1)], "step int, action string, switch_id string")
    return net.apply_plan(grid["edges"], plan)


def test_edges_and_ties(grid):
    assert {r["kind"]: r["count"] for r in grid["edges"].groupBy("kind").count().collect()} == {"trecho": 9, "chave": 7, "tie": 2}
    ends = {r.chave: (r.pac, r.pac_viz, r.ambigua) for r in net.tie_switches(grid["edges"]).collect()}
    assert ends == {"KA2": ("A8", "B5", False), "KB2": ("B7", "A7", False)}


def test_sources_with_fallback(catalog):
    edges = net.build_edges(catalog.read("SSDMT"), catalog.read("UNSEMT"))
    positions = net.node_positions(catalog.read("SSDMT"), catalog.read("UNSEMT"))
    found = net.feeder_sources(catalog.read("CTMT"), edges, positions, catalog.read("SUB")).collect()
    assert {r.ctmt: (r.node, r.fallback) for r in found} == {"AL1": ("A0", False), "BE1": ("B0", False), "GA1": ("G1", True)}


def test_single_feeder_uses_external_neighbours(catalog, ties):
    alone = [catalog.read(k).where("CTMT = 'AL1'") for k in ("SSDMT", "UNSEMT")]
    edges = net.add_ties(net.build_edges(*alone), ties, catalog.read("CTMT").where("COD_ID = 'AL1'"))
    found = {r.edge_id: (r.kind, r.src, r.dst, r.external, r.open) for r in edges.where("dst like 'EXT:%'").collect()}
    assert found == {"KA2|BE1": ("tie", "A8", "EXT:BE1", False, False), "KB2": ("chave", "A7", "EXT:BE1", True, True)}


def test_long_external_names_stay_apart(spark):
    names = ["N" * 1199 + c for c in "ab"]
    edges = spark.createDataFrame(
        [(f"T{i}", "tie", "F", f"p{i}", f"EXT:{n}") for i, n in enumerate(names)], "edge_id string, kind string, ctmt string, src string, dst string"
    )
    assert {r.ctmt for r in net.build_nodes(edges).where("kind = 'externo'").collect()} == set(names)


def test_rejected_edges(spark):
    columns = "COD_ID string, CTMT string, PAC_1 string, PAC_2 string"
    lines = spark.createDataFrame([("L1", "F", "p", "q"), ("L2", "F", "q", "p"), ("L3", "F", "r", "r"), ("L4", "F", None, "s")], columns)
    gates = spark.createDataFrame([("W1", "F", "q", "p"), ("W2", "F", "q", "t")], columns)
    assert {r.edge_id for r in net.build_edges(lines, gates).collect()} == {"L1", "W2"}
    reasons = {r.edge_id: r.reason for r in net.rejected_edges(lines, gates).collect()}
    assert reasons == dict.fromkeys(("L2", "W1"), "par_de_pac_ja_usado") | dict.fromkeys(("L3", "L4"), "pac_ausente_ou_repetido")


def test_energised(grid):
    fed = fed_by(grid["edges"], grid)
    want = {f"A{i}": "AL1" for i in range(8)} | {f"B{i}": "BE1" for i in range(7)} | {"A8": "BE1", "B7": "AL1"}
    assert fed == want  # B8 and B9 stand alone in the yard


def test_plan_changes_state(spark, grid):
    after = switched(spark, grid, ("abrir", "KA1"), ("fechar", "KA2"))
    fed = fed_by(after, grid)
    assert fed["A3"] == "AL1" and {fed[n] for n in ("A4", "A5", "A6", "A7", "B7")} == {"BE1"}
    assert {(r.switch_id, r.action) for r in net.state_difference(after).collect()} == {("KA1", "abrir"), ("KA2", "fechar")}
    assert net.state_difference(net.reset_plan(after)).count() == 0


def test_closed_loop_with_two_sources(spark, grid):
    fed = fed_by(switched(spark, grid, ("fechar", "KA2"), ("fechar", "KB2")), grid)
    assert {fed[n] for n in ("A0", "A1", "A2", "A3", "A4")} == {"AL1"} and {fed[n] for n in ("B0", "B1", "B2", "B3", "B4")} == {"BE1"}


def test_breadth_first_has_no_bound(spark):
    n = 41
    edges = spark.createDataFrame([(i, i + 1, f"e{i}") for i in range(n)] + [(0, 0, "loop")], "src long, dst long, edge_id string")
    seeds = spark.createDataFrame([(0, "s", "0"), (n, "t", "1")], "node long, source string, ord string")
    got = {r.node: (r.source, r.hops) for r in breadth_first(edges, seeds).collect()}
    assert got == {i: ("s", i) if i <= n // 2 else ("t", n - i) for i in range(n + 1)}


def test_isolation(grid, zones, zone_of):
    graph, isolation = zones
    fault = zone_of["SA1"]
    members = {r.node: r.zone for r in graph.zones.collect()}
    assert {n for n, z in members.items() if z == fault} == {"A1", "A2", "A3"}
    assert {r.zone: r.chaves for r in rst.isolation_table(graph, isolation).collect()}[fault] == "KA0;KA1"
    lost = {r.lost for r in rst.lost_at(graph, isolation).where(F.col("cut") == fault).collect()}
    assert {n for n, z in members.items() if z in lost} == {"A4", "A5", "A6", "A7", "B7"}


def test_restoration_and_impact(catalog, grid, zones, zone_of):
    graph, isolation = zones
    options = materialise(rst.restoration_options(graph, isolation), "options")
    own = options.where(F.col("zone") == zone_of["SA1"]).orderBy("ordem").collect()
    assert [(r.chave, r.fonte, r.tlcd, r.ucbt, r.ucmt, r.clientes_fonte) for r in own] == [("KA2", "BE1", True, 4, 0, 2), ("KB2", "BE1", False, 4, 0, 2)]
    lost = rst.isolation_table(graph, isolation).select("zone", (F.col("desligados_ucbt") + F.col("desligados_ucmt")).alias("desligados"))
    recovered = rst.recovered_components(graph, isolation).join(rst.lost_at(graph, isolation), ["cut", "component"]).join(
        graph.zones.withColumnRenamed("zone", "lost"), "lost"
    ).select(F.col("cut").alias("zone"), F.col("gate").alias("chave"), "node").distinct()
    layers = {k: catalog.read(k) for k in ("UNTRMT", "UCBT_tab", "UCMT_tab")}
    impact = option_impact(
        options, recovered, lost,
        regions=node_regions(layers["UNTRMT"], layers["UCBT_tab"], layers["UCMT_tab"]),
        asset_regions=node_asset_regions(grid["segments"], grid["switches"], layers["UNTRMT"]),
        node_feeders=net.build_nodes(grid["edges"]).select("node", "ctmt"),
        feeder_regions=feeder_region(grid["feeders"], [grid["segments"], grid["switches"]]),
        totals=region_totals(layers["UCBT_tab"], layers["UCMT_tab"]),
    ).where(F.col("zone") == zone_of["SA1"]).collect()
    found = {r.chave: r for r in impact}["KA2"]
    assert (found.region, found.total_uc, found.ucs_restauradas) == ("7", 10, 4)
    assert found.consumidor_minutos > 0 and abs(found.dec_horas - found.consumidor_minutos / 10 / 60) < 1e-12


def test_voltage_profile(spark, grid, zones, zone_of):
    graph, isolation = zones
    chosen = spark.createDataFrame([(zone_of["SA1"], "KA2", "BE1")], "zone string, chave string, fonte string")
    volts = spark.createDataFrame([("a7", 0.96), ("a7", 0.97), ("b0", 1.0)], "barra string, v_pu double")
    rows = rst.voltage_profile(graph, isolation, grid["edges"], grid["sources"], chosen, volts).collect()
    away = {r.barra: r.distancia_m for r in rows}
    assert {"B0", "B1", "B2", "B3", "B4", "B5", "A8", "A6", "A5", "A7"} <= set(away)
    # SB1 + SB2 + SB3, then SA4, then SA5
    want = {"B0": 0, "B2": 94, "B4": 178, "B5": 374, "A5": 479, "A7": 590}
    assert all(abs(away[n] - d) < 0.06 for n, d in want.items()) and max(away.values()) < 590.1
    assert {r.v_pu for r in rows if r.barra == "B0"} == {1.0}


def test_paths_and_footprint(grid, zones, zone_of):
    graph, isolation = zones
    foot = rst.fault_footprint(graph)
    far = {r.zone: r for r in foot.collect()}[zone_of["SA4"]]
    assert (far.religador, far.indicacoes, far.ultima_indicacao, far.clientes_sem_tensao) == ("KA0", "KA0;KA1", "KA1", 6)
    again = {r.zone: r for r in rst.reclose_effect(graph, isolation, foot).collect()}
    assert again[zone_of["SA4"]].religar and again[zone_of["SA4"]].clientes_religados == 2 and not again[zone_of["SA1"]].religar
    options = rst.restoration_options(graph, isolation).where(F.col("zone") == zone_of["SA1"])

    def steps(*more):
        found = rst.step_sequence(options, isolation, *more).where("chave = 'KA2'").orderBy("step").collect()
        return [(s.action, s.switch_id) for s in found]

    assert steps() == [("abrir", "KA0"), ("abrir", "KA1"), ("fechar", "KA2")]
    assert steps(foot) == [("abrir", "KA1"), ("fechar", "KA2")]


def test_downstream(grid, zones):
    graph, _ = zones
    behind = rst.switch_downstream(graph).join(graph.zones.withColumnRenamed("zone", "lost"), "lost").where("gate = 'KA1'")
    assert {r.node for r in behind.collect()} == {"A4", "A5", "A6", "A7", "B7"}
    down = {}
    for r in rst.node_downstream(grid["edges"], grid["sources"]).collect():
        down.setdefault(r.node, set()).add(r.lost)
    assert down["A6"] == {"A6"} and only(down["A4"], "A") == {"A4", "A5", "A6", "A7"} and down["A7"] == {"A7", "B7"}


def test_switch_on_two_edges(spark, ties, grid, zone_of):
    """KA3 joins A6 and A7 and also stands beside B6: one gate controls a ring and a bridge."""
    named = {"COD_ID": "KA3", "PAC_1": "A6", "PAC_2": "A7"}
    ring = grid["switches"].where("COD_ID = 'KA2'").withColumns({k: F.lit(v) for k, v in named.items()})
    extra = spark.createDataFrame(
        [("KA3", "AL1", "BE1", "SB4", "B6", 1.0, "A", 1, "32", False)],
        "COD_ID string, CTMT string, CTMT_VIZ string, SSDMT_VIZ string, PAC_VIZ string, DIST_M double, P_N_OPE string, TLCD int, TIP_UNID string, EM_SUB boolean",
    )
    base = net.build_edges(grid["segments"], grid["switches"].unionByName(ring))
    edges = materialise(net.add_ties(base, ties.drop("lon", "lat").unionByName(extra), grid["feeders"]), "edges")
    assert [(r.dst, r.gate, r.open) for r in edges.where("kind = 'tie' and gate is not null").collect()] == [("B6", "KA3", True)]
    graph = rst.zone_graph(edges, grid["sources"], grid["customers"])
    zone = {r.edge_id: r.zone for r in rst.segment_zones(edges, graph.zones).collect()}["SA1"]
    options = rst.restoration_options(graph, rst.isolate_zones(graph)).where(F.col("zone") == zone).collect()
    assert {r.chave: r.fonte for r in options} == dict.fromkeys(("KA2", "KB2", "KA3"), "BE1")
    closed = materialise(switched(spark, {"edges": edges}, ("fechar", "KA3"), ("abrir", "KA1")), "edges")
    assert fed_by(closed, grid)["A5"] == "BE1"
    down = rst.switch_downstream(rst.zone_graph(closed, grid["sources"], grid["customers"])).where("gate = 'KA3'")
    assert down.count() == 1


def test_trunk_and_summary(grid):
    trunk = net.trunk_segments(grid["edges"], grid["sources"])
    assert {(r.ctmt, r.edge_id) for r in trunk.collect()} == {("AL1", "SA1"), ("BE1", "SB1")}
    assert {r.ctmt: r.edge_id for r in net.longest_trunk(trunk).collect()} == {"AL1": "SA1", "BE1": "SB1"}
    fed = net.energised(grid["edges"], grid["sources"])
    r = {x.cluster_id: x for x in net.network_summary(grid["edges"], net.build_nodes(grid["edges"]), fed, grid["customers"]).collect()}["AL1"]
    assert (r.trechos, r.chaves, r.chaves_NA, r.chaves_NF, r.ucbt, r.ucmt) == (5, 3, 1, 2, 5, 1)
    gate = {x.chave: x for x in net.switch_dossier(grid["edges"], fed).collect()}["KA2"]
    assert (gate.estado, gate.fed_src, gate.fed_dst) == ("aberta", "AL1", "BE1")


def test_connected_including_low_voltage(catalog):
    layers = [catalog.read(x) for x in ("SSDMT", "UNSEMT", "UNTRMT", "SSDBT", "UNSEBT", "RAMLIG")]
    found = {r.node: r.connected for r in net.connected_to_source(layers, catalog.read("CTMT")).collect()}
    assert found["U1p"] and found["L3a"] and found["A7"] and not found["G1"] and not found["L4"]


def test_voltage_profile_between_trees_needs_no_search(spark, grid, zones, monkeypatch):
    graph, isolation = zones
    chosen = rst.restoration_options(graph, isolation).select("zone", "chave", "fonte")
    searched = {tuple(r) for r in rst._searched_walks(graph, isolation, grid["edges"], grid["sources"], chosen).collect()}
    volts = spark.createDataFrame([("a7", 0.96)], "barra string, v_pu double")

    def refuse(*_):
        raise AssertionError("a path between two trees was searched")

    monkeypatch.setattr(rst, "shortest_paths", refuse)
    rows = rst.voltage_profile(graph, isolation, grid["edges"], grid["sources"], chosen, volts).collect()
    assert searched and {(r.zone, r.chave, r.barra, r.distancia_m) for r in rows} == {(z, c, n, round(d, 1)) for z, c, n, d in searched}


def test_voltage_profile_keeps_no_level_of_the_walk(spark, grid, zones):
    graph, isolation = zones
    chosen = rst.restoration_options(graph, isolation).select("zone", "chave", "fonte")
    volts = spark.createDataFrame([("a7", 0.96)], "barra string, v_pu double")
    before = set(list_path(spark, app_scratch(spark)))
    rows = rst.voltage_profile(graph, isolation, grid["edges"], grid["sources"], chosen, volts)
    left = {name.rsplit("-", 1)[0] for name in set(list_path(spark, app_scratch(spark))) - before}
    assert "ends" in left and not left & {"front", "reached"}
    assert rows.count() > 0
