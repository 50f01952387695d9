import json

from pyspark.sql import functions as F

from gridlake.functions.keyed import unique_mode_per_key
from gridlake.operators import audit
from gridlake.operators import restoration as rst
from gridlake.operators.impact import option_impact
from gridlake.session import materialise
from tests.test_network import grid, zones  # noqa: F401


def test_regions_are_summed_only_for_pieces_that_options_touch(spark, zones):  # noqa: F811
    graph, isolation = zones
    regions = graph.customers.select(F.col("zone").alias("node"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("region"), F.lit(2).cast("long").alias("n"))
    every = {tuple(r) for r in rst.piece_regions(graph, isolation, regions).select("cut", "component", "region", "n").collect()}
    wanted = rst.recovered_components(graph, isolation, rst.lost_ends(graph, isolation)).select("cut", "component").limit(1)
    keys = {tuple(r) for r in wanted.collect()}
    some = {tuple(r) for r in rst.piece_regions(graph, isolation, regions, pieces=wanted).select("cut", "component", "region", "n").collect()}
    assert some == {r for r in every if r[:2] in keys} and some and some != every


def test_impact_of_options_with_one_and_several_nodes(spark, monkeypatch):
    options = spark.createDataFrame([("z", k, 9) for k in ("one", "two", "even", "none")], "zone string, chave string, clientes long")
    nodes = spark.createDataFrame([("z", "one", "a"), ("z", "two", "a"), ("z", "two", "b"), ("z", "even", "c"), ("z", "none", "d")], "zone string, chave string, node string")
    regions = spark.createDataFrame([("a", "1", 3), ("a", "1", 1), ("a", "2", 3), ("b", "2", 5), ("c", "1", 2), ("c", "2", 2)], "node string, region string, n long")
    totals = spark.createDataFrame([("1", 10), ("2", 20)], "region string, total_uc long")
    modes = []
    from gridlake.operators import impact

    def noted(df, *rest):
        modes.append(df)
        return unique_mode_per_key(df, *rest)

    monkeypatch.setattr(impact, "unique_mode_per_key", noted)
    rows = option_impact(options, nodes, spark.createDataFrame([("z", 9)], "zone string, desligados long"), regions=regions, totals=totals).collect()
    assert {r.chave: (r.region, r.total_uc, r.ucs_restauradas) for r in rows} == {
        "one": ("1", 10, 4), "two": ("2", 20, 8), "even": (None, None, None), "none": (None, None, None)}
    # region by region only the option of several nodes is listed
    assert {r.chave for df in modes if "chave" in df.columns for r in df.select("chave").collect()} == {"two"}


def test_entries_are_counted_as_the_timeline_lists_them(spark):
    kinds = ["agente.inicio", "mcp.chamada", "hitl.aprovacao", "agente.fim", "hitl.passo", "mcp.erro", "outro"]
    rows = []
    for file in ("a.jsonl", "b.jsonl", "dir/hitl.jsonl"):
        for pos in range(1, 41):
            kind = kinds[(pos * 7 + len(file) + pos // 5) % 7]
            body = {"ferramenta": ("restore_options", "load_cluster")[pos % 2], "resultado": "{}"}
            if pos % 3 == 0:
                body["evento"] = f"E-{pos % 4:04d}"
            if pos % 5 == 0:
                body["propostas"] = [f"P-{pos % 6:04d}", f"P-{(pos + len(file)) % 9:04d}"]
            rows.append((file, pos, pos, f"t{pos:03d}", kind, json.dumps(body)))
    records = materialise(spark.createDataFrame(rows, "file string, pos long, seq long, ts string, tipo string, dados string"), "records")
    listed = audit.event_timeline(records).groupBy("event_id", "entrada").agg(F.count(F.lit(1)).alias("n"))
    want = {tuple(r) for r in listed.collect()}
    assert {tuple(r) for r in audit.entry_counts(records).select("event_id", "entrada", "n").collect()} == want and len(want) > 8
    found = audit.event_records(records)
    assert found.count() == found.distinct().count()
