from gridlake.operators.inventory import feeder_inventory, top_feeders
from gridlake.operators.ties import neighbours, symmetric_counts
from gridlake.sources.catalog import LayerCatalog


def test_ties(ties):
    rows = {r.COD_ID: r for r in ties.collect()}
    assert {k: (v.CTMT, v.CTMT_VIZ, v.SSDMT_VIZ, v.EM_SUB) for k, v in rows.items()} == {
        "KA2": ("AL1", "BE1", "SB3", False), "KB2": ("BE1", "AL1", "SA5", False), "KB3": ("BE1", "AL1", "SA1", True)
    }
    # a hundred-thousandth of a degree of latitude
    assert all(abs(r.DIST_M - 1.107) < 0.01 for r in rows.values())


def test_symmetric_counts(ties):
    rows = {r.CTMT: r for r in symmetric_counts(ties).collect()}
    assert set(rows) == {"AL1", "BE1"}
    for feeder, other in (("AL1", "BE1"), ("BE1", "AL1")):
        r = rows[feeder]
        assert (r.NA_interligacao, r.NA_interligacao_telecomandada, r.NA_interligacao_SE) == (3, 2, 1)
        assert (r.NA_interligacao_campo, r.NA_interligacao_campo_telecomandada, r.vizinhos) == (2, 1, other)


def test_neighbours(ties):
    own = {r.CTMT: r for r in neighbours(ties).collect()}
    assert (own["AL1"].ties, own["AL1"].ties_telecomandadas, own["AL1"].ties_manuais, own["AL1"].ties_em_SE) == (3, 2, 1, 1)
    assert (own["AL1"].ties_proprias, own["AL1"].ties_do_vizinho, own["AL1"].chaves) == (1, 2, "KA2;KB2;KB3")
    assert (own["BE1"].ties_proprias, own["BE1"].ties_do_vizinho) == (2, 1)
    field = {r.CTMT: r for r in neighbours(ties, without_yard=True).collect()}["AL1"]
    assert (field.ties, field.ties_em_SE, field.chaves) == (2, 1, "KA2;KB2")


def test_inventory(catalog):
    rows = {r.COD_ID: r for r in feeder_inventory(catalog).collect()}
    # U8 hangs on a transformer of AL1 although it names BE1
    assert {f: (r.n_UCBT, r.n_UCMT) for f, r in rows.items()} == {"AL1": (5, 1), "BE1": (2, 0), "GA1": (1, 1)}
    assert {f: (r.chaves_total, r.chaves_NA, r.chaves_NF, r.chaves_telecomandadas) for f, r in rows.items()} == {
        "AL1": (3, 1, 2, 2), "BE1": (4, 2, 2, 2), "GA1": (1, 0, 1, 0)
    }
    one = rows["AL1"]
    assert (one.SUB_NOME, one.TEN_NOM_kV, one.MUN) == ("ESTACAO A", 13.2, "51")
    assert (one.n_UNTRMT, one.kVA_instalado, one.n_DER, one.kW_DER, one.n_UNCRMT) == (2, 105.0, 2, 406.0, 2)
    assert (one.vizinhos, rows["GA1"].vizinhos, rows["GA1"].score) == ("BE1", "", 0) and one.score > 0
    near = lambda got, want: all(abs(g - w) < 1e-9 for g, w in zip(got, want, strict=True))
    assert near((one.lon_min, one.lat_min, one.lon_max, one.lat_max), (-39.9999, -20.0, -39.996, -19.999))
    assert abs(one.ENE_MWh_ano - 10_800) < 1e-6 and abs(one.km_MT - 0.5) < 1e-9


def test_inventory_order_and_optional_layers(spark, catalog):
    found = feeder_inventory(catalog)
    best = [r.COD_ID for r in found.orderBy(found.score.desc(), found.COD_ID).limit(2).collect()]
    assert [r.COD_ID for r in top_feeders(found, 2).collect()] == best == ["AL1", "BE1"]
    small = LayerCatalog.of(spark, {k: catalog.read(k) for k in ("CTMT", "SSDMT")})
    r = feeder_inventory(small).where("COD_ID = 'AL1'").collect()[0]
    assert (r.n_UCBT, r.chaves_total, r.NA_interligacao, r.vizinhos, r.SUB_NOME) == (0, 0, 0, "", None)


def test_inventory_area_filter(spark, catalog):
    from pyspark.sql import functions as F

    from gridlake.functions.geo import box_edges

    def inside(*box):
        area = spark.createDataFrame([("area", *box)], "area_id string, minx double, miny double, maxx double, maxy double").withColumn(
            "edges", box_edges(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
        )
        return {r.COD_ID for r in feeder_inventory(catalog, area=area).select("COD_ID").collect()}

    assert inside(-40.01, -20.01, -39.99, -19.99) == {"AL1", "BE1"}
    assert inside(-39.985, -20.01, -39.97, -19.99) == {"GA1"}
