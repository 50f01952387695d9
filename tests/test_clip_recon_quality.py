import pytest
from pyspark.sql import functions as F

from conftest import line, point, square, to_frames
from gridlake.operators import clip, quality, recon
from gridlake.operators.inventory import feeder_inventory
from gridlake.sources.catalog import LayerCatalog, MissingLayer, export_layers
from gridlake.sources.register import REGISTER_COLUMNS, asset_generators, normalise_register


def test_catalog(spark, catalog, base_path, tmp_path):
    found, missing = catalog.resolve()
    assert "CTMT" in found and "BASE" in missing
    assert catalog.resolve(["ctmt", "CTMT", " ssdmt "])[0] == ["CTMT", "SSDMT"]
    with pytest.raises(MissingLayer):
        catalog.resolve(["NADA"])
    assert catalog.read("SSDMT", ["COD_ID", "NADA"]).columns == ["COD_ID", "geometry"]
    assert catalog.read_in("SSDMT", "CTMT", []).count() == 0
    assert catalog.read_in("SSDMT", "CTMT", ["GA1"]).count() == 1
    keys = spark.createDataFrame([("GA1",)], "k string")
    assert catalog.read_in("SSDMT", "CTMT", keys).count() == 1
    assert catalog.table("PIP", ["COD_ID", "ENE_01"]).count() == 0
    manifest = {r.layer: r for r in export_layers(catalog, str(tmp_path), ["SSDMT", "CTMT"]).collect()}
    assert (manifest["SSDMT"].rows, manifest["SSDMT"].kinds, manifest["SSDMT"].minx) == (10, "MultiLineString", -39.9999)
    assert LayerCatalog(spark, str(tmp_path)).read("CTMT").count() == 3


def test_clip(spark, catalog, ties, tmp_path):
    bridge = clip.clip_bridge(spark, {"alone": ["AL1"], "pair": ["AL1", "BE1"]})
    sel = clip.select_layers(catalog, bridge, ties=ties)
    counts = {(r.clip_id, r.layer): r.n for r in clip.clip_counts(sel, bridge).collect()}
    own = {layer: n for (c, layer), n in counts.items() if c == "alone"}
    direct = {"CTMT": 1, "SUB": 1, "UNTRAT": 1, "SSDMT": 5, "UNSEMT": 3, "UNTRMT": 2, "UNREMT": 0, "UNCRMT": 2, "UCMT_tab": 1, "UGMT_tab": 1, "SSDBT": 1, "UNSEBT": 1, "RAMLIG": 1, "UGBT_tab": 1}
    assert {k: own[k] for k in direct} == direct
    # U8 follows its transformer; conductors W1 and W2; curves of both classes; devices of T1, T2 and of three switches
    assert (own["UCBT_tab"], own["UCBT"], own["SEGCON"], own["CRVCRG"], own["EQTRMT"], own["EQSE"], own["CONJ"], own["INTERLIGACOES"]) == (5, 5, 2, 6, 2, 3, 1, 3)
    assert counts[("pair", "SSDMT")] == 9 and counts[("pair", "INTERLIGACOES")] == 3
    assert sel["PONNOT"].where("COD_ID in ('P998', 'P999', 'P22')").count() == 0
    pairs = clip.clip_neighbours(bridge, ties).orderBy("clip_id").collect()
    assert {(p.clip_id, p.CTMT, p.ties, p.ties_campo) for p in pairs} == {("alone", "AL1", 3, 2), ("pair", "AL1", 3, 2)}
    unknown = clip.unknown_feeders(catalog, clip.clip_bridge(spark, {"x": ["NADA"]}))
    assert [r.ctmt for r in unknown.collect()] == ["NADA"]
    clip.write_clips({k: sel[k] for k in ("CTMT", "SSDMT")}, bridge, str(tmp_path / "out"), ties)
    manifest = spark.read.json(str(tmp_path / "out" / "_manifest"))
    assert {r.clip_id: r.layers.SSDMT for r in manifest.collect()} == {"alone": 5, "pair": 9}
    assert clip.union_clips([sel["SSDMT"]]).count() == 9


def test_clip_files_do_not_grow_with_the_clips(spark, tmp_path):
    rows = spark.range(600).selectExpr("concat('L', id) AS COD_ID", "concat('c', id % 200) AS clip_id")
    feeders = spark.range(200).selectExpr("concat('c', id) AS clip_id", "concat('F', id) AS COD_ID", "'n' AS NOME", "'S' AS SUB")
    bridge = feeders.select("clip_id", F.col("COD_ID").alias("ctmt"))
    clip.write_clips({"CTMT": feeders, "SSDMT": rows}, bridge, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "SSDMT"))
    assert sorted(map(tuple, back.select("COD_ID", "clip_id").collect())) == sorted(map(tuple, rows.collect()))
    assert len(list((tmp_path / "out" / "SSDMT").rglob("*.parquet"))) < 50


def register_rows():
    """Four projects of the utility, three with a generator in the base, and one of another state."""
    always = {
        "NumCNPJDistribuidora": "11222333000144", "SigUF": "RJ", "NomAgente": "U", "CodMunicipioIbge": "51", "NomMunicipio": "Clara", "SigTipoGeracao": "UFV",
        "DscFonteGeracao": "Radiação solar", "DscClasseConsumo": "Residencial", "CodClasseConsumo": "1",
    }
    changing = (
        ("GD.RJ.X1", "6", "2021-03-04", {}), ("GD.RJ.X3", "400", "2022-01-02", {}), ("GD.RJ.X2", "9", "2023-05-06", {}),
        ("GD.RJ.X4", "2.5", "2023-07-08", {"CodMunicipioIbge": "52", "NomMunicipio": "Nova"}), ("GD.SP.X5", "70", "2023-09-09", {"SigUF": "SP"}),
    )
    return [
        dict.fromkeys(REGISTER_COLUMNS, "") | always | {"CodEmpreendimento": code, "MdaPotenciaInstaladaKW": kw, "DthAtualizaCadastralEmpreend": day} | other
        for code, kw, day, other in changing
    ]


def test_reconciliation(spark, catalog):
    rows = register_rows()
    raw = spark.createDataFrame([tuple(r[c] for c in REGISTER_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in REGISTER_COLUMNS))
    reg = normalise_register(raw, tax_id="11222333000144", state="RJ", agent="U")
    base = asset_generators(catalog)
    compared = recon.reconcile(reg, base)
    e = recon.evidence(reg, base, compared).collect()[0]
    assert (e.n_mmgd, e.kw_mmgd, e.n_mmgd_com_match, e.n_mmgd_sem_match, e.kw_mmgd_sem_match) == (4, 417.5, 3, 1, 2.5)
    assert (e.n_base, e.n_base_com_match, e.n_base_sem_codigo, e.n_ceg_ambiguos) == (3, 3, 0, 0)
    feeders = feeder_inventory(catalog).join(recon.feeder_region_cascade(catalog), "COD_ID")
    found = {r.COD_ID: r for r in recon.by_feeder(compared, feeders).collect()}
    assert {f: r.potencia_kw_mmgd for f, r in found.items()} == {"AL1": 406.0, "BE1": 9.0, "GA1": 0.0}
    one = found["AL1"]
    assert (one.fonte_predominante, one.classe_predominante) == ("UFV — Radiação solar", "Residencial (1)")
    assert (one.periodo_primeira_data, one.CONJ_NOME) == ("2021-03-04", "VILA CLARA")
    assert {r.ano: r.empreendimentos for r in recon.yearly_evolution(reg).collect()} == {2021: 1, 2022: 1, 2023: 2}
    region = recon.by_region(recon.by_feeder(compared, feeders)).collect()[0]
    assert (region.alimentadores, region.potencia_kw_mmgd, region.empreendimentos_mmgd) == (3, 415.0, 3)
    town = recon.unmatched_by_town(compared, feeders.withColumn("MUN", F.col("MUN").cast("long"))).collect()[0]
    assert (town.cod_municipio_ibge, town.potencia_kw_sem_chave, town.alimentadores_base) == (52, 2.5, 1)
    assert recon.top_divergences(compared).count() == 0
    with pytest.raises(KeyError):
        normalise_register(raw.drop("SigUF"), tax_id="", state="", agent="")


def quality_base():
    where = {"TR1": (-43.2, -22.9), "TR2": (-43.21, -22.9)}
    return {
        "BASE": [{"DIST": 382, "DAT_EXT": "2025-12-31"}],
        "CTMT": [{"COD_ID": "C1"}, {"COD_ID": "C2"}, {"COD_ID": "C3"}],
        "SEGCON": [{"COD_ID": "CAB1"}],
        "ARAT": [{"COD_ID": "A", "geometry": square(-44, -24, -42, -22)}],
        "UNTRMT": [{"COD_ID": t, "CTMT": c, "geometry": point(*where[t])} for t, c in (("TR1", "C1"), ("TR2", "C2"))],
        "PONNOT": [{"COD_ID": "P1", "geometry": point(-43.2, -22.9)}, {"COD_ID": "P2", "geometry": point(-43.6, -23.0)}, {"COD_ID": "P3", "geometry": None}],
        "UCBT_tab": [{"COD_ID": f"U{i}", "PN_CON": p, "UNI_TR_MT": "TR1", "CTMT": "C2", "FAS_CON": f} for i, (p, f) in enumerate((("P1", "AN"), ("P1", "ABC"), ("P2", "BN"), ("P1", " ")))],
        "RAMLIG": [{"COD_ID": f"R{i}", "CTMT": "C1", "UNI_TR_MT": "TR1", "TIP_CND": c, "COMP": x, "FAS_CON": "AN"} for i, (c, x) in enumerate((("CAB1", 10.0), ("NADA", 350.0), (" ", 900.0)))],
        "SSDMT": [{"COD_ID": "S1", "CTMT": "C1", "TIP_CND": "CAB1", "PAC_1": "N1", "PAC_2": "N2", "geometry": line((-43.2, -22.9), (-43.1, -22.9))},
                  {"COD_ID": "S2", "CTMT": "CX", "TIP_CND": None, "PAC_1": "N2", "PAC_2": "N3", "geometry": line((-45.0, -22.9), (-43.1, -22.9))}],
        "UNSEMT": [{"COD_ID": "K1", "CTMT": "C1", "TLCD": None, "PAC_1": "N1", "PAC_2": "N4"}, {"COD_ID": "K2", "CTMT": "C2", "TLCD": 7, "PAC_1": "M1", "PAC_2": "M2"}, {"COD_ID": "K3", "CTMT": "C2", "TLCD": 1, "PAC_1": "M2", "PAC_2": "M3"}],
    }


def test_quality(spark):
    cat = LayerCatalog.of(spark, to_frames(spark, quality_base()))
    rows = {r.check: r for r in quality.quality_summary(cat).collect()}
    assert {k: (r["count"], r.universe) for k, r in rows.items()} == {
        "fas_con": (5, 6), "ramlig": (2, 3), "pn_con": (1, 4), "tip_cnd": (3, 5), "ctmt": (1, 14), "ctmt_sem_referencia": (1, 3),
        "pac": (1, 7), "geometria": (1, 8), "bbox": (1, 7), "tlcd": (2, 3),
    }
    assert rows["ramlig"].examples == "R1;R2" and rows["ctmt_sem_referencia"].examples == "C3" and rows["pac"].examples == "N2"
    assert cat.base_metadata().collect()[0].DAT_EXT == "2025-12-31"
    p99 = quality.long_tail(cat.table("RAMLIG", ["COMP"])).collect()[0].p99
    assert abs(p99 - (350 + 550 * 0.98)) < 1e-9
