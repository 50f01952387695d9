"""Reconciliation and allocation on the driver's tables: orders are the register, order lines the
asset base, suppliers the feeders, nations the towns and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.columns import round_to
from gridlake.operators import allocation, recon
from gridlake.plans.registry import query, table

_REG = """
  reg AS (SELECT CAST(o_orderkey AS VARCHAR) AS cod, n_name AS municipio, c_nationkey AS mun, o_totalprice AS kw, CAST(o_totalprice AS DECIMAL(28,6)) AS dkw, o_orderpriority AS fonte,
                 o_orderstatus AS classe, o_orderdate AS dt, CAST(year(o_orderdate) AS INTEGER) AS ano
          FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
  base AS (SELECT CAST(l_orderkey AS VARCHAR) AS ceg, concat('S', l_suppkey) AS ctmt, l_returnflag AS conj, l_linestatus AS camada, CAST(l_extendedprice AS DECIMAL(28,6)) AS dkw,
                  concat(l_partkey, '-', l_linenumber) AS id FROM lineitem),
  map_ AS (SELECT ceg, string_agg(DISTINCT ctmt, ';' ORDER BY ctmt) AS ctmt, count(DISTINCT ctmt) AS n_ctmt, CAST(sum(dkw) AS DOUBLE) AS kw_base,
                  string_agg(DISTINCT conj, ';' ORDER BY conj) AS conj FROM base GROUP BY 1),
  cmp AS (SELECT reg.*, map_.ctmt, map_.n_ctmt, map_.kw_base, map_.conj,
                 CASE WHEN n_ctmt > 1 THEN 'match_ambiguo' WHEN map_.ceg IS NOT NULL THEN 'match_exato' ELSE 'sem_match' END AS st,
                 round_even((kw - coalesce(kw_base, 0)) * 1000000, 0) / 1000000 AS delta FROM reg LEFT JOIN map_ ON map_.ceg = reg.cod)
"""
_FEED = """
  fe AS (SELECT concat('S', s_suppkey) AS f, s_nationkey AS mun, CAST(s_nationkey AS VARCHAR) AS cc, n_name AS cn, abs(s_acctbal) + 1000 AS kva, abs(s_acctbal) AS der FROM supplier JOIN nation ON n_nationkey = s_nationkey),
  ex AS (SELECT * FROM cmp WHERE st = 'match_exato'),
  bf AS (SELECT ctmt AS f, count(*) AS n, CAST(sum(dkw) AS DOUBLE) AS kw, CAST(sum(CAST(kw_base AS DECIMAL(28,6))) AS DOUBLE) AS kwb, strftime(min(dt), '%Y-%m-%d') AS d1, strftime(max(dt), '%Y-%m-%d') AS d2 FROM ex GROUP BY 1),
  fm AS (SELECT ctmt AS f, fonte FROM (SELECT ctmt, fonte, row_number() OVER (PARTITION BY ctmt ORDER BY sum(dkw) DESC, fonte) AS r FROM ex GROUP BY 1, 2) WHERE r = 1)
"""


def register(spark: SparkSession, sf: str) -> DataFrame:
    towns = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return table(spark, sf, "orders").join(towns, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").cast("string").alias("cod_empreendimento"), F.col("n_name").alias("municipio"), F.col("c_nationkey").alias("cod_municipio_ibge"),
        F.col("o_totalprice").alias("potencia_kw"), F.col("o_orderpriority").alias("fonte_normalizada"), F.col("o_orderstatus").alias("classe_normalizada"),
        F.col("o_orderstatus").alias("subgrupo_normalizado"), F.col("o_orderdate").alias("data_atualizacao_cadastral"), F.year("o_orderdate").alias("ano_conexao"),
        F.when(F.col("o_orderstatus") == "F", "UFV").otherwise("CGH").alias("sig_tipo_geracao"), F.col("o_orderpriority").alias("fonte_geracao"),
    )


def base(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("ceg_gd"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ctmt"), F.col("l_returnflag").alias("conj"),
        F.col("l_linestatus").alias("camada_origem"), F.col("l_extendedprice").alias("potencia_kw_base"), F.col("l_linenumber").cast("long").alias("cod_municipio_base"),
        F.concat_ws("-", "l_partkey", "l_linenumber").alias("cod_id_base"), F.lit(1).cast("long").alias("linhas_origem_duplicadas"),
    )


def feeders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("COD_ID"), F.col("s_name").alias("NOME"), F.lit("").alias("SUB"), F.lit("").alias("SUB_NOME"),
        F.col("s_nationkey").alias("MUN"), F.col("s_nationkey").cast("string").alias("CONJ_CODIGO"), F.col("n_name").alias("CONJ_NOME"),
        (F.abs("s_acctbal") + 1000).alias("kVA_instalado"), F.abs("s_acctbal").alias("kW_DER"), F.lit(0).alias("n_DER"),
    )


def compared(spark: SparkSession, sf: str) -> DataFrame:
    return recon.reconcile(register(spark, sf), base(spark, sf))


@query("reconcile", f"WITH {_REG} SELECT cod AS cod_empreendimento, st AS status_juncao, ctmt, conj, kw_base AS potencia_kw_base, delta AS delta_kw FROM cmp")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """J9, A15."""
    return compared(spark, sf).select("cod_empreendimento", "status_juncao", "ctmt", "conj", "potencia_kw_base", "delta_kw")


@query(
    "reconcile_evidence",
    f"""WITH {_REG}, hit AS (SELECT base.*, reg.cod IS NOT NULL AS h FROM base LEFT JOIN reg ON reg.cod = base.ceg)
    SELECT (SELECT count(*) FROM cmp) AS n_mmgd, (SELECT CAST(sum(dkw) AS DOUBLE) FROM cmp) AS kw_mmgd, (SELECT count(*) FROM cmp WHERE st = 'match_exato') AS n_mmgd_com_match,
      (SELECT CAST(coalesce(sum(dkw), 0) AS DOUBLE) FROM cmp WHERE st = 'match_exato') AS kw_mmgd_com_match, (SELECT count(*) FROM cmp WHERE st = 'sem_match') AS n_mmgd_sem_match,
      (SELECT CAST(coalesce(sum(dkw), 0) AS DOUBLE) FROM cmp WHERE st = 'sem_match') AS kw_mmgd_sem_match, (SELECT count(*) FROM cmp WHERE st = 'match_ambiguo') AS n_ceg_ambiguos,
      (SELECT count(*) FROM hit) AS n_base, (SELECT CAST(sum(dkw) AS DOUBLE) FROM hit) AS kw_base, (SELECT count(*) FROM hit WHERE h) AS n_base_com_match,
      (SELECT CAST(coalesce(sum(dkw), 0) AS DOUBLE) FROM hit WHERE h) AS kw_base_com_match, (SELECT count(*) FROM hit WHERE NOT h) AS n_base_sem_match,
      (SELECT CAST(coalesce(sum(dkw), 0) AS DOUBLE) FROM hit WHERE NOT h) AS kw_base_sem_match, 0 AS n_base_sem_codigo, CAST(0 AS DOUBLE) AS kw_base_sem_codigo, 0 AS n_ceg_duplicados""",
)
def reconcile_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """J10."""
    return recon.evidence(register(spark, sf), base(spark, sf), compared(spark, sf))


@query(
    "recon_by_entity",
    f"""WITH {_REG}, {_FEED}
    SELECT fe.f AS COD_ID, coalesce(bf.n, 0) AS empreendimentos_mmgd, coalesce(bf.kw, 0) AS potencia_kw_mmgd, coalesce(bf.kwb, 0) AS potencia_kw_base_mesmas_chaves,
      coalesce(bf.kw, 0) * 100.0::DOUBLE / kva AS penetracao_gd_pct, round_even((coalesce(bf.kw, 0) - der) * 1000000, 0) / 1000000 AS diferenca_kw_total,
      coalesce(fm.fonte, '') AS fonte_predominante, coalesce(d1, '') AS periodo_primeira_data, coalesce(d2, '') AS periodo_ultima_data
    FROM fe LEFT JOIN bf ON bf.f = fe.f LEFT JOIN fm ON fm.f = fe.f""",
)
def recon_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    """A11."""
    return recon.by_feeder(compared(spark, sf), feeders(spark, sf)).select(
        "COD_ID", "empreendimentos_mmgd", "potencia_kw_mmgd", "potencia_kw_base_mesmas_chaves", "penetracao_gd_pct", "diferenca_kw_total",
        "fonte_predominante", "periodo_primeira_data", "periodo_ultima_data",
    )


@query(
    "recon_by_region",
    f"""WITH {_REG}, {_FEED}, a AS (SELECT fe.*, coalesce(bf.n, 0) AS n, coalesce(bf.kw, 0) AS kw, fm.fonte FROM fe LEFT JOIN bf ON bf.f = fe.f LEFT JOIN fm ON fm.f = fe.f),
      g AS (SELECT cc, cn, count(*) AS al, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CAST(kw AS DECIMAL(28,6))) AS DOUBLE) AS kw, CAST(sum(CAST(kva AS DECIMAL(28,6))) AS DOUBLE) AS kva FROM a GROUP BY 1, 2),
      m AS (SELECT cc, fonte FROM (SELECT cc, fonte, row_number() OVER (PARTITION BY cc ORDER BY sum(CAST(kw AS DECIMAL(28,6))) DESC, fonte) AS r FROM a WHERE fonte IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
    SELECT g.cc AS CONJ_CODIGO, cn AS CONJ_NOME, al AS alimentadores, n AS empreendimentos_mmgd, kw AS potencia_kw_mmgd, kva AS kVA_instalado_total, kw * 100.0::DOUBLE / kva AS penetracao_gd_pct,
      coalesce(m.fonte, '') AS fonte_predominante FROM g LEFT JOIN m ON m.cc = g.cc""",
)
def recon_by_region(spark: SparkSession, sf: str) -> DataFrame:
    """A12, F1."""
    return recon.by_region(recon.by_feeder(compared(spark, sf), feeders(spark, sf))).drop("potencia_kw_base_total")


@query(
    "unmatched_by_area",
    f"""WITH {_REG}, {_FEED}, c AS (SELECT mun, count(DISTINCT f) AS a, count(DISTINCT cc) AS k FROM fe GROUP BY 1),
      u AS (SELECT mun, municipio, count(DISTINCT cod) AS n, CAST(sum(dkw) AS DOUBLE) AS kw FROM cmp WHERE st <> 'match_exato' GROUP BY 1, 2)
    SELECT u.mun AS cod_municipio_ibge, municipio, n AS empreendimentos_sem_chave, kw AS potencia_kw_sem_chave, coalesce(a, 0) AS alimentadores_base, coalesce(k, 0) AS conjuntos_base FROM u LEFT JOIN c ON c.mun = u.mun""",
)
def unmatched_by_area(spark: SparkSession, sf: str) -> DataFrame:
    """A13."""
    return recon.unmatched_by_town(compared(spark, sf), feeders(spark, sf))


@query("yearly_evolution", f"WITH {_REG} SELECT ano, count(DISTINCT cod) AS empreendimentos, CAST(sum(dkw) AS DOUBLE) AS potencia_kw FROM reg GROUP BY 1")
def yearly_evolution(spark: SparkSession, sf: str) -> DataFrame:
    """A14."""
    return recon.yearly_evolution(register(spark, sf))


@query(
    "top_divergences",
    f"""WITH {_REG} SELECT cod AS cod_empreendimento, municipio, ctmt, kw AS potencia_kw, kw_base AS potencia_kw_base, delta AS delta_kw FROM cmp
    WHERE st = 'match_exato' AND abs(delta) > 0.001 ORDER BY abs(delta) DESC, cod LIMIT 25""",
)
def top_divergences(spark: SparkSession, sf: str) -> DataFrame:
    """T2."""
    return recon.top_divergences(compared(spark, sf))


# --- allocation ----------------------------------------------------------------------------------


@query(
    "exact_allocation",
    """WITH b AS (SELECT l_orderkey, concat(l_partkey, '-', l_suppkey, '-', l_linenumber) AS id, l_returnflag AS f, CAST(l_extendedprice AS DECIMAL(28,6)) AS w FROM lineitem),
      s AS (SELECT *, sum(w) OVER (PARTITION BY l_orderkey, f) AS t FROM b)
    SELECT CAST(l_orderkey AS VARCHAR) AS ceg_gd, id AS COD_ID, f AS CTMT, o_totalprice * (CAST(w AS DOUBLE) / CAST(t AS DOUBLE)) AS potencia_alocada_kw FROM s JOIN orders ON o_orderkey = l_orderkey""",
)
def exact_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """L1."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("CEG_GD"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("COD_ID"),
        F.col("l_returnflag").alias("CTMT"), F.col("l_extendedprice").alias("POT_INST"),
    )
    return allocation.exact_allocation(register(spark, sf), lines, keep=("COD_ID", "CTMT"))


def _residual(spark: SparkSession, sf: str) -> DataFrame:
    reg = register(spark, sf)
    residue = allocation.unmatched_by_model(reg, base(spark, sf).where(F.col("camada_origem") == "F")).withColumnRenamed("cod_municipio_ibge", "MUN")
    towns = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("MUN"))
    owners = table(spark, sf, "orders").join(towns, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "MUN")
    load = table(spark, sf, "lineitem").join(owners, "l_orderkey").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("CTMT"), "MUN", F.col("l_quantity").alias("CAR_INST"), F.col("l_linenumber").alias("UNI_TR_MT")
    )
    points = allocation.load_points(load, None)
    return allocation.residual_allocation(residue, allocation.load_by_feeder_town([load.drop("UNI_TR_MT")]), points)


_RES = f"""{_REG}, known AS (SELECT DISTINCT ceg FROM base WHERE camada = 'F'),
      res AS (SELECT mun, municipio, CASE WHEN classe = 'F' THEN 'PVSystem' ELSE 'Generator' END AS tipo, count(DISTINCT cod) AS n, CAST(sum(dkw) AS DOUBLE) AS kw FROM reg WHERE cod NOT IN (SELECT ceg FROM known) GROUP BY 1, 2, 3),
      ld AS (SELECT concat('S', l_suppkey) AS f, c_nationkey AS mun, l_linenumber AS id, CAST(l_quantity AS DECIMAL(28,6)) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
      lt AS (SELECT f, mun, CAST(sum(w) AS DOUBLE) AS c FROM ld GROUP BY 1, 2), mt AS (SELECT mun, CAST(sum(CAST(c AS DECIMAL(28,6))) AS DOUBLE) AS c FROM lt GROUP BY 1),
      pt AS (SELECT f, id, CAST(sum(w) AS DOUBLE) AS p FROM ld GROUP BY 1, 2), pf AS (SELECT f, CAST(sum(CAST(p AS DECIMAL(28,6))) AS DOUBLE) AS p FROM pt GROUP BY 1),
      al AS (SELECT lt.f, lt.mun, res.tipo, res.n, pt.id, (res.kw * (lt.c / mt.c)) * pt.p / pf.p AS kw FROM lt JOIN mt ON mt.mun = lt.mun JOIN res ON res.mun = lt.mun JOIN pt ON pt.f = lt.f JOIN pf ON pf.f = lt.f)"""


@query(
    "residual_allocation",
    f"WITH {_RES} SELECT f AS CTMT, mun AS MUN, tipo AS tipo_modelo, CAST(id AS VARCHAR) AS id_ref, round_even(kw * 10000, 0) / 10000 AS potencia_alocada_kw FROM al",
)
def residual_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """L2, A27, A28, F10."""
    return _residual(spark, sf).select("CTMT", "MUN", "tipo_modelo", "id_ref", round_to(F.col("potencia_alocada_kw"), 4).alias("potencia_alocada_kw"))


@query(
    "allocation_summary",
    f"""WITH {_RES}, a AS (SELECT f, count(*) AS n, round_even(CAST(sum(CAST(kw AS DECIMAL(28,9))) AS DOUBLE) * 1000, 0) / 1000 AS kw FROM al GROUP BY 1),
      e AS (SELECT f, CAST(sum(n) AS BIGINT) AS n FROM (SELECT DISTINCT f, mun, tipo, n FROM al) GROUP BY 1)
    SELECT a.f AS CTMT, a.n AS n_elementos, a.kw AS potencia_total_kw, e.n AS n_empreendimentos_agregados FROM a JOIN e ON e.f = a.f""",
)
def allocation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """L3: residual part only."""
    rest = _residual(spark, sf)
    none = rest.select("CTMT", F.lit("").alias("ceg_gd"), "potencia_alocada_kw").where(F.lit(False))
    out = allocation.allocation_summary(none, rest)
    return out.select("CTMT", "n_elementos", round_to(F.col("potencia_total_kw"), 3).alias("potencia_total_kw"), "n_empreendimentos_agregados")
