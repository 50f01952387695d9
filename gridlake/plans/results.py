"""Result tables, sampling, sweeps, plan checks and loads on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.columns import (
    distance_km,
    json_path,
    mask_tokens,
    pass_at_k,
    result_hash,
    round_to,
)
from gridlake.functions.ordered import exact_percentile
from gridlake.operators import impact, load, results, sample
from gridlake.plans.registry import query, table
from gridlake.sources.sinks import feature_lines, point_json


# --- power-flow like tables ----------------------------------------------------------------------


def voltages(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as bus voltages: run = supplier, phase = line number, bus = part."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS run_id", "concat('f', l_partkey % 7, '_mt_', l_partkey) AS barra", "l_linenumber AS fase", "CAST(IF(l_linestatus = 'O', 13.8, 0.22) AS DOUBLE) AS kv_base",
        "l_discount * 2 + 0.9 AS v_pu", "l_orderkey",
    )


def currents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS run_id", "concat('Line.SMT_', l_orderkey, '-', l_partkey, '-', l_linenumber) AS elemento", "l_quantity * 2.5 AS carregamento_pct"
    )


_V = "v AS (SELECT l_suppkey AS run_id, concat('f', l_partkey % 7, '_mt_', l_partkey) AS barra, l_linenumber AS fase, CASE WHEN l_linestatus = 'O' THEN 13.8 ELSE 0.22 END AS kv, l_discount * 2 + 0.9 AS v FROM lineitem)"


@query(
    "violations",
    f"""WITH {_V}, o AS (SELECT l_suppkey AS run_id, count(*) FILTER (l_quantity * 2.5 > 100) AS n FROM lineitem GROUP BY 1)
    SELECT v.run_id, count(*) FILTER (fase < 4 AND v > 0) AS n_nos_fase, count(*) FILTER (fase < 4 AND v <= 0) AS n_desenergizados, min(v) FILTER (fase < 4) AS v_min_pu, max(v) FILTER (fase < 4) AS v_max_pu,
      count(*) FILTER (fase < 4 AND v < 0.93) AS n_subtensao, count(*) FILTER (fase < 4 AND v > 1.05) AS n_sobretensao, any_value(o.n) AS n_sobrecargas FROM v JOIN o ON o.run_id = v.run_id GROUP BY 1""",
)
def violations(spark: SparkSession, sf: str) -> DataFrame:
    """A37."""
    return results.powerflow_summary(voltages(spark, sf), currents(spark, sf))


@query(
    "worst_buses",
    f"""WITH {_V}, r AS (SELECT run_id, v, row_number() OVER (PARTITION BY run_id ORDER BY v, barra, fase) AS rank FROM v WHERE fase < 4 AND v > 0) SELECT run_id, v AS v_pu, rank FROM r WHERE rank <= 10""",
)
def worst_buses(spark: SparkSession, sf: str) -> DataFrame:
    """T4."""
    return results.worst_buses(voltages(spark, sf)).select("run_id", "v_pu", "rank")


@query(
    "hourly_summary",
    f"""WITH {_V}, m AS (SELECT run_id, max(v) AS vm, count(DISTINCT CASE WHEN v > 1.05 THEN barra END) AS n, arg_min(barra, (-v, barra)) AS b FROM v WHERE fase < 4 AND v > 0 AND kv > 1 GROUP BY 1)
    SELECT s_suppkey AS run_id, m.vm AS vmax_mt_pu, coalesce(m.b, '') AS barra_vmax_mt, coalesce(m.n, 0) AS barras_mt_acima, CASE WHEN s_acctbal < 0 THEN 'reverso' ELSE 'SE→rede' END AS sentido_fonte,
      CASE WHEN s_nationkey = 3 THEN 'não convergiu' WHEN m.vm IS NULL THEN 'instável numericamente' ELSE 'ok' END AS status FROM supplier LEFT JOIN m ON m.run_id = s_suppkey""",
)
def hourly_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A38, F16."""
    runs = table(spark, sf, "supplier").selectExpr("s_suppkey AS run_id", "s_nationkey <> 3 AS convergiu", "s_acctbal AS potencia_kw", "abs(s_acctbal) AS perdas_kw")
    return results.hourly_summary(runs, voltages(spark, sf)).select("run_id", "vmax_mt_pu", "barra_vmax_mt", "barras_mt_acima", "sentido_fonte", "status")


@query(
    "electrical_verdict",
    """WITH v AS (SELECT l_suppkey AS r, min(0.93 + l_tax) AS lo, max(0.93 + l_tax) AS hi FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
      c AS (SELECT l_suppkey AS r, max(l_quantity * 2.02) AS mx, count(*) FILTER (l_quantity * 2.02 > 100) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 2 AND l_returnflag = 'R' GROUP BY 1),
      s AS (SELECT s_suppkey AS r, s_nationkey <> 3 AS modelado, s_nationkey <> 4 AS conv, s_acctbal AS i, 8000.0::DOUBLE AS nom FROM supplier)
    SELECT s.r AS run_id, coalesce(n, 0) AS n_sobrecargas, (nom - i) / nom AS margem,
      modelado AND conv AND coalesce(lo >= 0.93, true) AND coalesce(hi <= 1.05, true) AND coalesce(n, 0) = 0 AND i <= nom AS viavel FROM s LEFT JOIN v ON v.r = s.r LEFT JOIN c ON c.r = s.r""",
)
def electrical_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """L8."""
    runs = table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS run_id", "s_name AS chave", "CAST(s_nationkey AS STRING) AS fonte", "s_nationkey <> 3 AS modelled", "s_nationkey <> 4 AS converged", "s_acctbal AS i_source", "8000.0D AS i_nominal"
    )
    lines = table(spark, sf, "lineitem")
    v = lines.where("l_linenumber = 1").selectExpr("l_suppkey AS run_id", "CAST(l_partkey AS STRING) AS bus", "0.93D + l_tax AS v_pu")
    c = lines.where("l_linestatus = 'F' AND l_linenumber = 2 AND l_returnflag = 'R'").selectExpr("l_suppkey AS run_id", "CAST(l_partkey AS STRING) AS element", "l_quantity * 2.02D AS loading_pct")
    return impact.electrical_verdict(runs, v, c).select("run_id", "n_sobrecargas", "margem", "viavel")


# --- comparisons ---------------------------------------------------------------------------------

_RUNS = "a AS (SELECT l_partkey AS k, l_linenumber AS j, l_returnflag AS f, max(l_extendedprice) AS p, max(l_discount) AS d FROM lineitem GROUP BY 1, 2, 3)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("j"), F.col("l_returnflag").alias("f")).agg(
        F.max("l_extendedprice").alias("p"), F.max("l_discount").alias("d")
    )


@query(
    "run_diff",
    f"""WITH {_RUNS} SELECT x.j AS j, count(*) AS n_comum, max(abs(x.p - y.p)) AS erro_max, round_even(CAST(sum(CAST(abs(x.p - y.p) AS DECIMAL(28,9))) AS DOUBLE) / count(*) * 10000, 0) / 10000 AS erro_medio
    FROM a x JOIN a y ON y.k = x.k AND y.j = x.j AND x.f = 'A' AND y.f = 'R' GROUP BY 1""",
)
def run_diff(spark: SparkSession, sf: str) -> DataFrame:
    """J13, U5."""
    rows = _runs(spark, sf)
    out = results.run_difference(rows.where("f = 'A'"), rows.where("f = 'R'"), ["k"], "p", group=["j"])
    return out.withColumn("erro_medio", round_to(F.col("erro_medio"), 4))


@query(
    "hourly_delta",
    f"""WITH {_RUNS} SELECT x.k, x.j, x.p AS p_sem, y.p AS p_com, y.p - x.p AS delta_p, (x.d < 0.09) AND (y.d < 0.09) AS comparacao_valida FROM a x JOIN a y ON y.k = x.k AND y.j = x.j AND x.f = 'A' AND y.f = 'R'""",
)
def hourly_delta(spark: SparkSession, sf: str) -> DataFrame:
    """J14."""
    rows = _runs(spark, sf).where("f IN ('A', 'R')").withColumns({"com_gd": F.col("f") == "R", "status": F.when(F.col("d") < 0.09, "ok").otherwise("instável")})
    return results.paired_delta(rows, ["k", "j"], "com_gd", ["p"], "status").select("k", "j", "p_sem", "p_com", "delta_p", "comparacao_valida")


def _option_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("caso"), F.col("l_returnflag").alias("instante"), F.col("l_partkey").alias("chave"), (F.col("l_discount") < 0.02).alias("viavel"),
        F.col("l_tax").alias("margem"), F.col("l_quantity").alias("vmin_mt_pu"), F.col("l_quantity").alias("vmax_mt_pu"), F.lit("").alias("motivos"),
        F.struct((-F.col("l_extendedprice")).alias("p"), "l_orderkey", "l_partkey", "l_linenumber").alias("ordem"),
    )


_OPT = "(-l_extendedprice, l_orderkey, l_partkey, l_linenumber)"
_WIN = f"""w AS (SELECT l_suppkey AS caso, l_returnflag AS instante, count(*) AS n, count(*) FILTER (l_discount < 0.02) AS nv, arg_min(l_partkey, {_OPT}) AS venc, arg_min(l_tax, {_OPT}) AS margem,
      arg_min(l_partkey, {_OPT}) FILTER (l_discount < 0.02) AS vv FROM lineitem GROUP BY 1, 2)"""


@query("option_summary", f"WITH {_WIN} SELECT caso, instante, n AS n_opcoes, nv AS n_viaveis, venc AS vencedora, vv AS vencedora_viavel, margem AS margem_vencedora FROM w")
def option_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A36."""
    return results.option_summary(_option_rows(spark, sf), ["caso", "instante"]).drop("vmin_vencedora", "vmax_vencedora", "observacao")


@query(
    "compare_winners",
    f"""WITH {_WIN}, k AS (SELECT DISTINCT caso FROM w)
    SELECT k.caso, a.venc AS vencedora_a, b.venc AS vencedora_b, a.venc IS DISTINCT FROM b.venc AS mudou_vencedora, a.vv AS vencedora_viavel_a, b.vv AS vencedora_viavel_b, a.vv IS DISTINCT FROM b.vv AS mudou_opcao_viavel
    FROM k LEFT JOIN w a ON a.caso = k.caso AND a.instante = 'A' LEFT JOIN w b ON b.caso = k.caso AND b.instante = 'R'""",
)
def compare_winners(spark: SparkSession, sf: str) -> DataFrame:
    """J15."""
    return results.compare_winners(results.option_summary(_option_rows(spark, sf), ["caso", "instante"]), "A", "R", keys=["caso"])


@query(
    "before_after",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) < 1997 GROUP BY 1), d AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1)
    SELECT coalesce(a.k, d.k) AS o_custkey, a.n AS n_antes, d.n AS n_depois FROM a FULL JOIN d ON d.k = a.k""",
)
def before_after(spark: SparkSession, sf: str) -> DataFrame:
    """J16."""
    orders = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    count = lambda df: df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return results.before_after(count(orders.where("y >= 1997")), count(orders.where("y < 1997")), "o_custkey", ["n"])


@query(
    "ab_pairs",
    """WITH o AS (SELECT o_custkey AS f, o_orderstatus = 'F' AS arm, o_orderkey AS a, o_totalprice AS v FROM orders WHERE o_orderpriority <> '5-LOW'), n AS (SELECT f, arm, max(a) AS a, arg_max(v, a) AS v FROM o GROUP BY 1, 2)
    SELECT x.f AS familia, x.a AS arquivo_controle, x.v AS v_controle, y.a AS arquivo_variante, y.v AS v_variante, 's' AS sufixo FROM n x JOIN n y ON y.f = x.f AND x.arm AND NOT y.arm""",
)
def ab_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """J17."""
    rows = table(spark, sf, "orders").selectExpr("o_custkey AS familia", "o_orderstatus = 'F' AS arm", "o_orderpriority <> '5-LOW' AS fixed", "o_orderkey AS arquivo", "o_totalprice AS v")
    return results.ab_pairs(rows, arm="arm", fixed="fixed", suffix="s", values=["v"])


# --- summaries and sampling ----------------------------------------------------------------------


@query(
    "region_medians",
    """SELECT o_orderpriority, round_even(quantile_cont(o_totalprice, 0.5) * 10000, 0) / 10000 AS mediana FROM orders GROUP BY 1""",
)
def region_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Exact median per group."""
    return exact_percentile(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", 0.5, "mediana").withColumn("mediana", round_to(F.col("mediana"), 4))


@query(
    "region_summary",
    """WITH s AS (SELECT l_suppkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) AS q FROM lineitem GROUP BY 1)
    SELECT n_regionkey AS regiao, count(*) AS n, count(*) FILTER (s_acctbal >= 0) AS LDA, count(*) FILTER (s_acctbal < 0) AS LDS, CAST(sum(a) AS BIGINT) AS "ties_TLCD", CAST(sum(n) AS BIGINT) AS ties_campo,
      CAST(sum(r) AS BIGINT) AS "ties_SE", quantile_cont(q, 0.5) AS km_mediana, quantile_cont(n, 0.5) AS "UCBT_mediana" FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN s ON s.k = s_suppkey GROUP BY 1""",
)
def region_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A22."""
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_UCBT"), F.count_if(F.col("l_returnflag") == "A").alias("NA_interligacao_campo_telecomandada"),
        F.count_if(F.col("l_returnflag") == "R").alias("NA_interligacao_SE"), F.sum("l_quantity").alias("km_MT"),
    ).withColumn("NA_interligacao_campo", F.col("n_UCBT"))
    base = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(lines, F.col("l_suppkey") == F.col("s_suppkey"))
    return results.region_summary(base.withColumns({"regiao": F.col("n_regionkey"), "tipo": F.when(F.col("s_acctbal") >= 0, "LDA").otherwise("LDS")}))


@query(
    "stage_summary",
    """WITH m AS (SELECT event_type AS e, m FROM (SELECT event_type, props AS m, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, props) AS r FROM events WHERE value >= 100 GROUP BY 1, 2) WHERE r = 1)
    SELECT event_type AS etapa, count(*) AS n, count(*) FILTER (value < 100) AS sucesso, count(*) FILTER (value >= 100) AS falha,
      round_even(CAST(count(*) FILTER (value < 100) AS DOUBLE) / count(*) * 10000, 0) / 10000 AS taxa_sucesso, any_value(m.m) AS motivo_mais_comum FROM events JOIN m ON m.e = event_type GROUP BY 1""",
)
def stage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A35."""
    rows = table(spark, sf, "events").selectExpr("event_type AS etapa", "IF(value < 100, 'sucesso', 'falha') AS status", "props AS motivo", "user_id AS ctmt")
    return results.stage_summary(rows)


@query(
    "failure_groups",
    """SELECT event_type AS etapa, props AS motivo, count(*) AS n, string_agg(DISTINCT CAST(user_id AS VARCHAR), ', ' ORDER BY CAST(user_id AS VARCHAR)) AS ctmts FROM events WHERE value >= 100 GROUP BY 1, 2""",
)
def failure_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A35."""
    rows = table(spark, sf, "events").selectExpr("event_type AS etapa", "IF(value < 100, 'sucesso', 'falha') AS status", "props AS motivo", "user_id AS ctmt")
    return results.failure_groups(rows)


_SUP = "n AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), u AS (SELECT s_suppkey AS k, r_name AS regiao, n.n FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey JOIN n ON n.k = s_suppkey)"
_CLASS = f"""{_SUP}, r AS (SELECT *, row_number() OVER (ORDER BY n, k) AS i, count(*) OVER () AS m FROM u),
      c AS (SELECT k, regiao, n, CASE greatest(1, CAST(ceil((i - 1) * 3 / (m - 1)) AS BIGINT)) WHEN 1 THEN 'P' WHEN 2 THEN 'M' ELSE 'G' END AS porte FROM r)"""


def universe(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    base = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(
        table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")
    ).select(F.col("s_suppkey").alias("k"), F.col("r_name").alias("regiao")).join(counts, "k")
    return sample.size_class(base, "n", "k")


@query("size_class", f"WITH {_CLASS} SELECT k, regiao, n, porte FROM c")
def size_class(spark: SparkSession, sf: str) -> DataFrame:
    """W3, A40."""
    return universe(spark, sf).select("k", "regiao", "n", "porte")


@query(
    "strata_allocation",
    f"""WITH {_CLASS}, s AS (SELECT regiao, porte, count(*) AS t FROM c GROUP BY 1, 2), q AS (SELECT *, sum(t) OVER () AS tot FROM s),
      z AS (SELECT *, CAST(floor(30 * t / tot) AS BIGINT) AS w, CAST(30 * t AS BIGINT) % CAST(tot AS BIGINT) AS rest FROM q), y AS (SELECT *, 30 - sum(w) OVER () AS lft, row_number() OVER (PARTITION BY w < t ORDER BY rest DESC, t DESC, regiao DESC, porte DESC) AS i FROM z)
    SELECT regiao, porte, t AS tamanho, CAST(w + CASE WHEN w < t AND i <= lft THEN 1 ELSE 0 END AS BIGINT) AS alocados FROM y""",
)
def strata_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """W4."""
    return sample.strata_allocation(universe(spark, sf), 30)


@query(
    "stratified_sample",
    f"""WITH {_CLASS}, s AS (SELECT regiao, porte, count(*) AS t FROM c GROUP BY 1, 2), q AS (SELECT *, sum(t) OVER () AS tot FROM s),
      z AS (SELECT *, CAST(floor(30 * t / tot) AS BIGINT) AS w, CAST(30 * t AS BIGINT) % CAST(tot AS BIGINT) AS rest FROM q),
      y AS (SELECT *, 30 - sum(w) OVER () AS lft, row_number() OVER (PARTITION BY w < t ORDER BY rest DESC, t DESC, regiao DESC, porte DESC) AS i FROM z),
      a AS (SELECT regiao, porte, w + CASE WHEN w < t AND i <= lft THEN 1 ELSE 0 END AS alocados FROM y),
      d AS (SELECT c.*, sha256(concat('91:', CAST(k AS VARCHAR))) AS draw FROM c),
      o AS (SELECT *, row_number() OVER (PARTITION BY regiao, porte ORDER BY draw, k) AS r FROM d)
    SELECT k, regiao, porte, n, CAST(row_number() OVER (ORDER BY draw, regiao, porte, k) AS INTEGER) AS ordem_sorteio, 91 AS seed FROM o JOIN a USING (regiao, porte) WHERE r <= alocados""",
)
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """W4."""
    return sample.stratified_sample(universe(spark, sf), 30, 91, key="k").select("k", "regiao", "porte", "n", "ordem_sorteio", "seed")


@query(
    "diverse_top",
    """WITH s AS (SELECT s_suppkey AS ctmt, n_name AS regiao, s_name AS porte, CAST(floor(s_acctbal) AS BIGINT) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY regiao ORDER BY v DESC, porte, ctmt) AS i FROM s)
    SELECT ctmt, regiao, v AS score_viaveis FROM r ORDER BY i > 1, v DESC, regiao, porte, ctmt LIMIT 12""",
)
def diverse_top(spark: SparkSession, sf: str) -> DataFrame:
    """W10."""
    rows = table(spark, sf, "supplier").where("s_acctbal > 1").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).selectExpr(
        "s_suppkey AS ctmt", "n_name AS regiao", "s_name AS porte", "floor(s_acctbal) AS score_viaveis", "floor(s_acctbal) AS n_opcoes"
    )
    return results.diverse_top(rows, 12).select("ctmt", "regiao", "score_viaveis")


# --- sweeps --------------------------------------------------------------------------------------

_SWEEP = "s AS (SELECT user_id AS caso, CAST(day(ts) AS BIGINT) AS dia, arg_max(event_type, event_id) AS decisao FROM events GROUP BY 1, 2)"


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("caso"), F.dayofmonth("ts").cast("long").alias("dia")).agg(
        F.max_by("event_type", "event_id").alias("decisao")
    )


@query(
    "sweep_segments",
    f"""WITH {_SWEEP}, l AS (SELECT *, CASE WHEN lag(decisao) OVER w IS NOT DISTINCT FROM decisao THEN 0 ELSE 1 END AS b FROM s WINDOW w AS (PARTITION BY caso ORDER BY dia)),
      g AS (SELECT *, sum(b) OVER (PARTITION BY caso ORDER BY dia) AS g FROM l) SELECT caso, decisao, min(dia) AS de, max(dia) AS ate, count(*) AS n FROM g GROUP BY caso, g, decisao""",
)
def sweep_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Run lengths."""
    return results.sweep_segments(sweep(spark, sf), ["caso"], "dia")


@query(
    "verdict_flips",
    f"""WITH {_SWEEP}, b AS (SELECT caso, decisao AS d0 FROM s WHERE dia = 3), f AS (SELECT s.*, d0, decisao <> d0 AS v FROM s JOIN b USING (caso)),
      p AS (SELECT caso, any_value(d0) AS d0, min(dia) FILTER (v) AS p, arg_min(decisao, dia) FILTER (v) AS dn, count(*) FILTER (v) AS n FROM f GROUP BY 1),
      o AS (SELECT f.caso, count(DISTINCT decisao) = 1 AND count(*) FILTER (NOT v) = 0 AS um FROM f JOIN p ON p.caso = f.caso AND f.dia >= p.p GROUP BY 1),
      l AS (SELECT *, CASE WHEN lag(decisao) OVER w IS NOT DISTINCT FROM decisao THEN 0 ELSE 1 END AS k FROM f WINDOW w AS (PARTITION BY caso ORDER BY dia)), g AS (SELECT caso, CAST(sum(k) AS BIGINT) AS ns FROM l GROUP BY 1)
    SELECT p.caso, p.d0 AS decisao_base, p.p AS primeira_virada, p.dn AS decisao_nova, p.n AS n_viradas, coalesce(o.um, true) AS limiar_unico, g.ns AS n_segmentos FROM p LEFT JOIN o ON o.caso = p.caso JOIN g ON g.caso = p.caso""",
)
def verdict_flips(spark: SparkSession, sf: str) -> DataFrame:
    """W7, L9."""
    return results.verdict_flips(sweep(spark, sf), ["caso"], "dia", 3)


# --- benchmark runs ------------------------------------------------------------------------------

_RUN = """r AS (SELECT user_id AS tarefa, event_type AS nivel, value > 50 AS acerto, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, value,
      CASE event_type WHEN 'click' THEN 'openai/gpt-4.1-mini-2025' WHEN 'view' THEN 'gpt-4.1' WHEN 'error' THEN 'gpt-5-nano' WHEN 'signup' THEN 'fake' ELSE 'gemini-2.5-flash-lite-x' END AS modelo, event_id FROM events)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    model = (
        F.when(F.col("event_type") == "click", "openai/gpt-4.1-mini-2025").when(F.col("event_type") == "view", "gpt-4.1").when(F.col("event_type") == "error", "gpt-5-nano")
        .when(F.col("event_type") == "signup", "fake").otherwise("gemini-2.5-flash-lite-x")
    )
    return e.select(
        F.col("user_id").alias("tarefa"), F.col("event_type").alias("nivel"), (F.col("value") > 50).alias("acerto"), model.alias("modelo"), (k * 100 + 7).alias("tokens_total"), (k * 60).alias("tokens_prompt"),
        (k * 10).alias("tokens_completion"), (k > 5).alias("tokens_informados"), (F.col("value") / 1000).alias("ordem"), (F.col("value") / 500).alias("precisao"), k.alias("desnecessarias"), (k * 3).alias("chars_ferramentas"),
        F.col("value").alias("segundos_total"), (k % 4).alias("rodadas"), F.when(k == 9, "timeout").otherwise("").alias("erro"), "event_id",
    )


@query(
    "pass_at_k",
    f"""WITH RECURSIVE {_RUN}, t AS (SELECT nivel, tarefa, count(*) AS n, count(*) FILTER (acerto) AS c FROM r GROUP BY 1, 2 UNION ALL SELECT 'total', tarefa, count(*), count(*) FILTER (acerto) FROM r GROUP BY 2),
      p AS (SELECT *, CASE WHEN n - c < least(5, n) THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, least(5, n)), lambda i: CAST(n - c - i AS DOUBLE) / CAST(n - i AS DOUBLE))), lambda x, y: x * y) END AS pk FROM t),
      m AS (SELECT nivel, count(*) AS tarefas, round_even(CAST(sum(CAST(pk AS DECIMAL(28,9))) AS DOUBLE) / count(*) * 10000, 0) / 10000 AS pass_k FROM p GROUP BY 1),
      g AS (SELECT nivel, count(*) AS execucoes, count(*) FILTER (acerto) AS acertos, round_even(CAST(count(*) FILTER (acerto) AS DOUBLE) / count(*) * 10000, 0) / 10000 AS pass_1, count(*) FILTER (k = 9) AS erros,
              round_even(CAST(sum(k * 100 + 7) AS DOUBLE) / count(*) * 10, 0) / 10 AS tokens_medio FROM (SELECT * FROM r UNION ALL SELECT tarefa, 'total', acerto, k, value, modelo, event_id FROM r) GROUP BY 1)
    SELECT g.nivel, tarefas, pass_k, execucoes, acertos, pass_1, erros, tokens_medio FROM g JOIN m ON m.nivel = g.nivel""",
)
def pass_at_k_query(spark: SparkSession, sf: str) -> DataFrame:
    """A33, F17."""
    return results.run_metrics(runs(spark, sf), 5).select("nivel", "tarefas", "pass_k", "execucoes", "acertos", "pass_1", "erros", "tokens_medio")


@query("pass_ratio", "SELECT l_linenumber AS c, CASE WHEN 8 - l_linenumber < 3 THEN 1.0::DOUBLE ELSE round_even((1.0::DOUBLE - (8 - l_linenumber) * (7 - l_linenumber) * (6 - l_linenumber) / 336.0) * 1000000000, 0) / 1000000000 END AS p, count(*) AS n FROM lineitem GROUP BY 1")
def pass_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """the ratio itself for n = 8, k = 3."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("c", round_to(pass_at_k(F.lit(8), F.col("c"), F.lit(3)), 9).alias("p"), "n")


@query(
    "run_cost",
    f"""WITH {_RUN} SELECT modelo, count(*) AS n, count(*) FILTER (k > 5 AND modelo <> 'fake') AS com_preco,
      CASE WHEN modelo <> 'fake' THEN round_even(CAST(sum(CAST(CASE WHEN k > 5 THEN (k * 60 * CASE nivel WHEN 'click' THEN 0.4::DOUBLE WHEN 'view' THEN 2.0::DOUBLE WHEN 'error' THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END
        + greatest(k * 40 + 7, k * 10) * CASE nivel WHEN 'click' THEN 1.6::DOUBLE WHEN 'view' THEN 8.0::DOUBLE WHEN 'error' THEN 0.4::DOUBLE ELSE 0.4::DOUBLE END) / 1000000 END AS DECIMAL(28,12))) AS DOUBLE) * 100000000, 0) / 100000000 END AS custo FROM r GROUP BY 1""",
)
def run_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Longest model-name prefix."""
    return results.run_cost(runs(spark, sf)).groupBy("modelo").agg(
        F.count(F.lit(1)).alias("n"), F.count("custo_usd").alias("com_preco"), round_to(F.sum(F.col("custo_usd").cast("decimal(28,12)")).cast("double"), 8).alias("custo")
    )


@query(
    "lcs_score",
    # every subsequence of the first number is one bit mask; it is common if the second number holds its digits in order
    """WITH p AS (SELECT o_orderkey, string_split(CAST(o_orderkey AS VARCHAR), '') AS a, CAST(o_custkey AS VARCHAR) AS b FROM orders),
      m AS (SELECT *, unnest(range(0, CAST(1 AS BIGINT) << len(a))) AS mask FROM p),
      c AS (SELECT o_orderkey, any_value(len(a)) AS n, any_value(length(b)) AS k, max(bit_count(mask)) AS comum FROM m
        WHERE b LIKE concat('%', array_to_string(list_filter(a, lambda x, i: ((mask >> (i - 1)) & 1) = 1), '%'), '%') GROUP BY 1)
    SELECT o_orderkey, CAST(comum AS INTEGER) AS comum, round_even(comum * 1.0::DOUBLE / k * 10000, 0) / 10000 AS ordem, round_even(comum * 1.0::DOUBLE / n * 10000, 0) / 10000 AS precisao,
      CAST(greatest(n - comum, 0) AS INTEGER) AS desnecessarias FROM c""",
)
def lcs_score(spark: SparkSession, sf: str) -> DataFrame:
    """digits of the order key against digits of the customer key."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.split(F.col("o_orderkey").cast("string"), "").alias("a"), F.split(F.col("o_custkey").cast("string"), "").alias("b"))
    return rows.select("o_orderkey", *[c.alias(n) for n, c in results.sequence_score(F.col("a"), F.col("b")).items()])


@query("answer_numbers")
def answer_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in whole documents and whether one equals the document's length."""
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", F.size(results.numbers_in(F.col("text"))).alias("n_numeros"), results.number_hit(F.col("text"), F.col("n_chars").cast("double")).alias("acerto")
    )


@query(
    "proposal_hits",
    """SELECT o_orderstatus, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS certas, count(*) AS n FROM orders GROUP BY 1""",
)
def proposal_hits(spark: SparkSession, sf: str) -> DataFrame:
    """L10."""
    hit = results.proposal_hit(F.lit(True), F.col("o_orderpriority"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_if(hit).alias("certas"), F.count(F.lit(1)).alias("n"))


# --- rules and plan checks -----------------------------------------------------------------------

RULES = [
    impact.Restriction("r1", forbidden=["Supplier#000000001", "K7"]),
    impact.Restriction("r2", avoid=["nation 1"]),
    impact.Restriction("r3", remote_only=True),
]


@query(
    "rule_blocks",
    """WITH s AS (SELECT s_name AS chave, n_name AS fonte, s_acctbal > 0 AS tlcd, concat('K', s_suppkey) AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey),
      m AS (SELECT *, CASE WHEN chave = 'Supplier#000000001' THEN 'r1: usa chave proibida Supplier#000000001' WHEN k = 'K7' THEN 'r1: usa chave proibida K7' END AS a,
        CASE WHEN fonte = 'NATION_1' THEN 'r2: evita alimentar pela fonte NATION_1' WHEN fonte LIKE 'NATION_1%' THEN concat('r2: evita alimentar pela fonte ', fonte, ' (casamento aproximado: nation 1 casou com ', fonte, ' por prefixo)') END AS b,
        CASE WHEN NOT tlcd THEN concat('r3: exige só telecomandadas; há manobra local em ', chave) END AS c FROM s)
    SELECT chave, nullif(concat_ws('; ', a, b, c), '') AS bloqueio FROM m""",
)
def rule_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """L7, J18."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_name").alias("chave"), F.col("n_name").alias("fonte"), F.lit("").alias("ctmt_chave"), (F.col("s_acctbal") > 0).alias("tlcd"),
        F.array(F.concat(F.lit("K"), F.col("s_suppkey").cast("string"))).alias("switches"), F.lit(None).cast("array<string>").alias("manual"),
    )
    return impact.rule_blocks(rows, RULES).select("chave", "bloqueio")


@query(
    "equivalent_best",
    """WITH b AS (SELECT l_suppkey AS s, max(l_tax) AS m, arg_min(l_linenumber, (-l_tax, l_orderkey, l_partkey, l_linenumber)) AS c FROM lineitem GROUP BY 1)
    SELECT s AS l_suppkey, count(*) AS n FROM lineitem JOIN b ON b.s = l_suppkey AND l_linenumber = b.c AND l_tax >= b.m - 0.005 GROUP BY 1""",
)
def equivalent_best(spark: SparkSession, sf: str) -> DataFrame:
    """W6, P11."""
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", F.struct("l_orderkey", "l_partkey", "l_linenumber").alias("chave"), F.col("l_tax").alias("margem"), F.col("l_linenumber").alias("clientes")
    )
    return impact.equivalent_best(rows, ["l_suppkey"], 0.005).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "plan_checks",
    """WITH st AS (SELECT l_orderkey AS p, l_linenumber AS k, CASE WHEN l_returnflag = 'R' THEN 'fechar' ELSE 'abrir' END AS a, l_partkey AS s FROM lineitem),
      kn AS (SELECT p_partkey AS s, p_size < 10 AS o FROM part WHERE p_size <= 48),
      pp AS (SELECT p, count(*) FILTER (kn.s IS NULL) AS u, min(k) FILTER (a = 'fechar') AS fc, max(k) FILTER (a = 'abrir') AS lo FROM st LEFT JOIN kn ON kn.s = st.s GROUP BY 1),
      bd AS (SELECT o_orderstatus AS sc, min(l_partkey) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
      ms AS (SELECT o_orderkey AS p FROM orders JOIN bd ON sc = o_orderstatus JOIN kn ON kn.s = bd.s AND NOT kn.o WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.p = o_orderkey AND st.s = bd.s AND st.a = 'abrir'))
    SELECT o_orderkey AS plan_id, coalesce(u, 0) = 0 AS chaves_existem, NOT coalesce(fc < lo, false) AS abre_antes_de_fechar, ms.p IS NULL AS fronteira_isolada,
      coalesce(u, 0) = 0 AND NOT coalesce(fc < lo, false) AND ms.p IS NULL AS ok FROM orders LEFT JOIN pp ON pp.p = o_orderkey LEFT JOIN ms ON ms.p = o_orderkey""",
)
def plan_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is an isolate-only plan whose lines are the steps."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    plans = orders.select(F.col("o_orderkey").alias("plan_id"), F.col("o_orderstatus").alias("scenario"), F.lit(None).cast("string").alias("chave"))
    steps = lines.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step"), F.when(F.col("l_returnflag") == "R", "fechar").otherwise("abrir").alias("action"), F.col("l_partkey").cast("string").alias("switch_id"))
    known = table(spark, sf, "part").where("p_size <= 48").select(F.col("p_partkey").cast("string").alias("switch_id"), (F.col("p_size") < 10).alias("open"))
    boundary = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderstatus").alias("scenario")).agg(F.min("l_partkey").cast("string").alias("switch_id"))
    options = boundary.selectExpr(
        "scenario", "switch_id AS chave", "CAST(NULL AS STRING) AS bloqueio", "true AS converged", "1.0D AS vmin_mt_pu", "1.0D AS vmax_mt_pu", "0.5D AS margem", "0 AS n_sobrecargas", "false AS viavel"
    )
    return impact.plan_checks(plans, steps, known, boundary, options).select("plan_id", "chaves_existem", "abre_antes_de_fechar", "fronteira_isolada", "ok")


# --- loads ---------------------------------------------------------------------------------------


@query(
    "calendar_days",
    """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS ano FROM orders),
      e0 AS (SELECT ano, ano % 19 AS a, ano // 100 AS b, ano % 100 AS c FROM y),
      e1 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e0),
      e2 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM e1),
      e3 AS (SELECT *, h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114 AS q FROM e2),
      e AS (SELECT ano, make_date(ano, CAST(q // 31 AS INTEGER), CAST(q % 31 + 1 AS INTEGER)) AS pascoa FROM e3),
      d AS (SELECT ano, pascoa, CAST(unnest(generate_series(make_date(ano, 1, 1), make_date(ano, 12, 31), INTERVAL 1 DAY)) AS DATE) AS d FROM e),
      k AS (SELECT ano, CAST(month(d) AS INTEGER) AS mes, isodow(d) AS w, (date_diff('day', pascoa, d) IN (-2, -47, 60) OR (month(d), day(d)) IN ((1,1),(4,21),(5,1),(9,7),(10,12),(11,2),(11,15),(12,25)) OR (ano >= 2024 AND month(d) = 11 AND day(d) = 20)) AS f FROM d)
    SELECT ano, mes, count(*) FILTER (w <= 5 AND NOT f) AS "DU", count(*) FILTER (w = 6) AS "SA", count(*) FILTER (w = 7 OR (w <= 5 AND f)) AS "DO" FROM k GROUP BY 1, 2""",
)
def calendar_days(spark: SparkSession, sf: str) -> DataFrame:
    """F5."""
    return load.day_counts(table(spark, sf, "orders").select(F.year("o_orderdate").alias("ano")))


@query(
    "profile_resample",
    """WITH e AS (SELECT vec_id, embedding AS v, unnest(range(0, 24)) AS i FROM embeddings) SELECT vec_id, CAST(i AS INTEGER) AS hora, (0.0::DOUBLE + CAST(v[2 * i + 1] AS DOUBLE) + CAST(v[2 * i + 2] AS DOUBLE)) / 2 AS media FROM e""",
)
def profile_resample(spark: SparkSession, sf: str) -> DataFrame:
    """64 values to 24 block means."""
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(load.resample(F.col("embedding"))).alias("hora", "media"))


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """Curve = return flag, day type = weekday of shipping, value per month = shipped quantity."""
    day = F.when(F.weekday("l_shipdate") == 5, "SA").when(F.weekday("l_shipdate") == 6, "DO").otherwise("DU")
    months = [F.sum(F.when(F.month("l_shipdate") == m, F.col("l_quantity"))).alias(f"m{m}") for m in range(1, 13)]
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("COD_ID"), day.alias("TIP_DIA")).agg(*months)
    return wide.withColumn("v", F.array(*[F.col(f"m{m}") for m in range(1, 13)]))


_CURVE = """q AS (SELECT l_returnflag AS c, CASE isodow(l_shipdate) WHEN 6 THEN 'SA' WHEN 7 THEN 'DO' ELSE 'DU' END AS t, month(l_shipdate) AS m, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
      f AS (SELECT c, t, sum(q) AS s, max(q) AS pk FROM q GROUP BY 1, 2), p AS (SELECT *, s / sum(s) OVER (PARTITION BY c) AS prop, (s / 24) / pk AS fc FROM f)"""


@query("curve_profiles", f"WITH {_CURVE} SELECT c AS COD_ID, t AS TIP_DIA, round_even(fc * 1000000000, 0) / 1000000000 AS fc, s AS soma, round_even(prop * 1000000000, 0) / 1000000000 AS prop FROM p")
def curve_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """F6."""
    out = load.curve_profiles(curves(spark, sf), values=F.col("v"))
    return out.select("COD_ID", "TIP_DIA", round_to(F.col("fc"), 9).alias("fc"), "soma", round_to(F.col("prop"), 9).alias("prop"))


@query(
    "peak_factors",
    f"""WITH {_CURVE}, g AS (SELECT c, max(prop) FILTER (t = 'DU') AS pu, max(prop) FILTER (t = 'SA') AS ps, max(prop) FILTER (t = 'DO') AS pd, max(fc) FILTER (t = 'DU') AS fc FROM p GROUP BY 1)
    SELECT c AS COD_ID, round_even(pu * 22 / (pu * 22 + ps * 4 + pd * 5) / (22 * 24 * fc) * 1000000000000, 0) / 1000000000000 AS fator FROM g""",
)
def peak_factors(spark: SparkSession, sf: str) -> DataFrame:
    """January 2025 (22 working days, 4 Saturdays, 4 Sundays and one holiday)."""
    years = table(spark, sf, "orders").select((F.year("o_orderdate") * 0 + 2025).alias("ano"))
    factors = load.peak_factors(load.curve_profiles(curves(spark, sf), values=F.col("v")), load.day_counts(years), "DU", [2025])
    return factors.where("mes = 1").select("COD_ID", round_to(F.col("fator"), 12).alias("fator"))


@query(
    "unique_names",
    """SELECT concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS COD_ID, CASE WHEN count(*) OVER (PARTITION BY l_partkey) > 1
      THEN concat(l_partkey, '_', row_number() OVER (PARTITION BY l_partkey ORDER BY concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber))) ELSE CAST(l_partkey AS VARCHAR) END AS nome FROM lineitem""",
)
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    """W9."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("ramal"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("COD_ID"))
    return load.unique_names(rows, "ramal").select("COD_ID", "nome")


@query(
    "merge_duplicates",
    "SELECT l_orderkey AS COD_ID, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) AS ENE_01, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY 1",
)
def merge_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """A25."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("COD_ID"), F.col("l_quantity").alias("ENE_01"), "l_partkey", "l_suppkey", "l_linenumber")
    return load.merge_duplicates(rows, order=["l_linenumber", "l_partkey", "l_suppkey"]).select("COD_ID", "ENE_01", "l_partkey")


@query(
    "phase_rebalance",
    """WITH RECURSIVE r AS MATERIALIZED (
      SELECT CAST(l_suppkey AS VARCHAR) AS t, l_quantity AS kw, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS own, l_linenumber < 4 AS three,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey), l_quantity) AS i FROM lineitem),
      w(t, i, a, b, c, kw, own, p) AS (
        SELECT DISTINCT t, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0 FROM r
        UNION ALL SELECT t, i, CASE WHEN p = 1 THEN a + kw ELSE a END, CASE WHEN p = 2 THEN b + kw ELSE b END, CASE WHEN p = 3 THEN c + kw ELSE c END, kw, own, p FROM (
          SELECT r.t, r.i, w.a, w.b, w.c, r.kw, r.own, CASE WHEN w.a <= w.b AND (NOT three OR w.a <= w.c) THEN 1 WHEN NOT three OR w.b <= w.c THEN 2 ELSE 3 END AS p
          FROM w JOIN r ON r.t = w.t AND r.i = w.i + 1))
    SELECT t AS uni_tr_mt, CASE p WHEN 1 THEN 'AN' WHEN 2 THEN 'BN' ELSE 'CN' END AS nova_fase, count(*) AS n, count(*) FILTER (p <> own) AS trocas, sum(kw) AS kw FROM w WHERE i > 0 GROUP BY 1, 2""",
)
def phase_rebalance(spark: SparkSession, sf: str) -> DataFrame:
    """L4: greedy in the order of node and load inside each supplier."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("uni_tr_mt"), F.col("l_partkey").alias("pac"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("carga"), F.col("l_quantity").alias("kw_curva"),
        F.when(F.col("l_returnflag") == "A", "AN").when(F.col("l_returnflag") == "N", "BN").otherwise("CN").alias("fas_con"),
        F.when(F.col("l_linenumber") < 4, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2))).alias("fases_permitidas"),
    )
    moved = load.rebalance_phases(rows, order=("pac", "carga", "kw_curva"))
    return moved.groupBy("uni_tr_mt", "nova_fase").agg(F.count(F.lit(1)).alias("n"), F.count_if("trocou").alias("trocas"), F.sum("kw_curva").alias("kw"))


# --- small functions -----------------------------------------------------------------------------


@query(
    "geojson_lines",
    """SELECT concat('{"type":"Feature","tippecanoe":{"minzoom":9,"layer":"VEC"},"properties":{"vec_id":', vec_id, ',"label":', label, ',"nada":null},"geometry":{"type":"Point","coordinates":[', label, '.0,', vec_id, '.0]}}') AS value FROM embeddings""",
)
def geojson_lines(spark: SparkSession, sf: str) -> DataFrame:
    """S9."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.lit(None).cast("string").alias("nada"))
    return feature_lines(rows, "VEC", ["vec_id", "label", "nada"], point_json(F.col("label").cast("double"), F.col("vec_id").cast("double")), 9)


@query(
    "json_path",
    """SELECT event_id, regexp_extract(props, '(\\d+)', 1) AS k, CAST(1 AS INTEGER) AS n, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) + 2 AS soma FROM events""",
)
def json_path_query(spark: SparkSession, sf: str) -> DataFrame:
    """P12."""
    e = table(spark, sf, "events")
    listed = F.concat(F.lit('{"a":{"b":[{"c":'), F.col("props"), F.lit('}],"v":['), F.get_json_object("props", "$.k"), F.lit(",2]}}"))
    return e.select("event_id", json_path(listed, "a.b[0].c.k").alias("k"), json_path(listed, "len(a.b)").alias("n"), json_path(listed, "sum(a.v)").alias("soma"))


@query(
    "masked_tokens",
    """SELECT event_id, concat('{"token":"sha256:', substr(sha256(concat('t', event_id)), 1, 12), '","k":1}') AS payload, sha256(props) AS resultado_sha256 FROM events""",
)
def masked_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """P14."""
    e = table(spark, sf, "events")
    payload = F.concat(F.lit('{"token":"t'), F.col("event_id").cast("string"), F.lit('","k":1}'))
    return e.select("event_id", mask_tokens(payload, ["token"]).alias("payload"), result_hash(F.col("props")).alias("resultado_sha256"))


@query(
    "distance_km",
    """SELECT s_suppkey, round_even(sqrt(power(s_acctbal / 100000 * 111.32, 2) + power(s_nationkey / 100.0 * 111.32 * cos(radians((-22.9 + (-22.9 + s_acctbal / 100000)) / 2)), 2)) * 1000000, 0) / 1000000 AS km FROM supplier""",
)
def distance_km_query(spark: SparkSession, sf: str) -> DataFrame:
    """F2."""
    s = table(spark, sf, "supplier")
    d = distance_km(F.lit(-22.9), F.lit(-43.2), F.lit(-22.9) + F.col("s_acctbal") / 100000, F.lit(-43.2) + F.col("s_nationkey") / 100.0)
    return s.select("s_suppkey", round_to(d, 6).alias("km"))
