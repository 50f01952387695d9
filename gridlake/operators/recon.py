"""Reconciliation of the public generation register with the asset base."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.columns import code_text, exact_sum, percent, round_to, text_or_empty
from gridlake.functions.keyed import first_per_key, mode_per_key, sorted_text_list
from gridlake.sources.catalog import LayerCatalog

EXACT, AMBIGUOUS, UNMATCHED = "match_exato", "match_ambiguo", "sem_match"


def match_map(base: DataFrame) -> DataFrame:
    """One row per generator code: feeders, regions, town, summed kW, source layers, ids.

    Each list is built from the distinct values of a code, so repeated rows of one code collapse
    before any list exists.
    """
    coded = base.where(F.col("ceg_gd") != "")
    return coded.groupBy("ceg_gd").agg(
        sorted_text_list(F.col("ctmt")).alias("ctmt"),
        F.size(F.collect_set("ctmt")).cast("long").alias("n_ctmt"),
        sorted_text_list(F.col("conj")).alias("conj"),
        F.min_by(
            "cod_municipio_base",
            F.struct(F.col("cod_municipio_base").isNull(), F.col("camada_origem"), F.col("cod_id_base")),
        ).alias("cod_municipio_base"),
        exact_sum(F.col("potencia_kw_base")).alias("potencia_kw_base"),
        sorted_text_list(F.col("camada_origem")).alias("camadas_base"),
        sorted_text_list(F.col("cod_id_base")).alias("codigos_base"),
        (F.count(F.lit(1)) > 1).alias("duplicado_mesmo_ctmt"),
    )


def reconcile(register: DataFrame, base: DataFrame) -> DataFrame:
    """Register rows with their base counterpart, match status and kW difference."""
    joined = register.join(
        match_map(base), F.col("cod_empreendimento") == F.col("ceg_gd"), "left"
    )
    return joined.withColumn(
        "status_juncao",
        F.when(F.col("n_ctmt") > 1, AMBIGUOUS).when(F.col("ceg_gd").isNotNull(), EXACT).otherwise(UNMATCHED),
    ).withColumn(
        "delta_kw", round_to(F.col("potencia_kw") - F.coalesce("potencia_kw_base", F.lit(0.0)), 6)
    )


def evidence(register: DataFrame, base: DataFrame, compared: DataFrame) -> DataFrame:
    """Coverage on both sides in one row (J10): one conditional aggregate per side."""
    status, kw = F.col("status_juncao"), F.col("potencia_kw")

    def part(condition, n, k, value):
        return [
            F.count_if(condition).alias(n),
            F.coalesce(exact_sum(F.when(condition, value)), F.lit(0.0)).alias(k),
        ]

    left = compared.agg(
        F.count(F.lit(1)).alias("n_mmgd"), F.coalesce(exact_sum(kw), F.lit(0.0)).alias("kw_mmgd"),
        *part(status == EXACT, "n_mmgd_com_match", "kw_mmgd_com_match", kw),
        *part(status == UNMATCHED, "n_mmgd_sem_match", "kw_mmgd_sem_match", kw),
        F.count_if(status == AMBIGUOUS).alias("n_ceg_ambiguos"),
    )
    codes = register.select(F.col("cod_empreendimento").alias("ceg_gd")).distinct().withColumn("_hit", F.lit(True))
    hit, bkw = F.coalesce(F.col("_hit"), F.lit(False)), F.col("potencia_kw_base")
    blank = F.col("ceg_gd") == ""
    marked = base.join(codes, "ceg_gd", "left")
    right = marked.agg(
        F.count(F.lit(1)).alias("n_base"), F.coalesce(exact_sum(bkw), F.lit(0.0)).alias("kw_base"),
        *part(hit, "n_base_com_match", "kw_base_com_match", bkw),
        *part(~hit, "n_base_sem_match", "kw_base_sem_match", bkw),
        *part(blank, "n_base_sem_codigo", "kw_base_sem_codigo", bkw),
        F.count_distinct(
            F.when(~blank & (F.coalesce(F.col("linhas_origem_duplicadas"), F.lit(1)) > 1), F.col("ceg_gd"))
        ).alias("n_ceg_duplicados"),
    )
    # two one-row results side by side on a constant key
    one = F.lit(1).alias("_one")
    return left.select(one, "*").join(F.broadcast(right.select(one, "*")), "_one").drop("_one")


def by_feeder(compared: DataFrame, feeders: DataFrame) -> DataFrame:
    """Exact matches per feeder, joined to every feeder.

    ``feeders``: COD_ID, NOME, SUB, SUB_NOME, MUN, CONJ_CODIGO, CONJ_NOME, kVA_instalado, kW_DER, n_DER.
    """
    exact = compared.where(F.col("status_juncao") == EXACT)
    unique = first_per_key(
        exact.select(
            "ctmt", "cod_empreendimento", "potencia_kw", "potencia_kw_base", "fonte_normalizada",
            "classe_normalizada", "subgrupo_normalizado", "data_atualizacao_cadastral",
        ),
        ["ctmt", "cod_empreendimento"],
        ["data_atualizacao_cadastral", "potencia_kw", "fonte_normalizada", "classe_normalizada", "subgrupo_normalizado"],
    )
    totals = unique.groupBy("ctmt").agg(
        F.count(F.lit(1)).alias("empreendimentos_mmgd"),
        exact_sum(F.col("potencia_kw")).alias("potencia_kw_mmgd"),
        exact_sum(F.col("potencia_kw_base")).alias("potencia_kw_base_mesmas_chaves"),
        F.date_format(F.min("data_atualizacao_cadastral"), "yyyy-MM-dd").alias("periodo_primeira_data"),
        F.date_format(F.max("data_atualizacao_cadastral"), "yyyy-MM-dd").alias("periodo_ultima_data"),
    )
    for column, out in (
        ("fonte_normalizada", "fonte_predominante"),
        ("classe_normalizada", "classe_predominante"),
        ("subgrupo_normalizado", "subgrupo_predominante"),
    ):
        totals = totals.join(weighted_mode(unique, ["ctmt"], column, "potencia_kw", out), "ctmt", "left")
    table = feeders.join(totals.withColumnRenamed("ctmt", "COD_ID"), "COD_ID", "left")
    zero, none = F.lit(0.0), F.lit("")
    table = table.withColumns(
        {
            "empreendimentos_mmgd": F.coalesce("empreendimentos_mmgd", F.lit(0)).cast("long"),
            "potencia_kw_mmgd": F.coalesce("potencia_kw_mmgd", zero),
            "potencia_kw_base_mesmas_chaves": F.coalesce("potencia_kw_base_mesmas_chaves", zero),
            **{
                c: F.coalesce(c, none)
                for c in ("fonte_predominante", "classe_predominante", "subgrupo_predominante",
                          "periodo_primeira_data", "periodo_ultima_data", "CONJ_CODIGO", "CONJ_NOME")
            },
        }
    )
    kw, der = F.col("potencia_kw_mmgd"), F.col("kW_DER")
    return table.withColumns(
        {
            "diferenca_kw_mesmas_chaves": kw - F.col("potencia_kw_base_mesmas_chaves"),
            "diferenca_kw_total": round_to(kw - der, 6),
            "penetracao_gd_pct": percent(kw, F.col("kVA_instalado")),
            "cobertura_vs_base_pct": F.when(der > 0, percent(kw, der)).otherwise(zero),
        }
    ).select(
        "COD_ID", "NOME", "SUB", "SUB_NOME", "MUN", "CONJ_CODIGO", "CONJ_NOME", "kVA_instalado",
        "kW_DER", "n_DER", "empreendimentos_mmgd", "potencia_kw_mmgd",
        "potencia_kw_base_mesmas_chaves", "diferenca_kw_mesmas_chaves", "diferenca_kw_total",
        "penetracao_gd_pct", "cobertura_vs_base_pct", "fonte_predominante", "classe_predominante",
        "subgrupo_predominante", "periodo_primeira_data", "periodo_ultima_data",
    )


def weighted_mode(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Heaviest non-blank text per key, ties to the smaller text."""
    clean = df.withColumn("_v", F.nullif(F.trim(F.coalesce(F.col(value), F.lit(""))), F.lit("")))
    w = F.coalesce(F.col(weight), F.lit(0.0)).cast("decimal(28,6)")
    return mode_per_key(clean, keys, "_v", w, out)


def by_region(feeder_rows: DataFrame) -> DataFrame:
    """Reliability regions: feeders, projects, kW, kVA, penetration, predominant source."""
    keys = ["CONJ_CODIGO", "CONJ_NOME"]
    base = feeder_rows.where(F.col("CONJ_CODIGO") != "")
    totals = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alimentadores"),
        F.sum("empreendimentos_mmgd").alias("empreendimentos_mmgd"),
        exact_sum(F.col("potencia_kw_mmgd")).alias("potencia_kw_mmgd"),
        exact_sum(F.col("kW_DER")).alias("potencia_kw_base_total"),
        exact_sum(F.col("kVA_instalado")).alias("kVA_instalado_total"),
    )
    source = weighted_mode(base, keys, "fonte_predominante", "potencia_kw_mmgd", "fonte_predominante")
    return totals.join(source, keys, "left").select(
        *totals.columns,
        percent(F.col("potencia_kw_mmgd"), F.col("kVA_instalado_total")).alias("penetracao_gd_pct"),
        F.coalesce("fonte_predominante", F.lit("")).alias("fonte_predominante"),
    )


def unmatched_by_town(compared: DataFrame, feeders: DataFrame) -> DataFrame:
    """Everything that is not an exact match, by town, with the candidate feeders there."""
    candidates = feeders.groupBy(F.col("MUN").alias("cod_municipio_ibge")).agg(
        F.count_distinct("COD_ID").alias("alimentadores_base"),
        F.count_distinct("CONJ_CODIGO").alias("conjuntos_base"),
    )
    residue = compared.where(F.col("status_juncao") != EXACT)
    totals = residue.where(F.col("cod_municipio_ibge").isNotNull()).groupBy(
        "cod_municipio_ibge", "municipio"
    ).agg(
        F.count_distinct("cod_empreendimento").alias("empreendimentos_sem_chave"),
        exact_sum(F.col("potencia_kw")).alias("potencia_kw_sem_chave"),
    )
    return totals.join(candidates, "cod_municipio_ibge", "left").select(
        *totals.columns,
        F.coalesce("alimentadores_base", F.lit(0)).alias("alimentadores_base"),
        F.coalesce("conjuntos_base", F.lit(0)).alias("conjuntos_base"),
    )


def yearly_evolution(register: DataFrame) -> DataFrame:
    """Projects and kW per year."""
    return register.where(F.col("ano_conexao").isNotNull()).groupBy(F.col("ano_conexao").alias("ano")).agg(
        F.count_distinct("cod_empreendimento").alias("empreendimentos"),
        exact_sum(F.col("potencia_kw")).alias("potencia_kw"),
    )


def top_divergences(compared: DataFrame, limit: int = 25, threshold: float = 0.001) -> DataFrame:
    """Largest kW differences among exact matches."""
    rows = compared.where(
        (F.col("status_juncao") == EXACT) & (F.abs("delta_kw") > threshold)
    ).select("cod_empreendimento", "municipio", "ctmt", "potencia_kw", "potencia_kw_base", "delta_kw")
    return rows.orderBy(F.abs("delta_kw").desc(), "cod_empreendimento").limit(limit)


def feeder_regions(catalog: LayerCatalog, layers: Sequence[str] = ("UCBT_tab", "UCMT_tab", "UGBT_tab", "UGMT_tab", "UNTRMT")) -> DataFrame:
    """Commonest region code per feeder over several layers (A5)."""
    parts = []
    for layer in layers:
        if catalog.has(layer) and {"CTMT", "CONJ"} <= set(catalog.columns(layer)):
            df = catalog.read(layer, ["CTMT", "CONJ"])
            is_float = dict(df.dtypes)["CONJ"] in ("double", "float")
            parts.append(
                df.select(
                    F.nullif(text_or_empty(F.col("CTMT")), F.lit("")).alias("CTMT"),
                    F.nullif(code_text(F.col("CONJ"), is_float), F.lit("")).alias("CONJ"),
                )
            )
    if not parts:
        return catalog.empty(["CTMT", "CONJ"])
    union = reduce(DataFrame.unionByName, parts).where(F.col("CTMT").isNotNull())
    return mode_per_key(union, ["CTMT"], "CONJ")


def feeder_region_cascade(catalog: LayerCatalog) -> DataFrame:
    """COD_ID, CONJ_CODIGO, CONJ_NOME: own code, else the commonest of customers / transformers;
    a ``;`` list is named part by part; without a name the code stands in (J19)."""
    own = catalog.table("CTMT", ["COD_ID", "CONJ"])
    is_float = dict(own.dtypes)["CONJ"] in ("double", "float")
    own = own.select("COD_ID", code_text(F.col("CONJ"), is_float).alias("_own"))
    if not catalog.has("CONJ"):
        return own.select("COD_ID", F.col("_own").alias("CONJ_CODIGO"), F.lit("").alias("CONJ_NOME"))
    derived = feeder_regions(catalog, ("UCBT_tab", "UCMT_tab", "UNTRMT")).select(
        F.col("CTMT").alias("COD_ID"), F.col("CONJ").alias("_derived")
    )
    coded = own.join(derived, "COD_ID", "left").select(
        "COD_ID",
        F.when(F.col("_own") != "", F.col("_own")).otherwise(F.coalesce("_derived", F.lit(""))).alias("CONJ_CODIGO"),
    )
    names = first_per_key(
        catalog.table("CONJ", ["COD_ID", "NOME"]).select(
            code_text(F.col("COD_ID")).alias("_code"), F.coalesce(F.col("NOME"), F.lit("")).alias("_name")
        ),
        ["_code"], ["_name"],
    )
    # every code of a list is looked up on its own row, then the names are put back in order
    parts = coded.select("COD_ID", "CONJ_CODIGO", F.posexplode(F.split("CONJ_CODIGO", ";")).alias("_at", "_code"))
    named = parts.join(names, "_code", "left").groupBy("COD_ID", "CONJ_CODIGO").agg(
        F.array_join(
            F.transform(
                F.filter(
                    F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_name", F.lit("")).alias("n")))),
                    lambda s: s["n"] != "",
                ),
                lambda s: s["n"],
            ),
            ";",
        ).alias("_names")
    )
    return named.select(
        "COD_ID", "CONJ_CODIGO",
        F.when(F.col("_names") != "", F.col("_names")).otherwise(F.col("CONJ_CODIGO")).alias("CONJ_NOME"),
    )
