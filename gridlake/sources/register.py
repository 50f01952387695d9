"""Public distributed-generation register: reading and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridlake.functions.columns import (
    code_text,
    number,
    text_or_empty,
    timestamp_day_first,
    timestamp_iso,
    whole_number,
)

# Register column -> (name used here, kind). Kinds: t text, d date, s timestamp,
# i whole number, f number, r raw.
REGISTER_COLUMNS = {
    "DatGeracaoConjuntoDados": ("data_geracao_conjunto", "d"),
    "AnmPeriodoReferencia": ("periodo_referencia", "r"),
    "NumCNPJDistribuidora": ("cnpj_distribuidora", "t"),
    "SigAgente": ("sigla_agente", "t"),
    "NomAgente": ("nome_agente", "t"),
    "CodClasseConsumo": ("cod_classe_consumo", "t"),
    "DscClasseConsumo": ("classe_consumo", "t"),
    "CodSubGrupoTarifario": ("cod_subgrupo_tarifario", "t"),
    "DscSubGrupoTarifario": ("subgrupo_tarifario", "t"),
    "CodUFibge": ("cod_uf_ibge", "i"),
    "SigUF": ("uf", "t"),
    "CodRegiao": ("cod_regiao", "i"),
    "NomRegiao": ("regiao", "t"),
    "CodMunicipioIbge": ("cod_municipio_ibge", "i"),
    "NomMunicipio": ("municipio", "t"),
    "CodCEP": ("cep", "t"),
    "SigTipoConsumidor": ("tipo_consumidor", "t"),
    "NumCPFCNPJ": ("cpf_cnpj_titular", "t"),
    "CodEmpreendimento": ("cod_empreendimento", "t"),
    "DthAtualizaCadastralEmpreend": ("data_atualizacao_cadastral", "s"),
    "SigModalidadeEmpreendimento": ("sigla_modalidade", "t"),
    "DscModalidadeHabilitado": ("modalidade", "t"),
    "QtdUCRecebeCredito": ("qtd_uc_recebe_credito", "i"),
    "SigTipoGeracao": ("sig_tipo_geracao", "t"),
    "DscFonteGeracao": ("fonte_geracao", "t"),
    "DscPorte": ("porte", "t"),
    "MdaPotenciaInstaladaKW": ("potencia_kw", "f"),
    "NomSubEstacao": ("subestacao", "t"),
    "NumCoordESub": ("coord_e_sub", "f"),
    "NumCoordNSub": ("coord_n_sub", "f"),
    "NomTitularEmpreendimento": ("titular", "t"),
}
_PARSERS = {
    "t": text_or_empty,
    "d": lambda c: timestamp_iso(c).cast("date"),
    "s": timestamp_iso,
    "i": whole_number,
    "f": number,
    "r": lambda c: c,
}


def read_register(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Register from parquet or ``;``-separated text, gzip included; zips are unpacked upstream."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        df = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    else:
        raise ValueError(f"unsupported register format: {fmt}")
    return check_register(df)


def check_register(df: DataFrame) -> DataFrame:
    missing = sorted(set(REGISTER_COLUMNS) - set(df.columns))
    if missing:
        raise KeyError(f"register columns missing: {', '.join(missing)}")
    return df.select(*REGISTER_COLUMNS)


def empty_register(spark: SparkSession) -> DataFrame:
    schema = StructType([StructField(c, StringType()) for c in REGISTER_COLUMNS])
    return spark.createDataFrame([], schema)


def label(first: Column, second: Column, joiner, missing: str = "não informada") -> Column:
    """``joiner(first, second)`` when both exist, else the one that does, else ``missing``."""
    a, b = text_or_empty(first), text_or_empty(second)
    return (
        F.when((a != "") & (b != ""), joiner(a, b))
        .when(a != "", a)
        .when(b != "", b)
        .otherwise(F.lit(missing))
    )


def normalise_register(df: DataFrame, *, tax_id: str, state: str, agent: str) -> DataFrame:
    """Typed, renamed register rows of one utility (tax id, state and name all equal)."""
    df = check_register(df)
    typed = df.select(*[_PARSERS[k](F.col(c)).alias(n) for c, (n, k) in REGISTER_COLUMNS.items()])
    mine = typed.where(
        (F.col("cnpj_distribuidora") == tax_id) & (F.col("uf") == state) & (F.col("nome_agente") == agent)
    )
    return mine.withColumns(
        {
            "ano_conexao": F.year("data_atualizacao_cadastral"),
            "fonte_normalizada": label(
                F.col("sig_tipo_geracao"), F.col("fonte_geracao"), lambda a, b: F.concat_ws(" — ", a, b)
            ),
            "classe_normalizada": label(
                F.col("classe_consumo"), F.col("cod_classe_consumo"),
                lambda a, b: F.concat(a, F.lit(" ("), b, F.lit(")")),
            ),
            "subgrupo_normalizado": F.when(
                F.col("subgrupo_tarifario") != "", F.col("subgrupo_tarifario")
            ).otherwise(F.lit("sem subgrupo")),
        }
    )


def asset_generators(catalog) -> DataFrame:
    """LV and MV generators in one shape, deduplicated on (code, feeder, id).

    Copies are counted in ``linhas_origem_duplicadas``; the kept row is the one of the first layer
    name, then of the smaller transformer and connection date.
    """
    wanted = ["COD_ID", "CEG_GD", "CTMT", "UNI_TR_MT", "CONJ", "MUN", "POT_INST", "DAT_CON"]
    union: DataFrame | None = None
    for layer in ("UGBT_tab", "UGMT_tab"):
        part = catalog.table(layer, wanted)
        is_float = dict(part.dtypes)["CONJ"] in ("double", "float")
        part = part.withColumn("CONJ", code_text(F.col("CONJ"), is_float)).withColumn("camada_origem", F.lit(layer))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    clean = union.select(
        text_or_empty(F.col("COD_ID")).alias("cod_id_base"),
        text_or_empty(F.col("CEG_GD")).alias("ceg_gd"),
        text_or_empty(F.col("CTMT")).alias("ctmt"),
        text_or_empty(F.col("UNI_TR_MT")).alias("uni_tr_mt"),
        F.col("CONJ").alias("conj"),
        whole_number(F.col("MUN")).alias("cod_municipio_base"),
        F.coalesce(number(F.col("POT_INST")), F.lit(0.0)).alias("potencia_kw_base"),
        text_or_empty(F.col("DAT_CON")).alias("dat_con"),
        "camada_origem",
    )
    keys = ["ceg_gd", "ctmt", "cod_id_base"]
    rest = ["camada_origem", "uni_tr_mt", "dat_con", "conj", "cod_municipio_base", "potencia_kw_base"]
    kept = clean.groupBy(*keys).agg(
        F.min(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("linhas_origem_duplicadas")
    )
    return kept.select(*keys, "_row.*", "linhas_origem_duplicadas").withColumn(
        "data_conexao_base", timestamp_day_first(F.col("dat_con"))
    )


__all__ = [
    "REGISTER_COLUMNS", "asset_generators", "check_register", "empty_register",
    "label", "normalise_register", "read_register",
]
