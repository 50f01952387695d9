"""Tie atlas: which feeders can help which, over the whole utility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.columns import percent
from gridlake.functions.keyed import sorted_text_list
from gridlake.operators.components import connected_components
from gridlake.operators.ties import both_directions

ATTRIBUTES = ("SUB", "SUB_NOME", "CONJ_CODIGO", "CONJ_NOME")


def tie_edges(ties: DataFrame, feeders: DataFrame | None = None) -> DataFrame:
    """One row per unordered feeder pair: distinct switches, remote ones, lists, both ends."""
    remote = F.coalesce(F.col("TLCD") == 1, F.lit(False))
    per_switch = ties.select(
        F.least("CTMT", "CTMT_VIZ").alias("CTMT_A"), F.greatest("CTMT", "CTMT_VIZ").alias("CTMT_B"),
        F.col("COD_ID").cast("string").alias("COD_ID"), remote.alias("remote"),
    ).groupBy("CTMT_A", "CTMT_B", "COD_ID").agg(F.max("remote").alias("remote"))
    edges = per_switch.groupBy("CTMT_A", "CTMT_B").agg(
        F.count(F.lit(1)).alias("n_ties_campo"),
        F.count_if("remote").alias("n_ties_telecomandadas"),
        F.array_join(F.array_sort(F.collect_list("COD_ID")), ";").alias("chaves"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("remote"), F.col("COD_ID")))), ";").alias("chaves_telecomandadas"),
    )
    if feeders is None:
        return edges
    for side in ("A", "B"):
        names = [
            F.trim(F.coalesce(F.col(c), F.lit(""))).alias(f"{c.replace('CONJ_CODIGO', 'CONJ')}_{side}")
            for c in ATTRIBUTES
        ]
        edges = edges.join(
            feeders.select(F.col("COD_ID").alias(f"CTMT_{side}"), *names), f"CTMT_{side}", "left"
        )
    return edges


def degree_table(feeders: DataFrame, edges: DataFrame) -> DataFrame:
    """Every feeder with its number of neighbouring feeders."""
    ends = edges.select(F.explode(F.array("CTMT_A", "CTMT_B")).alias("COD_ID"))
    degree = ends.groupBy("COD_ID").agg(F.count(F.lit(1)).alias("grau"))
    return feeders.join(degree, "COD_ID", "left").withColumn("grau", F.coalesce("grau", F.lit(0)))


def degree_distribution(degrees: DataFrame, customers: str = "n_clientes") -> DataFrame:
    """Feeders and customers per degree with their shares."""
    grouped = degrees.groupBy("grau").agg(
        F.count(F.lit(1)).alias("alimentadores"), F.coalesce(F.sum(customers), F.lit(0)).alias("clientes")
    )
    totals = grouped.agg(F.sum("alimentadores").alias("_a"), F.sum("clientes").alias("_c"))
    one = F.lit(1).alias("_one")
    return grouped.select(one, "*").join(F.broadcast(totals.select(one, "*")), "_one").select(
        "grau", "alimentadores", percent(F.col("alimentadores"), F.col("_a")).alias("pct_alimentadores"),
        "clientes", percent(F.col("clientes"), F.col("_c")).alias("pct_clientes"),
    )


def feeder_components(feeders: DataFrame, edges: DataFrame) -> DataFrame:
    """COD_ID, component label (smallest feeder of the component); isolated feeders included."""
    labels = connected_components(
        edges.select(F.col("CTMT_A").alias("src"), F.col("CTMT_B").alias("dst")),
        feeders.select(F.col("COD_ID").alias("node")),
    )
    return labels.select(F.col("node").alias("COD_ID"), F.col("component"))


def component_table(members: DataFrame, feeders: DataFrame, edges: DataFrame, sample: int = 10) -> DataFrame:
    """Components ranked by size, then by first feeder: feeders, customers, edges, ties, stations."""
    from gridlake.functions.ordered import global_rank
    from gridlake.operators.quality import worst_per_group

    rows = members.join(feeders.select("COD_ID", "SUB", "n_clientes"), "COD_ID")
    sizes = rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_alimentadores"), F.sum("n_clientes").alias("n_clientes"),
        F.count_distinct(F.nullif(F.trim("SUB"), F.lit(""))).alias("n_subestacoes"),
    )
    inner = edges.join(members.withColumnRenamed("COD_ID", "CTMT_A"), "CTMT_A").groupBy("component").agg(
        F.count(F.lit(1)).alias("n_arestas"), F.sum("n_ties_campo").alias("n_ties_campo")
    )
    first = worst_per_group(rows, ["component"], [F.col("COD_ID")], sample).groupBy("component").agg(
        F.array_join(F.array_sort(F.collect_list("COD_ID")), ";").alias("amostra_ctmts")
    )
    table = sizes.join(inner, "component", "left").join(first, "component", "left")
    ranked = global_rank(
        table.withColumn("_neg", -F.col("n_alimentadores")), ["_neg", "component"], "componente_id"
    )
    return ranked.select(
        "componente_id", "component", "n_alimentadores", "n_clientes",
        F.coalesce("n_arestas", F.lit(0)).alias("n_arestas"),
        F.coalesce("n_ties_campo", F.lit(0)).alias("n_ties_campo"),
        "n_subestacoes", "amostra_ctmts",
    )


def atlas_by_feeder(
    feeders: DataFrame, ties: DataFrame, edges: DataFrame, members: DataFrame, components: DataFrame
) -> DataFrame:
    """Per feeder: degree, no-rescue flag, helpers, switches, component.

    ``feeders``: COD_ID, SUB, SUB_NOME, CONJ_CODIGO, CONJ_NOME, n_clientes, NA_interligacao_campo,
    NA_interligacao_campo_telecomandada.
    """
    pairs = both_directions(ties, ("COD_ID", "TLCD"))
    helpers = (
        pairs.select("CTMT", "CTMT_VIZ").distinct()
        .join(feeders.select(F.col("COD_ID").alias("CTMT_VIZ"), *ATTRIBUTES), "CTMT_VIZ", "left")
        .groupBy("CTMT")
        .agg(
            sorted_text_list(F.col("CTMT_VIZ")).alias("alimentadores_socorro"),
            sorted_text_list(F.col("SUB")).alias("subestacoes_socorro"),
            sorted_text_list(F.col("SUB_NOME")).alias("subestacoes_socorro_nomes"),
            sorted_text_list(F.col("CONJ_CODIGO")).alias("conjuntos_socorro"),
            sorted_text_list(F.col("CONJ_NOME")).alias("conjuntos_socorro_nomes"),
        )
    )
    remote = F.when(F.coalesce(F.col("TLCD") == 1, F.lit(False)), F.col("COD_ID"))
    switches = pairs.groupBy("CTMT").agg(
        F.count(F.lit(1)).alias("pares_ctmt_vizinho"),
        sorted_text_list(F.col("COD_ID")).alias("chaves_campo"),
        sorted_text_list(remote).alias("chaves_telecomandadas"),
    )
    place = members.join(
        components.select("component", "componente_id", F.col("n_alimentadores").alias("tamanho_componente")), "component"
    ).drop("component")
    table = degree_table(feeders, edges).join(place, "COD_ID", "left")
    for part in (helpers, switches):
        table = table.join(part.withColumnRenamed("CTMT", "COD_ID"), "COD_ID", "left")
    texts = [c for c in (*helpers.columns[1:], "chaves_campo", "chaves_telecomandadas")]
    return table.withColumns(
        {
            "ties_campo": F.col("NA_interligacao_campo"),
            "ties_telecomandadas": F.col("NA_interligacao_campo_telecomandada"),
            "ties_manuais": F.col("NA_interligacao_campo") - F.col("NA_interligacao_campo_telecomandada"),
            "sem_socorro": F.col("grau") == 0,
            "pares_ctmt_vizinho": F.coalesce("pares_ctmt_vizinho", F.lit(0)),
            **{c: F.coalesce(c, F.lit("")) for c in texts},
        }
    )


def atlas_headline(ties: DataFrame, edges: DataFrame, by_feeder: DataFrame, components: DataFrame) -> DataFrame:
    """The twelve headline numbers in one row."""
    one = F.lit(1).alias("_one")
    t = ties.agg(
        F.count_distinct("COD_ID").alias("n_ties_campo"),
        F.count_distinct(F.when(F.col("TLCD") == 1, F.col("COD_ID"))).alias("n_ties_telecomandadas"),
        F.count(F.lit(1)).alias("n_pares_ctmt"),
    )
    e = edges.agg(F.count(F.lit(1)).alias("n_arestas"))
    f = by_feeder.agg(
        F.count(F.lit(1)).alias("n_alimentadores"), F.count_if(F.col("grau") == 0).alias("n_grau_zero"),
        F.coalesce(F.sum("n_clientes"), F.lit(0)).alias("n_clientes_total"),
        F.coalesce(F.sum(F.when(F.col("grau") == 0, F.col("n_clientes"))), F.lit(0)).alias("n_clientes_sem_socorro"),
        F.coalesce(F.max("grau"), F.lit(0)).alias("grau_maximo"),
    )
    c = components.agg(
        F.count(F.lit(1)).alias("n_componentes"), F.coalesce(F.max("n_alimentadores"), F.lit(0)).alias("maior_componente")
    )
    row = t.select(one, "*")
    for part in (e, f, c):
        row = row.join(F.broadcast(part.select(one, "*")), "_one")
    return row.drop("_one").withColumn(
        "pct_clientes_sem_socorro", percent(F.col("n_clientes_sem_socorro"), F.col("n_clientes_total"))
    )
