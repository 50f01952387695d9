"""Data-quality profile of the asset layers.

Every check reads the layers it needs as one tagged union, aggregates it once and keeps its worst
examples with a bounded top-n. The summary puts all checks in one table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.columns import is_single_phase, number, percent, text_or_null
from gridlake.functions.geo import with_shape
from gridlake.functions.ordered import exact_percentile
from gridlake.operators.inventory import effective_key, transformer_map
from gridlake.operators.spatial import measured_references
from gridlake.sources.catalog import LayerCatalog

# Layers each check looks at.
PHASE_LAYERS = (
    "SSDMT", "SSDBT", "RAMLIG", "UNSEMT", "UNSEBT", "UCBT_tab", "UCMT_tab", "UGBT_tab", "UGMT_tab",
)
CONDUCTOR_LAYERS = ("SSDMT", "SSDBT", "RAMLIG")
FEEDER_REF_LAYERS = (
    "SSDMT", "SSDBT", "UNTRMT", "UNSEMT", "UNSEBT", "UNREMT", "UNCRMT", "RAMLIG", "UCBT_tab",
    "UCMT_tab", "UGBT_tab", "UGMT_tab", "PIP",
)
REMOTE_LAYERS = ("UNSEMT", "UNSEBT")
NODE_ORIGINS = (
    ("CTMT", "PAC_INI"), ("SSDMT", "PAC_1"), ("SSDMT", "PAC_2"), ("UNSEMT", "PAC_1"),
    ("UNSEMT", "PAC_2"), ("UNTRMT", "PAC_1"), ("UNTRMT", "PAC_2"), ("UNTRMT", "PAC_3"),
    ("UCMT_tab", "PAC"), ("UGMT_tab", "PAC"),
)
SUMMARY_COLUMNS = ["check", "count", "universe", "percent", "examples"]


def tagged_union(catalog: LayerCatalog, layers: Sequence[str], needed: Sequence[str], columns: Sequence[str]) -> DataFrame | None:
    """Union of the layers that exist and have the ``needed`` columns, with a ``layer`` column."""
    parts = []
    for layer in layers:
        if not catalog.has(layer) or not set(needed) <= set(catalog.columns(layer)):
            continue
        parts.append(
            catalog.table(layer, columns).select(
                F.lit(layer).alias("layer"), *[F.col(c).cast("string").alias(c) for c in columns]
            )
        )
    return reduce(DataFrame.unionByName, parts) if parts else None


def _clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: text_or_null(F.col(c)) for c in columns})


def worst_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group. The rank limit is applied before the shuffle as well, so a
    hot group sends at most ``n`` rows per map task (T3)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


# --- phase profile (A16) -------------------------------------------------------------------------


def phase_profile(rows: DataFrame, *, layer: str = "layer", phase: str = "FAS_CON", top: int = 5) -> DataFrame:
    """Per layer: rows, informed, single-phase, percentage, commonest values."""
    clean = rows.withColumn("_phase", text_or_null(F.col(phase)))
    counted = clean.groupBy(layer, "_phase").agg(F.count(F.lit(1)).alias("_n"))
    mono = is_single_phase(F.col("_phase"))
    totals = counted.groupBy(layer).agg(
        F.sum("_n").alias("registros"),
        F.coalesce(F.sum(F.when(F.col("_phase").isNotNull(), F.col("_n"))), F.lit(0)).alias("informados"),
        F.coalesce(F.sum(F.when(mono, F.col("_n"))), F.lit(0)).alias("monofasicos"),
    )
    best = worst_per_group(
        counted.where(F.col("_phase").isNotNull()), [layer], [F.col("_n").desc(), F.col("_phase")], top
    )
    text = F.concat(F.col("_phase"), F.lit("="), F.col("_n").cast("string"))
    lists = best.groupBy(layer).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda s: s["t"]), ", "
        ).alias("top_valores")
    )
    return totals.join(lists, layer, "left").select(
        *totals.columns, percent(F.col("monofasicos"), F.col("informados")).alias("pct_monofasico"),
        F.coalesce("top_valores", F.lit("—")).alias("top_valores"),
    )


def phase_by_feeder(
    rows: DataFrame, *, layer: str = "layer", feeder: str = "ctmt", phase: str = "FAS_CON",
    min_rows: int = 20, n: int = 5,
) -> DataFrame:
    """Feeders with the largest single-phase share among those with enough rows."""
    clean = rows.withColumn("_phase", text_or_null(F.col(phase))).where(
        F.col("_phase").isNotNull() & F.col(feeder).isNotNull()
    )
    counted = clean.groupBy(layer, feeder).agg(
        F.count(F.lit(1)).alias("registros"),
        F.count_if(is_single_phase(F.col("_phase"))).alias("monofasicos"),
    ).where(F.col("registros") >= min_rows)
    share = counted.withColumn("pct_monofasico", percent(F.col("monofasicos"), F.col("registros")))
    order = [F.col("pct_monofasico").desc(), F.col("monofasicos").desc()]
    top = worst_per_group(share, [layer], [*order, F.col(feeder)], 2 * n).drop("rank")
    return top.orderBy(*order, layer, feeder).limit(n)


# --- long drops (A17) ----------------------------------------------------------------------------


def long_tail(rows: DataFrame, value: str = "COMP", limit: float = 300.0, out: str = "p99") -> DataFrame:
    """One row: how many values exceed ``limit``, how many are readable, exact 99th percentile."""
    v = rows.select(number(F.col(value)).alias("_v"))
    counts = v.agg(F.count_if(F.col("_v") > limit).alias("count"), F.count("_v").alias("universe"))
    p99 = exact_percentile(v, [], "_v", 0.99, out)
    one = F.lit(1).alias("_one")
    joined = counts.select(one, "*").join(F.broadcast(p99.select(one, "*")), "_one", "left")
    return joined.select(
        "count", "universe", percent(F.col("count"), F.col("universe")).alias("percent"), out
    )


def longest(rows: DataFrame, value: str = "COMP", limit: float = 300.0, n: int = 5, key: str = "COD_ID") -> DataFrame:
    v = rows.withColumn("_v", number(F.col(value))).where(F.col("_v") > limit)
    return v.orderBy(F.col("_v").desc(), key).limit(n).drop("_v")


# --- distance (J12) ------------------------------------------------------------------------------


def far_references(
    references: DataFrame, targets: DataFrame, anchors: DataFrame, limit_m: float = 2000.0
) -> DataFrame:
    """Customer rows (COD_ID, CTMT, PN_CON, UNI_TR_MT) measured against both positions; ``far`` flags."""
    refs = _clean(references, ["PN_CON", "UNI_TR_MT"])
    measured = measured_references(refs, targets, anchors)
    return measured.withColumn("far", F.coalesce(F.col("dist_m") > limit_m, F.lit(False)))


# --- dangling references (J11) -------------------------------------------------------------------


def dangling_codes(rows: DataFrame, catalog_codes: DataFrame, *, layer: str = "layer", code: str = "TIP_CND") -> DataFrame:
    """Per layer: rows, blank codes, codes missing in the catalogue, problems and percentage."""
    known = catalog_codes.select(text_or_null(F.col(catalog_codes.columns[0])).alias("_code")).where(
        F.col("_code").isNotNull()
    ).distinct().withColumn("_known", F.lit(True))
    counted = rows.select(layer, text_or_null(F.col(code)).alias("_code")).groupBy(layer, "_code").agg(
        F.count(F.lit(1)).alias("_n")
    )
    joined = counted.join(known, "_code", "left")
    blank = F.when(F.col("_code").isNull(), F.col("_n")).otherwise(0)
    unknown = F.when(F.col("_code").isNotNull() & F.col("_known").isNull(), F.col("_n")).otherwise(0)
    return joined.groupBy(layer).agg(
        F.sum("_n").alias("registros"), F.sum(blank + unknown).alias("problemas"),
        F.sum(blank).alias("vazios"), F.sum(unknown).alias("sem_catalogo"),
    ).withColumn("percentual", percent(F.col("problemas"), F.col("registros")))


def dangling_examples(rows: DataFrame, catalog_codes: DataFrame, *, layer: str = "layer", code: str = "TIP_CND", key: str = "COD_ID", n: int = 5) -> DataFrame:
    known = catalog_codes.select(text_or_null(F.col(catalog_codes.columns[0])).alias("_code")).distinct()
    bad = rows.withColumn("_code", text_or_null(F.col(code))).join(known, "_code", "left_anti")
    return bad.orderBy(layer, F.coalesce("_code", F.lit("")), key).limit(n)


def unknown_references(rows: DataFrame, feeders: DataFrame, *, layer: str = "layer", ref: str = "CTMT") -> DataFrame:
    """Per layer: non-blank feeder references and how many name a feeder that does not exist."""
    counted = rows.select(layer, text_or_null(F.col(ref)).alias("_ref")).where(
        F.col("_ref").isNotNull()
    ).groupBy(layer, "_ref").agg(F.count(F.lit(1)).alias("_n"))
    known = feeders.select(text_or_null(F.col(feeders.columns[0])).alias("_ref")).distinct().withColumn("_known", F.lit(True))
    return counted.join(known, "_ref", "left").groupBy(layer).agg(
        F.sum("_n").alias("referencias"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("ausentes"),
    ).withColumn("percentual", percent(F.col("ausentes"), F.col("referencias")))


def unreferenced(rows: DataFrame, feeders: DataFrame, *, ref: str = "CTMT") -> DataFrame:
    """Registered feeders no row refers to (U4)."""
    name = feeders.columns[0]
    known = feeders.select(text_or_null(F.col(name)).alias(name)).where(F.col(name).isNotNull()).distinct()
    used = rows.select(text_or_null(F.col(ref)).alias(name)).distinct()
    return known.join(used, name, "left_anti")


# --- shared nodes (A18) --------------------------------------------------------------------------


def node_references(catalog: LayerCatalog) -> DataFrame:
    """(pac, ctmt, layer, cod_id) over the ten origins of MV nodes; one scan per layer."""
    per_layer: dict[str, list[str]] = {}
    for layer, column in NODE_ORIGINS:
        if catalog.has(layer) and column in catalog.columns(layer):
            per_layer.setdefault(layer, []).append(column)
    parts = []
    for layer, columns in per_layer.items():
        feeder = "COD_ID" if layer == "CTMT" else "CTMT"
        if not {"COD_ID", feeder} <= set(catalog.columns(layer)):
            continue
        df = catalog.read(layer, ["COD_ID", feeder, *columns])
        parts.append(
            df.select(
                F.explode(F.array(*[text_or_null(F.col(c)) for c in columns])).alias("pac"),
                text_or_null(F.col(feeder)).alias("ctmt"), F.lit(layer).alias("layer"),
                text_or_null(F.col("COD_ID")).alias("cod_id"),
            )
        )
    return reduce(DataFrame.unionByName, parts).where(F.col("pac").isNotNull() & F.col("ctmt").isNotNull())


def shared_nodes(references: DataFrame, node: str = "pac", owner: str = "ctmt") -> DataFrame:
    """Nodes used by more than one feeder: node, number of feeders, feeder list.

    Rows are first reduced to distinct (node, feeder) pairs.
    """
    pairs = references.select(node, owner).distinct()
    return pairs.groupBy(node).agg(
        F.count(F.lit(1)).alias("n_ctmt"),
        F.array_join(F.array_sort(F.collect_list(F.col(owner).cast("string"))), ", ").alias("ctmts"),
    ).where(F.col("n_ctmt") > 1)


# --- geometry (A19) ------------------------------------------------------------------------------


def geometry_checks(shaped: DataFrame, area: tuple[float, float, float, float] | DataFrame | None, *, layer: str = "layer") -> DataFrame:
    """Per layer: rows, geometry problems (null, empty, too few points, unclosed ring), measurable
    rows and rows outside the service area's extent. ``shaped`` has the columns of ``shape``;
    ``area`` is one extent as four numbers or a one-row frame minx, miny, maxx, maxy."""
    if isinstance(area, DataFrame):
        row = area.first()  # one row: the service-area extent
        area = None if row is None or row[0] is None else tuple(row)
    problem = F.col("is_null") | F.col("is_empty") | F.col("is_broken")
    measurable = F.col("minx").isNotNull()
    outside = F.lit(False)
    if area is not None:
        outside = measurable & (
            (F.col("minx") < area[0]) | (F.col("miny") < area[1])
            | (F.col("maxx") > area[2]) | (F.col("maxy") > area[3])
        )
    return shaped.groupBy(layer).agg(
        F.count(F.lit(1)).alias("registros"),
        F.count_if(problem).alias("problemas"),
        F.count_if(measurable).alias("mensuraveis"),
        F.count_if(outside).alias("fora"),
    )


# --- remote flag (A20) ---------------------------------------------------------------------------


def flag_domain(rows: DataFrame, *, layer: str = "layer", flag: str = "TLCD", allowed: Sequence[float] = (0, 1)) -> DataFrame:
    """Per layer: rows whose flag is blank or a number outside the domain."""
    text = text_or_null(F.col(flag))
    value = number(F.col(flag))
    blank = text.isNull()
    odd = F.coalesce(value.isNotNull() & ~value.isin([float(a) for a in allowed]), F.lit(False))
    return rows.groupBy(layer).agg(
        F.count(F.lit(1)).alias("registros"), F.count_if(blank | odd).alias("problemas"),
        F.count_if(blank).alias("nulos"), F.count_if(odd).alias("indefinidos"),
    ).withColumn("percentual", percent(F.col("problemas"), F.col("registros")))


# --- single-phase transformers (A26) -------------------------------------------------------------


def one_phase_transformers(customers: DataFrame, *, key: str = "UNI_TR_MT", phase: str = "FAS_CON", min_rows: int = 20, share: float = 0.9) -> DataFrame:
    """Transformers with enough single-phase customers, nearly all on one phase."""
    mono = customers.where(is_single_phase(F.col(phase))).select(
        F.trim(F.col(key).cast("string")).alias(key), F.substring(F.trim(F.col(phase)), 1, 1).alias("fase")
    )
    counted = mono.groupBy(key, "fase").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(key).agg(
        F.sum("n").alias("total"), F.max("n").alias("n"),
        F.min_by("fase", F.struct((-F.col("n")).alias("a"), F.col("fase").alias("b"))).alias("fase"),
    )
    return best.where((F.col("total") >= min_rows) & (F.col("n") / F.col("total") >= share)).select(
        key, "fase", "n", "total"
    )


# --- summary (A21) -------------------------------------------------------------------------------


def summary_row(check: str, totals: DataFrame, count: str, universe: str, examples: DataFrame | None = None, example: str = "COD_ID", n: int = 5) -> DataFrame:
    """One summary row from per-layer totals (summed) and a bounded example list."""
    one = F.lit(1).alias("_one")
    row = totals.agg(
        F.coalesce(F.sum(count), F.lit(0)).cast("long").alias("count"),
        F.coalesce(F.sum(universe), F.lit(0)).cast("long").alias("universe"),
    ).select(one, F.lit(check).alias("check"), "count", "universe", percent(F.col("count"), F.col("universe")).alias("percent"))
    if examples is None:
        return row.select("check", "count", "universe", "percent", F.lit("").alias("examples"))
    listed = examples.limit(n).agg(
        F.array_join(F.array_sort(F.collect_list(F.trim(F.col(example).cast("string")))), ";").alias("examples")
    )
    return row.join(F.broadcast(listed.select(one, "*")), "_one").select(*SUMMARY_COLUMNS)


def quality_summary(catalog: LayerCatalog, *, drop_limit_m: float = 300.0, pole_limit_m: float = 2000.0, n: int = 5) -> DataFrame:
    """The nine checks in one table (A21). A check whose layers are missing reports zero rows."""
    spark = catalog.spark
    rows: list[DataFrame] = []

    def absent(name: str) -> None:
        rows.append(spark.createDataFrame([(name, 0, 0, 0.0, "")], "check string, count long, universe long, percent double, examples string"))

    mapping = None
    if catalog.has("UNTRMT"):
        mapping = transformer_map(_clean(catalog.table("UNTRMT", ["COD_ID", "CTMT"]), ["COD_ID", "CTMT"]))

    phases = tagged_union(catalog, PHASE_LAYERS, ["FAS_CON"], ["COD_ID", "FAS_CON", "CTMT", "UNI_TR_MT"])
    if phases is None:
        absent("fas_con")
    else:
        keyed = effective_key(_clean(phases, ["CTMT", "UNI_TR_MT"]), mapping, out="ctmt")
        rows.append(summary_row("fas_con", phase_profile(phases), "monofasicos", "informados", phase_by_feeder(keyed, n=n), "ctmt", n))
    if catalog.has("RAMLIG"):
        drops = catalog.table("RAMLIG", ["COD_ID", "CTMT", "COMP"])
        rows.append(summary_row("ramlig", long_tail(drops, limit=drop_limit_m), "count", "universe", longest(drops, limit=drop_limit_m, n=n), "COD_ID", n))
    else:
        absent("ramlig")
    placed = all(catalog.has(x) and "geometry" in catalog.columns(x) for x in ("PONNOT", "UNTRMT"))
    if placed and catalog.has("UCBT_tab"):
        def located(layer: str) -> DataFrame:
            return with_shape(catalog.read(layer, ["COD_ID"])).select(
                text_or_null(F.col("COD_ID")).alias("COD_ID"), F.col("shape.minx").alias("x"), F.col("shape.miny").alias("y")
            ).where(F.col("x").isNotNull())

        measured = far_references(
            catalog.table("UCBT_tab", ["COD_ID", "PN_CON", "UNI_TR_MT", "CTMT"]), located("PONNOT"), located("UNTRMT"), pole_limit_m
        )
        totals = measured.agg(F.count_if("far").alias("c"), F.count("dist_m").alias("u"))
        worst = measured.where("far").orderBy(F.col("dist_m").desc(), "COD_ID", "CTMT").limit(n)
        rows.append(summary_row("pn_con", totals, "c", "u", worst, "COD_ID", n))
    else:
        absent("pn_con")
    conductors = tagged_union(catalog, CONDUCTOR_LAYERS, ["TIP_CND"], ["COD_ID", "TIP_CND"])
    if catalog.has("SEGCON") and conductors is not None:
        codes = catalog.table("SEGCON", ["COD_ID"])
        rows.append(summary_row("tip_cnd", dangling_codes(conductors, codes), "problemas", "registros", dangling_examples(conductors, codes, n=n), "COD_ID", n))
    else:
        absent("tip_cnd")
    refs = tagged_union(catalog, FEEDER_REF_LAYERS, ["CTMT"], ["COD_ID", "CTMT"])
    if catalog.has("CTMT") and refs is not None:
        feeders = catalog.table("CTMT", ["COD_ID"])
        bad = refs.where(text_or_null(F.col("CTMT")).isNotNull())
        rows.append(summary_row("ctmt", unknown_references(refs, feeders), "ausentes", "referencias", dangling_examples(bad, feeders, code="CTMT", n=n), "COD_ID", n))
        never = unreferenced(refs, feeders)
        known = feeders.agg(F.count_distinct(text_or_null(F.col("COD_ID"))).alias("u"))
        missing = never.agg(F.count(F.lit(1)).alias("c"))
        totals = known.select(F.lit(0).alias("c"), "u").unionByName(missing.select("c", F.lit(0).alias("u")))
        rows.append(summary_row("ctmt_sem_referencia", totals, "c", "u", never.orderBy("COD_ID"), "COD_ID", n))
    else:
        absent("ctmt")
        absent("ctmt_sem_referencia")
    nodes = node_references(catalog)
    clashes = shared_nodes(nodes)
    totals = nodes.agg(F.count_distinct("pac").alias("u")).select(F.lit(0).alias("c"), "u").unionByName(
        clashes.agg(F.count(F.lit(1)).alias("c")).select("c", F.lit(0).alias("u"))
    )
    rows.append(summary_row("pac", totals, "c", "u", clashes.orderBy(F.col("n_ctmt").desc(), "pac"), "pac", n))
    geo_layers = [x for x in sorted({**catalog.layers(), **catalog.frames}) if "geometry" in catalog.columns(x)]
    if geo_layers:
        shaped = reduce(
            DataFrame.unionByName,
            [with_shape(catalog.table(x, ["COD_ID", "geometry"])).select(F.lit(x).alias("layer"), F.col("COD_ID").cast("string").alias("COD_ID"), "shape.*") for x in geo_layers],
        )
        area = None
        if catalog.has("ARAT"):
            area = with_shape(catalog.read("ARAT", ["geometry"])).agg(
                F.min("shape.minx"), F.min("shape.miny"), F.max("shape.maxx"), F.max("shape.maxy")
            )
        checks = geometry_checks(shaped, area)
        broken = shaped.where(F.col("is_null") | F.col("is_empty") | F.col("is_broken")).orderBy("layer", "COD_ID")
        rows.append(summary_row("geometria", checks, "problemas", "registros", broken, "COD_ID", n))
        rows.append(summary_row("bbox", checks, "fora", "mensuraveis"))
    else:
        absent("geometria")
        absent("bbox")
    flags = tagged_union(catalog, REMOTE_LAYERS, ["TLCD"], ["COD_ID", "TLCD"])
    if flags is not None:
        rows.append(summary_row("tlcd", flag_domain(flags), "problemas", "registros"))
    else:
        absent("tlcd")
    return reduce(DataFrame.unionByName, [r.select(*SUMMARY_COLUMNS) for r in rows])
