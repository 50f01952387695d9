"""Impact of restoration options and operational checks on switching plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.columns import (
    code_text,
    dec_hours,
    feeder_key,
    feeder_match,
    minutes_avoided,
    round_to,
    segment_of_element,
    text_or_empty,
)
from gridlake.functions.keyed import unique_mode_per_key
from gridlake.functions.ordered import rank_in_group

# Minutes of a repair and of a switching when a case names none.
REPAIR_MIN = 180.0
SWITCHING_MIN = 5.0


# --- impact (N21) --------------------------------------------------------------------------------


def node_regions(transformers: DataFrame, lv: DataFrame | None, mv: DataFrame | None) -> DataFrame:
    """node, region, n: customers per network node and reliability region."""
    parts = []
    if lv is not None and {"UNI_TR_MT", "CONJ"} <= set(lv.columns):
        place = transformers.select(F.col("COD_ID").alias("UNI_TR_MT"), F.col("PAC_1").alias("node"))
        # counted before the join: one row per (transformer, region)
        counted = lv.groupBy("UNI_TR_MT", code_text(F.col("CONJ")).alias("region")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(counted.join(place, "UNI_TR_MT").select("node", "region", "n"))
    if mv is not None and {"PAC", "CONJ"} <= set(mv.columns):
        parts.append(
            mv.groupBy(F.col("PAC").alias("node"), code_text(F.col("CONJ")).alias("region")).agg(F.count(F.lit(1)).alias("n"))
        )
    union = reduce(DataFrame.unionByName, parts)
    return union.where(F.col("region") != "").groupBy("node", "region").agg(F.sum("n").alias("n"))


def node_asset_regions(segments: DataFrame, switches: DataFrame, transformers: DataFrame) -> DataFrame:
    """node, asset, region: assets touching each node (an asset counts once per node set)."""

    def touching(df: DataFrame, layer: str, columns: Sequence[str]) -> DataFrame:
        return df.select(
            F.explode(F.array(*[F.col(c) for c in columns])).alias("node"),
            F.concat(F.lit(f"{layer}:"), F.col("COD_ID").cast("string")).alias("asset"),
            code_text(F.col("CONJ")).alias("region"),
        )

    parts = [
        touching(df, layer, columns)
        for df, layer, columns in (
            (segments, "SSDMT", ("PAC_1", "PAC_2")), (switches, "UNSEMT", ("PAC_1", "PAC_2")), (transformers, "UNTRMT", ("PAC_1",)),
        )
        if "CONJ" in df.columns
    ]
    return reduce(DataFrame.unionByName, parts).where(F.col("region") != "")


def region_totals(lv: DataFrame | None, mv: DataFrame | None) -> DataFrame:
    """region, total_uc over all customers."""
    parts = [
        df.groupBy(code_text(F.col("CONJ")).alias("region")).agg(F.count(F.lit(1)).alias("n"))
        for df in (lv, mv)
        if df is not None and "CONJ" in df.columns
    ]
    return reduce(DataFrame.unionByName, parts).where(F.col("region") != "").groupBy("region").agg(F.sum("n").alias("total_uc"))


def feeder_region(feeders: DataFrame, layers: Sequence[DataFrame]) -> DataFrame:
    """ctmt, region: the feeder's own code, else the unique mode of the first layer that has one."""
    own = feeders.select(F.col("COD_ID").cast("string").alias("ctmt"), code_text(F.col("CONJ")).alias("r")).where(F.col("r") != "") \
        .groupBy("ctmt").agg(F.when(F.count(F.lit(1)) == 1, F.min("r")).alias("_r0")) if "CONJ" in feeders.columns else None
    table = feeders.select(F.col("COD_ID").cast("string").alias("ctmt")).distinct()
    picks: list[Column] = []
    if own is not None:
        table = table.join(own, "ctmt", "left")
        picks.append(F.col("_r0"))
    for i, layer in enumerate(layers, start=1):
        if not {"CTMT", "CONJ"} <= set(layer.columns):
            continue
        mode = unique_mode_per_key(
            layer.select(F.col("CTMT").cast("string").alias("ctmt"), F.nullif(code_text(F.col("CONJ")), F.lit("")).alias("v")), ["ctmt"], "v", f"_r{i}"
        )
        table = table.join(mode, "ctmt", "left")
        picks.append(F.col(f"_r{i}"))
    return table.select("ctmt", F.coalesce(*picks).alias("region"))


def option_impact(
    options: DataFrame,
    option_nodes: DataFrame,
    lost_customers: DataFrame,
    *,
    regions: DataFrame | None = None,
    asset_regions: DataFrame | None = None,
    node_feeders: DataFrame | None = None,
    feeder_regions: DataFrame | None = None,
    totals: DataFrame | None = None,
    names: DataFrame | None = None,
    repair_min: float = REPAIR_MIN,
    switching_min: float = SWITCHING_MIN,
) -> DataFrame:
    """Customer-minutes and average interruption avoided per option.

    ``options``: zone, chave, clientes; ``option_nodes``: zone, chave, node (recovered nodes);
    ``lost_customers``: zone, desligados. The region is the unique mode of the recovered customers,
    else of the touched assets, else of the nodes' feeder; without a region the minutes remain.
    """
    if repair_min < 0 or switching_min < 0:
        raise ValueError("times must not be negative")
    keys = ["zone", "chave"]
    saved = max(float(repair_min) - float(switching_min), 0.0)
    base = options.select(*keys, "clientes").join(lost_customers, "zone", "left").select(
        *keys, F.lit(float(repair_min)).alias("tempo_reparo_min"), F.lit(float(switching_min)).alias("tempo_manobra_min"),
        F.col("clientes").alias("clientes_restaurados"),
        F.greatest(F.coalesce("desligados", F.lit(0)) - F.col("clientes"), F.lit(0)).alias("clientes_sem_tensao"),
        minutes_avoided(F.col("clientes"), F.lit(float(repair_min)), F.lit(float(switching_min))).alias("consumidor_minutos"),
    )
    if regions is None or totals is None:
        return base
    # an option of one node has that node's mode and counts; only options of several are added up region by region
    counted = regions.groupBy("node", "region").agg(F.sum("n").alias("n"))
    nodes = option_nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.min("node").alias("_one"))
    several = option_nodes.join(nodes.where("_k > 1").select(*keys), keys)
    served = several.join(counted, "node").groupBy(*keys, "region").agg(F.sum("n").alias("n"))
    alone = nodes.where("_k = 1").select(*keys, F.col("_one").alias("node"))
    modes = unique_mode_per_key(counted, ["node"], "region", "_r1", F.col("n"))
    picked = [unique_mode_per_key(served, keys, "region", "_r1", F.col("n")).unionByName(alone.join(modes, "node").select(*keys, "_r1"))]
    if asset_regions is not None:
        assets = option_nodes.join(asset_regions, "node").select(*keys, "asset", "region").distinct()
        picked.append(unique_mode_per_key(assets, keys, "region", "_r2"))
    if node_feeders is not None and feeder_regions is not None:
        feeder = unique_mode_per_key(option_nodes.join(node_feeders, "node"), keys, "ctmt", "ctmt")
        picked.append(
            feeder.join(feeder_regions, "ctmt").select(*keys, F.col("region").alias("_r3"))
        )
    table = base
    for p in picked:
        table = table.join(p, keys, "left")
    chosen = F.coalesce(*[F.col(c) for c in ("_r1", "_r2", "_r3") if c in table.columns])
    table = table.withColumn("region", chosen).drop("_r1", "_r2", "_r3")
    table = table.join(totals, "region", "left").join(alone, keys, "left").join(
        counted.withColumnRenamed("n", "_n1"), ["node", "region"], "left"
    ).join(served, [*keys, "region"], "left").withColumn("n", F.coalesce("n", "_n1"))
    if names is not None:
        table = table.join(names.select("region", "region_name"), "region", "left")
    else:
        table = table.withColumn("region_name", F.col("region"))
    known = F.coalesce(F.col("total_uc") > 0, F.lit(False))
    minutes = F.coalesce("n", F.lit(0)).cast("double") * F.lit(saved)
    hours = F.when(known, dec_hours(minutes, F.col("total_uc")))
    return table.select(
        *base.columns, F.when(known, F.col("region")).alias("region"),
        F.when(known, F.coalesce("region_name", "region")).alias("region_name"),
        F.when(known, F.col("total_uc")).alias("total_uc"),
        F.when(known, F.coalesce("n", F.lit(0))).alias("ucs_restauradas"),
        hours.alias("dec_horas"), (hours * 60.0).alias("dec_minutos"),
    )


# --- restrictions (L7, J18) ----------------------------------------------------------------------


@dataclass(frozen=True)
class Restriction:
    """One operator rule: forbidden switches, feeders to avoid, remote-controlled switches only."""

    reason: str
    forbidden: Sequence[str] = field(default_factory=tuple)
    avoid: Sequence[str] = field(default_factory=tuple)
    remote_only: bool = False


def combined_rules(rules: Sequence[Restriction]) -> dict:
    """Union of the active rules."""
    return {
        "forbidden": sorted({c for r in rules for c in r.forbidden}),
        "avoid": sorted({c for r in rules for c in r.avoid}),
        "remote_only": any(r.remote_only for r in rules),
        "reasons": [r.reason for r in rules],
    }


def rule_blocks(options: DataFrame, rules: Sequence[Restriction]) -> DataFrame:
    """Adds ``bloqueio``: why an option breaks the rules, ``; ``-joined, null when free.

    ``options``: chave, fonte, ctmt_chave, tlcd, switches (array of switch ids in the plan),
    manual (array of plan switches without remote control). Rules are a short operator-given list,
    so they are expressions, not a join.
    """
    reasons: list[Column] = []
    used_all = F.array_distinct(F.concat(F.array(F.col("chave")), F.coalesce("switches", F.array().cast("array<string>"))))
    for rule in rules:
        if rule.forbidden:
            hit = F.array_sort(F.array_intersect(used_all, F.array(*[F.lit(c) for c in rule.forbidden])))
            reasons.append(
                F.when(F.size(hit) > 0, F.concat(F.lit(f"{rule.reason}: usa chave proibida "), F.array_join(hit, ", ")))
            )
        if rule.avoid:
            matches = []
            for target in rule.avoid:
                for value in ("fonte", "ctmt_chave"):
                    kind = feeder_match(F.lit(target), F.col(value))
                    a, b = feeder_key(F.lit(target)), feeder_key(F.col(value))
                    mode = F.when(F.startswith(a, b) | F.startswith(b, a), F.lit("prefixo")).otherwise(F.lit("substring"))
                    near = F.concat(
                        F.lit(" (casamento aproximado: "), F.lit(target), F.lit(" casou com "), F.trim(F.col(value)),
                        F.lit(" por "), mode, F.lit(")"),
                    )
                    matches.append(F.when(kind == "exact", F.lit("")).when(kind == "approximate", near))
            first = F.coalesce(*matches)
            source = F.when(text_or_empty(F.col("fonte")) != "", F.col("fonte")).otherwise(F.col("ctmt_chave"))
            reasons.append(
                F.when(first.isNotNull(), F.concat(F.lit(f"{rule.reason}: evita alimentar pela fonte "), source, first))
            )
        if rule.remote_only:
            local = F.array_sort(
                F.array_distinct(
                    F.concat(
                        F.when(~F.coalesce("tlcd", F.lit(False)), F.array(F.col("chave"))).otherwise(F.array().cast("array<string>")),
                        F.coalesce("manual", F.array().cast("array<string>")),
                    )
                )
            )
            reasons.append(
                F.when(
                    F.size(local) > 0,
                    F.concat(F.lit(f"{rule.reason}: exige só telecomandadas; há manobra local em "), F.array_join(local, ", ")),
                )
            )
    text = F.concat_ws("; ", *reasons) if reasons else F.lit("")
    return options.withColumn("bloqueio", F.nullif(text, F.lit("")))


def viable_options(options: DataFrame, unavailable: Sequence[str] = ()) -> DataFrame:
    """Options electrically viable, not blocked, without unavailable switches."""
    free = options.where(F.coalesce("viavel", F.lit(False)) & F.col("bloqueio").isNull())
    if not unavailable:
        return free
    used = F.concat(F.array(F.col("chave")), F.coalesce("switches", F.array().cast("array<string>")))
    return free.where(~F.arrays_overlap(used, F.array(*[F.lit(c) for c in unavailable])))


def equivalent_best(options: DataFrame, keys: Sequence[str], tolerance: float, *, margin: str = "margem", customers: str = "clientes") -> DataFrame:
    """Options as good as the best one: same customers, margin within ``tolerance``."""
    m = F.coalesce(F.col(margin), F.lit(float("-inf")))
    best = options.groupBy(*keys).agg(
        F.max(m).alias("_m"), F.min_by(customers, F.struct((-m).alias("a"), F.col("chave"))).alias("_c")
    )
    return options.join(best, list(keys)).where(
        F.col(customers).eqNullSafe(F.col("_c")) & (m >= F.col("_m") - F.lit(tolerance))
    ).drop("_m", "_c")


def rank_scored(options: DataFrame, keys: Sequence[str], *, blocked: str | None = None) -> DataFrame:
    """Order of scored options (W5): viable first, breaker margin (3 places, missing last), customers;
    blocked options last when ``blocked`` names their column."""
    order = [F.col(blocked).isNotNull()] if blocked else []
    order += [
        ~F.col("viavel"), -F.coalesce(round_to(F.col("margem"), 3), F.lit(float("-inf"))),
        F.col("ucbt").desc(), F.col("clientes").desc(), F.col("tlcd").desc(), F.col("chave"),
    ]
    return rank_in_group(options, list(keys), order, "ordem_score")


# --- electrical verdict (L8) ---------------------------------------------------------------------


def electrical_verdict(
    runs: DataFrame, voltages: DataFrame, currents: DataFrame, *, vmin: float = 0.93, vmax: float = 1.05
) -> DataFrame:
    """Verdict per option run.

    ``runs``: run_id, chave, fonte, modelled, converged, i_source, i_nominal; ``voltages``: run_id,
    bus, v_pu of the option's medium-voltage buses; ``currents``: run_id, element, loading_pct of
    its segments. Missing measurements (null or NaN) never fail a test.
    """
    v = F.nullif(F.col("v_pu"), F.lit(float("nan")))
    load = F.nullif(F.col("loading_pct"), F.lit(float("nan")))
    volts = voltages.where(v.isNotNull()).groupBy("run_id").agg(
        F.min(v).alias("vmin_mt_pu"), F.min_by("bus", F.struct(v, F.col("bus"))).alias("vmin_mt_barra"),
        F.max(v).alias("vmax_mt_pu"), F.min_by("bus", F.struct(-v, F.col("bus"))).alias("vmax_mt_barra"),
    )
    loads = currents.where(load.isNotNull()).groupBy("run_id").agg(
        F.max(load).alias("carregamento_max_pct"), F.count_if(load > 100.0).alias("n_sobrecargas"),
        F.min_by("element", F.struct(-load, F.col("element"))).alias("pior_elemento"),
    )
    i, nominal = F.nullif(F.col("i_source"), F.lit(float("nan"))), F.nullif(F.col("i_nominal"), F.lit(float("nan")))
    margin = F.when((nominal > 0) & i.isNotNull(), (nominal - i) / nominal)
    joined = runs.join(volts, "run_id", "left").join(loads, "run_id", "left").withColumn("margem", margin)
    modelled = F.coalesce("modelled", F.lit(True))

    def number_text(c: Column, places: int) -> Column:
        return F.regexp_replace(F.format_string(f"%.{places}f", c), r"\.", ",")

    reasons = F.when(
        ~modelled, F.array(F.concat(F.lit("fonte "), F.col("fonte"), F.lit(" fora do cluster (sem modelo)")))
    ).otherwise(
        F.array_compact(
            F.array(
                F.when(~F.coalesce("converged", F.lit(False)), F.lit("fluxo não convergiu")),
                F.when(F.col("vmin_mt_pu") < vmin, F.concat(F.lit("Vmin MT "), number_text(F.col("vmin_mt_pu"), 3), F.lit(" pu < "), number_text(F.lit(vmin), 2))),
                F.when(F.col("vmax_mt_pu") > vmax, F.concat(F.lit("Vmax MT "), number_text(F.col("vmax_mt_pu"), 3), F.lit(" pu > "), number_text(F.lit(vmax), 2))),
                F.when(F.col("n_sobrecargas") > 0, F.concat(F.col("n_sobrecargas").cast("string"), F.lit(" trecho(s) MT acima de 100 %"))),
                F.when((nominal > 0) & (i > nominal), F.concat(F.lit("I disjuntor "), F.format_string("%.0f", i), F.lit(" A > "), F.format_string("%.0f", nominal), F.lit(" A nominal"))),
            )
        )
    )
    return joined.withColumn("_r", reasons).select(
        *runs.columns, "vmin_mt_pu", "vmin_mt_barra", "vmax_mt_pu", "vmax_mt_barra", "carregamento_max_pct",
        F.coalesce("n_sobrecargas", F.lit(0)).alias("n_sobrecargas"), "pior_elemento", "margem",
        (F.size("_r") == 0).alias("viavel"), F.array_join("_r", "; ").alias("motivos"),
    )


def loaded_segments(currents: DataFrame, n: int = 5) -> DataFrame:
    """Most loaded line segments per run (T4)."""
    from gridlake.operators.quality import worst_per_group

    rows = currents.withColumn("cod_id", segment_of_element(F.col("element"))).where(
        F.col("cod_id").isNotNull() & F.nullif(F.col("loading_pct"), F.lit(float("nan"))).isNotNull()
    )
    return worst_per_group(rows, ["run_id"], [F.col("loading_pct").desc(), F.col("element")], n)


# --- plan checks (L6) ----------------------------------------------------------------------------


def plan_checks(
    plans: DataFrame, steps: DataFrame, known: DataFrame, boundary: DataFrame, options: DataFrame, *,
    unavailable: Sequence[str] = (), vmin: float = 0.93, vmax: float = 1.05, tolerance: float = 0.02,
) -> DataFrame:
    """One row per plan with every check and whether the plan may be proposed.

    ``plans``: plan_id, scenario, chave (null: isolate only); ``steps``: plan_id, step, action,
    switch_id; ``known``: switch_id, open; ``boundary``: scenario, switch_id; ``options``: scenario,
    chave, bloqueio, converged, vmin_mt_pu, vmax_mt_pu, margem, n_sobrecargas, viavel.
    """
    step = steps.join(known, "switch_id", "left")
    gone = F.array(*[F.lit(c) for c in unavailable]) if unavailable else F.array().cast("array<string>")
    per_plan = step.groupBy("plan_id").agg(
        F.count_if(F.col("open").isNull()).alias("_unknown"),
        F.count_if(F.array_contains(gone, F.col("switch_id"))).alias("_gone"),
        F.min(F.when(F.col("action") == "fechar", F.col("step"))).alias("_first_close"),
        F.max(F.when(F.col("action") == "abrir", F.col("step"))).alias("_last_open"),
    )
    opened = steps.where(F.col("action") == "abrir").select("plan_id", "switch_id").distinct()
    needed = plans.select("plan_id", "scenario").join(boundary, "scenario").join(known.where(~F.col("open")).select("switch_id"), "switch_id")
    missing = needed.join(opened, ["plan_id", "switch_id"], "left_anti").groupBy("plan_id").agg(F.count(F.lit(1)).alias("_missing"))
    best = options.where(F.coalesce("viavel", F.lit(False)) & F.col("bloqueio").isNull()).groupBy("scenario").agg(
        F.max(F.coalesce("margem", F.lit(-1.0))).alias("_best"), F.count(F.lit(1)).alias("_viable")
    )
    table = (
        plans.join(per_plan, "plan_id", "left").join(missing, "plan_id", "left")
        .join(options.withColumn("_option", F.lit(True)), ["scenario", "chave"], "left").join(best, "scenario", "left")
    )
    only_isolate = F.col("chave").isNull()
    listed = only_isolate | F.coalesce("_option", F.lit(False))
    margin, low, high = F.col("margem"), F.col("vmin_mt_pu"), F.col("vmax_mt_pu")
    voltage_bad = F.coalesce(low < vmin, F.lit(False)) | (low.isNotNull() & F.coalesce(high > vmax, F.lit(False)))
    checks = {
        "opcao_em_restore_options": listed,
        "chaves_existem": F.coalesce("_unknown", F.lit(0)) == 0,
        "chaves_disponiveis": F.coalesce("_gone", F.lit(0)) == 0,
        "restricoes_operacionais": F.col("bloqueio").isNull(),
        "abre_antes_de_fechar": ~F.coalesce(F.col("_first_close") < F.col("_last_open"), F.lit(False)),
        "fronteira_isolada": F.coalesce("_missing", F.lit(0)) == 0,
        "convergiu": only_isolate | F.coalesce("converged", F.lit(True)),
        "tensao_mt": only_isolate | ~voltage_bad,
        "corrente_disjuntor": only_isolate | ~F.coalesce(margin < 0, F.lit(False)),
        "sem_sobrecarga_mt": only_isolate | (F.coalesce("n_sobrecargas", F.lit(0)) == 0),
        "viavel": only_isolate | F.coalesce("viavel", F.lit(True)),
    }
    ok = reduce(lambda a, b: a & b, checks.values())
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(name)) for name, c in checks.items()]))
    better = ok & ~only_isolate & F.coalesce(F.col("_best") > F.coalesce(margin, F.lit(-1.0)) + tolerance, F.lit(False))
    unused = only_isolate & (F.coalesce("_viable", F.lit(0)) > 0)
    return table.select(
        "plan_id", "scenario", "chave", *[c.alias(n) if n != "viavel" else c.alias("opcao_viavel") for n, c in checks.items()],
        ok.alias("ok"), F.array_join(failed, ";").alias("falhas"),
        F.when(better, F.lit("há opção viável com margem maior")).when(unused, F.lit("há opção viável não usada")).otherwise(F.lit("")).alias("aviso"),
    )
