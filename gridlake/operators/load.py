"""Load curves, calendar, peak load and phase balance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.columns import (
    DELTA_CODES,
    ENERGY,
    PHASE_CODE,
    exact_sum,
    kilovolts,
    number,
    phase_index,
    text_or_empty,
    truncate_to,
)
from gridlake.functions.keyed import with_group_totals
from gridlake.functions.ordered import rank_in_group

DAY_TYPES = ("DU", "SA", "DO")
POINTS = [f"POT_{i:02d}" for i in range(1, 97)]
# National holidays (month, day); the last one counts from 2024 on.
FIXED_HOLIDAYS = ((1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (12, 25))
SINCE_2024 = (11, 20)
# Movable holidays as days from Easter Sunday.
FROM_EASTER = (-2, -47, 60)


# --- calendar (F5) -------------------------------------------------------------------------------


def easter(year: Column) -> Column:
    """Easter Sunday (Gregorian computus) as a date column."""

    def div(a, b):
        return F.floor(a / b)

    golden = year % 19
    century = div(year, 100)
    skipped = century - div(century, 4) - div(8 * century + 13, 25)
    epact = (skipped + 19 * golden + 15) % 30
    # two late epacts move one day earlier
    moon = epact - F.when((epact == 29) | ((epact == 28) & (golden > 10)), 1).otherwise(0)
    weekday = (year + div(year, 4) + moon + 2 - century + div(century, 4)) % 7
    days = moon - weekday
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), days.cast("int"))


def calendar(years: DataFrame, year: str = "ano") -> DataFrame:
    """Every day of the given years with its type: DU working day, SA Saturday, DO Sunday or a
    holiday on a weekday."""
    y = F.col(year).cast("int")
    days = years.select(y.alias(year)).distinct().select(
        year, easter(F.col(year)).alias("_easter"),
        F.explode(F.sequence(F.make_date(F.col(year), F.lit(1), F.lit(1)), F.make_date(F.col(year), F.lit(12), F.lit(31)))).alias("dia"),
    )
    month, dom = F.month("dia"), F.dayofmonth("dia")
    fixed = F.lit(False)
    for m, d in FIXED_HOLIDAYS:
        fixed = fixed | ((month == m) & (dom == d))
    fixed = fixed | ((F.col(year) >= 2024) & (month == SINCE_2024[0]) & (dom == SINCE_2024[1]))
    movable = F.datediff("dia", "_easter").isin(*FROM_EASTER)
    weekday = F.weekday("dia")
    kind = (
        F.when(weekday == 5, "SA").when(weekday == 6, "DO").when(fixed | movable, "DO").otherwise("DU")
    )
    return days.select(year, month.alias("mes"), "dia", kind.alias("tip_dia"), (fixed | movable).alias("feriado"))


def day_counts(years: DataFrame, year: str = "ano") -> DataFrame:
    """Days per year, month and type."""
    return calendar(years, year).groupBy(year, "mes").agg(*[F.count_if(F.col("tip_dia") == t).alias(t) for t in DAY_TYPES])


# --- curves (F6, F7) -----------------------------------------------------------------------------


def resample(values: Column, points: int = 24) -> Column:
    """Means of consecutive blocks, ``points`` of them, zero-padded; missing values count as zero."""
    clean = F.transform(values, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    step = F.greatest(F.lit(1), F.floor(F.size(values) / points)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.aggregate(F.slice(clean, i * step + 1, step), F.lit(0.0), lambda a, v: a + v) / step,
    )


def curve_profiles(curves: DataFrame, *, values: Column | None = None, key: str = "COD_ID", day: str = "TIP_DIA") -> DataFrame:
    """Per (curve, day type): hourly means scaled to the peak, load factor, sum, share of the curve."""
    source = values if values is not None else F.array(*[F.col(c) for c in POINTS if c in curves.columns])
    hourly = curves.select(text_or_empty(F.col(key)).alias(key), text_or_empty(F.col(day)).alias(day), resample(source).alias("_h"))
    peak = F.array_max("_h")
    total = F.aggregate("_h", F.lit(0.0), lambda a, v: a + v)
    shaped = hourly.select(
        key, day,
        F.when(peak > 0, F.transform("_h", lambda v: v / peak)).otherwise(F.transform("_h", lambda v: F.lit(0.0))).alias("mult"),
        F.when(peak > 0, (total / 24) / peak).otherwise(F.lit(1.0)).alias("fc"), total.alias("soma"),
    )
    # a curve has one row per day type
    out = with_group_totals(shaped, [key], _all=F.sum("soma"))
    return out.withColumn("prop", F.when(F.col("_all") != 0, F.col("soma") / F.col("_all")).otherwise(F.lit(0.0))).drop("_all")


def with_flat_curves(profiles: DataFrame, wanted: DataFrame, *, key: str = "COD_ID", day: str = "TIP_DIA") -> DataFrame:
    """Adds a flat curve (factor 1, equal shares) for every wanted code without one."""
    missing = wanted.select(text_or_empty(F.col(wanted.columns[0])).alias(key)).where(F.col(key) != "").distinct().join(
        profiles.select(key), key, "left_anti"
    )
    flat = missing.select(
        key, F.explode(F.array(*[F.lit(t) for t in DAY_TYPES])).alias(day),
        F.array_repeat(F.lit(1.0), 24).alias("mult"), F.lit(1.0).alias("fc"), F.lit(24.0).alias("soma"), F.lit(1.0 / 3.0).alias("prop"),
    )
    return profiles.unionByName(flat)


def peak_factors(
    profiles: DataFrame, days: DataFrame, day_type: str, years: Sequence[int], *, key: str = "COD_ID", day: str = "TIP_DIA", year: str = "ano"
) -> DataFrame:
    """Factor kWh of a month -> peak kW on ``day_type`` (F7): curve, year, month, factor.

    weight of a type = share x days; the month's energy of the type over its hours and load factor.
    """
    if day_type not in DAY_TYPES:
        raise ValueError(f"unknown day type: {day_type}")
    wide = profiles.groupBy(key).agg(
        *[F.max(F.when(F.col(day) == t, F.col("prop"))).alias(f"_p{t}") for t in DAY_TYPES],
        F.max(F.when(F.col(day) == day_type, F.col("fc"))).alias("_fc"),
    )
    periods = wide.withColumn(year, F.explode(F.array(*[F.lit(int(y)) for y in years]))).withColumn(
        "mes", F.explode(F.sequence(F.lit(1), F.lit(12)))
    )
    joined = periods.join(days, [year, "mes"])
    weight = {t: F.coalesce(f"_p{t}", F.lit(0.0)) * F.col(t) for t in DAY_TYPES}
    total = weight["DU"] + weight["SA"] + weight["DO"]
    n = F.col(day_type)
    all_days = F.col("DU") + F.col("SA") + F.col("DO")
    share = F.when(total != 0, weight[day_type] / total).otherwise(F.lit(0.0))
    known = F.coalesce(F.col("_fc") > 0, F.lit(False))
    factor = F.when(known, F.when(n > 0, share / (n * 24 * F.col("_fc"))).otherwise(F.lit(0.0))).otherwise(F.lit(1.0) / (all_days * 24))
    return joined.select(key, year, "mes", factor.alias("fator"))


# --- loads (A25, W9, L5, F8) ---------------------------------------------------------------------


def merge_duplicates(rows: DataFrame, key: str = "COD_ID", energy: Sequence[str] = tuple(ENERGY), order: Sequence[str] = ()) -> DataFrame:
    """One row per id: energies summed, other columns from the last row in ``order``."""
    summed = [c for c in energy if c in rows.columns]
    rest = [c for c in rows.columns if c not in (key, *summed)]
    ordering = F.struct(*[F.col(c) for c in (order or rest or [key])])
    aggregates = [exact_sum(F.col(c)).alias(c) for c in summed]
    if rest:
        aggregates.append(F.max_by(F.struct(*rest), ordering).alias("_r"))
    out = rows.groupBy(key).agg(*aggregates)
    return (out.select(key, *summed, "_r.*") if rest else out).select(*rows.columns)


def unique_names(rows: DataFrame, name: str, key: str = "COD_ID", out: str = "nome") -> DataFrame:
    """A repeated name gets ``_1``, ``_2`` ... in id order; a single one stays as it is."""
    ranked = rank_in_group(rows, [name], [key], "_n", size="_size")
    text = F.col(name).cast("string")
    return ranked.withColumn(
        out, F.when(F.col("_size") > 1, F.concat(text, F.lit("_"), F.col("_n").cast("string"))).otherwise(text)
    ).drop("_n", "_size")


def load_table(
    customers: DataFrame, factors: DataFrame, month: int, transformers: DataFrame | None, *, low_voltage: bool,
    base_kv: float = 13.8, name: str = "PN_CON",
) -> DataFrame:
    """Loads with node, phases, connection, kV, curve and kW by both models.

    ``factors``: COD_ID, fator of the wanted day type, year and month, plus the row of the code
    ``""`` for customers without a curve; ``transformers``: COD_ID, kv_line, kv_phase.
    Customers without yearly energy are left out; kW is truncated to 1e-6; the nominal model takes
    the installed load when there is one (F8).
    """
    present = [c for c in ENERGY if c in customers.columns]
    yearly = sum((F.coalesce(number(F.col(c)), F.lit(0.0)) for c in present), F.lit(0.0))
    named = unique_names(merge_duplicates(customers), name)
    rows = named.where(yearly != 0)
    phases = F.when(text_or_empty(F.col("FAS_CON")) != "", text_or_empty(F.col("FAS_CON"))).otherwise(F.lit("AN" if low_voltage else "ABC"))
    curve = F.when(text_or_empty(F.col("TIP_CC")) != "", text_or_empty(F.col("TIP_CC"))).otherwise(F.lit("flat"))
    rows = rows.withColumns({"fas_con": phases, "curva": curve, "kwh": F.coalesce(number(F.col(f"ENE_{month:02d}")), F.lit(0.0))})
    rows = rows.join(factors.select(F.col("COD_ID").alias("curva"), "fator"), "curva", "left")
    # one row whatever the factors hold
    flat = factors.where(F.col("COD_ID") == "").agg(F.max("fator").alias("_flat")).select(F.lit(1).alias("_one"), "_flat")
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(flat), "_one", "left")
    three = F.col("fas_con").isin("ABC", "ABCN")
    wye = ~F.col("fas_con").isin(*DELTA_CODES)
    if low_voltage:
        rows = rows.withColumn("uni_tr_mt", text_or_empty(F.col("UNI_TR_MT")))
        table = transformers.select(F.col("COD_ID").alias("uni_tr_mt"), "kv_line", "kv_phase")
        rows = rows.join(table, "uni_tr_mt", "left")
        fallback = F.coalesce(F.nullif(kilovolts(F.col("TEN_FORN")), F.lit(0.0)), F.lit(0.22))
        line = F.coalesce(F.nullif(F.col("kv_line"), F.lit(0.0)), fallback)
        kv = F.when(~three & wye, F.coalesce(F.nullif(F.col("kv_phase"), F.lit(0.0)), line / F.sqrt(F.lit(3.0)))).otherwise(line)
    else:
        rows = rows.withColumn("uni_tr_mt", F.lit(""))
        kv = F.lit(float(base_kv))
    kw = truncate_to(F.col("kwh") * F.coalesce("fator", "_flat", F.lit(0.0)), 6)
    installed = F.greatest(F.coalesce(number(F.col("CAR_INST")), F.lit(0.0)), F.lit(0.0))
    return rows.select(
        F.concat(F.lit("BT_" if low_voltage else "MT_"), "nome").alias("carga"), text_or_empty(F.col("PAC")).alias("pac"), "fas_con",
        F.when(three, 3).otherwise(1).alias("fases"), F.when(wye, "Wye").otherwise("Delta").alias("conexao"), kv.alias("kv"), "curva", "uni_tr_mt",
        kw.alias("kw_curva"), F.when(installed > 0, installed).otherwise(kw).alias("kw_nominal"),
    )


# --- phase balance (L4) --------------------------------------------------------------------------


def rebalance_phases(
    loads: DataFrame, *, group: str = "uni_tr_mt", order: Sequence[str] = ("pac", "carga"), kw: str = "kw_curva",
    phase: str = "fas_con", allowed: str = "fases_permitidas",
) -> DataFrame:
    """Greedy balance inside each transformer (L4): in order, each movable load goes to the allowed
    phase with the least load so far (smaller index on a tie). Adds ``nova_fase`` and ``trocou``.

    ``allowed`` is an array of phase indexes at the load's node; loads with fewer than two choices,
    no transformer or no wye phase keep theirs. The rule depends on order inside a transformer, so
    rows are sorted in the JVM (spilling if needed) and streamed through three running sums: no
    group is ever held in memory. Rows that the rule never touches stay where they are.
    """
    index = phase_index(F.col(phase))
    choices = F.array_sort(F.array_intersect(F.coalesce(allowed, F.array().cast("array<int>")), F.array(*[F.lit(i) for i in (1, 2, 3)])))
    movable = (text_or_empty(F.col(group)) != "") & index.isNotNull() & (F.size(choices) >= 2)
    if "conexao" in loads.columns:
        movable = movable & (F.col("conexao") == "Wye") & (F.col("fases") == 1)
    mask = F.aggregate(choices, F.lit(0), lambda a, v: a + F.pow(F.lit(2.0), v - 1).cast("int"))
    movable = F.coalesce(movable, F.lit(False))
    prepared = loads.where(movable).withColumns({"_mask": mask, "_kw": F.greatest(F.coalesce(F.col(kw), F.lit(0.0)), F.lit(0.0))})
    ordered = prepared.repartition(group).sortWithinPartitions(group, *order)
    schema = loads.withColumn("_new", F.lit(0)).schema

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sums = None, np.zeros(3)
        for pdf in batches:
            keys, masks, power = pdf[group].to_numpy(), pdf["_mask"].to_numpy(), pdf["_kw"].to_numpy()
            chosen = np.zeros(len(pdf), dtype="int32")
            for i in range(len(pdf)):
                if keys[i] != current:
                    current, sums = keys[i], np.zeros(3)
                if masks[i]:
                    best = min((p for p in range(3) if masks[i] >> p & 1), key=lambda p: (sums[p], p))
                    sums[best] += power[i]
                    chosen[i] = best + 1
            yield pdf.drop(columns=["_mask", "_kw"]).assign(_new=chosen)

    moved = ordered.mapInPandas(stream, schema).unionByName(loads.where(~movable).withColumn("_new", F.lit(0)))
    code = F.element_at(F.array(*[F.lit(PHASE_CODE[i]) for i in (1, 2, 3)]), F.nullif(F.col("_new"), F.lit(0)))
    keep = (F.col("_new") == 0) | (F.col("_new") == phase_index(F.col(phase)))
    return moved.select(
        *loads.columns, F.when(keep, F.col(phase)).otherwise(code).alias("nova_fase"), (~F.coalesce(keep, F.lit(True))).alias("trocou")
    )
