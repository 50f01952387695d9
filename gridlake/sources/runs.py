"""Benchmark and stage result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.columns import number
from gridlake.functions.keyed import with_group_totals
from gridlake.operators.results import sequence_score

# Columns of a run file; (name, kind, default). Kinds: t text, o optional text,
# i whole number, f number, b flag, l JSON list of strings.
RUN_COLUMNS = (
    ("tarefa", "t", None), ("nivel", "t", None), ("cluster", "t", ""), ("repeticao", "i", 0),
    ("acerto", "b", False), ("obtido", "o", None), ("esperado", "o", None), ("sequencia", "l", None),
    ("referencia", "l", None), ("ordem", "f", 0.0), ("precisao", "f", 0.0), ("desnecessarias", "i", None),
    ("rodadas", "i", 0), ("tokens_prompt", "i", 0), ("tokens_completion", "i", 0), ("tokens_total", "i", 0),
    ("tokens_informados", "b", False), ("chars_ferramentas", "i", 0), ("segundos_llm", "f", 0.0),
    ("segundos_ferramentas", "f", 0.0), ("segundos_total", "f", 0.0), ("replanejamentos", "i", 0),
    ("recusas", "i", 0), ("erro", "o", None), ("resposta", "t", ""), ("provider", "t", "?"),
    ("familia", "o", None), ("modelo", "o", None), ("exemplos", "b", True), ("compactado", "b", True),
    ("seed", "i", None), ("data", "t", ""),
)


def _typed(c: Column, kind: str, default) -> Column:
    blank = F.nullif(c, F.lit(""))
    if kind == "l":
        return F.from_json(F.coalesce(blank, F.lit("[]")), "array<string>")
    if kind == "o":
        return blank
    if kind == "t":
        return F.coalesce(c, F.lit(default)) if default is not None else c
    value = number(blank)
    typed = {"i": value.cast("long"), "f": value, "b": value.cast("int") != 0}[kind]
    return F.coalesce(typed, F.lit(default)) if default is not None else typed


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Typed run table from CSV files with a header (S13): defaults for missing columns, rows
    without task or level (or with an unreadable number or list) dropped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(
        path, header=True, multiLine=True, escape='"', enforceSchema=False
    )
    raw = raw.withColumn("arquivo", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    present = {n: (F.col(n) if n in raw.columns else F.lit(None).cast("string")) for n, _, _ in RUN_COLUMNS}
    bad = F.coalesce(present["tarefa"], F.lit("")).eqNullSafe("") | present["nivel"].isNull()
    for name, kind, _ in RUN_COLUMNS:
        blank = F.nullif(present[name], F.lit(""))
        if kind in "ifb":
            bad = bad | (blank.isNotNull() & number(blank).isNull())
        elif kind == "l":
            bad = bad | (blank.isNotNull() & F.from_json(blank, "array<string>").isNull())
    rows = raw.where(~bad).select("arquivo", *[_typed(present[n], k, d).alias(n) for n, k, d in RUN_COLUMNS])
    return rows.withColumn(
        "desnecessarias", F.coalesce("desnecessarias", sequence_score(F.col("sequencia"), F.col("referencia"))["desnecessarias"].cast("long"))
    )


def run_label() -> Column:
    """Provider and mode of a run: what is compared between files."""
    mode = F.concat_ws("·", F.when(~F.col("exemplos"), "sem-exemplos"), F.when(~F.col("compactado"), "sem-compactar"))
    return F.concat_ws("·", F.col("provider"), F.coalesce("familia", "modelo"), F.nullif(mode, F.lit("")))


def newest_per_label(runs: DataFrame) -> DataFrame:
    """Rows of the newest file of each label."""
    labelled = runs.withColumn("rotulo", run_label())
    return with_group_totals(labelled, ["rotulo"], _newest=F.max("arquivo")).where(F.col("arquivo") == F.col("_newest")).drop("_newest")


def read_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Result table with a header (stage results, restoration options, inventories)."""
    return spark.read.csv(path, header=True, inferSchema=False) if fmt == "csv" else spark.read.format(fmt).load(path)
