"""Verification of hash-chained logs and reconstruction of event timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.columns import literal_map
from gridlake.functions.ordered import running_totals
from gridlake.operators.components import connected_components
from gridlake.session import materialise
from gridlake.sources.logs import event_ids, proposal_ids, record_hash

GENESIS = "0" * 64
# Record types and their timeline entry and title.
ENTRIES = {
    "agente.inicio": ("evento", "Agente recebeu o evento"),
    "mcp.chamada": ("ferramenta", ""),
    "mcp.recusa": ("ferramenta_erro", "Ferramenta recusada"),
    "mcp.erro": ("ferramenta_erro", "Ferramenta falhou"),
    "agente.verificador.ok": ("verificador", "Verificador aprovou a proposta"),
    "agente.verificador.recusa": ("verificador", "Verificador recusou a proposta"),
    "agente.replanejamento": ("replanejamento", "Replanejamento após rejeição humana"),
    "hitl.aprovacao": ("aprovacao", "Aprovação humana"),
    "hitl.rejeicao": ("rejeicao", "Rejeição humana"),
    "hitl.passo": ("passo_humano", "Execução passo a passo"),
    "agente.fim": ("encerramento", "Agente encerrou a execução"),
}
TOOL_TITLES = {
    "load_cluster": "Cluster carregado",
    "inject_fault": "Evento injetado",
    "locate_fault": "Falta localizada",
    "isolate_fault": "Isolamento calculado",
    "restore_options": "Opções de restauração avaliadas",
    "propose_plan": "Proposta registrada",
    "set_switch": "Manobra executada",
    "run_powerflow": "Fluxo de potência executado",
    "get_topology": "Topologia consultada",
    "get_switch_state": "Estado de chave consultado",
    "downstream_customers": "Clientes a jusante consultados",
    "get_proposal": "Proposta consultada",
}
HUMAN = ("hitl.aprovacao", "hitl.rejeicao", "hitl.passo")
PREPARING = ("load_cluster", "inject_fault")


def chain_links(records: DataFrame, *, hash_check: bool = True, genesis: str = GENESIS) -> DataFrame:
    """Each record tested against its position and predecessor (W8): adds ``error``.

    The predecessor is fetched with an equi-join on (file, position - 1), so one long file is spread
    over all tasks. Order of tests: sequence, previous hash, own hash.
    """
    before = records.select("file", (F.col("pos") + 1).alias("pos"), F.col("hash").alias("_before"))
    joined = records.join(before, ["file", "pos"], "left")
    expected = F.when(F.col("pos") == 1, F.lit(genesis)).otherwise(F.col("_before"))
    error = F.when(
        F.col("seq") != F.col("pos"),
        F.concat(F.lit("sequência quebrada: esperado seq="), F.col("pos").cast("string"), F.lit(", encontrado "), F.col("seq").cast("string")),
    ).when(~F.col("hash_anterior").eqNullSafe(expected), F.concat(F.lit("seq="), F.col("seq").cast("string"), F.lit(": hash_anterior não bate com o registro anterior")))
    if hash_check:
        error = error.when(
            ~record_hash().eqNullSafe(F.col("hash")), F.concat(F.lit("seq="), F.col("seq").cast("string"), F.lit(": hash não bate (registro alterado)"))
        )
    return joined.withColumn("error", error).drop("_before")


def verify_files(records: DataFrame, *, hash_check: bool = True) -> DataFrame:
    """Per file: intact?, number of records, first divergence (L12). An unreadable line comes first."""
    readable = chain_links(records.where(F.col("problem").isNull()), hash_check=hash_check)
    unreadable = records.where(F.col("problem").isNotNull()).groupBy("file").agg(F.min_by("problem", "line").alias("_bad"))
    checked = readable.groupBy("file").agg(
        F.count(F.lit(1)).alias("registros"), F.min_by(F.col("error"), F.when(F.col("error").isNotNull(), F.col("pos"))).alias("_first")
    )
    files = records.select("file").distinct()
    out = files.join(checked, "file", "left").join(unreadable, "file", "left")
    failure = F.coalesce("_bad", "_first")
    return out.select(
        "file", failure.isNull().alias("integra"), F.when(failure.isNull(), F.coalesce("registros", F.lit(0))).alias("registros"), failure.alias("erro")
    )


def with_empty_files(verified: DataFrame, files: DataFrame) -> DataFrame:
    """Files without any record are intact with zero records (L12). ``files``: file."""
    empty = files.join(verified, "file", "left_anti").select(
        "file", F.lit(True).alias("integra"), F.lit(0).cast("long").alias("registros"), F.lit(None).cast("string").alias("erro")
    )
    return verified.unionByName(empty)


def _placed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event_id, file, pos, component of the records each event has by itself; file, pos, tipo, entrada, component of those that name proposals).

    ``file``, ``pos`` name a record. Proposals named in one record share a component, so a record has one or none.
    """
    base = records.select("file", "pos", "tipo", "dados")
    tool = F.get_json_object("dados", "$.ferramenta")
    prepare = F.col("tipo").isin("mcp.chamada", "mcp.recusa", "mcp.erro") & F.coalesce(tool.isin(*PREPARING), F.lit(False))
    flagged = base.withColumns({"_fim": (F.col("tipo") == "agente.fim").cast("int"), "_np": (~prepare).cast("int")})
    counted = running_totals(flagged.withColumns({"_ends": F.col("_fim"), "_other": F.col("_np")}), ["file", "pos"], ["_ends", "_other"])
    # a run is the stretch between two end records; preparing calls share the count before the start
    marked = materialise(counted.withColumn("_run", F.col("_ends") - F.col("_fim")), "marked")
    mentions = marked.select("file", "pos", "tipo", "_run", "_other", F.explode(event_ids(F.col("dados"))).alias("event_id"))
    starts = mentions.where(F.col("tipo") == "agente.inicio")
    runs = starts.groupBy("event_id", "file", "_run").agg(F.min("pos").alias("_from"))
    inside = marked.join(runs, ["file", "_run"]).where(F.col("pos") >= F.col("_from")).select("event_id", "file", "pos")
    prepared = marked.where(F.col("_np") == 0).withColumn("_other", F.col("_other") + 1).join(
        starts.select("event_id", "file", "_other"), ["file", "_other"]
    ).select("event_id", "file", "pos")
    direct = mentions.select("event_id", "file", "pos").unionByName(inside).unionByName(prepared).distinct()

    named = base.select("file", "pos", "tipo", _entry().alias("entrada"), proposal_ids(F.concat_ws(" ", "tipo", "dados")).alias("_ids")).where(F.size("_ids") > 0)
    # proposals named in one record form a chain, not all pairs
    chain = named.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("_ids")), lambda i: F.struct(
        F.element_at("_ids", i).alias("src"), F.element_at("_ids", F.greatest(i - 1, F.lit(1))).alias("dst")
    ))).alias("_e")).select("_e.*").distinct()
    chain = materialise(chain, "chain")
    groups = connected_components(chain, chain.select(F.col("src").alias("node")))
    place = materialise(named.withColumn("proposal", F.get("_ids", 0)).join(groups.withColumnRenamed("node", "proposal"), "proposal").select(
        "file", "pos", "tipo", "entrada", "component"), "place")
    return materialise(direct.join(place.select("file", "pos", "component"), ["file", "pos"], "left"), "direct"), place


def event_records(records: DataFrame) -> DataFrame:
    """event_id, file, pos: the records of every event.

    Direct mentions, the agent run around a start record (with the preparing calls just before it),
    and everything tied to them through shared proposal ids, closed over chains of proposals.
    """
    direct, place = _placed(records)
    # an event has all records of a component it reaches, so only records without one are its own alone
    alone = direct.where(F.col("component").isNull()).select("event_id", "file", "pos")
    reached = direct.where(F.col("component").isNotNull()).select("event_id", "component").distinct()
    return alone.unionByName(reached.join(place.select("file", "pos", "component"), "component").select("event_id", "file", "pos"))


def _entry():
    """The kind of entry a record makes; null for one that makes none."""
    call = F.col("tipo") == "mcp.chamada"
    with_options = call & (F.get_json_object("dados", "$.ferramenta") == "restore_options") & F.startswith(F.get_json_object("dados", "$.resultado"), F.lit("{"))
    entry = F.try_element_at(literal_map({k: v[0] for k, v in ENTRIES.items()}), F.col("tipo"))
    return F.when(F.coalesce(with_options, F.lit(False)), "opcoes").otherwise(entry)


def _canonical(human_log: str):
    return F.element_at(F.split("file", "/"), -1) == human_log


def entry_counts(records: DataFrame, human_log: str = "hitl.jsonl") -> DataFrame:
    """event_id, entrada, n: how many entries of each kind the timeline of every event has.

    Records are counted per group of proposals before events meet them, so no record is listed once per event.
    """
    direct, place = _placed(records)
    kinds = ["_canonical", "tipo", "entrada"]
    own = direct.where(F.col("component").isNull()).select("event_id", "file", "pos").join(
        records.select("file", "pos", "tipo", _entry().alias("entrada")), ["file", "pos"])
    own = own.withColumn("_canonical", _canonical(human_log)).groupBy("event_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    shared = place.withColumn("_canonical", _canonical(human_log)).groupBy("component", *kinds).agg(F.count(F.lit(1)).alias("n"))
    reached = direct.where(F.col("component").isNotNull()).select("event_id", "component").distinct()
    counts = own.unionByName(reached.join(shared, "component").select("event_id", *kinds, "n"))
    has_log = counts.groupBy("event_id").agg(F.max("_canonical").alias("_has"))
    kept = counts.join(has_log, "event_id").where(~(F.col("_has") & F.col("tipo").isin(*HUMAN) & ~F.col("_canonical")))
    return kept.where(F.col("tipo").isin(*ENTRIES)).groupBy("event_id", "entrada").agg(F.sum("n").alias("n"))


def event_timeline(records: DataFrame, human_log: str = "hitl.jsonl") -> DataFrame:
    """Typed timeline of every event (L11): one row per entry with its place in the event's order.

    Human records outside the human log are dropped when the event has records in that log; order
    is time, human log first, file, sequence.
    """
    rows = event_records(records).join(records, ["file", "pos"])
    canonical = _canonical(human_log)
    has_log = rows.groupBy("event_id").agg(F.max(canonical).alias("_has"))
    kept = rows.join(has_log, "event_id").where(~(F.col("_has") & F.col("tipo").isin(*HUMAN) & ~canonical))
    kept = kept.where(F.col("tipo").isin(*ENTRIES))
    tool = F.get_json_object("dados", "$.ferramenta")
    title = F.try_element_at(literal_map({k: v[1] for k, v in ENTRIES.items()}), F.col("tipo"))
    call = F.col("tipo") == "mcp.chamada"
    tool_title = F.coalesce(F.try_element_at(literal_map(TOOL_TITLES), tool), F.concat(F.lit("Ferramenta "), tool))
    ids = proposal_ids(F.col("dados"))
    return kept.select(
        "event_id", "ts", F.when(canonical, 0).otherwise(1).alias("prioridade"), "file", "seq", F.col("tipo").alias("registro_tipo"),
        _entry().alias("entrada"),
        F.when(call, tool_title).otherwise(title).alias("titulo"), tool.alias("ferramenta"),
        F.get_json_object("dados", "$.operador").alias("operador"), F.get_json_object("dados", "$.motivo").alias("motivo"),
        F.get_json_object("dados", "$.erro").alias("erro"), F.get_json_object("dados", "$.resposta").alias("resposta"),
        F.get(ids, 0).alias("proposta"),
    )


def final_answers(timeline: DataFrame) -> DataFrame:
    """Last closing entry's answer per event."""
    closing = timeline.where(F.col("entrada") == "encerramento")
    return closing.groupBy("event_id").agg(
        F.max_by("resposta", F.struct("ts", "prioridade", "file", "seq")).alias("resposta_final")
    )


def event_files(timeline: DataFrame, verified: DataFrame) -> DataFrame:
    """Chain state of the files each event appears in."""
    return timeline.select("event_id", "file").distinct().join(verified, "file")
