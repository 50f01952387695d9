import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions import columns as col
from gridlake.functions.ordered import exact_percentile, global_rank, previous_row, rank_in_group
from gridlake.operators import audit, load, results, sample
from gridlake.operators.components import connected_components
from gridlake.operators.network import energised
from gridlake.session import materialise
from gridlake.sources.logs import append_events, event_ids, events_since, read_audit
from gridlake.sources.runs import newest_per_label, read_runs
from gridlake.streaming import jobs


def test_percentile_and_ranks(spark):
    rng = random.Random(3)
    data = [("a" if rng.random() < 0.7 else "b", float(rng.randint(0, 40)), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, v double, i int")
    for q in (0.5, 0.99):
        got = {r.g: r.p for r in exact_percentile(df, ["g"], "v", q, "p").collect()}
        for g in "ab":
            assert abs(got[g] - np.percentile([v for k, v, _ in data if k == g], q * 100)) < 1e-9
    order = [r.i for r in global_rank(df, ["v", "i"]).orderBy("rank").collect()]
    assert order == [i for _, _, i in sorted(data, key=lambda t: (t[1], t[2]))]
    ranks = {r.i: (r["rank"], r.n) for r in rank_in_group(df, ["g"], ["v", "i"], size="n").collect()}
    for g in "ab":
        mine = sorted((t for t in data if t[0] == g), key=lambda t: (t[1], t[2]))
        assert all(ranks[t[2]] == (k, len(mine)) for k, t in enumerate(mine, 1))
    before = {r.i: r.b for r in previous_row(df, ["g"], ["i"], {"i": "b"}).collect()}
    for g in "ab":
        ids = sorted(t[2] for t in data if t[0] == g)
        assert all(before[b] == a for a, b in zip([None, *ids], ids))


def test_components_of_chains_and_hubs(spark):
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(40)]
    labels = connected_components(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("solo",)], "node string"))
    got = {r.node: r.component for r in labels.collect()}
    assert set(got.values()) == {"c000", "h0", "solo"} and len(got) == 61 + 41 + 1


def lcs(a, b):
    best = 0
    for n in range(min(len(a), len(b)), 0, -1):
        if any(list(c) == list(d) for c in itertools.combinations(a, n) for d in itertools.combinations(b, n)):
            best = n
            break
    return best


def test_sequence_scores(spark):
    rows = [(["a", "b", "c", "b"], ["b", "c", "a", "b"]), ([], ["a"]), (["a"], []), ([], []), (["x", "a", "y", "b"], ["a", "b"])]
    df = spark.createDataFrame(rows, "s array<string>, r array<string>")
    out = df.select("s", "r", *[c.alias(n) for n, c in results.sequence_score(F.col("s"), F.col("r")).items()]).collect()
    for o in out:
        common = lcs(o.s, o.r)
        assert o.comum == common and o.desnecessarias == max(len(o.s) - common, 0)
        assert o.ordem == (1.0 if not o.r else round(common / len(o.r), 4))
        assert o.precisao == ((1.0 if not o.s else 0.0) if not o.r else (round(common / len(o.s), 4) if o.s else 0.0))


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("4.036 clientes, 45,98 kW e 1.234,5 m; V=0.93, v2 x-7 -3",)], "t string")
    r = df.select(results.numbers_in(F.col("t")).alias("n"), results.number_hit(F.col("t"), F.lit(4036.0)).alias("a"), results.number_hit(F.col("t"), F.lit(0.94)).alias("b"), results.number_hit(F.col("t"), F.lit(5000.0)).alias("c")).collect()[0]
    assert {4036.0, 4.036, 45.98, 1234.5, 0.93, -3.0} <= set(r.n) and (r.a, r.b, r.c) == (True, True, False)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("12", [12.0]), ("+7", [7.0]), ("-1.250", [-1250.0, -1.25]), ("1.234.567", [1234567.0]), ("1.234.567,5", [1234567.5]), ("0,50", [0.5]), ("3.14", [3.14]),
        ("1234.567", [1234.567]), ("12.", [12.0]), ("kV13", []), ("13kV", []), ("1,2,3", [1.2]), ("", []), (None, []), ("5 e 6", [5.0, 6.0]),
    ],
)
def test_number_readings(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(results.numbers_in(F.col("t")).alias("n")).collect()[0].n == want


def test_ids_of_any_length(spark):
    from gridlake.sources.logs import event_ids, events_since, proposal_ids

    one = spark.range(1).select(event_ids(F.lit("E-9999 E-10000 E-123")).alias("e"), proposal_ids(F.lit("[P-123456]")).alias("p")).collect()[0]
    assert (one.e, one.p) == (["E-9999", "E-10000"], ["P-123456"])
    numbered = spark.createDataFrame([(f"E-{n}",) for n in (9999, 10000, 12345678901, 12345678902)], "id string")
    assert [r.id for r in events_since(numbered, 9999).collect()] == ["E-10000", "E-12345678901", "E-12345678902"]


def test_phase_balance_against_plain_loop(spark):
    rng = random.Random(5)
    rows = [(f"T{rng.randrange(4)}", f"p{i}", f"c{i:03d}", float(rng.randint(1, 9)), rng.choice(["AN", "BN", "CN", "ABC"]), sorted(rng.sample([1, 2, 3], rng.randint(1, 3)))) for i in range(120)]
    df = spark.createDataFrame(rows, "uni_tr_mt string, pac string, carga string, kw_curva double, fas_con string, fases_permitidas array<int>")
    got = {r.carga: (r.nova_fase, r.trocou) for r in load.rebalance_phases(df).collect()}
    sums, index = {}, {"AN": 1, "BN": 2, "CN": 3}
    for t, pac, name, kw, phase, allowed in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if phase not in index or len(allowed) < 2:
            assert got[name] == (phase, False)
            continue
        best = min(allowed, key=lambda p: (sums.get((t, p), 0.0), p))
        sums[(t, best)] = sums.get((t, best), 0.0) + kw
        assert got[name] == ({1: "AN", 2: "BN", 3: "CN"}[best], best != index[phase]), name


def test_calendar(spark):
    years = spark.createDataFrame([(y,) for y in (2019, 2024, 2025, 2038, 2076)], "ano int")
    e = {r.ano: str(r.e) for r in years.select("ano", load.easter(F.col("ano")).alias("e")).collect()}
    assert e == {2019: "2019-04-21", 2024: "2024-03-31", 2025: "2025-04-20", 2038: "2038-04-25", 2076: "2076-04-19"}
    jan = load.day_counts(years).where("ano = 2025 and mes = 1").collect()[0]
    assert (jan.DU, jan.SA, jan.DO) == (22, 4, 5)
    holidays = {str(r.dia) for r in load.calendar(years).where("ano = 2025 and feriado").collect()}
    assert {"2025-03-04", "2025-04-18", "2025-06-19", "2025-11-20"} <= holidays and len(holidays) == 12


def test_load_table(spark, catalog):
    profiles = load.with_flat_curves(load.curve_profiles(catalog.read("CRVCRG")), spark.createDataFrame([("NOVA",)], "c string"))
    p = {(r.COD_ID, r.TIP_DIA): r for r in profiles.collect()}
    assert abs(sum(p[("RES", d)].prop for d in ("DU", "SA", "DO")) - 1) < 1e-12 and p[("NOVA", "SA")].fc == 1.0
    assert len(p[("RES", "DU")].mult) == 24 and max(p[("RES", "DU")].mult) == 1.0
    days = load.day_counts(spark.createDataFrame([(2025,)], "ano int"))
    factors = load.peak_factors(profiles, days, "DU", [2025]).where("mes = 1")
    f = {r.COD_ID: r.fator for r in factors.collect()}
    assert abs(f["NOVA"] - (22 / 31) / (22 * 24)) < 1e-15
    transformers = spark.createDataFrame([("T1", 0.22, 0.127), ("T3", 0.22, 0.127)], "COD_ID string, kv_line double, kv_phase double")
    table = {(r.pac, r.kw_nominal): r for r in load.load_table(catalog.read("UCBT_tab"), factors, 1, transformers, low_voltage=True).collect()}
    one = table[("L1a", 0.2)]
    assert (one.fases, one.conexao, one.kv, one.kw_nominal) == (1, "Wye", 0.127, 0.2)
    assert abs(one.kw_curva - int(100.0 * f["RES"] * 1e6) / 1e6) < 1e-12
    assert table[("L3a", 1.5)].fases == 3 and table[("L3a", 1.5)].conexao == "Delta" and table[("L4", 0.2)].kv == pytest.approx(0.23 / 3**0.5)


def test_sampling(spark):
    inv = spark.createDataFrame(
        [("R1", "1", -22.906, -22.904, -43.183, -43.181), ("R2", "1", -22.926, -22.924, -43.236, -43.234), ("R3", "1", -22.985, -22.983, -43.204, -43.202), ("R4", "1", -23.004, -23.002, -43.351, -43.349), ("R5", "2", -22.906, -22.904, -43.183, -43.181), ("R6", "1", -20.0, -20.0, -40.0, -40.0)],
        "COD_ID string, MUN string, lat_min double, lat_max double, lon_min double, lon_max double",
    )
    seg = spark.createDataFrame([(c,) for c, n in (("R1", 5), ("R2", 20), ("R3", 40), ("R4", 80)) for _ in range(n)], "CTMT string")
    rows = {r.COD_ID: (r.regiao, r.n_trechos, r.porte) for r in sample.sampling_universe(inv, seg, "1").collect()}
    assert rows == {"R1": ("Centro", 5, "P"), "R2": ("Tijuca", 20, "P"), "R3": ("Ipanema/Leblon", 40, "M"), "R4": ("Barra/Recreio", 80, "G")}
    eight = spark.createDataFrame([(f"k{i}", i * 10) for i in range(8)], "k string, n int")
    sizes = {r.porte: r["count"] for r in sample.size_class(eight, "n", "k").groupBy("porte").count().collect()}
    assert sizes == {"P": 3, "M": 2, "G": 3}
    base = spark.createDataFrame([(f"f{i}", "r%d" % (i % 3), "P" if i % 5 else "G") for i in range(40)], "COD_ID string, regiao string, porte string")
    a = [r.COD_ID for r in sample.stratified_sample(base, 11, 91).orderBy("ordem_sorteio").collect()]
    b = [r.COD_ID for r in sample.stratified_sample(base, 11, 91).orderBy("ordem_sorteio").collect()]
    assert a == b and len(a) == 11 and sum(r.alocados for r in sample.strata_allocation(base, 11).collect()) == 11


def write_chain(path, entries, tamper=None):
    previous, lines = "0" * 64, []
    for seq, (ts, kind, data) in enumerate(entries, 1):
        body = {"seq": seq, "ts": ts, "tipo": kind, "dados": data, "hash_anterior": previous}
        digest = hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        if tamper == seq:
            body["dados"] = {**data, "x": 1}
        lines.append(json.dumps({**body, "hash": digest}, ensure_ascii=False))
        previous = digest
    path.write_text("\n".join(lines) + "\n\n", encoding="utf-8")


def test_audit(spark, tmp_path):
    run = [
        ("2026-01-01T00:00:00", "mcp.chamada", {"ferramenta": "load_cluster", "v": 1.50}), ("2026-01-01T00:00:01", "mcp.chamada", {"ferramenta": "inject_fault"}),
        ("2026-01-01T00:00:02", "agente.inicio", {"evento": {"id": "E-0001", "texto": "ação"}}), ("2026-01-01T00:00:03", "mcp.chamada", {"ferramenta": "propose_plan", "resultado": {"id": "P-0001"}}),
        ("2026-01-01T00:00:04", "agente.fim", {"resposta": "ok", "proposta": "P-0001"}), ("2026-01-01T00:00:05", "mcp.chamada", {"ferramenta": "get_topology"}),
        ("2026-01-01T00:00:07", "hitl.aprovacao", {"proposta": {"id": "P-0001"}}),
    ]
    write_chain(tmp_path / "sessao.jsonl", run)
    write_chain(tmp_path / "hitl.jsonl", [("2026-01-01T00:00:06", "hitl.aprovacao", {"operador": "ana", "proposta": {"id": "P-0001"}}), ("2026-01-01T00:00:08", "hitl.passo", {"proposta_id": "P-0002"})])
    write_chain(tmp_path / "ruim.jsonl", run, tamper=3)
    (tmp_path / "quebrado.jsonl").write_text('{"seq": 1,\nnada\n')
    records = read_audit(spark, str(tmp_path))
    by_name = {r.file.rsplit("/", 1)[-1]: r for r in audit.verify_files(records).collect()}
    assert (by_name["sessao.jsonl"].integra, by_name["sessao.jsonl"].registros) == (True, 7)
    assert not by_name["ruim.jsonl"].integra and by_name["ruim.jsonl"].erro == "seq=3: hash não bate (registro alterado)"
    assert by_name["quebrado.jsonl"].erro == "linha 1 ilegível"
    good = records.where("problem is null and file not like '%ruim%'")
    rows = audit.event_timeline(good).orderBy("ts", "prioridade", "file", "seq").collect()
    assert [(r.entrada, r.ferramenta) for r in rows] == [
        ("ferramenta", "load_cluster"), ("ferramenta", "inject_fault"), ("evento", None), ("ferramenta", "propose_plan"), ("encerramento", None), ("aprovacao", None)
    ]
    assert rows[-1].operador == "ana" and rows[0].titulo == "Cluster carregado"
    assert audit.final_answers(audit.event_timeline(good)).collect()[0].resposta_final == "ok"
    listed = spark.createDataFrame([("vazio",)], "file string")
    assert audit.with_empty_files(audit.verify_files(records), listed).where("file = 'vazio'").collect()[0].registros == 0
    assert spark.range(1).select(event_ids(F.lit('{"a":["E-0001 E-0002","XE-0003"]}')).alias("x")).collect()[0].x == ["E-0001", "E-0002"]


def test_event_queue_and_streams(spark, tmp_path):
    queue = str(tmp_path / "queue")
    first = spark.createDataFrame([("falta", "2026-01-01T00:00:00", "{}"), ("chave", "2026-01-01T00:00:01", "{}")], "tipo string, hora string, detalhes string")
    rows = append_events(first, queue)
    assert sorted(r.id for r in rows.collect()) == ["E-0001", "E-0002"]
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "cp")
    jobs.run_to_end(jobs.consume_events(jobs.stream_files(spark, queue), sink, checkpoint))
    append_events(first.limit(1).withColumn("hora", F.lit("2026-01-02T00:00:00")), queue, rows)
    jobs.run_to_end(jobs.consume_events(jobs.stream_files(spark, queue), sink, checkpoint))
    everything = spark.read.parquet(sink)
    assert sorted(r.id for r in everything.collect()) == ["E-0001", "E-0002", "E-0003"]
    assert [r.id for r in events_since(everything, 2).collect()] == ["E-0003"]

    log = str(tmp_path / "log")
    schema = "file string, seq bigint, hash_anterior string, hash string"
    read = lambda: jobs.stream_files(spark, log, spark.createDataFrame([], schema).schema, "parquet")
    out, cp = str(tmp_path / "chain"), str(tmp_path / "chaincp")
    spark.createDataFrame([("f", 1, "0" * 64, "h1"), ("f", 2, "h1", "h2")], schema).write.mode("append").parquet(log)
    jobs.run_to_end(jobs.follow_chain(read(), out, cp))
    spark.createDataFrame([("f", 3, "h2", "h3"), ("f", 5, "h4", "h5"), ("g", 1, "x", "y"), ("f", 2, "h1", "h2b")], schema).write.mode("append").parquet(log)
    jobs.run_to_end(jobs.follow_chain(read(), out, cp))
    found = {(r.file, r.seq): r.motivo for r in jobs.chain_divergences(spark, out).collect()}
    assert found == {("f", 5): "sequência quebrada", ("g", 1): "hash_anterior não bate", ("f", 2): "sequência repetida"}
    # the missing record comes late, with a repeat of what was accepted and a forgery of what waited
    spark.createDataFrame([("f", 4, "h3", "h4"), ("f", 1, "0" * 64, "h1"), ("f", 5, "h4", "zz"), ("f", 6, "h5", "h6")], schema).write.mode("append").parquet(log)
    jobs.run_to_end(jobs.follow_chain(read(), out, cp))
    found = sorted((r.file, r.seq, r.motivo) for r in jobs.chain_divergences(spark, out).collect())
    assert found == [("f", 2, "sequência repetida"), ("f", 5, "sequência repetida"), ("g", 1, "hash_anterior não bate")]


def test_events_once(spark, tmp_path):
    """Repeats in a file, across files and after a restart."""
    schema = "id string, hora string, tipo string"
    queue, sink, cp = (str(tmp_path / x) for x in ("queue", "sink", "cp"))
    for rows in ([("E-1", "2", "a"), ("E-1", "2", "a"), ("E-2", "9", "b"), (None, "1", "x")], [("E-2", "9", "b"), ("E-0", "0", "late"), (None, "1", "x"), (None, "1", "y")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(queue)
        stream = jobs.stream_files(spark, queue, spark.createDataFrame([], schema).schema, files_per_batch=1)
        jobs.run_to_end(jobs.consume_events(stream, sink, cp))
    got = sorted((r.id or "", r.tipo) for r in spark.read.parquet(sink).collect())
    assert got == [("", "x"), ("", "y"), ("E-0", "late"), ("E-1", "a"), ("E-2", "b")]


def test_supply_follows_steps(spark, tmp_path):
    """After each batch the supply equals a full search; positions are made whole again on the way."""
    n = 12
    edges = [(f"e{i}", "trecho" if i % 2 else "chave", f"n{i:02d}", f"n{i + 1:02d}", False) for i in range(n)] + [("tie", "chave", "n03", "n09", True)]
    frame = materialise(spark.createDataFrame([(e, k, a, b, o, e if k == "chave" else None) for e, k, a, b, o in edges], "edge_id string, kind string, src string, dst string, open boolean, gate string"), "edges")
    sources = spark.createDataFrame([("A", "n00"), ("B", f"n{n:02d}")], "ctmt string, node string")
    queue, sink, cp = (str(tmp_path / x) for x in ("queue", "sink", "cp"))
    schema = "switch_id string, step long, action string"
    rng, step, position = random.Random(6), 0, {}
    gates = [e for e, k, *_ in edges if k == "chave"]
    spark.createDataFrame([("e6", 0, "abrir")], schema).coalesce(1).write.mode("append").parquet(queue)
    position["e6"] = (0, "abrir")
    for _ in range(2):
        rows = []
        for _ in range(rng.randint(1, 3)):
            step += 1
            old = rng.random() < 0.2  # a late step that a newer one has overtaken
            row = (rng.choice(gates), max(0, step - 30) if old else step, rng.choice(["abrir", "fechar"]))
            rows.append(row)
            if row[1] > position.get(row[0], (-1,))[0]:
                position[row[0]] = row[1:]
        rows = list(dict.fromkeys(rows))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(queue)
        stream = jobs.stream_files(spark, queue, spark.createDataFrame([], schema).schema, "parquet", files_per_batch=1)
        jobs.run_to_end(jobs.follow_supply(stream, frame, sources, sink, cp))
        positions, supply = jobs.supply_tables(spark, sink)
        assert {r.switch_id: (r.step, r.action) for r in positions.latest().collect()} == position
        steps = spark.createDataFrame([(k, s, a) for k, (s, a) in position.items()], "gate string, step long, action string")
        now = frame.join(steps, "gate", "left").withColumn("open", F.coalesce(F.col("action") == "abrir", "open"))
        want = {r.node: r.fed_by for r in energised(now, sources).collect()}
        assert {r.node: r.fed_by for r in supply.latest().collect() if r.fed_by} == want


def test_versions_are_made_whole(spark, tmp_path):
    """Every read equals the newest value per key, across whole versions, and old files go."""
    versions = jobs.Versions(spark, str(tmp_path / "v"), "k", "k string, n bigint")
    versions.start(spark.createDataFrame([("a", -1), ("b", -1)], "k string, n long"))
    want = {"a": -1, "b": -1}
    versions.WHOLE = 2
    for batch in range(7):
        key = "abc"[batch % 3]
        versions.write(batch, spark.createDataFrame([(key, batch)], "k string, n long"))
        want[key] = batch
        assert {r.k: r.n for r in versions.before(batch + 1).collect()} == want
    assert {r.k: r.n for r in versions.latest().collect()} == want
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["part=4", "part=5", "part=6", "whole=3", "whole=5"]



def test_run_files(spark, tmp_path):
    head = "tarefa,nivel,repeticao,acerto,provider,modelo,sequencia,referencia,tokens_prompt,tokens_total,tokens_informados,compactado\n"
    (tmp_path / "2026-01-01-a.csv").write_text(head + 't1,facil,1,1,a,gpt-4.1-mini-x,"[""a"",""b""]","[""b""]",100,200,1,1\nt2,,1,x,a,,[],[],0,0,0,1\n')
    (tmp_path / "2026-01-02-a.csv").write_text(head + 't1,facil,1,0,a,gpt-4.1-mini-x,"[""a""]","[""a""]",100,200,1,1\n')
    runs = read_runs(spark, str(tmp_path))
    assert runs.count() == 2
    newest = newest_per_label(runs).collect()
    assert [(r.arquivo, r.acerto, r.desnecessarias, r.exemplos) for r in newest] == [("2026-01-02-a.csv", False, 0, True)]
    cost = results.run_cost(runs).collect()[0].custo_usd
    assert abs(cost - (100 * 0.4 + 100 * 1.6) / 1e6) < 1e-15


def test_small_functions(spark):
    df = spark.createDataFrame([(" a ", "", 2.0, None)], "t string, b string, x double, n double")
    r = df.select(
        col.text_or_null(F.col("b")).alias("a"), col.text_or_empty(F.col("t")).alias("b"), col.code_text(F.col("x"), True).alias("c"), col.number(F.lit("x")).alias("d"),
        col.timestamp_day_first(F.lit("31/12/2024")).alias("e"), col.percent(F.lit(1), F.lit(0)).alias("f"), col.sum_of_present([F.col("n"), F.col("n")]).alias("g"),
        col.sum_of_present([F.col("n"), F.col("x")]).alias("h"), col.kilovolts(F.lit("46")).alias("i"), col.is_open(F.lit(" a")).alias("j"), col.is_remote(F.lit("1.0")).alias("k"),
        col.is_solar(F.lit("x"), F.lit("Radiação SOLAR")).alias("l"), col.phase_index(F.lit("bn")).alias("m"), col.segment_of_element(F.lit("line.smt_ab1")).alias("n"),
        col.feeder_of_bus(F.lit("rjo1_mt_4")).alias("o"), col.truncate_to(F.lit(1.23456789)).alias("p"), col.split_codes(F.lit(" a; ;b")).alias("q"), col.round_to(F.lit(2.5), 0).alias("r"),
    ).collect()[0]
    assert (r.a, r.b, r.c, r.d, str(r.e)[:10], r.f, r.g, r.h, r.i, r.j, r.k, r.l, r.m, r.n, r.o, r.p, r.q, r.r) == (
        None, "a", "2", None, "2024-12-31", 0.0, None, 2.0, 13.2, True, True, True, 2, "AB1", "RJO1", 1.234567, ["a", "b"], 2.0
    )
    assert col.round_record(df.select("x")).collect()[0].x == 2.0


def test_stream_parts_are_spread_over_files(spark, tmp_path):
    from gridlake.plans.logs import send_parts

    rows = spark.range(4000).withColumnRenamed("id", "event_id")
    files = send_parts([rows.where("event_id < 1000"), rows.where("event_id >= 1000")], str(tmp_path / "sent"))
    written = list((tmp_path / "sent").glob("*.parquet"))
    assert files > 1 and len(written) == 2 * files
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "sent")).collect()) == list(range(4000))
