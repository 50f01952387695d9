"""Canonical JSON of the JVM against Python's own writer."""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import functions as F

from gridlake.functions.canonical import canonical_json, json_text
from gridlake.operators.audit import GENESIS, verify_files
from gridlake.sources.logs import chain_records, record_hash


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def any_value(rng, depth=0):
    text = "".join(rng.choice('aé"\\\n\t\x01\x1f\x7f/ 漢😀:,{}[]0-1.5eEn ') for _ in range(rng.randint(0, 8)))
    kind = rng.randint(0, 7 if depth < 4 else 4)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -1, 10**25, -(10**12), 42])
    if kind == 2:
        return rng.choice([1.0, 1.5, -0.25, 1e300, 1e-7, 123456.789, 2.5e16])
    if kind < 5:
        return text
    if kind == 5:
        return [any_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f"{text}{i % 3}{rng.choice(['', 'Z', 'é', '_'])}": any_value(rng, depth + 1) for i in range(rng.randint(0, 5))}


def test_canonical_json(spark):
    rng = random.Random(8)
    values = [any_value(rng) for _ in range(600)]
    texts = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=rng.choice([None, 2]), separators=rng.choice([None, (" , ", " : ")])) for i, v in enumerate(values)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical_json(F.col("t")).alias("c"))
    got = {r.i: r.c for r in rows.collect()}
    for i, value in enumerate(values):
        assert got[i] == canonical(value), texts[i]
    odd = spark.createDataFrame([("{nada",), ('{"a":1,"a":2}',), (None,)], "t string").select(canonical_json(F.col("t")).alias("c"))
    assert [r.c for r in odd.collect()] == [None, None, None]


def test_json_text(spark):
    texts = ['a"b', "\\n", "\x1f\x0b\n", "é😀", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", json_text(F.col("t")).alias("c"))
    assert {r.i: r.c for r in rows.collect()} == {i: canonical(t) for i, t in enumerate(texts)}


def test_written_chain_is_whole(spark):
    rows = [(f"f{i % 3}", i // 3 + 1, f"t{i}", 'ti"po', json.dumps({"b": i * 1.5, "a": ["ação", i]})) for i in range(30)]
    log = chain_records(spark.createDataFrame(rows, "file string, pos long, ts string, tipo string, dados string"), GENESIS)
    found = sorted(log.where("file = 'f1'").collect(), key=lambda r: r.seq)
    last = GENESIS
    for r in found:
        body = {"seq": r.seq, "ts": r.ts, "tipo": r.tipo, "dados": json.loads(r.dados), "hash_anterior": last}
        assert r.hash_anterior == last
        last = hashlib.sha256(canonical(body).encode()).hexdigest()
        assert r.hash == last
    read = log.withColumns({"line": F.col("pos"), "problem": F.lit(None).cast("string")})
    assert all(r.integra and r.registros == 10 for r in verify_files(read).collect())
    no_json = read.withColumn("dados", F.when((F.col("file") == "f2") & (F.col("pos") == 4), "{").otherwise(F.col("dados")))
    assert {r.file: r.erro for r in verify_files(no_json).collect()}["f2"] == "seq=4: hash não bate (registro alterado)"
    assert log.select(record_hash().alias("h"), "hash").where("h <> hash").count() == 0
