"""Append-only JSON-lines logs: audit records and events."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gridlake.functions.canonical import canonical_json, json_text
from gridlake.functions.ordered import rank_in_group

AUDIT_SCHEMA = StructType(
    [
        StructField("seq", LongType()), StructField("ts", StringType()), StructField("tipo", StringType()),
        StructField("dados", StringType()), StructField("hash_anterior", StringType()), StructField("hash", StringType()),
        StructField("_corrupt", StringType()),
    ]
)
EVENT_SCHEMA = StructType(
    [
        StructField(c, LongType() if c == "seed" else StringType())
        for c in ("id", "tipo", "cluster", "hora", "detalhes", "trecho", "ctmt", "chave", "cenario", "seed")
    ]
)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """One row per non-blank line: file, line, pos (rank among non-blank lines), the record fields,
    ``problem`` when the line is unreadable or lacks a field (S12).

    A text scan has no line numbers; they are the rank of (block of the file, order inside the
    block), computed by range so that one big file is not numbered in a single task.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    numbered = rank_in_group(lines, ["file"], ["_block", "_at"], "line").where(F.trim("value") != "")
    placed = rank_in_group(numbered.select("file", "line", "value"), ["file"], ["line"], "pos")
    parsed = placed.withColumn(
        "_r", F.from_json("value", AUDIT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    fields = [f for f in AUDIT_SCHEMA.fieldNames() if f != "_corrupt"]
    incomplete = F.lit(False)
    for f in fields:
        incomplete = incomplete | F.col(f"_r.{f}").isNull()
    problem = F.when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), F.concat(F.lit("linha "), F.col("line").cast("string"), F.lit(" ilegível"))).when(
        incomplete, F.concat(F.lit("registro malformado na linha "), F.col("line").cast("string"))
    )
    return parsed.select("file", "line", "pos", *[F.col(f"_r.{f}").alias(f) for f in fields], problem.alias("problem"))


def record_body(seq="seq", ts="ts", kind="tipo", data="dados") -> tuple[Column, Column]:
    """Canonical text of a record without its hash, before and behind the previous hash."""
    head = F.concat(F.lit('{"dados":'), canonical_json(F.col(data)), F.lit(',"hash_anterior":'))
    tail = F.concat(F.lit(',"seq":'), F.col(seq).cast("string"), F.lit(',"tipo":'), json_text(F.col(kind)), F.lit(',"ts":'), json_text(F.col(ts)), F.lit("}"))
    return head, tail


def record_hash(seq="seq", ts="ts", kind="tipo", data="dados", previous="hash_anterior") -> Column:
    """SHA-256 of the canonical record (F14), wholly in the JVM; null where ``data`` is no JSON."""
    head, tail = record_body(seq, ts, kind, data)
    return F.sha2(F.concat(head, json_text(F.col(previous)), tail), 256)


def chain_records(rows: DataFrame, genesis: str) -> DataFrame:
    """Rows (file, pos, ts, tipo, dados) as a written log: adds ``seq``, ``hash_anterior`` and ``hash`` (the append side of W8).

    Each hash needs the one before it, so a file is followed record by record; records stream past in order and only
    the last hash is held. Texts are canonical before they get there.
    """
    head, tail = record_body(seq="pos")
    texts = rows.select("file", "pos", head.alias("_head"), tail.alias("_tail"))
    ordered = texts.repartition(F.col("file")).sortWithinPartitions("file", "pos")

    def follow(batches):
        file, last = None, genesis
        for batch in batches:
            before, own = [], []
            for name, start, end in zip(batch["file"], batch["_head"], batch["_tail"], strict=True):
                if name != file:
                    file, last = name, genesis
                before.append(last)
                last = hashlib.sha256(f'{start}"{last}"{end}'.encode()).hexdigest()
                own.append(last)
            yield pd.DataFrame({"file": batch["file"], "pos": batch["pos"], "hash_anterior": before, "hash": own})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    hashed = ordered.mapInPandas(follow, f"file {kinds['file']}, pos {kinds['pos']}, hash_anterior string, hash string")
    return rows.withColumn("seq", F.col("pos").cast("long")).join(hashed, ["file", "pos"])


def event_ids(json_text):
    """Event ids ``E-`` and four or more digits anywhere in a nested record."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(json_text, F.lit("")), F.lit(r"\bE-\d{4,}\b"), F.lit(0)))


def event_number(event_id):
    """The number of an event id, all of its digits."""
    return F.regexp_extract(event_id, r"^E-(\d+)$", 1).try_cast("decimal(38,0)")


def proposal_ids(json_text):
    """Proposal ids ``P-`` and four or more digits anywhere in a nested record."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(json_text, F.lit("")), F.lit(r"\bP-\d{4,}\b"), F.lit(0)))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event queue as a batch table (S11); ``detalhes`` keeps its JSON text."""
    return spark.read.schema(EVENT_SCHEMA).json(path)


def append_events(events: DataFrame, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Append events with sequential ids ``E-0001`` ... after the highest existing one.

    ``events`` needs unique ``hora`` + ``tipo`` + ``detalhes``; the number is a range-split rank.
    Returns the numbered rows that were written.
    """
    from gridlake.functions.ordered import global_rank
    from gridlake.session import materialise

    start = 0
    if existing is not None:
        top = existing.agg(F.max(event_number("id"))).first()[0]
        start = int(top or 0)
    body = events.drop("id")
    ranked = global_rank(body, [c for c in ("hora", "tipo", "detalhes") if c in body.columns], "_n")
    number = (F.col("_n") + start).cast("string")
    # four digits at least; longer numbers keep all of theirs
    padded = F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0"))
    numbered = materialise(ranked.withColumn("id", F.concat(F.lit("E-"), padded)).drop("_n"), "events")
    numbered.write.mode("append").json(path)
    return numbered


def events_since(events: DataFrame, position: int) -> DataFrame:
    """Events after the first ``position`` ones, in id order."""
    return events.where(event_number("id") > position).orderBy(event_number("id"), "id")


def log_tail(records: DataFrame, n: int) -> DataFrame:
    """Last ``n`` records, newest first."""
    return records.orderBy(F.col("seq").desc()).limit(n)
