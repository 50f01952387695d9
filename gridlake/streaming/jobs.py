"""Incremental jobs over growing folders of events, switching steps and audit records.

Every job finishes what is there and stops (``availableNow``) or keeps running with a processing
interval. Results are written per micro-batch into a folder named after the batch id and replaced
when a batch is repeated, so a restart after a lost driver or executor changes nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridlake.functions.ordered import rank_in_group
from gridlake.operators.audit import GENESIS
from gridlake.operators.components import connected_components
from gridlake.operators.network import energised
from gridlake.session import app_scratch, delete_path, list_path, materialise, path_exists
from gridlake.sources.logs import EVENT_SCHEMA

BATCH = "_batch"



def _start(writer, trigger: str | None) -> StreamingQuery:
    if trigger is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=trigger).start()


def stream_files(spark: SparkSession, path: str, schema: StructType = EVENT_SCHEMA, fmt: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """File stream with an explicit schema; the checkpoint of the query is the read offset."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def _replace_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def consume_events(
    events: DataFrame, sink: str, checkpoint: str, *, key: str = "id", time: str | None = None, delay: str | None = None, trigger: str | None = None
) -> StreamingQuery:
    """Append every event once (ST1), however often it is sent again: in a batch, in another file or after a restart.

    The state holds the id of every event seen, and no watermark leaves a late event out. Where that state must be bounded,
    ``time`` and ``delay`` name an event time and how far repeats lie apart; an event later than that is then left out.
    Events without an id are told apart by their content.
    """
    rows = events.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\u0000"), F.sha2(F.to_json(F.struct(*events.columns)), 256))))
    if time is None:
        once = rows.dropDuplicates(["_key"])
    else:
        if delay is None:
            raise ValueError("give the delay of repeats with their time")
        once = rows.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_time")
    writer = once.drop("_key").writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return _start(writer, trigger)


def latest_states(steps: DataFrame, sink: str, checkpoint: str, *, key: str = "switch_id", order: str = "step", value: str = "action", trigger: str | None = None) -> StreamingQuery:
    """Latest value per key (ST2): a streaming aggregate whose changed rows are kept per batch.

    Partial aggregation runs before the shuffle, so a key with most of the steps costs one row per
    task; the state store holds one row per key.
    """
    current = steps.groupBy(key).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))
    writer = current.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, batch_id: _replace_batch(rows, sink, batch_id)
    )
    return _start(writer, trigger)


def read_states(spark: SparkSession, sink: str, *, key: str = "switch_id", order: str = "step", value: str = "action") -> DataFrame:
    """Current value per key from the change log of :func:`latest_states`."""
    log = spark.read.parquet(sink)
    return log.groupBy(key).agg(F.max_by(value, F.struct(order, BATCH)).alias(value), F.max(order).alias(order))


class Versions:
    """A keyed table that grows by one small version per batch and is made whole again every ``WHOLE`` batches.

    Reading before batch ``k`` takes the last whole version below it and the few versions since. What a repeated batch
    may still read is kept; older files are deleted.
    """

    WHOLE = 8

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema
        self.columns = [part.split()[0] for part in schema.split(", ")]

    def start(self, rows: DataFrame) -> None:
        """The whole table before the first batch; an existing one stays."""
        if not path_exists(self.spark, f"{self.path}/whole=-1"):
            rows.select(*self.columns).write.mode("overwrite").parquet(f"{self.path}/whole=-1")

    def before(self, batch_id: int) -> DataFrame:
        base = batch_id // self.WHOLE * self.WHOLE - 1
        read = self.spark.read.schema(self.schema)
        whole = [read.parquet(f"{self.path}/whole={base}")] if base >= 0 or path_exists(self.spark, f"{self.path}/whole=-1") else []
        parts = [df.withColumn("_v", F.lit(base)) for df in whole]
        parts += [read.parquet(f"{self.path}/part={k}").withColumn("_v", F.lit(k)) for k in range(base + 1, batch_id)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        if len(parts) == 1:
            return parts[0].drop("_v")
        rest = [c for c in self.columns if c != self.key]
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(self.key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*self.columns)

    def write(self, batch_id: int, changed: DataFrame) -> None:
        changed.select(*self.columns).write.mode("overwrite").parquet(f"{self.path}/part={batch_id}")
        if batch_id % self.WHOLE == self.WHOLE - 1:
            # all versions up to this one, read like the table before the next batch but from the parts
            rest = [c for c in self.columns if c != self.key]
            newest = self.spark.read.schema(self.schema).parquet(f"{self.path}/part={batch_id}")
            kept = self.before(batch_id).join(newest.select(self.key), self.key, "left_anti").select(*self.columns)
            kept.unionByName(newest.select(self.key, *rest).select(*self.columns)).write.mode("overwrite").parquet(f"{self.path}/whole={batch_id}")
            for old in range(batch_id - 2 * self.WHOLE + 1, batch_id - self.WHOLE + 1):
                delete_path(self.spark, f"{self.path}/part={old}")
            delete_path(self.spark, f"{self.path}/whole={batch_id - 2 * self.WHOLE}")

    def latest(self) -> DataFrame:
        """The table after the last batch that was written."""
        names = [n for n in list_path(self.spark, self.path) if n.startswith("part=")]
        return self.before(max((int(n[5:]) for n in names), default=-1) + 1)


def supply_tables(spark: SparkSession, sink: str) -> tuple[Versions, Versions]:
    """(switch positions, supply of nodes) of :func:`follow_supply`; ``latest()`` reads them."""
    return (
        Versions(spark, f"{sink}/positions", "switch_id", "switch_id string, step bigint, action string"),
        Versions(spark, f"{sink}/supply", "node", "node string, island string, fed_by string"),
    )


def follow_supply(steps: DataFrame, edges: DataFrame, sources: DataFrame, sink: str, checkpoint: str, *, trigger: str | None = None) -> StreamingQuery:
    """Switch positions and who feeds which node, kept up to date by a stream of steps (ST2).

    ``steps``: switch_id, step, action (``abrir`` / ``fechar``); the highest step of a switch wins, whenever it arrives.
    A batch recomputes only the islands (connected parts of the network) with an end of a switch that moved: what a
    closing switch joins are islands of its two ends, so no other node can change.
    """
    spark = steps.sparkSession
    positions, supply = supply_tables(spark, sink)

    def solved(part: DataFrame, nodes: DataFrame) -> DataFrame:
        closed = materialise(part.where(~F.col("open")), "closed")
        labels = connected_components(closed.select("src", "dst"), nodes)
        fed = energised(closed, sources.join(nodes, "node", "left_semi"), externals=True)
        return labels.withColumnRenamed("component", "island").join(fed, "node", "left")

    def moved_to(state: DataFrame) -> DataFrame:
        to = state.select(F.col("switch_id").alias("gate"), (F.col("action") == "abrir").alias("_to"))
        return edges.join(to, "gate", "left").withColumn("open", F.coalesce("_to", "open")).drop("_to")

    if not path_exists(spark, f"{supply.path}/whole=-1"):
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        supply.start(solved(edges, nodes))

    def step(batch: DataFrame, batch_id: int) -> None:
        before = positions.before(batch_id)
        newest = batch.groupBy("switch_id").agg(F.max("step").alias("step"), F.max_by("action", "step").alias("action"))
        known = before.select("switch_id", F.col("step").alias("_step"))
        changed = materialise(newest.join(known, "switch_id", "left").where(F.col("_step").isNull() | (F.col("step") > F.col("_step"))).drop("_step"), "steps")
        positions.write(batch_id, changed)
        to = changed.select(F.col("switch_id").alias("gate"), (F.col("action") == "abrir").alias("_to"))
        moved = moved_to(before).join(to, "gate").where(F.col("open") != F.col("_to"))
        ends = moved.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        table = supply.before(batch_id)
        islands = table.join(ends, "node", "left_semi").select("island").distinct()
        nodes = materialise(table.join(islands, "island", "left_semi").select("node"), "touched")
        if nodes.isEmpty():
            supply.write(batch_id, table.limit(0))
            return
        after = moved_to(before.join(changed.select("switch_id"), "switch_id", "left_anti").unionByName(changed))
        inside = after.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
        supply.write(batch_id, solved(inside, nodes))

    writer = steps.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return _start(writer, trigger)


_RECORD = "file string, seq bigint, hash_anterior string, hash string, arrival bigint"


def follow_chain(records: DataFrame, sink: str, checkpoint: str, *, genesis: str = GENESIS, trigger: str | None = None) -> StreamingQuery:
    """Check that each log's chain continues from its last record (ST3), whatever order records arrive in.

    ``records``: file, seq, hash_anterior, hash. A record beyond a gap waits until the gap is filled; the record that
    arrived first has its sequence number, of several in one batch one whose predecessor is known, then the least hash. Another record
    of that number is a divergence, an exact repeat is not. The tail and the waiting records of every file are small tables with a
    version per batch; predecessors are found by equi-joins on (file, seq), so a file is never replayed in one task.
    """
    spark = records.sparkSession
    tail_schema = "file string, seq bigint, hash string"

    def version(name: str, batch_id: int, schema: str) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{sink}/{name}/{BATCH}={batch_id}")

    def step(batch: DataFrame, batch_id: int) -> None:
        tails = version("tails", batch_id - 1, tail_schema)
        new = batch.select("file", "seq", "hash_anterior", "hash").distinct().withColumn("arrival", F.lit(batch_id).cast("long"))
        last = tails.select("file", F.col("seq").alias("_last"))
        rows = materialise(version("waiting", batch_id - 1, _RECORD).unionByName(new).join(last, "file", "left").withColumn("_last", F.coalesce("_last", F.lit(0).cast("long"))), "arrived")
        ahead = rows.where(F.col("seq") > F.col("_last"))
        links = ahead.select("file", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("hash_anterior")).unionByName(
            tails.select("file", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("hash_anterior"))).distinct().withColumn("_known", F.lit(0))
        sure = ahead.join(links, ["file", "seq", "hash_anterior"], "left").withColumn("_unsure", F.when(F.col("seq") == 1, (F.col("hash_anterior") != genesis).cast("int")).otherwise(F.coalesce("_known", F.lit(1))))
        place = F.struct("arrival", "_unsure", "hash", "hash_anterior")
        best = sure.groupBy("file", "seq").agg(F.min(place).alias("_b"), F.max("_last").alias("_last"))
        ranked = materialise(rank_in_group(best, ["file"], ["seq"], "_rank").select(
            "file", "seq", "_b.hash_anterior", "_b.hash", "_b.arrival", (F.col("seq") == F.col("_last") + F.col("_rank")).alias("_next")), "ranked")
        accepted = ranked.where("_next").select("file", "seq", "hash_anterior", "hash")
        before = accepted.select("file", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before")).unionByName(
            tails.select("file", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before")))
        expected = F.when(F.col("seq") == 1, F.lit(genesis)).otherwise(F.col("_before"))
        broken = accepted.join(before, ["file", "seq"], "left").where(~F.col("hash_anterior").eqNullSafe(expected)).select("file", "seq", F.lit("hash_anterior não bate").alias("motivo"))
        # records whose number is taken: by one of this batch, by one that waits, or by one accepted long ago
        taken = ahead.join(ranked.select("file", "seq", F.col("hash").alias("_own")), ["file", "seq"]).where(~F.col("hash").eqNullSafe(F.col("_own")))
        late = materialise(rows.where(F.col("seq") <= F.col("_last")), "late")
        if not late.isEmpty():
            history = spark.read.schema(f"{tail_schema}, {BATCH} bigint").parquet(f"{sink}/accepted").where(F.col(BATCH) < batch_id)
            taken = taken.select("file", "seq", "hash").unionByName(
                late.join(history.select("file", "seq", F.col("hash").alias("_own")), ["file", "seq"], "left").where(~F.col("hash").eqNullSafe(F.col("_own"))).select("file", "seq", "hash"))
        repeated = taken.select("file", "seq", F.lit("sequência repetida").alias("motivo"))
        _replace_batch(broken.unionByName(repeated), f"{sink}/divergences", batch_id)
        _replace_batch(accepted.select("file", "seq", "hash"), f"{sink}/accepted", batch_id)
        _replace_batch(ranked.where("not _next").select("file", "seq", "hash_anterior", "hash", "arrival"), f"{sink}/waiting", batch_id)
        furthest = accepted.select("file", "seq", "hash").unionByName(tails).groupBy("file").agg(F.max(F.struct("seq", "hash")).alias("_t")).select("file", "_t.seq", "_t.hash")
        _replace_batch(furthest, f"{sink}/tails", batch_id)
        for name in ("tails", "waiting"):
            # the version before this one stays for a repeat of this batch
            delete_path(spark, f"{sink}/{name}/{BATCH}={batch_id - 2}")

    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return _start(writer, trigger)


def chain_divergences(spark: SparkSession, sink: str) -> DataFrame:
    """file, seq, motivo of :func:`follow_chain` so far; a record that still waits behind a gap breaks the sequence."""
    found = spark.read.schema("file string, seq bigint, motivo string").parquet(f"{sink}/divergences")
    waiting = spark.read.schema(f"{_RECORD}, {BATCH} bigint").parquet(f"{sink}/waiting")
    newest = max((int(n.split("=")[1]) for n in list_path(spark, f"{sink}/waiting") if n.startswith(f"{BATCH}=")), default=-1)
    return found.select("file", "seq", "motivo").unionByName(waiting.where(F.col(BATCH) == newest).select("file", "seq", F.lit("sequência quebrada").alias("motivo")))


def run_to_end(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query and raise what stopped it."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def stream_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh (sink, checkpoint) folders in the shared scratch area."""
    root = f"{app_scratch(spark)}/stream-{name}-{uuid.uuid4().hex}"
    return f"{root}/sink", f"{root}/checkpoint"
