"""Stages of a stream that keep their state in tables.

A stage runs every micro-batch as a batch job over three things: the new rows, the state that the batch before left, and the watermark.
Its work is therefore written with the library's batch operators, and a hot path is split over tasks in a micro-batch as it is in a batch:
no group, no sorted path and no Python object holds a path's rows.

Folder of a stage, one sub-folder a micro-batch (``b0000000000``, ...) in each of:

    out       the rows it emits; the next stage follows this folder
    late      rows that came behind the watermark, or behind what had been emitted
    rejects   rows that did not parse
    <state>   what the next micro-batch needs
    ledger    one row: rows read, good, late, rejected and emitted, and the latest event time so far

A sub-folder is written beside its place and renamed into it, the ledger's last.  A micro-batch that is tried again after a failure skips the
sub-folders that are in place, and since it sees the same rows and the same state it would write the same.  So every row is counted
once, and a reader sees a batch whole or not at all (on stores where renaming a folder is one step).

The watermark is the latest event time of all micro-batches so far less a delay, as in Spark.  A stage knows it before and after its batch:
rows are late by the one before, and what the one after has passed can be emitted at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT = 16
LEDGER = "batch long, rows_in long, good long, late long, rejected long, emitted long, max_us long, watermark_us long"


class State(NamedTuple):
    """A state table.  Without a key every batch writes all of it.  With one a batch writes the rows of the keys it saw, the newest row of a
    key counts, and every ``COMPACT``-th batch writes all keys."""
    schema: str
    key: tuple[str, ...] = ()


class Micro(NamedTuple):
    """What a step is given: new rows, states, and the watermark before and after them."""
    rows: DataFrame
    state: dict[str, DataFrame]
    before: int | None
    now: int | None


class Stage(NamedTuple):
    """``step`` turns a micro-batch into tables: ``out``, every state, and ``late`` if it has late rows.

    ``parse`` splits raw rows into good ones and rejects.  ``event`` is the event time of good rows in microseconds; the watermark is cut to
    multiples of ``grain_us``.
    """
    stream: DataFrame
    step: Callable[[Micro], dict[str, DataFrame]]
    out: str
    states: dict[str, State]
    event: Column | None = None
    delay_us: int = 0
    grain_us: int = 1
    parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None


class StreamTable(NamedTuple):
    """A Parquet folder that one query appends to and others read, as a batch or as a stream."""
    folder: str
    rows: DataFrame
    nested: bool = False

    def follow(self) -> DataFrame:
        """The table as a stream whose micro-batch is all that its producer has finished since the last.

        The files of one producer batch are dealt by path and each spans the batch's whole time range.  Cutting them by a file count
        would move the watermark to the end of that range after the first few and make the rest late, so there is no such cap:
        the producer's own batches bound the consumer's, and they come in the order of its watermark.
        """
        reader = self.rows.sparkSession.readStream.schema(self.rows.schema)
        return reader.option("recursiveFileLookup", self.nested).parquet(f"{self.folder}/out")

    def side(self, name: str, schema: str | None = None) -> DataFrame:
        """A table beside the emitted rows, such as ``ledger``, ``late`` or ``rejects``."""
        reader = self.rows.sparkSession.read
        return (reader.schema(schema) if schema else reader).option("recursiveFileLookup", True).parquet(f"{self.folder}/{name}")

    def ledger(self) -> DataFrame:
        """Per micro-batch how many rows were read, good, late, rejected and emitted."""
        return self.side("ledger", LEDGER)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def publish(df: DataFrame, folder: str, name: str) -> None:
    """Write ``df`` as sub-folder ``name``, in place all at once; nothing happens if it is there."""
    spark = df.sparkSession
    if exists(spark, f"{folder}/{name}"):
        return
    df.write.mode("overwrite").parquet(f"{folder}/_{name}")
    fs, source = _place(spark, f"{folder}/_{name}")
    if not fs.rename(source, _place(spark, f"{folder}/{name}")[1]):
        raise OSError(f"cannot move {folder}/_{name} into place")


def batch_name(i: int) -> str:
    return f"b{i:010d}"


def read_state(spark: SparkSession, folder: str, state: State, batch: int) -> DataFrame:
    """The state before micro-batch ``batch``."""
    if batch == 0:
        return spark.createDataFrame([], state.schema)
    if not state.key:
        return spark.read.schema(state.schema).parquet(f"{folder}/{batch_name(batch - 1)}")
    full = (batch - 1) // COMPACT * COMPACT
    names = [f"{folder}/{batch_name(i)}" for i in range(full, batch)]
    rows = spark.read.schema(state.schema).option("recursiveFileLookup", True).parquet(*names)
    if len(names) == 1:
        return rows
    newest = F.max_by(F.struct(*rows.columns), "_from")                       # sub-folders sort by batch
    return (rows.withColumn("_from", F.col("_metadata.file_path"))
            .groupBy(*[F.col(k).alias(f"_k_{k}") for k in state.key]).agg(newest.alias("r")).select("r.*"))


def write_state(df: DataFrame, prior: DataFrame, folder: str, state: State, batch: int) -> None:
    if state.key and batch % COMPACT == 0 and batch:
        rest = prior.join(df.select(*state.key), list(state.key), "left_anti").select(*df.columns)
        df = df.unionByName(rest)
    publish(df, folder, batch_name(batch))


def _process(stage: Stage, folder: str, batch: DataFrame, i: int) -> None:
    spark, name = batch.sparkSession, batch_name(i)
    if exists(spark, f"{folder}/ledger/{name}"):
        return
    spark.conf.set("spark.sql.adaptive.enabled", "true")                  # a stream's session has it off; these are batch jobs
    batch = batch.persist()
    try:
        good, rejects = stage.parse(batch) if stage.parse else (batch, None)
        prior = spark.read.schema(LEDGER).parquet(f"{folder}/ledger/{batch_name(i - 1)}").first() if i else None
        event = stage.event if stage.event is not None else F.lit(None).cast("long")
        n, top = good.agg(F.count(F.lit(1)), F.max(event)).first()
        seen = [t for t in (top, prior.max_us if prior else None) if t is not None]
        top = max(seen) if seen else None
        now = None if top is None else top // stage.grain_us * stage.grain_us - stage.delay_us
        before = prior.watermark_us if prior else None
        state = {s: read_state(spark, f"{folder}/{s}", kind, i) for s, kind in stage.states.items()}
        made = stage.step(Micro(good, state, before, now))
        tables = {"out": made["out"], "late": made.get("late"), "rejects": rejects}

        def write(part: str) -> int:
            """Rows of a table that are counted; states are not."""
            if part in stage.states:
                write_state(made[part], state[part], f"{folder}/{part}", stage.states[part], i)
            elif tables[part] is not None:
                publish(tables[part], f"{folder}/{part}", name)
                return spark.read.schema(tables[part].schema).parquet(f"{folder}/{part}/{name}").count()
            return 0
        with ThreadPoolExecutor(4) as pool:
            parts = [*tables, *stage.states]
            counts = dict(zip(parts, pool.map(write, parts)))
        row = (i, batch.count(), n - counts["late"], counts["late"], counts["rejects"], counts["out"], top, now)
        columns = [F.lit(v).cast("long").alias(f.split()[0]) for v, f in zip(row, LEDGER.split(", "))]
        publish(spark.range(1).coalesce(1).select(*columns), f"{folder}/ledger", name)
    finally:
        batch.unpersist()


def run_stage(stage: Stage, folder: str) -> StreamTable:
    """Process what is there, one micro-batch after the other."""
    query = (stage.stream.writeStream.foreachBatch(lambda batch, i: _process(stage, folder, batch, i))
             .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    spark = stage.stream.sparkSession
    if not exists(spark, f"{folder}/out"):                                # no batch at all
        publish(spark.createDataFrame([], stage.out), f"{folder}/out", "empty")
    rows = spark.read.schema(stage.out).option("recursiveFileLookup", True).parquet(f"{folder}/out")
    return StreamTable(folder, rows, nested=True)


def current(table: StreamTable, stage: Stage, name: str) -> DataFrame:
    """A state table of ``stage`` as the last micro-batch left it."""
    last = table.ledger().agg(F.max("batch")).first()[0] if exists(table.rows.sparkSession, f"{table.folder}/ledger") else None
    return read_state(table.rows.sparkSession, f"{table.folder}/{name}", stage.states[name], 0 if last is None else last + 1)


def delay_us(delay: str) -> int:
    """Microseconds of a delay such as "10 seconds"."""
    amount, unit = delay.split()
    units = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86_400 * 10**6}
    return int(float(amount) * units[unit.removesuffix("s")])


def fields(df: DataFrame, columns: Sequence[str]) -> str:
    """DDL of some columns."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)
