"""Telemetry as Structured Streaming queries (RS1-RS5).

Entries arrive as JSON-lines files from many hosts. Alerts are stateless (append);
restart detection keeps an ordered map of each host's boot time records
(``transformWithState``) and corrects itself when samples come late; the status table keeps the latest sample per host (update mode).
Sources, sinks and checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow.operators.telemetry import alert_messages, flatten
from corpusflow.sources.files import TELEMETRY_SCHEMA, parse_telemetry_lines


def read_telemetry_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """RS1: stream of flat telemetry samples from a folder of JSONL files."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = r.load(path)
    entries = parse_telemetry_lines(lines).withColumn("ts", F.to_timestamp_ntz("timestamp"))
    # entries without a sample counter are ordered by their time (one sample per tick)
    entries = entries.withColumn("seq", F.coalesce(F.col("seq"), F.unix_micros(F.col("ts").cast("timestamp_ltz"))))
    return flatten(entries)


def stream_alerts(df: DataFrame, thresholds: dict | None = None, process_name: str = "run.py") -> DataFrame:
    """RS2: live alerts, stateless; one output row per sample."""
    return df.withColumn("alerts", alert_messages(thresholds, process_name))


RESTART_OUT = "host string, seq long, ts long, boot_time double, vm_restarted boolean, revision long"


def judge(records: dict[int, tuple], first: tuple | None, seq: np.ndarray, boot: np.ndarray, ts: list):
    """New samples of a host, in any order, against its state -> (flags, records, first, corrections).

    ``records`` has the samples whose boot time exceeded all earlier ones (by ``seq``) so far: seq -> (boot, ts); it decides
    what any sample was preceded by. ``first`` is (smallest seq, whether its boot time is null). A sample is a
    restart if an earlier boot time exists and is lower than its own, unless the first one is null. A late sample may take
    a record's place: ``corrections`` are the earlier samples whose flag is another one now, as (seq, boot, ts, flag).
    """
    def flags_of(recs, head):
        order = sorted(recs)
        return {s: k > 0 and not head[1] for k, s in enumerate(order)} if head else {}

    was = flags_of(records, first)
    k = int(np.argmin(seq))
    if first is None or seq[k] < first[0]:
        first = (int(seq[k]), bool(np.isnan(boot[k])))
    merged = dict(records)
    for s, b, t in zip(seq.tolist(), boot.tolist(), ts, strict=True):
        if b == b and (s not in merged or b > merged[s][0]):
            merged[s] = (b, t)
    now, high = {}, None
    for s in sorted(merged):
        if high is None or merged[s][0] > high:
            now[s] = merged[s]
            high = merged[s][0]
    flags = flags_of(now, first)
    at = np.array(sorted(now), np.int64)
    tops = np.array([now[s][0] for s in at.tolist()])
    before = np.searchsorted(at, seq, side="left") - 1          # the last record of a smaller seq
    prev = np.where(before >= 0, tops[np.maximum(before, 0)], np.nan) if len(at) else np.full(len(seq), np.nan)
    own = (boot > prev) & (not first[1])                        # comparisons with NaN are false
    arrived = set(seq.tolist())
    changed = [(s, *records[s], flags.get(s, False)) for s in records if s not in arrived and was[s] != flags.get(s, False)]
    return own, now, first, changed


STATE = "first long, dead boolean, revision long, last_ms long, seqs array<long>, boots array<double>, times array<long>"


class RestartProcessor(StatefulProcessor):
    """Per host: its first sample, a count of calls (the revision of a row) and its records by seq, in one value: a host costs one
    read and one write of state per micro-batch, however many records it has."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("host", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.state.get()
        records = {s: (b, t) for s, b, t in zip(*was[4:], strict=True)} if was else {}
        first, revision, last = (was[0], was[1]) if was else None, was[2] + 1 if was else 0, was[3] if was else 0
        for pdf in rows:
            seq, boot = pdf["seq"].to_numpy(np.int64), pdf["boot_time"].to_numpy(np.float64)
            ts = [None if t != t else int(t) for t in pdf["ts"].tolist()]
            flags, records, first, changed = judge(records, first, seq, boot, ts)
            last = max([last, *(t // 1000 for t in ts if t)])
            yield pd.DataFrame({"host": key[0], "seq": seq, "ts": pd.array(ts, "Int64") if None in ts else ts, "boot_time": boot, "vm_restarted": flags, "revision": revision})
            if changed:
                yield pd.DataFrame({"host": key[0], "seq": [c[0] for c in changed], "ts": pd.array([c[2] for c in changed], "Int64"),
                                    "boot_time": [c[1] for c in changed], "vm_restarted": [c[3] for c in changed], "revision": revision})
            revision += 1
        self.state.update((*first, revision - 1, last, list(records), [v[0] for v in records.values()], [v[1] for v in records.values()]))
        if self.ttl_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(last + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_restarts(df: DataFrame, late: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """RS3: restart detection by event order, whatever the order of arrival (``transformWithState``; start it with
    :func:`run_to_parquet`, or with a RocksDB state store).

    State per host is its records - the samples whose boot time exceeded all before them, as many as it had restarts - and
    its first sample. A sample gets its flag as it arrives; a late one that changes what earlier rows said sends
    those rows again with a higher ``revision``. :func:`settled` keeps the last word on each sample, which is the flag of the
    batch operator on all samples so far. Samples of equal ``seq`` are one sample. A host's samples are taken a chunk
    at a time, so no group is held whole.

    By default no sample is dropped and no host forgotten. ``late`` (with ``ttl_ms``, both or neither) bounds the state
    instead: samples later than ``late`` behind the watermark are dropped, and an event-time timer takes a host silent for
    ``ttl_ms`` out of state.
    """
    if (late is None) != (ttl_ms is None):
        raise ValueError("late and ttl_ms go together")
    at = F.col("ts").cast("timestamp_ltz")                  # UTC session: same instant
    flat = df.select("host", "seq", F.unix_micros(at).alias("ts"), F.col("boot_time").cast("double").alias("boot_time"),
                     *([] if late is None else [at.alias("event_time")])).where("seq is not null")
    if late is not None:
        flat = flat.withWatermark("event_time", late)
    out = flat.groupBy("host").transformWithStateInPandas(RestartProcessor(ttl_ms), RESTART_OUT, "Append", "None" if ttl_ms is None else "EventTime")
    return out.withColumn("ts", F.timestamp_micros("ts").cast("timestamp_ntz"))


def settled(df: DataFrame) -> DataFrame:
    """The last word on each sample: its row of the highest revision."""
    rest = [c for c in df.columns if c not in ("host", "seq", "revision")]
    return df.groupBy("host", "seq").agg(F.max_by(F.struct(*rest), "revision").alias("r")).select("host", "seq", "r.*")


def stream_status(df: DataFrame) -> DataFrame:
    """RS5: latest sample per host (aggregate; run in update mode: a micro-batch gives the hosts it changed)."""
    cols = ["seq", "ts", "mem_percent", "cpu_percent", "disk_percent", "swap_percent", "process_status"]
    latest = F.max_by(F.struct(*[F.col(c) for c in cols], F.size(alert_messages()).alias("n_alerts")), F.col("seq"))
    return df.groupBy("host").agg(latest.alias("s")).select("host", "s.*")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _for_start(spark: SparkSession, conf: dict):
    """Settings that a query takes along when it starts; the session has its own back afterwards."""
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(w, conf: dict, spark: SparkSession) -> None:
    with _for_start(spark, conf):
        q = w.start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def run_to_parquet(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", state_partitions: int | None = None) -> None:
    """RS4/K3: run a stream with ``availableNow`` into a parquet folder (append). In update mode a micro-batch
    writes the rows it changed to a folder of its own (``batch=N``), so its cost is that of its changes, and readers never
    see a folder in the making; see :func:`read_latest`. State lies in RocksDB, dealt to
    ``state_partitions`` (fixed by the first run of a checkpoint; by default as many as shuffles have)."""
    spark = df.sparkSession
    conf = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    if state_partitions:
        conf["spark.sql.shuffle.partitions"] = str(state_partitions)
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        w = w.format("parquet").option("path", sink)
    else:
        w = w.foreachBatch(lambda batch, i: _commit(batch, sink, i, lambda b, to: b.write.parquet(to)))
    _run(w, conf, spark)


def run_to_jsonl(df: DataFrame, sink: str, checkpoint: str) -> None:
    """K3/RS4: append a stream's rows as JSON lines (a single string column: as it is), one folder per micro-batch.

    A micro-batch is written aside and then moved to ``batch=N``; one that runs again after a failure replaces its own
    folder, so for any reader of the folders a restarted stream neither loses nor repeats a line."""
    def write(batch, to):
        plain = len(batch.dtypes) == 1 and batch.dtypes[0][1] == "string"
        (batch.write.text if plain else batch.write.json)(to)

    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    _run(w.foreachBatch(lambda batch, i: _commit(batch, sink, i, write)), {}, df.sparkSession)


def _commit(batch: DataFrame, sink: str, i: int, write) -> None:
    """Write a micro-batch to a hidden folder, then put it in place of what an earlier try left."""
    sc = batch.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    aside, place = path(f"{sink}/_batch={i}"), path(f"{sink}/batch={i}")
    fs = aside.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.delete(aside, True)
    write(batch, f"{sink}/_batch={i}")
    fs.delete(place, True)
    if not fs.rename(aside, place):
        raise OSError(f"cannot move {aside.toString()} to {place.toString()}")


def read_latest(spark: SparkSession, sink: str, key: str = "host") -> DataFrame:
    """The table as of the last micro-batch that :func:`run_to_parquet` finished in update mode: the last row of each ``key``."""
    df = spark.read.parquet(sink)
    rest = [c for c in df.columns if c not in (key, "batch")]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


__all__ = ["read_telemetry_stream", "stream_alerts", "stream_restarts", "settled", "stream_status", "run_to_parquet", "run_to_jsonl", "read_latest",
           "TELEMETRY_SCHEMA"]
