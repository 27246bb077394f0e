"""Checked queries: streaming telemetry. Each call writes the derived
entries as JSONL into a fresh folder under the shared checkpoint folder, runs the stream
with ``availableNow`` and returns the sink; the oracles are the batch twins' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.plans.fixtures import TELEMETRY_SQL, TSERIES_SQL, entries_from_series, telemetry_series
from corpusflow.plans.registry import query, with_ctes
from corpusflow.session import scratch_path
from corpusflow.streaming import telemetry_stream as RS

_T = with_ctes(TELEMETRY_SQL, TSERIES_SQL)


def _source(spark, sf, files: int = 8):
    """Files of consecutive samples, written by as many tasks in one job: they end, and so arrive, in any order."""
    src = scratch_path(spark, "telemetry-src")
    series = telemetry_series(spark, sf, restarts=False, alerts=False)
    entries_from_series(series.repartitionByRange(files, "seq").sortWithinPartitions("seq")).write.text(src)
    return src


def _run(spark, df, name, mode="append", state_partitions=None):
    sink, ckpt = scratch_path(spark, f"{name}-sink"), scratch_path(spark, f"{name}-ckpt")
    RS.run_to_parquet(df, sink, ckpt, mode, state_partitions)
    return spark.read.parquet(sink) if mode == "append" else RS.read_latest(spark, sink)


@query("stream_alerts", _T + """
SELECT seq, host, CAST(len(alerts) AS INTEGER) AS n_alerts, array_to_string(alerts, ' | ') AS alerts FROM tseries""")
def q_stream_alerts(spark, sf):
    stream = RS.read_telemetry_stream(spark, _source(spark, sf))
    out = _run(spark, RS.stream_alerts(stream).select("seq", "host", "alerts"), "alerts")
    return out.select("seq", F.col("host").cast("long").alias("host"), F.size("alerts").alias("n_alerts"),
                      F.array_join("alerts", " | ").alias("alerts"))


@query("stream_restarts", _T + "SELECT seq, host, CAST(boot_time AS DOUBLE) AS boot_time, vm_restarted FROM tseries")
def q_stream_restarts(spark, sf):
    """State is carried over micro-batches of files in any order; late files correct earlier flags."""
    stream = RS.read_telemetry_stream(spark, _source(spark, sf), max_files_per_trigger=3)
    out = RS.settled(_run(spark, RS.stream_restarts(stream), "restarts", state_partitions=spark.sparkContext.defaultParallelism))
    return out.select("seq", F.col("host").cast("long").alias("host"), "boot_time", "vm_restarted")


@query("stream_status", _T + """
SELECT host, seq, ts, mem_percent, cpu_percent, disk_percent, swap_percent, process_status, CAST(len(alerts) AS INTEGER) AS n_alerts
FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq DESC) AS rk FROM tseries) WHERE rk = 1""")
def q_stream_status(spark, sf):
    stream = RS.read_telemetry_stream(spark, _source(spark, sf))
    out = _run(spark, RS.stream_status(stream), "status", mode="update")
    return out.select(F.col("host").cast("long").alias("host"), "seq", "ts", "mem_percent", "cpu_percent",
                      "disk_percent", "swap_percent", "process_status", "n_alerts")


@query("stream_jsonl", _T + "SELECT seq, host, mem_percent, CAST(boot_time AS DOUBLE) AS boot_time FROM tseries")
def q_stream_jsonl(spark, sf):
    """K3, RS4: the entries a stream appends as JSON lines, read back by the file reader."""
    from corpusflow.operators.telemetry import flatten
    from corpusflow.sources.files import read_telemetry
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 3).load(_source(spark, sf))
    sink = scratch_path(spark, "jsonl-sink")
    RS.run_to_jsonl(lines.select("value"), sink, scratch_path(spark, "jsonl-ckpt"))
    return flatten(read_telemetry(spark, sink)).select("seq", F.col("host").cast("long").alias("host"), "mem_percent", "boot_time")
