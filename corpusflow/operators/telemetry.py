"""Telemetry analytics, batch.

Operators take the *flat* telemetry table (see :func:`flatten`):
``host, seq, ts, mem_percent, mem_used_gb, mem_available_gb, cpu_percent, disk_percent,
disk_free_gb, swap_percent, swap_used_gb, has_process, process_status, process_error,
boot_time, vm_restarted, alerts``. Every per-host reduction is a grouped aggregate
(combined map-side), so a host holding a third of all samples is not one task; the
only per-host windows are top-k (Spark inserts a partial group limit before the shuffle)
and the bucketed running max of :func:`corpusflow.operators.positions.running_agg`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import py_fixed
from corpusflow.operators.positions import running_agg

# Default alert thresholds (percent) and the fixed swap threshold.
DEFAULT_THRESHOLDS = {"memory_percent": 90, "cpu_percent": 95, "disk_percent": 90}
SWAP_ALERT = 80


def flatten(entries: DataFrame) -> DataFrame:
    """Nested JSON entry -> flat series. Absent process -> ``has_process`` false."""
    m = "metrics"
    proc = F.col(f"{m}.process")
    return entries.select(
        F.coalesce(F.col("host"), F.lit("default")).alias("host"), "seq", "ts",
        F.col(f"{m}.memory.percent").alias("mem_percent"), F.col(f"{m}.memory.used_gb").alias("mem_used_gb"),
        F.col(f"{m}.memory.available_gb").alias("mem_available_gb"),
        F.col(f"{m}.cpu.percent").alias("cpu_percent"),
        F.col(f"{m}.disk.percent").alias("disk_percent"), F.col(f"{m}.disk.free_gb").alias("disk_free_gb"),
        F.col(f"{m}.memory.swap_percent").alias("swap_percent"),
        F.col(f"{m}.memory.swap_used_gb").alias("swap_used_gb"),
        proc.isNotNull().alias("has_process"),
        F.col(f"{m}.process.status").alias("process_status"),
        F.col(f"{m}.process.error").alias("process_error"),
        F.col("boot_time"),
        F.coalesce(F.col(f"{m}.vm_restarted"), F.lit(False)).alias("vm_restarted"),
        F.coalesce(F.col("alerts"), F.array().cast("array<string>")).alias("alerts"))


def _fmt_threshold(v) -> str:
    return str(v)  # printed as given: 90 -> "90", 90.0 -> "90.0"


def alert_messages(thresholds: dict | None = None, process_name: str = "run.py") -> Column:
    """Alert messages in rule order (all comparisons strict)."""
    t = dict(DEFAULT_THRESHOLDS, **(thresholds or {}))
    rules = [
        (F.col("mem_percent") > t["memory_percent"],
         F.concat(F.lit("HIGH MEMORY: "), py_fixed("mem_percent"), F.lit(f"% (threshold: {_fmt_threshold(t['memory_percent'])}%)"))),
        (F.col("cpu_percent") > t["cpu_percent"],
         F.concat(F.lit("HIGH CPU: "), py_fixed("cpu_percent"), F.lit(f"% (threshold: {_fmt_threshold(t['cpu_percent'])}%)"))),
        (F.col("disk_percent") > t["disk_percent"],
         F.concat(F.lit("HIGH DISK: "), py_fixed("disk_percent"), F.lit(f"% (threshold: {_fmt_threshold(t['disk_percent'])}%)"))),
        (F.col("swap_percent") > SWAP_ALERT,
         F.concat(F.lit("HIGH SWAP: "), py_fixed("swap_percent"), F.lit("% - System is using swap memory heavily!"))),
        (F.col("has_process") & (F.col("process_status") == "zombie"),
         F.lit("PROCESS ZOMBIE: Process is in zombie state!")),
        (~F.col("has_process") | (F.col("process_status") == "not_found"),
         F.lit(f"PROCESS NOT FOUND: {process_name} process is not running!")),
    ]
    arr = F.array(*[F.when(F.coalesce(cond, F.lit(False)), msg) for cond, msg in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def alerts(df: DataFrame, thresholds: dict | None = None, process_name: str = "run.py") -> DataFrame:
    """R8 as an operator: adds ``alerts``."""
    return df.withColumn("alerts", alert_messages(thresholds, process_name))


def detect_restarts(df: DataFrame, host: str = "host", order: str = "seq", boot: str = "boot_time") -> DataFrame:
    """A sample is a restart when its boot time exceeds every earlier boot time of
    the host (running max, not ``lag``). A host whose first boot time is null never
    reports a restart."""
    r = running_agg(df, boot, "_cf_prev_boot", [host], order, how="max", exclusive=True,
                    first_out="_cf_first_boot")
    flag = (F.col("_cf_first_boot").isNotNull() & F.col(boot).isNotNull()
            & F.col("_cf_prev_boot").isNotNull() & (F.col(boot) > F.col("_cf_prev_boot")))
    return r.withColumn("vm_restarted", F.coalesce(flag, F.lit(False))).drop("_cf_prev_boot", "_cf_first_boot")


def _peak(value: str, companions: list[str], name: str) -> list[Column]:
    best = F.max_by(F.struct(F.col(value).alias("v"), F.col("ts").alias("ts"), *[F.col(c) for c in companions]),
                    F.struct(F.col(value), -F.col("seq")))
    return [best.alias(name)]


_PEAK_AGGS = [("mem_percent", ["mem_used_gb", "mem_available_gb"], "m"), ("cpu_percent", [], "c"),
              ("disk_percent", ["disk_free_gb"], "d"), ("swap_percent", ["swap_used_gb"], "s")]
def _peak_cols():
    return [
    F.col("m.v").alias("peak_mem"), F.col("m.ts").alias("peak_mem_ts"),
    F.col("m.mem_used_gb").alias("peak_mem_used_gb"), F.col("m.mem_available_gb").alias("peak_mem_available_gb"),
    F.col("c.v").alias("peak_cpu"), F.col("c.ts").alias("peak_cpu_ts"),
    F.col("d.v").alias("peak_disk"), F.col("d.ts").alias("peak_disk_ts"), F.col("d.disk_free_gb").alias("peak_disk_free_gb"),
    F.col("s.v").alias("peak_swap"), F.col("s.ts").alias("peak_swap_ts"), F.col("s.swap_used_gb").alias("peak_swap_used_gb")]


def _peak_aggs():
    out = []
    for v, comps, name in _PEAK_AGGS:
        out += _peak(v, comps, name)
    return out


def peaks(df: DataFrame) -> DataFrame:
    """R2: peak memory / CPU / disk / swap per host with time and companion values;
    the first sample wins ties. One aggregate pass."""
    return df.groupBy("host").agg(*_peak_aggs()).select("host", *_peak_cols())


def averages(df: DataFrame) -> DataFrame:
    """Mean CPU (and sample count) per host."""
    return df.groupBy("host").agg(F.avg("cpu_percent").alias("avg_cpu"), F.count(F.lit(1)).alias("n_entries"))


def last_n(df: DataFrame, n: int = 10, order: str = "seq", by: str = "host") -> DataFrame:
    """X9 per host: the last ``n`` samples (group top-k; partial limit before the shuffle)."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return df.withColumn("_cf_rk", F.row_number().over(w)).where(F.col("_cf_rk") <= n).drop("_cf_rk")


def tail_mean(df: DataFrame, n: int = 10) -> DataFrame:
    """Mean memory of the last ``n`` samples (all when fewer)."""
    return last_n(df.select("host", "seq", "mem_percent"), n).groupBy("host").agg(
        F.avg("mem_percent").alias("tail_mem"), F.count(F.lit(1)).alias("tail_n"))


def missing_span(df: DataFrame) -> DataFrame:
    """Process missing = status ``not_found`` or an ``error`` key (an absent process
    object does not count here); count, first and last time."""
    miss = (F.col("process_status") == "not_found") | F.col("process_error").isNotNull()
    m = F.coalesce(miss, F.lit(False))
    return df.groupBy("host").agg(
        F.count_if(m).alias("n_missing"),
        F.min_by(F.when(m, F.col("ts")), F.when(m, F.col("seq"))).alias("first_missing"),
        F.max_by(F.when(m, F.col("ts")), F.when(m, F.col("seq"))).alias("last_missing"))


def restart_list(df: DataFrame) -> DataFrame:
    """Samples flagged as VM restart (absent / false flag = no)."""
    return df.where(F.coalesce(F.col("vm_restarted"), F.lit(False))).select("host", "seq", "ts")


def alert_timeline(df: DataFrame, n: int = 10) -> DataFrame:
    """Last ``n`` samples with at least one alert per host, one row per alert."""
    with_alerts = df.where(F.size("alerts") > 0).select("host", "seq", "ts", "alerts")
    return last_n(with_alerts, n).select("host", "seq", "ts", F.posexplode("alerts").alias("alert_idx", "alert"))


# Diagnosis texts (severity marker kept as a separate column).
CAUSES = {
    "restart": ("primary", "PRIMARY CAUSE: VM RESTART - The VM was restarted, which stopped run.py"),
    "oom": ("primary", "PRIMARY CAUSE: OUT OF MEMORY - High memory usage likely caused OOM killer to terminate run.py"),
    "swap": ("contributing", "CONTRIBUTING FACTOR: Heavy swap usage indicates memory pressure"),
    "disk": ("primary", "PRIMARY CAUSE: DISK FULL - No space left, process may have crashed"),
    "oom_likely": ("likely", "LIKELY CAUSE: Process killed by OOM killer due to memory exhaustion"),
    "stopped": ("warning", "Process stopped unexpectedly - check run.py logs for errors"),
    "clear1": ("ok", "No obvious issues detected in system metrics"),
    "clear2": ("ok", "Check run.py logs for application-level errors"),
}


def host_summary(df: DataFrame, n_tail: int = 10) -> DataFrame:
    """Peaks, missing span and restart count in one grouped aggregate, joined with the
    tail mean (group top-k) on host."""
    miss = F.coalesce((F.col("process_status") == "not_found") | F.col("process_error").isNotNull(), F.lit(False))
    agg = df.groupBy("host").agg(
        *_peak_aggs(),
        F.count_if(miss).alias("n_missing"),
        F.min_by(F.when(miss, F.col("ts")), F.when(miss, F.col("seq"))).alias("first_missing"),
        F.max_by(F.when(miss, F.col("ts")), F.when(miss, F.col("seq"))).alias("last_missing"),
        F.count_if(F.coalesce("vm_restarted", F.lit(False))).alias("n_restarts"))
    agg = agg.select("host", *_peak_cols(), "n_missing", "first_missing", "last_missing", "n_restarts")
    return agg.join(tail_mean(df, n_tail), "host")


def severity_flags(summary: DataFrame) -> DataFrame:
    """Swap peak > 10, tail memory > 85, disk peak > 90."""
    return summary.select("host", (F.col("peak_swap") > 10).alias("high_swap"),
                          (F.col("tail_mem") > 85).alias("memory_pressure"),
                          (F.col("peak_disk") > 90).alias("disk_critical"))


def diagnose(summary: DataFrame) -> DataFrame:
    """Ordered causes per host -> ``(host, rank, severity, cause)``."""
    def item(key):
        sev, txt = CAUSES[key]
        return F.struct(F.lit(sev).alias("severity"), F.lit(txt).alias("cause"))
    restarted = F.col("n_restarts") > 0
    missing = F.col("n_missing") > 0
    cands = [
        F.when(restarted, item("restart")),
        F.when((F.col("tail_mem") > 85) | (F.col("peak_mem") > 95), item("oom")),
        F.when(F.col("peak_swap") > 50, item("swap")),
        F.when(F.col("peak_disk") > 95, item("disk")),
        F.when(missing & ~restarted & (F.col("tail_mem") > 80), item("oom_likely")),
        F.when(missing & ~restarted & ~(F.col("tail_mem") > 80), item("stopped")),
    ]
    found = F.filter(F.array(*cands), lambda x: x.isNotNull())
    causes = F.when(F.size(found) > 0, found).otherwise(F.array(item("clear1"), item("clear2")))
    return (summary.select("host", F.posexplode(causes).alias("rank", "c"))
            .select("host", (F.col("rank") + 1).alias("rank"), "c.severity", "c.cause"))


def to_gb(col) -> Column:
    """Bytes -> GB (1024^3)."""
    return (F.col(col) if isinstance(col, str) else col) / F.lit(1024.0 ** 3)


def gpu_percent(used, total) -> Column:
    """Used / total * 100; a zero total gives null."""
    u = F.col(used) if isinstance(used, str) else used
    t = F.col(total) if isinstance(total, str) else total
    return F.try_divide(u.cast("double"), t.cast("double")) * 100


def uptime(df: DataFrame, host: str = "host") -> DataFrame:
    """Seconds since the first sample of the host (aggregate + join, no window)."""
    start = df.groupBy(host).agg(F.min("ts").alias("_cf_t0"))
    return (df.join(start, host)
            .withColumn("uptime_seconds", F.timestamp_diff("MICROSECOND", F.col("_cf_t0"), F.col("ts")) / 1e6)
            .drop("_cf_t0"))
