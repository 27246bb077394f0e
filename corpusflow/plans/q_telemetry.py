"""Checked queries: telemetry batch analytics on the derived series."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import telemetry as R
from corpusflow.plans.fixtures import TELEMETRY_SQL, TSERIES_SQL, table, telemetry_series
from corpusflow.plans.registry import query, with_ctes

_T = with_ctes(TELEMETRY_SQL, TSERIES_SQL)


def _peak_sql(v, comps, name):
    out = [f"max({v}) AS peak_{name}", f"first(ts ORDER BY {v} DESC, seq) AS peak_{name}_ts"]
    for c, alias in comps:
        out.append(f"first({c} ORDER BY {v} DESC, seq) AS {alias}")
    return ", ".join(out)


_PEAKS_SQL = f"""
peaks AS (
  SELECT host, {_peak_sql('mem_percent', [('mem_used_gb', 'peak_mem_used_gb'), ('mem_available_gb', 'peak_mem_available_gb')], 'mem')},
         {_peak_sql('cpu_percent', [], 'cpu')},
         {_peak_sql('disk_percent', [('disk_free_gb', 'peak_disk_free_gb')], 'disk')},
         {_peak_sql('swap_percent', [('swap_used_gb', 'peak_swap_used_gb')], 'swap')}
  FROM tseries GROUP BY host
)"""
_TAIL_SQL = """
tailm AS (
  SELECT host, avg(mem_percent) AS tail_mem, count(*) AS tail_n FROM (
    SELECT host, mem_percent, row_number() OVER (PARTITION BY host ORDER BY seq DESC) AS rk FROM tseries) WHERE rk <= 10
  GROUP BY host
)"""
_MISS_SQL = """
miss AS (
  SELECT host, count(*) FILTER (WHERE m) AS n_missing,
         first(ts ORDER BY seq) FILTER (WHERE m) AS first_missing,
         first(ts ORDER BY seq DESC) FILTER (WHERE m) AS last_missing
  FROM (SELECT *, coalesce(process_status = 'not_found' OR process_error IS NOT NULL, false) AS m FROM tseries)
  GROUP BY host
)"""
_SUMMARY_SQL = """
summary AS (
  SELECT p.*, t.tail_mem, t.tail_n, m.n_missing, m.first_missing, m.last_missing, r.n_restarts
  FROM peaks p JOIN tailm t USING (host) JOIN miss m USING (host)
  JOIN (SELECT host, count(*) FILTER (WHERE vm_restarted) AS n_restarts FROM tseries GROUP BY host) r USING (host)
)"""


def series(spark, sf, restarts=False, alerts=False):
    return telemetry_series(spark, sf, restarts=restarts, alerts=alerts)


@query("telemetry_peaks", with_ctes(TELEMETRY_SQL, TSERIES_SQL, _PEAKS_SQL) + "SELECT * FROM peaks")
def q_telemetry_peaks(spark, sf):
    return R.peaks(series(spark, sf))


@query("telemetry_averages", _T + "SELECT host, avg(cpu_percent) AS avg_cpu, count(*) AS n_entries FROM tseries GROUP BY host")
def q_telemetry_averages(spark, sf):
    return R.averages(series(spark, sf))


@query("tail_mean", with_ctes(TELEMETRY_SQL, TSERIES_SQL, _TAIL_SQL) + "SELECT * FROM tailm")
def q_tail_mean(spark, sf):
    return R.tail_mean(series(spark, sf), 10)


@query("missing_span", with_ctes(TELEMETRY_SQL, TSERIES_SQL, _MISS_SQL) + "SELECT * FROM miss")
def q_missing_span(spark, sf):
    return R.missing_span(series(spark, sf))


@query("restart_list", _T + "SELECT host, seq, ts FROM tseries WHERE vm_restarted")
def q_restart_list(spark, sf):
    return R.restart_list(series(spark, sf, restarts=True))


@query("detect_restarts", _T + "SELECT seq, host, boot_time, vm_restarted FROM tseries")
def q_detect_restarts(spark, sf):
    return series(spark, sf, restarts=True).select("seq", "host", "boot_time", "vm_restarted")


@query("alert_rules", _T + """
SELECT seq, host, CAST(len(alerts) AS INTEGER) AS n_alerts, array_to_string(alerts, ' | ') AS alerts FROM tseries""")
def q_alert_rules(spark, sf):
    s = series(spark, sf, alerts=True)
    return s.select("seq", "host", F.size("alerts").alias("n_alerts"), F.array_join("alerts", " | ").alias("alerts"))


@query("alert_timeline", _T + """
SELECT host, seq, ts, CAST(i - 1 AS INTEGER) AS alert_idx, alerts[i] AS alert FROM (
  SELECT host, seq, ts, alerts, unnest(range(1, len(alerts) + 1)) AS i FROM (
    SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq DESC) AS rk FROM tseries WHERE len(alerts) > 0)
  WHERE rk <= 10)""")
def q_alert_timeline(spark, sf):
    return R.alert_timeline(series(spark, sf, alerts=True), 10)


_DIAG = with_ctes(TELEMETRY_SQL, TSERIES_SQL, _PEAKS_SQL, _TAIL_SQL, _MISS_SQL, _SUMMARY_SQL)


@query("severity_flags", _DIAG + """
SELECT host, peak_swap > 10 AS high_swap, tail_mem > 85 AS memory_pressure, peak_disk > 90 AS disk_critical FROM summary""")
def q_severity_flags(spark, sf):
    return R.severity_flags(R.host_summary(series(spark, sf, restarts=True)))


def _diag_sql():
    c = R.CAUSES
    def it(k):
        return f"{{'severity': '{c[k][0]}', 'cause': '{c[k][1]}'}}"
    return _DIAG + f"""
, cands AS (
  SELECT host, list_filter([
      CASE WHEN n_restarts > 0 THEN {it('restart')} END,
      CASE WHEN tail_mem > 85 OR peak_mem > 95 THEN {it('oom')} END,
      CASE WHEN peak_swap > 50 THEN {it('swap')} END,
      CASE WHEN peak_disk > 95 THEN {it('disk')} END,
      CASE WHEN n_missing > 0 AND NOT n_restarts > 0 AND tail_mem > 80 THEN {it('oom_likely')} END,
      CASE WHEN n_missing > 0 AND NOT n_restarts > 0 AND NOT tail_mem > 80 THEN {it('stopped')} END
    ], lambda x: x IS NOT NULL) AS f FROM summary),
c2 AS (SELECT host, CASE WHEN len(f) > 0 THEN f ELSE [{it('clear1')}, {it('clear2')}] END AS f FROM cands)
SELECT host, CAST(i AS INTEGER) AS rank, f[i].severity AS severity, f[i].cause AS cause
FROM (SELECT host, f, unnest(range(1, len(f) + 1)) AS i FROM c2)"""


@query("diagnosis", _diag_sql())
def q_diagnosis(spark, sf):
    return R.diagnose(R.host_summary(series(spark, sf, restarts=True)))


@query("unit_projection", """
SELECT event_id AS seq, CAST(round(value * 123456789) AS BIGINT) / (1024.0 * 1024.0 * 1024.0) AS used_gb,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id * 100 AS DOUBLE) / 16384.0 * 100 END AS gpu_percent
FROM events""")
def q_unit_projection(spark, sf):
    ev = table(spark, sf, "events")
    b = ev.select(F.col("event_id").alias("seq"), F.round(F.col("value") * 123456789).cast("long").alias("used_bytes"),
                  (F.col("user_id") * 100).cast("int").alias("used_mb"),
                  F.when(F.col("event_type") == "error", 0).otherwise(16384).alias("total_mb"))
    return b.select("seq", R.to_gb("used_bytes").alias("used_gb"), R.gpu_percent("used_mb", "total_mb").alias("gpu_percent"))


@query("uptime", _T + """
SELECT seq, host, date_diff('microsecond', min(ts) OVER (PARTITION BY host), ts) / 1000000.0 AS uptime_seconds FROM tseries""")
def q_uptime(spark, sf):
    return R.uptime(series(spark, sf).select("seq", "host", "ts")).select("seq", "host", "uptime_seconds")
