"""Telemetry JSONL parsing, alerts, restarts, diagnosis and batch-stream equality."""

import json
import os

from pyspark.sql import functions as F

from corpusflow.operators import telemetry as R
from corpusflow.sources.files import count_malformed, read_telemetry
from corpusflow.streaming import telemetry_stream as RS


def entry(ts, mem=50.0, cpu=10.0, disk=20.0, swap=0.0, process="running", boot=5.0, error=None,
          vm=None, load_avg=(1.0, 1.0, 1.0)):
    metrics = {
        "memory": {"total_gb": 64.0, "available_gb": 30.0, "used_gb": 34.0, "percent": mem, "swap_total_gb": 8.0,
                   "swap_used_gb": 0.5, "swap_percent": swap},
        "cpu": {"percent": cpu, "count": 8, "per_core": [cpu] * 2, "load_avg": list(load_avg) if load_avg else None},
        "disk": {"total_gb": 500.0, "used_gb": 100.0, "free_gb": 400.0, "percent": disk},
    }
    if vm is not None:
        metrics["vm_restarted"] = vm
    if process is not None:
        metrics["process"] = {"pid": 1, "status": process}
        if error:
            metrics["process"]["error"] = error
    return json.dumps({"timestamp": f"2024-01-01T00:{ts:02d}:00", "uptime_seconds": ts * 60.0, "boot_time": boot,
                       "metrics": metrics, "alerts": []})


def write_lines(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "monitor_log.jsonl"), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_parse_drops_malformed(spark, tmp_dir):
    lines = [entry(0), "{bad", "", entry(1, process=None), entry(2, process="not_found", error="gone"),
             entry(3, load_avg=None)]
    write_lines(tmp_dir, lines)
    df = read_telemetry(spark, tmp_dir)
    assert df.count() == 4
    m = count_malformed(spark, tmp_dir).first()
    assert (m.malformed, m.blank) == (1, 1)
    flat = R.flatten(df)
    rows = {r.seq: r for r in flat.collect()}
    assert sum(1 for r in rows.values() if not r.has_process) == 1
    assert all(r.vm_restarted is False for r in rows.values())


def test_alert_rules_and_thresholds(spark, tmp_dir):
    lines = [entry(0, mem=90.0, cpu=95.0, disk=90.0, swap=80.0),            # exactly at thresholds: nothing
             entry(1, mem=90.05, cpu=96.25, disk=91.0, swap=80.5, process="zombie"),
             entry(2, process=None), entry(3, process="not_found")]
    write_lines(tmp_dir, lines)
    flat = R.flatten(read_telemetry(spark, tmp_dir))
    got = {r.seq: r.alerts for r in R.alerts(flat).collect()}
    s = sorted(got)
    assert got[s[0]] == []
    assert got[s[1]] == ["HIGH MEMORY: 90.0% (threshold: 90%)", "HIGH CPU: 96.2% (threshold: 95%)",
                         "HIGH DISK: 91.0% (threshold: 90%)",
                         "HIGH SWAP: 80.5% - System is using swap memory heavily!",
                         "PROCESS ZOMBIE: Process is in zombie state!"]
    assert got[s[2]] == ["PROCESS NOT FOUND: run.py process is not running!"]
    assert got[s[3]] == ["PROCESS NOT FOUND: run.py process is not running!"]
    cli = {r.seq: r.alerts for r in R.alerts(flat, {"memory_percent": 80.0}).collect()}
    assert cli[s[1]][0] == "HIGH MEMORY: 90.0% (threshold: 80.0%)"


def _flat(spark, rows):
    return spark.createDataFrame(
        [("h", i, f"2024-01-01 00:{i:02d}:00", m, b, st, err) for i, (m, b, st, err) in enumerate(rows)],
        "host string, seq long, t string, mem_percent double, boot_time double, process_status string, "
        "process_error string").select(
        "host", "seq", F.to_timestamp_ntz("t").alias("ts"), "mem_percent",
        F.col("mem_percent").alias("mem_used_gb"), F.col("mem_percent").alias("mem_available_gb"),
        (F.col("mem_percent") / 2).alias("cpu_percent"), F.lit(10.0).alias("disk_percent"),
        F.lit(1.0).alias("disk_free_gb"), F.lit(0.0).alias("swap_percent"), F.lit(0.0).alias("swap_used_gb"),
        F.lit(True).alias("has_process"), "process_status", "process_error", "boot_time")


def test_restarts_peaks_tail(spark):
    rows = [(50.0, 5.0, "running", None), (97.0, 4.0, "running", None), (97.0, 5.0, "not_found", None),
            (10.0, 6.0, "running", "x")]
    df = R.detect_restarts(_flat(spark, rows))
    flags = [r.vm_restarted for r in df.orderBy("seq").collect()]
    assert flags == [False, False, False, True]  # 5, 4, 5, 6: only the last
    p = R.peaks(df).first()
    assert p.peak_mem == 97.0 and p.peak_mem_ts.minute == 1  # first of the tie wins
    t = R.tail_mean(df, 10).first()
    assert t.tail_n == 4 and t.tail_mem == (50 + 97 + 97 + 10) / 4
    m = R.missing_span(df).first()
    assert m.n_missing == 2 and m.first_missing.minute == 2 and m.last_missing.minute == 3


def test_tail_window_sizes(spark):
    for n, expect in [(9, 9), (10, 10), (11, 10)]:
        df = _flat(spark, [(float(i), 1.0, "running", None) for i in range(n)])
        t = R.tail_mean(df, 10).first()
        assert t.tail_n == expect
        assert t.tail_mem == sum(range(n - expect, n)) / expect


def test_first_boot_null_never_restarts(spark):
    df = R.detect_restarts(_flat(spark, [(1.0, None, "running", None), (1.0, 5.0, "running", None),
                                         (1.0, 9.0, "running", None)]))
    assert not any(r.vm_restarted for r in df.collect())


def test_diagnosis_rules(spark):
    clear = R.diagnose(R.host_summary(R.detect_restarts(_flat(spark, [(10.0, 1.0, "running", None)] * 3))))
    assert [r.cause for r in clear.orderBy("rank").collect()] == [R.CAUSES["clear1"][1], R.CAUSES["clear2"][1]]
    oom = R.diagnose(R.host_summary(R.detect_restarts(_flat(spark, [(96.0, 1.0, "not_found", None)] * 3))))
    causes = [r.cause for r in oom.orderBy("rank").collect()]
    assert causes == [R.CAUSES["oom"][1], R.CAUSES["oom_likely"][1]]


def test_stream_equals_batch(spark, tmp_dir):
    from corpusflow.session import scratch_path
    lines = [entry(i, mem=80.0 + i, boot=b, process="not_found" if i == 3 else "running")
             for i, b in enumerate([5.0, 4.0, 5.0, 6.0, 6.0, 7.0])]
    lines = [json.dumps(dict(json.loads(x), host="h1", seq=i)) for i, x in enumerate(lines)]
    write_lines(tmp_dir, lines)
    stream = RS.read_telemetry_stream(spark, tmp_dir)
    sink, ck = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    RS.run_to_parquet(RS.stream_restarts(stream), sink, ck)
    s = {r.seq: r.vm_restarted for r in RS.settled(spark.read.parquet(sink)).collect()}
    b = {r.seq: r.vm_restarted for r in R.detect_restarts(R.flatten(read_telemetry(spark, tmp_dir))).collect()}
    assert s == b == {0: False, 1: False, 2: False, 3: True, 4: False, 5: True}
    sink2, ck2 = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    RS.run_to_parquet(RS.stream_alerts(stream).select("seq", "alerts"), sink2, ck2)
    sa = {r.seq: r.alerts for r in spark.read.parquet(sink2).collect()}
    ba = {r.seq: r.alerts for r in R.alerts(R.flatten(read_telemetry(spark, tmp_dir))).collect()}
    assert sa == ba


def test_empty_and_missing_log(spark, tmp_dir):
    import pytest as _pytest
    write_lines(tmp_dir, ["{bad", ""])
    df = R.detect_restarts(R.flatten(read_telemetry(spark, tmp_dir)))
    assert df.count() == 0 and R.diagnose(R.host_summary(df)).count() == 0
    from pyspark.errors import AnalysisException
    with _pytest.raises(AnalysisException):
        read_telemetry(spark, tmp_dir + "-absent").count()


def test_stream_state_across_micro_batches(spark, tmp_dir):
    """Files arrive in time order, one per micro-batch: the state carries the running max."""
    import time as _time
    from corpusflow.session import scratch_path
    boots = [5.0, 4.0, 5.0, 6.0, 6.0, 7.0, 3.0, 8.0]
    os.makedirs(tmp_dir, exist_ok=True)
    for part in range(4):
        with open(os.path.join(tmp_dir, f"part-{part}.jsonl"), "w") as f:
            for i in range(part * 2, part * 2 + 2):
                f.write(json.dumps(dict(json.loads(entry(i, boot=boots[i])), host="h1", seq=i)) + "\n")
        os.utime(os.path.join(tmp_dir, f"part-{part}.jsonl"), (1_700_000_000 + part, 1_700_000_000 + part))
        _time.sleep(0.01)
    stream = RS.read_telemetry_stream(spark, tmp_dir, max_files_per_trigger=1)
    sink, ck = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    RS.run_to_parquet(RS.stream_restarts(stream), sink, ck)
    s = {r.seq: r.vm_restarted for r in RS.settled(spark.read.parquet(sink)).collect()}
    b = {r.seq: r.vm_restarted for r in R.detect_restarts(R.flatten(read_telemetry(spark, tmp_dir))).collect()}
    assert s == b
    assert [k for k, v in sorted(s.items()) if v] == [3, 5, 7]


def test_strict_lines(spark, tmp_dir):
    good = entry(0)
    write_lines(tmp_dir, [good, good.replace('"', "'"), good + " junk", good + good, "[" + good + "]", good[:-1], "  " + good + "  "])
    assert read_telemetry(spark, tmp_dir).count() == 2
    m = count_malformed(spark, tmp_dir).first()
    assert (m.malformed, m.blank) == (5, 0)


def test_rotated_files_follow_each_other(spark, tmp_dir):
    """24 samples without a counter in two files: 24 order keys, and the tail is the last ten by time."""
    os.makedirs(tmp_dir, exist_ok=True)
    for name, ticks in (("z-old.jsonl", range(12)), ("a-new.jsonl", range(12, 24))):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write("\n".join(entry(i, mem=90.0 if i < 12 else 10.0) for i in ticks) + "\n")
    flat = R.flatten(read_telemetry(spark, tmp_dir))
    assert flat.select("host", "seq").distinct().count() == 24
    assert R.tail_mean(flat, 10).first().tail_mem == 10.0


def test_stream_forgets_nothing_by_default(spark, tmp_dir):
    """Gaps of weeks, two hosts, one file per micro-batch: no sample is dropped, no boot time forgotten."""
    from corpusflow.session import scratch_path
    os.makedirs(tmp_dir, exist_ok=True)
    days = [("2024-01-01", "a", 5.0), ("2024-01-25", "b", 1.0), ("2024-01-02", "b", 3.0), ("2024-02-20", "a", 6.0), ("2024-04-01", "a", 6.5)]
    for k, (day, host, boot) in enumerate(days):
        x = json.loads(entry(0, boot=boot))
        x.update(host=host, seq=k, timestamp=f"{day}T00:00:00")
        p = os.path.join(tmp_dir, f"p{k}.jsonl")
        with open(p, "w") as f:
            f.write(json.dumps(x) + "\n")
        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
    sink, ck = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    RS.run_to_parquet(RS.stream_restarts(RS.read_telemetry_stream(spark, tmp_dir, max_files_per_trigger=1)), sink, ck)
    s = {r.seq: r.vm_restarted for r in RS.settled(spark.read.parquet(sink)).collect()}
    b = {r.seq: r.vm_restarted for r in R.detect_restarts(R.flatten(read_telemetry(spark, tmp_dir))).collect()}
    assert s == b and len(s) == 5 and s[3] and s[4]


def _flags(spark, folder):
    return {(r.host, r.seq): r.vm_restarted for r in R.detect_restarts(R.flatten(read_telemetry(spark, folder))).collect()}


def test_files_in_any_order_equal_batch(spark, tmp_dir):
    """Random boot times of three hosts in files that arrive shuffled, one per micro-batch; a restart of the stream in between."""
    import random
    from corpusflow.session import scratch_path
    rng = random.Random(8)
    samples = [(h, i, rng.choice([None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])) for h in "abc" for i in range(36)]
    os.makedirs(tmp_dir, exist_ok=True)
    order = list(range(9))
    rng.shuffle(order)
    sink, ck = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    for n, part in enumerate(order):
        p = os.path.join(tmp_dir, f"p{part}.jsonl")
        with open(p, "w") as f:
            for h, i, b in samples:
                if i % 9 == part:
                    x = json.loads(entry(i, boot=b))
                    x.update(host=h, seq=i)
                    f.write(json.dumps(x) + "\n")
        os.utime(p, (1_700_000_000 + n, 1_700_000_000 + n))
        if n in (3, 8):          # the stream stops after four files and goes on from its checkpoint
            RS.run_to_parquet(RS.stream_restarts(RS.read_telemetry_stream(spark, tmp_dir, max_files_per_trigger=1)), sink, ck, state_partitions=3)
            out = spark.read.parquet(sink)
            assert {(r.host, r.seq): r.vm_restarted for r in RS.settled(out).collect()} == _flags(spark, tmp_dir)
    assert out.count() > len(samples) and out.where("revision > 0").count() > 0       # corrections were sent
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != RS.STATE_STORE


def test_judge_in_any_order():
    import random
    import numpy as np
    rng = random.Random(4)
    for _ in range(300):
        boots = [rng.choice([None, None, 1.0, 2.0, 3.0, 4.0]) for _ in range(rng.randint(1, 9))]
        high, want = None, []
        for b in boots:
            want.append(b is not None and high is not None and b > high and boots[0] is not None)
            high = b if high is None or (b is not None and b > high) else high
        order, got, records, first = list(range(len(boots))), {}, {}, None
        rng.shuffle(order)
        while order:
            n = rng.randint(1, 3)
            take, order = order[:n], order[n:]
            own, records, first, changed = RS.judge(records, first, np.array(take), np.array([np.nan if boots[k] is None else boots[k] for k in take]), [None] * len(take))
            got.update(zip(take, own.tolist(), strict=True))
            got.update({c[0]: c[3] for c in changed})
        assert [got[k] for k in range(len(boots))] == want


def test_silent_hosts_leave_bounded_state(spark, tmp_dir):
    from corpusflow.session import scratch_path
    os.makedirs(tmp_dir, exist_ok=True)
    days = [("2024-01-01", "a", 5.0), ("2024-01-20", "b", 1.0), ("2024-01-21", "b", 1.0), ("2024-02-20", "a", 6.0)]
    for k, (day, host, boot) in enumerate(days):
        x = json.loads(entry(0, boot=boot))
        x.update(host=host, seq=k, timestamp=f"{day}T00:00:00")
        p = os.path.join(tmp_dir, f"p{k}.jsonl")
        with open(p, "w") as f:
            f.write(json.dumps(x) + "\n")
        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
    sink, ck = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    RS.run_to_parquet(RS.stream_restarts(RS.read_telemetry_stream(spark, tmp_dir, max_files_per_trigger=1), "1 day", 86_400_000), sink, ck, state_partitions=2)
    s = {r.seq: r.vm_restarted for r in RS.settled(spark.read.parquet(sink)).collect()}
    assert s == {0: False, 1: False, 2: False, 3: False}       # host a was forgotten: its new boot time is its first


def test_entries_without_a_timestamp_are_kept(spark, tmp_dir):
    x = json.loads(entry(0))
    del x["timestamp"]
    write_lines(tmp_dir, [entry(1), json.dumps(x), "1", "null", "{}", "{bad"])
    rows = R.flatten(read_telemetry(spark, tmp_dir)).collect()
    assert len(rows) == 3 and sum(r.ts is None for r in rows) == 2
    m = count_malformed(spark, tmp_dir).first()
    assert (m.malformed, m.blank) == (3, 0)


def test_jsonl_sink_neither_loses_nor_repeats(spark, tmp_dir):
    """The last micro-batch runs again, as after a crash between its write and its commit."""
    from corpusflow.session import local_path, scratch_path
    src, sink, ck = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "sink"), local_path(scratch_path(spark, "ck"))
    os.makedirs(src)

    def put(k):
        p = os.path.join(src, f"p{k}.jsonl")
        with open(p, "w") as f:
            f.write("".join(f'{{"k": {10 * k + j}}}\n' for j in range(5)))
        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))

    def run():
        lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(src)
        RS.run_to_jsonl(lines.select("value"), sink, ck)
        return sorted(r.value for r in spark.read.text(sink).select("value").collect())

    for k in range(3):
        put(k)
    first = run()
    assert len(first) == 15 and len(set(first)) == 15
    for name in os.listdir(os.path.join(ck, "commits")):
        if name.strip(".").split(".")[0] == "2":
            os.remove(os.path.join(ck, "commits", name))
    with open(os.path.join(sink, "batch=2", "part-9.txt"), "w") as f:
        f.write("left over by the crash\n")
    put(3)
    again = run()
    assert len(again) == 20 and len(set(again)) == 20 and set(first) < set(again)
    js = os.path.join(tmp_dir, "js")
    RS.run_to_jsonl(spark.readStream.format("text").load(src).selectExpr("value", "length(value) AS n"), js, scratch_path(spark, "ck"))
    assert spark.read.json(js).count() == 20 and "n" in spark.read.json(js).columns


def test_status_writes_changes_only(spark, tmp_dir):
    from corpusflow.session import scratch_path
    os.makedirs(tmp_dir, exist_ok=True)
    for k, hosts in enumerate(("ab", "a", "c")):
        p = os.path.join(tmp_dir, f"p{k}.jsonl")
        with open(p, "w") as f:
            for h in hosts:
                f.write(json.dumps(dict(json.loads(entry(k, mem=50.0 + k)), host=h, seq=k)) + "\n")
        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
    sink = scratch_path(spark, "sink")
    RS.run_to_parquet(RS.stream_status(RS.read_telemetry_stream(spark, tmp_dir, max_files_per_trigger=1)), sink, scratch_path(spark, "ck"), "update")
    assert {r.batch: r["count"] for r in spark.read.parquet(sink).groupBy("batch").count().collect()} == {0: 2, 1: 1, 2: 1}
    assert {r.host: (r.seq, r.mem_percent) for r in RS.read_latest(spark, sink).collect()} == {"a": (1, 51.0), "b": (0, 50.0), "c": (2, 52.0)}
