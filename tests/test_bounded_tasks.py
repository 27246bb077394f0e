"""What one task reads or holds does not grow with the tables."""

import glob
import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusflow.plans import q_files as Q


def _events(spark, path, n):
    kinds = ("error", "click", "view", "signup", "other")
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=7 * k), k % 5, kinds[k * 7 % 5], float(k * 13 % 120)) for k in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")


def test_telemetry_lines_go_to_files_of_bounded_size(spark, tmp_dir, monkeypatch):
    _events(spark, tmp_dir, 120)
    monkeypatch.setattr(Q, "scratch_path", lambda s, name: f"{tmp_dir}/{name}")
    monkeypatch.setattr(Q, "_FILE_LINES", 50, raising=False)
    got = Q.q_jsonl_telemetry(spark, tmp_dir).collect()
    assert sorted(r["seq"] for r in got) == list(range(120))
    files = glob.glob(f"{tmp_dir}/jsonl/part-*")
    assert len(files) >= 8 and sum(len(open(f).read().split("\n")) - 1 for f in files) == 600
    hosts = {h: {f for f in files for x in open(f) if f'"host":"{h}"' in x and x.endswith("}\n") and json.loads(x)["host"] == h} for h in "01234"}
    assert all(len(v) >= 2 for v in hosts.values())


def test_long_telemetry_logs_are_compressed_and_their_lines_are_not_dealt(spark, tmp_dir, monkeypatch):
    import gzip

    _events(spark, tmp_dir, 300)
    # a sample that comes twice, and samples without time, kind or value
    odd = [(300, None, 1, "click", 99.0), (301, datetime(2024, 1, 2), 7, "view", None), (302, datetime(2024, 1, 2), 2, None, None)]
    spark.createDataFrame([*odd, odd[0]], spark.read.parquet(f"{tmp_dir}/events.parquet").schema).write.mode("append").parquet(f"{tmp_dir}/events.parquet")
    real, wrote = Q.K.append_jsonl, []

    def watched(lines, *args):
        wrote.append(lines._jdf.queryExecution().optimizedPlan().toString())
        return real(lines, *args)

    monkeypatch.setattr(Q.K, "append_jsonl", watched)
    got, texts = {}, {}
    for limit in (10_000, 1_000):
        monkeypatch.setattr(Q, "scratch_path", lambda s, name, limit=limit: f"{tmp_dir}/{limit}/{name}")
        monkeypatch.setattr(Q, "_PLAIN_LINES", limit, raising=False)
        df = Q.q_jsonl_telemetry(spark, tmp_dir)
        got[limit] = sorted(map(str, df.collect()))
        texts[limit] = spark.read.text(f"{tmp_dir}/{limit}/jsonl").count()
        assert "from_json" not in df._jdf.queryExecution().toString()          # lines are parsed once, before the restarts
    packed = glob.glob(f"{tmp_dir}/1000/jsonl/part-*")
    assert all(f.endswith(".gz") for f in packed) and not any(f.endswith(".gz") for f in glob.glob(f"{tmp_dir}/10000/jsonl/part-*"))
    assert len(packed) >= 2 and sum(len(gzip.open(f, "rt").read().split("\n")) - 1 for f in packed) == texts[1_000] == texts[10_000] == 5 * 304
    assert sum(os.path.getsize(f) for f in packed) * 5 < sum(os.path.getsize(f) for f in glob.glob(f"{tmp_dir}/10000/jsonl/part-*"))
    assert len(got[1_000]) == 304 and got[1_000] == got[10_000]
    for plan in wrote:                                                          # what is dealt are events, below the lines made of them
        assert plan.index("Generate explode") < plan.index("RepartitionByExpression") and "to_json" not in plan[plan.index("RepartitionByExpression"):]


def test_semicolon_files_are_written_and_read_by_many_tasks(spark, tmp_dir, monkeypatch):
    rows = [(k, None if k == 5 else f'text {k}; "quoted"\nnext\r\nline', "en") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(f"{tmp_dir}/documents.parquet")
    monkeypatch.setattr(Q, "scratch_path", lambda s, name: f"{tmp_dir}/{name}")
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))          # a task per file
    try:
        df = Q.q_csv_semicolon(spark, tmp_dir)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)
    assert len(glob.glob(f"{tmp_dir}/semicolon/part-*")) == 4
    assert "SortMergeJoin" not in df._jdf.queryExecution().toString()          # rows are not dealt by file
    want = spark.createDataFrame(rows, "doc_id long, text string, lang string").select(
        "doc_id", F.when(F.col("doc_id") % 11 != 0, F.sha2("text", 256)).alias("sha"))
    assert {r["doc_id"]: r["text_sha"] for r in df.collect()} == {r["doc_id"]: r["sha"] for r in want.collect()}


def test_workers_take_batches_in_small_slices(spark):
    import pyarrow as pa

    from corpusflow.functions.arrays import pieces
    b = pa.RecordBatch.from_pydict({"k": list(range(3000)), "t": ["x" * 3000] * 3000})
    got = list(pieces([b, b.slice(0, 0)]))
    assert max(x.num_rows for x in got) <= 512 and max(x.nbytes for x in got) <= 1 << 20
    assert [k for x in got for k in x.column("k").to_pylist()] == list(range(3000))


def test_encoding_works_on_slices_and_keeps_every_row(spark, tmp_dir):
    from corpusflow.operators import features as T
    from corpusflow.operators import subwords as S
    from corpusflow.plans.q_subwords import vocabulary
    df = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.concat_ws(" ", F.lit("word"), F.col("id") % 50, F.lit("end"))).alias("text"))
    path = vocabulary()
    back = S.decode_subwords(S.encode_subwords(df, path, max_length=None, drop_text=False), path)
    assert back.where("decoded <> coalesce(text, '')").count() == 0 and back.select("id").distinct().count() == 3000
    toks = df.select("id", T.tokens("text").alias("tokens"))
    enc = T.encode(toks, T.build_vocab(toks, 20), max_length=2).collect()
    assert len(enc) == 3000 and all((r["input_ids"] is None) == (r["id"] % 7 == 0) for r in enc)
    assert all(len(r["input_ids"]) == 2 for r in enc if r["id"] % 7)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


def test_self_training_moves_no_vectors_after_they_are_written(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    from corpusflow.operators import selftrain as ST
    from corpusflow.operators.gradient import GradientConfig
    rows = spark.range(0, 400, 1, 3).select("id", array_to_vector(F.array(F.when(F.col("id") % 2 == 0, 2.0).otherwise(-2.0), (F.col("id") % 5).cast("double"))).alias("features"),
                                            (F.col("id") % 2).cast("int").alias("label"))
    real, plans = ST.train_epochs, []

    def watched(spark_, data, *args, **kw):
        plans.extend(df._jdf.queryExecution().toString() for df in data.values())
        return real(spark_, data, *args, **kw)

    monkeypatch.setattr(ST, "train_epochs", watched)
    pool = rows.where("id >= 40").drop("label")
    # repeated ids count once, ids of the labelled rows are left out
    _, _, hist = ST.self_train(rows.where("id < 40"), pool.unionByName(pool.where("id < 60")).unionByName(rows.where("id < 9").drop("label")),
                                          rows, GradientConfig(2, lr=0.5), "id", rounds=3, threshold=0.6)
    assert len(plans) >= 8 and not any("Exchange" in p or "Join" in p for p in plans)
    assert 0 < hist.orderBy("round").first()["n_added"] <= 360


def test_a_telemetry_line_is_parsed_once(spark):
    from corpusflow.operators.telemetry import flatten
    from corpusflow.sources.files import parse_telemetry_lines
    lines = spark.createDataFrame([('{"host":"a","seq":1,"timestamp":"2024-01-01T00:00:00","boot_time":1.0}',), ("{} {}",), ("{}, {}",), ("",), (" ",), ("[1]",),
                                   ("{'host':'b'}",), ("{}",), ("null",), (None,)], "value string")
    df = flatten(parse_telemetry_lines(lines).withColumn("ts", F.to_timestamp_ntz("timestamp")))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [(r["host"], r["seq"]) for r in df.collect()] == [("a", 1), ("default", None)]


def test_a_host_costs_one_value_of_state(spark):
    from datetime import timezone

    import pandas as pd

    from corpusflow.streaming.telemetry_stream import RestartProcessor

    class Value:
        got, calls = None, 0

        def exists(self):
            self.calls += 1
            return self.got is not None

        def get(self):
            self.calls += 1
            return self.got

        def update(self, v):
            self.calls += 1
            self.got = v

    class Handle:
        value = Value()

        def getValueState(self, name, schema):
            return self.value

    p, handle = RestartProcessor(), Handle()
    p.init(handle)
    at = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1e6)
    first = pd.concat(p.handleInputRows(("a",), iter([pd.DataFrame({"seq": [5, 6, 8], "boot_time": [2.0, 3.0, 4.0], "ts": [at, float("nan"), at]})]), None))
    late = pd.concat(p.handleInputRows(("a",), iter([pd.DataFrame({"seq": [7], "boot_time": [4.0], "ts": [at]})]), None))
    assert first["vm_restarted"].tolist() == [False, True, True] and first["ts"].isna().tolist() == [False, True, False]
    assert late[["seq", "vm_restarted", "revision"]].values.tolist() == [[7, True, 1], [8, False, 1]]
    assert handle.value.calls == 4
