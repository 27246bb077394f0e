"""CSV layouts, source sets, saved splits, run logs and sinks on handmade files."""

import os

import pytest
from pyspark.sql import functions as F

from corpusflow.sources import files as S
from corpusflow.sources import sinks as K


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    p = os.path.join(path, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_csv_quoting(spark, tmp_dir):
    p = _write(tmp_dir, "news.csv",
               'headline,body_text,source,label\n'
               '"He said ""hi""","a, b",outlet,Real\n'
               '"multi\nline","x",,Fake\n'
               'NA,None,n/a,Real\n'
               'plain,text,src,Fake\n')
    df = S.read_csv_source(spark, p)
    rows = df.orderBy("row_idx").collect()
    assert len(rows) == 4
    assert rows[0].headline == 'He said "hi"' and rows[0].body_text == "a, b"
    assert rows[1].headline == "multi\nline" and rows[1].source is None
    assert rows[2].headline is None and rows[2].body_text is None and rows[2].source is None
    assert [r.row_idx for r in rows] == [0, 1, 2, 3]


def test_semicolon_csv(spark, tmp_dir):
    p = _write(tmp_dir, "train.csv", "title;text;label\nA, with comma;body;1\nB;other;0\n")
    rows = S.read_csv_source(spark, p, sep=";").orderBy("row_idx").collect()
    assert [(r.title, r.label) for r in rows] == [("A, with comma", "1"), ("B", "0")]


def test_load_corpus_isolation(spark, tmp_dir):
    from corpusflow.functions.text import compose_text, map_label
    good = _write(tmp_dir, "good.csv", "headline,body_text,source,label\nh,b,s,Real\nh2,b2,,Fake\n")
    bad = _write(tmp_dir, "bad.csv", "text,label\nx,notanint\n")
    specs = [
        S.SourceSpec("good", lambda s: S.read_csv_source(s, good),
                     text=lambda d: compose_text("headline", "body_text"),
                     label=lambda d: map_label("label", {"Real": 0, "Fake": 1}),
                     domain=lambda d: F.coalesce("source", F.lit("unknown")), language="en"),
        S.SourceSpec("bad", lambda s: S.read_csv_source(s, bad), text=F.col("text"), label=F.col("label"),
                     domain="merged", language="en", strict_label=True),
        S.SourceSpec("absent", lambda s: S.read_csv_source(s, os.path.join(tmp_dir, "nope.csv")),
                     text=F.col("text"), label=0, domain="x", language="en", optional=True),
        S.SourceSpec("missing_col", lambda s: S.read_csv_source(s, good), text=F.col("text"), label=0,
                     domain="x", language="en", required_cols=["text"]),
    ]
    df, rep = S.load_corpus(spark, specs)
    status = {r.dataset: r.status for r in rep.collect()}
    assert status == {"good": "ok", "bad": "failed", "absent": "missing", "missing_col": "failed"}
    rows = df.orderBy("row_idx").collect()
    assert [(r.text, r.label, r.domain) for r in rows] == [("h b", 0, "s"), ("h2 b2", 1, "unknown")]
    with pytest.raises(ValueError):
        S.load_corpus(spark, specs[1:2])


def test_resolve_text(spark):
    df = spark.createDataFrame([("h", "c", "1")], "headline string, content string, label string")
    assert df.select(S.resolve_text(df, [("headline", "body_text"), "text", "headline"])).first()[0] == "h"
    df2 = spark.createDataFrame([("x", "1")], "News_Content string, label string")
    assert df2.select(S.resolve_text_column(df2, priority=("text",), contains=("content",))).first()[0] == "x"
    assert S.ensure_column(df2, "domain", "unknown").first().domain == "unknown"


def test_saved_splits(spark, tmp_dir):
    base = os.path.join(tmp_dir, "splits")
    made = S.load_or_make_splits(spark, base, lambda: spark.createDataFrame([("t", 1, "train")], "text string, label int, split string"))
    assert made.count() == 1
    for n in ("train", "val", "test"):
        _write(base, f"{n}.csv", "text,label\nsome text,1\n")
    got = S.load_or_make_splits(spark, base, lambda: None)
    assert sorted(r.split for r in got.collect()) == ["test", "train", "val"]
    assert {r.domain for r in got.collect()} == {"unknown"}


def test_run_logs(spark, tmp_dir):
    d = os.path.join(tmp_dir, "logs")
    _write(d, "model_a.log", "epoch 1\nFinal Accuracy: 0.8233 (82.33%)\nFinal Accuracy: 0.9 (90.00%)\n")
    _write(d, "model_b.log", "crashed\n")
    rows = S.parse_run_logs(spark, d).collect()
    assert [(r.model, round(r.accuracy, 4)) for r in rows] == [("model_a", 0.8233)]


def test_sinks_roundtrip(spark, tmp_dir):
    hist = spark.createDataFrame([("r", 2, 0.5, 0.6), ("r", 1, 0.7, 0.4)], "run_id string, epoch int, val_loss double, val_f1 double")
    K.write_history(hist, os.path.join(tmp_dir, "hist"))
    h = spark.read.json(os.path.join(tmp_dir, "hist")).first()
    assert h.epochs == [1, 2] and h.val_f1 == [0.4, 0.6]
    K.append_history(hist.limit(1), os.path.join(tmp_dir, "long"))
    K.append_history(hist.limit(1), os.path.join(tmp_dir, "long"))
    assert spark.read.parquet(os.path.join(tmp_dir, "long")).count() == 2
    m = spark.createDataFrame([(0.1, 0.8)], "loss double, accuracy double")
    rec = K.results_record(m, spark.createDataFrame([(0.7,)], "f double"))
    K.write_results(rec, os.path.join(tmp_dir, "res"))
    r = spark.read.json(os.path.join(tmp_dir, "res")).first()
    assert r.test_metrics.accuracy == 0.8 and r.best_val_f1 == 0.7
    splits = spark.createDataFrame([("a", "train"), ("b", "val")], "text string, split string")
    K.write_splits(splits, os.path.join(tmp_dir, "splits"))
    assert spark.read.parquet(os.path.join(tmp_dir, "splits")).where("split = 'val'").count() == 1


def test_pair_fails_as_one(spark, tmp_dir):
    good = _write(tmp_dir, "train.csv", "text,label\nfine,1\n")
    bad = _write(tmp_dir, "test.csv", "text,label\nbroken,x\n")
    other = _write(tmp_dir, "other.csv", "text,label\nkept,0\n")
    mk = lambda name, path, grp: S.SourceSpec(name, lambda s: S.read_csv_source(s, path), text=F.col("text"),
                                              label=F.col("label"), domain=name, language="en",
                                              strict_label=True, group=grp)
    df, rep = S.load_corpus(spark, [mk("train", good, "pair"), mk("test", bad, "pair"), mk("other", other, None)])
    assert {r.dataset: r.status for r in rep.collect()} == {"train": "failed", "test": "failed", "other": "ok"}
    assert [r.text for r in df.collect()] == ["kept"]


def test_pair_keeps_the_first_file(spark, tmp_dir):
    """A text in both files of a pair keeps the first file's label; order keys are unique."""
    from corpusflow.operators.curate import dedupe_first
    true = _write(tmp_dir, "true.csv", "text\nunique a\nshared\n")
    fake = _write(tmp_dir, "fake.csv", "text\nshared\nunique b\n")
    spec = S.SourceSpec("pair", lambda s: S.read_labelled_pair(s, {true: 0, fake: 1}, domain="d", language="en"),
                        text=F.col("text"), label=F.col("label"), domain=F.col("domain"), language=F.col("language"))
    df, _ = S.load_corpus(spark, [spec])
    assert df.select("dataset_rank", "row_idx").distinct().count() == 4
    for narrow in (False, True):
        got = {r.text: r.label for r in dedupe_first(df, narrow=narrow).collect()}
        assert got == {"unique a": 0, "shared": 0, "unique b": 1}


def test_folder_of_files_has_unique_rows_in_path_order(spark, tmp_dir):
    d = os.path.join(tmp_dir, "many")
    for k in range(3):
        _write(d, f"part-{k}.csv", "text\n" + "".join(f"f{k} r{i}\n" for i in range(4)))
    rows = S.read_csv_source(spark, d).orderBy("row_idx").collect()
    assert [r.text for r in rows] == [f"f{k} r{i}" for k in range(3) for i in range(4)]


def test_number_labels_and_report_counts(spark, tmp_dir):
    p = _write(tmp_dir, "nums.csv", "text,label\na,1.0\nb,0.0\nNA,1\n")
    mk = lambda strict: S.SourceSpec("nums", lambda s: S.read_csv_source(s, p), text=F.col("text"), label=F.col("label"),
                                     domain="d", language="en", strict_label=strict)
    for strict in (False, True):
        df, rep = S.load_corpus(spark, [mk(strict)])
        assert {r.text: r.label for r in df.collect()} == {"a": 1, "b": 0} and rep.first().n_rows == 2


def test_run_time_error_fails_one_source(spark, tmp_dir):
    from corpusflow.functions.text import normalise_label
    p = _write(tmp_dir, "bad.csv", "text,label\na,perhaps\n")
    q = _write(tmp_dir, "good.csv", "text,label\nb,real\n")
    mk = lambda n, f: S.SourceSpec(n, lambda s: S.read_csv_source(s, f), text=F.col("text"),
                                   label=lambda d: normalise_label("label"), domain="d", language="en")
    df, rep = S.load_corpus(spark, [mk("bad", p), mk("good", q)])
    assert [r.text for r in df.collect()] == ["b"] and {r.dataset: r.status for r in rep.collect()} == {"bad": "failed", "good": "ok"}


def test_saved_splits_of_write_splits_are_found(spark, tmp_dir):
    base = os.path.join(tmp_dir, "saved")
    K.write_splits(spark.createDataFrame([("a", "Fake", "train"), ("b", "0.0", "val"), ("c", "1", "test")], "text string, label string, split string"), base)
    got = {(r.text, r.label, r.split, r.domain) for r in S.load_or_make_splits(spark, base, lambda: None).collect()}
    assert got == {("a", 1, "train", "unknown"), ("b", 0, "val", "unknown"), ("c", 1, "test", "unknown")}


def test_report_examples_and_jsonl_sink(spark, tmp_dir):
    one = spark.createDataFrame([(1, 0.5)], "n int, acc double")
    ex = spark.createDataFrame([(1, "text", 1, 0.75)], "example int, text string, prediction int, confidence double")
    rows = {(r.section, r.key): r.value for r in K.run_report(one, {"a": 1}, one, ex).collect()}
    assert rows[("examples", "1.confidence")] == "0.750000" and rows[("examples", "1.text")] == "text"
    for _ in range(2):
        K.append_jsonl(ex, os.path.join(tmp_dir, "ex"))
    assert spark.read.json(os.path.join(tmp_dir, "ex")).count() == 2


def test_catalogue_of_sources(spark, tmp_dir):
    from corpusflow.sources.catalogue import corpus_specs
    _write(tmp_dir, "english_fake_news_2212.csv", "news_id,headline,body_text,source,label\n1,h,b,,Real\n2,h2,,bbc,Fake\n3,x,y,z,Maybe\n")
    _write(tmp_dir, "train (2).csv", "title;text;label\nt;u;1.0\n")
    _write(tmp_dir, "test (1).csv", "title;text;label\nt;u;zero\n")          # strict label: the pair fails as one
    for k in ("ka", "ta", "ma"):
        _write(tmp_dir, f"{k}_true.csv", f"text\n{k} shared\n{k} true\n")
        _write(tmp_dir, f"{k}_fake.csv", f"text\n{k} shared\n")
    _write(tmp_dir, "LabeledAuthentic-7K.csv", "headline,content,domain\na,b,\n")
    _write(tmp_dir, "LabeledFake-1K.csv", "headline,content\nc,d\n")
    df, report = S.load_corpus(spark, corpus_specs(tmp_dir))
    status = {r.dataset: (r.status, r.n_rows) for r in report.collect()}
    assert status == {"english_fake_news_2212": ("ok", 2), "train": ("failed", 0), "test": ("failed", 0), "ka": ("ok", 3),
                      "ta": ("ok", 3), "ma": ("ok", 3), "labeled": ("ok", 2), "authentic_48k": ("missing", 0)}
    rows = {(r.text, r.label, r.domain, r.language) for r in df.collect()}
    assert ("h b", 0, "unknown", "en") in rows and ("h2 nan", 1, "bbc", "en") in rows
    assert ("ka shared", 0, "kannada", "kn") in rows and ("ka shared", 1, "kannada", "kn") in rows
    assert ("a b", 0, "labeled_authentic", "en") in rows and ("c d", 1, "labeled_fake", "en") in rows


def _counted(spark, rows, seen):
    """A source that counts how often its rows are read."""
    def read(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    return lambda s: s.createDataFrame(rows, "text string, label string").mapInPandas(read, "text string, label string")


def _spec(name, reader, **more):
    return S.SourceSpec(name, reader, text=F.col("text"), label=F.col("label"), domain=name, language="en", **more)


def test_sources_are_read_once(spark):
    seen = [spark.sparkContext.accumulator(0) for _ in range(3)]
    specs = [_spec("one", _counted(spark, [("a", "1"), ("b", "0"), (None, "1"), ("c", None)], seen[0])),
             _spec("two", _counted(spark, [("d", "1.0"), ("e", "x")], seen[1])),
             _spec("strict", _counted(spark, [("f", "1"), ("g", "x")], seen[2]), strict_label=True)]
    df, rep = S.load_corpus(spark, specs)
    assert {(r.dataset, r.status, r.n_rows) for r in rep.collect()} == {("one", "ok", 2), ("two", "ok", 1), ("strict", "failed", 0)}
    assert sorted((r.dataset, r.dataset_rank, r.text, r.label) for r in df.collect()) == [("one", 0, "a", 1), ("one", 0, "b", 0), ("two", 1, "d", 1)]
    assert df.count() == 3 and [a.value for a in seen] == [4, 2, 2]          # load, report and two actions
    assert df.schema == S.CANONICAL_SCHEMA


def test_source_that_breaks_while_it_is_read(spark, tmp_dir):
    def broken(s):
        def read(batches):
            for _ in batches:
                raise RuntimeError("disk on fire")
            yield
        return s.createDataFrame([("a", "1")], "text string, label string").mapInPandas(read, "text string, label string")

    good = _spec("good", lambda s: s.createDataFrame([("a", "1")], "text string, label string"))
    empty = _spec("empty", lambda s: s.createDataFrame([], "text string, label string"))
    df, rep = S.load_corpus(spark, [good, _spec("broken", broken), empty])
    got = {r.dataset: (r.status, r.n_rows) for r in rep.collect()}
    assert got == {"good": ("ok", 1), "broken": ("failed", 0), "empty": ("ok", 0)} and df.count() == 1
    with pytest.raises(Exception, match="Python worker"):
        S.load_corpus(spark, [good, _spec("broken", broken)], on_error="raise")
    assert S.load_corpus(spark, [empty])[0].count() == 0
