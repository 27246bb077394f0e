"""The known source files of a corpus folder as ``SourceSpec`` objects, by flow.

``load_corpus(spark, corpus_specs(folder, "multilingual"))`` reads what a flow reads, in its
order. Canonical labels: 1 = fake. The two-language flow means 1 = true by it: apply
:func:`corpusflow.functions.text.flip_polarity` to its result for the reference's polarity.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.text import compose_text, detect_script, domain, map_label
from corpusflow.sources.files import SourceSpec, labelled_pair, read_csv_source, resolve_text, resolve_text_column

# File names, their label words and the languages of the paired files.
REAL_FAKE = {"Real": 0, "Fake": 1}
REAL_FAKE_LOWER = {"real": 0, "fake": 1}
PAIRS = {"ka": ("kannada", "kn"), "ta": ("tamil", "ta"), "ma": ("malayalam", "ml")}
FLOWS = {
    "three_sources": ("english_fake_news_2212", "fake_news_dataset", "dataset-merged"),
    "multilingual": ("english_fake_news_2212", "train", "test", "ka", "ta", "ma", "labeled", "authentic_48k"),
    "two_languages": ("ka", "english_fake_news_2212"),
    "evaluation": ("evaluation",),
}


def _csv(folder: str, name: str, sep: str = ","):
    return lambda spark: read_csv_source(spark, f"{folder}/{name}", sep=sep)


def _pair(folder: str, key: str):
    def read(spark):
        return labelled_pair([(read_csv_source(spark, f"{folder}/{key}_true.csv"), 0),
                              (read_csv_source(spark, f"{folder}/{key}_fake.csv"), 1)])
    name, code = PAIRS[key]
    return SourceSpec(key, read, text=F.col("text"), label=F.col("label"), domain=name, language=code, required_cols=["text"])


def _labeled(folder: str) -> SourceSpec:
    """Two files without a label column; a missing or null domain is named after the file."""
    def part(spark, name, default):
        df = read_csv_source(spark, f"{folder}/{name}")
        return df.withColumn("domain", domain("domain", default) if "domain" in df.columns else F.lit(default))

    def read(spark):
        return labelled_pair([(part(spark, "LabeledAuthentic-7K.csv", "labeled_authentic"), 0),
                              (part(spark, "LabeledFake-1K.csv", "labeled_fake"), 1)])
    return SourceSpec("labeled", read, text=compose_text("headline", "content"), label=F.col("label"),
                      domain=F.col("domain"), language="en", required_cols=["headline", "content"])


def _authentic_text(df):
    """``text``, else headline and content, else the first column named like a text."""
    if "text" in df.columns or {"headline", "content"} <= set(df.columns):
        return resolve_text(df, ["text", ("headline", "content")])
    if not any(w in c.lower() for c in df.columns for w in ("text", "content")):
        raise ValueError("no text column")
    return resolve_text_column(df, priority=(), contains=("text", "content"))


def _spec(folder: str, key: str) -> SourceSpec:
    titled = compose_text("title", "text")
    if key in PAIRS:
        return _pair(folder, key)
    if key == "labeled":
        return _labeled(folder)
    if key == "english_fake_news_2212":
        return SourceSpec(key, _csv(folder, "english_fake_news_2212.csv"), text=compose_text("headline", "body_text"),
                          label=map_label("label", REAL_FAKE), domain=domain("source"), language="en",
                          required_cols=["headline", "body_text", "source", "label"])
    if key == "fake_news_dataset":
        return SourceSpec(key, _csv(folder, "fake_news_dataset.csv"), text=titled, label=map_label("label", REAL_FAKE_LOWER),
                          domain=domain("source"), language="en", required_cols=["title", "text", "source", "label"])
    if key == "dataset-merged":
        return SourceSpec(key, _csv(folder, "dataset-merged.csv"), text=F.col("text"), label=F.col("label"), domain="merged",
                          language=detect_script("text"), required_cols=["text", "label"], strict_label=True)
    if key == "evaluation":
        return SourceSpec(key, _csv(folder, "evaluation.csv", ";"), text=titled, label=F.col("label"), domain="evaluation",
                          language="en", required_cols=["title", "text", "label"], strict_label=True)
    if key in ("train", "test"):
        name = {"train": "train (2).csv", "test": "test (1).csv"}[key]
        return SourceSpec(key, _csv(folder, name, ";"), text=titled, label=F.col("label"), domain=f"{key}_dataset", language="en",
                          required_cols=["title", "text", "label"], strict_label=True, group="train_test")
    if key == "authentic_48k":
        return SourceSpec(key, _csv(folder, "Authentic-48K.csv"), text=_authentic_text, label=0, domain="authentic_48k",
                          language="en", optional=True)
    raise ValueError(f"unknown source {key}")


def corpus_specs(folder: str, flow: str = "multilingual") -> list[SourceSpec]:
    """The sources of one of the ``FLOWS``, in reading order (the first one keeps a shared text)."""
    return [_spec(folder, key) for key in FLOWS[flow]]
