"""Language ID by Bayesian evidence fusion."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 14                  # buckets of hashed character n-grams
MAX_GRAMS = 300.0          # evidence of a text grows no further than that of so many n-grams
HOST, DOMAIN = 20.0, 50.0  # pseudo-counts by which a host leans on its domain, a domain on the whole
DECLARED, SUFFIX = 0.9, 0.8   # trust in a declared language and in an address suffix
MAX_LANGS = 4096           # more distinct languages than this are an error, not a cut

RAW = re.compile(rb"<(script|style|noscript)\b", re.I)
RAW_END = {t: re.compile(rb"</" + t + rb"\s*+>", re.I) for t in (b"script", b"style", b"noscript")}
HTML_TAG = re.compile(rb"<html\b", re.I)
LANG = re.compile(rb"\blang\s*+=\s*+[\"']?([A-Za-z]+)", re.I)
# fixed values: country codes of addresses and the languages written there
COUNTRIES = """at de; au en; be nl fr de; br pt; ca en fr; ch de fr it; cl es; co es; gb en; ie en; mx es; nz en; pe es; uk en; us en; ve es;
ar es; ao pt; mz pt; lu fr de; li de; cz cs; dk da; gr el; il he; jp ja; kr ko; cn zh; tw zh; hk zh; se sv; ua uk; in hi en; ee et; si sl; rs sr; ir fa; by be ru; kz kk ru"""


def buckets(text: bytes, bits: int = BITS) -> np.ndarray:
    """Hashed 1- to 3-byte grams of a lower-cased text, white space squeezed."""
    c = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    out = []
    for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        if len(c) >= n:
            g = c[:len(c) - n + 1].copy()
            for k in range(1, n):
                g |= c[k:len(c) - n + 1 + k] << np.uint32(8 * k)
            with np.errstate(over="ignore"):
                out.append((g * np.uint32(salt)) >> np.uint32(32 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def fit_languages(df: DataFrame, lang_col: str = "lang", text_col: str = "text", bits: int = BITS, max_langs: int = MAX_LANGS):
    """(languages, log-probabilities): a multinomial model of n-gram buckets from labelled texts.

    Counts cover every row with a language and text: each task sums its own buckets, the sums are
    added by grouped aggregation, and the result is one row of ``2**bits`` numbers per language. Every
    language of the column takes part; a column of more than ``max_langs`` values holds something
    else and raises ValueError. None if there is no labelled text.
    """
    common.bound_batches(df.sparkSession)
    rows = df.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t")).where("l is not null and t is not null")
    langs = sorted(r["l"] for r in rows.select("l").distinct().limit(max_langs + 1).collect())
    if not langs:
        return None
    if len(langs) > max_langs:
        raise ValueError(f"{lang_col} has more than {max_langs} distinct values")
    index = {x: i for i, x in enumerate(langs)}

    def count(batches):
        sums: dict[int, np.ndarray] = {}             # only languages that the task meets
        for b in batches:
            for x, t in zip(b.column(0).to_pylist(), common.texts(b.column(1)), strict=True):
                got = sums.setdefault(index[x], np.zeros(1 << bits, np.int64))
                got += np.bincount(buckets(t, bits), minlength=1 << bits)
        for i, n in sums.items():
            j = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i, np.int32)), pa.array(j, pa.int32()), pa.array(n[j])], names=["l", "g", "n"])

    table = np.zeros((len(langs), 1 << bits))
    for r in rows.mapInArrow(count, "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toLocalIterator():
        table[r["l"], r["g"]] = r["n"]
    table += 0.5
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _text(html: bytes) -> bytes:
    """What is not markup, scripts or styles, in linear time: a comment or tag that never ends is text, a script that never
    ends takes the rest."""
    out, at, pos = [], 0, 0
    last_comment, last_end = html.rfind(b"-->"), html.rfind(b">")
    while (pos := html.find(b"<", pos)) >= 0:
        if html.startswith(b"<!--", pos) and pos + 4 <= last_comment:
            end = html.find(b"-->", pos + 4) + 3
        elif m := RAW.match(html, pos):
            close = RAW_END[m.group(1).lower()].search(html, pos)
            end = close.end() if close else len(html)
        elif pos < last_end:
            end = html.find(b">", pos) + 1
        else:
            pos += 1
            continue
        out.append(html[at:pos])
        at = pos = end
    return b" ".join([*out, html[at:]])


def _declared(html: bytes) -> str:
    """The ``lang`` of the first html tag."""
    m = HTML_TAG.search(html)
    end = html.find(b">", m.end()) if m else -1
    m = LANG.search(html, m.end(), end) if end >= 0 else None
    return m.group(1).decode().lower() if m else ""


def _countries(langs: list[str]) -> dict[str, list[str]]:
    """Country code -> its languages among ``langs``; a code that COUNTRIES does not name speaks the language of its own name."""
    table = {x: [x] for x in langs}
    table.update({c[0]: [x for x in c[1:] if x in langs] for c in map(str.split, COUNTRIES.split(";"))})
    return {c: x for c, x in table.items() if x}


def language_id(pages: DataFrame, model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                bits: int = BITS) -> DataFrame:
    """(id, url, lang, probability, declared, suffix, host) for each page.

    The posterior is the product of the text's likelihood (tempered to ``MAX_GRAMS`` n-grams, as
    n-grams overlap), the declared ``lang`` attribute of the markup, the suffix of the address (its
    country code, by the languages of the country, or a path segment that names a language), and a
    host prior. Host priors are counts of what text, markup and address of the *other* pages say, by host, domain and
    in all, from grouped aggregation: a host leans on its domain by ``HOST`` pseudo-counts, a domain on
    all pages by ``DOMAIN``; a page's own vote is taken out of them. Priors join by host on narrow rows; a hot host is one
    row of the prior table.

    Null url, html or id: no evidence of that kind, the row stays; a page without a host gets the prior of
    all pages. Empty pages get the prior alone. Ties go to the language that sorts first. Repeated rows
    stay. Without a model (no labelled text) ``lang`` is null.
    """
    spark = pages.sparkSession
    common.bound_batches(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    slim = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), host.alias("h"), F.col(html_col).alias("t"))
    if model is None:
        return slim.select(F.col("i").alias(id_col), F.col("u").alias("url"), F.lit(None).cast("string").alias("lang"),
                           F.lit(None).cast("double").alias("probability"), F.lit("").alias("declared"), F.lit("").alias("suffix"), F.col("h").alias("host"))
    langs, logp = model
    held = spark.sparkContext.broadcast((langs, logp))
    path_lang = re.compile(r"^[^/]*//[^/]*\.([a-z]{2})(?=[/:?#]|$)|/([a-z]{2})(?=[/?#]|$)", re.I)

    def evidence():
        langs, logp = held.value
        spoken = _countries(langs)

        def lean(names, trust):
            names = [x for x in names if x in langs]
            if not names:
                return np.zeros(len(langs))
            v = np.full(len(langs), np.log((1 - trust) / max(1, len(langs) - len(names)) + 1e-9))
            v[[langs.index(x) for x in names]] = np.log(trust / len(names))
            return v

        def address(u):
            """What the address says: a country's languages, else a path segment."""
            for m in path_lang.finditer(u or ""):
                if m.group(1) and m.group(1).lower() in spoken:
                    return m.group(1).lower(), spoken[m.group(1).lower()]
                if m.group(2) and m.group(2).lower() in langs:
                    return m.group(2).lower(), [m.group(2).lower()]
            return "", []

        def step(b):
            dec, suf, ev = [], [], []
            cols = {n: b.column(b.schema.get_field_index(n)) for n in ("u", "t")}
            for u, t in zip(cols["u"].to_pylist(), common.texts(cols["t"]), strict=True):
                g = buckets(_text(t), bits)
                like = logp[:, g].sum(axis=1) * min(1.0, MAX_GRAMS / max(1, len(g))) if len(g) > 4 else np.zeros(len(langs))
                d = _declared(t)
                s, say = address(u)
                dec.append(d)
                suf.append(s)
                ev.append((like - like.max() + lean([d], DECLARED) + lean(say, SUFFIX)).tolist())
            return pa.array(dec, pa.string()), pa.array(suf, pa.string()), pa.array(ev, pa.list_(pa.float64()))
        return step

    rows = common.arrow_columns(slim, evidence, "dec string, suf string, ev array<double>", drop=("t",)).checkpoint()
    names = F.array(*map(F.lit, langs))

    def largest(c: str):
        return F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))

    best = largest("ev")
    domain = F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1)
    told = rows.select("h", domain.alias("d"), best.alias("l")).groupBy("h", "d", "l").agg(F.count("*").alias("n"))
    per_domain = told.groupBy("d", "l").agg(F.sum("n").alias("n"))
    total = {r["l"]: r["n"] for r in per_domain.groupBy("l").agg(F.sum("n").alias("n")).collect()}   # one number per language
    everything = sum(total.values()) + len(langs)

    def counts(df, key, name):
        return df.groupBy(*key).agg(F.sum("n").alias(f"{name}_all"), F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("by")).select(
            *key, f"{name}_all", F.array(*[F.coalesce(F.col("by")[x], F.lit(0)) for x in langs]).alias(name))

    def others(name, k, x):
        """The counts of the other pages of the same host or domain: this page's own vote is not evidence for itself."""
        return F.col(name)[k] - F.when(F.col("own") == x, 1).otherwise(0)

    plain = F.array(*[F.lit(float(np.log((total.get(x, 0) + 1) / everything))) for x in langs])
    prior = counts(told.where("h <> ''"), ["h", "d"], "hc").join(counts(per_domain, ["d"], "dc"), "d").drop("d")
    met = rows.withColumn("own", best).join(prior, "h", "left")
    domains = {k: (others("dc", k, x) + DOMAIN * (total.get(x, 0) + 1) / everything) / (F.col("dc_all") - 1 + DOMAIN) for k, x in enumerate(langs)}
    hosts = F.array(*[F.log((others("hc", k, x) + HOST * domains[k]) / (F.col("hc_all") - 1 + HOST)) for k, x in enumerate(langs)])
    met = met.withColumn("hp", F.when(F.col("hc").isNull(), plain).otherwise(hosts))
    post = met.withColumn("s", F.zip_with("ev", "hp", lambda a, b: a + b))
    top = F.array_max("s")
    return post.select(F.col("i").alias(id_col), F.col("u").alias("url"),
                       largest("s").alias("lang"),
                       (1 / F.aggregate(F.transform("s", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)).alias("probability"),
                       F.col("dec").alias("declared"), F.col("suf").alias("suffix"), F.col("h").alias("host"))
