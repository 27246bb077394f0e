"""Broken pages in linear time, ids that stand more than once, caches bounded by bytes, and plain twins of packing and language ID."""

import gc
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from corpusflow.llm import common, html_crf, language, packing, simhash, token_counts, tree_bpe
from corpusflow.llm.queries import QUERIES, tokenizer

from . import brute

SF = "/root/testdata/sf0.001"
MB = 1 << 20
BROKEN = {
    "unterminated tag": "<p>hi</p><a " + '"x" ' * (MB // 4), "open tags": "<a" * (MB // 2), "open tags with names": "<a b " * (MB // 5),
    "comments": "<!--" * (MB // 4), "angles": "<" * MB, "sections": "<![CDATA[" * (MB // 9) + ">", "declarations": "<!x " * (MB // 4),
    "quoted ends": "<a '>' " * (MB // 7), "raw": "<svg>" * (MB // 5), "titles": "<title>" * (MB // 7), "scripts": "<script " * (MB // 8) + ">",
    "unknown ends": "<b>" * (MB // 6) + "</x>" * (MB // 8), "paragraphs": "<p><div>" + "<b>" * (MB // 6) + "<hr>" * (MB // 8),
    "items": "<ul>" + "<h1>" * (MB // 8) + "<li></li>" * (MB // 18), "hidden": "<svg>" + "<b>" * (MB // 3), "names": "<div " + 'class="' * (MB // 8) + ">x",
    "html": "<html " * (MB // 6), "lang": "<html lang" + " " * MB + ">", "references": "&" * MB,
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_broken_pages_take_linear_time(name):
    page = BROKEN[name]
    t = time.process_time()
    html_crf.leaf_blocks(page)
    language._text(page.encode())
    language._declared(page.encode())
    assert time.process_time() - t < 3          # a megabyte each; quadratic scans take minutes


def test_nested_blocks_keep_their_text():
    blocks = html_crf.leaf_blocks("<div class=x>t" * 3000)
    assert len(blocks) == 3000 and max(len(b.path) for b in blocks) == html_crf.DEPTH and {b.text for b in blocks} == {"t"}


def test_quotes_of_tags():
    def texts(page):
        return [b.text for b in html_crf.leaf_blocks(page)]
    assert texts("<p title='a>b'>x</p>") == ["x"] and texts('<p title="a>b" class=\'c>d\'>x') == ["x"]
    assert texts("<p title=it's>x</p><p>y") == ["x", "y"] and texts("<p>a < b</p>") == ["a < b"] and texts("<p>a<b") == ["a<b"]
    assert texts("<p>a<!-- <p> --> b<![CDATA[ <p>c ]]></p>d") == ["a b", "d"] and texts("<p>a<!-- b") == ["a"]
    assert texts("<br/><p/>a<img alt='/'>b") == ["a b"]


def test_text_of_a_page():
    assert language._text(b"a<b>c<!-- <x> -->d<script>e</SCRIPT >f<style>g").split() == [b"a", b"c", b"d", b"f"]
    assert language._text(b"a<!-- b> c") .split() == [b"a", b"c"] and language._text(b"a<b") == b"a<b"
    assert [language._declared(x) for x in (b"<HTML dir=x LANG = 'De-at'>", b"<p><html><html lang=fr>", b"<html lang=fr", b"")] == ["de", "", "", ""]


# --- near-dedup ----------------------------------------------------------------------------------------------------

def survivors(rows):
    """Kept (id, text), as often: the smallest (id, fingerprint) of each component, null ids last."""
    at = list(enumerate(rows))
    comp = {k: c for k, _, c in brute.components([(k, t) for k, (_, t) in at])}
    keep = []
    for c in set(comp.values()):
        best = min((i is None, i or 0, (fp if fp < 1 << 63 else fp - (1 << 64)), i) for k, (i, t) in at if comp[k] == c for fp in [brute.fingerprint(t)])
        keep.append(best[3])
    return sorted(keep, key=repr), comp


def test_no_unrelated_text_vanishes(spark):
    a, b, c = ("the first text of some length here", "a second text that is not alike at all", "third words of another kind altogether")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, "fourth other text with own words"), (7, c), (None, b), (None, "fifth text without an id"), (None, "fifth text without an id"), (8, None), (9, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.near_dedup(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")).collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (7, c), (7, "fourth other text with own words"), (None, "fifth text without an id"), (8, None)], key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_near_dedup_of_random_ids(spark, seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(200)) for _ in range(8)]
    rows = [(rng.choice([None, *range(12)]), rng.choice([t, t + " x", t.replace("a", "A")])) for t in base for _ in range(6)]
    want, _ = survivors(rows)
    out = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] for r in out), key=repr) == want
    assert len(brute.components([(k, r["text"]) for k, r in enumerate(out)])) == len({c for _, _, c in brute.components([(k, r["text"]) for k, r in enumerate(out)])})


# --- caches ---------------------------------------------------------------------------------------------------------

def test_tree_is_used_and_long_chunks_are_not_kept(spark):
    enc = tree_bpe.TreeEncoder(tokenizer("word_bpe_49k.json"))
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    enc.encode_decode(docs)
    assert enc.trees > 10                        # on the texts of the table itself
    rng = random.Random(0)
    long = ["".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(5000)) for _ in range(4)]
    before = len(enc.known)
    for t, ids in zip(long, enc.encode_decode(long)[0], strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == enc.tok.encode(t, add_special_tokens=False).ids
    assert len(enc.known) == before


def test_caches_end_at_their_bytes():
    enc = tree_bpe.TreeEncoder(tokenizer("word_bpe_49k.json"), cache=20_000)
    counter = token_counts.PieceCounter(tokenizer("piece_bpe_32k.model"), cache=20_000)
    for k in range(30):
        texts = [f"word{k * 100 + j} other{j}x{k} " + "q" * 300 for j in range(20)]
        for t, ids in zip(texts, enc.encode_decode(texts)[0], strict=True):
            assert np.frombuffer(ids, np.int32).tolist() == enc.tok.encode(t, add_special_tokens=False).ids
        assert counter.count(texts) == [len(counter.sp.encode(t)) for t in texts]
        assert enc.known_bytes < 60_000 and counter.size < 60_000 and max(map(len, counter.known)) <= token_counts.SHORT


def test_garbage_is_collected_again_after_a_task(spark):
    def state(batches):
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array([gc.isenabled()])], names=["on"])

    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string").coalesce(1)
    token_counts.token_counts(df, tokenizer("piece_bpe_32k.model")).collect()
    assert all(r["on"] for r in spark.range(0, 16, 1, 8).mapInArrow(state, "on boolean").collect())
    assert common.arrow_columns(df.limit(0), lambda: lambda b: [], "x int", no_gc=True).count() == 0


# --- packing --------------------------------------------------------------------------------------------------------

def replay(lengths, caps):
    """Best fit against all open bins in a plain list (of equal rooms the bin filled last); the least cost per token opens a bin.
    Lengths, number and sorted contents of the bins."""
    todo, bins = sorted(lengths, reverse=True), []
    while todo:
        x = todo.pop(0)
        fit = [b for b in bins if b[0] - sum(b[1]) >= x]
        if fit:
            best = min(fit, key=lambda b: (b[0] - sum(b[1]), -next(k for k, o in enumerate(bins) if o is b)))
            best[1].append(x)
            bins.append(bins.pop(next(k for k, b in enumerate(bins) if b is best)))
            continue

        def per_token(c):
            room = c - x
            for y in todo:
                if 0 < y <= room:
                    room -= y
            return (c + packing.OVERHEAD) / max(1, c - room)
        bins.append([min((c for c in caps if c >= x), key=lambda c: (per_token(c), c)), [x]])
    return Counter(min(c for c in caps if c >= sum(b)) for _, b in bins), len(bins), sorted(tuple(b) for _, b in bins)


@pytest.mark.parametrize("seed", range(12))
def test_packing_equals_a_replay(seed):
    rng = random.Random(seed)
    caps = rng.choice([(16, 32, 64), (64,), (10, 25, 60, 64)])
    lengths = [rng.choice([rng.randint(0, 64), rng.randint(1, 12), 16, 32, 48]) for _ in range(rng.choice([1, 40, 250]))]
    bins, _, cap = packing.pack(lengths, caps)
    held = {}
    for b, x in sorted(zip(bins, lengths, strict=True), key=lambda t: -t[1]):
        held.setdefault(b, []).append(x)
    want = replay(lengths, caps)
    assert (Counter(cap), len(cap)) == want[:2] and sorted(tuple(x) for x in held.values()) == want[2]


def test_packing_query_fills_its_bins(spark):
    rows = QUERIES["op3_packing"](spark, SF).collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Counter()
    bins = {}
    for r in rows:
        got[r["doc_id"]] += r["length"]
        bins.setdefault((r["bin_id"], r["capacity"]), []).append((r["bin_offset"], r["length"]))
    assert {i: got[i] for i in words} == words and len({b for b, _ in bins}) == len(bins)
    for (_, c), s in bins.items():
        s.sort()
        assert s[0][0] == 0 and all(a + x == b for (a, x), (b, _) in zip(s, s[1:], strict=False)) and s[-1][0] + s[-1][1] <= c
    fill, single = sum(got.values()) / sum(c for _, c in bins), packing.pack([r["length"] for r in rows], (max(packing.CAPACITIES),))[2]
    assert fill > 0.95 and fill >= sum(got.values()) / sum(single) - 1e-9


def test_packing_of_ties_nulls_and_long_texts(spark):
    rows = [(k, n) for k, n in enumerate([None, -5, 0, 0, 4096, 4097, 9000, 9000, 512, 512, 10 ** 6])]
    out = packing.best_fit_packing(spark.createDataFrame([(i, n, 1) for i, n in rows], "doc_id long, n long, shard int"), "n").collect()
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
        assert r["bin_offset"] + r["length"] <= r["capacity"] and r["start"] == r["piece"] * 4096
    assert {i: got[i] for i, _ in rows} == {i: max(0, n or 0) for i, n in rows}
    assert len(out) == sum(max(1, -(-max(0, n or 0) // 4096)) for _, n in rows)


# --- language ID ----------------------------------------------------------------------------------------------------

def bayes(pages, model):
    """Plain twin: {position: (lang, probability)} from the model's log probabilities."""
    langs, logp = model
    spoken = language._countries(langs)
    ev, own, hosts = [], [], []
    for _, url, html in pages:
        h = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", url or "")
        hosts.append(h.group(1).lower() if h else "")
        html = (html or "").encode()
        g = language.buckets(language._text(html))
        like = {x: sum(logp[k, j] for j in g) * min(1.0, language.MAX_GRAMS / max(1, len(g))) if len(g) > 4 else 0.0 for k, x in enumerate(langs)}
        e = {x: v - max(like.values()) for x, v in like.items()}
        d = language._declared(html)
        cc = re.search(r"\.([a-z]{2})$", hosts[-1])
        seg = [m.lower() for m in re.findall(r"/([A-Za-z]{2})(?=[/?#]|$)", url or "") if m.lower() in langs]
        say = spoken[cc.group(1)] if cc and cc.group(1) in spoken else seg[:1]
        for names, trust in (([d] if d in langs else [], language.DECLARED), (say, language.SUFFIX)):
            for x in langs if names else []:
                e[x] += np.log(trust / len(names)) if x in names else np.log((1 - trust) / max(1, len(langs) - len(names)) + 1e-9)
        ev.append(e)
        own.append(max(langs, key=lambda x: (e[x], -langs.index(x))))
    total, n_all = Counter(own), len(own) + len(langs)
    domains = [re.search(r"([^.]+\.[^.]+)$", h).group(1) if re.search(r"([^.]+\.[^.]+)$", h) else "" for h in hosts]
    out = []
    for k, e in enumerate(ev):
        prior = {x: (total[x] + 1) / n_all for x in langs}
        if hosts[k]:
            dom = [own[j] for j in range(len(own)) if j != k and domains[j] == domains[k]]
            host = [own[j] for j in range(len(own)) if j != k and hosts[j] == hosts[k]]
            dp = {x: (dom.count(x) + language.DOMAIN * prior[x]) / (len(dom) + language.DOMAIN) for x in langs}
            prior = {x: (host.count(x) + language.HOST * dp[x]) / (len(host) + language.HOST) for x in langs}
        s = {x: e[x] + np.log(prior[x]) for x in langs}
        top = max(langs, key=lambda x: (s[x], -langs.index(x)))
        out.append((top, 1 / sum(np.exp(s[x] - s[top]) for x in langs)))
    return out


def test_language_equals_plain_bayes_where_evidence_disagrees(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    model = language.fit_languages(docs)
    text = {r["lang"]: r["text"][:400] for r in docs.where("length(text) > 400").collect()}
    rng = random.Random(4)
    pages = []
    for k in range(120):
        body, said = rng.choice(sorted(text)), rng.choice(["", *sorted(text), "xx"])
        cut = rng.choice([0, 12, 60, 400])
        url = rng.choice([None, "", "not a url", f"https://{rng.choice('abc')}.example.{rng.choice(['com', 'at', 'mx', 'uk', 'fr', 'zz'])}{rng.choice(['', '/', '/de/x', '/en?q', '/xy/fr/'])}"])
        pages.append((k, url, rng.choice([None, "", f"<html lang={said}><p>{text[body][:cut]}</p>", f"{text[body][:cut]}<!-- open"])))
    pages += [pages[3], (None, "http://a.example.com", "<html lang=de>")]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, host string").repartition(3)
    got = sorted(((r["page_id"], r["url"] or "", r["lang"], round(r["probability"], 9)) for r in language.language_id(df, model).collect()), key=repr)
    want = sorted(((i, u or "", x, round(p, 9)) for (i, u, _), (x, p) in zip(pages, bayes(pages, model), strict=True)), key=repr)
    assert got == want


def test_pages_without_a_host_are_not_one_host(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    model = language.fit_languages(docs)
    text = {r["lang"]: r["text"] for r in docs.where("length(text) > 400").collect()}
    rows = [(k, None, text["de"]) for k in range(60)] + [(100 + k, f"http://h{k}.example.org/", text["en"]) for k in range(200)] + [(99, None, None)]
    got = {r["page_id"]: r for r in language.language_id(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got[99]["lang"] == "en" and got[99]["probability"] < 0.9 and all(got[k]["lang"] == "de" for k in range(60))
    assert language.language_id(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0), model).count() == 0


def test_every_language_is_counted(spark):
    rows = [(f"l{k:03d}", " ".join(f"w{k}x{j}" for j in range(30))) for k in range(90)] + [(None, "x"), ("l000", None)]
    langs, logp = language.fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    assert len(langs) == 90 and logp.shape == (90, 1 << language.BITS)
    with pytest.raises(ValueError):
        language.fit_languages(spark.createDataFrame(rows, "lang string, text string"), max_langs=89)


# --- pipeline -------------------------------------------------------------------------------------------------------

def test_pipeline_stages_on_odd_tables(spark):
    full = spark.read.parquet(f"{SF}/documents.parquet")
    odd = full.selectExpr("if(doc_id % 7 = 0, null, doc_id) as doc_id", "if(doc_id % 11 = 0, null, text) as text", "lang", "source", "n_chars",
                          "1 as key", "'k' as id", "2 as n_lines", "true as kept", "0 as fp", "'s' as score")
    for docs in (odd, odd.limit(0), full.limit(0)):
        cur = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            cur = stage(spark, cur, SF).checkpoint()
            assert cur.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, cur, SF).count() >= cur.count()
    assert cur.count() == 0
