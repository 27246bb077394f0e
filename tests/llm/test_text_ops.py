"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random

import numpy as np
import pytest

from corpusflow.llm import line_dedup, packing, pii, quality, simhash, token_counts, tree_bpe
from corpusflow.llm.queries import tokenizer

from . import brute

B40 = "This line of forty characters or more repeats."
TEXTS = [None, "", " ", "\n", "x" * 30000, "a b c", "A B C", "word " * 4000, "Café ÉCOLE naïve\t\x0btext\r\nline",
         *[f"{B40}\nown line number {k} which is not repeated at all anywhere" for k in range(7)],
         *[f"  {B40.upper()} \ntail {k}" for k in range(2)], "é" * 39, "é" * 40, *["é" * 40] * 4,
         "mail me: a@b.co, a@b.c_d@e.fg or 1.2.3.4 and 1.2.3.400, 4111 1111 1111 1111 or 4111-1111-1111-1112",
         "+1 (743) 555-3824 +12 +123456789 12345678901234567890 001.002.003.004.5", "é@x.y ü 10.0.0.1 @ a@b", "1." * 3000, "9" * 5000,
         "the cat sat on the mat the cat sat on the mat " * 3, "l1 a\nl1 a\n\n\nl1 a", "#*$%&|<> x"]
ROWS = [(k, t) for k, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with clashing extra columns, in several partitions; doc 9 stands twice."""
    rows = [(i, t, "k", 1, "n") for i, t in [*ROWS, ROWS[9]]]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_lines int, id string").repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string, n_lines int, id string")


def by_id(df, *cols):
    return sorted(tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect())


def test_line_dedup(docs, none):
    out = line_dedup.line_dedup(docs)
    assert by_id(out, "n_lines", "n_dropped", "text") == sorted(brute.lines([*ROWS, ROWS[9]]))
    assert set(out.columns) == {"doc_id", "text", "key", "n_lines", "id", "n_dropped"}
    assert line_dedup.line_dedup(none).count() == 0


def test_line_filters_have_no_false_negatives():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    flat = np.zeros(1 << 14, np.uint8)
    line_dedup._set(flat, h, 1 << 17)
    assert line_dedup._has(flat, h, 1 << 17).all()
    assert line_dedup._has(flat, rng.integers(0, 1 << 63, 5000, dtype=np.uint64), 1 << 17).mean() < 0.05


def test_line_filter_of_many_slices(spark, monkeypatch):
    """The once-seen filter grows by slices, the twice-seen one stays at its bound; results do not change."""
    assert line_dedup._sizes(10 ** 11)[2] == line_dedup.MAX_BITS and line_dedup._sizes(10 ** 11)[0] > 10 ** 4
    monkeypatch.setattr(line_dedup, "SLICE_BITS", 1 << 8)
    monkeypatch.setattr(line_dedup, "MIN_BITS", 1 << 10)
    monkeypatch.setattr(line_dedup, "MAX_BITS", 1 << 14)
    rows = [(k, "\n".join([f"{B40} {k % 60}", f"own line {k} with enough characters to be a long key", "s"])) for k in range(2000)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, out)) == sorted(brute.lines(rows))


def test_line_dedup_null_ids_and_full_filter(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MIN_BITS", 1 << 10)
    monkeypatch.setattr(line_dedup, "MAX_BITS", 1 << 10)       # a filter that lets nearly all through changes nothing
    rows = [(k, f"{B40}\nunique line {k} with enough characters to be a long key") for k in range(300)]
    out = line_dedup.line_dedup(spark.createDataFrame([*rows, (None, B40)], "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in out.collect()}
    assert got[None] == (1, "") and got[299][0] == 0 and all(got[k][0] == 1 for k in range(299))


def test_bpe(docs, none):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for leaf in (2048, 16):
        out = {r["doc_id"]: r for r in tree_bpe.bpe_encode_decode(docs, tokenizer("word_bpe_49k.json"), leaf=leaf).collect()}
        for i, t in ROWS:
            want = lib.encode(t or "", add_special_tokens=False).ids
            assert out[i]["ids"] == want and out[i]["n_tokens"] == len(want)
            assert out[i]["decoded"] == lib.decode(want, skip_special_tokens=False)
    assert tree_bpe.bpe_encode_decode(none, tokenizer("word_bpe_49k.json")).count() == 0


def test_bpe_trees_of_random_unsplit_text():
    enc = tree_bpe.TreeEncoder(tokenizer("word_bpe_49k.json"), leaf=7)
    rng = random.Random(3)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(1, 900))) for a in
             ("ab", "the", "abcdefghij", "a'st!.,0", "аб漢字🙂'd", "éàß́x", "<|endoftext|>") for _ in range(20)]
    texts += ["<|endoftext|>" * 5 + "zz" * 50, "a\x85b\x1cc d", "J̌" * 40]
    for t, ids, d in zip(texts, *enc.encode_decode(texts), strict=True):
        want = enc.tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, np.int32).tolist() == want
        assert d == enc.tok.decode(want, skip_special_tokens=False)


def test_token_counts(docs, none):
    counter = token_counts.PieceCounter(tokenizer("piece_bpe_32k.model"))
    assert counter.safe
    out = {r["doc_id"]: r for r in token_counts.token_counts(docs, tokenizer("piece_bpe_32k.model")).collect()}
    for i, t in ROWS:
        n = len(counter.sp.encode(t or ""))
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096)
    odd = ["  a  b\t\n c  ", "▁a▁▁b ▁", " ▁ ", "a ", " a", "日本語 テ", "<s>a</s> <unk>", "a b 　c", " " * 50, "a" + " " * 33]
    assert counter.count(odd) == [len(counter.sp.encode(x)) for x in odd]
    assert token_counts.token_counts(none, tokenizer("piece_bpe_32k.model")).count() == 0


def test_pii_base(docs, none):
    out = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for i, t in ROWS:
        assert [tuple(x[c] for c in ("s", "k", "e")) for x in out[i]["base"]] == brute.pii(t), t
        assert set(map(tuple, out[i]["base"])) <= set(map(tuple, out[i]["spans"]))
    assert pii.find_pii(docs).count() == len(ROWS) + 1 and pii.find_pii(none).count() == 0


def test_pii_random_texts(spark):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("a.@-+ 0123456789()_%b") for _ in range(60))) for k in range(400)]
    out = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert [tuple(x[c] for c in ("s", "k", "e")) for x in out[i]["base"]] == brute.pii(t), t


def test_pii_discovers_unseen_identifiers_by_context(spark):
    rows = [(k, f"Doc {k}. please call us +1 (555) 010-{1000 + k:04d} today and rest") for k in range(12)]
    rows += [(100, "Doc. please call us (555) 010-7777 today and rest"), (101, "there were 555 010 7777 people in it")]
    out = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[12][1]
    assert [text[x["s"]:x["e"]] for x in out[100]["spans"]] == ["(555) 010-7777"] and out[100]["base"] == []
    assert out[101]["spans"] == []


def test_pii_discovery_among_unseen_identifiers(spark):
    rows, want = [], {}
    for g, (seeds, unseen) in enumerate(((5, 1), (5, 2), (12, 6), (30, 15))):       # up to a third of a context's instances
        rows += [(1000 * g + k, f"please w{g} us +1 (555) 01{g}-{1000 + k:04d} today{g} and") for k in range(seeds)]
        for k in range(unseen):
            rows.append((1000 * g + 100 + k, f"please w{g} us (555) 01{g}-{7000 + k} today{g} and"))
            want[1000 * g + 100 + k] = [f"(555) 01{g}-{7000 + k}"]
    rows.append((900, "please w1 us 0044 20 7946 0958 otherwise"))
    want[900] = ["0044 20 7946 0958"]
    rows += [(5000 + k, f"the host at 2.3.4.{k} answered") for k in range(12)]
    for k, x in enumerate(("2001:db8::1", "::1", "1:2:3:4:5:6:7:8", "fe80::")):
        rows.append((5100 + k, f"the host at {x} answered"))
        want[5100 + k] = [x]
    rows.append((5200, "host at std::vector or at :: answered"))
    want[5200] = []
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    assert {i: [dict(rows)[i][x["s"]:x["e"]] for x in got[i]["spans"]] for i in want} == want


def test_addresses_are_not_times_or_versions(spark):
    rows = [(k, f"reach the server at 10.1.{k}.9 today") for k in range(30)]
    no = ["2024:11:05:10", "12:30:45:00", "12:30:45", "5.4.3", "cafe:babe:dead:beef", "1:2:3:4:5:6:7:8:9", "aa:bb:cc:dd:ee:ff", "12::30::45x", "a.b.c.d"]
    yes = ["cafe:babe:dead:beef:cafe:babe:dead:beef", "2001:db8::8a2e:370:7334", "::ffff:a00:1", "10[.]0[.]0[.]1", "fe80::"]
    rows += [(100 + k, f"reach the server at {x} today") for k, x in enumerate(no)] + [(200 + k, f"reach the server at {x} today") for k, x in enumerate(yes)]
    rows.append((300, "reach the server at ::ffff:10.0.0.1 today"))
    got = {r["doc_id"]: [t[x["s"]:x["e"]] for x in r["spans"]] for t, r in
           ((dict(rows)[r["doc_id"]], r) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect())}
    assert [got[200 + k] for k in range(len(yes))] == [[x] for x in yes]
    assert [x for k, x in enumerate(no) if got[100 + k]] == []
    assert got[300] == ["10.0.0.1"]             # the base match inside stays


def test_recall_and_precision_of_discovery_on_planted_rows(spark):
    """Contexts of all kinds, a quarter of whose identifiers no base pattern takes, among strings that look alike elsewhere."""
    rng, rows, want = random.Random(11), [], {}

    def digits(n):
        return "".join(rng.choice("123456789") for _ in range(n))

    def hexes(n):
        return ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(n))

    seen = {"email": lambda: f"u{digits(5)}@mail.org", "ip": lambda: f"10.{rng.randrange(256)}.{rng.randrange(256)}.7", "phone": lambda: f"+1 555 {digits(3)} {digits(4)}"}
    unseen = {"email": lambda: f"u{digits(5)} [at] mail.org", "ip": lambda: hexes(8), "phone": lambda: f"(555) {digits(3)}-{digits(4)}"}
    other = [lambda: f"12:{digits(2)}:45:{digits(2)}", lambda: f"{digits(4)} {digits(4)}", lambda: f"version 1.{digits(1)}.{digits(2)}.{digits(1)}.2", lambda: f"order {digits(8)}"]
    for c in range(30):
        kind = ("email", "ip", "phone")[c % 3]
        for k in range(20):
            x = (unseen if k % 4 == 3 else seen)[kind]()
            i = len(rows)
            rows.append((i, f"row {i} says contact{c} via{c} {x} until{c} noon"))
            if k % 4 == 3:
                want[i] = x
    for _ in range(300):
        rows.append((len(rows), f"row w{digits(2)} at v{digits(2)} {rng.choice(other)()} z{digits(2)} noon"))
    got = {}
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect():
        new = {tuple(x) for x in r["spans"]} - {tuple(x) for x in r["base"]}
        if new:
            got[r["doc_id"]] = [rows[r["doc_id"]][1][s:e] for s, _, e in sorted(new)]
    right = sum(got.get(i) == [x] for i, x in want.items())
    assert right >= 0.95 * len(want), right
    assert right >= 0.98 * sum(map(len, got.values())), (right, got)


def test_pii_discovery_needs_more_seeds_than_negatives(spark):
    rows = [(k, f"reach it at +1 (555) 010-{1000 + k:04d} today") for k in range(8)] + [(50, "reach it at 555 010 7777 today")]
    rows += [(100 + k, f"reach it at 192.168.100.{100 + k} today") for k in range(8)]       # of a phone's shape, but addresses
    out = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[50]["spans"] == [] and len(out[100]["spans"]) == 1


def test_redact(docs, spark):
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()}
    k = TEXTS.index("é@x.y ü 10.0.0.1 @ a@b")
    assert got[k] == "é@x.y ü <ip> @ a@b" and got[0] is None and got[5] == "a b c"
    assert got[k - 2].startswith("mail me: <email>, <email>") and pii.redact(docs).columns == docs.columns


def test_simhash_components(spark, none):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    near = [(200 + k, " ".join(base[:k] + ["new"] + base[k + 1:])) for k in range(0, 400, 9)]
    rows = [*ROWS, ROWS[9], *near, (900, " ".join(base)), (901, " ".join(base))]
    got = by_id(simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), "fp", "component_id")
    want = sorted(brute.components(rows))
    assert [(i, f"{f & (1 << 64) - 1:016x}", c) for i, f, c in got] == want
    assert simhash.simhash_components(none).count() == 0
    kept = sorted(r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame([*rows, (None, "q"), (None, "q")], "doc_id long, text string")).collect() if r["doc_id"] is not None)
    assert kept == sorted({c for _, _, c in want})


def test_bk_tree_finds_all_links_and_slices(spark, monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300, dtype=np.uint64),
                                    *[np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 9, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 9, 60, dtype=np.uint64))]]))
    links = {(min(a, b), max(a, b)) for n, hit in simhash.tree_links(fps, np.arange(len(fps)), 2) for a, b in [(n, x) for x in hit] if a != b}
    assert links == {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (int(fps[a]) ^ int(fps[b])).bit_count() <= 2}
    monkeypatch.setattr(simhash, "SLICE", 5)                   # large shards are spread over slices
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash._links(df, 2)).collect()}
    signed = [int(x) for x in fps.view(np.int64)]
    up = {x: x for x in signed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        up[find(signed[a])] = find(signed[b])
    low = {}
    for x in signed:
        low[find(x)] = min(low.get(find(x), x), x)
    assert all(roots.get(x, x) == low[find(x)] for x in signed)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_quality(docs, none):
    out = {r["doc_id"]: r for r in quality.quality_rules(docs, None).collect()}
    for i, t in ROWS:
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(t), t
        assert r["kept"] == (not r["base_failed"])
    assert quality.quality_rules(none, None).count() == 0


def test_quality_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(d, lab.where("doc_id % 3 <> 0"), sample=300)
    rows = quality.quality_rules(d, model).where("not base_failed").join(lab.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.95
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.98
    assert quality.fit_quality(d, lab.where("quality = 1")) is None


@pytest.mark.parametrize("seed", range(4))
def test_pack(seed):
    rng = random.Random(seed)
    caps = (16, 32, 64)
    n = [rng.choice([0, 1, 5, 16, 17, 31, 40, 63, 64, rng.randint(0, 64)]) for _ in range(300)]
    bins, offs, cap = packing.pack(n, caps)
    spans = {}
    for b, o, x in zip(bins, offs, n, strict=True):
        assert o + x <= cap[b] and cap[b] in caps
        spans.setdefault(b, []).append((o, x))
    for b, s in spans.items():
        s.sort()
        assert all(a + x == c for (a, x), (c, _) in zip(s, s[1:], strict=False)) and s[0][0] == 0      # no gaps, no overlaps
        total = sum(x for _, x in s)
        assert cap[b] == min(c for c in caps if c >= total)                                            # downsized
    assert len(spans) == len(cap) and sum(cap) <= 1.1 * sum(n) + 64
    # best fit: replay the order against all open bins
    assert sum(map(packing.cost, cap)) <= sum(map(packing.cost, (64,) * len(cap)))


def test_best_fit_packing(docs, none):
    out = packing.best_fit_packing(docs, "length(text)", capacities=(512, 1024, 4096), shard=5).collect()
    want = {}
    for i, t in [*ROWS, ROWS[9]]:
        want[i] = want.get(i, 0) + len(t or "")
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        assert r["bin_offset"] + r["length"] <= r["capacity"]
    assert got == want and packing.best_fit_packing(none, "length(text)").count() == 0


def test_packing_spreads_null_and_repeated_ids(spark):
    rows = [(None, "a b")] * 400 + [(7, "a b")] * 400
    out = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string"), "length(text)", capacities=(16, 64), shard=100).collect()
    assert len(out) == 800 and sum(r["doc_id"] is None for r in out) == 400
    shards = {}
    for r in out:
        shards[r["bin_id"] >> 32] = shards.get(r["bin_id"] >> 32, 0) + 1
    assert len(shards) == 8 and max(shards.values()) < 200


def test_hash_of_kept_text_is_utf8():
    assert brute.sha("é") == hashlib.sha256("é".encode()).hexdigest()
