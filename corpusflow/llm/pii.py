"""Personal data: base patterns, and identifiers found by bootstrapped context patterns. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns in forms that scan each text once: a run is entered at its start (or where
# the last match ended) and possessive parts never give back what could not match otherwise.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Identifier-like strings of each kind that the base patterns do not take: what contexts may discover.
LOOSE = {
    "email": r"(?:(?<![^\x20\x09-\x0D<>()\[\],;\"])|\G)[^\x20\x09-\x0D<>()\[\],;:@\"]{1,64}+(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9.-]++",
    # all eight groups, or "::" between fewer (a dotted end is a base match); or four parts with each dot in brackets
    "ip": (r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+"
           r"|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+::(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)?+"
           r"|::[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+"
           r"|[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}+)(?!:*+[0-9A-Za-z])(?!\.[0-9])"),
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ .-]?[0-9]){11,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}+(?![0-9A-Za-z])",
}
ROUNDS = 3
MIN_SEEDS = 5          # different seed identifiers that a pattern must be seen with
MIN_CONFIDENCE = 0.8   # share of a pattern's evidence that speaks for it, smoothed by one negative
UNLABELLED = 0.1       # weight against a pattern of a string that no rule accepts or rejects
ACCEPT = 0.8           # score at which an identifier is accepted


def _octet() -> str:
    return r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(
        F.pmod(n - i, F.lit(2)) == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.pmod(2 * F.substring(digits, i, F.lit(1)).cast("int"), F.lit(10)) + F.floor(2 * F.substring(digits, i, F.lit(1)).cast("int") / 10).cast("int")))
    return F.pmod(total, F.lit(10)) == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_octet()}(?:\.{_octet()}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _may_hold(kind: str, text: Column, loose: bool) -> Column:
    """A cheap necessary condition, so that most texts are not scanned."""
    if kind == "email":
        return F.contains(text, F.lit("@")) | (F.contains(text, F.lit("at]")) | F.contains(text, F.lit("at)")) if loose else F.lit(False))
    if kind == "phone" and not loose:
        return F.contains(text, F.lit("+"))
    return text.rlike(r"::|:[0-9A-Fa-f]{1,4}:|\[\.\]" if kind == "ip" and loose else "[0-9]")


def _matches(text: Column, kind: str, loose: bool = False) -> Column:
    """array<struct<s, e, m, l, r>>: code point span, text and neighbouring pieces of each match, in order.

    The pieces between the matches and the matches themselves alternate, so their lengths add up to
    the places.
    """
    rx = (LOOSE if loose else BASE)[kind]
    parts = F.split(text, rx, -1)
    found = F.regexp_extract_all(text, F.lit(f"({rx})"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,m:string,l:string,r:string>>)").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["l"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r")))).alias("out"))

    trios = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(parts, i).alias("l"), F.get(parts, i + 1).alias("r")))
    got = F.aggregate(trios, zero, step, lambda acc: acc["out"])
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string,l:string,r:string>>)")
    return F.when(_may_hold(kind, text, loose), got).otherwise(none)


def _words(piece: Column, n: int) -> Column:
    """The last (n < 0) or first words of a piece, lower-cased, white space as one blank."""
    flat = F.translate(piece, "\t\n\x0b\x0c\r", "     ")
    flat = F.rtrim(flat) if n < 0 else F.ltrim(flat)
    return F.lower(F.substring_index(flat, " ", n))


SPAN = "struct<s:int,k:int,e:int>"


def _spans(matches: Column, k: int) -> Column:
    return F.transform(F.filter(matches, lambda m: _valid(KINDS[k], m["m"])),
                       lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e")))


def _candidates(matches: Column, k: int, seed: bool, other=None, failed=None) -> Column:
    """array<struct<k, s, e, inst, ctx, seed, other, against>>: identifiers with the hashes of their context patterns.

    ``other(m)``: the string is of another kind by the base rules; ``failed(m)``: it failed its own kind's
    check. Both weigh against a pattern in full, a string no rule knows by ``UNLABELLED``.
    """
    def one(m):
        l2, l1, r1 = _words(m["l"], -2), _words(m["l"], -1), _words(m["r"], 1)
        return F.struct(F.lit(k).alias("k"), m["s"].alias("s"), m["e"].alias("e"),
                        F.xxhash64(F.lit(k), F.lower(m["m"])).alias("inst"),
                        F.array(F.xxhash64(F.lit(k), F.lit("l2"), l2), F.xxhash64(F.lit(k), F.lit("lr"), l1, r1)).alias("ctx"),
                        F.lit(seed).alias("seed"), (other(m) if other else F.lit(False)).alias("other"),
                        F.when(F.lit(seed), 0.0).when(other(m) | failed(m) if other else F.lit(False), 1.0).otherwise(UNLABELLED).alias("against"))
    return F.transform(matches, one)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, for spans sorted by start and kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
             min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """(id, h, base, spans) of each row: spans are ``array<struct<s, k, e>>`` of code points, sorted.

    ``base`` holds the matches of the fixed patterns (kind k of ``KINDS``; failing matches dropped,
    no retries); ``spans`` adds discovered ones that overlap none of them. ``h`` is the hash of the
    text, so (id, h) names a row up to equal copies, which have equal spans.

    Discovery: base identifiers are seeds. Their contexts (two words before; the word on either
    side) are patterns, kept per kind. Patterns and identifier-like strings (``LOOSE``) form a
    weighted graph of distinct edges. Each round scores a pattern by its accepted identifiers against
    its negatives, smoothed by one: strings of its kind's shape that the base rules give another kind
    or that failed their kind's check count in full, strings not yet accepted by ``UNLABELLED``. A
    pattern needs at least ``min_seeds`` different accepted ones and ``min_confidence``; an identifier's score is the noisy-or of its patterns; those of at least
    ``accept`` are accepted and vote in the next round. An occurrence is reported if its identifier
    is accepted and one of its own contexts is a confident pattern.

    A null text is empty and has no spans; null ids stay; repeated rows stay; an empty table gives
    an empty result. Only functions of Spark SQL run; texts are read twice and never shuffled: the
    graph holds hashes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = df.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    base = src.select("id", F.xxhash64("t").alias("h"), "t", *[_matches(F.col("t"), x).alias(f"b{k}") for k, x in enumerate(KINDS)])
    spans = F.array_sort(F.concat(*[_spans(F.col(f"b{k}"), k) for k in range(4)]))

    def sound(k: int):
        return F.filter(F.col(f"b{k}"), lambda m: _valid(KINDS[k], m["m"]))

    def failed(k: int):
        return F.filter(F.col(f"b{k}"), lambda m: ~_valid(KINDS[k], m["m"]))

    known = base.select("id", "h", "t", spans.alias("base"), *[sound(k).alias(f"b{k}") for k in range(4)], *[failed(k).alias(f"x{k}") for k in range(4)])

    def meets(spans, m):
        return F.exists(spans, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))

    def loose(k: int):
        """Strings of the kind's shape, but for its own base identifiers."""
        own = F.filter("base", lambda b: b["k"] == k)
        return F.filter(_matches(F.col("t"), KINDS[k], loose=True), lambda m: ~meets(own, m))

    cands = F.concat(*[_candidates(F.col(f"b{k}"), k, True) for k in range(4)],
                     *[_candidates(loose(k), k, False, lambda m: meets(F.col("base"), m), lambda m, k=k: meets(F.col(f"x{k}"), m)) for k in range(4)])
    rows = known.select("id", "h", "base", cands.alias("c")).checkpoint()

    hits = rows.select("id", "h", F.explode("c").alias("c")).select("id", "h", "c.*")
    edges = (hits.select("inst", "seed", "other", "against", F.explode("ctx").alias("ctx")).groupBy("ctx", "inst")
             .agg(F.max("seed").alias("seed"), F.min("other").alias("other"), F.max("against").alias("against")))
    # a pattern needs seeds to begin with: the others cannot become confident before an identifier does
    edges = edges.checkpoint()
    seeds = edges.where("seed").groupBy("inst").agg(F.lit(1.0).alias("score"))
    known_inst = seeds
    patterns = None
    for _ in range(rounds):
        patterns = (edges.join(known_inst, "inst", "left").groupBy("ctx")
                    .agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("good"), F.count("score").alias("m"),
                         F.sum(F.when(F.col("score").isNull(), F.col("against")).otherwise(0.0)).alias("bad"))
                    .withColumn("conf", F.col("good") / (F.col("m") + F.col("bad") + 1))
                    .where((F.col("m") >= min_seeds) & (F.col("conf") >= min_confidence - 1e-9))
                    .select("ctx", "conf")).checkpoint()
        found = (edges.where(~F.col("seed") & ~F.col("other")).join(patterns, "ctx").groupBy("inst")
                 .agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("conf"), F.lit(0.999)))))).alias("score")).where(F.col("score") >= accept - 1e-9))
        known_inst = seeds.unionAll(found.join(seeds, "inst", "left_anti")).checkpoint()

    new = (hits.where(~F.col("seed") & ~F.col("other")).select("id", "h", "k", "s", "e", "inst", F.explode("ctx").alias("ctx"))
           .join(patterns.select("ctx"), "ctx").join(known_inst.select("inst"), "inst", "left_semi")
           .groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("s", "k", "e"))).alias("new")))
    rid, rh = "_nid", "_nh"
    new = new.select(F.col("id").alias(rid), F.col("h").alias(rh), "new")
    out = rows.select("id", "h", "base").join(new, F.col("id").eqNullSafe(F.col(rid)) & (F.col("h") == F.col(rh)), "left")
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    # discovered spans that overlap one another: the first one stays
    apart = F.aggregate(F.coalesce("new", empty), F.struct(F.lit(0).alias("at"), empty.alias("o")), lambda a, x: F.when(
        x["s"] >= a["at"], F.struct(x["e"].alias("at"), F.concat(a["o"], F.array(x)).alias("o"))).otherwise(a), lambda a: a["o"])
    return out.select(F.col("id").alias(id_col), "h", "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with each span of :func:`find_pii` replaced by its kind in angle brackets, e.g. ``<email>``.

    Overlapping spans are replaced as one, by the first one's kind. Null texts stay null.
    """
    cid, ch, csp = common.fresh(df, "id", "h", "spans")
    found = (find_pii(df, id_col, text_col, **options).where(F.size("spans") > 0)
             .select(F.col(id_col).alias(cid), F.col("h").alias(ch), F.col("spans").alias(csp)).distinct())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = F.array(*map(F.lit, KINDS))
    done = F.aggregate(
        F.col(csp), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("o")),
        lambda a, x: F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), F.concat(a["o"], F.array(
            F.substring(F.col(text_col), a["at"] + 1, x["s"] - a["at"]), F.concat(F.lit("<"), F.element_at(names, x["k"] + 1), F.lit(">")))).alias("o")))
        .otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["o"].alias("o"))),
        lambda a: F.concat(F.array_join(a["o"], ""), F.substring(F.col(text_col), a["at"] + 1, F.length(F.col(text_col)))))
    joined = df.join(found, df[id_col].cast("long").eqNullSafe(F.col(cid)) & (F.xxhash64(text) == F.col(ch)), "left")
    return joined.withColumn(text_col, F.when(F.col(csp).isNull(), F.col(text_col)).otherwise(done)).select(*[F.col(f"`{c}`") for c in df.columns])
