"""Main-text extraction: a linear-chain CRF over the leaf blocks of a page, decoded by Viterbi."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 14
SAMPLE = 200          # pages the model is trained on (a bounded sample)
ROUNDS = 8
SEED = 11

TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")     # possessive: nothing is tried twice
ATTR = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# fixed values: elements of the HTML language by their role
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object xmp noframes".split())
RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
NO_TEXT = frozenset("head script style noscript template textarea title iframe svg math object select option button canvas xmp noframes datalist".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt tr td th tbody thead tfoot".split())
SELF_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEAD_HOLDS = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
SCOPE = frozenset("ul ol dl table article section div main body aside nav form".split())
PLACED = SCOPE.union(*SELF_CLOSE.values())
DEPTH = 256           # innermost ancestors that a block keeps
SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("link", "path", "text")

    def __init__(self, path: tuple, text: str, link: int):
        self.path, self.text, self.link = path, text, link


class Tokens:
    """Markup of a page, from left to right in linear time however broken it is.

    ``next(pos)`` gives (start, end, tag, closing, attributes) of the next piece at or after ``pos``, or None; comments,
    declarations and sections have no tag. A tag ends at the first ``>`` outside quotes; a quote that never closes is
    an ordinary character. Once a scan met the end of the page inside quotes, quotes count as ordinary for the rest.
    A comment left open takes the rest of the page; a ``<`` that no ``>`` follows is text.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in (">", "-->", "]]>")}
        self.quotes = True

    def _end(self, pos: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends before ``pos``."""
        page, at = self.page, pos
        while self.quotes:
            at = INSIDE.match(page, at).end()
            if at >= len(page):
                self.quotes = False
            elif page[at] == ">":
                return at
            else:                           # a quote that no other closes
                at += 1
        return page.find(">", pos)

    def next(self, pos: int):
        page, last = self.page, self.last
        while (at := page.find("<", pos)) >= 0:
            if page.startswith("<!--", at):
                return at, page.find("-->", at + 4) + 3 if at + 4 <= last["-->"] else len(page), "", False, ""
            if at > last[">"]:
                pos = page.find("<!--", at)             # only an open comment can follow
                if pos < 0:
                    return None
                continue
            if page.startswith("<![CDATA[", at) and at + 9 <= last["]]>"]:
                return at, page.find("]]>", at + 9) + 3, "", False, ""
            if page.startswith(("<!", "<?"), at):
                return at, page.find(">", at) + 1, "", False, ""
            if m := TAG.match(page, at):
                end = self._end(m.end())
                return at, end + 1, m.group(2).lower(), bool(m.group(1)), page[m.end():end]
            pos = at + 1
        return None


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: runs of text not broken by a block element, with their ancestors.

    Ancestors are strings such as ``div.side-bar#x``. Markup may be broken: an element that its
    parent cannot hold closes what is open, unknown end tags are ignored, open elements end with
    the page. A head left open ends at the first text or start tag it cannot hold. Text of scripts,
    styles, titles, form controls and the like is no block. Time is linear in the page: open tags are counted, so
    what is not open is not looked for, and blocks keep their ``DEPTH`` innermost ancestors.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []          # (tag, ancestor string)
    opened: Counter = Counter()                # open elements by tag
    solid: list[int] = []                      # places in the stack of elements that are not inline
    placed: list[int] = []                     # places of elements that may end, or keep from ending, another
    unclosed: set[str] = set()                 # raw elements whose end tag does not come any more
    tokens = Tokens(page)
    hidden = 0                                 # open elements whose text does not show
    buf: list[str] = []
    link = 0
    in_a = 0

    def flush() -> None:
        nonlocal link
        if buf:
            t = SPACE.sub(" ", entities.unescape("".join(buf))).strip()
            if t:
                blocks.append(Block(tuple(stack[k][1] for k in solid[-DEPTH:]), t, link))
            buf.clear()
        link = 0

    def push(tag: str, name: str) -> None:
        nonlocal hidden, in_a
        if tag not in INLINE:
            solid.append(len(stack))
        if tag in PLACED:
            placed.append(len(stack))
        stack.append((tag, name))
        opened[tag] += 1
        hidden += tag in NO_TEXT
        in_a += tag == "a"

    def pop_to(k: int) -> None:
        nonlocal hidden, in_a
        while len(stack) > k:
            tag = stack.pop()[0]
            opened[tag] -= 1
            hidden -= tag in NO_TEXT
            in_a -= tag == "a"
        for places in (solid, placed):
            while places and places[-1] >= k:
                places.pop()

    def place(tag: str) -> int:
        """Place of the innermost open element of that tag."""
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag) if opened[tag] else -1

    def end_head() -> None:
        if hidden and opened["head"]:
            pop_to(next(k for k, x in enumerate(stack) if x[0] == "head"))

    pos, n = 0, len(page)
    while pos < n:
        m = tokens.next(pos)
        end = m[0] if m else n
        if hidden and stack[-1][0] == "head" and page[pos:end].strip():
            end_head()
        if end > pos and not hidden:
            buf.append(page[pos:end])
            if in_a:
                link += end - pos
        if not m:
            break
        _, pos, tag, closing, inside = m
        if not tag:
            continue
        if closing:
            at = place(tag)
            if at >= 0:
                if tag not in INLINE:
                    flush()
                pop_to(at)
            elif tag == "p" or tag not in INLINE:
                flush()
            continue
        if hidden and tag not in HEAD_HOLDS:
            end_head()
        empty = inside.endswith("/")
        if tag in INLINE:
            if tag == "br" or tag == "img":
                if not hidden:
                    buf.append(" ")
            elif not empty:
                push(tag, tag)
            continue
        flush()
        if tag in CLOSES_P and solid and stack[solid[-1]][0] == "p":
            pop_to(solid[-1])
        if tag in SELF_CLOSE:
            for k in reversed(placed):
                if stack[k][0] in SELF_CLOSE[tag]:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        if tag in VOID or empty:
            continue
        attrs = {a.lower(): x or y or z or "" for a, x, y, z in ATTR.findall(inside)}
        name = tag + "".join(f".{w}" for w in attrs.get("class", "").lower().split()) + "".join(
            f"#{attrs[a].lower()}" for a in ("id", "role", "itemprop") if attrs.get(a))
        if tag in RAW:                                        # text up to the end tag is not markup
            close = None if tag in unclosed else RAW_END[tag].search(page, pos)
            if close:
                pos = close.end()
                continue
            unclosed.add(tag)
            pos = n if tag in ("script", "style") else pos
        push(tag, name)
    flush()
    return blocks


# ---- features ----------------------------------------------------------------------------------
WORD = re.compile(r"[a-z]+")
# fixed values: words of layout names, as they stand in class names and ids, by what they name
BOILER_NAMES = ("nav navbar menu header masthead topbar footer sidebar side aside rail widget notice cookie consent banner alert "
                "popup modal ad ads advert advertisement sponsor promo share social related recommended breadcrumb breadcrumbs "
                "comment comments reply replies disqus discussion respond newsletter subscribe signup login search form pagination "
                "pager toolbar copyright legal tags skip").split()
CONTENT_NAMES = "article content main post entry story body text article-body post-content entry-content story-body articlebody maincontent".split()


def _hash(names: list[str], bits: int) -> np.ndarray:
    return np.unique(np.fromiter(((crc32(x.encode()) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits) for x in names), np.int64))


def path_features(path: tuple) -> list[str]:
    """Ancestor tags, near and far, and the words of their names."""
    f = ["1"]
    for depth, a in enumerate(reversed(path)):
        tag = a.split(".")[0].split("#")[0]
        f.append(f"t:{tag}")
        if depth < 2:
            f.append(f"t{depth}:{tag}")
        rest = a[len(tag):]
        if rest:
            f += [f"w:{w}" for w in WORD.findall(rest)]
            f += [f"n:{w.strip('.#')}" for w in re.split(r"(?=[.#])", rest) if w]
    return f


def text_features(b: Block, k: int, n: int) -> tuple:
    """Shape of a block's text and its place in the page."""
    t = b.text
    return (f"len:{min(8, len(t).bit_length())}", f"words:{min(7, (t.count(' ') + 1).bit_length())}",
            f"link:{int(4 * min(1.0, b.link / len(t)))}", f"end:{'s' if t[-1] in '.!?' else 'o'}",
            "copyright" if "©" in t else "", f"at:{'first' if k == 0 else 'last' if k == n - 1 else 'in'}")


def features(blocks: list[Block], bits: int = BITS) -> list[np.ndarray]:
    """Hashed binary features of each block: a part for its ancestors and a part for its text."""
    n = len(blocks)
    return [np.concatenate([_hash(path_features(b.path), bits), (1 << bits) + _hash(list(text_features(b, k, n)), bits)])
            for k, b in enumerate(blocks)]


class Scorer:
    """Emission scores; the sums of path and text parts are remembered, as pages share most of them."""

    def __init__(self, model, bits: int = BITS, cache: int = 50_000):
        (self.w, self.trans), self.bits, self.cache, self.part, self.chars = model, bits, cache, {}, 0

    def _sum(self, key: tuple, names, base: int) -> np.ndarray:
        got = self.part.get(key)
        if got is None:
            if len(self.part) > self.cache or self.chars > 1 << 24:
                self.part.clear()
                self.chars = 0
            self.chars += sum(map(len, key))
            got = self.part[key] = self.w[:, base + _hash(list(names(key)), self.bits)].sum(axis=1)
        return got

    def label(self, blocks: list[Block]) -> np.ndarray:
        n = len(blocks)
        emit = np.stack([self._sum(b.path, path_features, 0) + self._sum(text_features(b, k, n), lambda x: x, 1 << self.bits)
                         for k, b in enumerate(blocks)])
        return viterbi(emit, self.trans)


# ---- the chain ---------------------------------------------------------------------------------
def _scores(feats, w) -> np.ndarray:
    return np.stack([w[:, f].sum(axis=1) for f in feats])


def viterbi(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    """The likeliest labels; ties go to label 0. Plain numbers: two states are too few for arrays."""
    (t00, t01), (t10, t11) = trans.tolist()
    steps = emit.tolist()
    s0, s1 = steps[0]
    back = []
    for e0, e1 in steps[1:]:
        b0, b1 = int(s1 + t10 > s0 + t00), int(s1 + t11 > s0 + t01)
        back.append((b0, b1))
        s0, s1 = (s1 + t10 if b0 else s0 + t00) + e0, (s1 + t11 if b1 else s0 + t01) + e1
    y = [int(s1 > s0)]
    for b in reversed(back):
        y.append(b[y[-1]])
    return y[::-1]


def _marginals(emit: np.ndarray, trans: np.ndarray):
    n = len(emit)
    a, z = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = emit[0]
    for k in range(1, n):
        a[k] = np.logaddexp(a[k - 1, 0] + trans[0], a[k - 1, 1] + trans[1]) + emit[k]
    for k in range(n - 2, -1, -1):
        x = trans + (emit[k + 1] + z[k + 1])[None, :]
        z[k] = np.logaddexp(x[:, 0], x[:, 1])
    total = np.logaddexp(*a[-1])
    node = np.exp(a + z - total)
    edge = np.exp(a[:-1, :, None] + trans[None] + (emit[1:] + z[1:])[:, None, :] - total) if n > 1 else np.zeros((0, 2, 2))
    return node, edge.sum(axis=0)


def fit_crf(pages: list[tuple[list[np.ndarray], np.ndarray]], bits: int = BITS, rounds: int = ROUNDS, l2: float = 1e-4):
    """(w, trans) by AdaGrad on the conditional likelihood, one page at a time."""
    w, trans = np.zeros((2, 2 << bits)), np.zeros((2, 2))
    gw, gt = np.full((2, 2 << bits), 1e-6), np.full((2, 2), 1e-6)
    order, rng = list(range(len(pages))), random.Random(SEED)
    for _ in range(rounds):
        rng.shuffle(order)
        for p in order:
            feats, y = pages[p]
            if not len(feats):
                continue
            node, edge = _marginals(_scores(feats, w), trans)
            gold = np.zeros((2, 2))
            np.add.at(gold, (y[:-1], y[1:]), 1)
            d = np.eye(2)[y] - node
            at = np.concatenate(feats)
            g = np.zeros((2, len(at)))
            g[:] = np.repeat(d, [len(f) for f in feats], axis=0).T
            u, inv = np.unique(at, return_inverse=True)
            gu = np.stack([np.bincount(inv, weights=g[c], minlength=len(u)) for c in (0, 1)]) - l2 * w[:, u]
            gw[:, u] += gu * gu
            w[:, u] += 0.3 * gu / np.sqrt(gw[:, u])
            ge = gold - edge - l2 * trans
            gt += ge * ge
            trans += 0.3 * ge / np.sqrt(gt)
    return w, trans


# ---- labelled pages ----------------------------------------------------------------------------
def seed_label(b: Block) -> int | None:
    """1 in an article or main element, 0 in an element that names its own role, else unknown."""
    tags = [a.split(".")[0].split("#")[0] for a in b.path]
    names = {w for a in b.path for w in WORD.findall(a)}
    if any(t in ("nav", "footer", "aside", "form") for t in tags) or names & set(BOILER_NAMES):
        return 0
    return 1 if "article" in tags or "main" in tags else None


def _wrap(rng: random.Random, kind: str, inner: str) -> str:
    """``inner`` in an element that a page could use for ``kind``."""
    if kind == "content":
        name = rng.choice(CONTENT_NAMES)
        return rng.choice([f"<article>{inner}</article>", f"<main>{inner}</main>", f"<article class='{name}'>{inner}</article>",
                           f"<div class='{name}'>{inner}</div>", f"<div id='{name}'>{inner}</div>",
                           f"<main><div class='{name}'>{inner}</div></main>", f"<section class='{name}'><article>{inner}</article></section>"])
    name = rng.choice(BOILER_NAMES)
    mark = rng.choice([name, f"{name}-box", f"site-{name}", f"page {name}"])
    tag = rng.choice(["div", "section", "ul", "div", "aside", "p"])
    named = f"<{tag} {rng.choice(['class', 'id', 'role'])}='{mark}'>{inner}</{tag}>"
    plain = rng.choice(["nav", "header", "footer", "aside", "form"])
    return rng.choice([named, named, f"<{plain}>{inner}</{plain}>", f"<{plain} class='{mark}'>{inner}</{plain}>"])


def compose(rng: random.Random, content: list[str], boiler: list[str]) -> tuple[str, list[int]]:
    """A labelled page: given texts in a layout drawn at random. Returns (html, label of each block)."""
    parts: list[tuple[str, list[int]]] = []

    def inner(texts: list[str], label: int) -> tuple[str, list[int]]:
        out = []
        for t in texts:
            e = entities.escape(t, quote=False)
            tag = rng.choice(["p", "p", "p", "li", "h2", "div", "blockquote", "td"] if label else ["p", "li", "div", "span", "a", "h3", "small"])
            if tag == "li":
                out.append(f"<ul><li>{e if label or rng.random() < 0.4 else f'<a href=x>{e}</a>'}</li></ul>")
            elif tag == "td":
                out.append(f"<table><tr><td>{e}</td></tr></table>")
            elif tag == "a":
                out.append(f"<div><a href=x>{e}</a></div>")
            elif tag in ("span", "small"):
                out.append(f"<div><{tag}>{e}</{tag}></div>")
            else:
                out.append(f"<{tag}>{e}</{tag}>")
        return "".join(out), [label] * len(texts)

    def noise(n: int) -> tuple[str, list[int]]:
        s, y = inner([rng.choice(boiler) for _ in range(n)], 0)
        return _wrap(rng, "boiler", s), y

    for _ in range(rng.randint(0, 3)):
        parts.append(noise(rng.randint(1, 5)))
    texts, y = [f"<h1>{entities.escape(content[0], quote=False)}</h1>"], [1]
    if rng.random() < 0.15:
        texts[0] = texts[0].replace("h1>", "p>")
    if rng.random() < 0.3:
        texts[0] = f"<header>{texts[0]}</header>"
    for c in content[1:]:
        s, lab = inner([c], 1)
        texts.append(s)
        y += lab
        if rng.random() < 0.3:
            s, lab = noise(rng.randint(1, 2))
            texts.append(s)
            y += lab
    if rng.random() < 0.3:
        s, lab = noise(rng.randint(1, 3))
        texts.append(s)
        y += lab
    bare = rng.random() < 0.25            # a page without an element for its article
    parts.append(("".join(texts) if bare else _wrap(rng, "content", "".join(texts)), y))
    for _ in range(rng.randint(0, 3)):
        parts.append(noise(rng.randint(1, 4)))
    body = "".join(p[0] for p in parts)
    if rng.random() < 0.3:
        body = f"<div class='{rng.choice(['wrapper', 'container', 'page', 'layout'])}'>{body}</div>"
    return f"<html><head><title>x</title></head><body>{body}</body></html>", [v for p in parts for v in p[1]]


def training_pages(pages: list[str], seed: int = SEED) -> list[tuple[list[Block], np.ndarray]]:
    """Labelled pages: the given ones as their own elements label them, and their texts in other layouts."""
    rng = random.Random(seed)
    out, bodies, boiler = [], [], []
    for p in pages:
        blocks = leaf_blocks(p)
        y = [seed_label(b) for b in blocks]
        if None not in y and 1 in y:
            out.append((blocks, np.array(y)))
        bodies.append([b.text for b, v in zip(blocks, y, strict=True) if v == 1])
        boiler += [b.text for b, v in zip(blocks, y, strict=True) if v == 0]
    bodies = [b for b in bodies if b] or [["Title.", "A paragraph of text."]]
    boiler = boiler or ["Home", "About us"]
    pool = [t for b in bodies for t in b]
    boiler = [*boiler, *pool[:max(1, len(boiler) // 2)]]     # boilerplate may read like an article
    for body in bodies * 4:
        text, y = compose(rng, [x for x in body[:rng.randint(1, 12)]], boiler)
        blocks = leaf_blocks(text)
        if len(blocks) == len(y):
            out.append((blocks, np.array(y)))
    return out


def fit_extractor(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE):
    """The CRF, trained on at most ``sample`` pages (those of smallest id hash, so the same each run)."""
    ids = (pages.where(F.col(id_col).isNotNull() & F.col(html_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"))
           .orderBy(F.xxhash64("i"), "i").limit(sample).distinct())
    got = (pages.select(F.col(id_col).cast("long").alias("i"), F.col(html_col).alias("t")).where("t is not null")
           .join(F.broadcast(ids), "i").orderBy(F.xxhash64("i"), "i", "t").limit(sample).collect())
    data = [(features(b), y) for b, y in training_pages([r["t"] for r in got])]
    return fit_crf([d for d in data if len(d[0])])


def main_text(page: str, scorer: Scorer) -> str:
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    return "\n".join(b.text for b, v in zip(blocks, scorer.label(blocks), strict=True) if v)


def extract_text(df: DataFrame, model, html_col: str = "html") -> DataFrame:
    """``df`` with ``text`` (main text, "" if none) and ``n_chars`` (its code points) for each page.

    Each page is one chain: its leaf blocks with ancestor and text features, labelled by Viterbi
    over the trained ``model`` (fixed size, broadcast); no shuffle. White space in a block becomes one space,
    blocks are joined by a line feed. Null or empty pages give the empty text; repeated rows give
    repeated results; columns named like a result are replaced.
    """
    common.bound_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(held.value)

        def step(b):
            out = [main_text(t.decode("utf-8", "replace"), scorer)
                   for t in common.texts(b.column(b.schema.get_field_index(html_col)))]
            return pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())
        return step

    return common.arrow_columns(df, start, "text string, n_chars long")
