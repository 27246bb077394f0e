"""Plain Python twins of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WS = " \t\n\x0b\x0c\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def lines(docs, min_chars=40, min_docs=5):
    """[(doc_id, n_lines, n_dropped, kept text)]"""
    def key(x):
        return x.strip(WS).translate(UP)
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or i == max(held[key(x)])]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d: str) -> bool:
    s = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def pii(text):
    """[(start, kind number, end)] of the base patterns."""
    out = []
    for k, (kind, rx) in enumerate(PII.items()):
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs, radius=2):
    fp = [(i, fingerprint(t)) for i, t in docs]
    up = list(range(len(fp)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(fp)):
        for b in range(a):
            if (fp[a][1] ^ fp[b][1]).bit_count() <= radius:
                up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(fp):
        low[find(k)] = min(low.get(find(k), i), i)
    return [(i, f"{f:016x}", low[find(k)]) for k, (i, f) in enumerate(fp)]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    rep = {j for i in range(len(w) - 4) if n[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w))
