"""BPE encoding and decoding with tree concatenation of long unsplit text."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

SPLIT = re.compile(r"[ \t\r\n]+")   # white space for every pattern of the library; no token spans it
LEAF = 16                           # characters of an unsplit word encoded in one piece
CACHE = 176 << 20                   # bytes of chunks, and of words, that a task remembers
LATIN = re.compile("[!-~¡-įı-ſ]+")  # no white space, no combining marks, each character in normal form


class TreeEncoder:
    """Encodes as ``tokenizers`` does (``add_special_tokens=False``, no truncation or padding).

    Chunks between white space are encoded by the library in batches and remembered (short chunks of
    Latin characters through its BPE model word by word, which skips its costly alignment). In a chunk
    longer than ``leaf`` characters the library's own normaliser and pre-tokeniser give the words;
    a word longer than ``leaf`` is cut in halves down to ``leaf``, all pieces are encoded in one
    parallel batch, and the halves are joined bottom-up: a window around the join is re-encoded and
    doubled until its first token is the left half's and one of its inner tokens is the right
    half's, same id and same place. Then each pair of neighbours in the joined sequence also stands
    in a true encoding of its own text, which for BPE makes the whole sequence the encoding.
    """

    def __init__(self, path: str, leaf: int = LEAF, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf, self.cache = leaf, cache
        self.bare = Tokenizer(self.tok.model)   # the merges alone: no normaliser, words or added tokens
        added = self.tok.get_added_tokens_decoder()
        plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added.values())
        self.special = {t.content: i for i, t in added.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.tree = plain and self.tok.normalizer is not None and self.tok.pre_tokenizer is not None
        self.known: dict[str, tuple[bytes, str]] = {}     # chunks of at most ``leaf`` characters: long ones are not kept
        self.words: dict[str, tuple[list[int], list[str]]] = {}
        self.known_bytes = self.word_bytes = 0
        self.trees = 0                                    # words encoded as trees
        self.pattern = self._word_pattern()
        if self.pattern:
            bytelevel = {c: self.tok.pre_tokenizer.pre_tokenize_str(chr(c)) for c in range(0xA1, 0x180)}
            self.names = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
            self.mapped = {c: w[0][0] for c, w in bytelevel.items() if w}

    def _word_pattern(self):
        """The pre-tokeniser's own pattern, if it is the one that short Latin chunks can be split by here."""
        conf = json.loads(self.tok.to_str())
        norm, pre = conf.get("normalizer") or {}, conf.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in norm.get("normalizers", [])], [x["type"] for x in pre.get("pretokenizers", [])]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or not self.tree or self.tok.decoder:
            return None
        cut, level = pre["pretokenizers"]
        if (cut["behavior"], cut["invert"], level["use_regex"], level["add_prefix_space"],
                norm["normalizers"][1]["pattern"]) != ("Removed", True, False, False, {"Regex": r"\s+"}):
            return None
        return regex.compile(cut["pattern"]["Regex"])

    def _latin(self, chunk: str) -> tuple[bytes, str]:
        """Ids and decoded tokens of a short chunk of Latin characters: its words, each by the library's model."""
        ids, tokens, words = [], [], self.words
        for w in self.pattern.findall(chunk.lower()):
            got = words.get(w)
            if got is None:
                if self.word_bytes > self.cache:
                    words.clear()
                    self.word_bytes = 0
                self.word_bytes += 300 + 40 * len(w)
                t = self.tok.model.tokenize(w if w.isascii() else w.translate(self.mapped))
                i = [x.id for x in t]
                got = words[w] = i, [self.names[x] for x in i]
            ids += got[0]
            tokens += got[1]
        return array("i", ids).tobytes(), " ".join(tokens)

    # ---- tree concatenation of one long word ------------------------------------------------
    def _tokens(self, word: str, start: int, end: int):
        e = self.bare.encode(word[start:end], add_special_tokens=False)
        return [(i, a + start, b + start) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def join(self, word: str, left: list, right: list) -> list:
        w = 4
        while True:
            i, j = max(0, len(left) - w), min(len(right), w)
            win = self._tokens(word, left[i][1], right[j - 1][2])
            if i == 0 or win[0] == left[i]:
                if j == len(right):
                    return left[:i] + win
                at = {t: k for k, t in enumerate(right[:j])}
                for p in range(len(win) - 2, 0, -1):     # the last token ends at a cut
                    if (k := at.get(win[p])) is not None:
                        return left[:i] + win[:p] + right[k:]
            w *= 2

    def word(self, word: str) -> list[int]:
        self.trees += 1
        cuts = [0]

        def halve(a: int, b: int) -> None:
            if b - a <= self.leaf:
                cuts.append(b)
            else:
                halve(a, (a + b) // 2)
                halve((a + b) // 2, b)
        halve(0, len(word))
        spans = list(zip(cuts, cuts[1:], strict=False))
        level = [[(t, x + a, y + a) for t, (x, y) in zip(e.ids, e.offsets, strict=True)]
                 for (a, _), e in zip(spans, self.bare.encode_batch([word[a:b] for a, b in spans],
                                                                    add_special_tokens=False), strict=True)]
        level = [t for t in level if t]
        while len(level) > 1:
            level = [self.join(word, *level[k:k + 2]) if k + 1 < len(level) else level[k]
                     for k in range(0, len(level), 2)]
        return [t[0] for t in level[0]] if level else []

    def long_chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for part in (self.cut.split(chunk) if self.cut else [chunk]):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                    ids += self.word(w) if len(w) > self.leaf else [t.id for t in self.tok.model.tokenize(w)]
        return ids

    # ---- texts -----------------------------------------------------------------------------
    def learn(self, chunks: set[str]) -> dict[str, tuple[bytes, str]]:
        """Ids and decoded text of the chunks: short ones are remembered, within ``cache`` bytes; long ones are not."""
        if self.known_bytes > self.cache:
            self.known.clear()
            self.known_bytes = 0
        new = [c for c in chunks if c not in self.known]
        got: dict[str, tuple[bytes, str]] = {}
        if self.pattern:
            rest = []
            for c in new:
                if len(c) <= self.leaf and LATIN.fullmatch(c) and not (self.cut and self.cut.search(c)):
                    got[c] = self._latin(c)
                else:
                    rest.append(c)
            new = rest
        short = [c for c in new if len(c) <= self.leaf or not self.tree]
        every = list(zip(short, (e.ids for e in self.tok.encode_batch_fast(short, add_special_tokens=False)), strict=True))
        every += [(c, self.long_chunk(c)) for c in new if len(c) > self.leaf and self.tree]
        decoded = (self.tok.decode_batch([i for _, i in every], skip_special_tokens=False)
                   if self.tok.decoder is None else [""] * len(every))
        for (c, ids), d in zip(every, decoded, strict=True):
            got[c] = (array("i", ids).tobytes(), d)
        long = {}
        for c, x in got.items():
            if len(c) > max(self.leaf, 256):
                long[c] = x
            else:
                self.known[c] = x
                self.known_bytes += 250 + 4 * len(c) + len(x[0]) + 4 * len(x[1])
        return long

    def encode_decode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids as int32 bytes, and ``decode(ids, skip_special_tokens=False)``, for each text."""
        split = [SPLIT.split(t) if "\t" in t or "\r" in t or "\n" in t else t.split(" ") for t in texts]
        long = self.learn({c for s in split for c in s if c})
        ids, out, known = [], [], self.known
        for s in split:
            got = [known.get(c) or long[c] for c in s if c]
            ids.append(b"".join([g[0] for g in got]))
            out.append(" ".join([g[1] for g in got if g[0]]) if self.tok.decoder is None else None)
        if self.tok.decoder is not None:
            out = self.tok.decode_batch([np.frombuffer(i, np.int32).tolist() for i in ids], skip_special_tokens=False)
        return ids, out


def bpe_encode_decode(df: DataFrame, path: str, text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``df`` with ``ids`` (array<int>), ``n_tokens`` and ``decoded`` for each whole text.

    No shuffle: rows are encoded where they are read, in batches bounded by bytes. Null is the empty
    text, which has no ids and decodes to the empty string; repeated rows give repeated results;
    columns named like a result are replaced.
    """
    common.bound_batches(df.sparkSession, 4 << 20)

    def start():
        enc = TreeEncoder(path, leaf)

        def step(b):
            ids, dec = enc.encode_decode([t.decode("utf-8", "replace") for t in
                                          common.texts(b.column(b.schema.get_field_index(text_col)))])
            n = np.array([len(i) // 4 for i in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)),
                                             pa.array(np.frombuffer(b"".join(ids), np.int32)))
            return lists, pa.array(n), pa.array(dec, pa.string())
        return step

    return common.arrow_columns(df, start, "ids array<int>, n_tokens long, decoded string", no_gc=True)
