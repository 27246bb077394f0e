"""Token counts: lengths only, from byte-balanced batches of safely split texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SEGMENT = re.compile("[ ▁]+[^ ▁]*")   # U+2581 is the library's own sign for a space
CACHE = 96 << 20                      # bytes of segments remembered by a task
SHORT = 256                           # characters of a segment that is remembered
BATCH = 128 << 10


class PieceCounter:
    """Counts pieces of a BPE model of sentencepiece.

    A boundary before a run of spaces is safe if no piece of the vocabulary holds a space sign after
    another character (checked against the model; without it texts are not split). Each segment is a
    run of spaces and the characters up to the next one; the library's own dummy prefix stands for
    its first space. Segments not met before are encoded in batches of equal bytes, and only their
    numbers of pieces are kept, those of short segments within ``cache`` bytes for later texts.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces) and self.sp.encode("a  b a ", out_type=str) == \
            self.sp.encode("a", out_type=str) + ["▁"] + self.sp.encode("b", out_type=str) + self.sp.encode("a", out_type=str) + ["▁"]
        self.cache, self.known, self.size = cache, {}, 0

    def _lengths(self, items: list[str]) -> list[int]:
        out, batch, size = [], [], 0
        for t in [*items, None]:
            if batch and (t is None or size + len(t) > BATCH):
                out += map(len, self.sp.encode(batch, num_threads=1))
                batch, size = [], 0
            if t is not None:
                batch.append(t)
                size += len(t)
        return out

    def _split(self, text: str) -> list[str]:
        """Segments without their first space; runs of spaces without characters keep a mark."""
        if not text:
            return []
        if "  " not in text and "▁" not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [s if not s.strip(" ▁") else s[1:] for s in SEGMENT.findall(" " + text)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self._lengths(texts)
        split = [self._split(t) for t in texts]
        known = self.known
        if self.size > self.cache:
            known.clear()
            self.size = 0
        new = [s for s in set().union(*split) if s not in known]
        blank = [s for s in new if not s.strip(" ▁")]
        words = [s for s in new if s.strip(" ▁")]
        got = dict(zip(words, self._lengths(words), strict=True))
        one = self._lengths(["a"])[0]
        got.update((s, n - one) for s, n in zip(blank, self._lengths(["a" + s for s in blank]), strict=True))
        long = {}
        for s, n in got.items():
            if len(s) > SHORT:
                long[s] = n
            else:
                known[s] = n
                self.size += 120 + 4 * len(s)
        return [sum([known[x] if x in known else long[x] for x in s]) for s in split]


def token_counts(df: DataFrame, path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` for each whole text.

    ``path`` is a sentencepiece ``.model``. Counts are without begin and end tokens. No shuffle, and
    only lengths return. Null is the empty text (0 bytes, 0 tokens); repeated rows give repeated
    results; an empty table gives an empty result; columns named like a result are replaced.
    """
    common.bound_batches(df.sparkSession)

    def start():
        counter = PieceCounter(path)

        def step(b):
            raw = common.texts(b.column(b.schema.get_field_index(text_col)))
            n = counter.count([t.decode("utf-8", "replace") for t in raw])
            return (pa.array([len(t) for t in raw], pa.int64()), pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()))
        return step

    return common.arrow_columns(df, start, "n_bytes long, n_tokens long, over_limit boolean", no_gc=True)
