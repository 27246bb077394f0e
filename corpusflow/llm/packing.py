"""Best-fit packing with several permitted sequence lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
SHARD = 50_000       # pieces packed together by one task
OVERHEAD = 16        # cost of a bin beside its length, so that many small bins are not free


class Lengths:
    """Multiset of waiting lengths: the longest that fits, in a sorted list of distinct lengths."""

    def __init__(self, lengths):
        self.n: dict[int, int] = {}
        for x in lengths:
            self.n[x] = self.n.get(x, 0) + 1
        self.sorted = sorted(self.n)

    def remove(self, x: int) -> None:
        self.n[x] -= 1
        if not self.n[x]:
            del self.n[x]
            del self.sorted[bisect_left(self.sorted, x)]

    def fill(self, room: int) -> int:
        """Tokens that the waiting lengths, longest first, would put into ``room``."""
        left, at = room, bisect_right(self.sorted, room)
        while left and at:
            at = min(at, bisect_right(self.sorted, left)) - 1
            x = self.sorted[at] if at >= 0 else 0
            if x <= 0:
                break
            left -= x * min(self.n[x], left // x)
        return room - left


def cost(capacity: int) -> int:
    return capacity + OVERHEAD


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, offset of each item, capacity of each bin); lengths are 0..max(capacities).

    Longest first. An item goes to the open bin it leaves least room in (of equal rooms, the bin filled last). If none fits, a bin opens:
    of all permitted lengths the one of least cost per token that it could hold, the waiting
    lengths taken into account (ties: the shorter). At the end each bin shrinks to the shortest
    permitted length that holds its contents.
    """
    caps = sorted(capacities)
    waiting = Lengths(lengths)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    cap: list[int] = []
    rooms: list[int] = []                 # distinct rooms of open bins, sorted
    by_room: dict[int, list[int]] = {}

    def put_back(b: int) -> None:
        r = cap[b] - used[b]
        if r not in by_room:
            by_room[r] = []
            insort(rooms, r)
        by_room[r].append(b)

    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        x = lengths[k]
        waiting.remove(x)
        at = bisect_left(rooms, x)
        if at < len(rooms):
            r = rooms[at]
            b = by_room[r].pop()
            if not by_room[r]:
                del by_room[r]
                del rooms[at]
        else:
            b = len(used)
            used.append(0)
            cap.append(min((c for c in caps if c >= x), key=lambda c: (cost(c) / max(1, x + waiting.fill(c - x)), c)))
        bins[k], offsets[k] = b, used[b]
        used[b] += x
        put_back(b)
    return bins, offsets, [caps[bisect_left(caps, u)] for u in used]


def best_fit_packing(df: DataFrame, length: str, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES,
                     shard: int = SHARD) -> DataFrame:
    """Pack rows of ``length`` (an SQL expression, tokens) into bins of permitted lengths.

    Rows longer than the longest capacity are cut in pieces of it and a rest. Pieces are dealt by
    hash of their place in a written table to shards of about ``shard`` pieces, so that neither null
    ids nor repeated rows gather in one; each shard is packed on its own, no task or group grows
    with the table, and the waste is one shard's tail. Returns a row per piece: id, piece,
    start (in the document), length, bin_id, bin_offset, capacity.

    A null or negative length is 0; a piece of length 0 takes no room but has a bin. Repeated rows
    are packed as often as they come; null ids are kept; an empty table gives an empty result; no
    other columns are read.
    """
    top = max(capacities)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(F.expr(length).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    pieces = rows.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / top) - 1))).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * top).alias("start"),
                           F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("length")).checkpoint()
    shards = max(1, -(-pieces.count() // shard))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, offsets, caps = pack(g["length"].tolist(), capacities)
        return pd.DataFrame({"id": g["id"], "piece": g["piece"], "start": g["start"], "length": g["length"],
                             "bin_id": g["shard"].astype("int64") * (1 << 32) + pd.Series(bins, dtype="int64"),
                             "bin_offset": offsets, "capacity": [caps[b] for b in bins]})

    out = (pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(shards)))
           .groupBy("shard").applyInPandas(run, "id long, piece long, start long, length long, bin_id long, bin_offset long, capacity long"))
    return out.withColumnRenamed("id", id_col)
