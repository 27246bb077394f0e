"""Prefix trie of conversations by vertical bitmaps.

A turn is the SHA-256 digest (16 bytes of it) of its role and text, so texts are read once and never
shuffled; a node is the digest of its parent and its last turn, so equal prefixes meet wherever they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import ensure_checkpoint_dir

SHARD_IDS = 2048            # conversations of a shard: the width of its bitsets
SHARD_TURNS = 1 << 15       # turns of a shard, unless one conversation alone has more
ROOT = bytes(16)

_NODES = ("k binary, parent binary, depth long, first long, n long, size long, inner boolean, ends string, shard long")
_MERGED = ("k binary, parent binary, depth long, first long, n long, size long, inner boolean, ends string, shard long, owner boolean")
_PARTS = ("k binary, conv_id long, depth long, parent_conv_id long, n_convs long, ends string, "
          "children long, leaves long, saved long")


def sequences(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, steps): each conversation's turns in order, as (d: digest of role and text, n: UTF-8 bytes of the text).

    Order is by turn, null first; turns of equal number stand in the order of their digests, repeated rows
    are turns of their own. Null role or text is the empty string; rows without a conversation id take no part.
    One row holds one conversation: 24 bytes a turn, however long its texts.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("t"), digest.alias("d"),
                     F.octet_length(text).cast("long").alias("n")).where("conv_id is not null")
    steps = F.transform(F.sort_array(F.collect_list(F.struct("t", "d", "n"))), lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n")))
    return rows.groupBy("conv_id").agg(steps.alias("steps"))


def share_starts(seq: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """Conversations that start as another one does: conversation c gets the first h turns of c - c % ``every``
    (all if it has fewer, none if it is absent), then its own turns after its first h; h is
    crc32(decimal c) % (``most`` + 1). Remainders have the sign of c, as in SQL."""
    base = seq.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("steps", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    none = F.expr("cast(array() as array<struct<d: binary, n: bigint>>)")
    own = F.when(F.size("steps") > F.col("h"), F.expr("slice(steps, h + 1, size(steps))")).otherwise(none)
    return (seq.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(base, "base", "left")
            .select("conv_id", F.concat(F.coalesce(F.expr("slice(head, 1, h)"), none), own).alias("steps")))


def shard_nodes(ids: list[int], turns: list[list[bytes]], sizes: list[list[int]]) -> Iterator[tuple]:
    """The trie of one shard: (k, parent, depth, first, n, size, inner, ends) per node, ids ascending.

    (position, turn) is indexed to the bitset of its conversations. Depth first, a node's bitset met with the
    posting of the turn that its lowest conversation not yet placed has next gives a child; the popcount is the
    number of members, and the meet with the conversations of just this length gives the list of ends.
    """
    posts, long = {}, {}
    for i, t in enumerate(turns):
        bit = 1 << i
        long[len(t)] = long.get(len(t), 0) | bit
        for key in enumerate(t):
            posts[key] = posts.get(key, 0) | bit
    stack = [(ROOT, None, 0, (1 << len(ids)) - 1, 0)]
    while stack:
        k, parent, depth, bits, size = stack.pop()
        ends = bits & long.get(depth, 0)
        rest = bits ^ ends
        yield k, parent, depth, ids[(bits & -bits).bit_length() - 1], bits.bit_count(), size, rest != 0, _decimals(ids, ends)
        while rest:
            i = (rest & -rest).bit_length() - 1
            turn = turns[i][depth]
            child = bits & posts[depth, turn]
            rest ^= child
            stack.append((hashlib.sha256(k + turn).digest()[:16], k, depth + 1, child, sizes[i][depth]))


def _decimals(ids: list[int], bits: int) -> str | None:
    out = []
    while bits:
        out.append(str(ids[(bits & -bits).bit_length() - 1]))
        bits &= bits - 1
    return ",".join(out) if out else None


def _batches(rows, schema, most: int = 8192):
    """Record batches of an iterator of tuples."""
    part = []
    for r in rows:
        part.append(r)
        if len(part) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def prefix_trie(seq: DataFrame, shard_ids: int = SHARD_IDS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the prefix trie of ``seq`` (conv_id, steps as :func:`sequences` gives them, ids distinct).

    Per distinct sequence of first d turns (the root: d = 0): ``conv_id``, smallest member; ``depth``;
    ``parent_conv_id``, the parent's conv_id (root: null); ``n_convs``, members; ``n_children``; ``n_leaves``, childless nodes of
    the subtree with its top; ``saved_tokens``, over the subtree, (n_convs - 1) * bytes of the last text;
    ``ends_sha256``, SHA-256 of the decimal ids of the members that end here, ascending and comma-joined.

    Conversations lie in shards of adjoining ids, bounded by number and turns, so a first turn or a whole
    conversation that a third of all share is spread like any other. Each shard builds its own trie; nodes meet
    by key (a node has one row per shard), ends are hashed as a stream in shard order; merged values go back to
    the shards, where each node counts once, for the shard of its smallest member, in the sums of the
    prefixes there; those partial sums are added by key. Five shuffles of narrow rows, no loop over depth, nothing
    on the driver. A conversation without turns is a member of the root. An empty table has no nodes.
    """
    ensure_checkpoint_dir(seq.sparkSession)
    nodes, merged, parts = _schema(_NODES), _schema(_MERGED), _schema(_PARTS)

    def build(batches):
        def rows():
            ids, turns, sizes, total = [], [], [], 0
            for b in batches:
                for i, t, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if ids and (len(ids) >= shard_ids or total + len(t) > shard_turns):
                        yield from ((*x, ids[0]) for x in shard_nodes(ids, turns, sizes))
                        ids, turns, sizes, total = [], [], [], 0
                    ids.append(i)
                    turns.append(t)
                    sizes.append(n)
                    total += len(t)
            if ids:
                yield from ((*x, ids[0]) for x in shard_nodes(ids, turns, sizes))
        return _batches(rows(), nodes)

    def merge(batches):
        """Rows by (k, shard): the first shard of a key holds its smallest member."""
        def close(key, head, n, inner, digest, shards):
            for j, s in enumerate(shards):
                yield *key, head[0], n, head[1], inner, digest.hexdigest() if j == 0 else None, s, j == 0

        def rows():
            k = None
            for r in _rows(batches):
                if r[0] != k:
                    if k is not None:
                        yield from close(key, head, n, inner, digest, shards)
                    k, key, head, n, inner, digest, shards, some = r[0], r[:3], (r[3], r[5]), 0, False, hashlib.sha256(), [], False
                n, inner = n + r[4], inner or r[6]
                if r[7]:
                    digest.update(((b"," if some else b"") + r[7].encode()))
                    some = True
                shards.append(r[8])
            if k is not None:
                yield from close(key, head, n, inner, digest, shards)
        return _batches(rows(), merged)

    def add(batches):
        """Rows by (shard, depth descending): sums over the prefixes of a shard."""
        def close(of):
            first = {r[0]: r[3] for r in of}
            sums = {}
            for k, parent, depth, conv, n, size, inner, ends, _, owner in of:
                children, leaves, saved = sums.pop(k, (0, 0, 0))
                if owner:
                    leaves, saved = leaves + (not inner), saved + (n - 1) * size
                if parent is not None:
                    c, x, y = sums.get(parent, (0, 0, 0))
                    sums[parent] = (c + owner, x + leaves, y + saved)
                if owner:
                    yield k, conv, depth, first.get(parent), n, ends, children, leaves, saved
                elif children or leaves:
                    yield k, None, None, None, None, None, children, leaves, saved

        def rows():
            shard, of = None, []
            for r in _rows(batches):
                if r[8] != shard:
                    yield from close(of)
                    shard, of = r[8], []
                of.append(r)
            yield from close(of)
        return _batches(rows(), parts)

    flat = seq.select("conv_id", F.col("steps")["d"].alias("d"), F.col("steps")["n"].alias("n"))
    # written: the cuts between shards must not move when a lost task runs again
    local = flat.repartitionByRange("conv_id").sortWithinPartitions("conv_id").mapInArrow(build, _NODES).checkpoint()
    met = local.repartition("k").sortWithinPartitions("k", "shard").mapInArrow(merge, _MERGED)
    back = met.repartition("shard").sortWithinPartitions("shard", F.desc("depth")).mapInArrow(add, _PARTS)
    return (back.groupBy("k").agg(*(F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")), F.sum("children").alias("n_children"),
                                  F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("ends").alias("ends_sha256"))
            .drop("k"))
