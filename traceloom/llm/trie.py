"""Prefix trie of conversations by vertical bitmaps.

Conversations, in order of their ids, are cut into shards of a bounded number of turns. A shard indexes each
(position, turn) to the bitset of its conversations that have this turn there. Depth first, a node's bitset is
intersected with the postings of the next position: each intersection that isn't empty is a child, its
popcount the child's members, and its intersection with the conversations of that length the list of those that end
there. A node is known everywhere by the MD5 of its path, so the nodes of all shards add up in one aggregation.

Sums over subtrees take no round per level: every node belongs to the shard that holds its smallest member, where all
its ancestors have a node too. A shard numbers its nodes depth first, so a subtree is a range of numbers, and
the shards' sums of what they own add up to the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, STRING, schema, written

ROOT = hashlib.md5(b"").digest()
NODES = schema(
    ("shard", LONG), ("at", LONG), ("after", LONG), ("node", T.BinaryType()), ("parent", T.BinaryType()), ("depth", LONG), ("first", LONG), ("n_convs", LONG),
    ("n_chars", LONG), ("ends", T.ArrayType(LONG)),
)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn, null first), key (MD5 of role and text), n (code points of the text).

    Null roles and texts read as empty, null conv_ids as -1; turns with the same number go by their key. No other column is read.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(-1)).alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("key"), F.length(text).cast("long").alias("n"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "key", "n")


def with_borrowed_heads(rows: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % ``block`` (all if fewer), h = crc32 of c in decimal, modulo ``heads``.

    ``rows`` as ``turns`` gives them. A conversation that is left without turns has one row with pos -1 and a null key.
    """
    rows = written(rows, "conversation-turns")
    base = F.col("conv_id") - F.col("conv_id") % block
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = rows.where((F.col("conv_id") % block == 0) & (F.col("pos") < heads - 1))
    lengths = first.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("held"))
    convs = rows.where("pos = 0").select("conv_id", base.alias("base"), h.alias("h"))
    own = (
        rows.withColumns({"base": base, "h": h}).where("pos >= h").join(lengths, "base", "left")
        .select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("held", F.lit(0)))).alias("pos"), "key", "n")
    )
    lent = convs.join(first.select(F.col("conv_id").alias("base"), "pos", "key", "n"), "base").where("pos < h").select("conv_id", "pos", "key", "n")
    there = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("n"))
    return own.unionByName(lent).unionByName(there)


class Shard:
    """The postings of a few conversations, and their trie."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, keys: list[bytes], n: np.ndarray):
        """Conversations in order of ``ids``; each has ``size`` of the ``keys`` (turns) in order."""
        self.ids, self.keys, self.n = ids.tolist(), keys, n.tolist()
        self.start, self.size = (np.cumsum(size) - size).tolist(), size.tolist()
        depth = max(self.size, default=0) + 1
        self.postings: list[dict[bytes, int]] = [{} for _ in range(depth)]
        self.ending = [0] * depth
        for i, (at, k) in enumerate(zip(self.start, self.size)):
            bit = 1 << i
            self.ending[k] |= bit
            for pos, key in enumerate(keys[at : at + k]):
                self.postings[pos][key] = self.postings[pos].get(key, 0) | bit

    def _ids(self, members: int) -> list[int]:
        out = []
        while members:
            low = members & -members
            out.append(self.ids[low.bit_length() - 1])
            members ^= low
        return out

    def nodes(self) -> Iterator[tuple]:
        """Rows of NODES without shard and after, depth first, with the number of the parent's row in place of ``at``."""
        stack, at = [((1 << len(self.ids)) - 1, 0, ROOT, None, 0, -1)], 0
        while stack:
            members, depth, node, parent, n, above = stack.pop()
            ends = members & self.ending[depth]
            yield above, node, parent, depth, self.ids[(members & -members).bit_length() - 1], members.bit_count(), n, self._ids(ends) if ends else None
            left = members ^ ends
            while left:
                i = (left & -left).bit_length() - 1
                turn = self.start[i] + depth
                key = self.keys[turn]
                child = left & self.postings[depth][key]  # of a node's members, those that go on with this turn
                stack.append((child, depth + 1, hashlib.md5(node + key).digest(), node, self.n[turn], at))
                left ^= child
            at += 1

    def table(self) -> pd.DataFrame:
        rows = list(self.nodes())
        above = [r[0] for r in rows]
        size = [1] * len(rows)
        for at in range(len(rows) - 1, 0, -1):
            size[above[at]] += size[at]
        after = [at + k if at + k < len(rows) else None for at, k in enumerate(size)]
        out = pd.DataFrame([r[1:] for r in rows], columns=["node", "parent", "depth", "first", "n_convs", "n_chars", "ends"])
        return out.assign(shard=self.ids[0], at=range(len(rows)), after=pd.array(after, dtype="Int64"))[NODES.names]


def _chain(conv: int, at: int, node: bytes, parts: list[tuple[list[bytes], list[int]]], over: bool) -> tuple[pd.DataFrame, int, bytes]:
    """Rows of a shard of one long conversation from depth ``at`` + 1 on, the depth reached and its node; ``over``: it ends there."""
    rows = []
    for keys, n in parts:
        for key, k in zip(keys, n):
            child, at = hashlib.md5(node + key).digest(), at + 1
            rows.append((conv, at, None, child, node, at, conv, 1, k, None))
            node = child
    if over and rows:
        rows[-1] = (*rows[-1][:-1], [conv])
    return pd.DataFrame(rows, columns=NODES.names), at, node


def shards(rows: DataFrame, most: int) -> DataFrame:
    """Rows of NODES of all shards: each of at most about ``most`` turns, or one longer conversation, which goes through in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n_held, chain = 0, None  # of a conversation longer than a shard: its id, the depth reached, the node there

        def tries(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """Of whole conversations: cut where the next one would take a shard beyond its size."""
            conv = part["conv_id"].to_numpy()
            ids, start = np.unique(conv, return_index=True)
            real = (part["pos"] >= 0).to_numpy()
            size = np.add.reduceat(real.astype(np.int64), start) if len(ids) else np.zeros(0, np.int64)
            keys, n = part["key"][real].tolist(), part["n"].to_numpy()[real]
            turn = np.concatenate([[0], np.cumsum(size)])
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(turn, turn[at] + most, side="right")) - 1)
                yield Shard(ids[at:to], size[at:to], keys[turn[at] : turn[to]], n[turn[at] : turn[to]]).table()
                at = to

        for batch in batches:
            while len(batch):
                if chain is not None:
                    conv, at, node = chain
                    own = int(np.searchsorted(batch["conv_id"].to_numpy(), conv, side="right"))
                    over = own < len(batch)
                    piece = batch[:own]
                    # the piece held back is written once the next one shows whether the conversation ends with it
                    if len(piece):
                        held.append(piece)
                    while held and (len(held) > 1 or over):
                        table, at, node = _chain(conv, at, node, [(held[0]["key"].tolist(), held[0]["n"].tolist())], over and len(held) == 1)
                        held.pop(0)
                        yield table
                    chain = None if over else (conv, at, node)
                    batch = batch[own:]
                    continue
                held.append(batch)
                n_held += len(batch)
                batch = batch[:0]
                if n_held >= most:
                    both = pd.concat(held, ignore_index=True)
                    conv = both["conv_id"].to_numpy()
                    last = int(np.searchsorted(conv, conv[-1]))
                    if last:
                        yield from tries(both[:last])
                    both = both[last:].reset_index(drop=True)
                    held, n_held = [both], len(both)
                    if n_held >= most:
                        yield pd.DataFrame([(int(conv[-1]), 0, None, ROOT, None, 0, int(conv[-1]), 1, 0, None)], columns=NODES.names)
                        held, n_held, chain = [both[both["pos"] >= 0]], 0, (int(conv[-1]), 0, ROOT)
        if chain is not None:
            conv, at, node = chain
            table, _, _ = _chain(conv, at, node, [(h["key"].tolist(), h["n"].tolist()) for h in held], True)
            yield table
        elif held:
            yield from tries(pd.concat(held, ignore_index=True))

    return rows.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos").mapInPandas(run, NODES)


def _digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: the ids that end at a node, ascending, comma-joined. Shards hold ranges of ids: their lists follow one another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            nodes, out = [], []
            for at, ids in zip(batch["node"], batch["ends"]):
                text = ",".join(map(str, ids)).encode()
                if at == node:
                    state.update(b"," + text)
                    continue
                if node is not None:
                    nodes.append(node)
                    out.append(state.hexdigest())
                node, state = at, hashlib.sha256(text)
            if nodes:
                yield pd.DataFrame({"node": nodes, "ends_sha256": out})
        if node is not None:
            yield pd.DataFrame({"node": [node], "ends_sha256": [state.hexdigest()]})

    sorted_lists = ends.select("node", F.col("ends")[0].alias("_first"), "ends").repartition("node").sortWithinPartitions("node", "_first")
    return sorted_lists.mapInPandas(run, schema(("node", T.BinaryType()), ("ends_sha256", STRING)))


def prefix_trie(rows: DataFrame, most: int = 20_000) -> DataFrame:
    """The nodes of the trie of all conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and node (MD5 of the path).

    ``rows``: conv_id, pos (gapless from 0), key, n; a conversation without turns has one row with pos -1. Turns are the same where
    their keys are. ``saved_tokens`` sums n times (members - 1) over the subtree; ``n_leaves`` counts its childless
    nodes; ``ends_sha256`` is of the ids of the conversations that end there. The root stands for no turn; without any
    conversation there is no node. A conversation longer than a shard is a shard of its own and goes through in
    pieces, so memory is bounded whatever the lengths; the ids that end at one node are hashed as a stream.
    """
    part = written(shards(rows, most), "trie-shards")
    whole = part.groupBy("node").agg(
        F.min("first").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("n_chars").alias("n_chars")
    )
    whole = written(whole, "trie-nodes")
    children = whole.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")).where("node is not null")
    above = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = whole.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(above, "parent", "left")
    whole = written(whole.withColumn("value", (F.col("n_convs") - 1) * F.col("n_chars")), "trie-nodes")
    # what a shard owns, summed from each number to the end of its nodes
    mine = F.col("first") == F.col("conv_id")
    owned = part.select("shard", "at", "after", "node", "first").join(whole.select("node", "conv_id", "value", "n_children"), "node").select(
        "shard", "at", "after", "node", F.when(mine, F.col("value")).otherwise(0).alias("value"), (mine & (F.col("n_children") == 0)).cast("long").alias("leaf")
    )
    onward = Window.partitionBy("shard").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = written(owned.select("shard", "at", "after", "node", F.sum("value").over(onward).alias("value"), F.sum("leaf").over(onward).alias("leaf")), "trie-sums")
    beyond = sums.select("shard", F.col("at").alias("after"), F.col("value").alias("value_beyond"), F.col("leaf").alias("leaf_beyond"))
    subtree = sums.join(beyond, ["shard", "after"], "left").groupBy("node").agg(
        F.sum(F.col("value") - F.coalesce("value_beyond", F.lit(0))).alias("saved_tokens"), F.sum(F.col("leaf") - F.coalesce("leaf_beyond", F.lit(0))).alias("n_leaves")
    )
    none = hashlib.sha256(b"").hexdigest()
    return whole.join(subtree, "node").join(_digests(part.where("ends is not null")), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "node"
    )
