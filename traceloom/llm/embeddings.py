"""Embedding near-duplicates by navigable small-world graphs, one hierarchy a shard.

Vectors are dealt to shards; each shard builds a hierarchical graph in numpy, batch by batch, and
keeps it in a table. Blocks of vectors are then sent to every shard, to one of the tasks that hold a copy of
its graph, streamed past it, and searched together, a step of all their beams at a time. A beam that is full of links is searched
again twice as wide, and beams widen until an audit of the shard against brute force reaches the
wanted recall. Cosines are verified in double precision. What leaves a task is a count for
each vector and a spanning forest of the block's links, never all pairs; components are united
across blocks and shards. Equal vectors are one node.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, components, schema, written

BLOCK = 512  # vectors put into a graph together
ASKED = 2048  # vectors that look for links together
SHARD = 150_000  # vectors of a shard, while there are not too many shards
PAIRS = 1 << 27  # of a vector that asks and a node, marked at once
BINARY = T.BinaryType()


class Graph:
    """Hierarchy of neighbour graphs over unit vectors; level k holds the first ``n >> (4 * k)`` of them."""

    def __init__(self, x: np.ndarray, degree: int = 16, beam: int = 48):
        self.x, self.degree, self.beam = x.astype(np.float32), degree, beam
        sizes = [len(x)]
        while sizes[-1] > 256:
            sizes.append(sizes[-1] >> 4)
        self.levels: list[np.ndarray] = []
        for size in reversed(sizes):
            self.levels.insert(0, np.zeros((0, 2 * degree), np.int32))
            self._build(size)

    def _build(self, n: int) -> None:
        """Fills the lowest level so far, by inserting batches that at most double it."""
        graph = np.full((n, 2 * self.degree), -1, np.int32)
        start = min(n, 256)
        sims = self.x[:start] @ self.x[:start].T
        np.fill_diagonal(sims, -9)
        near = np.argsort(-sims, axis=1)[:, : self.beam].astype(np.int32)
        self.levels[0] = graph
        self._join(np.arange(start), near)
        at = start
        while at < n:
            new = np.arange(at, min(n, at + min(at, BLOCK)))
            found, _ = self.search(self.x[new], self.beam, limit=at)
            sims = self.x[new] @ self.x[new].T
            np.fill_diagonal(sims, -9)
            k = min(len(new), self.beam // 2)
            own = np.argpartition(-sims, k - 1, axis=1)[:, :k] + at
            self._join(new, np.concatenate([found, own.astype(np.int32)], axis=1))
            at = new[-1] + 1
        if len(self.levels) > 1:
            self._reach(len(self.levels[1]))

    def _reach(self, roots: int) -> None:
        """Nodes that no walk from the level above meets, as all links back to them were dropped, get one from the nearest of their own that is met."""
        graph = self.levels[0]
        met = np.zeros(len(graph), dtype=bool)

        def walk(front: np.ndarray) -> None:
            while len(front):
                met[front] = True
                front = np.unique(graph[front])
                front = front[front >= 0]
                front = front[~met[front]]

        walk(np.arange(roots))
        for node in np.flatnonzero(~met):
            if met[node]:
                continue
            own = graph[node][graph[node] >= 0]
            own = own[met[own]] if met[own].any() else np.flatnonzero(met)
            near = own[np.argmax(self.x[own] @ self.x[node])]
            place = (graph[near] >= 0).sum()
            if place == graph.shape[1]:
                graph = np.pad(graph, ((0, 0), (0, 1)), constant_values=-1)
            graph[near, place] = node
            walk(np.array([node]))
        self.levels[0] = graph

    def _join(self, new: np.ndarray, candidates: np.ndarray) -> None:
        graph, width = self.levels[0], 2 * self.degree
        kept = self._spread(new, candidates, self.degree)
        graph[new, : self.degree] = kept
        # links back: what a node has and is offered, spread again where it is too much, nodes with about as much together
        to, back = kept.ravel(), np.repeat(new, kept.shape[1]).astype(np.int32)
        more = (to >= 0) & ~(graph[to] == back[:, None]).any(axis=1)
        if not more.any():
            return
        order = np.argsort(to[more], kind="stable")
        to, back = to[more][order], back[more][order]
        start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        nodes, offered = to[start], np.diff(np.r_[start, len(to)])
        have = (graph[nodes] >= 0).sum(axis=1)
        of = np.repeat(np.arange(len(nodes)), offered)
        place = np.arange(len(to)) - start[of] + have[of]
        every = have + offered
        room = (every <= width)[of]
        graph[to[room], place[room]] = back[room]
        wide = width
        while (every > wide).any():
            wide *= 2
            some = np.flatnonzero((every > max(width, wide // 2)) & (every <= wide))
            for at in range(0, len(some), most := max(1, 4_000_000 // wide**2)):
                own = some[at : at + most]
                row = np.full(len(nodes), -1)
                row[own] = np.arange(len(own))
                candidates = np.full((len(own), wide), -1, np.int32)
                candidates[:, :width] = graph[nodes[own]]
                mine = np.flatnonzero(row[of] >= 0)
                candidates[row[of[mine]], place[mine]] = back[mine]
                graph[nodes[own]] = self._spread(nodes[own], candidates, width)

    def _spread(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Of each node's candidates those nearer to it than to any kept before, then the nearest of the rest."""
        x = self.x
        sims = np.where(candidates >= 0, np.einsum("bd,bkd->bk", x[nodes], x[candidates]), -9)
        sims[candidates == nodes[:, None]] = -9
        order = np.argsort(-sims, axis=1)
        candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
        repeat = np.zeros_like(candidates, dtype=bool)
        repeat[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
        sims[repeat] = -9
        own = x[candidates]
        between = own @ own.transpose(0, 2, 1)
        kept, n = np.zeros(candidates.shape, dtype=bool), np.zeros(len(nodes), np.int64)
        for k in range(candidates.shape[1]):
            kept[:, k] = (sims[:, k] > -2) & (n < most * 3 // 4) & ~(kept[:, :k] & (between[:, k, :k] > sims[:, k, None])).any(axis=1)
            n += kept[:, k]
        rank = np.where(kept, 0, np.where(sims > -2, 1, 2)) * candidates.shape[1] + np.arange(candidates.shape[1])
        pick = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(sims, pick, 1) > -2, np.take_along_axis(candidates, pick, 1), -1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def search(self, q: np.ndarray, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes met for each query (-1 pads), and their similarities."""
        q = q.astype(np.float32)
        first = self.levels[-1].shape[0]
        first = min(first, limit) if limit is not None else first
        sims = q @ self.x[:first].T
        entry = np.argpartition(-sims, min(3, first - 1), axis=1)[:, : min(4, first)].astype(np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            if k == len(self.levels) - 1 and k > 0:
                continue  # the top was compared whole
            width = beam if k == 0 else 8
            ids, sims = self._beam(self.levels[k], q, entry, width)
            entry = ids[:, :4]
        return ids, sims

    def _beam(self, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        n = len(graph)
        wide = n + 1
        kind = np.int32 if len(q) * wide < 1 << 31 else np.int64
        seen = np.zeros(len(q) * wide, dtype=bool)  # (query, node) pairs as numbers, a query's last for -1
        seen[n::wide] = True
        ids = np.full((len(q), beam), -1, np.int32)
        sims = np.full((len(q), beam), -9, np.float32)
        done = np.ones((len(q), beam), dtype=bool)
        k = min(entry.shape[1], beam)
        ids[:, :k] = entry[:, :k]
        done[:, :k] = entry[:, :k] < 0
        sims[:, :k] = np.where(done[:, :k], -9, np.einsum("bd,bkd->bk", q, self.x[ids[:, :k]]))
        seen[(np.arange(len(q), dtype=kind) * wide)[:, None] + np.where(ids < 0, n, ids)] = True
        live = np.arange(len(q), dtype=kind)
        while len(live):
            s = np.where(done[live], -9, sims[live])
            pick = np.argpartition(-s, min(step, beam) - 1, axis=1)[:, :step] if beam > step else np.argsort(-s, axis=1)
            valid = np.take_along_axis(s, pick, 1) > -2
            going = valid.any(axis=1)
            live, pick, valid = live[going], pick[going], valid[going]
            if not len(live):
                break
            r = live[:, None]
            chosen = ids[r, pick][valid]
            done[r, pick] = True
            pairs = graph[chosen]
            pairs[pairs < 0] = n
            pairs = (pairs + (np.repeat(live, valid.sum(axis=1)) * kind(wide))[:, None]).ravel()
            pairs = np.sort(pairs[~seen[pairs]])
            if not len(pairs):
                continue
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
            seen[pairs] = True
            of = pairs // kind(wide)
            nodes = pairs - of * kind(wide)
            new = np.einsum("kd,kd->k", q[of], self.x[nodes])
            better = new > sims.min(axis=1)[of]  # the others would leave the beam at once
            of, nodes, new = of[better], nodes[better], new[better]
            if not len(of):
                continue
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            size = np.diff(np.r_[first, len(of)])
            row, place, own = np.repeat(np.arange(len(first)), size), np.arange(len(of)) - np.repeat(first, size), of[first]
            all_ids = np.concatenate([ids[own], np.full((len(own), size.max()), -1, np.int32)], axis=1)
            all_sims = np.concatenate([sims[own], np.full((len(own), size.max()), -9, np.float32)], axis=1)
            all_ids[row, beam + place], all_sims[row, beam + place] = nodes, new
            all_done = np.concatenate([done[own], all_ids[:, beam:] < 0], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[own] = np.take_along_axis(all_ids, best, 1)
            sims[own] = np.take_along_axis(all_sims, best, 1)
            done[own] = np.take_along_axis(all_done, best, 1)
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def linked(graph: Graph, exact: np.ndarray, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, node) pairs with cosine >= ``least`` in double precision; full beams are searched again, wider."""
    most = max(64, PAIRS // (len(exact) + 1))
    if len(q) > most:
        found = [linked(graph, exact, q[at : at + most], least, beam) for at in range(0, len(q), most)]
        return np.concatenate([a + k * most for k, (a, _) in enumerate(found)]), np.concatenate([b for _, b in found])
    near = np.float32(least - 1e-5)
    a, b, rows, n = [], [], np.arange(len(q)), len(exact)
    while len(rows):
        beam = min(beam, n)
        ids, sims = graph.search(q[rows], beam)
        full = (sims[:, -1] >= near) & (beam < n)
        ok = (sims >= near) & (ids >= 0) & ~full[:, None]
        i, j = np.nonzero(ok)
        i, j = rows[i], ids[i, j]
        for at in range(0, len(i), 100_000):
            u, v = i[at : at + 100_000], j[at : at + 100_000]
            true = np.einsum("kd,kd->k", q[u], exact[v]) >= least
            a.append(u[true])
            b.append(v[true])
        rows, beam = rows[full], beam * 2
    return np.concatenate(a or [rows]), np.concatenate(b or [rows])


def audited_beam(graph: Graph, exact: np.ndarray, least: float, beam: int, recall: float, audited: int) -> int:
    """``beam``, doubled until a search finds ``recall`` of the links that brute force finds; a vector's link to itself is none.

    Asks with the nodes put in last, which no upper level holds; a shard's nodes are a hash sample of the table. There are
    ``audited`` of them, or more, up to 16 times as many, until they have ``audited`` links.
    """
    n, rows, true = len(exact), np.zeros(0, np.int64), 0
    while len(rows) < min(n, 16 * audited) and true < audited:
        own = np.arange(max(0, n - len(rows) - audited), n - len(rows))
        true += int((exact[own] @ exact.T >= least).sum()) - len(own)
        rows = np.concatenate([rows, own])
    while beam < n:
        a, b = linked(graph, exact, exact[rows], least, beam)
        if int((rows[a] != b).sum()) >= recall * true:
            break
        beam *= 2
    return beam


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links a-b."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist()):
        x, y = find(u), find(v)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((u, v))
    return out


GRAPHS = schema(("shard", LONG), ("blob", BINARY))
SENT = schema(("task", LONG), ("kind", LONG), ("part", LONG), ("blob", BINARY))
FOUND = schema(("a", LONG), ("b", LONG), ("n", LONG))


def _unit(values) -> np.ndarray:
    x = np.array(list(values), dtype=np.float64)
    x = x.reshape(len(x), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Neither null nor zero, no null or non-finite component, a length that a double can hold."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & (square > 0) & (square < float("inf")), F.lit(False))


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, shards: int = 12, beam: int = 64, recall: float = 0.98, audited: int = 128
) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors`` (vec_id, embedding).

    n_links counts the other vectors found with cosine >= ``least``; component_id is the smallest vec_id
    reachable by links, itself included. Vectors that are null, zero or hold null or non-finite
    components link with nothing. Vectors of unequal dimension do not link. A null vec_id reads as -1.
    ``audited`` vectors of each shard or more are compared with all of it (see ``audited_beam``); its beams double until
    they find ``recall`` of the links. There are at most ``shards``: four, or as many as keep them below ``SHARD`` vectors. Choose
``shards`` so that a shard fits a task's memory.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(-1)).alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")), F.transform("v", lambda x: x + 0.0)))
    nodes = written(
        rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size")).withColumn("dim", F.size("v")), "vectors"
    )
    dims = [r.dim for r in nodes.select("dim").distinct().collect()]
    edges = None
    for dim in dims:
        own = nodes.where(F.col("dim") == dim)
        e = _compared(own, least, shards, beam, recall, audited)
        edges = e if edges is None else edges.unionByName(e)
    if edges is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    edges = written(edges, "vector-links")
    counts = edges.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    united = components(edges.where("b is not null").select("a", "b"))
    named = nodes.join(counts, "node", "left").join(united, "node", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    linking = rows.where("v is not null").join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linking.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _compared(nodes: DataFrame, least: float, shards: int, beam: int, recall: float, audited: int) -> DataFrame:
    """Rows (node, null, how many vectors link with it in one shard) and (a, b, null) of a spanning forest."""
    # each vector asks every shard, so there are few; each is asked by several tasks, with a copy of its graph
    n = nodes.count()
    shards = min(shards, max(4, -(-n // SHARD)))
    copies = max(1, min(24 // shards, -(-n // (8 * ASKED))))
    dealt = nodes.select("node", "size", "v", F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(shards)).cast("int").alias("shard"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [batch for batch in batches if len(batch)]
        for shard, batch in pd.concat(held).groupby("shard") if held else ():
            batch = batch.iloc[np.lexsort([batch["node"]])]
            batch = batch.iloc[np.random.default_rng(1).permutation(len(batch))]
            x = _unit(batch["v"])
            graph = Graph(x)
            width = audited_beam(graph, x, least, beam, recall, audited)
            graph.x = None  # ``x`` in single precision
            yield pd.DataFrame([(shard, pickle.dumps((graph, x, batch["node"].to_numpy(), batch["size"].to_numpy(), width), protocol=5))], columns=GRAPHS.names)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        copy = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, len(batch), ASKED):
                own = batch.iloc[at : at + ASKED]
                blob = pickle.dumps((own["node"].to_numpy(), _unit(own["v"])), protocol=5)
                copy = (copy + 1) % copies
                for s in range(shards):
                    yield pd.DataFrame([(s * copies + copy, 1, int(own["node"].iloc[0]), blob)], columns=SENT.names)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = None
        for batch in batches:
            for task, kind, blob in zip(batch["task"].tolist(), batch["kind"].tolist(), batch["blob"]):
                if kind == 0:
                    graph, exact, node, size, width = pickle.loads(blob)
                    here, graph.x = task, exact.astype(np.float32)
                    continue
                if task != here:  # a shard without vectors
                    continue
                ids, q = pickle.loads(blob)
                a, b = linked(graph, exact, q, least, width)
                other = ids[a] != node[b]
                a, b = a[other], b[other]
                n = np.bincount(a, size[b], len(ids)).astype(np.int64)
                has = np.flatnonzero(n)
                tree = _forest(ids[a], node[b])
                yield pd.DataFrame(
                    {
                        "a": pd.array([*ids[has].tolist(), *(u for u, _ in tree)], dtype="Int64"),
                        "b": pd.array([*[None] * len(has), *(v for _, v in tree)], dtype="Int64"),
                        "n": pd.array([*n[has].tolist(), *[None] * len(tree)], dtype="Int64"),
                    }
                )

    # a shard, or a copy of it, has a task of its own: dealt by a hash, several would share one
    graphs = written(dealt.repartitionById(shards, "shard").mapInPandas(build, GRAPHS), "vector-graphs")
    copied = graphs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
        (F.col("shard") * copies + F.col("copy")).alias("task"), F.lit(0).cast("long").alias("kind"), F.lit(0).cast("long").alias("part"), "blob"
    )
    blocks = nodes.select("node", "v").mapInPandas(block, SENT)
    sent = copied.unionByName(blocks).repartitionById(shards * copies, F.col("task").cast("int")).sortWithinPartitions("task", "kind", "part")
    return sent.mapInPandas(ask, FOUND)
