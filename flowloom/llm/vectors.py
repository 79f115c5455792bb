"""Near-duplicate vectors by range search on a robust-pruned flat graph.

Vectors of one label are compared, by cosine in double precision; those found with `LEAST` or more
are linked.

1. Equal vectors of a label are one node with a multiplicity.
2. Nodes of a label go to the shards of their `overlap` nearest centroids; labels of up to `TARGET`
   nodes are one shard. Centroids are fitted on a bounded sample: at most `SAMPLE` vectors in all
   and `CENTROIDS` centroids a label. A shard of more than `PART` nodes (centroids cannot split a
   crowd of near copies) is cut by a hash into parts.
3. In each part nodes are inserted batch by batch into a flat graph: a greedy beam search from the
   medoid gives a node's candidates, robust pruning (keep the nearest, drop those `ALPHA` times
   nearer to a kept one than to the node, fill up with the nearest dropped) its at most `DEGREE`
   neighbours, which get it as theirs.
4. A node's lists from all its shards are united.
5. Every node of a shard searches every part of it: its own part from where it stands, with `ROUNDS`
   rounds of its nearest, another part by a greedy beam search from the medoid; then
   expansion of all nodes in range (with some slack) along links of either direction until none is new. What is in range is verified
   in double precision. A pair that shares several shards counts in the first.
6. The recall is audited: `AUDIT` nodes, picked by hash, are compared with all nodes of their label;
   four times as many while they hold fewer than `LINKS` links, up to `AUDIT_MOST`. Below `RECALL` the
   search is repeated with twice the overlap, and, when a node is in all shards of its label, with
   twice the degree and beam, up to eight times. If that is not enough, or `AUDIT_MOST` nodes hold too
   few links to judge by although there are more nodes, every part of a label is compared with every
   other one exactly, without a graph.
A task returns one number and one root for each node that it saw, never its pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those
without label or id, link with nothing; so do vectors of different lengths. Equal ids are rows of
their own with results of their own; a component is named by its least id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, hash_pair, sample_bounded
from .components import components

LEAST = 0.93
TARGET, PART, CENTROIDS, SAMPLE = 2500, 5000, 256, 40_000
DEGREE, BEAM, ALPHA, WIDTH = 32, 64, 1.2, 4
SLACK = 0.12
ROUNDS = 2
AUDIT, AUDIT_MOST, LINKS, RECALL = 200, 12_800, 100, 0.98
EXACT = 0  # the effort that compares without a graph


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaled first, so that no square overflows or vanishes."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Graph:
    """A flat graph over unit vectors: `near` has each node's neighbours, -1 where there are fewer."""

    def __init__(self, x: np.ndarray, effort: int = 1):
        self.x = x.astype(np.float32)
        self.degree, self.beam = DEGREE * effort, BEAM * effort
        n = len(x)
        self.near = np.full((n, self.degree), -1, np.int32)
        self._ways = None
        self.medoid = int(np.argmax(self.x @ self.x.mean(axis=0))) if n else 0

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search from the medoid: (nodes, similarities) of the best `beam` seen, -1 where fewer; and the similarities of all nodes seen (-2: not seen)."""
        b, n = len(queries), len(self.x)
        seen = np.full((b, n), -2, np.float32)
        beam = np.full((b, self.beam), -1, np.int64)
        value = np.full((b, self.beam), -3, np.float32)
        open_ = np.zeros((b, self.beam), bool)
        beam[:, 0] = self.medoid
        value[:, 0] = queries @ self.x[self.medoid]
        seen[:, self.medoid] = value[:, 0]
        open_[:, 0] = True
        row, place = np.arange(b), np.empty(b * n, np.int32)
        flat = seen.reshape(-1)
        while True:
            alive = np.flatnonzero(open_.any(axis=1))  # the others have come to their end
            if not len(alive):
                break
            some = slice(None) if len(alive) == b else alive
            held, worth, opened = beam[some], value[some], open_[some]
            rank = np.where(opened, worth, -9)
            pick = np.argpartition(-rank, WIDTH - 1, axis=1)[:, :WIDTH]
            chosen = np.take_along_axis(opened, pick, 1)
            nodes = np.where(chosen, np.take_along_axis(held, pick, 1), -1)
            np.put_along_axis(opened, pick, False, 1)
            near = np.where(nodes[:, :, None] >= 0, self.near[nodes], -1).reshape(len(alive), -1)
            beam_row, c = np.nonzero(near >= 0)
            node = near[beam_row, c].astype(np.int64)
            key = row[some][beam_row] * n + node
            new = flat[key] == -2
            key = _once(key[new], place)
            node, beam_row = key % n, np.searchsorted(row[some], key // n)
            s = np.einsum("ij,ij->i", queries[key // n], self.x[node])
            flat[key] = s
            better = s > worth.min(axis=1)[beam_row]  # others do not enter the beam
            beam_row, node, s = beam_row[better], node[better], s[better]
            count = np.bincount(beam_row, minlength=len(alive))
            if len(s):
                at = np.arange(len(s)) - (np.cumsum(count) - count)[beam_row]
                shape = len(alive), int(count.max())
                fresh_nodes, fresh_value = np.full(shape, -1, np.int64), np.full(shape, -3, np.float32)
                fresh_nodes[beam_row, at], fresh_value[beam_row, at] = node, s
                all_value = np.hstack([worth, fresh_value])
                best = np.argpartition(-all_value, self.beam - 1, axis=1)[:, :self.beam]
                held, opened = (np.take_along_axis(np.hstack(x), best, 1) for x in ((held, fresh_nodes), (opened, fresh_nodes >= 0)))
                worth = np.take_along_axis(all_value, best, 1)
            beam[some], value[some], open_[some] = held, worth, opened
        return beam, seen

    def prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning of each node's candidates (-1: none) to `degree` neighbours."""
        b = len(nodes)
        candidates = np.where(candidates == nodes[:, None], -1, candidates)
        order = np.sort(candidates, axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        there = order >= 0
        c = self.x[order]
        near = np.where(there, 1 - np.einsum("bd,bcd->bc", self.x[nodes], c), 9)
        first = np.argsort(near, axis=1)
        order, near, there, c = (np.take_along_axis(a, first, 1) for a in (order, near, there, order))
        c = self.x[order]
        between = 1 - np.matmul(c, c.transpose(0, 2, 1))
        out = np.full((b, self.degree), -1, np.int32)
        alive, spare, row = there.copy(), there.copy(), np.arange(b)
        for k in range(self.degree):
            some = alive.any(axis=1)
            # a list that pruning leaves short is filled with the nearest that were dropped: members of a crowd of near copies would else lead to its centre alone
            at = np.where(some, alive.argmax(axis=1), spare.argmax(axis=1))
            out[row, k] = np.where(spare[row, at], order[row, at], -1)
            alive &= ~(some[:, None] & (ALPHA * between[row, at] <= near))
            alive[row, at] = spare[row, at] = False
        return out

    def build(self, seed: int = 3) -> Graph:
        n = len(self.x)
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.medoid], order[order != self.medoid]]) if n else order
        at, size = 1, 1
        while at < n:
            size = min(256, at, n - at)
            batch = order[at : at + size]
            beam, _ = self.search(self.x[batch])
            # nodes of the same batch cannot find each other, so they are candidates besides
            peers = np.broadcast_to(batch, (size, size))[:, : 2 * self.degree] if size <= 2 * self.degree else batch[np.argpartition(-(self.x[batch] @ self.x[batch].T), self.degree, axis=1)[:, :self.degree]]
            self.near[batch] = self.prune(batch, np.hstack([beam, peers]))
            src = np.repeat(batch, self.degree)
            dst = self.near[batch].ravel().astype(np.int64)
            src, dst = src[dst >= 0], dst[dst >= 0]
            self._add(dst, src)
            at += size
        return self

    def _add(self, to: np.ndarray, extra: np.ndarray) -> None:
        """Add `extra` to the neighbours of `to`; nodes with too many are pruned again."""
        order = np.argsort(to, kind="stable")
        to, extra = to[order], extra[order]
        nodes, start, count = np.unique(to, return_index=True, return_counts=True)
        width = int(count.max()) if len(count) else 0
        more = np.full((len(nodes), width), -1, np.int64)
        more[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(start, count)] = extra
        joint = np.hstack([self.near[nodes].astype(np.int64), more])
        held = (joint >= 0).sum(axis=1)
        full = held > self.degree
        if (~full).any():
            packed = -np.sort(-joint[~full], axis=1)
            self.near[nodes[~full]] = packed[:, :self.degree]
        longest_last = np.flatnonzero(full)[np.argsort(held[full], kind="stable")]  # lists of about one length are pruned together, as all are filled up to the longest
        for a in range(0, len(longest_last), 256):
            rows = longest_last[a : a + 256]
            self.near[nodes[rows]] = self.prune(nodes[rows], -np.sort(-joint[rows], axis=1)[:, : held[rows[-1]]])

    def _both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """Every node's neighbours and the nodes that it is a neighbour of: first places, and all of them."""
        if self._ways is None:
            n = len(self.x)
            a, k = np.nonzero(self.near >= 0)
            b = self.near[a, k].astype(np.int64)
            pair = np.unique(np.concatenate([a * n + b, b * n + a]))
            self._ways = np.searchsorted(pair // max(n, 1), np.arange(n + 1)), pair % max(n, 1)
        return self._ways

    def in_range(self, queries: np.ndarray, least: float) -> np.ndarray:
        """Mask [query, node] of the nodes found with similarity of about `least` or more."""
        seen = self.search(queries)[1]
        self._expand(queries, seen, least - SLACK)
        return seen >= least - 1e-4

    def around(self, own: np.ndarray, least: float) -> np.ndarray:
        """`in_range` of the graph's own nodes `own`. Their search starts where they are, as their neighbours were found when they were inserted, and not at the medoid."""
        b, n = len(own), len(self.x)
        queries, row = self.x[own], np.arange(b)
        seen = np.full((b, n), -2, np.float32)
        seen[row, own] = 2  # before all others
        done = np.zeros((b, n), bool)
        todo = row * n + own
        for _ in range(ROUNDS + 1):
            done.reshape(-1)[todo] = True
            self._see(queries, seen, todo)
            k = min(2 * WIDTH, n)
            best = (row[:, None] * n + np.argpartition(-np.where(done, -9, seen), k - 1, axis=1)[:, :k]).ravel()
            todo = best[(seen.reshape(-1)[best] > -2) & ~done.reshape(-1)[best]]
        self._expand(queries, seen, least - SLACK)
        return seen >= least - 1e-4

    def _see(self, queries: np.ndarray, seen: np.ndarray, pairs: np.ndarray) -> None:
        """Similarities of queries with what is linked in either direction to a node, for pairs (query * n + node)."""
        n, flat = len(self.x), seen.reshape(-1)
        start, ends = self._both_ways()
        r, node = pairs // n, pairs % n
        count = start[node + 1] - start[node]
        q = np.repeat(r, count)
        key = q * n + ends[np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[node], count)]
        key = _once(key[flat[key] == -2], np.empty(seen.size, np.int32))
        flat[key] = np.einsum("ij,ij->i", queries[key // n], self.x[key % n])

    def _expand(self, queries: np.ndarray, seen: np.ndarray, least: float) -> None:
        """Similarities of all that links lead to from nodes of `least` or more, until none is new."""
        expanded = np.zeros(seen.shape, bool)
        while True:
            pairs = np.flatnonzero((seen >= least) & ~expanded)
            if not len(pairs):
                break
            expanded.reshape(-1)[pairs] = True
            self._see(queries, seen, pairs)


def _once(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each key once; `place` has room for all keys and any content."""
    turn = np.arange(len(key), dtype=np.int32)
    place[key] = turn
    return key[place[key] == turn]


def _build(table: pa.Table, effort: int) -> pa.Table:
    node = table.column("node").to_numpy()
    graph = Graph(unit(_matrix(table.column("v"))), effort).build()
    lists = [node[x[x >= 0]].tolist() for x in graph.near]
    return pa.table({"node": pa.array(node, pa.int64()), "near": pa.array(lists, pa.list_(pa.int64()))})


def _search(table: pa.Table, effort: int) -> pa.Table:
    """Links of a group's queries with its base nodes: the multiplicity linked to each query, and the root here of each node."""
    node, is_base = table.column("node").to_numpy(), table.column("base").to_numpy(zero_copy_only=False).astype(bool)
    x, many = unit(_matrix(table.column("v"))), table.column("many").to_numpy()
    shard, homes = table.column("shard")[0].as_py(), table.column("homes").to_pylist()
    base, query = np.flatnonzero(is_base), np.flatnonzero(~is_base)
    graph = Graph(x[base], max(effort, 1))
    place = {int(v): i for i, v in enumerate(node[base])}
    lists = [[place[y] for y in near if y in place] for near in (table.column("near")[int(i)].as_py() or [] for i in base)]
    width = max(map(len, lists), default=0)
    graph.near = np.array([x + [-1] * (width - len(x)) for x in lists], np.int32).reshape(len(base), width)
    # a pair counts in the first shard that both are in: rank of shards before this one, as sets of bits
    earlier = sorted({h for hs in homes for h in hs if h < shard})
    member = np.array([[h in hs for h in earlier] for hs in map(set, homes)], bool).reshape(len(node), len(earlier))
    ids = np.unique(node)
    label, linked = np.arange(len(ids)), np.zeros(len(query), np.int64)
    index = np.searchsorted(ids, node)
    ours = table.column("part")[0].as_py() == table.column("other")[0].as_py()  # the queries are the base nodes
    for a in range(0, len(query), 256):
        rows = query[a : a + 256]
        if effort == EXACT:
            found = x[rows] @ x[base].T >= LEAST - 1e-6
        elif ours:
            found = graph.around(np.array([place[int(v)] for v in node[rows]]), LEAST)
        else:
            found = graph.in_range(x[rows].astype(np.float32), LEAST)
        r, c = np.nonzero(found)
        same = node[rows[r]] == node[base[c]]
        exact = np.einsum("ij,ij->i", x[rows[r]], x[base[c]]) >= LEAST
        r, c = r[exact & ~same], c[exact & ~same]
        for k in np.unique(r):  # join the components of what is linked
            own = np.append(index[base[c[r == k]]], index[rows[k]])
            groups = np.unique(label[own])
            if len(groups) > 1:
                label[np.isin(label, groups)] = groups[0]
        if len(earlier):
            counted = ~(member[rows[r]] & member[base[c]]).any(axis=1)
            r, c = r[counted], c[counted]
        linked[a : a + 256] = np.bincount(r, many[base[c]], len(rows)).astype(np.int64)
    none = np.zeros(len(ids), np.int64)
    return pa.table({"node": pa.array(np.append(node[query], ids), pa.int64()), "links": pa.array(np.append(linked, none), pa.int64()), "root": pa.array(np.append(node[query], ids[label]), pa.int64())})


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors, seeded by farthest points."""
    centre = [x.mean(axis=0)]
    best = x @ centre[0]
    for _ in range(k):
        centre.append(x[int(np.argmin(best))])
        best = np.maximum(best, x @ centre[-1])
    centre = np.array(centre[1:])
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        for i in range(k):
            if (own == i).any():
                m = x[own == i].mean(axis=0)
                centre[i] = m / max(np.sqrt(m @ m), 1e-12)
    return centre


def _centroids(nodes: DataFrame) -> dict:
    """Centroids of each label that needs several shards, from a bounded sample."""
    sizes = {r.label: r.n for r in nodes.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > TARGET).orderBy(F.desc("n"), "label").limit(SAMPLE // 64).collect()}
    if not sizes:
        return {}
    spark = nodes.sparkSession
    large = nodes.join(F.broadcast(spark.createDataFrame([(x,) for x in sizes], nodes.select("label").schema)), "label")
    rows = sample_bounded(large.select("label", "node", "v"), F.col("node"), SAMPLE, 13).orderBy(F.xxhash64("node"), "node").collect()
    out = {}
    for label, n in sizes.items():
        x = [r.v for r in rows if r.label == label]
        k = min(CENTROIDS, -(-n // (TARGET // 2)), len(x) // 8)
        if k > 1:
            out[label] = _kmeans(unit(np.array(x)), k)
    return out


def _sharded(nodes: DataFrame, centroids: dict, overlap: int) -> DataFrame:
    """node, v, many, shard (label and centroid), homes (all shards of the node)."""
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("array<int>")
    def nearest(label: pa.Array, v: pa.Array) -> pa.Array:
        names, out = label.to_pylist(), [[0]] * len(label)
        for name in set(names) & set(shared.value):
            rows = [i for i, x in enumerate(names) if x == name]
            c = shared.value[name]
            k = min(overlap, len(c))
            best = np.sort(np.argsort(-(unit(_matrix(v.take(pa.array(rows)))) @ c.T), axis=1, kind="stable")[:, :k], axis=1)
            for i, b in zip(rows, best.tolist(), strict=True):
                out[i] = b
        return pa.array(out, pa.list_(pa.int32()))

    homes = nodes.withColumn("homes", nearest("label", "v"))
    return homes.withColumn("shard", F.explode("homes"))


def _found(nodes: DataFrame, centroids: dict, overlap: int, effort: int) -> DataFrame:
    """(node, links, root) rows of all searches."""
    where = ["label", "shard"]
    sharded = durable(_sharded(nodes, centroids, overlap))
    parts = sharded.groupBy(*where).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    sharded = sharded.join(parts, where).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    if effort == EXACT:
        listed = sharded.withColumn("near", F.array().cast("array<long>"))
    else:
        lists = sharded.select(*where, "part", "node", "v").groupBy(*where, "part").applyInArrow(lambda t: _build(t, effort), "node long, near array<long>")
        listed = sharded.join(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "node")
    base = listed.withColumns({"base": F.lit(True), "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    query = sharded.withColumns({"base": F.lit(False), "near": F.lit(None).cast("array<long>"), "other": F.col("part"), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    fields = [*where, "part", "other", "node", "v", "many", "homes", "near", "base"]
    both = base.select(*fields).unionByName(query.select(*fields))
    return durable(both.groupBy(*where, "part", "other").applyInArrow(lambda t: _search(t, effort), "node long, links long, root long"))


def _recall(nodes: DataFrame, found: DataFrame) -> float | None:
    """Share of the links of a bounded sample of nodes that were found; None if the largest sample holds too few to tell."""
    audit, total = AUDIT, nodes.count()
    while True:
        true, got = _audited(nodes, found, audit)
        if true >= LINKS or audit >= total:
            return got / true if true else 1.0
        if audit >= AUDIT_MOST:
            return None
        audit *= 4


def _audited(nodes: DataFrame, found: DataFrame, most: int) -> tuple[int, int]:
    """Links of about `most` nodes, and how many of them were found."""
    picked = sample_bounded(nodes, F.col("node"), most, 17).select("label", "node", "v").collect()
    by_label: dict = {}
    for r in picked:
        by_label.setdefault(r.label, []).append((r.node, r.v))
    shared = nodes.sparkSession.sparkContext.broadcast({k: (np.array([n for n, _ in x]), unit(np.array([v for _, v in x]))) for k, x in by_label.items()})

    def compare(batches):
        for b in batches:
            names = b.column("label").to_pylist()
            out: dict[int, int] = {}
            for name in set(names) & set(shared.value):
                rows = pa.array([i for i, x in enumerate(names) if x == name])
                ids, x = shared.value[name]
                node, many = b.column("node").take(rows).to_numpy(), b.column("many").take(rows).to_numpy()
                link = (unit(_matrix(b.column("v").take(rows))) @ x.T >= LEAST) & (node[:, None] != ids[None, :])
                for i, n in zip(ids.tolist(), (link * many[:, None]).sum(axis=0).tolist(), strict=True):
                    out[i] = out.get(i, 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], ["node", "true"])

    true = nodes.select("label", "node", "v", "many").mapInArrow(compare, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    got = found.groupBy("node").agg(F.sum("links").alias("links"))
    r = true.join(got, "node", "left").agg(F.sum("true").alias("t"), F.sum(F.least("true", F.coalesce("links", F.lit(0)))).alias("g")).first()
    return r.t or 0, r.g or 0


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", overlap: int = 2) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    rows = rows.withColumn("ok", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    rows = rows.withColumns({"label": F.concat_ws(":", F.size("v").cast("string"), "label"), **dict(zip(("h1", "h2"), hash_pair(F.col("v")), strict=True))})
    # a node is named by a hash of label and vector, its component by the least id in it
    nodes = rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("v").alias("v"))
    nodes = durable(nodes.withColumn("node", F.xxhash64("label", "h1", "h2")))
    centroids = _centroids(nodes)
    most = max((len(c) for c in centroids.values()), default=1)
    effort = 1
    while True:
        found = _found(nodes, centroids, overlap, effort)
        recall = _recall(nodes, found)
        if recall is not None and recall >= RECALL:
            break
        if recall is None or effort >= 8:
            found = _found(nodes, {}, 1, EXACT)
            break
        overlap, effort = (overlap * 2, effort) if overlap < most else (overlap, effort * 2)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node != root"), "node", "root")
    whole = nodes.select("node", "label", "h1", "h2", "least", "many").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    known = whole.join(names, "root").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    linked = rows.where("ok").join(known, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
