"""Near-duplicate vectors by cosine: navigable small-world graphs per shard.

Distinct vectors are dealt to shards by hash.  In a shard a vector within the threshold of an earlier one joins it as
a member; the others (leaders) are the nodes of a hierarchical small-world graph, whose beam is doubled until an audit
against brute force passes.  Every vector queries every shard.  A vector linked to a member of a leader is within twice
the threshold's angle of that leader, so a beam that still ends within this angle is doubled for that query: dense
regions are read whole, not cut.

The search names pairs of leaders whose members link.  Each such pair is then verified member by member in double
precision, in blocks, and only counts leave a block, so a group of n near copies costs no n * n rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.components import connected_components
from rankflow.session import work_dir

#: distinct vectors in a shard (about: they are dealt by hash), queries in a task's group, vectors in a verified block
SHARD_ROWS, SLICE_ROWS, BLOCK_ROWS = 32_768, 16_384, 1_024
#: bytes of a stored graph in a row
PART_BYTES = 1 << 20
#: neighbours of a node (twice as many in the lowest layer), and the beam while building
DEGREE, BUILD_BEAM = 16, 64
#: the least share of leaders in reach that the audited beam has to find, and the queries of an audit
RECALL, AUDIT = 0.99, 256
#: queries that walk a graph in step
STEP = 256
#: what single-precision similarities may be off by
SLACK = 1e-4


class Layer:
    """A flat graph: unit vectors, neighbour lists (-1: none), and each node's number in the layer below."""

    def __init__(self, dims: int, degree: int):
        self.vec, self.near, self.down = np.empty((0, dims), np.float32), np.empty((0, degree), np.int32), np.empty(0, np.int32)

    @property
    def n(self) -> int:
        return len(self.vec)

    def beam(self, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in step, from ``start`` (one node each): (nodes, similarities) of the
        ``width`` best found, best first; -1 and -inf where there are fewer."""
        n_q, degree = len(q), self.near.shape[1]
        width = min(width, self.n)
        seen = np.full(n_q * self.n, -1, np.int32)
        node = np.full((n_q, width), -1, np.int32)
        sim = np.full((n_q, width), -np.inf, np.float32)
        done = np.ones((n_q, width), bool)
        node[:, 0], sim[:, 0], done[:, 0] = start, (q * self.vec[start]).sum(1), False
        seen[np.arange(n_q) * self.n + start] = 0
        at_once = 4
        alive = np.arange(n_q)
        while len(alive):
            # the beam is sorted: its first open entries
            open_ = ~done[alive]
            rank = np.cumsum(open_, axis=1)
            row, col = np.nonzero(open_ & (rank <= at_once))
            done[alive[row], col] = True
            to = self.near[node[alive[row], col]]
            query = np.repeat(alive[row], degree)
            to = to.ravel()
            query, to = query[to >= 0], to[to >= 0]
            place = query.astype(np.int64) * self.n + to
            new = seen[place] < 0
            query, to, place = query[new], to[new], place[new]
            stamp = np.arange(len(place), dtype=np.int32)
            seen[place] = stamp
            once = seen[place] == stamp  # of a node named twice in this step, one stays
            query, to = query[once], to[once]
            if len(query):
                got = np.einsum("ij,ij->i", q[query], self.vec[to])
                better = got > sim[query, width - 1]
                query, to, got = query[better], to[better], got[better]
            if len(query):
                who, first, many = np.unique(query, return_index=True, return_counts=True)
                most = int(many.max())
                more, more_sim = np.full((len(who), most), -1, np.int32), np.full((len(who), most), -np.inf, np.float32)
                r = np.repeat(np.arange(len(who)), many)
                c = np.arange(len(query)) - np.repeat(first, many)
                more[r, c], more_sim[r, c] = to, got
                all_sim = np.concatenate([sim[who], more_sim], axis=1)
                order = np.argsort(-all_sim, axis=1, kind="stable")[:, :width]
                sim[who] = np.take_along_axis(all_sim, order, 1)
                node[who] = np.take_along_axis(np.concatenate([node[who], more], axis=1), order, 1)
                done[who] = np.take_along_axis(np.concatenate([done[who], more < 0], axis=1), order, 1)
            alive = alive[~done[alive].all(1)]
        return node, sim


def _chosen(base: np.ndarray, cand: np.ndarray, cand_sim: np.ndarray, vec: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours of each base row among its candidates (best first, -1: none): first those nearer to it than to any
    chosen one, then the nearest of the others."""
    n, c = cand.shape
    points = vec[np.maximum(cand, 0)]
    between = np.matmul(points, points.transpose(0, 2, 1))
    kept = np.zeros((n, c), bool)
    nearest_kept = np.full((n, c), -np.inf, np.float32)
    for k in range(c):
        take = (cand[:, k] >= 0) & (cand_sim[:, k] > nearest_kept[:, k]) & (kept.sum(1) < degree)
        kept[:, k] = take
        nearest_kept = np.where(take[:, None], np.maximum(nearest_kept, between[:, k]), nearest_kept)
    rank = np.where(cand < 0, 2 * c, np.where(kept, 0, c)) + np.arange(c)[None]
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(cand, order, 1)
    return out if out.shape[1] == degree else np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


class Graph:
    """Leaders of a shard in layers, the highest first in ``search``."""

    def __init__(self, dims: int):
        self.layers = [Layer(dims, 2 * DEGREE)]
        self.dims = dims

    def search(self, q: np.ndarray, width: int, lowest: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The beam of every query in layer ``lowest``."""
        start = np.zeros(len(q), np.int64)
        for level in range(len(self.layers) - 1, lowest, -1):
            found, _ = self.layers[level].beam(q, start, 4)
            start = self.layers[level].down[found[:, 0]]
        return self.layers[lowest].beam(q, start, width)

    def add(self, vec: np.ndarray, level: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> None:
        """New nodes, each up to its level; ``found`` is their beam in the lowest layer."""
        below = None
        for k in range(int(level.max()) + 1):
            up = np.flatnonzero(level >= k)
            if k == len(self.layers):
                self.layers.append(Layer(self.dims, DEGREE))
            layer = self.layers[k]
            beams = None
            if k == 0:
                beams = found
            elif layer.n:
                beams = self.search(vec[up], BUILD_BEAM, k)
            old = layer.n
            self._insert(layer, vec[up], beams)
            layer.down = np.concatenate([layer.down, np.zeros(len(up), np.int32) if below is None else below[up].astype(np.int32)])
            here = np.zeros(len(vec), np.int64)
            here[up] = old + np.arange(len(up))
            below = here

    def _insert(self, layer: Layer, vec: np.ndarray, beams) -> None:
        old, n, degree = layer.n, len(vec), layer.near.shape[1]
        layer.vec = np.concatenate([layer.vec, vec])
        layer.near = np.concatenate([layer.near, np.full((n, degree), -1, np.int32)])
        among = vec @ vec.T
        np.fill_diagonal(among, -np.inf)
        near = np.argsort(-among, axis=1, kind="stable")[:, : min(degree, n - 1)]
        cand, cand_sim = (near + old).astype(np.int32), np.take_along_axis(among, near, 1)
        if beams is not None:
            cand, cand_sim = np.concatenate([beams[0], cand], axis=1), np.concatenate([beams[1], cand_sim], axis=1)
        order = np.argsort(-cand_sim, axis=1, kind="stable")
        cand, cand_sim = np.take_along_axis(cand, order, 1), np.take_along_axis(cand_sim, order, 1)
        chosen = _chosen(vec, cand, cand_sim, layer.vec, degree)
        layer.near[old:] = chosen
        self._link_back(layer, np.repeat(old + np.arange(n), degree), chosen.ravel())

    @staticmethod
    def _link_back(layer: Layer, new: np.ndarray, to: np.ndarray) -> None:
        """Every chosen neighbour names the node that chose it, and drops others where its list is full."""
        degree = layer.near.shape[1]
        new, to = new[to >= 0], to[to >= 0]
        sim = np.einsum("ij,ij->i", layer.vec[new], layer.vec[to])
        order = np.lexsort((-sim, to))
        new, to = new[order], to[order]
        who, first, many = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, many)
        ok = place < degree
        more = np.full((len(who), degree), -1, np.int32)
        more[np.repeat(np.arange(len(who)), many)[ok], place[ok]] = new[ok]
        have = layer.near[who]
        more[(more[:, :, None] == have[:, None, :]).any(2)] = -1  # named already
        cand = np.concatenate([have, more], axis=1)
        for part in np.array_split(np.arange(len(who)), max(1, len(who) // 512)):
            c = cand[part]
            s = np.matmul(layer.vec[np.maximum(c, 0)], layer.vec[who[part]][:, :, None])[:, :, 0]
            s[c < 0] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")
            c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
            fits = (c >= 0).sum(1) <= degree
            layer.near[who[part[fits]]] = c[fits][:, :degree]
            full = np.flatnonzero(~fits)
            if len(full):
                layer.near[who[part[full]]] = _chosen(layer.vec[who[part[full]]], c[full], s[full], layer.vec, degree)

    def pack(self) -> dict[str, bytes]:
        return {f"{name}{k}": getattr(a, name).tobytes() for k, a in enumerate(self.layers) for name in ("vec", "near", "down")}

    @classmethod
    def unpack(cls, dims: int, stored: dict[str, bytes]) -> Graph:
        out = cls(dims)
        out.layers = []
        while f"vec{len(out.layers)}" in stored:
            k = len(out.layers)
            layer = Layer(dims, DEGREE)
            layer.vec = np.frombuffer(stored[f"vec{k}"], np.float32).reshape(-1, dims)
            layer.near = np.frombuffer(stored[f"near{k}"], np.int32).reshape(layer.n, -1)
            layer.down = np.frombuffer(stored[f"down{k}"], np.int32)
            out.layers.append(layer)
        return out


def reach(threshold: float) -> float:
    """The least cosine between a vector and the leader of a member that it links with."""
    return 2 * threshold * threshold - 1


def within_reach(graph: Graph, q: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, leader) of every leader found with at least this similarity; a beam that ends above it is doubled."""
    out_q, out_l = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(8, STEP * 32_768 // max(graph.layers[0].n, 32_768))
    for start in range(0, len(q), step):
        ask, beam = np.arange(start, min(start + step, len(q))), width
        while len(ask):
            node, sim = graph.search(q[ask], beam)
            narrow = (sim[:, -1] >= least - SLACK) & (beam < graph.layers[0].n)
            row, col = np.nonzero((sim >= least - SLACK) & ~narrow[:, None])
            out_q.append(ask[row])
            out_l.append(node[row, col].astype(np.int64))
            ask, beam = ask[narrow], 2 * beam
    return np.concatenate(out_q), np.concatenate(out_l)


def build(vec: np.ndarray, threshold: float, seed: int) -> tuple[Graph, np.ndarray, int]:
    """Graph of a shard's unit vectors, the leader's node of every vector, and the beam that passes the audit."""
    rng = np.random.default_rng(seed)
    v32 = vec.astype(np.float32)
    n, dims = vec.shape
    graph, node_of = Graph(dims), np.full(n, -1, np.int64)
    levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(DEGREE)).astype(int), 6)
    at = 0
    while at < n:
        part = np.arange(at, min(n, at + min(512, max(64, at // 4))))
        at = part[-1] + 1
        v = v32[part]
        old = graph.layers[0].n
        found = graph.search(v, BUILD_BEAM) if old else None
        new = np.ones(len(part), bool)
        if old:
            double = (vec[part] * graph.layers[0].vec[found[0][:, 0]].astype(np.float64)).sum(1)
            joins = double >= threshold + SLACK  # leaders are kept in single precision
            node_of[part[joins]] = found[0][joins, 0]
            new &= ~joins
        close = np.argwhere(np.triu(v @ v.T >= threshold + SLACK, 1))
        joined = {}
        for i, j in close[np.lexsort((close[:, 0], close[:, 1]))]:
            if new[i] and new[j] and i not in joined and j not in joined:
                joined[j] = i
        new[list(joined)] = False
        leaders = np.flatnonzero(new)
        node_of[part[leaders]] = old + np.arange(len(leaders))
        for j, i in joined.items():
            node_of[part[j]] = node_of[part[i]]
        if len(leaders):
            graph.add(v[leaders], levels[part[leaders]], None if found is None else (found[0][leaders], found[1][leaders]))
    return graph, node_of, audited(graph, v32, threshold, rng)


def audited(graph: Graph, v32: np.ndarray, threshold: float, rng: np.random.Generator) -> int:
    """The least doubling of the build beam with which an audit's queries find RECALL of what is in their reach.  The
    queries lie at exactly the threshold from vectors of the shard, the farthest that a link can be."""
    of = rng.choice(len(v32), min(AUDIT, len(v32)), replace=False)
    off = rng.normal(size=(len(of), graph.dims))
    off -= (off * v32[of]).sum(1)[:, None] * v32[of]
    off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
    q = (threshold * v32[of] + math.sqrt(max(0.0, 1 - threshold**2)) * off).astype(np.float32)
    least, leaders = reach(threshold), graph.layers[0].vec
    there = sum(int((part @ leaders.T >= least).sum()) for part in np.array_split(q, max(1, len(q) // 64)))
    width = BUILD_BEAM
    while width < graph.layers[0].n:
        ask, node = within_reach(graph, q, width, least)
        found = int(((q[ask] * leaders[node]).sum(1) >= least).sum())
        if found >= RECALL * there:
            break
        width *= 2
    return width


def _doubles(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _units(column: pa.Array, dims: int) -> np.ndarray:
    x = _doubles(column, dims)
    x = x / np.abs(x).max(1, keepdims=True)  # no square over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _linkable(vector: str):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def leader_links(nodes: DataFrame, shards: DataFrame, slices: int, threshold: float) -> DataFrame:
    """(a, b) leaders of which a member of one was found to link with a member of the other.  Every vector of ``nodes``
    queries every shard of its number of dimensions; a group is a slice of queries and one shard's graph."""
    ask = nodes.select("key", "leader", "unit", "dims", "slice").join(
        F.broadcast(shards.select("dims", F.col("shard").alias("to")).distinct()), "dims")
    graphs = shards.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def search(queries, graph):
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not queries.num_rows or not graph.num_rows:
            return empty
        stored: dict[str, bytes] = {}
        for row in graph.sort_by([("name", "ascending"), ("place", "ascending")]).select(["name", "data"]).to_pylist():
            stored.setdefault(row["name"], []).append(row["data"])
        stored = {k: b"".join(v) for k, v in stored.items()}
        dims, beam = graph.column("dims")[0].as_py(), graph.column("beam")[0].as_py()
        g, names = Graph.unpack(dims, stored), np.frombuffer(stored["leaders"], np.int64)
        member_of, units = np.frombuffer(stored["member_of"], np.int32), np.frombuffer(stored["units"], np.float64).reshape(-1, dims)
        first = np.searchsorted(member_of, np.arange(len(names) + 1))  # members lie leader by leader
        q = _doubles(queries.column("unit").combine_chunks(), dims)
        own = queries.column("leader").to_numpy()
        who, node = within_reach(g, q.astype(np.float32), beam, reach(threshold))
        other = own[who] != names[node]
        who, node = who[other], node[other]
        linked = np.zeros(len(who), bool)
        ends = np.cumsum(first[node + 1] - first[node])
        start = 0
        while start < len(who):  # members of the leaders in reach, a bounded number at a time
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 100_000)))
            n = first[node[start:end] + 1] - first[node[start:end]]
            at = np.repeat(first[node[start:end]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair = np.repeat(np.arange(start, end), n)
            hit = np.einsum("ij,ij->i", q[who[pair]], units[at]) >= threshold
            linked[pair[hit]] = True
            start = end
        a, b = own[who[linked]], names[node[linked]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    found = ask.groupBy("to", "dims", "slice").cogroup(graphs.groupBy("shard", "dims", "slice")).applyInArrow(search, "a long, b long")
    return found.distinct()


def _built(nodes: DataFrame, threshold: float) -> DataFrame:
    """Of each shard its graph and its members leader by leader, as rows (name, place, data) of at most PART_BYTES, and
    a row (key, leader) of each vector."""

    def shard(key, rows):
        rows = rows.sort_by("key")
        dims, keys = key[1].as_py(), rows.column("key").to_numpy()
        unit = _doubles(rows.column("unit").combine_chunks(), dims)
        order = np.random.default_rng(len(keys)).permutation(len(keys))
        graph, node_of, beam = build(unit[order], threshold, len(keys))
        node = np.empty(len(keys), np.int64)
        node[order] = node_of
        names = np.full(graph.layers[0].n, np.iinfo(np.int64).max)
        np.minimum.at(names, node, keys)  # a leader goes by the least key of its members
        by = np.argsort(node, kind="stable")
        stored = graph.pack() | {"leaders": names.tobytes(), "member_of": node[by].astype(np.int32).tobytes(), "units": unit[by].tobytes()}
        parts = [(name, k // PART_BYTES, data[k: k + PART_BYTES]) for name, data in stored.items() for k in range(0, max(len(data), 1), PART_BYTES)]
        n = len(parts)
        out = {"shard": [key[0].as_py()] * n, "dims": pa.array([dims] * n, pa.int32()), "beam": pa.array([beam] * n, pa.int32()),
               "name": [x[0] for x in parts], "place": pa.array([x[1] for x in parts], pa.int32()), "data": [x[2] for x in parts]}
        who = {"key": keys, "leader": names[node]}
        graph_rows = pa.table(out | {k: pa.nulls(n, pa.int64()) for k in who})
        member_rows = pa.table({k: pa.nulls(len(keys), graph_rows.schema.field(k).type) for k in out} | who)
        return pa.concat_tables([graph_rows, member_rows])

    return nodes.select("key", "unit", "shard", "dims").groupBy("shard", "dims").applyInArrow(
        shard, "shard long, dims int, beam int, name string, place int, data binary, key long, leader long")


def _counted(nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(key, n): links of every vector with the rows of other vectors, over all pairs of leaders and within each
    leader.  A leader's members lie in blocks; two blocks meet once and give one number a vector."""
    spark = nodes.sparkSession
    numbered = nodes.withColumn("part", F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(BLOCK_ROWS)))))
    folder = work_dir(spark, "embedding-blocks")
    (numbered.groupBy("leader", "size", "dims", "part").agg(
        F.collect_list(F.struct("key", "copies", "unit")).alias("m"))
        .select("leader", "size", "dims", "part", F.col("m.key").alias("key"), F.col("m.copies").alias("copies"),
                F.flatten(F.col("m.unit")).alias("unit")).write.parquet(folder))
    blocks = spark.read.parquet(folder)
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns])
    a, b = side("a"), side("b")
    inside = blocks.where("size > 1").select(F.col("leader").alias("a"), F.col("leader").alias("b")).distinct()
    met = (pairs.select("a", "b").union(inside).join(a, F.col("a") == F.col("leader_a")).join(b, F.col("b") == F.col("leader_b"))
           .where("a <> b OR part_a <= part_b"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in batch.schema.names}
                key, copies, unit = ([row[f"{k}_{s}"].values.to_numpy(zero_copy_only=False) for s in "ab"] for k in ("key", "copies", "unit"))
                x, y = (u.reshape(len(k), -1) for u, k in zip(unit, key, strict=True))
                linked = x @ y.T >= threshold
                same = row["leader_a"].as_py() == row["leader_b"].as_py() and row["part_a"].as_py() == row["part_b"].as_py()
                if same:
                    np.fill_diagonal(linked, False)
                keys.append(key[0])
                found.append(linked @ copies[1])
                if not same:
                    keys.append(key[1])
                    found.append(copies[0] @ linked)
            k, n = np.concatenate(keys), np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(k[n > 0]), pa.array(n[n > 0])], names=["key", "n"])

    columns = [f"{c}_{s}" for s in "ab" for c in ("leader", "part", "key", "copies", "unit")]
    return met.select(*columns).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vector: str = "embedding", vec_id: str = "vec_id",
                    shard_rows: int = SHARD_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``.

    Two rows link if their vectors have equally many components and a cosine of ``threshold`` or more in double
    precision.  Vectors that are null, empty, zero or hold null or non-finite components link with nothing.  Equal
    vectors are one node with a number of copies, which all link with each other.  component_id is the smallest
    non-null id reachable, the row's own included; kept says that it is the row's own (false for a null id).  Rows
    that repeat an id are rows of their own.  An empty table gives an empty result; other columns are not read.

    ``threshold`` is from 0.75 up (below, a leader's reach passes the right angle's neighbourhood and every beam
    would take in the whole shard)."""
    if not 0.75 <= threshold <= 1:
        raise ValueError("a threshold between 0.75 and 1 is needed")
    spark = vectors.sparkSession
    folder = work_dir(spark, "embedding-dedup")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    usable = rows.where(_linkable("vector"))
    kind = vectors.schema[vec_id].dataType.simpleString()

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            dims = np.diff(column.offsets.to_numpy())
            out: list = [None] * batch.num_rows
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for i, u in zip(at.tolist(), _units(column.take(pa.array(at)), d), strict=True):
                    out[i] = u
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vector", "least", "copies")], pa.array(out, pa.list_(pa.float64()))],
                                             names=["vector", "least", "copies", "unit"])

    distinct = usable.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct.mapInArrow(unit, f"vector array<double>, least {kind}, copies long, unit array<double>").select(
        F.monotonically_increasing_id().alias("key"), "*", F.size("unit").alias("dims"),
        F.xxhash64("vector").alias("hash")).write.parquet(f"{folder}/distinct")
    distinct = spark.read.parquet(f"{folder}/distinct")
    total = distinct.count()
    shards, slices = max(2, math.ceil(total / shard_rows)), max(1, math.ceil(total / slice_rows))
    dealt = distinct.withColumn("shard", F.pmod("hash", F.lit(shards))).withColumn(
        "slice", F.pmod(F.xxhash64("hash"), F.lit(slices)).cast("int"))
    _built(dealt, threshold).write.parquet(f"{folder}/shards")
    built = spark.read.parquet(f"{folder}/shards")
    graphs, leaders = built.where("name IS NOT NULL").drop("key", "leader"), built.where("name IS NULL").select("key", "leader")
    sizes = leaders.groupBy("leader").agg(F.count("*").alias("size"))
    (dealt.join(leaders, "key").join(sizes, "leader")
     .select("key", "leader", "size", "least", "copies", "vector", "unit", "dims", "slice").write.parquet(f"{folder}/nodes"))
    nodes = spark.read.parquet(f"{folder}/nodes")
    leader_links(nodes, graphs, slices, threshold).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    links = _counted(nodes, pairs, threshold)
    groups = connected_components(pairs).withColumnRenamed("node", "leader")
    placed = nodes.select("key", "leader", "least", "copies", "vector").join(groups, "leader", "left").withColumn(
        "group", F.coalesce("component", "leader"))
    least = placed.groupBy("group").agg(F.min("least").alias("component_id"))
    about = placed.join(least, "group").join(links, "key", "left").select(
        "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    found = usable.join(about, "vector")
    alone = rows.where(~_linkable("vector")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.select("vec_id", "n_links", "component_id").unionByName(alone).select(
        F.col("vec_id").alias(vec_id), "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
