"""Near-duplicate vectors by cosine: a navigable small-world graph per shard, every shard queried by all vectors."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import connected_components, saved

#: Fixed small numbers for the searches: beams start so wide, and an audit holds so many queries against all nodes.
BEAM, AUDIT, AUDIT_RECALL = 24, 64, 1.0
QUERY_BATCH = 256


def unit(rows: list) -> tuple[list[int], list[np.ndarray]]:
    """(which rows are vectors, those as unit vectors): no nulls, all components finite, not zero."""
    good, out = [], []
    for i, v in enumerate(rows):
        if v is None or not len(v) or any(c is None for c in v):
            continue
        a = np.asarray(v, np.float64)
        if not np.isfinite(a).all():
            continue
        top = np.abs(a).max()
        if top > 0:
            a = a / top
            good.append(i)
            out.append(a / math.sqrt(float(a @ a)))
    return good, out


class Shard:
    """A searchable shard. Vectors within half the linking angle of a node form a ball: all pairs in it link."""

    def __init__(self, uids: list[int], ids: list[int], x: np.ndarray, threshold: float):
        from quern.llm.hnsw import Graph

        self.angle = math.acos(threshold)
        self.threshold = threshold
        self.ids, self.x = np.array(ids, np.int64), x
        self.graph = Graph(x.astype(np.float32), tight=math.cos(self.angle / 2 - 1e-4))
        node_of = self.graph.node_of
        self.place = dict(zip(uids, range(len(uids))))
        members = np.argsort(node_of, kind="stable")
        self.first = np.searchsorted(node_of[members], np.arange(len(self.graph.nodes) + 1))
        self.members = members
        to_node = np.arccos(np.clip(np.einsum("ij,ij->i", x, x[self.graph.nodes[node_of]]), -1, 1))
        self.radius = np.zeros(len(self.graph.nodes))
        np.maximum.at(self.radius, node_of, to_node)
        single = np.diff(self.first) == 1
        self.radius[single] = 0
        self.single = single
        # what a node's similarity must be for a member to link, with room for single precision
        self.least = (np.cos(np.minimum(math.pi, self.angle + self.radius)) - 1e-4).astype(np.float32)

    def near(self, q: np.ndarray) -> list[np.ndarray]:
        """The nodes that may hold links of each query. Beams are widened until two things hold: each beam ends
        below every node's least similarity, and an audit of queries against all nodes finds AUDIT_RECALL."""
        q32, n = q.astype(np.float32), len(self.graph.nodes)
        lowest, found = float(self.least.min()), [np.zeros(0, np.int64)] * len(q)
        ef, todo = min(BEAM, n), np.arange(len(q))
        while True:
            full = []
            for i in range(0, len(todo), QUERY_BATCH):
                rows = todo[i : i + QUERY_BATCH]
                ids, sims = self.graph.search(q32[rows], ef)
                for r, a, s in zip(rows, ids, sims):
                    hit = (a >= 0) & (s >= self.least[a])
                    found[r] = a[hit].astype(np.int64)
                    if a[-1] >= 0 and s[-1] >= lowest:
                        full.append(r)
            if ef >= n:
                return found
            if not full:
                if self._audit(q32, found):
                    return found
                todo = np.arange(len(q))
            else:
                todo = np.array(full)
            ef = min(2 * ef, n)

    def _audit(self, q: np.ndarray, found: list[np.ndarray]) -> bool:
        some = np.flatnonzero([len(f) > 0 for f in found])
        asked = np.unique(np.concatenate((some[:: max(1, len(some) // AUDIT)], np.arange(0, len(q), max(1, len(q) // AUDIT)))))
        right = got = 0
        for i in range(0, len(asked), 64):
            truth = q[asked[i : i + 64]] @ self.graph.x.T >= self.least
            right += int(truth.sum())
            got += sum(int(t[found[r]].sum()) for r, t in zip(asked[i : i + 64], truth))
        return got >= AUDIT_RECALL * right

    def links(self, uids: list[int], q: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(query, links in this shard, one linked id for each ball): cosines of single vectors in double
        precision, balls wholly inside or outside by their angles, others member by member."""
        for k, nodes in enumerate(self.near(q)):
            own = self.place.get(uids[k])
            if own is not None:
                nodes = np.union1d(nodes, [self.graph.node_of[own]])
            if not len(nodes):
                continue
            cos = np.einsum("ij,j->i", self.x[self.graph.nodes[nodes]], q[k])
            n, to = 0, []
            for node, c in zip(nodes, cos):
                members = self.members[self.first[node] : self.first[node + 1]]
                if self.single[node]:
                    linked = int(c >= self.threshold)
                    me = own is not None and members[0] == own
                    linked -= linked if me else 0
                else:
                    inside = math.acos(min(1.0, max(-1.0, c))) + self.radius[node] < self.angle - 1e-9
                    linked = len(members) if inside else int((self.x[members] @ q[k] >= self.threshold).sum())
                    if own is not None and self.graph.node_of[own] == node:
                        # its own ball links wholly; members lie within half the angle of the node
                        linked = len(members) - 1
                if linked:
                    n += linked
                    to.append(int(self.ids[self.graph.nodes[node]]))
            if n:
                yield k, n, to


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, least_shards: int = 8, shard_rows: int = 131_072, shard_bytes: int = 1 << 27, query_rows: int = 1 << 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links are pairs with a cosine of `threshold` or more.

    Rows are dealt over shards by hash, least_shards or as many as hold shard_rows rows and shard_bytes of vectors
    each. A shard's graph is built in one task and written to the shared folder. All vectors are held against each
    shard, in blocks of up to query_rows: a task gets one copy of the graph, and the block's vectors stream through
    it. query_rows is 8 * shard_rows, so that graphs are a small part of what is shuffled. n_links counts the other
    rows linked directly. component_id is the smallest id reachable by links; kept: it is the row's own.

    A ball of copies counts as one node of the graph and gives a query one edge, so that a group of g copies costs
    g edges a shard, not g * g. Only links whose cosine (double precision) or angle sum proves it are counted.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths never link. Rows that share an id stay rows, each counted; a null id is a row of its own,
    with no component. An empty table gives no rows; other columns are not read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids must be integers, not {kind}")
    points = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).withColumn("uid", F.monotonically_increasing_id())

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, x = unit([r.tolist() if isinstance(r, np.ndarray) else r for r in b.column(1).to_pylist()])
            bodies: list[bytes | None] = [None] * b.num_rows
            for i, a in zip(good, x):
                bodies[i] = a.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(bodies, pa.binary())], names=["uid", "id", "x"])

    points = saved(points.mapInArrow(normal, "uid long, id long, x binary"), "vectors")
    valid = points.where("x is not null and id is not null")
    total, size = valid.agg(F.count("*"), F.coalesce(F.sum(F.length("x").cast("long")), F.lit(0))).first()
    shards = max(least_shards, -(-total // shard_rows), -(-size // shard_bytes))
    wide = -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // shards)  # two tasks a core where there are few shards
    blocks = max(1, -(-total // query_rows), min(wide, -(-total // 8_192)))
    dealt = valid.withColumn("d", F.length("x")).withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))

    def arrays(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(t.num_rows, -1)

    def build(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")
        shard = Shard(t.column("uid").to_pylist(), t.column("id").to_pylist(), arrays(t), threshold)
        return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "graph": pa.array([pickle.dumps(shard, protocol=5)], pa.binary())})

    graphs = saved(dealt.groupBy("d", "shard").applyInArrow(build, "d int, shard int, graph binary"), "graphs")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (d, shard, block), the graph first."""
        shard = held = None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(4)])
            is_graph = keys[3] == 0
            change = np.flatnonzero(is_graph[1:] | (keys[:3, 1:] != keys[:3, :-1]).any(0)) + 1
            for start, end in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
                if start == end:
                    continue
                if is_graph[start]:
                    shard, held = pickle.loads(b.column(6)[start].as_py()), tuple(keys[:3, start])
                    start += 1
                if start == end or held != tuple(keys[:3, start]):
                    continue  # no vector of this length was dealt to the shard
                t = b.slice(start, end - start)
                uids, ids = t.column(4).to_pylist(), t.column(5).to_pylist()
                x = np.frombuffer(b"".join(t.column(6).to_pylist()), np.float64).reshape(t.num_rows, -1)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for k, n, to in shard.links(uids, x):
                    for column, v in zip(out, (uids[k], ids[k], n, to)):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))], names=["uid", "id", "n", "links"])

    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    none = F.lit(None).cast("long")
    asked = dealt.select("d", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "uid", "id", F.col("x").alias("body")).select("d", each_shard.alias("shard"), "block", "kind", "uid", "id", "body")
    ready = graphs.select("d", "shard", each_block.alias("block"), F.lit(0).alias("kind"), none.alias("uid"), none.alias("id"), F.col("graph").alias("body"))
    keys = ["d", "shard", "block"]
    streams = ready.union(asked).repartition(shards * blocks, *keys).sortWithinPartitions(*keys, "kind")
    found = saved(streams.mapInArrow(search, "uid long, id long, n long, links array<long>"), "found")
    united = connected_components(found.select(F.col("id").alias("src"), F.explode("links").alias("dst")))
    n_links = found.groupBy("uid").agg(F.sum("n").alias("n"))
    component = F.coalesce("component", "id")
    out = points.join(n_links, "uid", "left").join(united, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").cast(kind).alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
