"""Hierarchical navigable small-world graphs over unit vectors, built and searched for many vectors at a time."""

from __future__ import annotations

import math

import numpy as np

FLAT = 512  # layers of at most so many nodes are searched whole
BATCH = 256
EXPAND = 4


def beam_search(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef best nodes met for each query, best first: ids (-1: none) and similarities.

    x: nodes by dimension; near: the neighbours of each node, -1 padded; entry: a node for each query. All
    queries go on in step: each expands its EXPAND best nodes not yet expanded until all of its beam are.
    """
    n_q = len(q)
    ids = np.full((n_q, ef), -1, np.int32)
    sims = np.full((n_q, ef), -2.0, np.float32)
    done = np.ones((n_q, ef), bool)
    seen = np.zeros((n_q, len(x)), bool)
    all_rows = np.arange(n_q)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", x[entry], q), False
    seen[all_rows, entry] = True
    rows = all_rows
    k = min(EXPAND, ef)
    while len(rows):
        open_ = np.where(done[rows], np.float32(-3), sims[rows])
        pick = np.argpartition(-open_, k - 1, axis=1)[:, :k] if k < ef else np.tile(np.arange(ef), (len(rows), 1))
        live = np.take_along_axis(open_, pick, 1) > -2.5
        alive = live.any(1)
        rows, pick, live = rows[alive], pick[alive], live[alive]
        if not len(rows):
            break
        done[rows[:, None], pick] = True
        nodes = np.where(live, ids[rows[:, None], pick], -1)
        found = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(len(rows), -1)
        new = (found >= 0) & ~seen[rows[:, None], found]
        r, c = np.nonzero(new)
        node = found[r, c]
        # a node reached twice in one step counts once
        flat = rows[r].astype(np.int64) * len(x) + node
        _, once = np.unique(flat, return_index=True)
        r, node = r[once], node[once]
        seen[rows[r], node] = True
        s = np.einsum("ij,ij->i", x[node], q[rows[r]])
        better = s > sims[rows[r]].min(1)
        r, node, s = r[better], node[better], s[better]
        if not len(r):
            continue
        count = np.bincount(r, minlength=len(rows))
        width = int(count.max())
        place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        more_ids = np.full((len(rows), width), -1, np.int32)
        more_sims = np.full((len(rows), width), -2.0, np.float32)
        more_ids[r, place], more_sims[r, place] = node, s
        both_s = np.concatenate((sims[rows], more_sims), 1)
        both_i = np.concatenate((ids[rows], more_ids), 1)
        both_d = np.concatenate((done[rows], more_ids < 0), 1)
        best = np.argpartition(-both_s, ef - 1, axis=1)[:, :ef]
        sims[rows], ids[rows], done[rows] = (np.take_along_axis(a, best, 1) for a in (both_s, both_i, both_d))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    """Nodes in layers, the highest first: (rows of x, neighbours by place in the layer). Vectors within `tight` of a node join it.

    node_of: the node of each vector; nodes: the vector that each node is.
    """

    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 64, tight: float | None = None, seed: int = 7):
        n = len(x)
        draw = np.random.Generator(np.random.PCG64(seed)).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-300)) / math.log(m)).astype(int)
        order = np.argsort(-level, kind="stable")
        self.tight = tight
        self.upper: list[tuple[np.ndarray, np.ndarray]] = []
        self.m = m
        for layer in range(int(level.max(initial=0)), 0, -1):
            rows = order[: int((level >= layer).sum())]
            if len(rows) > FLAT or not self.upper or len(self.upper[-1][0]) < FLAT:
                if len(rows) <= FLAT:
                    self.upper = [(rows, np.zeros((0, 0), np.int32))]  # one flat layer on top is enough
                else:
                    self.upper.append((rows, self._layer(x[rows], m, ef, None)[1]))
        self.x_upper = [x[rows] for rows, _ in self.upper]
        nodes, near, node_of = self._layer(x[order], m, ef, tight)
        self.nodes, self.near = order[nodes], near
        self.node_of = np.empty(n, np.int32)
        self.node_of[order] = node_of
        self.x = np.ascontiguousarray(x[self.nodes])

    def _enter(self, q: np.ndarray, x_upper: list[np.ndarray]) -> np.ndarray:
        """The vector (place in the insertion order) near each query, found through the layers above."""
        at = np.zeros(len(q), np.int64)
        for i, (rows, near) in enumerate(self.upper):
            at = np.argmax(q @ x_upper[i].T, axis=1) if len(rows) <= FLAT else beam_search(x_upper[i], near, q, at, 4)[0][:, 0]
        return at  # layers hold the first vectors of one order, so a place is the same in all

    def _layer(self, x: np.ndarray, m: int, ef: int, tight: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the nodes, neighbours, node of each place) for vectors in insertion order."""
        n, wide = len(x), 2 * m
        x_upper = [x[: len(rows)] for rows, _ in self.upper]
        nodes, node_of = np.zeros(n, np.int64), np.full(n, -1, np.int32)
        own = np.zeros_like(x)
        near, sim = np.full((n, wide), -1, np.int32), np.full((n, wide), -2.0, np.float32)
        count = start = 0
        while start < n:
            end = min(n, start + (BATCH if count >= FLAT else min(BATCH, FLAT - count)))
            q = x[start:end]
            if count <= FLAT:
                s = q @ own[:count].T
                ids = np.broadcast_to(np.arange(count, dtype=np.int32), s.shape)
            else:
                entry = node_of[np.minimum(self._enter(q, x_upper), start - 1)]
                ids, s = beam_search(own[:count], near[:count], q, entry, ef)
            among = q @ q.T
            np.fill_diagonal(among, -2)
            fresh = np.ones(len(q), bool)
            if tight is not None:
                if count:
                    best = np.argmax(s, axis=1)
                    joins = s[np.arange(len(q)), best] >= tight
                    node_of[start:end][joins] = ids[np.arange(len(q)), best][joins]
                    fresh &= ~joins
                for i in np.flatnonzero(fresh & (np.tril(among) >= tight).any(1)):
                    to = np.flatnonzero((among[i, :i] >= tight) & fresh[:i])
                    if len(to):
                        fresh[i] = False
                        node_of[start + i] = -2 - to[0]
            at = np.flatnonzero(fresh)
            number = np.full(len(q), -1, np.int32)
            number[at] = count + np.arange(len(at))
            node_of[start:end][at] = number[at]
            late = node_of[start:end] < -1
            node_of[start:end][late] = number[-2 - node_of[start:end][late]]
            nodes[count : count + len(at)] = start + at
            own[count : count + len(at)] = q[at]
            if len(at):
                all_ids = np.concatenate((ids[at], np.broadcast_to(number[at], (len(at), len(at)))), 1)
                all_sims = np.concatenate((np.where(ids[at] >= 0, s[at], -2), among[np.ix_(at, at)]), 1)
                self._link(near, sim, number[at], all_ids, all_sims, m)
                count += len(at)
            start = end
        return nodes[:count], near[:count], node_of

    @staticmethod
    def _link(near: np.ndarray, sim: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> None:
        wide = near.shape[1]
        k = min(m, ids.shape[1])
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        to, s = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        ok = s > -1.5
        a, b, s = np.repeat(new, k)[ok.ravel()], to[ok], s[ok]
        # both ways; a node keeps its `wide` best
        src, dst, s = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((s, s))
        pair = src.astype(np.int64) * len(near) + dst
        _, once = np.unique(pair, return_index=True)
        src, dst, s = src[once], dst[once], s[once]
        order = np.lexsort((-s, src))
        src, dst, s = src[order], dst[order], s[order]
        who, first, n = np.unique(src, return_index=True, return_counts=True)
        rank = np.arange(len(src)) - np.repeat(first, n)
        keep = rank < wide
        row = np.repeat(np.arange(len(who)), n)[keep]
        more_i, more_s = np.full((len(who), wide), -1, np.int32), np.full((len(who), wide), -2.0, np.float32)
        more_i[row, rank[keep]], more_s[row, rank[keep]] = dst[keep], s[keep]
        both_i, both_s = np.concatenate((near[who], more_i), 1), np.concatenate((sim[who], more_s), 1)
        best = np.argpartition(-both_s, wide - 1, axis=1)[:, :wide]
        near[who], sim[who] = np.take_along_axis(both_i, best, 1), np.take_along_axis(both_s, best, 1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and similarities of the ef best nodes met for each query, best first."""
        ef = min(ef, len(self.x))
        if len(self.x) <= FLAT or ef >= len(self.x):
            s = q @ self.x.T
            best = np.argpartition(-s, ef - 1, axis=1)[:, :ef]
            s = np.take_along_axis(s, best, 1)
            order = np.argsort(-s, axis=1)
            return np.take_along_axis(best, order, 1).astype(np.int32), np.take_along_axis(s, order, 1)
        place = self._enter(q, self.x_upper)
        entry = self.node_of[self.upper[-1][0][place]] if self.upper else np.zeros(len(q), np.int32)
        return beam_search(self.x, self.near, q, entry, ef)
