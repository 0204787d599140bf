"""Beam search over a proximity graph, for many queries at once, and a graph that rows are added to in batches.

A graph is a matrix of places, a row for each node, filled up with -1.
"""

from __future__ import annotations

import numpy as np

from ..functions.distance import Metric

#: Nodes that each query expands in a step; queries handled together; allowed rows up to which a filter is answered by a scan.
EXPAND, TOGETHER, SCAN = 4, 512, 1024


def padded_matrix(lists: list[np.ndarray], width: int | None = None) -> np.ndarray:
    """Lists of places as a matrix, filled up with -1."""
    sizes = np.array([len(c) for c in lists], np.int64)
    out = np.full((len(lists), max(int(sizes.max(initial=0)), width or 0, 1)), -1, np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.concatenate([np.zeros(0, np.int64), *lists])
    return out


def beam_search(q: np.ndarray, x: np.ndarray, near: np.ndarray, starts: np.ndarray | int, beam: int, m: Metric) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances), a row for each query: the best `beam` rows seen, ascending, filled up with -1 and infinity.

    A query expands the nearest rows of its beam that it has not expanded yet, and stops once all of them are: every
    row left is then beyond the beam.  Ties go to the smaller place.
    """
    beam = min(beam, len(x))
    places, dist = np.full((len(q), max(beam, 0)), -1, np.int64), np.full((len(q), max(beam, 0)), np.inf)
    if beam < 1:
        return places, dist
    starts = np.broadcast_to(starts, len(q))
    for low in range(0, len(q), TOGETHER):
        part = slice(low, low + TOGETHER)
        places[part], dist[part] = _walk(q[part], x, near, starts[part], beam, m)
    return places, dist


def _walk(q: np.ndarray, x: np.ndarray, near: np.ndarray, starts: np.ndarray, beam: int, m: Metric) -> tuple[np.ndarray, np.ndarray]:
    n = len(q)
    seen = np.zeros((n, len(x)), bool)
    place, dist, done = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf), np.ones((n, beam), bool)
    place[:, 0], dist[:, 0], done[:, 0] = starts, m.pairs(q, x[starts]), False
    seen[np.arange(n), starts] = True
    active = np.arange(n)
    while len(active):
        turn = ~done[active]
        turn &= turn.cumsum(1) <= EXPAND
        row, column = np.nonzero(turn)  # of the nodes to expand
        who = active[row]
        done[who, column] = True
        new, owner = near[place[who, column]].ravel(), np.repeat(who, near.shape[1])
        fresh = (new >= 0) & ~seen[owner, new]
        cell = np.unique(owner[fresh] * len(x) + new[fresh])
        owner, new = np.divmod(cell, len(x))
        seen[owner, new] = True
        d = m.pairs(q[owner], x[new])
        keep = d <= dist[owner, -1]
        owner, new, d = owner[keep], new[keep], d[keep]
        if len(owner):
            first = np.searchsorted(owner, active)
            wide = int(np.diff(first, append=len(owner)).max())
            at = np.searchsorted(active, owner)
            more_place, more_dist = np.full((len(active), wide), -1, np.int64), np.full((len(active), wide), np.inf)
            more_place[at, np.arange(len(owner)) - first[at]], more_dist[at, np.arange(len(owner)) - first[at]] = new, d
            both_place, both_dist = np.concatenate([place[active], more_place], 1), np.concatenate([dist[active], more_dist], 1)
            both_done = np.concatenate([done[active], more_place < 0], 1)
            order = np.lexsort((both_place, both_dist), axis=1)[:, :beam]
            place[active], dist[active], done[active] = (np.take_along_axis(v, order, 1) for v in (both_place, both_dist, both_done))
        active = active[~done[active].all(1)]
    return place, dist


def filtered_search(q: np.ndarray, x: np.ndarray, near: np.ndarray, start: int, k: int, beam: int, m: Metric, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the best k allowed rows for each query, filled up with -1 and infinity; never fewer than min(k, allowed rows).

    Few allowed rows are compared outright.  Else the beam is doubled for the queries whose beam holds fewer than k allowed rows, and
    those that would need half of the rows are answered by a comparison too.
    """
    places, dist = np.full((len(q), max(k, 0)), -1, np.int64), np.full((len(q), max(k, 0)), np.inf)
    some = np.flatnonzero(allowed)
    if k < 1 or not len(some):
        return places, dist
    todo, wide = np.arange(len(q)), max(beam, k)
    while len(todo) and len(some) > SCAN and wide <= len(x) // 2:
        found, d = beam_search(q[todo], x, near, start, wide, m)
        fits = (found >= 0) & allowed[found]
        enough = fits.sum(1) >= k
        order = np.argsort(~fits[enough], axis=1, kind="stable")[:, :k]  # allowed ones first, in order of distance
        places[todo[enough]], dist[todo[enough]] = (np.take_along_axis(v[enough], order, 1) for v in (found, d))
        todo, wide = todo[~enough], 2 * wide
    for low in range(0, len(todo), TOGETHER):
        own = todo[low : low + TOGETHER]
        d = m.kernel(q[own], x[some])
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        places[own, : order.shape[1]], dist[own, : order.shape[1]] = some[order], np.take_along_axis(d, order, 1)
    return places, dist


class DeltaGraph:
    """A graph beside a base index that takes added rows in batches.

    The rows of a batch find their candidates together, in the graph and among themselves; links go both
    ways, and a list that grows over the degree is pruned anew.
    """

    def __init__(self, dim: int, m: Metric, degree: int = 32, pool: int = 64, alpha: float = 1.2, rule: str = "vamana"):
        self.x, self.near, self.start = np.zeros((0, dim)), np.full((0, degree), -1, np.int64), 0
        self.m, self.degree, self.pool, self.alpha, self.rule = m, degree, pool, alpha, rule

    def add(self, rows: np.ndarray) -> range:
        """Places of the added rows; the entry is the medoid of all rows afterwards."""
        from .graph import chosen_neighbors, linked_back

        first, own = len(self.x), np.arange(len(self.x), len(self.x) + len(rows))
        if not len(rows):
            return range(first, first)
        old = beam_search(rows, self.x, self.near, self.start, self.pool, self.m)[0] if first else np.zeros((len(rows), 0), np.int64)
        self.x = np.concatenate([self.x, rows])
        among = self.m.kernel(rows, rows)
        np.fill_diagonal(among, np.inf)
        wide = min(self.pool, len(rows) - 1)
        peers = first + np.argpartition(among, wide - 1, axis=1)[:, :wide] if wide > 0 else np.zeros((len(rows), 0), np.int64)
        new = chosen_neighbors(own, np.concatenate([old, peers], 1), self.x, self.degree, self.alpha, self.m, rule=self.rule, fill=False)
        self.near = linked_back(np.concatenate([self.near, new]), self.x, self.degree, self.alpha, self.m, rule=self.rule)
        self.start = int(np.argmin(self.m.kernel(self.x.mean(0, keepdims=True), self.x)[0]))
        return range(first, len(self.x))

    def search(self, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the best k for each query."""
        places, d = beam_search(q, self.x, self.near, self.start, max(beam, 1), self.m)
        return places[:, :k], d[:, :k]
