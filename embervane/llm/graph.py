"""A robust-pruned directed graph over unit vectors, built and searched in batches with numpy."""

from __future__ import annotations

import numpy as np

_ONE, _IDS, _NONE, _SCALE = np.uint64(1), np.uint64(0x7FFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF), np.float32(1 << 22)


def _keys(ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
    far = np.rint(np.clip(1 - sims, 0, 4) * _SCALE).astype(np.uint64)
    return (far << np.uint64(32)) | (ids.astype(np.uint64) & _IDS) << _ONE | _ONE


def within(x: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact: (row of ``q``, row of ``x``, similarity) of every two at or above ``least``, similarities in the steps of the beam search."""
    step, found = max(1, 8_000_000 // max(1, len(x))), []
    for lo in range(0, len(q), step):
        s = q[lo : lo + step] @ x.T
        at = np.flatnonzero(s >= least - 1e-6)
        s = 1 - np.rint(np.clip(1 - s.ravel()[at], 0, 4) * _SCALE) / _SCALE
        at, s = at[s >= least], s[s >= least]
        found.append((at // len(x) + lo, at % len(x), s))
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    return tuple(np.concatenate(c) for c in zip(none, *found))


class PrunedGraph:
    """Directed graph over the rows of ``x`` (unit vectors, float32) for nearest neighbours by cosine.

    Points are inserted in batches of growing size: a greedy beam search on the graph so far proposes
    neighbours, robust pruning keeps a candidate only if no kept one is nearer to it by the factor ``alpha``,
    and every edge is answered by its reverse. Lists that run over are pruned again. Searches start at the
    best of ``n_entry`` fixed entry points.
    """

    def __init__(self, x: np.ndarray, degree: int = 16, beam: int = 24, alpha: float = 1.2, n_entry: int = 256, seed: int = 7, batch: int = 2048):
        self.x, self.degree, self.beam, self.alpha2, self.batch = np.ascontiguousarray(x, np.float32), degree, beam, np.float32(alpha * alpha), batch
        n = len(x)
        self.width = 2 * degree
        self.links = np.full((n, self.width), -1, np.int32)
        self.count = np.zeros(n, np.int32)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.entries = order[: min(n, n_entry)]
        self.entry_x = self.x[self.entries]
        done = self._first(order)
        while done < n:
            new = order[done : done + min(done, batch)]
            self._insert(new)
            done += len(new)

    def _first(self, order: np.ndarray) -> int:
        ids = order[: min(len(order), 4 * self.beam)]
        if len(ids) > 1:
            s = self.x[ids] @ self.x[ids].T
            np.fill_diagonal(s, -np.inf)
            k = min(self.beam, len(ids) - 1)
            at = np.argsort(-s, axis=1)[:, :k]
            self._connect(ids, ids[at], np.take_along_axis(s, at, 1))
        return len(ids)

    def _insert(self, new: np.ndarray) -> None:
        ids, sims = self.search(self.x[new], self.beam)
        # points of one batch do not see each other in the graph yet
        own = self.x[new] @ self.x[new].T
        np.fill_diagonal(own, -np.inf)
        k = min(8, len(new) - 1)
        if k > 0:
            at = np.argpartition(-own, k - 1, axis=1)[:, :k]
            ids = np.concatenate([ids, new[at]], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, at, 1)], 1)
            o = np.argsort(-sims, axis=1)[:, : self.beam]
            ids, sims = np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)
        self._connect(new, ids, sims)

    def _prune(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Robust pruning of candidates (sorted by falling similarity) of many points at once: kept ids, -1 behind."""
        b, c = ids.shape
        v = self.x[np.maximum(ids, 0)]
        near = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        far = 2 - 2 * sims
        alive = (ids >= 0) & np.isfinite(sims)
        kept = np.zeros((b, c), bool)
        n = np.zeros(b, np.int32)
        for j in range(c):
            take = alive[:, j] & (n < self.degree)
            kept[:, j] = take
            n += take
            # copies of a kept point stay, whatever the rounding
            alive &= ~(take[:, None] & (self.alpha2 * near[:, j] <= far - 1e-5))
        o = np.argsort(~kept, axis=1, kind="stable")[:, : self.degree]
        return np.where(np.take_along_axis(kept, o, 1), np.take_along_axis(ids, o, 1), -1)

    def _connect(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        out = self._prune(ids, sims)
        self.links[points, : out.shape[1]] = out
        self.count[points] = (out >= 0).sum(1)
        src, slot = np.nonzero(out >= 0)
        to, back = out[src, slot], points[src]
        o = np.argsort(to, kind="stable")
        to, back = to[o], back[o]
        heads, first, n = np.unique(to, return_index=True, return_counts=True)
        place = self.count[to] + np.arange(len(to)) - np.repeat(first, n)
        fits = place < self.width
        self.links[to[fits], place[fits]] = back[fits]
        full = heads[self.count[heads] + n > self.width]
        self.count[heads] = np.minimum(self.count[heads] + n, self.width)
        if len(full):
            rest = np.flatnonzero(~fits)
            at = np.searchsorted(full, to[rest])
            extra = place[rest] - self.width
            more = np.full((len(full), int(extra.max()) + 1), -1, np.int32)
            more[at, extra] = back[rest]
            for lo in range(0, len(full), self.batch):
                p = full[lo : lo + self.batch]
                cand = np.concatenate([self.links[p], more[lo : lo + self.batch]], 1)
                s = np.matmul(self.x[np.maximum(cand, 0)], self.x[p][:, :, None])[:, :, 0]
                s[(cand < 0) | (cand == p[:, None])] = -np.inf
                k = min(cand.shape[1], self.width)
                o = np.argsort(-s, axis=1)[:, :k]
                kept = self._prune(np.take_along_axis(cand, o, 1), np.take_along_axis(s, o, 1))
                self.links[p] = -1
                self.links[p, : kept.shape[1]] = kept
                self.count[p] = (kept >= 0).sum(1)

    def search(self, q: np.ndarray, beam: int, start: np.ndarray | None = None, expand: int = 3, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for every row of ``q``: (ids, similarities) of ``beam`` columns by falling similarity.

        ``start``: ids of points equal to the queries, from which the search then sets out. Missing entries
        have id -1 and similarity -inf.
        """
        parts = [self._beam(q[lo : lo + rows], beam, None if start is None else start[lo : lo + rows], expand) for lo in range(0, len(q), rows)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _beam(self, q, beam, start, expand):
        """One sorted array of keys a query: distance, id and whether the id is still to be expanded, in 64 bits,
        so that one sort orders them, brings copies together and puts the expanded copy first."""
        b = len(q)
        keys = np.full((b, beam), _NONE, np.uint64)
        if start is None:
            s = q @ self.entry_x.T
            k = min(4, len(self.entries), beam)
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            keys[:, :k] = _keys(self.entries[at], np.take_along_axis(s, at, 1))
            keys.sort(axis=1)
        else:
            keys[:, 0] = _keys(start, np.ones(b, np.float32))
        done = np.empty_like(keys)
        rows = np.arange(b)
        while True:
            open_ = ((keys & _ONE) == 1) & (keys != _NONE)
            live = open_.any(1)
            if not live.all():
                done[rows[~live]] = keys[~live]
                if not live.any():
                    break
                rows, q, keys, open_ = rows[live], q[live], keys[live], open_[live]
            rank = open_.cumsum(1, dtype=np.int16)
            pick = open_ & (rank <= expand)
            r, c = np.nonzero(pick)
            node = np.full((len(rows), expand), -1, np.int32)
            node[r, rank[r, c] - 1] = ((keys[r, c] >> _ONE) & _IDS).astype(np.int32)
            keys[r, c] &= ~_ONE
            near = self.links[node]
            near[node < 0] = -1
            near = near.reshape(len(rows), -1)
            s = np.einsum("bkd,bd->bk", self.x[near], q)
            fresh = _keys(near, s)
            fresh[near < 0] = _NONE
            keys = np.concatenate([keys, fresh], 1)
            keys.sort(axis=1)
            same = (keys[:, 1:] >> _ONE) == (keys[:, :-1] >> _ONE)
            keys[:, 1:][same] = _NONE
            keys = np.sort(keys[:, : 3 * beam], axis=1)[:, :beam]
        none = done == _NONE
        ids = np.where(none, -1, ((done >> _ONE) & _IDS).astype(np.int64)).astype(np.int32)
        return ids, np.where(none, np.float32(-np.inf), (1 - (done >> np.uint64(32)).astype(np.float32) / _SCALE).astype(np.float32))
