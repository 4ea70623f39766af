"""A hierarchical navigable small-world graph over unit vectors, built and searched many rows at a time in numpy."""

from __future__ import annotations

import io

import numpy as np


class Hnsw:
    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 40, seed: int = 3, level: np.ndarray | None = None, heuristic: bool = True):
        """``x``: unit rows. Rows enter in the order given, in batches that also see one another.

        ``level`` gives each row's highest layer (else drawn by ``seed``); without ``heuristic`` a row links to its nearest.
        """
        self.x, self.heuristic = np.ascontiguousarray(x, np.float32), heuristic
        n = len(x)
        if level is None:
            level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(m)).astype(np.int64), 6)
        self.top = int(level.max(initial=0))
        self.links = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(self.top + 1)]
        self.entry = np.array([int(level.argmax())] if n else [], np.int64)
        order = np.concatenate([self.entry, np.delete(np.arange(n), self.entry)]).astype(np.int64)
        done = 0
        while done < n:
            batch = order[done : done + min(1024, max(64, done))]
            self._insert(batch, level[batch], order[:done], ef, m)
            done += len(batch)
        if heuristic:
            self._mend()

    def _mend(self, least: int = 3, spare: int = 8) -> None:
        """Rows that few others link to get links from their own neighbours, in spare places: all stay reachable."""
        n, links = len(self.x), self.links[0]
        into = np.bincount(links[links >= 0], minlength=n) if n else np.zeros(0, np.int64)
        extra, used = np.full((n, spare), -1, np.int32), np.zeros(n, np.int64)
        for i in np.flatnonzero(into < least).tolist():
            got = into[i]
            for j in links[i].tolist():
                if j >= 0 and got < least and used[j] < spare and i not in links[j]:
                    extra[j, used[j]] = i
                    used[j] += 1
                    got += 1
        self.links[0] = np.hstack([links, extra])

    def _insert(self, batch: np.ndarray, level: np.ndarray, before: np.ndarray, ef: int, m: int) -> None:
        at = np.tile(self.entry, (len(batch), 1))
        among = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(among, -2)
        for k in range(self.top, -1, -1):
            new = np.flatnonzero(level >= k)
            if len(before):
                ids, sim = self._beam(self.x[batch], at, ef if k == 0 else 12, k)
                at = ids[:, :4]
            else:
                ids, sim = np.full((len(batch), 0), -1, np.int64), np.zeros((len(batch), 0), np.float32)
            if not len(new):
                continue
            own = among[np.ix_(new, new)]
            near = np.argsort(-own, axis=1)[:, : min(2 * m, len(new) - 1)]
            ids = np.hstack([ids[new], batch[new][near]])
            sim = np.hstack([sim[new], np.take_along_axis(own, near, 1)])
            picked = self._select(batch[new], ids, sim, m)
            self.links[k][batch[new], :m] = picked
            self._back(k, batch[new], picked)

    def _select(self, base: np.ndarray, ids: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
        """Of each row's candidates those nearer to it than to one taken before; then the nearest of the rest, up to m."""
        sim = np.where(ids >= 0, sim, -3.0)
        order = np.argsort(-sim, axis=1, kind="stable")[:, : 4 * m]
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        out = np.full((len(base), m), -1, np.int64)
        for i in range(0, len(base), 512):
            a, s = ids[i : i + 512], sim[i : i + 512]
            if not self.heuristic:
                out[i : i + 512, : min(m, a.shape[1])] = np.where(s > -3.0, a, -1)[:, :m]
                continue
            v = self.x[np.maximum(a, 0)]
            cross = v @ v.transpose(0, 2, 1)
            taken, held = np.zeros(a.shape, bool), np.full(a.shape, -4.0, np.float32)
            count = np.zeros(len(a), np.int64)
            for c in range(a.shape[1]):
                ok = (s[:, c] > held[:, c]) & (a[:, c] >= 0) & (count < m)
                taken[:, c] = ok
                count += ok
                held = np.where(ok[:, None], np.maximum(held, cross[:, c]), held)
            first = np.argsort(np.where(a >= 0, np.where(taken, 0, 1), 2), axis=1, kind="stable")[:, :m]
            got = np.take_along_axis(a, first, 1)
            out[i : i + 512, : got.shape[1]] = got
        return out

    def _back(self, k: int, new: np.ndarray, picked: np.ndarray) -> None:
        """Links from those picked to the new rows; full lists are chosen anew."""
        to, of = picked.ravel(), np.repeat(new, picked.shape[1])
        of, to = of[to >= 0], to[to >= 0]
        if not len(to):
            return
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        nodes, lead, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(lead, count)
        width = min(int(count.max()), 64)
        more = np.full((len(nodes), width), -1, np.int64)
        fits = place < width
        more[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = of[fits]
        have = self.links[k][nodes].astype(np.int64)
        more[(more[:, :, None] == have[:, None, :]).any(2)] = -1
        ids, most = np.hstack([have, more]), have.shape[1]
        few = (ids >= 0).sum(1) <= most
        if few.any():
            part = ids[few]
            self.links[k][nodes[few]] = np.take_along_axis(part, np.argsort(part < 0, axis=1, kind="stable"), 1)[:, :most]
        for i in range(0, int((~few).sum()), 2048):
            part, base = ids[~few][i : i + 2048], nodes[~few][i : i + 2048]
            sim = np.einsum("bd,bcd->bc", self.x[base], self.x[np.maximum(part, 0)])
            self.links[k][base] = self._select(base, part, sim, most)

    def _beam(self, q: np.ndarray, at: np.ndarray, ef: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best rows that a beam of that width finds on layer k, best first; -1 where there are fewer."""
        n, b = len(self.x), len(q)
        ids, sims = np.full((b, ef), -1, np.int64), np.full((b, ef), -3.0, np.float32)
        at = at[:, :ef]
        seen = np.zeros((b, n), bool)
        rows = np.arange(b)
        sim = np.where(at >= 0, np.einsum("bd,bcd->bc", q, self.x[np.maximum(at, 0)]), -3.0)
        seen[rows[:, None].repeat(at.shape[1], 1)[at >= 0], at[at >= 0]] = True
        ids[:, : at.shape[1]], sims[:, : at.shape[1]] = at, sim
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        fresh = ids >= 0
        while True:
            act = np.flatnonzero(fresh.any(1))
            if not len(act):
                return ids, sims
            j = fresh[act].argmax(1)  # beams are sorted: the first is the best
            fresh[act, j] = False
            to = self.links[k][ids[act, j]].astype(np.int64)
            ok = (to >= 0) & ~seen[act[:, None], to]
            seen[act[:, None].repeat(to.shape[1], 1)[ok], to[ok]] = True
            some = ok.any(1)
            act, to, ok = act[some], to[some], ok[some]
            if not len(act):
                continue
            sim = np.where(ok, np.matmul(self.x[np.maximum(to, 0)], q[act][:, :, None])[:, :, 0], np.float32(-3.0))
            sim[sim <= sims[act, -1][:, None]] = -3.0
            better = (sim > -3.0).any(1)
            act, to, sim = act[better], to[better], sim[better]
            if not len(act):
                continue
            allsim = np.hstack([sims[act], sim])
            order = np.argsort(-allsim, axis=1, kind="stable")[:, :ef]
            sims[act] = np.take_along_axis(allsim, order, 1)
            ids[act] = np.where(sims[act] > -3.0, np.take_along_axis(np.hstack([ids[act], to]), order, 1), -1)
            fresh[act] = np.take_along_axis(np.hstack([fresh[act], sim > -3.0]), order, 1) & (ids[act] >= 0)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.ascontiguousarray(q, np.float32)
        at = np.tile(self.entry, (len(q), 1))
        for k in range(self.top, 0, -1):
            at = self._beam(q, at, 4, k)[0]
        return self._beam(q, at, max(ef, 4), 0)

    def search_allowed(self, q: np.ndarray, ef: int, allowed: np.ndarray) -> np.ndarray:
        """The ``ef`` best rows of those ``allowed`` (a mask) by a beam over all rows, -1 where there are fewer.

        A beam that holds fewer of them than that is widened, until it does or is as wide as the graph.
        """
        want = min(ef, int(allowed.sum()))
        out, todo, wide = np.full((len(q), ef), -1, np.int64), np.arange(len(q)), min(ef, len(self.x))
        while len(todo) and want:
            more = []
            for i in range(0, len(todo), 256):
                part = todo[i : i + 256]
                ids = self.search(q[part], wide)[0]
                ok = (ids >= 0) & allowed[ids]
                short = (ok.sum(1) < want) & (wide < len(self.x))
                first = np.argsort(~ok, axis=1, kind="stable")[:, :ef]
                got = np.where(np.take_along_axis(ok, first, 1), np.take_along_axis(ids, first, 1), -1)
                out[part[~short], : got.shape[1]] = got[~short]
                more.append(part[short])
            todo, wide = np.concatenate(more), min(4 * wide, len(self.x))
        return out

    def within(self, q: np.ndarray, least: float, ef: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of q, row of x) found at a similarity of ``least`` or more. A beam that is full of such rows is widened."""
        left, right = [], []
        for i in range(0, len(q), block):
            todo, wide = np.arange(i, min(i + block, len(q))), ef
            while len(todo):
                wide = min(wide, len(self.x))
                step = max(1, min(block, (1 << 22) // wide))
                more = []
                for j in range(0, len(todo), step):
                    part = todo[j : j + step]
                    ids, sims = self.search(q[part], wide)
                    full = (sims[:, -1] >= least) & (ids[:, -1] >= 0) & (wide < len(self.x))
                    hit = (sims >= least) & (ids >= 0) & ~full[:, None]
                    r, c = np.nonzero(hit)
                    left.append(part[r])
                    right.append(ids[r, c])
                    more.append(part[full])
                todo, wide = np.concatenate(more), wide * 2
        return np.concatenate(left), np.concatenate(right)

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, x=self.x, entry=self.entry, **{f"k{i}": k for i, k in enumerate(self.links)})
        return f.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Hnsw:
        g, z = cls.__new__(cls), np.load(io.BytesIO(raw))
        g.x, g.entry = z["x"], z["entry"]
        g.links = [z[f"k{i}"] for i in range(len(z.files) - 2)]
        g.top = len(g.links) - 1
        return g
