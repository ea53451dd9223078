"""The k nearest of query vectors among vectors that come in blocks, in numpy (V-01 ... V-09, K-02).

A cheap bound, taken for all pairs of a slice of queries and a block, leaves those pairs that may still be among the k
best found so far, and only they are scored in double precision. Bounds err on the side of leaving too much, so the
result is that of scoring every pair.
"""

from __future__ import annotations

import numpy as np

#: Queries in a slice, and pairs that are scored at once.
SLICE, PAIRS = 1024, 1 << 14
#: Scores are rounded to so many digits before they are ranked.
DIGITS, HALF = 9, 1e-9


def average_ranks(v: np.ndarray) -> np.ndarray:
    """Of each row's values, from 1; equal values share the mean of their ranks."""
    order = np.argsort(v, axis=1, kind="stable")
    x = np.take_along_axis(v, order, axis=1)
    at = np.broadcast_to(np.arange(v.shape[1]), v.shape)
    new = np.ones(v.shape, bool)
    new[:, 1:] = (x[:, 1:] != x[:, :-1]) & ~(np.isnan(x[:, 1:]) & np.isnan(x[:, :-1]))
    last = np.ones(v.shape, bool)
    last[:, :-1] = new[:, 1:]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    end = np.minimum.accumulate(np.where(last, at, v.shape[1])[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(v.shape)
    np.put_along_axis(out, order, (first + end) / 2 + 1, axis=1)
    return out


def prepared(metric: str, v: np.ndarray) -> np.ndarray:
    """What is compared: correlations are the cosines of centred values or ranks."""
    if metric == "spearman":
        v = average_ranks(v)
    return v - v.mean(axis=1, keepdims=True) if metric in ("pearson", "spearman") else v


def distinct(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first rows of each kind, and each row's kind."""
    rows = np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel()
    _, first, kind = np.unique(rows, return_index=True, return_inverse=True)
    return first, kind.ravel()


def lowest(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows without those that have k equal ones of lower id: no query has them among its k best."""
    first, kind = distinct(v)
    if len(first) == len(v):
        return np.arange(len(v))
    order = np.lexsort((ids, kind))
    starts = np.searchsorted(kind[order], np.arange(len(first)))
    return np.sort(order[np.arange(len(v)) - starts[kind[order]] < k])


class _Dots:
    """Products in single precision: cosine and what grows with it, dot, euclidean."""

    width = 1024

    def __init__(self, metric: str, q: np.ndarray):
        self.metric, self.norms = metric, np.linalg.norm(q, axis=1)
        self.slack = (q.shape[1] + 8) * 2.0**-23
        self.most = np.max(self.norms, initial=0.0)
        if metric != "euclidean":
            self.fq = np.divide(q, self.norms[:, None], out=np.zeros_like(q), where=self.norms[:, None] > 0).astype("<f4")
        else:
            self.q = q

    def block(self, v: np.ndarray) -> None:
        norms = np.linalg.norm(v, axis=1)
        if self.metric == "euclidean":
            scale = 2.0 ** np.ceil(np.log2(max(self.most, np.max(norms, initial=0.0)) or 1.0))
            if getattr(self, "scale", None) != scale:
                self.scale = scale
                self.fq = np.concatenate([self.q / scale, np.ones((len(self.q), 1))], axis=1).astype("<f4")
            v = np.concatenate([v / scale, -0.5 * (norms / scale)[:, None] ** 2], axis=1)
        elif self.metric == "dot":
            self.scale = np.max(norms, initial=0.0) or 1.0
            v = v / self.scale
        else:
            v = np.divide(v, norms[:, None], out=np.zeros_like(v), where=norms[:, None] > 0)
        self.fv = np.ascontiguousarray(v.astype("<f4").T)

    def _least(self, a: int, b: int, least: np.ndarray) -> np.ndarray:
        s = least - HALF
        if self.metric == "angular":
            return np.where(s > -1, np.cos(np.clip((1 - s) * (np.pi / 2), 0, np.pi)) - HALF, -np.inf) - self.slack
        if self.metric == "dot":
            by = self.norms[a:b] * self.scale
            return np.where(by > 0, s / by, -np.inf) - self.slack
        if self.metric == "euclidean":
            far = np.where(s > 0, 1 / s - 1, np.inf) / self.scale
            return ((self.norms[a:b] / self.scale) ** 2 - far * far) / 2 - 2 * self.slack
        return s - self.slack

    def pairs(self, a: int, b: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.fq[a:b] @ self.fv
        low = np.less(s, self._least(a, b, least).astype("<f4")[:, None])
        return np.divmod(np.flatnonzero(np.logical_not(low, out=low)), self.fv.shape[1])  # what isn't a number stays


class _Manhattan:
    """Sums of absolute differences of values cut to a range and counted in steps: 2 max(x, y) - x - y in 16 bits."""

    width = 1024

    def __init__(self, metric: str, q: np.ndarray):
        self.dims = min(q.shape[1], 4096)
        self.levels = 43_000 // self.dims  # their sum and half a sum of as much fit 16 bits
        low, high = np.nanpercentile(q[:, : self.dims], [0.05, 99.95]) if len(q) else (0.0, 1.0)
        self.low, self.step = (low, (high - low) / self.levels) if np.isfinite(high - low) and high > low else (0.0, 1.0)
        self.q = self._steps(q)
        self.sums = self.q.sum(axis=1, dtype=np.int64)
        self.out = np.empty((SLICE, self.width), np.uint16)

    def _steps(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(v), self.dims + 1), np.uint16)
        out[:, :-1] = np.nan_to_num(np.rint(np.clip((v[:, : self.dims] - self.low) / self.step, 0, self.levels)))
        return out

    def block(self, v: np.ndarray) -> None:
        steps = self._steps(v)
        sums = steps.sum(axis=1, dtype=np.int64)
        self.most = sums.max(initial=0)
        steps[:, -1] = (self.most - sums) // 2
        self.v = np.ascontiguousarray(steps.T)
        self.work = np.empty_like(self.v)

    def pairs(self, a: int, b: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = least - HALF
        far = np.where(s > 0, 1 / s - 1 + HALF, np.inf) / self.step + self.dims + 1 + self.sums[a:b]
        most = np.clip((far + self.most) / 2, 0, 65_535).astype(np.uint16)
        out = self.out[: b - a, : self.v.shape[1]]
        for x, sums in zip(self.q[a:b, :, None], out):
            np.maximum(self.v, x, out=self.work)
            np.add.reduce(self.work, axis=0, out=sums)
        return np.divmod(np.flatnonzero(out <= most[:, None]), out.shape[1])


class _Chebyshev:
    """Bitmaps of a block by value: of each of up to 64 dimensions, which vectors are at least or at most as great as an edge."""

    width, edges = 4096, 32

    def __init__(self, metric: str, q: np.ndarray):
        self.q = q[:, :64]
        low, high = np.nanpercentile(self.q, [0.5, 99.5], axis=0) if len(q) else np.zeros((2, self.q.shape[1]))
        some = np.isfinite(high - low) & (high > low)
        self.low = np.where(some, low, 0.0)
        self.step = np.where(some, high - low, self.edges - 1.0) / (self.edges - 1)

    def block(self, v: np.ndarray) -> None:
        self.n, dims, words = len(v), self.q.shape[1], -(-len(v) // 64)
        bits = np.zeros((2, dims, self.edges + 1, words * 64), bool)
        bits[0, :, 0, : self.n] = bits[1, :, -1, : self.n] = True
        at = self.low[:, None] + self.step[:, None] * np.arange(self.edges)
        x = v[:, :dims].T
        for d in range(dims):
            np.greater_equal(x[d], at[d][:, None], out=bits[0, d, 1:, : self.n])
            np.less_equal(x[d], at[d][:, None], out=bits[1, d, :-1, : self.n])
        self.table = np.packbits(bits, axis=-1, bitorder="little").view("<u8").reshape(-1, words)

    def pairs(self, a: int, b: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, q, n = least - HALF, self.q[a:b], self.edges
        far = np.where(s > 0, 1 / s - 1, np.inf)[:, None] * (1 + HALF) + HALF * (self.step + np.abs(q))
        whole = lambda x: np.nan_to_num(np.clip(x, 0, n)).astype(np.int64)
        from_, to = whole(np.floor((q - far - self.low) / self.step) + 1), whole(np.ceil((q + far - self.low) / self.step))
        at = np.concatenate([from_, to], axis=1) + np.arange(2 * q.shape[1]) * (n + 1)
        work, out = np.empty((at.shape[1], self.table.shape[1]), "<u8"), np.empty((b - a, self.table.shape[1]), "<u8")
        for rows, bits in zip(at, out):
            np.take(self.table, rows, axis=0, out=work, mode="clip")
            np.bitwise_and.reduce(work, axis=0, out=bits)
        row, word = np.nonzero(out)
        hit, bit = np.nonzero(np.unpackbits(out[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return row[hit], word[hit] * 64 + bit


class Nearest:
    """The ``k`` best of at least ``least`` of each query (ids, rows of ``q``) among what ``feed`` brings; ties by id."""

    def __init__(self, metric: str, k: int, least: float, ids: np.ndarray, q: np.ndarray):
        metric = {"dot_product": "dot"}.get(metric, metric)
        first, self.kind = distinct(q)
        self.metric, self.k, self.least, self.ids, self.q = metric, k, least, ids, q[first]
        self.scores = np.full((len(first), k), -np.inf)
        self.keys = np.full((len(first), k), np.iinfo(np.int64).max)
        self.worst = np.full(len(first), float(least))
        with np.errstate(all="ignore"):
            self.norms = np.linalg.norm(self.q, axis=1)
            self.bound = {"manhattan": _Manhattan, "chebyshev": _Chebyshev}.get(metric, _Dots)(metric, self.q)
        self.waiting, self.piece = [], max(64, 4 * k)

    def feed(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.waiting.append((ids, v))
        if sum(len(i) for i, _ in self.waiting) >= self.bound.width:
            self._work()

    def _work(self) -> None:
        ids, v = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, at = [], 0
        with np.errstate(all="ignore"):
            while at < len(ids):  # the first pieces are small, as nothing bounds them yet
                n = min(self.piece, self.bound.width)
                self._block(ids[at : at + n], v[at : at + n])
                at, self.piece = at + n, 2 * n

    def _block(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.bound.block(v)
        norms = np.linalg.norm(v, axis=1)
        for a in range(0, len(self.q), SLICE):
            b = min(a + SLICE, len(self.q))
            rows, cols = self.bound.pairs(a, b, self.worst[a:b])
            for at in range(0, len(rows), 16 * PAIRS):
                self._merge(rows[at : at + 16 * PAIRS] + a, cols[at : at + 16 * PAIRS], ids, v, norms)

    def _merge(self, rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, v: np.ndarray, norms: np.ndarray) -> None:
        parts = [self._exact(rows[at : at + PAIRS], cols[at : at + PAIRS], v, norms) for at in range(0, len(rows), PAIRS)]
        score = np.round(np.concatenate(parts), DIGITS)
        good = score >= self.worst[rows]
        rows, score, keys = rows[good], score[good], ids[cols[good]]
        touched = np.unique(rows)
        if not len(touched):
            return
        at = np.concatenate([np.repeat(touched, self.k), rows])
        score = np.concatenate([self.scores[touched].ravel(), score])
        keys = np.concatenate([self.keys[touched].ravel(), keys])
        order = np.lexsort((keys, -score, at))
        starts = np.searchsorted(at[order], touched)
        best = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.scores[touched], self.keys[touched] = score[best].reshape(-1, self.k), keys[best].reshape(-1, self.k)
        self.worst[touched] = np.maximum(self.least, self.scores[touched, -1])

    def _exact(self, rows: np.ndarray, cols: np.ndarray, v: np.ndarray, norms: np.ndarray) -> np.ndarray:
        x, y = self.q[rows], v[cols]
        if self.metric == "manhattan":
            return 1 / (1 + np.abs(x - y).sum(axis=1))
        if self.metric == "chebyshev":
            return 1 / (1 + np.abs(x - y).max(axis=1, initial=0.0))
        if self.metric == "euclidean":
            return 1 / (1 + np.sqrt(((x - y) ** 2).sum(axis=1)))
        dots = np.einsum("ij,ij->i", x, y)
        if self.metric == "dot":
            return dots
        by = self.norms[rows] * norms[cols]
        cos = np.divide(dots, by, out=np.zeros_like(dots), where=by > 0)
        return 1 - 2 * np.arccos(np.clip(cos, -1, 1)) / np.pi if self.metric == "angular" else cos

    def found(self, most: int = 1 << 14):
        """Arrays of query ids, keys and scores, of at most ``most`` queries at a time."""
        if self.waiting:
            self._work()
        for at in range(0, len(self.ids), most):
            kind = self.kind[at : at + most]
            rows, cols = np.nonzero(np.isfinite(self.scores[kind]) | (self.keys[kind] < np.iinfo(np.int64).max))
            yield self.ids[at : at + most][rows], self.keys[kind][rows, cols], self.scores[kind][rows, cols]
