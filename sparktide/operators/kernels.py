"""Factorization kernels on one node: sparse products, start values, and the multiplicative solvers.

The distributed solver runs the same updates block by block (see factorize).
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np

EPS = 1e-10


#: Non-zeros that one thread multiplies at a time.
CHUNK = 1 << 17
_THREADS = min(8, os.cpu_count() or 1)


class Sparse:
    """A sparse matrix by rows and, for transposed products, by columns; empty rows and columns are fine."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        by_row = np.lexsort((col, row))
        self.row, self.col, self.val = row[by_row], col[by_row], val[by_row].astype(np.float64)
        by_col = np.lexsort((self.row, self.col))
        self._t = (self.col[by_col], self.row[by_col], self.val[by_col])
        self._cuts: dict[bool, tuple] = {}
        self._threads = _THREADS

    def arrays(self) -> dict[str, np.ndarray]:
        """What products need, so that of() makes the matrix again without sorting."""
        out = {}
        for transposed, (at, val) in enumerate(((self.col, self.val), self._t[1:])):
            first, rows, _ = self._runs(bool(transposed))
            out |= {f"first{transposed}": first, f"rows{transposed}": rows, f"at{transposed}": at, f"val{transposed}": val}
        return out

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], shape: tuple[int, int]) -> "Sparse":
        """For products in one thread only; arrays may be mapped from files."""
        m = cls.__new__(cls)
        m.shape, m.row, m._threads, m._cuts = shape, None, 1, {}
        m.col, m.val, m._t = arrays["at0"], arrays["val0"], (None, arrays["at1"], arrays["val1"])
        for transposed in (False, True):
            first, rows = arrays[f"first{transposed:d}"], arrays[f"rows{transposed:d}"]
            m._cuts[transposed] = (first, rows, cls._chunks(first, len(m.val)))
        return m

    @staticmethod
    def _chunks(first: np.ndarray, n: int) -> list[tuple[int, int]]:
        at = np.unique(np.searchsorted(first, np.arange(0, n, CHUNK)))
        at = at[at < len(first)]
        return list(zip(at.tolist(), [*at[1:].tolist(), len(first)], strict=True))

    def _runs(self, transposed: bool) -> tuple:
        """Where rows start, and chunks of about CHUNK non-zeros that begin with a row."""
        if transposed not in self._cuts:
            out_at = self._t[0] if transposed else self.row
            first = np.flatnonzero(np.append(True, out_at[1:] != out_at[:-1])) if len(out_at) else np.zeros(0, np.int64)
            self._cuts[transposed] = (first, out_at[first], self._chunks(first, len(out_at)))
        return self._cuts[transposed]

    def _product(self, transposed: bool, b: np.ndarray) -> np.ndarray:
        in_at, val = self._t[1:] if transposed else (self.col, self.val)
        out = np.zeros((self.shape[1] if transposed else self.shape[0], b.shape[1]))
        first, rows, chunks = self._runs(transposed)
        columns = np.ascontiguousarray(b.T)

        def part(lo: int, hi: int) -> None:
            s = slice(first[lo], first[hi] if hi < len(first) else len(val))
            for j, c in enumerate(columns):
                out[rows[lo:hi], j] = np.add.reduceat(val[s] * c[in_at[s]], first[lo:hi] - first[lo])

        if len(chunks) < 2 or self._threads < 2:
            for c in chunks:
                part(*c)
        else:
            with ThreadPoolExecutor(self._threads) as pool:
                list(pool.map(lambda c: part(*c), chunks))
        return out

    def mul(self, b: np.ndarray) -> np.ndarray:
        """V b."""
        return self._product(False, b)

    def tmul(self, b: np.ndarray) -> np.ndarray:
        """V' b."""
        return self._product(True, b)


def spectral_norm(x: np.ndarray) -> float:
    """Largest singular value of a matrix that is thin in one direction."""
    g = x @ x.T if x.shape[0] < x.shape[1] else x.T @ x
    return float(np.sqrt(max(0.0, np.linalg.eigvalsh(g)[-1])))


def svd(v: Sparse, k: int, rounds: int = 12, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest singular triplets by subspace iteration; each left vector's largest entry is positive."""
    k = min(k, *v.shape)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1], min(k + 8, *v.shape))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(v.tmul(np.linalg.qr(v.mul(q))[0]))[0]
    u, s, w = np.linalg.svd(v.mul(q), full_matrices=False)
    vt = (q @ w.T).T
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return (u * sign)[:, :k], s[:k], (vt * sign[:, None])[:k]


def nndsvd(v: Sparse, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start values from the signs of the singular vectors: the dominant half of each pair."""
    u, s, vt = svd(v, k)
    w, h = np.zeros((v.shape[0], k)), np.zeros((k, v.shape[1]))
    w[:, 0], h[0] = np.sqrt(s[0]) * np.abs(u[:, 0]), np.sqrt(s[0]) * np.abs(vt[0])
    for j in range(1, len(s)):
        best = max(((np.linalg.norm(a) * np.linalg.norm(b), i, a, b) for i, (a, b) in enumerate(((np.maximum(u[:, j], 0), np.maximum(vt[j], 0)), (np.maximum(-u[:, j], 0), np.maximum(-vt[j], 0))))), key=lambda x: (x[0], -x[1]))
        size, _, a, b = best
        if size > 0:
            f = np.sqrt(s[j] * size)
            w[:, j], h[j] = f * a / np.linalg.norm(a), f * b / np.linalg.norm(b)
    w[w < 1e-11], h[h < 1e-11] = 0, 0
    return w, h


def random_start(shape: tuple[int, int], k: int, low: float = 0.0, high: float = 1.0, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Uniform start values."""
    r = np.random.default_rng(seed)
    return r.uniform(low, high, (shape[0], k)), r.uniform(low, high, (k, shape[1]))


def update_h(wtw: np.ndarray, wtv: np.ndarray, h: np.ndarray) -> np.ndarray:
    """H * W'V / (W'W H)."""
    return h * wtv / (wtw @ h + EPS)


def update_w(w: np.ndarray, vht: np.ndarray, hht: np.ndarray) -> np.ndarray:
    """W * VH' / (W HH')."""
    return w * vht / (w @ hht + EPS)


def nmf(v: Sparse, k: int, threshold: float = 0.005, zero: float = 1e-5, most: int = 10_000, start: tuple | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Lee-Seung with H first; stops when both changes have a spectral norm below threshold. (W, H, rounds)."""
    w, h = start or nndsvd(v, k)
    n = 0
    for n in range(1, most + 1):
        new_h = update_h(w.T @ w, v.tmul(w).T, h)
        new_w = update_w(w, v.mul(new_h.T), new_h @ new_h.T)
        done = spectral_norm(new_w - w) < threshold and spectral_norm(new_h - h) < threshold
        w, h = new_w, new_h
        if done:
            break
    w[w < zero], h[h < zero] = 0, 0
    return w, h, n


def projective_nmf(v: Sparse, k: int, threshold: float = 0.005, zero: float = 1e-5, most: int = 1000, start: np.ndarray | None = None, orthogonal: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """V ~ W W'V; V V' is never formed. The converged step isn't taken; then columns have length 1 and H = W'V.

    orthogonal: the variant W * VV'W / (W W'VV'W), divided by its spectral norm, stopped by the Frobenius norm.
    """
    w = nndsvd(v, k)[0] if start is None else start
    n = 0
    for n in range(1, most + 1):
        vw = v.tmul(w)
        vvw = v.mul(vw)
        if orthogonal:
            new = w * vvw / (w @ (w.T @ vvw) + EPS)
            new = new / (spectral_norm(new) + EPS)
            change = float(np.linalg.norm(new - w))
        else:
            new = w * np.sqrt(vvw / (w @ (vw.T @ vw) + vvw @ (w.T @ w) + EPS))
            change = spectral_norm(new - w)
        if change < threshold:
            break
        w = new
    w = w / np.maximum(np.linalg.norm(w, axis=0), EPS)
    w[w < zero] = 0
    return w, v.tmul(w).T, n


def nmtf(v: Sparse, k: int, threshold: float = 0.005, zero: float = 1e-5, most: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """V ~ W S H: tri-factorization; start from two NNDSVDs, Frobenius stop. (W, S, H, rounds)."""
    w, h = nndsvd(v, k)
    sw = np.abs(w.T @ w)
    sh = np.abs(h @ h.T)
    s = np.sqrt(sw * sh) + EPS
    n = 0
    for n in range(1, most + 1):
        vht = v.mul(h.T)
        new_w = w * (vht @ s.T) / (w @ (s @ (h @ h.T) @ s.T) + EPS)
        wtv = v.tmul(new_w).T
        new_s = s * (wtv @ h.T) / (new_w.T @ new_w @ s @ (h @ h.T) + EPS)
        new_h = h * (new_s.T @ wtv) / (new_s.T @ (new_w.T @ new_w) @ new_s @ h + EPS)
        done = max(np.linalg.norm(new_w - w), np.linalg.norm(new_s - s), np.linalg.norm(new_h - h)) < threshold
        w, s, h = new_w, new_s, new_h
        if done:
            break
    w[w < zero], h[h < zero] = 0, 0
    return w, s, h, n


def symmetric_nmf(a: np.ndarray, k: int, rounds: int = 100, seed: int = 42) -> np.ndarray:
    """A ~ H H' by coordinate descent: each entry takes the best non-negative root of its quartic."""
    n = len(a)
    h = np.random.default_rng(seed).uniform(0, 1, (n, k)) * np.sqrt(max(a.mean(), EPS) / k) * 2
    for _ in range(rounds):
        before = h.copy()
        for i in range(n):
            for j in range(k):
                # f(x) = x^4/4 + p x^2/2 + q x for entry (i, j), up to a constant
                col, x0 = h[:, j], h[i, j]
                r = a[i] - h[i] @ h.T + x0 * col
                p = col @ col - x0 * x0 - (r[i] - 0.0)
                q = -(r @ col - r[i] * x0)
                roots = np.roots([1.0, 0.0, p, q])
                real = roots[np.abs(roots.imag) < 1e-9].real
                cand = np.append(real[real > 0], 0.0)
                h[i, j] = cand[np.argmin(cand**4 / 4 + p * cand**2 / 2 + q * cand)]
        if np.abs(h - before).max() < 1e-6:
            break
    return h


class OnlineNMF:
    """H kept over batches of rows: each batch's W is solved against H, then H is updated with an orthogonality penalty."""

    def __init__(self, k: int, alpha: float = 0.1, rounds: int = 50):
        self.k, self.alpha, self.rounds = k, alpha, rounds
        self.wtw: np.ndarray | None = None
        self.wtv: np.ndarray | None = None
        self.h: np.ndarray | None = None

    def update(self, v: Sparse) -> np.ndarray:
        """W of a new batch; H and the statistics take it in."""
        if self.h is None:
            _, self.h = nndsvd(v, self.k)
            self.h += 1e-3
            self.wtw, self.wtv = np.zeros((self.k, self.k)), np.zeros_like(self.h)
        w = self.transform(v)
        self.wtw, self.wtv = self.wtw + w.T @ w, self.wtv + v.tmul(w).T
        off = self.alpha * (np.ones((self.k, self.k)) - np.eye(self.k))
        for _ in range(self.rounds):
            self.h = self.h * self.wtv / (self.wtw @ self.h + off @ self.h + EPS)
        return w

    def transform(self, v: Sparse) -> np.ndarray:
        """W of rows against the present H."""
        w = np.full((v.shape[0], self.k), 0.1)
        vht, hht = v.mul(self.h.T), self.h @ self.h.T
        for _ in range(self.rounds):
            w = update_w(w, vht, hht)
        return w


def hierarchical_nmf(v: Sparse, leaves: int, rounds: int = 200) -> list[np.ndarray]:
    """Columns split into `leaves` groups: always the leaf whose rank-2 factors gain the most, sigma(L)^2 + sigma(R)^2 - sigma^2."""

    def part(cols: np.ndarray) -> Sparse:
        at = np.full(v.shape[1], -1)
        at[cols] = np.arange(len(cols))
        use = at[v.col] >= 0
        return Sparse(v.row[use], at[v.col[use]], v.val[use], (v.shape[0], len(cols)))

    def top(cols: np.ndarray) -> float:
        return float(svd(part(cols), 1)[1][0] ** 2) if len(cols) else 0.0

    def split(cols: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if len(cols) < 2:
            return -np.inf, cols, cols[:0]
        _, h, _ = nmf(part(cols), 2, most=rounds)
        left = h[0] >= h[1]
        a, b = cols[left], cols[~left]
        return (top(a) + top(b) - top(cols) if len(a) and len(b) else -np.inf), a, b

    groups = [(np.arange(v.shape[1]), split(np.arange(v.shape[1])))]
    while len(groups) < leaves:
        i = max(range(len(groups)), key=lambda i: groups[i][1][0])
        if groups[i][1][0] == -np.inf:
            break
        _, (_, a, b) = groups.pop(i)
        groups += [(a, split(a)), (b, split(b))]
    return [g for g, _ in groups]


def classical_mds(d: np.ndarray, dims: int = 2) -> np.ndarray:
    """Coordinates whose distances are like d (k x k)."""
    n = len(d)
    j = np.eye(n) - 1.0 / n
    value, vector = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    order = np.argsort(-value)[:dims]
    return vector[:, order] * np.sqrt(np.maximum(value[order], 0))
