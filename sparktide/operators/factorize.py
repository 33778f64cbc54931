"""Factorization of a document-term table, on one node where it is small and in blocks where it isn't.

Both take the same start (NNDSVD), the same steps and the same stop rule, so that the size of a table doesn't decide its topics.
In blocks: documents are hashed into blocks, whose non-zeros are sorted once and kept as arrays in the shared folder.
Start and rounds are one barrier stage: its tasks keep their blocks and these blocks' W, give their parts of V'W
to the owners of ranges of terms through files of the shared folder, and sum k x k matrices over sockets.
If the stage is run again, it begins anew under other names. Where no barrier stage can run (dynamic allocation), a step of the start and a round
are one job each instead. The driver holds H (k x terms) and k x k matrices only.
"""

from __future__ import annotations

import hmac
import io
import socket
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .shared import checkpointed, ordered_ids, scratch_root

#: Non-zeros up to which the table is gathered and solved on the driver.
LOCAL_NNZ = 5_000_000
BLOCK_DOCS = 8000
#: Most rounds of each method.
MOST = {"nmf": 10_000, "pnmf": 1000, "opnmf": 5000, "nmtf": 1000}
COLUMN_RANGE = 65_536
#: Documents for which a task of the rounds is worth its start.
TASK_DOCS = 1000


class Factors:
    """W (doc_id, topic_id, weight), H (topic_id, term, weight), S (i, j, value) or None, and the number of rounds. Topics count from 1."""

    def __init__(self, w: DataFrame, h: DataFrame, s: DataFrame | None, rounds: int):
        self.w, self.h, self.s, self.rounds = w, h, s, rounds


def _long(spark, ids: list, m: np.ndarray, key: str, topic_first: bool) -> DataFrame:
    """Rows of a dense factor; m is ids x topics."""
    k = m.shape[1]
    t = pa.table({key: pa.array(np.repeat(np.asarray(ids, dtype=object), k).tolist()) if key == "term" else pa.array(np.repeat(np.asarray(ids), k)), "topic_id": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))), "weight": pa.array(m.ravel())})
    d = spark.createDataFrame(t)
    return d.select("topic_id", key, "weight") if topic_first else d


def factorize(v: DataFrame, k: int, method: str = "nmf", threshold: float = 0.005, most: int | None = None, local_nnz: int = LOCAL_NNZ) -> Factors:
    """Factors of v (doc_id, term, w) by nmf, pnmf, opnmf or nmtf.

    Ids order documents and terms, so the result doesn't depend on the order of rows. k = -1 takes floor(nnz / (docs + terms)).
    Above local_nnz non-zeros the same steps run in blocks.
    """
    spark = v.sparkSession
    if method not in ("nmf", "pnmf", "opnmf", "nmtf"):
        raise ValueError(f"unknown method {method!r}")
    nnz = v.count()
    if nnz == 0:
        raise ValueError("nothing to factorize")
    if nnz > local_nnz:
        return factorize_blocks(v, k, method, threshold, most)
    m, docs, terms = local_matrix(v)
    if k == -1:
        k = max(1, nnz // (len(docs) + len(terms)))
    s = None
    if method == "nmf":
        w, h, n = kernels.nmf(m, k, threshold, most=most or MOST[method])
    elif method == "nmtf":
        w, s, h, n = kernels.nmtf(m, k, threshold, most=most or MOST[method])
    else:
        w, h, n = kernels.projective_nmf(m, k, threshold, most=most or MOST[method], orthogonal=method == "opnmf")
    return Factors(_long(spark, docs, w, "doc_id", False), _long(spark, terms, h.T, "term", True), _links(spark, s), n)


def _links(spark, s: np.ndarray | None) -> DataFrame | None:
    if s is None:
        return None
    i, j = np.indices(s.shape)
    return spark.createDataFrame(pa.table({"i": pa.array(i.ravel() + 1, pa.int32()), "j": pa.array(j.ravel() + 1, pa.int32()), "value": pa.array(s.ravel())}))


def _fs(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root:
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root.removeprefix("file:")


def _save(root: str, name: str, a: np.ndarray) -> None:
    fs, path = _fs(root)
    fs.create_dir(path, recursive=True)
    tmp = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as out:
        np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(a := np.ascontiguousarray(a)))
        out.write(a)
    fs.move(tmp, f"{path}/{name}.npy")


def _load(root: str, name: str) -> np.ndarray:
    fs, path = _fs(root)
    with fs.open_input_file(f"{path}/{name}.npy") as f:
        return np.load(io.BytesIO(f.read()))


def _map(root: str, name: str) -> np.ndarray:
    """As _load; where the folder is local, pages are read as they are used and don't belong to the process."""
    fs, path = _fs(root)
    return np.load(f"{path}/{name}.npy", mmap_mode="r") if isinstance(fs, pafs.LocalFileSystem) else _load(root, name)


def _drop(root: str, name: str) -> None:
    fs, path = _fs(root)
    fs.delete_file(f"{path}/{name}.npy")


class _Shared:
    """An array over all terms in the shared folder; a task takes the rows of its block's terms. Where the folder is local, workers share its pages."""

    def __init__(self, root: str, a: np.ndarray):
        self.root, self.name = root, f"shared-{uuid.uuid4().hex}"
        _save(root, self.name, np.ascontiguousarray(a))

    def take(self, terms: np.ndarray) -> np.ndarray:
        return _map(self.root, self.name)[terms]

    def drop(self) -> None:
        _drop(self.root, self.name)


def _block(root: str, b: int, docs: int) -> tuple[np.ndarray, kernels.Sparse]:
    """The terms of a block and its matrix."""
    terms = _load(root, f"terms-{b}")
    return terms, kernels.Sparse.of({f"{name}{t}": _map(root, f"{name}{t}-{b}") for name in ("first", "rows", "at", "val") for t in (0, 1)}, (docs, len(terms)))


def _tasks(spark, most: int) -> int:
    """Tasks of a barrier stage: no more than can run at once."""
    sc = spark.sparkContext._jsc.sc()
    return max(1, min(most, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())))


class _ByTerm:
    """An array with a row for each of a block's terms."""

    def __init__(self, a: np.ndarray):
        self.a = a


class _Blocks:
    """v in blocks of documents; run() sums what a function gives for each block."""

    def __init__(self, v: DataFrame, block_docs: int):
        self.spark = v.sparkSession
        self.vocab = checkpointed(ordered_ids(v, "term", "term_id"))
        self.n_terms, self.n_docs = self.vocab.count(), v.select("doc_id").distinct().count()
        self.tasks = tasks = _tasks(self.spark, max(1, -(-self.n_docs // block_docs), self.n_docs // TASK_DOCS))
        blocks = -(-max(tasks, -(-self.n_docs // block_docs)) // tasks) * tasks
        by = v.join(self.vocab, "term").select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", "term_id", "w")
        self.root = root = f"{scratch_root(self.spark)}/factors-{uuid.uuid4().hex}"

        def pack(t: pa.Table) -> pa.Table:
            docs, row = np.unique(np.asarray(t.column("doc_id")), return_inverse=True)
            terms, col = np.unique(np.asarray(t.column("term_id")), return_inverse=True)
            b = t.column("block")[0].as_py()
            _save(root, f"terms-{b}", terms)
            for name, x in kernels.Sparse(row, col, np.asarray(t.column("w")), (len(docs), len(terms))).arrays().items():
                _save(root, f"{name}-{b}", x)
            return pa.table({"block": t.column("block").slice(0, 1), "docs": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array(docs, pa.int64()))})

        self.packed = checkpointed(by.groupBy("block").applyInArrow(pack, "block bigint, docs array<bigint>"))
        self.sizes = {r.block: r.n for r in self.packed.select("block", F.size("docs").alias("n")).collect()}

    def _parts(self, fn, shared):
        """Of each block, what fn gives. Arrays of shared that have a row for each term come to fn with the rows of the block's own terms,
        and fn's arrays over these terms go back with their ids, so that a task holds nothing as long as the vocabulary."""
        n_terms, root, sizes = self.n_terms, self.root, sorted(self.sizes.items())
        given = shared if isinstance(shared, tuple) else (shared,)
        given = tuple(_Shared(root, x) if isinstance(x, np.ndarray) and x.shape[:1] == (n_terms,) and x.ndim == 2 else x for x in given)
        single = not isinstance(shared, tuple)

        def run(batches):
            for batch in batches:
                for i in batch.column("id").to_pylist():
                    b = sizes[i][0]
                    terms, m = _block(root, *sizes[i])
                    own = tuple(x.take(terms) if isinstance(x, _Shared) else x for x in given)
                    out = []
                    for part, x in enumerate(fn(b, m, lambda name, b=b: _load(root, f"{name}-{b}"), lambda name, x, b=b: _save(root, f"{name}-{b}", x), own[0] if single else own)):
                        if not isinstance(x, _ByTerm):
                            out.append((part, -1, np.zeros(0, np.int32), x))
                            continue
                        cuts = np.searchsorted(terms, np.arange(0, n_terms + COLUMN_RANGE, COLUMN_RANGE))
                        out += [(part, c, (terms[lo:hi] - c * COLUMN_RANGE).astype(np.int32), x.a[lo:hi]) for c, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if lo < hi]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _, _ in out], pa.int32()), pa.array([c for _, c, _, _ in out], pa.int32()), pa.array([i.tobytes() for _, _, i, _ in out], pa.binary()), pa.array([np.ascontiguousarray(x, dtype=np.float64).tobytes() for _, _, _, x in out], pa.binary())], names=["part", "at", "ids", "data"])

        return self.spark.range(0, len(sizes), 1, len(sizes)).mapInArrow(run, "part int, at int, ids binary, data binary"), [x for x in given if isinstance(x, _Shared)]

    def run(self, fn, shared=None) -> list[np.ndarray]:
        """Sums over blocks of the arrays that fn(block, matrix, load, save, shared) gives; a _ByTerm becomes an array over all terms."""
        n_terms = self.n_terms

        def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, s = key[1].as_py(), None
            for t in batches:
                for ids, data in zip(t.column("ids"), t.column("data"), strict=True):
                    x = np.frombuffer(data.as_buffer(), dtype=np.float64)
                    if at < 0:
                        s = x.copy() if s is None else s + x
                        continue
                    i = np.frombuffer(ids.as_buffer(), dtype=np.int32)
                    x = x.reshape(len(i), -1)
                    if s is None:
                        s = np.zeros((min(COLUMN_RANGE, n_terms - at * COLUMN_RANGE), x.shape[1]))
                    s[i] += x  # a block's terms are distinct
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([at], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["part", "at", "data"])

        parts, files = self._parts(fn, shared)
        rows = parts.groupBy("part", "at").applyInArrow(total, "part int, at int, data binary").collect()
        for x in files:
            x.drop()
        got: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r.part, r["at"])):
            got.setdefault(r.part, []).append(np.frombuffer(r.data, dtype=np.float64))
        return [np.concatenate(got[p]) for p in sorted(got)]

    def each(self, fn, shared=None) -> list[np.ndarray]:
        """The one small array that fn gives for each block."""
        parts, files = self._parts(fn, shared)
        got = [np.frombuffer(r.data, dtype=np.float64) for r in parts.collect()]
        for x in files:
            x.drop()
        return got

    def nndsvd(self, k: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
        """Start values as in kernels.nndsvd: W is saved as w0, H is given."""
        n, p = self.n_terms, min(k + 8, self.n_docs, self.n_terms)
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, p)))[0]

        def gram(b, m, load, save, q):
            z = m.mul(q)
            return _ByTerm(m.tmul(z)), (z.T @ z).ravel()

        for _ in range(rounds):
            vz, g = self.run(gram, q)
            size, e = np.linalg.eigh(g.reshape(p, p))
            ok = size > size[-1] * 1e-14
            q = np.linalg.qr(vz.reshape(n, p) @ (e * np.where(ok, 1 / np.sqrt(np.where(ok, size, 1)), 0)))[0]
        size, e = np.linalg.eigh(self.run(gram, q)[1].reshape(p, p))
        order = np.argsort(-size)[: min(k, p)]
        s, e = np.sqrt(np.maximum(size[order], 0)), e[:, order]
        vt = (q @ e).T
        to_u = q @ (e / np.where(s > 0, s, 1))

        def peaks(b, m, load, save, x):
            u = m.mul(x)
            return (u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])],)

        top = np.array(self.each(peaks, to_u))
        sign = np.sign(top[np.abs(top).argmax(axis=0), np.arange(len(s))])
        to_u, vt = to_u * sign, vt * sign[:, None]

        def halves(b, m, load, save, x):
            u = m.mul(x)
            return (np.maximum(u, 0) ** 2).sum(axis=0), (np.maximum(-u, 0) ** 2).sum(axis=0)

        up, un = map(np.sqrt, self.run(halves, to_u))
        h, side, scale = np.zeros((k, n)), np.zeros(len(s)), np.zeros(len(s))
        h[0], scale[0] = np.sqrt(s[0]) * np.abs(vt[0]), np.sqrt(s[0])
        for j in range(1, len(s)):
            a, b = np.maximum(vt[j], 0), np.maximum(-vt[j], 0)
            pos, neg = up[j] * np.linalg.norm(a), un[j] * np.linalg.norm(b)
            size, half, x, norm = (pos, 1.0, a, up[j]) if pos >= neg else (neg, -1.0, b, un[j])
            if size > 0:
                f = np.sqrt(s[j] * size)
                side[j], scale[j], h[j] = half, f / norm, f * x / np.linalg.norm(x)
        h[h < 1e-11] = 0

        def start(b, m, load, save, shared):
            x, side, scale = shared
            u = m.mul(x)
            w = np.zeros((m.shape[0], k))
            w[:, 0] = np.abs(u[:, 0]) * scale[0]
            w[:, 1 : len(side)] = np.maximum(u[:, 1:] * side[1:], 0) * scale[1:]
            w[w < 1e-11] = 0
            save("w0", w)
            return (np.zeros(1),)

        self.run(start, (to_u, side, scale))
        return h

    def forget(self, name: str) -> None:
        fs, path = _fs(self.root)
        for f in fs.get_file_info(pafs.FileSelector(path)):
            if f.base_name.startswith(f"{name}-"):
                fs.delete_file(f.path)


def _products(w: np.ndarray, old: np.ndarray, m: kernels.Sparse) -> tuple:
    """V'W, W'W, and the Gram matrix of the change."""
    d = w - old
    return _ByTerm(m.tmul(w)), (w.T @ w).ravel(), (d.T @ d).ravel()


def _root(gram: np.ndarray) -> float:
    return float(np.sqrt(max(0.0, np.linalg.eigvalsh(gram)[-1])))


def factorize_blocks(v: DataFrame, k: int, method: str = "nmf", threshold: float = 0.005, most: int | None = None, block_docs: int = BLOCK_DOCS) -> Factors:
    """Factors of v in blocks of documents by the steps of kernels."""
    spark, most = v.sparkSession, most or MOST[method]
    x = _Blocks(v, block_docs)
    if k == -1:
        k = max(1, v.count() // (x.n_docs + x.n_terms))
    n, h, s = (_one_stage if _barriers(spark) else _a_job_each)(x, k, method, threshold, most)
    root = x.root

    def rows_of_w(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs, w = np.asarray(batch.column("docs")[i].values), _load(root, f"w-{batch.column('block')[i].as_py()}")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(docs, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(docs))), pa.array(w.ravel())], names=["doc_id", "topic_id", "weight"])

    w = x.packed.mapInArrow(rows_of_w, "doc_id bigint, topic_id int, weight double")
    terms = x.vocab.orderBy("term_id").toPandas()["term"].tolist()
    return Factors(w, _long(spark, terms, h.T, "term", True), _links(spark, s), n)


def _barriers(spark) -> bool:
    return spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false").lower() != "true"


def _receive(c: socket.socket, n: int) -> bytes:
    out = bytearray()
    while len(out) < n:
        if not (x := c.recv(min(n - len(out), 1 << 20))):
            raise ConnectionError("a task of the stage has ended")
        out += x
    return bytes(out)


def _received(c: socket.socket) -> bytes:
    return _receive(c, struct.unpack("<q", _receive(c, 8))[0])


class _Group:
    """A task of the stage of all rounds: its blocks, the range of terms that it owns, and what it exchanges with the others."""

    def __init__(self, root: str, sizes: dict[int, int], n_terms: int, k: int):
        ctx = BarrierTaskContext.get()
        self.me, tasks = ctx.partitionId(), ctx.getTaskInfos()
        self.root, self.n, self.k, self.steps = root, len(tasks), k, 0
        self.last_part = self.last_range = ""
        host = tasks[self.me].address.rsplit(":", 1)[0].strip("[]")
        server = socket.create_server((host, 0), backlog=self.n, family=socket.AF_INET6 if ":" in host else socket.AF_INET) if self.me == 0 else None
        # Spark's own all-gather takes about a second; it only tells the others where the first task listens
        self.run, host, port, secret = ctx.allGather(f"{uuid.uuid4().hex} {host} {server.getsockname()[1] if server else 0} {uuid.uuid4().hex}")[0].split()
        self.peers: list[socket.socket] = []
        if server is None:
            self.peers = [socket.create_connection((host, int(port)), timeout=60)]
            self.peers[0].sendall(secret.encode() + struct.pack("<i", self.me))
        else:
            server.settimeout(60)
            by = {}
            while len(by) < self.n - 1:
                c = server.accept()[0]
                c.settimeout(60)
                hello = _receive(c, len(secret) + 4)
                if hmac.compare_digest(hello[:-4], secret.encode()):
                    by[struct.unpack("<i", hello[-4:])[0]] = c
            self.peers = [by[t] for t in sorted(by)]
            server.close()
        for c in self.peers:
            c.settimeout(None)
            c.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            c.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
        self.blocks = [b for b in sorted(sizes) if b % self.n == self.me]
        got = [_block(root, b, sizes[b]) for b in self.blocks]
        self.terms = np.unique(np.concatenate([t for t, _ in got])) if got else np.zeros(0, np.int64)
        self.v = [(m, None if len(t) == len(self.terms) else np.searchsorted(self.terms, t)) for t, m in got]
        self.ranges = np.linspace(0, n_terms, self.n + 1).astype(np.int64)
        self.cuts = np.searchsorted(self.terms, self.ranges)
        self.low, self.high = int(self.ranges[self.me]), int(self.ranges[self.me + 1])
        _save(root, f"own-{self.run}-{self.me}", self.terms)
        places = np.frombuffer(self._meet(self.cuts.astype(np.int64).tobytes(), b"".join), np.int64).reshape(self.n, -1)
        self.theirs = [(int(c[self.me]), int(c[self.me + 1])) for c in places]
        self.at = [_map(root, f"own-{self.run}-{t}")[lo:hi] - self.low for t, (lo, hi) in enumerate(self.theirs)]

    def total(self, *arrays: np.ndarray, done: bool = False) -> tuple[list[np.ndarray], bool]:
        """Sums over all tasks, and whether the first of them is done, so that all end in the same round. All wait here for each other."""
        mine = np.concatenate([[float(done)], *map(np.ravel, arrays)])

        def add(got: list[bytes]) -> bytes:
            s = np.sum([np.frombuffer(x) for x in got], axis=0)
            s[0] = done
            return s.tobytes()

        s = np.frombuffer(self._meet(mine.tobytes(), add))
        return [x.reshape(a.shape) for x, a in zip(np.split(s[1:], np.cumsum([x.size for x in arrays])), arrays, strict=False)], bool(s[0])

    def first(self, make: Callable[[], np.ndarray]) -> np.ndarray:
        """An array that the first task makes, so that eigenvectors have the same signs everywhere."""
        return np.frombuffer(self._meet(b"", lambda _: np.ascontiguousarray(make(), dtype=np.float64).tobytes()))

    def _meet(self, mine: bytes, join: Callable[[list[bytes]], bytes]) -> bytes:
        """What the first task makes of all tasks' bytes, in their order."""
        if self.me:
            self.peers[0].sendall(struct.pack("<q", len(mine)) + mine)
            return _received(self.peers[0])
        out = join([mine, *map(_received, self.peers)])
        for c in self.peers:
            c.sendall(struct.pack("<q", len(out)) + out)
        return out

    def mul(self, b: np.ndarray) -> list[np.ndarray]:
        """V b by blocks, b being over the task's own terms."""
        return [m.mul(b if at is None else b[at]) for m, at in self.v]

    def tmul(self, w: list[np.ndarray], width: int | None = None) -> np.ndarray:
        """The task's part of V'w, over its own terms; w has k columns, or width."""
        out = np.zeros((len(self.terms), width or self.k))
        for (m, at), x in zip(self.v, w, strict=True):
            out[slice(None) if at is None else at] += m.tmul(x)
        return out

    def _give(self, kind: str, a: np.ndarray) -> None:
        """Written under the number of the step; what was written two steps of this kind before has been read by all."""
        self.steps += 1
        _save(self.root, f"{kind}-{self.run}-{self.steps}-{self.me}", a)

    def sum_by_term(self, part: np.ndarray, *small: np.ndarray, done: bool = False) -> tuple[np.ndarray, list[np.ndarray], bool]:
        """The sums of all tasks' parts over the range of terms that this one owns; and what total() gives."""
        self._give("part", part)
        got = self.total(*small, done=done)
        s = np.zeros((self.high - self.low, part.shape[1]))
        for t, ((lo, hi), at) in enumerate(zip(self.theirs, self.at, strict=True)):
            if lo < hi:
                s[at] += _map(self.root, f"part-{self.run}-{self.steps}-{t}")[lo:hi]
        self.last_part = f"part-{self.run}-{self.steps}-{self.me}"
        return s, *got

    def share(self, a: np.ndarray, *small: np.ndarray, done: bool = False) -> tuple[np.ndarray, list[np.ndarray], bool]:
        """The rows of the task's own terms of an array of which each task has the range that it owns; and what total() gives."""
        self._give("range", a)
        got = self.total(*small, done=done)
        if self.last_part:  # all have read it: they wrote their ranges since
            _drop(self.root, self.last_part)
            self.last_part = ""
        out = np.empty((len(self.terms), a.shape[1]))
        for t, (lo, hi) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            if lo < hi:
                np.take(_map(self.root, f"range-{self.run}-{self.steps}-{t}"), self.terms[lo:hi] - self.ranges[t], axis=0, out=out[lo:hi])
        if self.last_range:
            _drop(self.root, self.last_range)
        self.last_range = f"range-{self.run}-{self.steps}-{self.me}"
        return out, *got


def _gram(w: list[np.ndarray], k: int) -> np.ndarray:
    return sum((x.T @ x for x in w), np.zeros((k, k)))


def _whitening(gram: np.ndarray) -> np.ndarray:
    """What makes columns with this Gram matrix orthonormal; directions that aren't there become zero."""
    size, e = np.linalg.eigh(gram)
    ok = size > size[-1] * 1e-14
    return e * np.where(ok, 1 / np.sqrt(np.where(ok, size, 1)), 0)


def _start(g: _Group, q: np.ndarray, rounds: int = 12) -> tuple[list[np.ndarray], np.ndarray]:
    """Start values as in _Blocks.nndsvd: W by blocks, and H of the task's range of terms, terms first. q: this range of the random start."""
    p, k = q.shape[1], g.k

    def orthonormal(y):
        for _ in range(2):
            (gram,), _ = g.total(y.T @ y)
            y = y @ g.first(lambda gram=gram: _whitening(gram)).reshape(p, p)
        return y

    q = orthonormal(q)
    for _ in range(rounds):
        z = g.mul(g.share(q)[0])
        vz, (zz,), _ = g.sum_by_term(g.tmul(z, p), _gram(z, p))
        q = orthonormal(vz @ g.first(lambda zz=zz: _whitening(zz)).reshape(p, p))
    z = g.mul(g.share(q)[0])
    (zz,), _ = g.total(_gram(z, p))
    size, e = np.split(g.first(lambda: np.concatenate([(x := np.linalg.eigh(zz))[0], x[1].ravel()])), [p])
    order = np.argsort(-size)[: min(k, p)]
    s, e = np.sqrt(np.maximum(size[order], 0)), e.reshape(p, p)[:, order]
    u, v = [x @ (e / np.where(s > 0, s, 1)) for x in z], q @ e
    peaks = np.zeros((g.n, len(s)))
    for x in u:
        top = x[np.abs(x).argmax(axis=0), np.arange(len(s))]
        peaks[g.me] = np.where(np.abs(top) > np.abs(peaks[g.me]), top, peaks[g.me])
    (peaks,), _ = g.total(peaks)
    sign = np.sign(peaks[np.abs(peaks).argmax(axis=0), np.arange(len(s))])
    u, v = [x * sign for x in u], v * sign
    squares = lambda xs: sum(((np.maximum(x, 0) ** 2).sum(axis=0) for x in xs), np.zeros(len(s)))
    (up, un, vp, vn), _ = g.total(squares(u), squares(-x for x in u), squares([v]), squares([-v]))
    up, un, vp, vn = map(np.sqrt, (up, un, vp, vn))
    w, h = [np.zeros((len(x), k)) for x in u], np.zeros((len(v), k))
    for j in range(len(s)):
        if j == 0:
            halves, fu, fv = (np.abs(v[:, 0]), [np.abs(x[:, 0]) for x in u]), np.sqrt(s[0]), np.sqrt(s[0])
        else:
            side, a, b = (1.0, up[j], vp[j]) if up[j] * vp[j] >= un[j] * vn[j] else (-1.0, un[j], vn[j])
            if a * b == 0:
                continue
            f = np.sqrt(s[j] * a * b)
            halves, fu, fv = (np.maximum(v[:, j] * side, 0), [np.maximum(x[:, j] * side, 0) for x in u]), f / a, f / b
        h[:, j] = fv * halves[0]
        for x, to in zip(halves[1], w, strict=True):
            to[:, j] = fu * x
    for x in (*w, h):
        x[x < 1e-11] = 0
    return w, h


def _one_stage(x: _Blocks, k: int, method: str, threshold: float, most: int, seed: int = 42) -> tuple[int, np.ndarray, np.ndarray | None]:
    """Start, rounds and end in one barrier stage; W is saved by blocks. (rounds, H, S)."""
    root, sizes, n_terms, eps, zero = x.root, x.sizes, x.n_terms, kernels.EPS, 1e-5
    start = _Shared(root, np.random.default_rng(seed).standard_normal((n_terms, min(k + 8, x.n_docs, n_terms))))

    def solve(g: _Group) -> tuple[int, np.ndarray | None]:
        s, n, done = None, 0, False
        w, h = _start(g, start.take(slice(g.low, g.high)))  # h: of the range of terms that the task owns, terms first
        vw, (ww,), _ = g.sum_by_term(g.tmul(w), _gram(w, k))
        if method == "nmf":
            while True:
                new = h * vw / (h @ ww + eps)
                own, (hh, dh), done = g.share(new, new.T @ new, (new - h).T @ (new - h), done=done or n == most)
                if done:
                    break
                n, h = n + 1, new
                to = [kernels.update_w(old, vht, hh) for old, vht in zip(w, g.mul(own), strict=True)]
                dw = _gram([a - b for a, b in zip(to, w, strict=True)], k)
                w = to
                vw, (ww, dw), _ = g.sum_by_term(g.tmul(w), _gram(w, k), dw)
                done = max(_root(dw), _root(dh)) < threshold
        elif method == "nmtf":
            own, (hh,), _ = g.share(h, h.T @ h)
            s = np.sqrt(np.abs(ww) * np.abs(hh)) + eps
            while True:
                _, done = g.total(done=done or n == most)
                if done:
                    break
                n += 1
                inner = s @ hh @ s.T
                to = [old * (vht @ s.T) / (old @ inner + eps) for old, vht in zip(w, g.mul(own), strict=True)]
                dw = _gram([a - b for a, b in zip(to, w, strict=True)], k)
                w = to
                vw, (ww, dw), _ = g.sum_by_term(g.tmul(w), _gram(w, k), dw)
                (vwh,), _ = g.total(vw.T @ h)
                new_s = s * vwh / (ww @ s @ hh + eps)
                new = h * (vw @ new_s) / (h @ (new_s.T @ ww @ new_s).T + eps)
                own, (hh, dh), _ = g.share(new, new.T @ new, np.sum((new - h) ** 2, keepdims=True))
                done = max(np.sqrt(np.trace(dw)), np.linalg.norm(new_s - s), np.sqrt(dh[0, 0])) < threshold
                s, h = new_s, new
        else:
            own, (inner,), _ = g.share(vw, vw.T @ vw)
            for n in range(1, most + 1):  # noqa: B007
                vvw = g.mul(own)
                if method == "opnmf":
                    to = [old * a / (old @ inner + eps) for old, a in zip(w, vvw, strict=True)]
                else:
                    to = [old * np.sqrt(a / (old @ inner + a @ ww + eps)) for old, a in zip(w, vvw, strict=True)]
                if method == "opnmf":
                    (new_ww,), _ = g.total(_gram(to, k))
                    c = 1 / (_root(new_ww) + eps)
                    to = [a * c for a in to]
                dw = _gram([a - b for a, b in zip(to, w, strict=True)], k)
                new_vw, (new_ww, dw), _ = g.sum_by_term(g.tmul(to), _gram(to, k), dw)
                done = (np.sqrt(np.trace(dw)) if method == "opnmf" else _root(dw)) < threshold
                own, (inner,), done = g.share(new_vw, new_vw.T @ new_vw, done=done)
                if done:  # the converged step isn't taken
                    break
                w, ww = to, new_ww
            length = np.maximum(np.sqrt(np.diag(ww)), eps)
            w = [a / length for a in w]
        for a in w:
            a[a < zero] = 0
        if method in ("nmf", "nmtf"):
            h[h < zero] = 0
        else:
            h, _, _ = g.sum_by_term(g.tmul(w))
        for b, a in zip(g.blocks, w, strict=True):
            _save(root, f"w-{b}", a)
        _save(root, f"h-{g.me}", h)
        return n, s

    def run(batches):
        for _ in batches:
            pass
        g = _Group(root, sizes, n_terms, k)
        n, s = solve(g)
        yield pa.RecordBatch.from_arrays([pa.array([g.me], pa.int32()), pa.array([n], pa.int32()), pa.array([b"" if s is None else np.ascontiguousarray(s).tobytes()], pa.binary())], names=["task", "rounds", "s"])

    got = sorted(x.spark.range(0, x.tasks, 1, x.tasks).mapInArrow(run, "task int, rounds int, s binary", barrier=True).collect())
    start.drop()
    return got[0].rounds, np.concatenate([_load(root, f"h-{t}") for t in range(x.tasks)]).T, np.frombuffer(got[0].s).reshape(k, k) if got[0].s else None


def _a_job_each(x: _Blocks, k: int, method: str, threshold: float, most: int) -> tuple[int, np.ndarray, np.ndarray | None]:
    """As _one_stage, with a job for each round."""
    n_terms, eps, zero, scale, s = x.n_terms, kernels.EPS, 1e-5, np.ones(k), None
    h = x.nndsvd(k)

    def first(b, m, load, save, shared):
        return _products(load("w0"), load("w0"), m)

    vw, ww, _ = x.run(first)
    vw, ww = vw.reshape(n_terms, k), ww.reshape(k, k)
    if method == "nmtf":
        s = np.sqrt(np.abs(ww) * np.abs(h @ h.T)) + eps
    n, last = 0, 0
    for n in range(1, most + 1):
        if method in ("nmf", "nmtf"):
            new_h = kernels.update_h(ww, vw.T, h) if method == "nmf" else h

            def step(b, m, load, save, shared, n=n):
                ht, hh, s = shared
                old = load(f"w{n - 1}")
                if s is None:
                    w = kernels.update_w(old, m.mul(ht), hh)
                else:
                    w = old * (m.mul(ht) @ s.T) / (old @ (s @ hh @ s.T) + eps)
                save(f"w{n}", w)
                return _products(w, old, m)

            vw, ww, dw = x.run(step, (new_h.T, new_h @ new_h.T, s))
            vw, ww, dw = vw.reshape(n_terms, k), ww.reshape(k, k), dw.reshape(k, k)
            last = n
            if method == "nmf":
                done = max(_root(dw), kernels.spectral_norm(new_h - h)) < threshold
            else:
                hh = h @ h.T
                new_s = s * (vw.T @ h.T) / (ww @ s @ hh + eps)
                new_h = h * (new_s.T @ vw.T) / (new_s.T @ ww @ new_s @ h + eps)
                done = max(np.sqrt(np.trace(dw)), np.linalg.norm(new_s - s), np.linalg.norm(new_h - h)) < threshold
                s = new_s
            h = new_h
        else:
            orthogonal = method == "opnmf"

            def step(b, m, load, save, shared, n=n):
                vw, inner, ww, factor = shared
                old = load(f"w{n - 1}") * factor
                vvw = m.mul(vw)
                w = old * vvw / (old @ inner + eps) if orthogonal else old * np.sqrt(vvw / (old @ inner + vvw @ ww + eps))
                save(f"w{n}", w)
                return _ByTerm(m.tmul(w)), (w.T @ w).ravel(), ((w - old).T @ (w - old)).ravel(), np.array([(w * old).sum(), (old * old).sum()])

            new_vw, new_ww, dw, dots = x.run(step, (vw, vw.T @ vw, ww, float(scale[0])))
            new_vw, new_ww, dw = new_vw.reshape(n_terms, k), new_ww.reshape(k, k), dw.reshape(k, k)
            if orthogonal:
                c = 1 / (_root(new_ww) + eps)
                done = np.sqrt(max(0.0, c * c * np.trace(new_ww) - 2 * c * dots[0] + dots[1])) < threshold
            else:
                c, done = 1.0, _root(dw) < threshold
            if not done:  # the converged step isn't taken
                vw, ww, last, scale = c * new_vw, c * c * new_ww, n, np.full(k, c)
        if n > 1:
            x.forget(f"w{n - 2}")
        if done:
            break
    if method in ("nmf", "nmtf"):
        h[h < zero] = 0
    else:
        scale = scale / np.maximum(np.sqrt(np.diag(ww)), eps)

    def finish(b, m, load, save, scale):
        w = load(f"w{last}") * scale
        w[w < zero] = 0
        save("w", w)
        return (_ByTerm(m.tmul(w)),)

    vw = x.run(finish, scale)[0].reshape(n_terms, k)
    return n, vw.T if method in ("pnmf", "opnmf") else h, s


def topic_subset(v: DataFrame, w: DataFrame, topic: int, least: float = 0.01) -> DataFrame:
    """The rows of v of documents whose weight for a topic is at least `least`, to be factorized anew."""
    return v.join(w.where((F.col("topic_id") == topic) & (F.col("weight") >= least)).select("doc_id"), "doc_id", "left_semi")


def local_matrix(v: DataFrame) -> tuple[kernels.Sparse, np.ndarray, list[str]]:
    """v gathered as a sparse matrix, with the ids of its rows and the terms of its columns, both in order."""
    t = v.select("doc_id", "term", "w").toArrow()
    docs, row = np.unique(np.asarray(t.column("doc_id")), return_inverse=True)
    coded = t.column("term").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), dtype=np.int64)
    place[order] = np.arange(len(names))
    return kernels.Sparse(row, place[np.asarray(coded.indices)], np.asarray(t.column("w")), (len(docs), len(names))), docs, [names[i] for i in order]
