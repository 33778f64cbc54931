import random

import numpy as np
import pytest

from sparktide.operators import factorize as Z
from sparktide.operators import kernels as K


def matrix(n=60, terms=40, seed=0):
    rng = random.Random(seed)
    rows = {}
    for i in range(n):
        for _ in range(12):
            t = rng.randrange(terms // 2) + (i % 2) * terms // 2
            rows[i * 3, f"t{t:02d}"] = rows.get((i * 3, f"t{t:02d}"), 0.0) + 1.0
        rows[i * 3, f"t{rng.randrange(terms):02d}"] = 0.5
    return [(d, t, w) for (d, t), w in rows.items()]


@pytest.mark.parametrize("method", ["nmf", "pnmf", "opnmf", "nmtf"])
def test_blocks_give_what_one_node_gives(spark, method):
    v = spark.createDataFrame(matrix(), "doc_id bigint, term string, w double")
    a = Z.factorize(v, 3, method, most=12)
    b = Z.factorize_blocks(v, 3, method, most=12, block_docs=15)
    assert a.rounds == b.rounds
    for x, y, key in ((a.w, b.w, "doc_id"), (a.h, b.h, "term")):
        x = {(r[key], r.topic_id): r.weight for r in x.collect()}
        y = {(r[key], r.topic_id): r.weight for r in y.collect()}
        assert x.keys() == y.keys()
        assert np.allclose([x[i] for i in sorted(x)], [y[i] for i in sorted(x)], atol=1e-5, rtol=1e-4)
    assert (a.s is None) == (b.s is None) == (method != "nmtf")


def test_kernels_by_dense_algebra():
    rows = matrix(20, 12, 1)
    docs, terms = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    dense = np.zeros((len(docs), len(terms)))
    for d, t, w in rows:
        dense[docs.index(d), terms.index(t)] = w
    r, c = np.nonzero(dense)
    m = K.Sparse(r, c, dense[r, c], dense.shape)
    b = np.random.default_rng(0).random((len(terms), 3))
    assert np.allclose(m.mul(b), dense @ b) and np.allclose(m.tmul(dense @ b), dense.T @ (dense @ b))
    u, s, vt = K.svd(m, 3)
    assert np.allclose(s, np.linalg.svd(dense)[1][:3]) and np.allclose((u * s) @ vt @ vt.T, dense @ vt.T)
    w, h = K.nndsvd(m, 3)
    assert (w >= 0).all() and (h >= 0).all()
    # one step of the multiplicative rule
    h1 = h * (w.T @ dense) / (w.T @ w @ h + K.EPS)
    w1 = w * (dense @ h1.T) / (w @ h1 @ h1.T + K.EPS)
    w1[w1 < 1e-5], h1[h1 < 1e-5] = 0, 0
    got = K.nmf(m, 3, most=1)
    assert np.allclose(got[0], w1) and np.allclose(got[1], h1)
    for method in (False, True):
        w, h, n = K.projective_nmf(m, 3, most=200, orthogonal=method)
        assert np.allclose(np.linalg.norm(w, axis=0), 1, atol=1e-3) and np.linalg.norm(dense - w @ h) < np.linalg.norm(dense)
    w, s, h, n = K.nmtf(m, 3, most=200)
    assert np.linalg.norm(dense - w @ s @ h) < 0.8 * np.linalg.norm(dense)
    a = dense @ dense.T
    x = K.symmetric_nmf(a, 3)
    assert (x >= 0).all() and np.linalg.norm(a - x @ x.T) < 0.6 * np.linalg.norm(a)
    groups = K.hierarchical_nmf(m, 2)
    assert sorted(np.concatenate(groups).tolist()) == list(range(len(terms))) and len(groups) == 2
    p = np.random.default_rng(1).random((6, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    q = K.classical_mds(d)
    assert np.allclose(np.sqrt(((q[:, None] - q[None]) ** 2).sum(axis=2)), d)
    for x in K.random_start((4, 5), 2, 0.1, 0.2):
        assert ((x >= 0.1) & (x < 0.2)).all()
