"""Clusters against every distance computed in full, in Python's integers."""

import hashlib

import numpy as np
import pytest

from wellspring.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, id long, distance int"


def brute(rows, clusters=16, rounds=3):
    kept = [(i, [int(np.floor(64 * e)) for e in v]) for i, v in rows if v is not None and len(v) == 64 and all(e is not None and np.isfinite(e) for e in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:clusters]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, x)) for x in c]
            out.append((i, v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        by = {}
        for _, v, k, _ in assign():
            by.setdefault(k, []).append(v)
        c = [[sum(col) // len(by[k]) for col in zip(*by[k])] if k in by else x for k, x in enumerate(c)]
    last = assign()
    of = lambda k: sum(d for _, _, j, d in last if j == k)
    sha = lambda k: hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()
    return sorted((str(i), k, d, of(k), sum(x[3] for x in last), sha(k)) for i, _, k, d in last)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    out = centroids.cluster_vectors(df.repartition(3) if rows else df)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-100, 100, (2, 5, 64))
    d = centroids.walsh_hadamard(x) - centroids.walsh_hadamard(y)
    assert ((d * d).sum(axis=1) == 64 * ((x - y) ** 2).sum(axis=1)).all()
    assert (centroids.walsh_hadamard(x)[:, 0] == x.sum(axis=1)).all()  # the coarsest coefficient first


def test_search_is_exact_with_ties():
    rng = np.random.default_rng(2)
    v, c = rng.integers(-3, 3, (500, 64)), rng.integers(-3, 3, (16, 64))
    c[7], c[9] = c[3], c[3]
    where, far = centroids.nearest(centroids.walsh_hadamard(v), centroids.walsh_hadamard(c))
    d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (where == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


@pytest.mark.parametrize("kind", ["normal", "few", "equal", "large"])
def test_clusters_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    n = 9 if kind == "few" else 150
    x = rng.normal(size=(n, 64)) * (10.0 ** rng.integers(0, 6, n)[:, None] if kind == "large" else 1)
    if kind == "equal":
        x = np.tile(rng.normal(size=(4, 64)), (40, 1))[:n]
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)] + [(3, [float(e) for e in x[3]])]
    rows += [(None, [0.5] * 64), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("inf")] + [1.0] * 63)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_out_of_range(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    far = run(spark, [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)])
    assert [r[2] for r in far] == [0, 0, 0]  # each is its own centroid
