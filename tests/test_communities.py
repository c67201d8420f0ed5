"""Communities against a serial Louvain, and enrichment of groups against permutations counted in numpy."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import benchmark as B
from wellspring.operators import communities, spatial


def modularity(edges, part, resolution):
    m, degree, inside = sum(w for _, _, w in edges), defaultdict(float), 0.0
    for a, b, w in edges:
        degree[part[a]] += w
        degree[part[b]] += w
        inside += w * (part[a] == part[b])
    return inside / m - resolution * sum((k / (2 * m)) ** 2 for k in degree.values())


def serial_louvain(edges, resolution, seed):
    """Best of plain moves, one node at a time, then contraction."""
    rng = random.Random(seed)
    part = {n: n for e in edges for n in e[:2]}
    graph = [tuple(e) for e in edges]
    while True:
        near, degree = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, b, w in graph:
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        m2, of, total, moved = sum(degree.values()), {n: n for n in degree}, dict(degree), False
        while True:
            nodes, again = list(degree), False
            rng.shuffle(nodes)
            for n in nodes:
                total[of[n]] -= degree[n]
                w = defaultdict(float, {of[n]: 0.0})
                for o, x in near[n].items():
                    w[of[o]] += x
                best = max(w, key=lambda c: (round(w[c] - resolution * degree[n] * total[c] / m2, 9), c == of[n]))
                again |= best != of[n]
                of[n] = best
                total[best] += degree[n]
            moved |= again
            if not again:
                break
        if not moved:
            return part
        part = {n: of[c] for n, c in part.items()}
        merged = defaultdict(float)
        for a, b, w in graph:
            merged[min(of[a], of[b]), max(of[a], of[b])] += w
        graph = [(a, b, w) for (a, b), w in merged.items()]


def planted(seed, sizes, inner, outer):
    rng, block = random.Random(seed), [i for i, n in enumerate(sizes) for _ in range(n)]
    return [(a, b, rng.choice([1.0, 1.5])) for a in range(len(block)) for b in range(a + 1, len(block)) if rng.random() < (inner if block[a] == block[b] else outer)]


def test_runs_reach_the_modularity_of_a_serial_louvain(spark):
    resolutions = (0.5, 1.0, 2.0)
    graphs = [planted(1, [20, 15, 25], 0.4, 0.03), planted(2, [12] * 5, 0.3, 0.06)]
    rows = [(g * 3 + i, a, b, w) for g, edges in enumerate(graphs) for i in range(3) for a, b, w in edges]
    got = communities.louvain_runs(spark.createDataFrame(rows, "run int, src long, dst long, weight double"), {g * 3 + i: r for g in range(2) for i, r in enumerate(resolutions)})
    parts = defaultdict(dict)
    for r in got.collect():
        parts[r["run"]][r["node"]] = r["community"]
    for g, edges in enumerate(graphs):
        for i, r in enumerate(resolutions):
            want = max(modularity(edges, serial_louvain(edges, r, s), r) for s in range(3))
            assert set(parts[g * 3 + i]) == {n for e in edges for n in e[:2]}
            assert modularity(edges, parts[g * 3 + i], r) >= want - 0.02, (g, r)


def test_no_edges_give_no_communities(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert communities.louvain_communities(none).collect() == []


def test_expected_information_of_large_clusters_is_quick_and_near_that_of_lgamma():
    import math

    x = np.array([0, 1, 255, 256, 1000, 10**8], dtype=float)
    assert B.log_factorial(x) == pytest.approx([math.lgamma(v + 1) for v in x], rel=1e-13, abs=1e-9)


def test_expected_information_of_middling_clusters_is_the_sum_over_whole_counts():
    import math

    import pandas as pd

    def want(x, y, t):
        f = lambda v: math.lgamma(v + 1)
        p = lambda n: math.exp(f(x) + f(y) + f(t - x) + f(t - y) - f(t) - f(n) - f(x - n) - f(y - n) - f(t - x - y + n))
        return sum(n / t * math.log(t * n / (x * y)) * p(n) for n in range(max(1, x + y - t), min(x, y) + 1))

    sizes = [(700, 800, 2000), (1, 2000, 2000), (5, 7, 20), (15000, 400, 50000), (900, 1000, 1200)] * 300
    got = B._expected_information.func(*(pd.Series(c) for c in zip(*sizes)))
    assert got.tolist() == pytest.approx([want(*c) for c in sizes[:5]] * 300, rel=1e-8, abs=1e-12)


def test_graphs_advance_in_the_same_rounds_and_part_as_each_alone(spark, monkeypatch):
    frame = lambda edges: spark.createDataFrame(edges, "src long, dst long, weight double")
    graphs = [frame(planted(3, [8] * 4, 0.6, 0.1)), frame(planted(4, [30], 0.2, 0.2))]
    stored, real = [], communities.durable
    monkeypatch.setattr(communities, "durable", lambda *a, **k: stored.append(1) or real(*a, **k))

    def parts(df):
        return {(r["run"], r["node"]): r["community"] for r in df.collect()}

    alone, rounds = [], []
    for g in graphs:
        stored.clear()
        alone.append(parts(communities.communities_at(g, (0.5, 2.0))))
        rounds.append(len(stored))
    stored.clear()
    both = communities.communities_of(graphs, (0.5, 2.0))
    assert len(stored) < 0.8 * sum(rounds)
    for number, want in enumerate(alone):
        assert parts(both.where(F.col("graph") == number)) == want


def permuted(spark, ids, groups, perms, seed):
    """Labels that the operator gives each id in each permutation, by the same order of hashes."""
    f = spark.createDataFrame([(i, p) for i in ids for p in range(1, perms + 1)], "id long, perm int")
    h = {(r["perm"], r["id"]): r["h"] for r in f.select("id", "perm", F.xxhash64(F.lit(seed), "perm", "id").alias("h")).collect()}
    out = {}
    for p in range(1, perms + 1):
        order = sorted(ids, key=lambda i: (h[p, i], i))
        out[p] = {n: groups[ids[k]] for k, n in enumerate(order)}
    return out


def test_enrichment_has_all_pairs_and_the_z_of_numpy(spark):
    rng = random.Random(4)
    ids = list(range(24))
    groups = {i: "AB"[i // 12] if i < 22 else "C" for i in ids}
    edges = [(a, b, rng.randrange(1, 4)) for a in ids for b in ids if a != b and groups[a] == groups[b] and rng.random() < 0.3]
    nodes = spark.createDataFrame([("w", i, groups[i]) for i in ids], "well string, id long, g string")
    e = spark.createDataFrame([("w", a, b, r) for a, b, r in edges], "well string, src long, dst long, rank int")
    perms = permuted(spark, ids, groups, 40, 7)

    def z(edges):
        count = lambda label, x, y: sum(label[a] == x and label[b] == y for a, b, _ in edges)
        out = {}
        for x in "ABC":
            for y in "ABC":
                n, ns = count(groups, x, y), np.array([count(p, x, y) for p in perms.values()], dtype=float)
                out[x, y] = (n, (n - ns.mean()) / ns.std() if ns.std() > 0 else None)
        return out

    run = lambda **more: spatial.nhood_enrichment(nodes, e, "g", 40, 7, key=("well",), id_col="id", **more)
    got = {(r["src_group"], r["dst_group"]): (r["n"], r["z"]) for r in run(batch=15).collect()}
    want = z(edges)
    assert set(got) == set(want) and got["A", "B"][0] == 0 and got["A", "B"][1] < -2
    for pair, (n, score) in want.items():
        assert got[pair] == (n, pytest.approx(score))
    nested = run(nested=3).collect()
    assert len(nested) == 27
    for r in nested:
        n, score = z([x for x in edges if x[2] <= r["k"]])[r["src_group"], r["dst_group"]]
        assert (r["n"], r["z"]) == (n, pytest.approx(score) if score is not None else None)


def test_well_features_are_complete_and_zero_filled(spark):
    from wellspring.operators import joins
    from wellspring.operators.spatial_features import well_features

    rng = random.Random(6)
    rows = [("p", w, f"{w}{i}", i % 2, rng.random() * 60, rng.random() * 60, rng.random() * 60, rng.random()) for w in "AB" for i in range(30)]
    rows += [("p", "far", f"f{i}", i % 2, 1000.0 * i, 0.0, 0.0, 1.0) for i in range(3)] + [("p", "single", f"s{i}", 0, float(i), 0.0, 0.0, 1.0) for i in range(3)]
    nodes = spark.createDataFrame(rows, "plate_id string, well_id string, label string, leiden int, x double, y double, z double, f double")
    edges = joins.radius_neighbors(nodes, 30.0)
    got = {}
    for r in well_features(nodes, edges, (15, 30), ("f",), "m", 30.0, 1, n_perms=20).collect():
        got.setdefault(r["well_id"], {})[r["feature"]] = r["value"]
    assert set(got) == {"A", "B", "far"} and len({frozenset(v) for v in got.values()}) == 1
    assert got["A"]["cell_count"] == 30 and got["A"]["m_0"] == 15
    e = edges.where("well_id = 'A' and dist <= 15").collect()
    kind = {r[2]: r[3] for r in rows}
    assert got["A"]["m_stat_interaction_0_1_15"] == sum(kind[x["src"]] == 0 and kind[x["dst"]] == 1 for x in e)
    assert got["A"]["m_stat_mean_degree_30"] == pytest.approx(edges.where("well_id = 'A'").count() / 30)
    assert got["A"]["m_stat_hull_volume"] > 0 and got["far"]["m_stat_hull_volume"] == 0
    kinds = ("interaction_0_1", "enrichment_0_0", "mean_degree_1", "std_degree", "centrality_0", "closeness_1", "clustering_0", "morans_i_f", "morans_i_1")
    assert all(f"m_stat_{k}_{r}" in got["A"] for k in kinds for r in (15, 30))
    assert {v for k, v in got["far"].items() if k not in ("cell_count", "m_0", "m_1")} == {0.0}


def test_well_features_without_edges_are_the_same(spark):
    from wellspring.operators import joins
    from wellspring.operators.spatial_features import well_features

    rng = random.Random(6)
    rows = [("p", "A", f"A{i}", i % 2, rng.random() * 60, rng.random() * 60, 0.0, rng.random()) for i in range(40)]
    nodes = spark.createDataFrame(rows, "plate_id string, well_id string, label string, leiden int, x double, y double, z double, f double")
    edges = joins.radius_neighbors(nodes, 30.0)
    a, b = ({r["feature"]: r["value"] for r in well_features(nodes, e, (30,), ("f",), "m", 30.0, 1, n_perms=5).collect()} for e in (edges, None))
    assert set(a) == set(b) and len(a) > 20 and all(b[k] == pytest.approx(v) for k, v in a.items())
