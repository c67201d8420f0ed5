"""Diffusion, registration, profiles, stored distances, transferred clusters and hulls against plain numpy."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import diffusion, embedding, geometry, mixing, profiles, registration, spatial, wells
from wellspring.sources import tables as S


def test_diffusion_components_equal_a_dense_eigensolver(spark):
    rng = random.Random(3)
    n = 24
    edges = [(i, i + 1, 1.0) for i in range(n - 1)] + [(i, j, round(rng.random(), 3) + 0.1) for i in range(n) for j in range(i + 2, n) if rng.random() < 0.15]
    c, values = diffusion.diffusion_components(spark.createDataFrame(edges, "src long, dst long, weight double"), 4, 1e-9)
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    q = w.sum(axis=1)
    k = w / np.outer(q, q)
    z = np.sqrt(k.sum(axis=1))
    value, vector = np.linalg.eigh(k / np.outer(z, z))
    value, vector = value[::-1][:4], vector[:, ::-1][:, :4]
    vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), range(4)])
    got = {r["node"]: r["components"] for r in c.collect()}
    assert values == pytest.approx(value.tolist(), abs=1e-9)
    assert np.abs(np.array([got[i] for i in range(n)]) - vector).max() < 1e-6
    time = {r["node"]: r["pseudotime"] for r in diffusion.pseudotime(c, values).collect()}
    root = int(vector[:, 1].argmin())
    far = np.sqrt((((vector - vector[root]) * (value / np.maximum(1 - value, 1e-12)))[:, 1:] ** 2).sum(axis=1))
    assert time[root] == 0 and np.array([time[i] for i in range(n)]) == pytest.approx(far / far.max(), abs=1e-5)


def test_diffusion_of_tiny_and_empty_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert diffusion.diffusion_components(none)[0].collect() == []
    c, values = diffusion.diffusion_components(spark.createDataFrame([(1, 2, 1.0)], none.schema), 4)
    assert values == pytest.approx([1.0, -1.0]) and c.count() == 2


def turn(x, angle, axis):
    a, b = [i for i in range(3) if i != axis]
    r = np.eye(3)
    r[a, a] = r[b, b] = math.cos(angle)
    r[a, b], r[b, a] = -math.sin(angle), math.sin(angle)
    return x @ r.T


def test_planted_motions_are_recovered_and_small_wells_stay(spark):
    rng = np.random.default_rng(5)
    planted = {"A": (0.03, 2, (4.0, -3.0, 1.0)), "B": (-0.02, 0, (30.0, 0.0, 5.0))}
    source, target = [], []
    for well, (angle, axis, shift) in planted.items():
        x = rng.uniform(0, 300, (60, 3))
        y = turn(x, angle, axis) + shift
        source += [(well, f"s{i}", *map(float, p)) for i, p in enumerate(x)]
        target += [(well, f"t{i}", *map(float, p)) for i, p in enumerate(y)]
    source += [("C", "s0", 0.0, 0.0, 0.0), ("C", "s1", 1.0, 0.0, 0.0), ("D", "s0", 1.0, 2.0, 3.0), ("A", "null", None, 0.0, 0.0)]
    target += [("C", "t0", 5.0, 5.0, 5.0)]
    schema = "well_id string, label string, x double, y double, z double"
    out = registration.rigid_register(spark.createDataFrame(source, schema), spark.createDataFrame(target, schema), 40.0, 10.0, rounds=25).collect()
    got = {(r["well_id"], r["label"]): r for r in out}
    assert len(got) == len(out) == len(source) - 1
    want = {(w, "s" + t[1:]): (x, y, z) for w, t, x, y, z in target}
    for key, r in got.items():
        if key[0] in "AB":
            assert (r["x"], r["y"], r["z"]) == pytest.approx(want[key], abs=1e-4) and r["linked"]
    assert [got[k]["x"] for k in (("C", "s0"), ("C", "s1"), ("D", "s0"))] == [0.0, 1.0, 1.0] and not got["D", "s0"]["linked"]


def test_kabsch_does_not_reflect():
    rng = np.random.default_rng(1)
    s = rng.normal(size=(50, 3))
    t = s * [1, 1, -1]
    m = registration.kabsch(np.array([50.0]), s.sum(axis=0)[None], t.sum(axis=0)[None], (s.T @ t)[None])[0]
    assert np.linalg.det(m[:9].reshape(3, 3)) == pytest.approx(1.0)


def brute_spectrum(p, points=16, sigma=1.0):
    x = np.interp(np.linspace(0, len(p) - 1, points), np.arange(len(p)), p)
    w = np.exp(-0.5 * (np.arange(-4, 5) / sigma) ** 2)
    x = np.convolve(np.pad(x, 4, mode="symmetric"), w / w.sum(), mode="valid")
    return np.fft.fft(x)[: points // 2 + 1]


def test_profile_distances_equal_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(img, e, [float(v) for v in rng.integers(0, 100, rng.integers(1, 40))]) for img in (0, 1) for e in range(9) if (img, e) != (1, 4)]
    df = spark.createDataFrame([*rows, (0, 99, None), (0, 98, [])], "img int, edge long, profile array<double>")
    got = {(r["a"], r["b"]): (r["distance"], r["n"]) for r in profiles.distance_between_profiles(df, ["img"], "edge", block_rows=4).collect()}
    f = {(i, e): brute_spectrum(p) for i, e, p in rows}
    assert len(got) == 36
    for (a, b), (d, n) in got.items():
        each = [np.sqrt((np.abs(f[i, a] - f[i, b]) ** 2).sum()) for i in (0, 1) if (i, a) in f and (i, b) in f]
        assert n == len(each) and d == pytest.approx(np.mean(each))


def test_profile_pairs_are_summed_over_groups_in_tasks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(img, e, [float(v) for v in rng.integers(0, 100, 6)]) for img in range(5) for e in range(7 if img else 3)]
    df = spark.createDataFrame(rows, "img int, edge long, profile array<double>")
    f = {(i, e): brute_spectrum(p) for i, e, p in rows}
    for slots, block in ((1024, 512), (2, 3)):  # in one sum, and given again and again
        monkeypatch.setattr(profiles, "SLOTS", slots)
        got = {(r["a"], r["b"]): (r["distance"], r["n"]) for r in profiles.distance_between_profiles(df, ["img"], "edge", block_rows=block).collect()}
        assert set(got) == {(a, b) for b in range(7) for a in range(b)}
        for (a, b), (d, n) in got.items():
            each = [np.sqrt((np.abs(f[i, a] - f[i, b]) ** 2).sum()) for i in range(5) if (i, b) in f]
            assert n == len(each) and d == pytest.approx(np.mean(each))


def test_a_rerun_replaces_one_plate_and_reads_are_pruned(spark, tmp_path):
    rows = spark.createDataFrame([(p, "A01", r, str(i), float(i)) for p in ("004", "005") for r in (25, 50) for i in range(3)], "plate_id string, well_id string, radius int, label string, distance double")
    path = str(tmp_path / "distances")
    S.write_kernel_distances(rows, path)
    S.write_kernel_distances(rows.where("plate_id = '004' and label = '0'").withColumn("distance", F.lit(9.0)), path)
    back = S.load_kernel_distances(spark, path)
    assert back.where("plate_id = '005'").count() == 6
    assert [(r["label"], r["distance"]) for r in back.where("plate_id = '004'").collect()] == [("0", 9.0)] * 2
    one = S.load_kernel_distances(spark, path, ["005"], [50])
    assert len(one.inputFiles()) > 0 and one.count() == 3
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [plate_id" in scan.replace("isnotnull(plate_id", "plate_id") or "PartitionFilters" in scan and "plate_id" in scan.split("PartitionFilters")[1][:200]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.load_kernel_distances(spark, path + "x").count()


def test_principal_components_equal_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)) + 5
    df = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>").repartition(4)
    got = {r["id"]: r["pcs"] for r in embedding.pca(df, "v", 3).collect()}
    c = x - x.mean(axis=0)
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :3]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(3)])
    assert np.array([got[i] for i in range(80)]) == pytest.approx(c @ axes, abs=1e-8) and got[99] is None


def test_nearest_vectors_with_ties_over_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (90, 4)).astype(float)
    df = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)] + [(500, None)], "id long, v array<double>")
    got = {}
    for r in embedding.vector_knn(df, df, 5, "id", "v", block_rows=16).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dist"], r["dst"]))
    for i in range(90):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want = sorted((d[j], j) for j in range(90) if j != i)[:5]
        assert [(b, c) for _, b, c in sorted(got[i])] == [(pytest.approx(a), j) for a, j in want]
    assert len(got) == 90


def test_nearest_vectors_move_with_the_rows_and_not_with_their_pairs(spark, monkeypatch):
    def copies(n):  # rows that reach a join or a cogroup from either side, for n rows
        df = spark.range(n).select("id", F.array((F.col("id") * 7 % 101).cast("double"), (F.col("id") * 13 % 89).cast("double")).alias("v"))
        near = embedding.vector_knn(df, df, 3, "id", "v", block_rows=16)
        assert near.count() == 3 * n
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan
        return near.select("src", "rank").distinct().count()

    assert (copies(400), copies(1600)) == (1200, 4800)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (120, 3)).astype(float)
    rows = [(i, i % 3, [float(e) for e in v]) for i, v in enumerate(x)] + [(900, 0, [float("nan")] * 3), (901, 0, None), (3, 0, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    whole = sorted(map(tuple, embedding.vector_knn(df, df, 4, "id", "v", group="g").collect()))
    monkeypatch.setattr(embedding, "HELD", 400)  # references in cuts of ten rows, queries in parts of four
    assert sorted(map(tuple, embedding.vector_knn(df, df, 4, "id", "v", block_rows=4, group="g").collect())) == whole
    assert len(whole) == 120 * 4 and not {r[1] for r in whole} & {900, 901}


def blobs(spark, n=240, extra=()):
    rng = np.random.default_rng(9)
    center = rng.normal(size=(4, 5)) * 12
    rows = [(i, [float(e) for e in center[i % 4] + rng.normal(size=5)]) for i in range(n)]
    return spark.createDataFrame([*rows, *extra], "id long, v array<double>")


def test_transferred_clusters_follow_blobs(spark):
    labels, accuracy = wells.cluster_pipeline(blobs(spark, extra=[(999, None)]), "id", "v", frac=0.5, n_comps=3, k=8, vote=9)
    got = {r["id"]: r for r in labels.collect()}
    assert set(got) == set(range(240)) and 80 < sum(r["sampled"] for r in got.values()) < 160
    parts = {b: {got[i]["leiden"] for i in range(b, 240, 4)} for b in range(4)}
    assert sum(len(p) for p in parts.values()) == len(set().union(*parts.values()))  # no label spans two blobs
    assert accuracy.first()[0] > 0.9


def test_all_rows_are_clustered_unless_a_sample_is_asked_for(spark):
    labels, accuracy = wells.cluster_pipeline(blobs(spark), "id", "v", n_comps=3, k=8, vote=9)
    got = labels.collect()
    assert len(got) == 240 and all(r["sampled"] for r in got) and accuracy.first()[0] > 0.9


def test_well_embedding_equals_numpy_and_shares_features(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 4)) * [1, 10, 3, 0] + [0, 5, 1, 2]
    rows = [(i, f"W{i}", "AB"[i % 2], *[float(e) if (i, j) != (3, 1) else None for j, e in enumerate(v)]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, well_id string, plate_id string, a double, b double, c double, d double")
    out = wells.well_embedding(df, "id", {"one": ["a", "b"], "both": ["a", "b", "c", "d"]}, n_comps=2, k=5).collect()
    assert len(out) == 120 and all(r["leiden"] is not None for r in out)
    x[3, 1] = np.nan
    z = np.nan_to_num((x - np.nanmean(x, axis=0)) / np.where(np.nanstd(x, axis=0, ddof=1) > 0, np.nanstd(x, axis=0, ddof=1), np.inf))
    for name, cols in (("one", [0, 1]), ("both", [0, 1, 2, 3])):
        c = z[:, cols] - z[:, cols].mean(axis=0)
        axes = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :2]
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
        got = {r["id"]: r["pcs"] for r in out if r["modality"] == name}
        assert np.array([got[i] for i in range(60)]) == pytest.approx(c @ axes, abs=1e-8)


def test_ridge_removes_a_plate_shift(spark):
    rows = [(i, "AB"[i % 2], i % 3, float(i % 2) * 10 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, plate string, row int, f double")
    out = {r["id"]: r["f"] for r in wells.ridge_residuals(wells.scaled_features(df, ["f"]), ["f"], ["plate"], ["row"], 1e-6).collect()}
    by = lambda k: np.mean([v for i, v in out.items() if i % 2 == k])
    assert by(0) == pytest.approx(by(1), abs=1e-4) and len(out) == 60


def test_hulls_keep_their_volume_and_tasks_get_few_points(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 3))
    cube = [(float(a), float(b), float(c)) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    rows = [("ball", *map(float, p)) for p in x] + [("cube", *p) for p in cube] + [("flat", float(i), float(i % 3), 0.0) for i in range(9)] + [("one", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "w string, x double, y double, z double")
    got = {r["w"]: r for r in geometry.convex_hulls(df, ["w"], 1.0).collect()}
    assert got["ball"]["volume"] == pytest.approx(geometry.hull_volume_area(x)[0]) and got["cube"]["volume"] == pytest.approx(1.0) and got["cube"]["area"] == pytest.approx(6.0)
    assert got["flat"]["volume"] == got["one"]["volume"] == 0.0
    assert geometry.extreme_points(df.where("w = 'ball'"), ["w"]).count() < 1000


def test_component_stats_drop_sparse_points_and_small_wells(spark):
    rng = np.random.default_rng(12)
    near = rng.uniform(0, 50, (20, 3))
    rows = [("p", "A", str(i), 1, *map(float, p)) for i, p in enumerate(near)] + [("p", "A", "far", 1, 900.0, 900.0, 0.0), ("p", "A", "other", 2, 10.0, 10.0, 10.0)]
    rows += [("p", "B", str(i), 1, *map(float, p)) for i, p in enumerate(near[:10])]
    df = spark.createDataFrame(rows, "plate_id string, well_id string, label string, leiden int, x double, y double, z double")
    got = geometry.component_stats(df, [1]).collect()
    assert [(r["well_id"], r["n_pts"]) for r in got] == [("A", 20)]
    assert got[0]["cx"] == pytest.approx(near[:, 0].mean() * geometry.PIXEL_MM)


def test_morans_i_of_groups_equals_that_of_each_membership(spark):
    rng = random.Random(13)
    nodes = spark.createDataFrame([("p", "w", i, rng.randrange(3)) for i in range(30)] + [("p", "alone", 1, 0)], "plate_id string, well_id string, label long, leiden int")
    edges = spark.createDataFrame([("p", "w", a, b) for a in range(28) for b in range(28) if a != b and rng.random() < 0.2], "plate_id string, well_id string, src long, dst long")
    got = {(r["well_id"], r["leiden"]): r["moran_i"] for r in spatial.morans_i_groups(nodes, edges).collect()}
    for g in range(3):
        one = {r["well_id"]: r["moran_i"] for r in spatial.morans_i(nodes.withColumn("h", (F.col("leiden") == g).cast("double")), edges, "h").collect()}
        assert got["w", g] == pytest.approx(one["w"])
    assert got["alone", 0] == 0.0


def test_search_holds_no_doubles_of_all_references():
    r = np.random.default_rng(0).normal(size=(100_000, 64)).astype(np.float32)
    ids = np.arange(len(r))
    tracemalloc.start()
    found = list(embedding.nearest_rows(ids[:64], r[:64], ids, r, 5, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * r.nbytes
    row, col, near = found[0]
    d = np.sqrt(((r[:64, None].astype(float) - r[None, :2000]) ** 2).sum(axis=2))
    d[np.arange(64), np.arange(64)] = np.inf
    assert all(d[i].min() >= near[row == i].min() - 1e-9 for i in range(64)) and not (row == col).any()


def test_lisi_of_many_rows_at_once():
    rng = np.random.default_rng(0)
    dist, label = np.sort(rng.exponential(size=(50, 15)), axis=1), rng.integers(0, 3, (50, 15))
    many = mixing.inverse_simpsons(dist, label, 5.0)
    assert np.allclose(many, [mixing.inverse_simpsons(d[None], x[None], 5.0)[0] for d, x in zip(dist, label)])
    low, high = 1e-6, 1e6
    for _ in range(200):  # one row, by bisection of the logarithm
        beta = (low * high) ** 0.5
        p = np.exp(-beta * (dist[0] - dist[0].min()))
        p /= p.sum()
        low, high = (beta, high) if -(p * np.log(p)).sum() > np.log(5.0) else (low, beta)
    assert abs(many[0] - 1 / sum(p[label[0] == v].sum() ** 2 for v in range(3))) < 1e-4
