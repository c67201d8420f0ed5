"""Operators on small frames with values worked out by hand."""

import numpy as np
from pyspark.sql import functions as F

from wellspring.functions.cdf import beta_inc, gamma_upper
from wellspring.operators import geometry, graph, joins, pixels, spatial, stats
from wellspring.sources import tables


def points(spark, rows):
    return spark.createDataFrame([("p", "w", *r) for r in rows], "plate_id string, well_id string, label string, x double, y double, z double, leiden int")


def test_radius_join_is_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(f"n{i}", *map(float, rng.uniform(-50, 50, 3)), int(i % 3)) for i in range(60)]
    got = {(r.src, r.dst) for r in joins.radius_neighbors(points(spark, rows), 20.0).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and sum((p - q) ** 2 for p, q in zip(a[1:4], b[1:4])) <= 400}
    assert got == want


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (9, 9), (None, 4), (5, 6), (6, 4), (4, 7)], "src int, dst int")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4, 9: 9}
    assert graph.connected_components(e.where("src > 100")).count() == 0


def test_constant_field_stays(spark):
    p = points(spark, [("a", 0.0, 0.0, 0.0, 0), ("b", 1.0, 0.0, 0.0, 1), ("c", 50.0, 0.0, 0.0, 1)]).withColumn("f", F.lit(3.0))
    e = joins.radius_neighbors(p, 5.0)
    assert {r.f_msg for r in spatial.message_passing(p, e, ["f"]).collect()} == {3.0}
    assert {r.label: r.degree for r in spatial.degree(p, e).collect()} == {"a": 1, "b": 1, "c": 0}
    assert spatial.morans_i(p, e, "f").first().moran_i == 0.0


def test_regionprops_of_a_rectangle(spark):
    rows = [(0, y, x, 5, 1) for y in range(2) for x in range(6)]
    px = spark.createDataFrame(rows, "img int, y int, x int, v int, label int")
    r = pixels.regionprops(px, ["img"]).first()
    assert (r.area, r.cy, r.cx) == (12, 0.5, 2.5)
    assert abs(r.major_axis_length - 4 * np.sqrt(35 / 12 + 1 / 12)) < 1e-9


def test_disconnected_parts(spark):
    rows = [(0, 0, 0, x, 1) for x in (0, 1, 5)] + [(0, 0, 1, 2, 1)]
    px = spark.createDataFrame(rows, "img int, z int, y int, x int, label int")
    assert pixels.split_disconnected(px, ["img"]).select("part").distinct().count() == 2


def test_tails_match_published_values():
    assert abs(gamma_upper(0.5, 3.841459 / 2) - 0.05) < 1e-6
    assert abs(beta_inc(10 / 2, 0.5, 10 / (10 + 2.228139**2)) - 0.05) < 1e-6
    assert abs(beta_inc(20 / 2, 3 / 2, 20 / (20 + 3 * 3.098391)) - 0.05) < 1e-6


def test_bh_is_never_below_p(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, None, 0.01])], "i int, p double")
    rows = stats.p_adjust(df, "p").collect()
    assert all(r.p_adjusted >= r.p for r in rows if r.p is not None)
    assert next(r.p_adjusted for r in rows if r.i == 0) == 0.025


def test_image_names(spark):
    df = spark.createDataFrame([("P_B03_T0001F002L01A03Z04C02.tif",), ("other.png",)], "file string")
    r = tables.parse_image_names(df).collect()
    assert len(r) == 1 and (r[0].well_id, r[0].field_id, r[0].z_stack_id, r[0].channel_id) == ("B03", "002", "04", "02")


def test_hull_of_the_unit_cube():
    rng = np.random.default_rng(0)
    corners = np.array([[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)], dtype=float)
    v, a = geometry.hull_volume_area(np.vstack([corners, rng.uniform(0.1, 0.9, (200, 3))]))
    assert abs(v - 1) < 1e-9 and abs(a - 6) < 1e-9
    assert geometry.hull_volume_area(corners[:3]) == (0.0, 0.0)
    assert geometry.hull_volume_area(np.c_[corners[:, :2], np.zeros(8)]) == (0.0, 0.0)
    assert geometry.hull_volume_area(np.outer(np.arange(5), [1, 2, 3])) == (0.0, 0.0)


def test_line_and_plane(spark):
    p = points(spark, [(str(i), float(i), 2.0 * i, 0.0, 0) for i in range(5)])
    assert abs(geometry.line_fit_distance(p).first().distance) < 1e-6
    assert geometry.plane_detected(p).first().plane_detected is True


def test_communities_of_two_cliques(spark):
    e = [(a, b, 1.0) for a in range(5) for b in range(a)] + [(a + 10, b + 10, 1.0) for a in range(5) for b in range(a)] + [(0, 10, 0.1)]
    df = spark.createDataFrame(e, "src long, dst long, weight double")
    got = {r.node: r.community for r in graph.label_communities(df).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]
    q = graph.modularity(df, spark.createDataFrame(list(got.items()), "node long, community long")).first().modularity
    assert abs(q - (20 / 20.1 - 2 * 20.1**2 / (4 * 20.1**2))) < 1e-9


def test_nhood_enrichment_is_near_all_permutations(spark):
    """On a ring of 20 nodes moments over all placements are known; 1000 permutations come near in each well."""
    from itertools import combinations

    groups = [0, 1, 0, 1] + [2] * 16
    nodes = [("p", f"w{w}", f"{w}_{i}", g) for w in range(6) for i, g in enumerate(groups)]
    ring = [(i, (i + d) % 20) for i in range(20) for d in (1, -1)]
    n = spark.createDataFrame(nodes, "plate_id string, well_id string, label string, leiden int")
    e = spark.createDataFrame([("p", f"w{w}", f"{w}_{i}", f"{w}_{j}") for w in range(6) for i, j in ring], "plate_id string, well_id string, src string, dst string")
    near = [{(i + 1) % 20, (i - 1) % 20} for i in range(20)]
    counts = np.array([sum(len(near[x] & set(b)) for x in a) for a in combinations(range(20), 2) for b in combinations(sorted(set(range(20)) - set(a)), 2)])
    want = (3 - counts.mean()) / counts.std()
    got = spatial.nhood_enrichment(n, e).where("src_group = 0 and dst_group = 1").collect()
    assert len(got) == 6 and all(r.n == 3 and abs(r.z / want - 1) < 0.12 for r in got)
    a, b = ({(r.well_id, r.src_group, r.dst_group): r.z for r in spatial.nhood_enrichment(n, e, n_perms=7, batch=k).collect()} for k in (3, 7))
    assert a == b
