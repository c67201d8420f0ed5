"""Scores of a latent space, neighbours and communities against plain computations on small fixtures."""

import math

import pytest

from wellspring.operators import aggregates as A
from wellspring.operators import benchmark as B
from wellspring.operators import communities, graph, joins
from wellspring.operators import pixels as P
from wellspring.operators import stats


def test_adjusted_mutual_information_of_equal_and_crossed_clusters(spark):
    same = spark.createDataFrame([(i, i % 3, (i % 3) + 5) for i in range(30)], "id int, a int, b int")
    assert B.adjusted_mutual_information(same, "a", "b").first()[0] == pytest.approx(1.0)
    crossed = spark.createDataFrame([(i % 2, (i // 2) % 2) for i in range(8)], "a int, b int")
    # sizes 4 and 4 of 8: n_ij has hypergeometric weights 1, 16, 36, 16, 1 of 70
    expected = 4 * sum(p / 70 * n / 8 * math.log(8 * n / 16) for n, p in ((1, 16), (2, 36), (3, 16), (4, 1)))
    want = (0 - expected) / (math.log(2) - expected)
    assert B.adjusted_mutual_information(crossed, "a", "b").first()[0] == pytest.approx(want)


def test_fuzzy_connectivities_are_symmetric_and_bounded(spark):
    knn = spark.createDataFrame([(i, (i + j) % 9, float(j)) for i in range(9) for j in (1, 2, 3)], "src long, dst long, dist double")
    w = {(r["src"], r["dst"]): r["weight"] for r in B.fuzzy_connectivities(knn).collect()}
    assert len(w) == 54 and all(0 < v <= 1 for v in w.values())
    assert all(w[a, b] == pytest.approx(w[b, a]) for a, b in w)


def test_knn_join_has_three_neighbours_of_every_point(spark):
    from wellspring.plans import registry

    out = registry.QUERIES["j9_knn_join"](spark, "/root/testdata/sf0.001").groupBy("plate_id", "well_id", "src").count()
    assert {r["count"] for r in out.select("count").distinct().collect()} == {3} and out.count() > 5000


def test_knn_points_look_farther_where_points_are_few(spark):
    xs = [0.0, 1.0, 2.0, 50.0, 900.0]
    rows = [("p", "w", str(i), x, 0.0, 0.0) for i, x in enumerate(xs)] + [("p", "alone", "a", 0.0, 0.0, 0.0), ("p", "w", "null", None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "plate_id string, well_id string, label string, x double, y double, z double")
    got = {(r["src"], r["rank"]): r["dst"] for r in joins.knn_points(points, 2, 3.0).collect()}
    want = {}
    for i, x in enumerate(xs):
        near = sorted((abs(x - y), str(j)) for j, y in enumerate(xs) if j != i)
        want |= {(str(i), r + 1): near[r][1] for r in range(2)}
    assert got == want
    few = joins.knn_points(points.where("well_id = 'w' and x < 2"), 5, 3.0)
    assert sorted((r["src"], r["dst"]) for r in few.collect()) == [("0", "1"), ("1", "0")]
    assert joins.knn_points(points.limit(0), 2, 3.0).count() == 0


def test_average_ranks_over_many_partitions(spark):
    values = [(k, float(v)) for k in "ab" for v in (3, 1, 2, 2, 2, 9, 9, 4)] + [("a", None)]
    got = {(r["k"], r["v"]): (r["r"], r["t"]) for r in A.average_ranks(spark.createDataFrame(values, "k string, v double"), ["k"], "v").collect()}
    assert got == {(k, v): x for k in "ab" for v, x in {1.0: (1.0, 1), 2.0: (3.0, 3), 3.0: (5.0, 1), 4.0: (6.0, 1), 9.0: (7.5, 2)}.items()}


def test_compound_order_counts_groups_that_one_side_lacks(spark):
    shares = spark.createDataFrame([("c", 1, 1.0), ("x", 2, 1.0), ("y", 1, 0.5), ("y", 2, 0.5)], "compound string, g int, v double")
    got = {r["compound"]: r["distance"] for r in stats.compound_order(shares, "compound", "g", "v", "c").collect()}
    assert got == pytest.approx({"c": 0.0, "x": math.sqrt(2), "y": math.sqrt(0.5)})


def test_edge_path_profile_reads_zero_outside(spark):
    px = spark.createDataFrame([(0, y, x, x) for y in range(9) for x in range(9)], "img int, y int, x int, v int")
    e = spark.createDataFrame([(0, 1, 2, 4, 2, 4, 6)], "img int, src int, dst int, y0 int, x0 int, y1 int, x1 int")
    got = {r["step"]: r["intensity"] for r in P.edge_path_profile(e, px, ["img"], 2).collect()}
    assert got == pytest.approx({0: 2.0, 1: 3.0, 2: 4.0, 3: 5.0})
    wide = {r["step"]: r["intensity"] for r in P.edge_path_profile(e, px, ["img"], 9).collect()}
    assert wide[0] == pytest.approx(2.0 * 9 / 18)


def test_louvain_parts_two_cliques_and_resolution_splits_them(spark):
    pairs = [(a + o, b + o, 1.0) for o in (0, 10) for a in range(5) for b in range(a + 1, 5)] + [(0, 10, 1.0)]
    edges = spark.createDataFrame(pairs, "src long, dst long, weight double")
    part = {r["node"]: r["community"] for r in communities.louvain_communities(edges).collect()}
    assert len(part) == 10 and len(set(part.values())) == 2
    assert all(part[a] == part[0] for a in range(5)) and all(part[a] == part[10] for a in range(10, 15))
    assert graph.modularity(edges, spark.createDataFrame(list(part.items()), "node long, community long")).first()[0] > 0.4
    fine = {r["community"] for r in communities.louvain_communities(edges, resolution=20.0).collect()}
    assert len(fine) > 2
    whole = B.community_silhouette(spark.createDataFrame([(n, [float(c), float(n % 2) / 9]) for n, c in part.items()], "id long, v array<double>"), "id", "v", edges, (1.0,))
    assert whole.first()[0] > 0.9


def test_samples_are_scored_alone_and_small_ones_have_nulls(spark):
    import random

    from wellspring.operators import embedding as E

    rng = random.Random(3)
    rows = [(i, i % 2 if i < 80 else 5, [rng.random() for _ in range(2)], [rng.random() + (i % 3) for _ in range(3)], i % 3, i // 40) for i in range(82)]
    df = spark.createDataFrame(rows, "id long, s int, pos array<double>, lat array<double>, label int, batch int")
    got = {(r["sample"], r["metric"]): r["value"] for r in B.benchmark_samples(df, "s", "id", "pos", "lat", "label", "batch", 5, 30, 3.0).collect()}
    assert len(got) == 3 * 8 and all(got["5", m] is None for m in ("gcs", "avg_gcs", "basw"))
    one = df.where("s = 1")
    near = {c: E.vector_knn(one, one, 5, "id", c) for c in ("pos", "lat")}
    gcs = {r["k"]: r["gcs"] for r in B.graph_similarities(near["lat"], near["pos"], 5, 40).collect()}
    assert got["1", "gcs"] == pytest.approx(gcs[5]) and got["1", "avg_gcs"] == pytest.approx(sum(gcs.values()) / 5)
    assert got["1", "casw"] == pytest.approx(B.label_silhouette(one, "id", "lat", "label").first()[0])
    assert 0 < got["1", "avg_cas"] <= 1 and got["0", "clisi"] is not None


def test_edges_over_tiles_read_the_same_pixels_as_one_by_one(spark):
    import random

    rng = random.Random(4)
    value = {(y, x): rng.randrange(100) for y in range(-10, 150) for x in range(-10, 90) if rng.random() < 0.9}
    px = spark.createDataFrame([(0, y, x, v) for (y, x), v in value.items()], "img int, y int, x int, v int")
    ends = [(i, 500 + i, rng.randrange(-12, 152), rng.randrange(-12, 92), rng.randrange(-12, 152), rng.randrange(-12, 92)) for i in range(12)]
    e = spark.createDataFrame([(0, *r) for r in ends], "img int, src int, dst int, y0 int, x0 int, y1 int, x1 int")
    profile = P.edge_path_profile(e, px, ["img"], 3)
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan  # points of edges are not rows of a join
    got = {(r["src"], r["step"]): r["intensity"] for r in profile.collect()}
    want = {}
    for src, _, y0, x0, y1, x1 in ends:
        n = math.sqrt((y1 - y0) ** 2 + (x1 - x0) ** 2)
        dy, dx = ((y1 - y0) / n, (x1 - x0) / n) if n else (0, 0)
        for t in range(math.floor(n)):
            spots = [(math.floor(y0 + t * dy + s * dx + 0.5), math.floor(x0 + t * dx - s * dy + 0.5)) for s in range(-3, 3)]
            want[src, t] = sum(value.get(p, 0) for p in spots) / 6
    assert got == pytest.approx(want)
