"""Exact quantiles by ranks, and neighbours by tile against brute force."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from wellspring.operators import aggregates as A
from wellspring.operators import graph, pixels, spatial, tiles
from wellspring.session import durable
from wellspring.sources import fixtures


def test_clipped_stats_hold_no_group_whole(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g in "ab" for v in rng.integers(0, 400, 3000) / 7]
    df = spark.createDataFrame([*rows, ("a", None), ("c", 2.0)], "g string, v double")
    out = A.clipped_stats(df, ["g"], "v")
    plan = out._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan
    got = {r["g"]: r for r in out.collect()}
    assert set(got) == set("abc") and got["c"]["n"] == 1 and got["c"]["p99"] == 2.0
    for g in "ab":
        v = np.array([x for k, x in rows if k == g])
        lo, hi = np.quantile(v, [0.01, 0.99])
        v = v[(v >= lo) & (v <= hi)]
        want = [len(v), v.mean(), np.median(v), v.std(), *np.quantile(v, [0.25, 0.75, 0.01, 0.99])]
        assert [got[g][c] for c in ("n", "mean", "median", "std", "q25", "q75", "p1", "p99")] == pytest.approx(want, rel=1e-12)


def _points(n, side, seed, more=()):
    rng = np.random.default_rng(seed)
    at = np.round(rng.uniform(-side, side, (n, 3)) * [1, 1, 0.2])
    return [("p", f"w{i % 2}", f"n{i}", *map(float, at[i]), int(rng.integers(0, 3)), float(rng.normal())) for i in range(n)] + list(more)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "plate_id string, well_id string, label string, x double, y double, z double, leiden int, f1 double")


def _brute(rows, r):
    """Neighbours of each row, by its place."""
    p = np.array([[np.nan if v is None else v for v in x[3:6]] for x in rows])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    other = np.array([[a[1] == b[1] and a[2] != b[2] for b in rows] for a in rows])
    with np.errstate(invalid="ignore"):
        return d, other & (d <= r)


@pytest.fixture(scope="module")
def cloud(spark):
    """Points over several tiles, a crowd on one spot, points without a place or a value, and an id twice."""
    crowd = [("p", "w0", f"c{i}", 7.0, 7.0, 0.0, i % 3, 1.0) for i in range(90)]
    odd = [("p", "w0", "null", None, 1.0, 1.0, 0, 2.0), ("p", "w1", "far", 9e5, 0.0, 0.0, 1, 3.0), ("p", "w1", "n1", 1.0, 1.0, 1.0, 1, 1.0), ("p", "w0", "bare", 7.0, 8.0, 0.0, 2, None)]
    rows = _points(500, 60, 1, crowd + odd)
    return rows, _frame(spark, rows), *_brute(rows, 5.0)


def test_sums_over_neighbours_by_tile(cloud):
    rows, df, _, hit = cloud
    got = sorted((r["label"], r["degree"], round(r["sum_f1"], 9), r["n_f1"]) for r in tiles.neighbor_sums(df, 5.0, ["f1"]).collect())
    want = []
    for i, r in enumerate(rows):
        f = [rows[j][7] for j in np.flatnonzero(hit[i])]
        f = [v for v in f if v is not None]
        want.append((r[2], int(hit[i].sum()), round(sum(f), 9), len(f)))
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want)]
    assert [c for *_, c, _ in got] == pytest.approx([c for *_, c, _ in sorted(want)], abs=1e-8)


def test_edges_and_nearest_by_tile(cloud):
    rows, df, d, hit = cloud
    got = sorted((r["well_id"], r["src"], r["dst"], r["dist"]) for r in tiles.edges(df, 5.0).collect())
    want = sorted((rows[i][1], rows[i][2], rows[j][2], float(d[i, j])) for i, j in zip(*np.nonzero(hit)))
    assert got == want
    got = sorted((r["well_id"], r["src"], r["dst"]) for r in tiles.nearest(df.where("label <> 'n1'"), None, 2, 5.0).collect())
    best = []
    for i, r in enumerate(rows):
        near = sorted((d[i, j], rows[j][2]) for j in np.flatnonzero(hit[i]) if rows[j][2] != "n1")
        best += [(r[1], r[2], x) for _, x in near[:2] if r[2] != "n1"]
    assert got == sorted(best)


def test_graph_statistics_by_tile_are_those_of_edges(spark, cloud):
    rows, df, _, _ = cloud
    df = df.where("label <> 'n1'")
    e = durable(tiles.edges(df, 5.0))
    e.createOrReplaceTempView("e")

    def same(a, b):
        cols = sorted(a.columns)
        a, b = ([tuple(r[c] for c in cols) for r in x.select(*cols).collect()] for x in (a, b))
        key = lambda r: tuple(str(v) for v in r if not isinstance(v, float))
        a, b = sorted(a, key=key), sorted(b, key=key)
        assert len(a) == len(b) > 0
        for x, y in zip(a, b):
            assert [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)]
            assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)], abs=1e-9)

    for normalized in (False, True):
        same(tiles.interaction_matrix(df, 5.0, normalized=normalized), spatial.interaction_matrix(e, df, normalized=normalized))
    same(tiles.group_degree_centrality(df, 5.0), spatial.group_degree_centrality(df, e))
    same(tiles.degree_stats(df, 5.0, "leiden"), spatial.degree_stats(df, e, "leiden"))
    same(tiles.average_clustering(df, 5.0), spatial.average_clustering(df, e))
    same(tiles.morans_i(df, 5.0, "leiden"), spatial.morans_i(df, e, "leiden"))
    same(tiles.morans_i_groups(df, 5.0), spatial.morans_i_groups(df, e))
    same(tiles.message_passing(df, 5.0, ["f1"]), spatial.message_passing(df, e, ["f1"]))
    node = lambda c: F.concat_ws("|", "plate_id", "well_id", c)
    want = graph.connected_components(e.select(node("src").alias("src"), node("dst").alias("dst")))
    same(tiles.components(df, 5.0).select(node("label").alias("node"), "component"), want)


def test_neighbours_do_not_move_pairs(spark):
    """A crowd makes 40 000 pairs; what the task gives and what moves is rows of points."""
    df = _frame(spark, [("p", "w", f"c{i}", 1.0, 1.0, 1.0, i % 2, 1.0) for i in range(200)])
    for out in (tiles.degree_stats(df, 5.0), tiles.interaction_matrix(df, 5.0), tiles.average_clustering(df, 5.0), tiles.morans_i(df, 5.0, "f1")):
        plan = out._jdf.queryExecution().toString()
        assert "FlatMapGroupsInArrow" in plan and "src, dst" not in plan
    n = {(r["src_group"], r["dst_group"]): r["n"] for r in tiles.interaction_matrix(df, 5.0).collect()}
    assert n == {(0, 0): 9900, (0, 1): 10000, (1, 0): 10000, (1, 1): 9900}
    assert {r["clustering"] for r in tiles.average_clustering(df, 5.0).collect()} == {1.0}


def test_few_keys_do_not_bring_rows_together(spark):
    """Statistics of few keys go to the rows; the rows are not dealt by key."""
    df = spark.range(1000).selectExpr("id", "cast(id % 2 as string) feature", "cast(id as double) v")
    out = A.zscore(df, ["feature"], ["v"], eps=1e-10)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = [r["v"] for r in out.where("feature = '0'").orderBy("id").collect()]
    x = np.arange(0, 1000, 2.0)
    assert got == pytest.approx(((x - x.mean()) / (x.std(ddof=1) + 1e-10)).tolist())


def test_pixels_are_made_by_many_tasks(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(25).select(F.col("id").alias("n_nationkey")).coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    px = fixtures.pixels(spark, str(tmp_path))
    assert px.rdd.getNumPartitions() == 5
    assert px.count() == 500_000
    out = pixels.percentile_rescale(px.select("ch", "img", "y", "x", "v"), ["ch"], 0.01, 0.0, 1.0, few=True)
    assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()


def _by(df, *names):
    return {tuple(r[n] for n in names): r for r in df.collect()}


def test_closeness_asks_tiles_and_stores_no_edges(spark, cloud, monkeypatch):
    """Hops over several tiles, groups out of reach, more groups than a word has bits, and points without a group."""
    rows, df, _, _ = cloud
    df = df.where("label <> 'n1'")
    chain = spark.createDataFrame([("p", "chain", f"a{i}", i / 4, 0.0, 0.0, i // 2, 1.0) for i in range(140)], df.schema)
    df = df.unionByName(chain)
    e = durable(tiles.edges(df, 5.0))
    want = _by(spatial.group_closeness(df, e), "plate_id", "well_id", "leiden")
    monkeypatch.setattr(tiles, "edges", None)
    got = _by(tiles.group_closeness(df, 5.0), "plate_id", "well_id", "leiden")
    assert set(got) == set(want) and len(got) > 70
    for k, r in want.items():
        assert got[k]["closeness"] == (pytest.approx(r["closeness"]) if r["closeness"] is not None else None)
    more = df.where("well_id = 'chain' and leiden < 2").unionByName(spark.createDataFrame([("p", "chain", "none", 4.0, 2.0, 0.0, None, 1.0)], df.schema))
    bare = _by(tiles.group_closeness(more, 5.0), "leiden")
    assert set(bare) == {(0,), (1,)} and {r["closeness"] for r in bare.values()} == {1.0}


def test_nearest_looks_outwards_in_a_crowd(spark):
    """Among 20 000 points a block meets few of those within the radius, and ties go to the smaller id all the same."""
    rng = np.random.default_rng(3)
    at = np.round(rng.uniform(0, 100, (20000, 2)))
    kind = "w string, label string, x double, y double"
    df = spark.createDataFrame([("w", f"n{i:05d}", *map(float, p)) for i, p in enumerate(at)], kind)
    some = rng.choice(20000, 60, replace=False)
    got = {(r["src"], r["rank"]): (r["dst"], r["dist"]) for r in tiles.nearest(df, None, 3, 40.0, ("x", "y"), ("w",)).where(F.col("src").isin([f"n{i:05d}" for i in some])).collect()}
    for i in some:
        d = np.sqrt(((at - at[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        for rank, j in enumerate(np.lexsort((np.arange(len(d)), d))[:3], 1):
            assert got[f"n{i:05d}", rank] == (f"n{j:05d}", d[j])
    def count_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, tile = [0], tiles.Tile(batches, 40.0, 2)
        meet = tile.meet

        def counted(rows, near):
            met[0] += len(rows) * len(near)
            return meet(rows, near)

        tile.meet = counted
        list(tile.nearest(3))
        yield pa.RecordBatch.from_arrays([pa.array(met)], names=["n"])

    dealt = tiles._dealt(df, None, 40.0, ("x", "y"), ["w"], "label", ids=True)
    met = dealt.applyInArrow(count_meetings, "n long").agg(F.sum("n")).first()[0]
    assert met < 20000 * 1500


def test_links_are_summed_where_they_are_found(cloud):
    rows, df, _, _ = cloud
    other = df.where("label like 'c%'").withColumn("x", F.col("x") + 1.5)
    want = _by(tiles.nearest(df, other, 1, 5.0, strict=True), "plate_id", "well_id", "src", "dst")
    got = tiles.linked(df, other, 5.0, ["leiden"])
    assert got.count() == len([r for r in rows if r[3] is not None])
    met = got.where("to is not null").collect()
    assert {(r["plate_id"], r["well_id"], r["label"], r["to"]) for r in met} == set(want)
    assert all(r["to_x"] == 8.5 for r in met if r["to"].startswith("c"))
    place = {r[2]: r[3:6] for r in rows}
    (sums,) = tiles.link_sums(df, other, 5.0).collect()
    s = np.array([place[r["label"]] for r in met])
    t = np.array([[r["to_x"], r["to_y"], r["to_z"]] for r in met])
    assert sums["n"] == len(met) and sums["sums"] == pytest.approx([*s.sum(axis=0), *t.sum(axis=0), *(s.T @ t).ravel()])


def test_crowded_points_and_their_components_meet_few(cloud, monkeypatch):
    """Full cells tell of their points; the others are counted, over borders of tiles too."""
    rows, df, _, hit = cloud
    want = [r[2] for r, n in zip(rows, hit.sum(axis=1)) if n >= 3]
    whole = tiles.crowded(df, 5.0, 3)
    assert whole.columns == df.columns and sorted(r["label"] for r in whole.collect()) == sorted(want)
    met, meet = [], tiles.Tile.meet
    monkeypatch.setattr(tiles.Tile, "meet", lambda self, rows, near: met.append(len(rows) * len(near)) or meet(self, rows, near))
    crowd = [("p", f"c{i:04d}", *map(float, p)) for i, p in enumerate(np.random.default_rng(2).uniform(0, 60, (3000, 3)))]
    tile = pa.table({"w": [c[0] for c in crowd], "id": [c[1] for c in crowd], "same": range(3000), "tiles": [1] * 3000, "is_src": [True] * 3000, "is_dst": [True] * 3000} | {f"v{i}": [c[2 + i] for c in crowd] for i in range(3)})
    monkeypatch.setattr(tiles, "_run", lambda dealt, like, extra, work, *more: (_ for _ in ()).throw(_Caught(work)))
    with pytest.raises(_Caught) as caught:
        tiles.components(df.selectExpr("well_id w", "label", "x", "y", "z"), 30.0, key=("w",))
    kind = pa.schema([("w", pa.string()), ("id", pa.string()), ("root", pa.string()), ("own", pa.bool_()), ("shared", pa.bool_())])
    out = pa.Table.from_batches(caught.value.work(tiles.Tile(tile.to_batches(), 30.0, 3), kind))
    assert out.num_rows == 3000 and set(out.column("root").to_pylist()) == {"c0000"} and sum(met) < 3000 * 300


class _Caught(Exception):
    def __init__(self, work):
        self.work = work


def test_hashes_are_those_of_spark(spark):
    from wellspring.operators import permutations

    texts = ["", "a", "abcd", "abcdefg", "abcdefgh", "123_4_567_89", "x" * 31, "y" * 32, "z" * 45, "\u00e9" * 20, None]
    df = spark.createDataFrame([(t, i - 3, (i - 3) * 10**12) for i, t in enumerate(texts)], "t string, i int, l long")
    rows = df.select("*", *[F.xxhash64(F.lit(7), F.lit(12), c).alias(f"h{c}") for c in "til"]).toArrow()
    start = permutations._number(12, permutations._number(7, 42))
    for c in "til":
        assert permutations.Hasher(rows.column(c).combine_chunks())(start).tolist() == rows.column(f"h{c}").to_pylist()


def test_enrichment_by_tile_is_that_of_edges(spark, cloud):
    _, df, _, _ = cloud
    df = df.where("label <> 'n1'").withColumn("leiden", F.when(F.col("label") != "n7", F.col("leiden")))
    e = durable(tiles.edges(df, 5.0))
    got = _by(spatial.nhood_enrichment_within(df, (3.0, 5.0), n_perms=30, batch=20), "k", "well_id", "src_group", "dst_group")
    for k, r in ((1, 3.0), (2, 5.0)):
        want = _by(spatial.nhood_enrichment(df, e.where(F.col("dist") <= r), n_perms=30), "well_id", "src_group", "dst_group")
        assert len(want) > 18
        for pair, x in want.items():
            assert (got[k, *pair]["n"], got[k, *pair]["z"]) == (x["n"], pytest.approx(x["z"]) if x["z"] is not None else None)
