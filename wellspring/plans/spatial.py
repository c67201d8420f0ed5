"""Queries over the spatial graph of nuclei: joins, graph statistics, message passing."""

from pyspark.sql import functions as F

from ..operators import joins, spatial, tiles
from ..sources.fixtures import nuclei
from .registry import add

KS = "plate_id, well_id"


#: The radius that most queries ask for.
RADIUS = 25.0


def _angles(e):
    return e.select("plate_id", "well_id", "src", "dst", spatial.edge_angle().alias("angle"))


def _near(fn, *more):
    """fn of the nuclei and RADIUS, which asks for neighbours tile by tile and stores no edges."""
    return lambda s, d: fn(nuclei(s, d), RADIUS, *more)


add("j8_radius_join", _near(tiles.edges), f"select {KS}, src, dst, dist from edges", "binned", "dist")
add(
    "j8_radius_join_2d",
    lambda s, d: tiles.edges(nuclei(s, d), 10.0, cols=("x", "y"), key=("plate_id", "well_id", "z_slice")),
    "select a.plate_id, a.well_id, a.z_slice, a.label src, b.label dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) dist from nuclei a "
    "join nuclei b on a.plate_id = b.plate_id and a.well_id = b.well_id and a.z_slice = b.z_slice and a.label <> b.label "
    "and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 100",
    "nuclei", "dist",
)
add(
    "w14_neighbor_count",
    lambda s, d: tiles.degree(nuclei(s, d), 10.0, ("x", "y"), ("plate_id", "well_id", "z_slice")),
    "select a.plate_id, a.well_id, a.z_slice, a.label, count(b.label) as degree from nuclei a left join nuclei b on a.plate_id = b.plate_id "
    "and a.well_id = b.well_id and a.z_slice = b.z_slice and a.label <> b.label and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 100 group by all",
    "nuclei",
)
add(
    "j9_knn_join",
    lambda s, d: joins.knn_points(nuclei(s, d), 3, RADIUS),
    "select * from (select a.plate_id, a.well_id, a.label src, b.label dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) dist, "
    "row_number() over (partition by a.plate_id, a.well_id, a.label order by sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), b.label)::int rank "
    "from nuclei a join nuclei b on a.plate_id = b.plate_id and a.well_id = b.well_id and a.label <> b.label) where rank <= 3",
    "nuclei", "dist",
)
add(
    "j10_nearest_link",
    lambda s, d: joins.nearest_link(nuclei(s, d).where("plate_id = '004'"), nuclei(s, d).where("plate_id = '005'"), 40.0),
    """select distinct well_id, source, target, dist from (
     select a.well_id, a.label source, b.label target, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) dist,
       case when ns <= nt then a.label else b.label end me, case when ns <= nt then b.label else a.label end other,
       row_number() over (partition by a.well_id, case when ns <= nt then a.label else b.label end
         order by sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), case when ns <= nt then b.label else a.label end) r
     from nuclei a join nuclei b on a.well_id = b.well_id and a.plate_id = '004' and b.plate_id = '005'
       and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) < 1600
     join (select well_id, count(*) filter (plate_id = '004') ns, count(*) filter (plate_id = '005') nt from nuclei group by 1) c on c.well_id = a.well_id)
     where r = 1""",
    "nuclei", "dist",
)
add(
    "g1_degree",
    _near(tiles.degree),
    "select n.plate_id, n.well_id, n.label, count(e.dst) as degree from nuclei n left join edges e on e.plate_id = n.plate_id and e.well_id = n.well_id and e.src = n.label group by all",
    "binned",
)
_deg = "(select n.plate_id, n.well_id, n.label, n.leiden, count(e.dst) as degree from nuclei n left join edges e on e.plate_id = n.plate_id and e.well_id = n.well_id and e.src = n.label group by all)"
add("g1_degree_stats", _near(tiles.degree_stats), f"select {KS}, avg(degree) mean_degree, stddev_pop(degree) std_degree from {_deg} group by all", "binned", "mean_degree std_degree")
add(
    "g1_degree_by_cluster",
    _near(tiles.degree_stats, "leiden"),
    f"select {KS}, leiden, avg(degree) mean_degree, stddev_pop(degree) std_degree from {_deg} group by all",
    "binned", "mean_degree std_degree",
)
add(
    "g2_message_passing",
    _near(tiles.message_passing, ["f1", "f2"]),
    f"select {KS}, label, avg(f1) f1_msg, avg(f2) f2_msg from (select {KS}, label, f1, f2 from nuclei union all "
    f"select e.plate_id, e.well_id, e.src, n.f1, n.f2 from edges e join nuclei n on n.plate_id = e.plate_id and n.well_id = e.well_id and n.label = e.dst) group by all",
    "binned", "f1_msg f2_msg",
)
add("g8_interaction_matrix", _near(tiles.interaction_matrix), f"select {KS}, src_cl src_group, dst_cl dst_group, count(*) n from edges group by all", "binned")
add(
    "g8_interaction_normalized",
    _near(tiles.interaction_matrix, "leiden", True),
    f"select *, n / sum(n) over (partition by {KS}, src_group) share from (select {KS}, src_cl src_group, dst_cl dst_group, count(*) n from edges group by all)",
    "binned", "share",
)
add(
    "g9_group_degree_centrality",
    _near(tiles.group_degree_centrality),
    f"""select s.plate_id, s.well_id, s.leiden, case when total - s.n > 0 then coalesce(t, 0) / (total - s.n) end centrality
     from (select *, sum(n) over (partition by {KS}) total from (select {KS}, leiden, count(*) n from nuclei group by {KS}, leiden)) s
     left join (select {KS}, src_cl, count(distinct dst) t from edges where src_cl <> dst_cl group by all) e
     on e.plate_id = s.plate_id and e.well_id = s.well_id and e.src_cl = s.leiden""",
    "binned", "centrality",
)
add(
    "g10_average_clustering",
    _near(tiles.average_clustering),
    f"""select n.plate_id, n.well_id, n.leiden, avg(case when d.degree > 1 then 2.0 * coalesce(t, 0) / (d.degree * (d.degree - 1)) else 0.0 end) clustering
     from nuclei n join {_deg} d on d.plate_id = n.plate_id and d.well_id = n.well_id and d.label = n.label
     left join (select a.plate_id, a.well_id, a.src, count(*) t from edges a join edges b on a.plate_id = b.plate_id and a.well_id = b.well_id and a.src = b.src and a.dst < b.dst
       join edges c on c.plate_id = a.plate_id and c.well_id = a.well_id and c.src = a.dst and c.dst = b.dst group by all) t
     on t.plate_id = n.plate_id and t.well_id = n.well_id and t.src = n.label group by all""",
    "binned", "clustering",
)
add("g11_group_closeness", _near(tiles.group_closeness), doubles="closeness")
add("g12_nhood_enrichment", lambda s, d: spatial.nhood_enrichment_within(nuclei(s, d), (RADIUS,)).drop("k"), doubles="z")
_moran = """select n.plate_id, n.well_id, case when ss > 0 and w is not null then n / w * num / ss else 0.0 end moran_i from
   (select plate_id, well_id, count(*) n, var_pop(F) * count(*) ss from nuclei group by all) n left join
   (select l.plate_id, l.well_id, sum((a.F - m.mean) * (l.lag - m.mean)) num, count(*) w from
     (select e.plate_id, e.well_id, e.src, avg(b.F) lag from edges e join nuclei b on b.plate_id = e.plate_id and b.well_id = e.well_id and b.label = e.dst group by all) l
     join nuclei a on a.plate_id = l.plate_id and a.well_id = l.well_id and a.label = l.src
     join (select plate_id, well_id, avg(F) mean from nuclei group by all) m on m.plate_id = l.plate_id and m.well_id = l.well_id group by all) s
   on s.plate_id = n.plate_id and s.well_id = n.well_id"""
add("g13_morans_i", _near(tiles.morans_i, "f1"), _moran.replace("F", "f1"), "binned", "moran_i")
add(
    "g14_morans_i_cluster",
    lambda s, d: tiles.morans_i(nuclei(s, d).withColumn("is2", (F.col("leiden") == 2).cast("double")), RADIUS, "is2"),
    _moran.replace("a.F", "a.is2").replace("b.F", "b.is2").replace("F", "is2").replace("nuclei", "(select *, (leiden = 2)::int::double is2 from nuclei)"),
    "binned", "moran_i",
)
add(
    "g16_edge_angle",
    lambda s, d: _angles(tiles.edges(nuclei(s, d), RADIUS, shared=("x", "y"))),
    "select e.plate_id, e.well_id, e.src, e.dst, degrees(atan2(b.y - a.y, b.x - a.x)) angle from edges e "
    "join nuclei a on a.plate_id = e.plate_id and a.well_id = e.well_id and a.label = e.src join nuclei b on b.plate_id = e.plate_id and b.well_id = e.well_id and b.label = e.dst",
    "binned", "angle",
)
_msg = f"(select {KS}, label, avg(f1) f1_msg, avg(f2) f2_msg from (select {KS}, label, f1, f2 from nuclei union all select e.plate_id, e.well_id, e.src, n.f1, n.f2 from edges e join nuclei n on n.plate_id = e.plate_id and n.well_id = e.well_id and n.label = e.dst) group by all)"
for _name, _metric, _sql in (
    ("e24_kernel_distance", "euclidean", "sqrt((f1 - f1_msg) * (f1 - f1_msg) + (f2 - f2_msg) * (f2 - f2_msg))"),
    ("e24_kernel_cosine", "cosine", "1 - (f1 * f1_msg + f2 * f2_msg) / (sqrt(f1 * f1 + f2 * f2) * sqrt(f1_msg * f1_msg + f2_msg * f2_msg))"),
):
    add(
        _name,
        _near(lambda n, r, m=_metric: spatial.vector_distance(tiles.message_passing(n, r, ["f1", "f2"], carry=True), ["f1", "f2"], m)),
        f"select n.plate_id, n.well_id, n.label, {_sql} distance from nuclei n join {_msg} m on m.plate_id = n.plate_id and m.well_id = n.well_id and m.label = n.label",
        "binned", "distance",
    )


def _components(spark, d):
    return tiles.components(nuclei(spark, d), RADIUS).select(F.concat_ws("|", "plate_id", "well_id", "label").alias("node"), "component")


add("g4_connected_components", _components,
    """select node, min(other) component from (
      with recursive reach(node, other) as (
        select distinct concat_ws('|', plate_id, well_id, src), concat_ws('|', plate_id, well_id, src) from edges
        union select r.node, concat_ws('|', e.plate_id, e.well_id, e.dst) from reach r join edges e on concat_ws('|', e.plate_id, e.well_id, e.src) = r.other)
      select * from reach) group by node""", "binned")  # fmt: skip
