"""Queries that score a latent space, and those on paths between objects, patches and layouts."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import benchmark as B
from ..operators import embedding as E
from ..operators import joins, mixing, spatial, tiles
from ..operators import pixels as P
from ..sources import tables as S
from ..sources.fixtures import nuclei, pixels, table
from .registry import add
from .tables import N, W

MAX_K = 14


def vectors(s, d):
    """Embeddings with three components as positions and the others as the latent vector; batch is the label modulo 3."""
    v = table(s, d, "embeddings")
    return v.select("vec_id", "label", (F.col("vec_id") % 3).alias("batch"), F.slice("embedding", 1, 3).alias("pos"), F.slice("embedding", 4, 1000).alias("latent"))


V = """v as (select vec_id, label, vec_id % 3 batch, embedding[1:3]::double[] pos, embedding[4:]::double[] latent from embeddings),
 kp as (select * from (select a.vec_id src, b.vec_id dst, row_number() over (partition by a.vec_id order by round(list_distance(a.pos, b.pos), 12), b.vec_id) rank from v a join v b on a.vec_id <> b.vec_id) where rank <= 14),
 kl as (select * from (select a.vec_id src, b.vec_id dst, row_number() over (partition by a.vec_id order by round(list_distance(a.latent, b.latent), 12), b.vec_id) rank from v a join v b on a.vec_id <> b.vec_id) where rank <= 14)"""
_gcs = f"""with {V}, k as (select unnest(range(1, 15)) k), j as (select coalesce(a.rank, 15) ra, coalesce(b.rank, 15) rb from kp a full join kl b on a.src = b.src and a.dst = b.dst),
 g as (select k, 1 - sum(((ra <= k) <> (rb <= k))::int) / (2.0::double * k * (select count(*) from v)) gcs from k, j group by k)"""


def _knn(s, d, column, k=MAX_K):
    v = vectors(s, d)
    return E.vector_knn(v, v, k, "vec_id", column)


def _gcs_table(s, d):
    return B.graph_similarities(_knn(s, d, "pos"), _knn(s, d, "latent"), MAX_K, vectors(s, d).count())


add("m1_gcs_by_k", _gcs_table, f"{_gcs} select k, gcs from g", "", "gcs")
add("m2_avg_gcs", lambda s, d: _gcs_table(s, d).agg(F.avg("gcs").alias("avg_gcs")), f"{_gcs} select avg(gcs) avg_gcs from g", "", "avg_gcs")


def _enrichment(s, d, column, k, n_perms):
    v = vectors(s, d).withColumn("batch", F.lit(0))
    edges = _knn(s, d, column, k).select(F.lit(0).alias("batch"), "src", "dst")
    return spatial.nhood_enrichment(v, edges, "label", n_perms, key=("batch",), id_col="vec_id").select("src_group", "dst_group", "z")


add("m3_cas", lambda s, d: B.enrichment_similarity(_enrichment(s, d, "latent", 15, 1000), _enrichment(s, d, "pos", 15, 1000)), doubles="cas")


def _nested(s, d, column):
    v = vectors(s, d).withColumn("batch", F.lit(0))
    edges = _knn(s, d, column).select(F.lit(0).alias("batch"), "src", "dst", "rank")
    return spatial.nhood_enrichment(v, edges, "label", 1000, key=("batch",), id_col="vec_id", nested=MAX_K)


add("m4_avg_cas", lambda s, d: B.mean_enrichment_similarity(_nested(s, d, "latent"), _nested(s, d, "pos")), doubles="avg_cas")
add("m7_ami", N(lambda n: B.adjusted_mutual_information(n, "leiden", "z_slice")), doubles="ami", digits=8)
add("m11_kmeans_agreement", lambda s, d: B.kmeans_agreement(vectors(s, d), "latent", "label", 10), doubles="nmi ari")
_dist = "select a.vec_id, a.label al, a.batch ab, b.vec_id other, b.label bl, b.batch bb, power(list_distance(a.latent, b.latent), 2) d from v a join v b on a.vec_id <> b.vec_id"
_sil = "(select vec_id, any_value(own) own, coalesce(max(m) filter (mine), -1) a, min(m) filter (not mine) b, any_value(grp) grp from (select vec_id, {own} own, {other} = {own} mine, avg(d) m, any_value(al) grp from d {where} group by vec_id, {own}, {other}) group by vec_id)"
_s = "case when a < 0 or b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end"
add("m12_silhouette", lambda s, d: B.silhouettes(vectors(s, d), "vec_id", "latent", "label"),
    f"with {V}, d as ({_dist}) select v.vec_id, v.label, coalesce({_s}, 0) silhouette from v left join {_sil.format(own='al', other='bl', where='')} x using (vec_id)", "", "silhouette", 5)
add("m12_casw", lambda s, d: B.label_silhouette(vectors(s, d), "vec_id", "latent", "label"),
    f"with {V}, d as ({_dist}) select (avg(coalesce({_s}, 0)) + 1) / 2 casw from v left join {_sil.format(own='al', other='bl', where='')} x using (vec_id)", "", "casw", 5)
add("m12_basw", lambda s, d: B.batch_silhouette(vectors(s, d), "vec_id", "latent", "label", "batch"),
    f"with {V}, d as ({_dist}) select avg(m) basw from (select v.label, avg(1 - abs(coalesce({_s}, 0))) m, count(distinct v.batch) n from v left join {_sil.format(own='ab', other='bb', where='where al = bl')} x using (vec_id) group by v.label) where n > 1", "", "basw", 5)


def _lisi(s, d, column, integration):
    lisi = mixing.lisi(_knn(s, d, "latent", 90), vectors(s, d), "vec_id", column, 30.0)
    return B.rescaled_lisi(lisi, vectors(s, d).select(column).distinct().count(), integration)


add("m13_clisi", lambda s, d: _lisi(s, d, "label", False), doubles="score", digits=4)
add("m13_blisi", lambda s, d: _lisi(s, d, "batch", True), doubles="score", digits=4)
_ve = "(select sum(b) / (sum(b) + sum(w)) r from (select i, sum(n * (m - gm) * (m - gm)) b, sum(ss) w from (select *, sum(n * m) over (partition by i) / sum(n) over (partition by i) gm from (select i, batch, count(*) n, avg(x) m, var_pop(x) * count(*) ss from (select batch, unnest({c}) x, unnest(range(len({c}))) i from v) group by all)) group by i))"
add("m15_pcr", lambda s, d: B.pc_regression(vectors(s, d), "pos", "latent", "batch"),
    f"with {V} select greatest((a.r - b.r) / a.r, 0) pcr from {_ve.format(c='pos')} a, {_ve.format(c='latent')} b", "", "pcr", 5)


add("m16_benchmark_samples", lambda s, d: B.benchmark_samples(vectors(s, d).withColumn("sample", F.col("vec_id") % 4), "sample", "vec_id", "pos", "latent", "label", "batch"), doubles="value", digits=4)
add("e9_fuzzy_connectivities", lambda s, d: B.fuzzy_connectivities(_knn(s, d, "latent", 15)), doubles="weight", digits=5)

# Correlation of latent dimensions with a feature, and with an orientation
_dims = "d as (select vec_id, label, unnest(range(len(latent))) dim, unnest(latent) x, sin(2 * radians(vec_id % 180)) sn, cos(2 * radians(vec_id % 180)) cs from v)"
_rank = "rank() over (partition by dim order by {c}) + (count(*) over (partition by dim, {c}) - 1) / 2.0::double"


def _dimensions(s, d):
    theta = 2 * F.radians(F.col("vec_id") % 180)
    return vectors(s, d).select("vec_id", "label", F.round(F.sin(theta), 9).alias("sn"), F.round(F.cos(theta), 9).alias("cs"), F.posexplode("latent").alias("dim", "x"))


add("e25_spearman", lambda s, d: A.spearman(_dimensions(s, d), ["dim"], "x", "label"),
    f"with {V}, {_dims}, r as (select dim, {_rank.format(c='x')} a, {_rank.format(c='label')} b from d) select dim::int dim, corr(a, b) r from r group by dim", "", "r")


def _orientation(s, d):
    x = _dimensions(s, d)
    j = A.spearman(x, ["dim"], "x", "sn").withColumnRenamed("r", "rs").join(A.spearman(x, ["dim"], "x", "cs").withColumnRenamed("r", "rc"), "dim")
    return j.select("dim", F.sqrt(F.col("rs") * F.col("rs") + F.col("rc") * F.col("rc")).alias("r"))


add("e25_orientation", _orientation,
    f"with {V}, {_dims}, e as (select vec_id, dim, x, round(sn, 9) sn, round(cs, 9) cs from d), r as (select dim, {_rank.format(c='x')} a, {_rank.format(c='sn')} b, {_rank.format(c='cs')} c from e) select dim::int dim, sqrt(power(corr(a, b), 2) + power(corr(a, c), 2)) r from r group by dim", "", "r")

# Neighbours, paths, patches, layouts
add("j9_knn_points", lambda s, d: joins.knn_points(nuclei(s, d), 3, 25.0),
    "select * from (select a.plate_id, a.well_id, a.label src, b.label dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) dist, row_number() over (partition by a.plate_id, a.well_id, a.label order by sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), b.label)::int rank from nuclei a join nuclei b on a.plate_id = b.plate_id and a.well_id = b.well_id and a.label <> b.label) where rank <= 3", "nuclei", "dist")


def _paths(s, d):
    px = pixels(s, d)
    at = P.positions(px, ["img"]).withColumn("label", F.col("label").cast("long"))
    e = tiles.edges(at, 12.0, ("x", "y"), ("img",), shared=("y", "x"))
    e = e.select("img", "src", "dst", *[F.col(f"{end}_{c}").alias(f"{c}{i}") for i, end in enumerate(("src", "dst")) for c in ("y", "x")])
    return P.edge_path_profile(e, px, ["img"])


_path = """spots as (select img, label, round_even(avg(y), 0)::int y, round_even(avg(x), 0)::int x from pixels where label > 0 group by all),
 e as (select a.img, a.label src, b.label dst, a.y y0, a.x x0, sqrt((b.y-a.y)*(b.y-a.y)+(b.x-a.x)*(b.x-a.x)) l, (b.y-a.y)/l dy, (b.x-a.x)/l dx from spots a join spots b on a.img = b.img and a.label <> b.label and (b.y-a.y)*(b.y-a.y)+(b.x-a.x)*(b.x-a.x) <= 144 and (b.y-a.y)*(b.y-a.y)+(b.x-a.x)*(b.x-a.x) >= 1),
 t as (select *, unnest(range(0, floor(l)::bigint)) step from e), u as (select *, unnest(range(-4, 4)) s from t),
 w as (select img, src, dst, step, floor(y0 + step * dy + s * dx + 0.5)::int y, floor(x0 + step * dx - s * dy + 0.5)::int x from u),
 profile as (select w.img, src::bigint src, dst::bigint dst, step::int step, avg(coalesce(v, 0)) intensity from w left join pixels p on p.img = w.img and p.y = w.y and p.x = w.x group by all)"""
add("p24_edge_path_profile", _paths, f"with {_path} select img, src, dst, step, intensity from profile", "pixels", "intensity")
add("g3_laminar_message_passing", lambda s, d: P.laminar_message_passing(_paths(s, d), pixels(s, d).withColumn("label", F.col("label").cast("long")), ["img"]),
    f"with {_path} select img, label, avg(m) message from (select img, label::bigint label, ln(1 + avg(v)) m from pixels where label > 0 group by all union all select img, src, ln(1 + avg(intensity)) from profile group by img, src, dst) group by all", "pixels", "message")
add("s17_patches", lambda s, d: P.patches(P.positions(pixels(s, d), ["img"]), pixels(s, d), ["img"], 8),
    "select a.img, a.label, list(coalesce(v, 0)::float order by dy, dx) patch from (select *, unnest(range(-4, 4)) dx from (select img, label, round_even(avg(y), 0)::int y, round_even(avg(x), 0)::int x, unnest(range(-4, 4)) dy from pixels where label > 0 group by img, label)) a left join pixels p on p.img = a.img and p.y = a.y + dy and p.x = a.x + dx group by a.img, a.label", "pixels")
add("s5_load_plate", N(lambda n: S.plate_rows(n.select("label", "well_id", "plate_id", "x", "y", "z"))), "select label, well_id, plate_id, x, y, z, label || '_' || well_id || '_' || plate_id id from nuclei", "nuclei")


def _layout(w):
    wide = w.groupBy(F.col("plate_id").alias("row")).agg(F.min("compound").alias("1"), F.max("compound").alias("2"))
    drugs = w.groupBy(F.col("plate_id").alias("row")).agg(F.min("well_id").alias("1"), F.max("well_id").alias("2"))
    lookup = w.groupBy(F.col("compound").alias("cancer_x_caf")).agg((F.count("*") % 3).alias("cancer"))
    meta = w.groupBy(F.col("conc").alias("cancer")).agg(F.count("*").alias("wells"))
    return S.multi_patient_layout(wide, drugs, lookup, meta)


add("s11_multi_patient_layout", W(_layout),
    "with p as (select plate_id as row, unnest(['01', '02']) as \"column\", unnest([min(compound), max(compound)]) cancer_x_caf, unnest([min(well_id), max(well_id)]) drug from wells group by plate_id) select row || \"column\" well_id, c.cancer, p.cancer_x_caf, p.row, p.\"column\", m.wells, p.drug from p left join (select compound, count(*) % 3 cancer from wells group by compound) c on c.compound = p.cancer_x_caf left join (select conc, count(*) wells from wells group by conc) m on m.conc = c.cancer", "wells")
