"""Further queries: shapes, components, registration, models, gene scores."""

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import embedding as E
from ..operators import geometry as G
from ..operators import joins, spatial, stats, tiles
from ..session import durable
from ..sources.fixtures import nuclei, table, wells
from .registry import add
from .tables import FS, N, W

KS = "plate_id, well_id"
KL = ["plate_id", "well_id"]


def _cycles(s, d):
    n = nuclei(s, d)
    return n.where("plate_id = '004'"), n.where("plate_id = '005'")


# Geometry
add("g6_convex_hull", N(lambda n: G.convex_hulls(n, KL)), doubles="volume area", digits=9)


def _well_hull(s, d):
    """Hull of the points with more than 5 neighbours within 100; a well without four such points has a zero row."""
    n = nuclei(s, d)
    h = G.convex_hulls(tiles.crowded(n.select(*KL, "label", "x", "y", "z"), 100.0, 6), KL)
    h = n.select(*KL).distinct().join(h, KL, "left").na.fill(0.0, ["volume", "area"]).na.fill(0, ["n_points"])
    return h.withColumn("density", F.when(F.col("volume") > 0, F.col("n_points") / F.col("volume")).otherwise(0.0))


add("g7_well_hull", _well_hull, doubles="volume area density")
add("g5_component_stats", lambda s, d: G.component_stats(nuclei(s, d), [0, 1]), doubles="cx cy cz center_distance volume area volume_per_point", digits=9)
add("g17_spatial_drift", N(lambda n: G.drift(n.withColumn("step", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("(z_slice - 1) % step = 0").groupBy("step", *KL, "leiden").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z")), [*KL, "leiden"], "step")),
    f"with t as (select unnest([1,2,3]) step, * from nuclei), c as (select step, {KS}, leiden, avg(x) x, avg(y) y, avg(z) z from t where (z_slice - 1) % step = 0 group by all), d as (select c.step, sqrt((c.x-b.x)*(c.x-b.x)+(c.y-b.y)*(c.y-b.y)+(c.z-b.z)*(c.z-b.z)) dist from c join c b on b.step = 1 and b.plate_id = c.plate_id and b.well_id = c.well_id and b.leiden = c.leiden) select step, avg(dist) mean, stddev_samp(dist) std, min(dist) min, max(dist) max, count(*) n from d where dist < 100 group by step", "nuclei", "mean std min max")
add("g18_line_fit_distance", N(G.line_fit_distance), doubles="distance")
add("g19_plane_detected", N(G.plane_detected), f"select {KS}, count(distinct x) = 1 or count(distinct y) = 1 or count(distinct z) = 1 plane_detected from nuclei group by all", "nuclei")
add("g20_registration_qc", lambda s, d: G.registration_qc(joins.nearest_link(*_cycles(s, d), 40.0), *_cycles(s, d), ["well_id"]), doubles="score")
add("g23_distance_graph", N(lambda n: (lambda m: m.alias("a").join(m.alias("b"), (F.col("a.feature") == F.col("b.feature")) & (F.col("a.well_id") < F.col("b.well_id"))).groupBy(F.col("a.well_id").alias("a"), F.col("b.well_id").alias("b")).agg(F.sqrt(F.sum((F.col("a.value") - F.col("b.value")) * (F.col("a.value") - F.col("b.value")))).alias("d")).withColumn("weight", F.max("d").over(Window.partitionBy()) - F.col("d")))(A.unpivot(n, ["well_id"], FS).groupBy("well_id", "feature").agg(F.avg("value").alias("value")))),
    "with m as (select well_id, avg(f1) f1, avg(f2) f2, avg(f3) f3, avg(f4) f4 from nuclei group by all), e as (select a.well_id a, b.well_id b, sqrt((a.f1-b.f1)*(a.f1-b.f1)+(a.f2-b.f2)*(a.f2-b.f2)+(a.f3-b.f3)*(a.f3-b.f3)+(a.f4-b.f4)*(a.f4-b.f4)) d from m a join m b on a.well_id < b.well_id) select *, max(d) over () - d weight from e", "nuclei", "d weight", 5)
_grp = "select n_regionkey g from nation group by 1 having count(*) > 2"
add("g24_subnetworks", lambda s, d: (lambda c: c.join(c.groupBy("n_regionkey").count().where("count > 2"), "n_regionkey", "left_semi").select("n_name", "n_regionkey"))(table(s, d, "nation")), f"select n_name, n_regionkey from nation where n_regionkey in ({_grp})")

# Joins, windows, filters
add("j5_cross_join_controls", W(lambda w: w.select("timepoint", "conc").distinct().join(F.broadcast(w.where("compound = 'DMSO'").groupBy("plate_id").agg(F.avg("f1").alias("f1"))))), "select timepoint, conc, plate_id, f1 from (select distinct timepoint, conc from wells), (select plate_id, avg(f1) f1 from wells where compound = 'DMSO' group by all)", "wells", "f1")
add("j11_baseline_join", N(lambda n: (lambda c: c.alias("a").join(c.where("z_slice = 1").alias("b"), ["well_id", "leiden"]).select("well_id", "leiden", F.col("a.z_slice").alias("z_slice"), (F.col("a.x") - F.col("b.x")).alias("dx")))(n.groupBy("well_id", "leiden", "z_slice").agg(F.avg("x").alias("x")))), "with c as (select well_id, leiden, z_slice, avg(x) x from nuclei group by all) select a.well_id, a.leiden, a.z_slice, a.x - b.x dx from c a join c b on a.well_id = b.well_id and a.leiden = b.leiden and b.z_slice = 1", "nuclei", "dx")
add("w6_trimmed_sample", W(lambda w: (lambda q: w.join(F.broadcast(q), "plate_id").where("f1 between q[0] and q[1]").select("well_id", "plate_id", "f1"))(w.groupBy("plate_id").agg(F.expr("percentile(f1, array(0.01, 0.99))").alias("q")))), "select well_id, plate_id, f1 from wells join (select plate_id, quantile_cont(f1, 0.01) a, quantile_cont(f1, 0.99) b from wells group by all) using (plate_id) where f1 between a and b", "wells")
add("w8_ordered_categories", lambda s, d: wells(s, d).join(F.broadcast(s.createDataFrame([("P", 1), ("F", 2), ("O", 3)], "plate_id string, place int")), "plate_id").groupBy("plate_id", "place").agg(F.count("*").alias("n")).orderBy("place"), "select plate_id, case plate_id when 'P' then 1 when 'F' then 2 else 3 end::int place, count(*) n from wells group by all", "wells")
add("f5_artefact_filter", N(lambda n: n.where("not (plate_id = '005' and cast(substring(well_id, 2, 2) as int) < 4 and (ascii(well_id) - 64) % 2 = 0 and leiden = 3)").select("label")), "select label from nuclei where not (plate_id = '005' and substr(well_id, 2, 2)::int < 4 and (ascii(well_id) - 64) % 2 = 0 and leiden = 3)", "nuclei")
add("f11_rename_markers", W(lambda w: w.select("well_id", "f1", "f2").withColumnsRenamed({"f1": "marker_a", "f2": "marker_b"})), "select well_id, f1 marker_a, f2 marker_b from wells", "wells")
add("s13_plate_summaries", W(lambda w: w.select(F.regexp_replace(F.concat("plate_id", F.lit("-01")), r"-\d\d$", "").alias("plate_id"), "well_id")), "select plate_id, well_id from wells", "wells")
def _distance_by_well(n):
    """Mean and exact median of each well's kernel distances."""
    dist = durable(spatial.vector_distance(tiles.message_passing(n, 25.0, ["f1", "f2"], carry=True), ["f1", "f2"]))
    mid = A.quantiles(dist, KL, "distance", [0.5]).select(*KL, F.col("q")[0].alias("median"))
    return dist.groupBy(*KL).agg(F.avg("distance").alias("mean")).join(mid, KL, "left")


add("a23_distance_by_well", N(_distance_by_well), doubles="mean median")

# Genes and scores
_gc = "select unnest(string_split(p_type, ' ')) gene, p_brand compound, p_retailprice d from part"


def _genes(s, d):
    return table(s, d, "part").select(F.explode(F.split("p_type", " ")).alias("gene"), F.col("p_brand").alias("compound"), F.col("p_retailprice").alias("d"))


add("t21_gene_compound_matrix", lambda s, d: _genes(s, d).groupBy("gene", "compound").agg(F.max("d").alias("value")), f"select gene, compound, max(d) as value from ({_gc}) group by all")
add("t22_score_perturbations", lambda s, d: joins.matrix_product(_genes(s, d).groupBy("gene", "compound").agg(F.log1p(F.max("d")).alias("value")), _genes(s, d).groupBy(F.lit("all").alias("profile"), "gene").agg((F.avg("d") / 2000).alias("value")), "gene"), f"select compound, 'all' as profile, sum(a * b) as value from (select gene, compound, ln(1 + max(d)) a from ({_gc}) group by all) join (select gene, avg(d) / 2000 b from ({_gc}) group by all) using (gene) group by all", "", "value", 4)
add("t23_pathway_scores", lambda s, d: _genes(s, d).withColumn("pathway", F.length("gene") % 3).groupBy("pathway").agg(F.log1p(F.sum("d")).alias("score")), f"select length(gene) % 3 pathway, ln(1 + sum(d)) score from ({_gc}) group by all", "", "score")
add("t19_interaction_scores", N(lambda n: tiles.interaction_matrix(n, 25.0).withColumn("pair", F.when((F.col("src_group") < 2) & (F.col("dst_group") < 2), "cancer-cancer").when((F.col("src_group") >= 2) & (F.col("dst_group") >= 2), "caf-caf").otherwise("cancer-caf")).groupBy(*KL, "pair").agg(F.avg("n").alias("score"))), f"select {KS}, pair, avg(n) score from (select {KS}, case when src_cl < 2 and dst_cl < 2 then 'cancer-cancer' when src_cl >= 2 and dst_cl >= 2 then 'caf-caf' else 'cancer-caf' end pair, count(*) n from edges group by {KS}, src_cl, dst_cl) group by all", "binned", "score")
add("t20_proliferation_score", N(lambda n: n.groupBy(*KL).agg(F.avg(F.col("leiden").isin(1, 4).cast("double")).alias("proliferation"))), f"select {KS}, avg((leiden in (1, 4))::int::double) proliferation from nuclei group by all", "nuclei", "proliferation")
add("t17_cluster_wilcoxon", N(lambda n: stats.p_adjust(stats.rank_sum(A.fractions(n, ["well_id", "z_slice"], "leiden").select(F.col("leiden").cast("string").alias("feature"), F.substring("well_id", 1, 1).alias("row"), F.col("fraction").alias("value")), "row", "A"), "p")), doubles="u auc z p p_adjusted")

# Models


def _features(df):
    return VectorAssembler(inputCols=FS, outputCol="v", handleInvalid="skip").transform(df)


add("e16_kmeans", W(lambda w: (lambda v: KMeans(k=3, seed=1, featuresCol="v").fit(v).transform(v).groupBy("prediction").agg(F.count("*").alias("n")))(_features(A.zscore(w.select("well_id", *FS), [], FS)))))
add("e18_one_hot", W(lambda w: (lambda i: OneHotEncoder(inputCols=["i"], outputCols=["o"], dropLast=False).fit(i).transform(i).select("well_id", vector_to_array("o").alias("one_hot")))(StringIndexer(inputCol="plate_id", outputCol="i", stringOrderType="alphabetAsc").fit(w).transform(w))), "select well_id, [(plate_id = 'F')::int::double, (plate_id = 'O')::int::double, (plate_id = 'P')::int::double] one_hot from wells", "wells")
add("e19_marker_long_table", N(lambda n: A.zscore(A.unpivot(n, ["label"], ["f1", "f2"]), ["feature"], ["value"], eps=1e-10)), "select label, feature, (value - avg(value) over w) / (stddev_samp(value) over w + 1e-10) as value from (select label, unnest(['f1','f2']) feature, unnest([f1, f2]) as value from nuclei) window w as (partition by feature)", "nuclei", "value")
add("e20_ridge_impute", W(lambda w: (lambda v: LinearRegression(featuresCol="v", labelCol="f4", regParam=0.1, elasticNetParam=0.0).fit(v).transform(v).select("well_id", "prediction"))(VectorAssembler(inputCols=["f1", "f2", "f3"], outputCol="v").transform(w))), doubles="prediction", digits=4)
add("e8_bbknn", lambda s, d: E.batch_knn(table(s, d, "embeddings").withColumn("b", (F.col("label") % 2).cast("int")), 3, "vec_id", "embedding", "b"), "select src, dst, dist, rank, batch from (select a.vec_id src, b.vec_id dst, b.label % 2 batch, list_distance(a.embedding::double[], b.embedding::double[]) dist, row_number() over (partition by a.vec_id, b.label % 2 order by round(list_distance(a.embedding::double[], b.embedding::double[]), 12), b.vec_id)::int rank from embeddings a join embeddings b on a.vec_id <> b.vec_id) where rank <= 3", "", "dist")
add("e21_knn_impute", lambda s, d: (lambda v: E.vector_knn(v, v, 5, "vec_id", "embedding").join(v.select(F.col("vec_id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("vec_id")).agg(F.avg("label").alias("imputed")))(table(s, d, "embeddings")), "select k.src vec_id, avg(e.label) imputed from (select a.vec_id src, b.vec_id dst, row_number() over (partition by a.vec_id order by round(list_distance(a.embedding::double[], b.embedding::double[]), 12), b.vec_id) r from embeddings a join embeddings b on a.vec_id <> b.vec_id) k join embeddings e on e.vec_id = k.dst where r <= 5 group by all", "", "imputed")
add("e22_imputation_metrics", W(lambda w: w.groupBy("compound").agg((1 - F.sum((F.col("f3") - F.col("f4")) * (F.col("f3") - F.col("f4"))) / (F.var_pop("f3") * F.count("*"))).alias("r2"), F.corr("f3", "f4").alias("pearson"), F.avg(F.abs(F.col("f3") - F.col("f4"))).alias("mae"))), "select compound, 1 - sum((f3 - f4) * (f3 - f4)) / (var_pop(f3) * count(*)) r2, corr(f3, f4) pearson, avg(abs(f3 - f4)) mae from wells group by all", "wells", "r2 pearson mae")
add("e25_latent_feature_correlation", lambda s, d: (lambda v: v.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.corr(F.col("x").cast("double"), "label").alias("r")))(table(s, d, "embeddings")), "select dim, corr(x::double, label) r from (select label, unnest(range(64))::int dim, unnest(embedding) x from embeddings) group by dim", "", "r")
add("m18_pool_summaries", W(lambda w: w.groupBy("conc").agg((F.sum("f3") / F.sum(F.col("f3") + F.col("f4"))).alias("micro"), F.avg(F.col("f3") / (F.col("f3") + F.col("f4") + 1)).alias("macro"), F.stddev_samp(F.col("f3") / (F.col("f3") + F.col("f4") + 1)).alias("macro_sd"))), "select conc, sum(f3) / sum(f3 + f4) micro, avg(f3 / (f3 + f4 + 1)) macro, stddev_samp(f3 / (f3 + f4 + 1)) macro_sd from wells group by all", "wells", "micro macro macro_sd")
