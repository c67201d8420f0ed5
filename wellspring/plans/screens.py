"""Queries over wells and vectors: screen statistics, embedding and its quality."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import embedding as E
from ..operators import spatial, stats
from ..sources.fixtures import nuclei, table, wells
from .registry import add
from .tables import FS, N, W, _long

_l = f"with l as ({_long.format(k='well_id, plate_id, compound', t='wells')})"


def L(fn):
    return lambda s, d: fn(A.unpivot(wells(s, d), ["well_id", "plate_id", "compound"], FS))


_eta = """, g as (select feature, {g}, count(*) n, avg(value) m, var_pop(value) * count(*) ss from l group by all),
 t as (select feature, sum(n) n, count(*) k, sum(ss) ssw, sum(n * m) / sum(n) gm from g group by all),
 b as (select feature, sum(g.n * (m - gm) * (m - gm)) ssb from g join t using (feature) group by all)
 select feature, n::bigint n, k, ssb / (ssb + ssw) eta2, (ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw + ssw / (n - k)) omega2, sqrt(ssb / ssw) cohens_f from t join b using (feature)"""
add("t1_effect_sizes", L(lambda x: stats.effect_sizes(x, "compound")), _l + _eta.format(g="compound"), "wells", "eta2 omega2 cohens_f", 9)
_two = """, g as (select feature, compound, count(*) n, avg(value) m, var_pop(value) * count(*) ss, var_samp(value) v from l group by all), c as (select * from g where compound = 'DMSO')"""
add("t2_eta2_two_groups", L(lambda x: stats.eta2_against(x, "compound", "DMSO")), _l + _two + " select g.feature, g.compound, b / (b + ss + ss0 + 1e-10) eta2 from (select g.*, c.ss ss0, g.n * c.n / (g.n + c.n) * (g.m - c.m) * (g.m - c.m) b from g join c using (feature) where g.compound <> 'DMSO') g", "wells", "eta2", 9)
add("t3_signal_to_noise", L(lambda x: stats.effect_sizes(x, "compound").select("feature", F.col("eta2").alias("a")).join(stats.effect_sizes(x, "plate_id").select("feature", F.col("eta2").alias("b")), "feature").select("feature", (F.col("a") / F.col("b")).alias("ratio"), (F.col("a") - F.col("b")).alias("diff"))),
    _l + ", e1 as (with x as (select 1)" + _eta.format(g="compound") + "), e2 as (with x as (select 1)" + _eta.format(g="plate_id") + ") select feature, e1.eta2 / e2.eta2 ratio, e1.eta2 - e2.eta2 diff from e1 join e2 using (feature)", "wells", "ratio diff")
add("t4_cohens_d", L(lambda x: stats.cohens_d(x, "compound", "DMSO")), _l + _two + " select g.feature, g.compound, (g.m - c.m) / sqrt(((g.n - 1) * g.v + (c.n - 1) * c.v) / (g.n + c.n - 2)) d from g join c using (feature) where g.compound <> 'DMSO'", "wells", "d")
add("t5_anova_main_effects", W(lambda w: stats.anova_first_term(w, "f1", "compound", ("conc", "timepoint"))), doubles="f p")
_welch = _l + _two + " select g.feature, g.compound, (g.m - c.m) / sqrt(g.v / g.n + c.v / c.n) t, pow(g.v / g.n + c.v / c.n, 2) / (pow(g.v / g.n, 2) / (g.n - 1) + pow(c.v / c.n, 2) / (c.n - 1)) df from g join c using (feature) where g.compound <> 'DMSO'"
add("t6_welch_t", L(lambda x: stats.welch_t(x, "compound", "DMSO").drop("p")), _welch, "wells", "t df", 5)
add("t6_welch_p", L(lambda x: stats.welch_t(x, "compound", "DMSO")), doubles="t df p")
_rank = _l + """, n as (select distinct feature, compound from l where compound <> 'DMSO'), b as (select n.feature, n.compound, l.value, 0 is_x from n join l on l.feature = n.feature and l.compound = 'DMSO' union all select feature, compound, value, 1 from l where compound <> 'DMSO'),
 r as (select *, rank() over (partition by feature, compound order by value) + (count(*) over (partition by feature, compound, value) - 1) / 2.0 r, count(*) over (partition by feature, compound, value) t from b),
 s as (select feature, compound, sum(r * is_x) - sum(is_x) * (sum(is_x) + 1) / 2 u, sum(is_x)::double n1, count(*) - sum(is_x)::double n2, count(*)::double n, sum(t * t - 1)::double tie from r group by all)
 select feature, compound, u::double u, u / (n1 * n2) auc, (u - n1 * n2 / 2 - sign(u - n1 * n2 / 2) * 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - tie / (n * (n - 1)))) z from s"""
add("t7_rank_sum", L(lambda x: stats.rank_sum(x, "compound", "DMSO").drop("p")), _rank, "wells", "u auc z")
add("t7_rank_sum_p", L(lambda x: stats.rank_sum(x, "compound", "DMSO")), doubles="u auc z p")
add("t8_kruskal_wallis", L(lambda x: stats.kruskal_wallis(x, "compound").drop("p")), _l + ", r as (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 r, count(*) over (partition by feature, value) t from l), g as (select feature, compound, sum(r)::double s, count(*) n, sum(t * t - 1)::double tie from r group by all), h as (select feature, sum(s * s / n) q, sum(n)::double n, sum(tie) tie, count(*) - 1 df from g group by all) select feature, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) h, df from h", "wells", "h")
add("t8_kruskal_p", L(lambda x: stats.kruskal_wallis(x, "compound")), doubles="h p")
_p = "(select well_id, compound, (f3 + 1) / 99.0::double p from wells)"
add("t9_p_adjust_bh", W(lambda w: stats.p_adjust(w.select("well_id", "compound", ((F.col("f3") + 1) / 99.0).alias("p")), "p", "BH", ("compound",))), f"select well_id, compound, p, least(min(q) over (partition by compound order by p desc range between unbounded preceding and current row), 1.0) p_adjusted from (select *, p * count(*) over (partition by compound) / (rank() over (partition by compound order by p) + count(*) over (partition by compound, p) - 1) q from {_p})", "wells", "p p_adjusted")
add("t9_p_adjust_bonferroni", W(lambda w: stats.p_adjust(w.select("well_id", "compound", ((F.col("f3") + 1) / 99.0).alias("p")), "p", "bonferroni", ("compound",))), f"select well_id, compound, p, least(p * count(*) over (partition by compound), 1.0) p_adjusted from {_p}", "wells", "p p_adjusted")
add("t10_marker_features", L(lambda x: stats.marker_features(x, "compound")), doubles="u auc log_fc z p p_adjusted rank_group")
add("t10_marker_auc", L(lambda x: stats.one_versus_rest(x, "compound").drop("p")), _l + """, r as (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 r, count(*) over (partition by feature, value)::double t from l),
 a as (select feature, count(*) n, sum(value) s, sum(t * t - 1) tie from r group by all), g as (select feature, compound, count(*) n1, sum(value) s1, sum(r) rx from r group by all),
 u as (select *, rx - n1 * (n1 + 1) / 2 u, n - n1 n2, sqrt(n1 * (n - n1) / 12.0::double * (n + 1 - tie / (n * (n - 1)))) sd from g join a using (feature))
 select feature, compound, u, u / (n1 * n2) auc, s1 / n1 - (s - s1) / n2 log_fc, case when sd > 0 then (u - n1 * n2 / 2 - sign(u - n1 * n2 / 2) * 0.5) / sd end z from u""", "wells", "u auc log_fc z", 4)
add("t11_n_de_features", L(lambda x: stats.marker_features(x, "compound").groupBy("compound").agg(F.sum((F.col("p_adjusted") <= 0.005).cast("int")).alias("n_de"))))
_rho = f"with l as ({_long.format(k='well_id', t='wells')}), r as (select well_id, feature, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0::double r from l) select a.feature feature_a, b.feature feature_b, corr(a.r, b.r) rho from r a join r b using (well_id) group by all"
add("t12_spearman_matrix", W(lambda w: stats.spearman_matrix(A.unpivot(w, ["well_id"], FS), "well_id")), _rho, "wells", "rho")
add("g22_correlation_graph", W(lambda w: stats.correlation_graph(stats.spearman_matrix(A.unpivot(w, ["well_id"], FS), "well_id"), 0.01)), f"select feature_a, feature_b from ({_rho}) where feature_a < feature_b and abs(rho) >= 0.01", "wells")
add("t13_pairwise_mahalanobis", W(lambda w: stats.pairwise_mahalanobis(w, "compound", FS)), doubles="distance")
add("t14_distance_to_control", W(lambda w: stats.pairwise_mahalanobis(w, "compound", FS).where("compound_b = 'DMSO'").select("compound", F.log1p("distance").alias("distance")).withColumn("rank", F.rank().over(Window.orderBy("distance")))), doubles="distance")
add("t16_z_prime", W(lambda w: stats.z_prime(w, "compound", "DMSO", "f1")), "with g as (select compound, avg(f1) m, stddev_samp(f1) s from wells group by all) select a.compound, 1 - 3 * (a.s + b.s) / abs(a.m - b.m) z_prime, case when 1 - 3 * (a.s + b.s) / abs(a.m - b.m) < 0 then 'bad' when 1 - 3 * (a.s + b.s) / abs(a.m - b.m) <= 0.5 then 'fair' else 'good' end category from g a, g b where b.compound = 'DMSO' and a.compound <> 'DMSO'", "wells", "z_prime", 3)
add("t18_compound_order", N(lambda n: stats.compound_order(A.fractions(n, ["well_id"], "leiden"), "well_id", "leiden", "fraction", "A01")), "with f as (select well_id, leiden, n / sum(n) over (partition by well_id) v from (select well_id, leiden, count(*) n from nuclei group by all)) select g.well_id, sqrt(sum(power(coalesce(a.v, 0) - coalesce(c.v, 0), 2))) distance, rank() over (order by sqrt(sum(power(coalesce(a.v, 0) - coalesce(c.v, 0), 2))))::int rank from (select * from (select distinct well_id from f), (select distinct leiden from f)) g left join f a using (well_id, leiden) left join f c on c.well_id = 'A01' and c.leiden = g.leiden group by g.well_id", "nuclei", "distance")
add("t24_well_mean_intensity", N(lambda n: n.groupBy("plate_id", "well_id").agg(F.avg("f1").alias("mean")).withColumn("scaled", stats.min_max(F.col("mean"), Window.partitionBy("plate_id")))), "select plate_id, well_id, mean, (mean - min(mean) over w) / (max(mean) over w - min(mean) over w) scaled from (select plate_id, well_id, avg(f1) mean from nuclei group by all) window w as (partition by plate_id)", "nuclei", "mean scaled")
add("e4_regress_out_linear", N(lambda n: stats.regress_out(n.select("label", "well_id", "f2", "z"), ["well_id"], "f2", "z").select("label", "residual")), "select label, f2 - regr_intercept(f2, z) over w - regr_slope(f2, z) over w * z residual from nuclei window w as (partition by well_id)", "nuclei", "residual", 4)
add("e1_scale", W(lambda w: A.zscore(w.select("well_id", *FS), [], FS)), "select well_id, (f1 - avg(f1) over ()) / stddev_samp(f1) over () f1, (f2 - avg(f2) over ()) / stddev_samp(f2) over () f2, (f3 - avg(f3) over ()) / stddev_samp(f3) over () f3, (f4 - avg(f4) over ()) / stddev_samp(f4) over () f4 from wells", "wells", "f1 f2 f3 f4")
add("e6_variable_features", W(lambda w: E.variable_features(A.unpivot(w, ["well_id"], FS), 2)), _long.format(k="well_id", t="wells").join(["with l as (", "), f as (select feature, avg(value) mean, var_samp(value) var, var_samp(value) / avg(value) dispersion, ntile(2) over (order by avg(value), feature)::int bin from l group by feature) select *, coalesce((dispersion - avg(dispersion) over w) / nullif(stddev_samp(dispersion) over w, 0), 0) z from f window w as (partition by bin)"]), "wells", "mean var dispersion z", 4)


def _latent_knn(s, d, k=5):
    v = table(s, d, "embeddings")
    return E.vector_knn(v, v, k, "vec_id", "embedding")


_knn = "select src, dst, dist, rank from (select a.vec_id src, b.vec_id dst, list_distance(a.embedding::double[], b.embedding::double[]) dist, row_number() over (partition by a.vec_id order by round(list_distance(a.embedding::double[], b.embedding::double[]), 12), b.vec_id)::int rank from embeddings a join embeddings b on a.vec_id <> b.vec_id) where rank <= 5"
add("e7_knn_graph", _latent_knn, _knn, "", "dist")
add("e12_project_labels", lambda s, d: E.project_labels(_latent_knn(s, d), table(s, d, "embeddings"), "vec_id", "label"), f"select vec_id, predicted, n from (select k.src vec_id, e.label predicted, count(*) n, row_number() over (partition by k.src order by count(*) desc, e.label) r from ({_knn}) k join embeddings e on e.vec_id = k.dst group by k.src, e.label) where r = 1")
add("e13_label_accuracy", lambda s, d: E.project_labels(_latent_knn(s, d), table(s, d, "embeddings"), "vec_id", "label").join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy")), f"select avg((predicted = label)::int::double) accuracy from (select k.src vec_id, e.label predicted, row_number() over (partition by k.src order by count(*) desc, e.label) r from ({_knn}) k join embeddings e on e.vec_id = k.dst group by k.src, e.label) join embeddings using (vec_id) where r = 1", "", "accuracy")
add("m1_gcs", lambda s, d: E.graph_similarity(_latent_knn(s, d), _latent_knn(s, d, 3), 5, table(s, d, "embeddings").count()), f"select 1 - (select count(*) from ({_knn}) where rank > 3) / (2.0 * 5 * (select count(*) from embeddings)) gcs", "", "gcs")
add("m10_nmi_ari", N(lambda n: E.clustering_agreement(n, "leiden", "z_slice")), """with c as (select leiden a, z_slice b, count(*)::double n from nuclei group by all), t as (select sum(n) t from c), ra as (select a, sum(n) na from c group by a), rb as (select b, sum(n) nb from c group by b),
 m as (select sum(n / t * ln(n * t / (na * nb))) mi, sum(n * (n - 1) / 2) s from c join ra using (a) join rb using (b), t), x as (select -sum(na / t * ln(na / t)) ha, sum(na * (na - 1) / 2) sa from ra, t), y as (select -sum(nb / t * ln(nb / t)) hb, sum(nb * (nb - 1) / 2) sb from rb, t)
 select mi / ((ha + hb) / 2) nmi, (s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)) ari from m, x, y, t""", "nuclei", "nmi ari", 9)  # fmt: skip
