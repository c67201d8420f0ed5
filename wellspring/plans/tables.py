"""Queries over nuclei and well tables: projections, joins, grouping, windows, sets, samples."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins
from ..sources import tables as S
from ..sources.fixtures import nuclei, table, wells
from .registry import add

KS = "plate_id, well_id"
FS = ["f1", "f2", "f3", "f4"]
_long = "select {k}, unnest(['f1','f2','f3','f4']) feature, unnest([f1, f2, f3::double, f4::double]) as value from {t}"


def N(fn):
    return lambda s, d: fn(nuclei(s, d))


def W(fn):
    return lambda s, d: fn(wells(s, d))


# Sources
add("s1_image_catalog", N(lambda n: S.parse_image_names(n.select(F.concat("plate_id", F.lit("_"), "well_id", F.lit("_T0001F001L01A01Z"), F.lpad(F.col("z_slice").cast("string"), 2, "0"), F.lit("C01.tif")).alias("file")).distinct())),
    "select distinct plate_id || '_' || well_id || '_T0001F001L01A01Z' || lpad(z_slice::varchar, 2, '0') || 'C01.tif' as file, well_id, '0001' time_point, '001' field_id, '01' time_line_id, '01' action_id, lpad(z_slice::varchar, 2, '0') z_stack_id, '01' channel_id, well_id || '_' || lpad(z_slice::varchar, 2, '0') id from nuclei", "nuclei")
add("s3_load_features", N(lambda n: S.join_features(n.select("plate_id", "well_id", "label", F.col("z_slice").alias("z"), F.col("f1").alias("ch_01"), F.col("f2").alias("ch_02")), n.select("plate_id", "well_id", "label", F.col("z_slice").alias("z"), F.col("f1").alias("intensity_mean_0"), F.col("f2").alias("intensity_mean_1"), F.col("f3").alias("area")))),
    f"select {KS}, label, z_slice - 1 z, f1 ch_01_neighbors, f2 ch_02_neighbors, ln(1 + f1) ch_01_nuclei, ln(1 + f2) ch_02_nuclei, f3 area from nuclei", "nuclei", "ch_01_nuclei ch_02_nuclei ch_01_neighbors ch_02_neighbors area")
add("s4_centroids", N(lambda n: S.centroids(n.withColumn("label", F.col("leiden").cast("string")).select("plate_id", "well_id", "label", F.col("z_slice").cast("double").alias("z"), F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("f1").alias("area")), 10.0, 0.322, 25.0)),
    f"select * from (select {KS}, leiden::varchar label, avg(z_slice::double / 0.322::double * 10) z, avg(y) cy, avg(x) cx, avg(f1) area, avg(z_slice::double) z_init from nuclei group by all) where area > 25", "nuclei", "z cy cx area z_init")
add("s7_select_channels", W(lambda w: S.select_channels(w.select("well_id", F.col("f1").alias("ch_01_nuclei"), F.col("f2").alias("ch_02_nuclei"), F.col("f3").alias("ch_02_neighbors")), ["02"])), "select well_id, f2 ch_02_nuclei, f3 ch_02_neighbors from wells", "wells", "ch_02_nuclei ch_02_neighbors")
add("s8_plate_layout", lambda s, d: S.plate_layout(table(s, d, "orders").select((1 + F.col("o_orderkey") % 16).cast("int").alias("plateRow"), (1 + (F.col("o_orderkey") / 16).cast("long") % 24).cast("int").alias("plateColumn")).distinct()),
    "select distinct 1 + (o_orderkey % 16)::int \"plateRow\", 1 + ((o_orderkey // 16) % 24)::int \"plateColumn\", chr((65 + o_orderkey % 16)::int) row_letter, chr((65 + o_orderkey % 16)::int) || lpad((1 + (o_orderkey // 16) % 24)::varchar, 2, '0') well_id from orders")
add("s9_wide_layout_to_long", W(lambda w: S.wide_layout_to_long(w.groupBy(F.col("plate_id").alias("row")).agg(F.max("f1").alias("1"), F.max("f2").alias("2"), F.max("f3").alias("11")), "row")),
    "select plate_id as row, unnest(['01','02','11']) as \"column\", unnest([max(f1), max(f2), max(f3)]) as value, plate_id || unnest(['01','02','11']) as well_id from wells group by plate_id", "wells", "value")
add("s10_plate_metadata", lambda s, d: S.plate_metadata(table(s, d, "nation").select("n_nationkey"), table(s, d, "region").select("r_name")), "select n_nationkey::varchar n_nationkey, r_name from nation cross join region")
add("s12_transpose_wide", W(lambda w: S.transpose_wide(w.groupBy("plate_id").agg(F.sum("f3").alias("a"), F.sum("f4").alias("b")), "plate_id", ["F", "O", "P"])),
    "select unnest(['a','b']) as name, unnest([sum(f3) filter (plate_id='F'), sum(f4) filter (plate_id='F')]) \"F\", unnest([sum(f3) filter (plate_id='O'), sum(f4) filter (plate_id='O')]) \"O\", unnest([sum(f3) filter (plate_id='P'), sum(f4) filter (plate_id='P')]) \"P\" from wells", "wells", "F O P")
add("s14_unprocessed_plates", lambda s, d: S.unprocessed(table(s, d, "customer").select(F.col("c_custkey").alias("plate_id")), table(s, d, "orders").select(F.col("o_custkey").alias("plate_id")), ["plate_id"]), "select c_custkey plate_id from customer where c_custkey not in (select o_custkey from orders)")
add("s15_filter_bad_wells", W(lambda w: S.drop_bad(w.select("well_id", "plate_id"), w.select("well_id", F.when(F.col("f3") > 90, "bad").otherwise("good").alias("decision")), ["well_id"])), "select well_id, plate_id from wells where f3 <= 90", "wells")

# Filters and projections
add("f1_equality_filters", N(lambda n: n.where(F.col("plate_id").isin("004") & F.col("leiden").isin(1, 3)).select("label")), "select label from nuclei where plate_id = '004' and leiden in (1, 3)", "nuclei")
add("f2_patch_in_bounds", N(lambda n: S.patch_in_bounds(n.select("label", "x", "y"), 128, 1000, 1000)), "select label, x, y from nuclei where x >= 64 and y >= 64 and x + 64 <= 1000 and y + 64 <= 1000", "nuclei")
add("f3_encodable_only", N(lambda n: n.select("label", "well_id", "z_slice").join(n.where("leiden = 0 and plate_id = '004'").select("well_id", "z_slice").distinct(), ["well_id", "z_slice"], "left_semi")), "select label, well_id, z_slice from nuclei where (well_id, z_slice) in (select well_id, z_slice from nuclei where leiden = 0 and plate_id = '004')", "nuclei")
add("f4_cut_open", N(lambda n: S.cut_open(n, ["plate_id", "well_id"]).select("label")), f"select label from (select *, avg(x) over w mx, avg(y) over w my from nuclei window w as (partition by {KS})) where not (x > mx and y > my)", "nuclei")
add("f6_control_relabel", W(lambda w: S.control_relabel(w.select("well_id", "compound", "conc", "timepoint"))), "select well_id, case when conc = 0 then 'DMSO' else compound end compound, case when conc = 0 or compound = 'DMSO' then 0 else conc end conc, timepoint, concat_ws('_', case when conc = 0 then 'DMSO' else compound end, case when conc = 0 or compound = 'DMSO' then 0 else conc end, timepoint) condition from wells", "wells")
add("f7_feature_taxonomy", lambda s, d: S.feature_taxonomy(table(s, d, "part").select(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("stat_interaction_1_2_", "stat_degree_3_", "morans_", "hull_volume_", "ch_01_nuclei_")]), (F.col("p_partkey") % 5 + 1).cast("int")), F.element_at(F.array(*[F.lit(x) for x in ("25", "50", "100", "all")]), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("feature")).distinct()),
    "select distinct feature, case when feature like '%interaction%' then 'interaction' when feature like '%degree%' then 'degree' when feature like '%moran%' then 'autocorrelation' when feature like '%hull%' then 'morphology' else 'intensity' end as type, case when feature like '%\\_all' escape '\\' then null else regexp_extract(feature, '_(25|50|100|150)$', 1)::int end kernel, case when feature like '%\\_all' escape '\\' then 'whole' else 'local' end as scope from (select ['stat_interaction_1_2_','stat_degree_3_','morans_','hull_volume_','ch_01_nuclei_'][(p_partkey % 5 + 1)::int] || ['25','50','100','all'][(p_partkey % 4 + 1)::int] feature from part)")
add("f8_density", W(lambda w: w.select("well_id", (F.col("f1") / F.when(F.col("f4") != 0, F.col("f4"))).alias("density"))), "select well_id, f1 / nullif(f4, 0) density from wells", "wells", "density")
add("f9_significance_stars", W(lambda w: w.select("well_id", S.significance_stars(F.col("f3") / 970).alias("stars"))), "select well_id, case when f3/970 <= 0.001 then '***' when f3/970 <= 0.01 then '**' when f3/970 <= 0.05 then '*' else 'ns' end stars from wells", "wells")
add("f10_prefix_to_suffix", lambda s, d: table(s, d, "part").select("p_partkey", S.prefix_to_suffix(F.col("p_type"), " ").alias("a"), S.suffix_to_prefix(F.col("p_type"), " ").alias("b")), "select p_partkey, array_to_string(list_concat(string_split(p_type,' ')[2:], [string_split(p_type,' ')[1]]), ' ') a, array_to_string(list_concat([string_split(p_type,' ')[-1]], string_split(p_type,' ')[:-2]), ' ') b from part")
add("f12_dedupe_columns", W(lambda w: S.distinct_features(A.unpivot(w.withColumn("f5", F.col("f1")), ["well_id"], [*FS, "f5"]), "well_id").select("feature")), "select unnest(['f1','f2','f3','f4']) feature")

# Joins
add("j2_left_join_layout", W(lambda w: w.select("well_id", "plate_id").join(F.broadcast(w.groupBy("plate_id").agg(F.max("f3").alias("top"))), "plate_id", "left")), "select well_id, plate_id, max(f3) over (partition by plate_id) top from wells", "wells")
add("j3_merge_cycles", N(lambda n: S.merge_cycles(n.where("plate_id = '004'").select("label", "well_id", "f1"), n.where("plate_id = '004' and leiden < 3").select("label", "well_id", "f1"), ["label", "well_id"])), "select label, well_id, f1 f1_source, f1 f1_target from nuclei where plate_id = '004' and leiden < 3", "nuclei")
add("j4_wells_in_both", N(lambda n: n.where("plate_id='004'").select("well_id").distinct().join(n.where("plate_id='005' and leiden=1").select("well_id").distinct(), "well_id")), "select distinct well_id from nuclei where plate_id='004' and well_id in (select well_id from nuclei where plate_id='005' and leiden=1)", "nuclei")
add("j6_anti_join", W(lambda w: w.select("well_id").join(w.where("f4 > 50").select("well_id"), "well_id", "left_anti")), "select well_id from wells where f4 <= 50", "wells")
add("j7_semi_join", W(lambda w: w.select("well_id", "plate_id").join(w.where("f4 > 50").select("well_id"), "well_id", "left_semi")), "select well_id, plate_id from wells where f4 > 50", "wells")
add("j12_contrast_pairs", W(lambda w: S.contrast_pairs(w.groupBy("plate_id", "compound").agg(F.avg("f1").alias("f1")), ["plate_id"], "compound", "DMSO")), "with g as (select plate_id, compound, avg(f1) f1 from wells group by all) select a.plate_id, a.compound, a.f1, b.f1 f1_control from g a join g b using (plate_id) where a.compound <> 'DMSO' and b.compound = 'DMSO'", "wells", "f1 f1_control")
add("j13_fold_left_joins", W(lambda w: joins.fold_left_joins([w.groupBy("compound").agg(F.avg(c).alias("score")) for c in ("f1", "f2", "f3")], ["compound"])), "select compound, avg(f1) score, avg(f2) score_1, avg(f3) score_2 from wells group by all", "wells", "score score_1 score_2")
add("j14_gene_compound_join", lambda s, d: S.explode_list(table(s, d, "part").select("p_partkey", F.col("p_brand").alias("compound"), F.regexp_replace("p_type", " ", ";").alias("genes")), "genes", ";").groupBy("genes").agg(F.concat_ws(";", F.sort_array(F.collect_set("compound"))).alias("compounds"), F.count("*").alias("n")), "select genes, array_to_string(list_sort(list(distinct compound)), ';') compounds, count(*) n from (select p_brand compound, unnest(string_split(p_type, ' ')) genes from part) group by genes")
add("j15_matrix_product", lambda s, d: joins.matrix_product(table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("r"), F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("value")), table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("k"), F.col("l_linestatus").alias("c")).agg(F.sum("l_discount").alias("value")), "k"),
    "select r, c, sum(a * b) as value from (select l_returnflag r, l_linenumber k, sum(l_quantity) a from lineitem group by all) join (select l_linenumber k, l_linestatus c, sum(l_discount) b from lineitem group by all) using (k) group by all", "", "value", 3)
add("j16_complete_grid", W(lambda w: A.cluster_counts(w, ["plate_id"], "compound")), "select p.plate_id, c.compound, count(w.well_id) n from (select distinct plate_id from wells) p cross join (select distinct compound from wells) c left join wells w on w.plate_id = p.plate_id and w.compound = c.compound group by all", "wells")

# Aggregations
add("a1_counts", N(lambda n: n.groupBy("plate_id", "well_id").agg(F.count("*").alias("n"))), f"select {KS}, count(*) n from nuclei group by all", "nuclei")
add("a2_cluster_counts", N(lambda n: A.cluster_counts(n, ["plate_id", "well_id", "z_slice"], "leiden")), "select k.plate_id, k.well_id, k.z_slice, c.leiden, count(n.label) n from (select distinct plate_id, well_id, z_slice from nuclei) k cross join (select distinct leiden from nuclei) c left join nuclei n on n.plate_id = k.plate_id and n.well_id = k.well_id and n.z_slice = k.z_slice and n.leiden = c.leiden group by all", "nuclei")
add("a3_well_gate", N(lambda n: A.well_gate(n, ["plate_id", "well_id", "z_slice"], ["leiden", "f3"])), "select plate_id, well_id, z_slice from nuclei group by all having count(distinct leiden) > 1 and count(distinct f3) > 1", "nuclei")
add("a4_profile_mean", N(lambda n: A.profile(n, ["leiden"], FS)), "select leiden, avg(f1) f1, avg(f2) f2, avg(f3) f3, avg(f4) f4 from nuclei group by all", "nuclei", "f1 f2 f3 f4")
add("a4_profile_median", N(lambda n: A.profile(n, ["leiden"], FS, "median")), "select leiden, quantile_cont(f1, 0.5) f1, quantile_cont(f2, 0.5) f2, quantile_cont(f3, 0.5) f3, quantile_cont(f4, 0.5) f4 from nuclei group by all", "nuclei", "f1 f2 f3 f4")
add("a5_dot_plot", W(lambda w: A.dot_plot(A.unpivot(w, ["compound"], FS), "compound")), f"select compound, feature, avg(value) mean, avg((value > 0)::int) fraction, count(value) n from ({_long.format(k='compound', t='wells')}) group by all", "wells", "mean fraction")
add("a6_multi_agg", N(lambda n: A.multi_agg(n, ["plate_id", "well_id"], ["f1", "f2"])), f"select {KS}, avg(f1) f1_mean, sum(f1) f1_sum, avg(f2) f2_mean, sum(f2) f2_sum from nuclei group by all", "nuclei", "f1_mean f1_sum f2_mean f2_sum", 3)
add("a7_cluster_fractions", N(lambda n: A.fractions(n, ["well_id"], "leiden")), "select well_id, leiden, n, n / sum(n) over (partition by well_id) fraction from (select well_id, leiden, count(*) n from nuclei group by all)", "nuclei", "fraction")
add("a8_mean_proportions", N(lambda n: A.mean_proportions(n, ["well_id"], ["plate_id"], "leiden")), "select plate_id, leiden, avg(n / t) mean_share from (select k.plate_id, k.well_id, c.leiden, count(n.label) n, sum(count(n.label)) over (partition by k.plate_id, k.well_id) t from (select distinct plate_id, well_id from nuclei) k cross join (select distinct leiden from nuclei) c left join nuclei n on n.plate_id = k.plate_id and n.well_id = k.well_id and n.leiden = c.leiden group by k.plate_id, k.well_id, c.leiden) group by all", "nuclei", "mean_share")
add("a9_cv_summary", W(lambda w: A.cv_summary(A.unpivot(w, ["compound", "conc"], FS), ["compound", "conc", "feature"])), f"select compound, conc, feature, count(value) n, avg(value) mean, stddev_samp(value) sd, stddev_samp(value) / nullif(avg(value), 0) cv from ({_long.format(k='compound, conc', t='wells')}) group by all", "wells", "mean sd cv")
add("a10_cv_within_total", W(lambda w: A.cv_within_total(A.unpivot(w, ["compound"], FS), "compound")), f"with l as ({_long.format(k='compound', t='wells')}) select feature, stddev_samp(value) / abs(avg(value)) cv_total, any_value(cw) cv_within from l join (select feature, avg(cv) cw from (select feature, compound, stddev_samp(value) / abs(avg(value)) cv from l group by all) group by feature) using (feature) group by feature", "wells", "cv_total cv_within")
add("a11_pivot_wide", W(lambda w: w.groupBy("compound").pivot("plate_id", ["F", "O", "P"]).agg(F.avg("f1"))), "select compound, avg(f1) filter (plate_id = 'F') \"F\", avg(f1) filter (plate_id = 'O') \"O\", avg(f1) filter (plate_id = 'P') \"P\" from wells group by all", "wells", "F O P")
add("a11_pivot_longer", W(lambda w: A.unpivot(w, ["well_id"], FS)), _long.format(k="well_id", t="wells"), "wells", "value")
add("a12_split_name", lambda s, d: table(s, d, "part").select("p_partkey", F.get(F.split("p_type", " "), F.lit(0)).alias("a"), F.get(F.split("p_type", " "), F.lit(1)).alias("b")), "select p_partkey, string_split(p_type, ' ')[1] a, string_split(p_type, ' ')[2] b from part")
add("a13_min_max", N(lambda n: n.groupBy("leiden").agg(F.min("f2").alias("q_low"), F.max("f2").alias("q_high"))), "select leiden, min(f2) q_low, max(f2) q_high from nuclei group by all", "nuclei")
add("a14_average_matched", W(lambda w: w.select("well_id", S.row_mean("f3", F.when(F.col("f4") > 50, F.col("f4"))).alias("f"))), "select well_id, case when f4 > 50 then (f3 + f4) / 2 else f3 end f from wells", "wells", "f")
add("a15_label_mean", N(lambda n: n.groupBy("plate_id", "well_id", "leiden").agg(F.avg("f1").alias("f1"), F.avg("x").alias("x"))), f"select {KS}, leiden, avg(f1) f1, avg(x) x from nuclei group by all", "nuclei", "f1 x")
add("a16_row_mean", W(lambda w: w.select("well_id", S.row_mean("f2", "f3", "f4").alias("m"))), "select well_id, (f2 + f3 + f4) / 3 m from wells", "wells", "m")
add("a17_crosstab", N(lambda n: A.crosstab(n, "leiden", "z_slice")), "select leiden, z_slice, n, n / sum(n) over (partition by leiden) share from (select leiden, z_slice, count(*) n from nuclei group by all)", "nuclei", "share")
add("a18_any", N(lambda n: n.groupBy("plate_id", "well_id").agg(F.bool_or(F.col("f1") > 49).alias("any_high"))), f"select {KS}, bool_or(f1 > 49) any_high from nuclei group by all", "nuclei")
add("a19_robust_summary", W(lambda w: A.robust_summary(w, ["compound"], "f1")), "select compound, avg(f1) mean, stddev_samp(f1) sd, var_samp(f1) var, quantile_cont(f1, 0.5) median, 1.4826 * mad(f1) mad from wells group by all", "wells", "mean sd var median mad", 3)
add("a20_gene_ranks", lambda s, d: S.gene_ranks(table(s, d, "part").select(F.split("p_type", " ").alias("genes"), F.col("p_retailprice").alias("distance"))), "select gene, total, n, total / n score, rank() over (order by total / n desc)::int rank from (select gene, sum(p_retailprice) total, count(*) n from (select unnest(string_split(p_type, ' ')) gene, p_retailprice from part) group by gene)", "", "total score")
add("a21_mean_scores", W(lambda w: w.groupBy("compound").agg(F.avg("f1").alias("score")).orderBy("score")), "select compound, avg(f1) score from wells group by all", "wells", "score")
add("a22_clipped_stats", N(lambda n: A.clipped_stats(n, ["leiden"], "f2")), "with c as (select leiden l, quantile_cont(f2, 0.01) a, quantile_cont(f2, 0.99) b from nuclei group by all) select leiden, count(f2) n, avg(f2) mean, quantile_cont(f2, 0.5) median, stddev_pop(f2) std, quantile_cont(f2, 0.25) q25, quantile_cont(f2, 0.75) q75, quantile_cont(f2, 0.01) p1, quantile_cont(f2, 0.99) p99 from nuclei join c on l = leiden where f2 between a and b group by all", "nuclei", "mean median std q25 q75 p1 p99", 4)
add("a24_undersample", N(lambda n: A.undersample(n, ["plate_id", "well_id"], "leiden", "z_slice", "f1")), f"with r as (select *, dense_rank() over (partition by {KS} order by z_slice) r from nuclei), t as (select unnest([1,2,3,4]) step, * from r), c as (select step, {KS}, leiden, count(*) n, sum(f1) area from t where (r - 1) % step = 0 group by all), o as (select step, count(*) n_cells, avg(n) mean_seen, avg(area) mean_area from c group by all) select *, n_cells / (select n_cells from o where step = 1) fraction from o", "nuclei", "mean_seen mean_area fraction")

# Windows and samples
add("w1_average_rank", W(lambda w: w.select("well_id", A.average_rank("f3", ["compound"]).alias("r"))), "select well_id, rank() over (partition by compound order by f3) + (count(*) over (partition by compound, f3) - 1) / 2.0 r from wells", "wells", "r")
add("w2_group_totals", W(lambda w: w.select("well_id", F.count("*").over(Window.partitionBy("compound")).alias("n_total"))), "select well_id, count(*) over (partition by compound) n_total from wells", "wells")
add("w3_zscore", W(lambda w: A.zscore(w.select("well_id", "plate_id", "f1", "f2"), ["plate_id"], ["f1", "f2"])), "select well_id, plate_id, (f1 - avg(f1) over w) / stddev_samp(f1) over w f1, (f2 - avg(f2) over w) / stddev_samp(f2) over w f2 from wells window w as (partition by plate_id)", "wells", "f1 f2")
add("w4_iqr_outliers", W(lambda w: A.iqr_outliers(w.select("well_id", "compound", "f1"), ["compound"], "f1", 1.5, 0.75)), "select well_id, compound, f1, f1 < a - 1.5 * (b - a) or f1 > b + 0.75 * (b - a) is_outlier from wells join (select compound, quantile_cont(f1, 0.25) a, quantile_cont(f1, 0.75) b from wells group by all) using (compound)", "wells")
add("w5_quantile_rescale", W(lambda w: A.quantile_rescale(w.select("well_id", "compound", "f1"), ["compound"], "f1")), "select well_id, compound, f1, (least(greatest(f1, a), b) - a) / (b - a) scaled from wells join (select compound, quantile_cont(f1, 0.05) a, quantile_cont(f1, 0.95) b from wells group by all) using (compound)", "wells", "scaled")
add("w7_top_n", W(lambda w: w.withColumn("r", F.rank().over(Window.partitionBy("plate_id").orderBy(F.desc("f3")))).where("r <= 10").select("well_id", "plate_id", "f3")), "select well_id, plate_id, f3 from (select *, rank() over (partition by plate_id order by f3 desc) r from wells) where r <= 10", "wells")
add("w9_stratified_sample", W(lambda w: A.stratified_sample(w.select("well_id", "compound"), ["compound"], 20, 7, "well_id")), "select well_id, compound from (select *, row_number() over (partition by compound order by md5('7|' || well_id), well_id) r from wells) where r <= 20", "wells")
add("w10_fraction_sample", W(lambda w: A.fraction_sample(w.select("well_id", "compound"), ["compound"], 0.25, 3, "well_id")), "select well_id, compound from (select *, row_number() over (partition by compound order by md5('3|' || well_id), well_id) r, count(*) over (partition by compound) n from wells) where r <= floor(n * 0.25)", "wells")
add("w11_balanced_sample", W(lambda w: A.balanced_sample(w.select("well_id", "f3"), "f3", 20, 5, 1, "well_id")), "select well_id, f3, bin from (select *, row_number() over (partition by bin order by md5('1|' || well_id), well_id) r from (select well_id, f3, least(floor((f3 - a) / ((b - a) / 20)), 19)::int bin from wells, (select min(f3) a, max(f3) b from wells))) where r <= 5", "wells")
add("w12_grouped_split", W(lambda w: A.grouped_split(w.select("well_id", "compound", "conc"), ["compound", "conc"], 0.8, 5)), "with g as (select distinct compound, conc from wells), o as (select *, row_number() over (order by md5('5|' || compound || '|' || conc)) r, count(*) over () n from g) select well_id, compound, conc, r <= floor(n * 0.8) is_train from wells join o using (compound, conc)", "wells")
add("w13_three_way_split", W(lambda w: A.three_way_split(w.select("well_id"), 9, "well_id")), "select well_id, case when h < 70 then 'train' when h < 85 then 'valid' else 'test' end part from (select well_id, ('0x' || substr(md5('9|' || well_id), 1, 6))::int % 100 h from wells)", "wells")

# Sets
add("u1_union_all", W(lambda w: w.select("well_id", "f1").withColumn("id", F.lit("a")).unionByName(w.select("well_id", "f3").withColumn("id", F.lit("b")), allowMissingColumns=True)), "select well_id, f1, 'a' id, null::double f3 from wells union all select well_id, null, 'b', f3 from wells", "wells")
add("u2_column_bind", W(lambda w: w.select("well_id", "f1").join(w.select("well_id", F.col("f2").alias("b_f2")), "well_id")), "select well_id, f1, f2 b_f2 from wells", "wells")
add("u3_intersect", W(lambda w: w.where("f3 > 30").select("compound", "conc").intersect(w.where("f4 < 20").select("compound", "conc"))), "select compound, conc from wells where f3 > 30 intersect select compound, conc from wells where f4 < 20", "wells")
add("u4_except", W(lambda w: w.select("f3").subtract(w.where("f4 < 90").select("f3"))), "select f3 from wells except select f3 from wells where f4 < 90", "wells")
add("u5_distinct", N(lambda n: n.select("well_id", "leiden").distinct()), "select distinct well_id, leiden from nuclei", "nuclei")
