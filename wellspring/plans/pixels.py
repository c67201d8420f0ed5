"""Queries over pixel and label tables."""

from pyspark.sql import functions as F

from ..operators import pixels as P
from ..sources.fixtures import pixels
from .registry import add


def X(fn):
    return lambda s, d: fn(pixels(s, d))


add("p1_mip", X(lambda p: P.mip(p, ["well", "ch"])), "select well, ch, y, x, max(v) v from pixels group by all", "pixels")
add("p2_image_stats", X(lambda p: P.image_stats(p, ["img"])), "select img, max(v) max, min(v) min, avg(v) mean, stddev_pop(v) std, avg(v) / stddev_pop(v) mean_std from pixels group by all", "pixels", "mean std mean_std")
add("p3_robust_stats", X(lambda p: P.robust_stats(p, ["img"])), "select img, quantile_cont(v, 0.5) median, mad(v::double) mad, quantile_cont(v, 0.5) / mad(v::double) median_mad from pixels group by all", "pixels", "median mad median_mad")
add("p4_patch_stats", X(lambda p: P.patch_stats(p, ["img", "ch"], 10)), "select img, ch, x // 10 px, y // 10 py, avg(v) mean, stddev_pop(v) std, quantile_cont(v, 0.5) median, quantile_cont(v, 0.01) quantile_low, quantile_cont(v, 0.99) quantile_high, max(v) max, min(v) min, quantile_cont(abs(v - m), 0.5) mad from pixels, (select quantile_cont(v, 0.5) m from pixels) group by all", "pixels", "mean std median quantile_low quantile_high mad")
add("p5_channel_qc_mean", X(lambda p: P.image_stats(p, ["img", "ch"]).groupBy("ch").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))), "select ch, avg(mean) mean, avg(std) std from (select img, ch, avg(v) mean, stddev_pop(v) std from pixels group by all) group by all", "pixels", "mean std")
_otsu = """with e as (select img, min(v)::double a, max(v)::double b from {t} group by all), h as (select img, a, b, least(floor((v - a) / ((b - a) / 256)), 255) bin, count(*) n from {t} join e using (img) group by all),
 c as (select *, a + (b - a) / 256 * (bin + 0.5) c from h), s as (select *, sum(n) over u n1, sum(n * c) over u s1, sum(n) over t nt, sum(n * c) over t st from c window u as (partition by img order by bin), t as (partition by img)),
 b as (select *, case when nt > n1 then round(n1 * (nt - n1) * (s1 / n1 - (st - s1) / (nt - n1)) * (s1 / n1 - (st - s1) / (nt - n1)), 3) else -1 end bt from s)
 select img, arg_max(c, bt - bin * 1e-9) threshold from b group by all"""
add("p6_otsu_threshold", X(lambda p: P.otsu_threshold(p, ["img"])), _otsu.format(t="pixels"), "pixels", "threshold", 4)
add("p7_foreground_filter", X(lambda p: P.foreground_filter(p, ["well", "z"], "ch")), doubles="ratio")
add("p8_flatfield_apply", X(lambda p: P.flatfield_apply(p.select("img", "ch", "y", "x", "v"), P.flatfield_average(p.select("ch", "y", "x", (F.col("v") / 2048).alias("v"))))), "select img, ch, y, x, case when f > 0 then least(floor(v / f), 65535)::int else v end v from (select img, ch, y, x, v, avg(v / 2048) over (partition by ch, y, x) f from pixels)", "pixels")
add("p9_flatfield_average", X(lambda p: P.flatfield_average(p)), "select ch, y, x, avg(v) flat from pixels group by all", "pixels", "flat")
add("p11_background_subtract", X(lambda p: P.background_subtract(p.select("img", "y", "x", "v"), p.groupBy("img").agg(F.expr("percentile(v, 0.1)").alias("bg")), ["img"])), "select img, y, x, greatest(v - trunc(q)::int, 0) v from pixels join (select img, quantile_cont(v, 0.1) q from pixels group by all) using (img)", "pixels")
add("p12_z_profile", X(lambda p: P.z_profile(p, ["well", "ch"])), "select well, ch, z, quantile_cont(v, 0.5) median_value, lpad((z + 1)::varchar, 2, '0') z_slice from pixels group by all", "pixels", "median_value")
add("p14_percentile_rescale", X(lambda p: P.percentile_rescale(p.select("img", "y", "x", "v"), ["img"], 0.05, 0.0, 255.0)), "select img, y, x, v, 0 + least(greatest((v - a) / (b - a), 0), 1) * 255.0 scaled from pixels join (select img, quantile_cont(v, 0.05) a, quantile_cont(v, 0.95) b from pixels group by all) using (img)", "pixels", "scaled")
add("p15_quantile_scale", X(lambda p: P.percentile_rescale(p.select("ch", "img", "y", "x", "v"), ["ch"], 0.01, 0.0, 1.0, few=True)), "select ch, img, y, x, v, least(greatest((v - a) / (b - a), 0), 1) scaled from pixels join (select ch, quantile_cont(v, 0.01) a, quantile_cont(v, 0.99) b from pixels group by all) using (ch)", "pixels", "scaled")
add("p16_stitch_tiles", X(lambda p: P.stitch_tiles(p.withColumn("tile", F.col("z")), 2, 50, 25, 5, ["well", "ch"])),
    "select well, ch, (y + (z // 2) * 20)::int cy, (x + (z % 2) * 45)::int cx, sum(v * w) / sum(w) v from (select *, least(1, (least(x, 49 - x) + 1) / 6.0::double) * least(1, (least(y, 24 - y) + 1) / 6.0::double) w from pixels) group by all", "pixels", "v")
add("p17_downsample", X(lambda p: P.downsample(p.select("img", "y", "x", "v"), 5)), "select img, y, x, v from pixels where x % 5 = 0 and y % 5 = 0", "pixels")
add("p18_montage", X(lambda p: P.montage(p, 3, 50, 25, ["z"], [0, 1])), "select z, (y + (well // 3) * 25)::int cy, (x + (well % 3) * 50)::int cx, coalesce(max(v) filter (ch = 0), 0) \"0\", coalesce(max(v) filter (ch = 1), 0) \"1\" from pixels group by all", "pixels")
add("p19_regionprops", X(lambda p: P.regionprops(p, ["img"])),
    "select img, label, area, cy, cx, 4 * sqrt(h + r) major_axis_length, 4 * sqrt(greatest(h - r, 0)) minor_axis_length, sqrt(1 - greatest(h - r, 0) / (h + r)) eccentricity, i intensity_mean from (select *, (xx + yy) / 2 h, sqrt(4 * xy * xy + (xx - yy) * (xx - yy)) / 2 r from (select img, label, count(*) area, avg(y) cy, avg(x) cx, var_pop(y) + 1.0::double / 12 yy, var_pop(x) + 1.0::double / 12 xx, covar_pop(y, x) xy, avg(v) i from pixels where label > 0 group by all))", "pixels", "cy cx major_axis_length minor_axis_length eccentricity intensity_mean", 5)
add("p20_positions", X(lambda p: P.positions(p, ["img"])), "select img, label, round_even(avg(y), 0)::int y, round_even(avg(x), 0)::int x from pixels where label > 0 group by all", "pixels")
add("p21_radial_profile", X(lambda p: P.radial_profile(P.positions(p, ["img"]), p, ["img"], 4)),
    "with c as (select img, label center, round_even(avg(y), 0)::int y0, round_even(avg(x), 0)::int x0 from pixels where label > 0 group by all), g as (select *, unnest([0,1,2,3,4]) radial_position from c) select g.img, g.center, g.radial_position, coalesce(avg(v), 0) intensity from g left join pixels p on p.img = g.img and p.y - y0 >= -4 and p.y - y0 < 4 and p.x - x0 >= -4 and p.x - x0 < 4 and floor(sqrt((p.y - y0) * (p.y - y0) + (p.x - x0) * (p.x - x0))) = radial_position group by all", "pixels", "intensity")
add("p22_average_intensities", X(lambda p: P.radial_profile(P.positions(p, ["img"]), p, ["img"], 4).groupBy("img", "center").agg(F.avg("intensity").alias("intensity"))), doubles="intensity")
add("p23_regular_grid_features", X(lambda p: P.radial_profile(P.grid_positions(p, ["img"], 10), p, ["img"], 5).groupBy("img", "center").agg(F.avg("intensity").alias("intensity"))), doubles="intensity")
add("p25_label_offset_merge", X(lambda p: P.offset_labels(p.select("well", "ch", "z", "y", "x", "label"), ["well", "ch"])), "select well, ch, z, y, x, case when label > 0 then label + coalesce(o, 0) else 0 end::bigint label from pixels join (select well, ch, z, sum(max(label)) over (partition by well, ch order by z rows between unbounded preceding and 1 preceding) o from pixels group by well, ch, z) using (well, ch, z)", "pixels")
_shift = "(select img, well, ch, z, y, x + 1 x, label from pixels)"
add("p26_stitch_labels_3d", X(lambda p: P.stitch_labels_3d(p, ["well", "ch"]).groupBy("well", "ch").agg(F.countDistinct("object").alias("objects"), F.count("*").alias("labels"))), "select well, ch, count(distinct label) objects, count(distinct (z, label)) labels from pixels where label > 0 group by all", "pixels")
add("p27_split_disconnected", X(lambda p: P.split_disconnected(p.withColumn("label", F.when(F.col("label") > 0, F.col("label") % 3 + 1).otherwise(0)), ["img"]).groupBy("img", "z", "label").agg(F.countDistinct("part").alias("parts"), F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))),
    "select img, z, label % 3 + 1 as label, count(distinct label) parts, count(*) pixels from pixels where label > 0 group by img, z, label % 3 + 1", "pixels")
add("p28_single_slice_labels", X(lambda p: P.single_slice_labels(p.where("not (label = 3 and z > 0)"), ["well"])), "select well, label from pixels where label > 0 and not (label = 3 and z > 0) group by all having count(distinct z) >= 2", "pixels")
add("p29_contingency", X(lambda p: P.contingency(p, p.withColumn("x", F.col("x") + 1), ["well", "ch"])), f"with j as (select p.well, p.ch, p.z, p.label gt, q.label pred from pixels p join {_shift} q using (well, ch, z, y, x) where p.label > 0 and q.label > 0) select well, ch, gt, pred, z, count(*) n from j group by all union all select well, ch, gt, pred, null, count(*) from j group by all", "pixels")
_areas = "select img * 1000 + label label, count(*) area from {t} where label > 0 group by all"


def _metrics(p):
    p = p.withColumn("label", F.when(F.col("label") > 0, F.col("img") * 1000 + F.col("label")).otherwise(0))
    q = p.withColumn("x", F.col("x") + 1)
    area = lambda t: t.where("label > 0").groupBy("label").agg(F.count("*").alias("area"))
    pairs = P.contingency(p, q, ["img"]).where("z is null").select("gt", "pred", "n")
    return P.instance_metrics(pairs, area(p), area(q), [0.5, 0.6, 0.75])


add("m17_instance_metrics", X(_metrics),
    f"""with a as ({_areas.format(t='pixels')}), b as ({_areas.format(t=_shift)}), j as (select p.img * 1000 + p.label gt, q.img * 1000 + q.label pred, count(*) n from pixels p join {_shift} q using (well, ch, z, y, x) where p.label > 0 and q.label > 0 group by all),
    i as (select n / (a.area + b.area - n) iou from j join a on a.label = gt join b on b.label = pred), t as (select unnest([0.5::double, 0.6::double, 0.75::double]) tau),
    h as (select tau, count(iou) tp, coalesce(sum(iou), 0) s from t left join i on iou > tau group by all), c as (select *, (select count(*) from a) n_gt, (select count(*) from b) n_pred from h)
    select tau, n_gt, n_pred, tp, n_pred - tp fp, n_gt - tp fn, tp / n_pred "precision", tp / n_gt recall, 2 * tp / (n_gt + n_pred) f1, tp / (n_gt + n_pred - tp) ap, s / (tp + 0.5 * (n_pred - tp) + 0.5 * (n_gt - tp)) pq from c""",
    "pixels", "precision recall f1 ap pq")
