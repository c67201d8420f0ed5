"""Operators on long pixel tables: one row per pixel."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import durable
from .graph import connected_components


def mip(px: DataFrame, keys: list[str]) -> DataFrame:
    """Maximum over slices."""
    return px.groupBy(*keys, "y", "x").agg(F.max("v").alias("v"))


def image_stats(px: DataFrame, keys: list[str]) -> DataFrame:
    """max, min, mean, population deviation and mean over deviation of each image."""
    out = px.groupBy(*keys).agg(F.max("v").alias("max"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return out.withColumn("mean_std", F.when(F.col("std") > 0, F.col("mean") / F.col("std")))


def robust_stats(px: DataFrame, keys: list[str]) -> DataFrame:
    """Median, median absolute deviation and their ratio of each image."""
    med = px.groupBy(*keys).agg(F.expr("percentile(v, 0.5)").alias("median"))
    out = px.join(med, keys).groupBy(*keys, "median").agg(F.expr("percentile(abs(v - median), 0.5)").alias("mad"))
    return out.withColumn("median_mad", F.when(F.col("mad") > 0, F.col("median") / F.col("mad")))


def patch_stats(px: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Statistics of square patches of each image; the deviation is from the median of all."""
    cut = px.withColumn("px", F.floor(F.col("x") / size).cast("int")).withColumn("py", F.floor(F.col("y") / size).cast("int"))
    overall = px.agg(F.expr("percentile(v, 0.5)").alias("_m"))
    q = lambda p: F.expr(f"percentile(v, {p})")
    return cut.join(F.broadcast(overall)).groupBy(*keys, "px", "py").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), q(0.5).alias("median"), q(0.01).alias("quantile_low"),
        q(0.99).alias("quantile_high"), F.max("v").alias("max"), F.min("v").alias("min"), F.expr("percentile(abs(v - _m), 0.5)").alias("mad"),
    )


def otsu_threshold(px: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """Threshold of each image that parts its histogram with the largest variance between the parts.

    An image of one value has that value as threshold.
    """
    ends = px.groupBy(*keys).agg(F.min("v").cast("double").alias("a"), F.max("v").cast("double").alias("b"))
    w = (F.col("b") - F.col("a")) / bins
    at = F.when(w > 0, F.least(F.floor((F.col("v") - F.col("a")) / w), F.lit(bins - 1))).otherwise(0)
    h = px.join(ends, keys).groupBy(*keys, "a", "b", at.alias("bin")).agg(F.count("*").alias("n"))
    center = F.col("a") + w * (F.col("bin") + 0.5)
    up, all_ = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
    h = h.withColumn("c", center).withColumn("n1", F.sum("n").over(up)).withColumn("s1", F.sum(F.col("n") * F.col("c")).over(up))
    h = h.withColumn("nt", F.sum("n").over(all_)).withColumn("st", F.sum(F.col("n") * F.col("c")).over(all_))
    n2 = F.col("nt") - F.col("n1")
    d = F.col("s1") / F.col("n1") - (F.col("st") - F.col("s1")) / n2
    h = h.withColumn("between", F.when(n2 > 0, F.round(F.col("n1") * n2 * d * d, 3)).otherwise(-1.0))
    best = h.groupBy(*keys).agg(F.max(F.struct("between", (-F.col("bin")).alias("b"), "c")).alias("m"), F.any_value("a").alias("a"))
    return best.select(*keys, F.when(F.col("m.between") < 0, F.col("a")).otherwise(F.col("m.c")).alias("threshold"))


def foreground_filter(px: DataFrame, image: list[str], channel: str, least: float = 0.005) -> DataFrame:
    """(image, ratio): images with more than least of their channel maximum above its threshold."""
    top = px.groupBy(*image, "y", "x").agg(F.max("v").alias("v"))
    out = top.join(otsu_threshold(top, image), image).groupBy(*image).agg(F.avg((F.col("v") > F.col("threshold")).cast("double")).alias("ratio"))
    return out.where(F.col("ratio") > least)


def flatfield_average(fields: DataFrame) -> DataFrame:
    """Mean of the flat fields of all shards."""
    return fields.groupBy("ch", "y", "x").agg(F.avg("v").alias("flat"))


def flatfield_apply(px: DataFrame, flat: DataFrame) -> DataFrame:
    """Divides by the flat field and truncates; pixels without one stay."""
    out = px.join(flat, ["ch", "y", "x"], "left")
    return out.withColumn("v", F.when(F.col("flat") > 0, F.least(F.floor(F.col("v") / F.col("flat")), F.lit(65535))).otherwise(F.col("v")).cast("int")).drop("flat")


def background_subtract(px: DataFrame, background: DataFrame, keys: list[str]) -> DataFrame:
    """Subtracts the truncated background of each image, not below 0; NaN and null count 0."""
    bg = F.coalesce(F.when(~F.isnan("bg"), F.col("bg")), F.lit(0.0)).cast("int")
    return px.join(background, keys, "left").withColumn("v", F.greatest(F.col("v") - bg, F.lit(0))).drop("bg")


def z_profile(px: DataFrame, keys: list[str]) -> DataFrame:
    """Median by slice with the padded slice id."""
    return px.groupBy(*keys, "z").agg(F.expr("percentile(v, 0.5)").alias("median_value")).withColumn("z_slice", F.lpad((F.col("z") + 1).cast("string"), 2, "0"))


def percentile_rescale(px: DataFrame, keys: list[str], p: float, low: float, high: float, few: bool = False) -> DataFrame:
    """Maps the p and 1 - p percentiles of each image to low and high, clamped.

    few tells that the keys are few: their percentiles go to the rows then, not the rows to few tasks.
    """
    q = px.groupBy(*keys).agg(F.expr(f"percentile(v, array({p}, {1 - p}))").alias("_q"))
    a, b = F.col("_q")[0], F.col("_q")[1]
    s = F.least(F.greatest((F.col("v") - a) / F.when(b > a, b - a).otherwise(1.0), F.lit(0.0)), F.lit(1.0))
    return px.join(F.broadcast(q) if few else q, keys).withColumn("scaled", low + s * (high - low)).drop("_q")


def stitch_tiles(px: DataFrame, columns: int, width: int, height: int, overlap: int, keys: list[str]) -> DataFrame:
    """Tiles of a regular grid on one canvas, blended linearly where they overlap.

    px has tile (from 0, row by row), x, y, v. Weights fall from 1 to 1 / (overlap + 1)
    towards an edge that another tile shares.
    """
    col, row = F.col("tile") % columns, F.floor(F.col("tile") / columns)
    ramp = lambda p, n: F.least(F.lit(1.0), (F.least(p, n - 1 - p) + 1) / float(overlap + 1))
    w = ramp(F.col("x"), width) * ramp(F.col("y"), height)
    out = px.withColumn("w", w).withColumn("cx", (F.col("x") + col * (width - overlap)).cast("int")).withColumn("cy", (F.col("y") + row * (height - overlap)).cast("int"))
    return out.groupBy(*keys, "cy", "cx").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def downsample(px: DataFrame, k: int) -> DataFrame:
    return px.where((F.col("x") % k == 0) & (F.col("y") % k == 0))


def montage(px: DataFrame, columns: int, width: int, height: int, keys: list[str] | None = None, channels: list | None = None) -> DataFrame:
    """All wells on one canvas for each of keys, row by row; channels become columns and missing pixels 0.

    Without channels given, all of px are found first.
    """
    keys = keys or []
    cx = F.col("x") + (F.col("well") % columns) * width
    cy = F.col("y") + F.floor(F.col("well") / columns) * height
    placed = px.select(*keys, cx.cast("int").alias("cx"), cy.cast("int").alias("cy"), "ch", "v")
    wide = placed.groupBy(*keys, "cy", "cx").pivot("ch", channels).agg(F.max("v"))
    return wide.na.fill(0, [c for c in wide.columns if c not in (*keys, "cy", "cx")])


#: Width of the tiles in which edges meet pixels, and points of edges looked up at once.
TILE, POINTS = 64, 1 << 20


def edge_path_profile(edges: DataFrame, px: DataFrame, keys: list[str], path_width: int = 4) -> DataFrame:
    """(keys, src, dst, step, intensity) along distinct edges (keys, src, dst, y0, x0, y1, x1).

    Step t is the mean over 2 * path_width points across the edge, t away from its
    start; each point takes its nearest pixel, and 0 outside the image. An edge
    goes to the tiles around it and a pixel to those that it may be seen from;
    the points are made in the task of a tile, which gives the steps inside it.
    """
    keys = list(keys)
    edges = edges.withColumn("_l", F.sqrt((F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")) + (F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")))).where("_l >= 1")
    e = edges.withColumn("_dy", (F.col("y1") - F.col("y0")) / F.col("_l")).withColumn("_dx", (F.col("x1") - F.col("x0")) / F.col("_l"))
    tile = lambda c: F.floor(c / F.lit(float(TILE)))
    for t, c in (("_ty", "y"), ("_tx", "x")):
        e = e.withColumn(t, F.explode(F.sequence(tile(F.least(f"{c}0", f"{c}1")), tile(F.greatest(f"{c}0", f"{c}1")))))
    at = [F.col(c).cast("double").alias(c) for c in ("y0", "x0")]
    e = e.select(*keys, "_ty", "_tx", "src", "dst", *at, "_dy", "_dx", F.floor("_l").cast("int").alias("_n"))
    p, reach = px.select(*keys, "y", "x", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v")), path_width + 1
    for t, c in (("_ty", "y"), ("_tx", "x")):
        p = p.withColumn(t, F.explode(F.sequence(tile(F.col(c) - reach), tile(F.col(c) + reach))))
    p = p.select(*keys, "_ty", "_tx", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    ddl = ", ".join([*[f"`{c}` {kinds[c]}" for c in (*keys, "src", "dst")], "step int", "intensity double"])
    schema, wide = to_arrow_schema(StructType.fromDDL(ddl)), TILE + 2 * reach

    def meet(left, right):
        if not left.num_rows:
            return schema.empty_table()
        left, column = left.combine_chunks(), lambda t, c: t.column(c).to_numpy()
        ty, tx = left.column("_ty")[0].as_py(), left.column("_tx")[0].as_py()
        low_y, low_x = ty * TILE - reach, tx * TILE - reach
        place = (column(right, "y") - low_y) * wide + column(right, "x") - low_x
        total = np.bincount(place, column(right, "v"), wide * wide)
        rows = np.maximum(np.bincount(place, minlength=wide * wide), 1)
        n = column(left, "_n").astype(np.int64)
        ends, s, found = np.cumsum(n), np.arange(-path_width, path_width), []
        size = max(POINTS // (2 * path_width), 1)
        for lo in range(0, int(ends[-1]), size):  # steps of all edges, one after another
            step = np.arange(lo, min(lo + size, int(ends[-1])))
            edge = np.searchsorted(ends, step, "right")
            step = step - (ends - n)[edge]
            y0, x0, dy, dx = (column(left, c)[edge] for c in ("y0", "x0", "_dy", "_dx"))
            cy, cx = y0 + step * dy, x0 + step * dx
            here = (np.floor(cy / TILE) == ty) & (np.floor(cx / TILE) == tx)
            edge, step, cy, cx, dy, dx = (c[here] for c in (edge, step, cy, cx, dy, dx))
            y = np.floor(cy[:, None] + s * dx[:, None] + 0.5).astype(np.int64) - low_y
            x = np.floor(cx[:, None] - s * dy[:, None] + 0.5).astype(np.int64) - low_x
            spot = y * wide + x
            found.append((edge, step, total[spot].sum(axis=1) / rows[spot].sum(axis=1)))
        edge, step, mean = (np.concatenate(f) for f in zip(*found))
        edge = pa.array(edge)
        columns = [left.column(c).take(edge) for c in (*keys, "src", "dst")]
        return pa.table([*columns, pa.array(step.astype(np.int32)), pa.array(mean)], names=schema.names).cast(schema)

    by = [*keys, "_ty", "_tx"]
    return e.groupBy(*by).cogroup(p.groupBy(*by)).applyInArrow(meet, ddl)


def laminar_message_passing(profiles: DataFrame, px: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, message): mean of a label's own log1p mean intensity and of log1p means of the profiles that leave it."""
    own = px.where("label > 0").groupBy(*keys, "label").agg(F.log1p(F.avg("v")).alias("m"))
    out = profiles.groupBy(*keys, F.col("src").alias("label"), "dst").agg(F.log1p(F.avg("intensity")).alias("m")).drop("dst")
    return own.unionByName(out).groupBy(*keys, "label").agg(F.avg("m").alias("message"))


def patches(positions: DataFrame, px: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, label, patch): size by size pixels around each position, row by row; 0 outside the image."""
    at = F.sequence(F.lit(-(size // 2)), F.lit(size - size // 2 - 1))
    p = positions.withColumn("_dy", F.explode(at)).withColumn("_dx", F.explode(at))
    p = p.select(*keys, "label", "_dy", "_dx", (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x"))
    met = p.join(px.select(*keys, "y", "x", "v"), [*keys, "y", "x"], "left")
    cell = F.struct("_dy", "_dx", F.coalesce("v", F.lit(0)).cast("float").alias("v"))
    return met.groupBy(*keys, "label").agg(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["v"]).alias("patch"))


def regionprops(px: DataFrame, keys: list[str]) -> DataFrame:
    """Area, centroid, axis lengths and eccentricity of each label, from second central moments.

    The moments add a twelfth for the extent of a pixel. Background (0) is left out.
    """
    m = px.where("label > 0").groupBy(*keys, "label").agg(
        F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        (F.var_pop("y") + 1 / 12).alias("yy"), (F.var_pop("x") + 1 / 12).alias("xx"), F.covar_pop("y", "x").alias("xy"),
        F.avg("v").alias("intensity_mean"),
    )
    half, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt(4 * F.col("xy") * F.col("xy") + (F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy"))) / 2
    l1, l2 = half + root, F.greatest(half - root, F.lit(0.0))
    return m.select(*keys, "label", "area", "cy", "cx", (4 * F.sqrt(l1)).alias("major_axis_length"), (4 * F.sqrt(l2)).alias("minor_axis_length"), F.sqrt(1 - l2 / l1).alias("eccentricity"), "intensity_mean")


def positions(px: DataFrame, keys: list[str]) -> DataFrame:
    """Label centroids rounded half to even."""
    return px.where("label > 0").groupBy(*keys, "label").agg(F.bround(F.avg("y")).cast("int").alias("y"), F.bround(F.avg("x")).cast("int").alias("x"))


def radial_profile(centers: DataFrame, px: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Mean intensity by truncated distance from each centre, 0 where no pixel lies.

    Pixels and centres meet by tiles as wide as the radius.
    """
    t = radius + 1
    a = centers.select(*keys, F.col("label").alias("center"), F.col("y").alias("y0"), F.col("x").alias("x0"))
    for c in ("y", "x"):
        a = a.withColumn(f"t{c}", F.explode(F.array(*[F.floor(F.col(f"{c}0") / t) + d for d in (-1, 0, 1)])))
    b = px.select(*keys, "y", "x", "v", F.floor(F.col("y") / t).alias("ty"), F.floor(F.col("x") / t).alias("tx"))
    dy, dx = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    near = a.join(b, [*keys, "ty", "tx"]).where((dy >= -radius) & (dy < radius) & (dx >= -radius) & (dx < radius))
    near = near.withColumn("radial_position", F.floor(F.sqrt(dy * dy + dx * dx)).cast("int")).where(F.col("radial_position") <= radius)
    means = near.groupBy(*keys, "center", "radial_position").agg(F.avg("v").alias("intensity"))
    grid = centers.select(*keys, F.col("label").alias("center"), F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("radial_position"))
    return grid.join(means, [*keys, "center", "radial_position"], "left").na.fill(0.0, ["intensity"])


def grid_positions(px: DataFrame, keys: list[str], step: int) -> DataFrame:
    """A raster of centres every step pixels over each image; labels number them row by row."""
    size = px.groupBy(*keys).agg(F.max("y").alias("h"), F.max("x").alias("w"))
    g = size.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h"), F.lit(step)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w"), F.lit(step))))
    return g.select(*keys, (F.col("y") * 100_000 + F.col("x")).cast("long").alias("label"), "y", "x")


def offset_labels(px: DataFrame, keys: list[str]) -> DataFrame:
    """Labels made unique over slices by adding the largest labels of the slices before."""
    top = px.groupBy(*keys, "z").agg(F.max("label").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*keys).orderBy("z").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return px.join(top.withColumn("offset", before).drop("m"), [*keys, "z"]).withColumn("label", F.when(F.col("label") > 0, F.col("label") + F.col("offset")).otherwise(0)).drop("offset")


def contingency(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap in pixels of label pairs, per slice and (z null) in all; pairs with background are left out."""
    j = a.select(*keys, "z", "y", "x", F.col("label").alias("gt")).join(b.select(*keys, "z", "y", "x", F.col("label").alias("pred")), [*keys, "z", "y", "x"])
    j = j.where("gt > 0 and pred > 0")
    each = j.groupBy(*keys, "gt", "pred", "z").agg(F.count("*").alias("n"))
    return each.unionByName(each.groupBy(*keys, "gt", "pred").agg(F.sum("n").alias("n")).withColumn("z", F.lit(None).cast("int")))


def stitch_labels_3d(px: DataFrame, keys: list[str], least: float = 0.25) -> DataFrame:
    """(keys, z, label, object): labels of neighbouring slices linked by their best overlap of least or more."""
    px = px.where("label > 0")
    area = px.groupBy(*keys, "z", "label").agg(F.count("*").alias("area"))
    a = px.select(*keys, "z", "y", "x", "label")
    b = px.select(*keys, (F.col("z") - 1).alias("z"), "y", "x", F.col("label").alias("next"))
    both = a.join(b, [*keys, "z", "y", "x"]).groupBy(*keys, "z", "label", "next").agg(F.count("*").alias("n"))
    both = both.join(area, [*keys, "z", "label"]).join(area.select(*keys, (F.col("z") - 1).alias("z"), F.col("label").alias("next"), F.col("area").alias("area2")), [*keys, "z", "next"])
    both = both.withColumn("iou", F.col("n") / (F.col("area") + F.col("area2") - F.col("n"))).where(F.col("iou") >= least)
    best = both.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "z", "next").orderBy(F.desc("iou"), "label"))).where("r = 1")
    name = lambda z, x: F.concat_ws("|", *keys, F.lpad(z.cast("string"), 4, "0"), F.lpad(x.cast("string"), 6, "0"))
    edges = best.select(name(F.col("z"), F.col("label")).alias("src"), name(F.col("z") + 1, F.col("next")).alias("dst"))
    part = connected_components(edges)
    nodes = area.withColumn("node", name(F.col("z"), F.col("label")))
    return nodes.join(part, "node", "left").select(*keys, "z", "label", F.coalesce("component", "node").alias("object"))


def single_slice_labels(px: DataFrame, keys: list[str], slices: int = 2) -> DataFrame:
    """Labels seen in slices slices or more."""
    return px.where("label > 0").groupBy(*keys, "label").agg(F.countDistinct("z").alias("n")).where(F.col("n") >= slices).drop("n")


def label_runs(px: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, z, label, y, x0, x1): unbroken runs of a label's pixels in each row."""
    row = [*keys, "z", "label", "y"]
    island = F.col("x") - F.row_number().over(Window.partitionBy(*row).orderBy("x"))
    return px.where("label > 0").select(*row, "x").withColumn("_i", island).groupBy(*row, "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i")


def split_disconnected(px: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, z, label, y, x0, x1, part): runs of labels with the part they belong to, by eight neighbours.

    Parts of a label are numbered from 1 in the order of their first pixel.
    Runs are the nodes of the graph, and two of neighbouring rows have an edge
    where they overlap or touch at a corner, so its size follows the outlines of labels
    and not their areas. A node is two numbers: a hash of the group and its place.
    """
    group = [*keys, "z", "label"]
    place = lambda y: F.struct(F.xxhash64(*group).alias("g"), (y.cast("long") * (1 << 32) + F.col("x0")).alias("p"))
    runs = durable(label_runs(px, keys).withColumn("node", place(F.col("y"))))
    below = runs.select(*group, (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("node").alias("dst"))
    edges = runs.join(below, [*group, "y"]).where("x0 <= b1 + 1 and b0 <= x1 + 1").select(F.col("node").alias("src"), "dst")
    root = F.coalesce("component", "node")
    named = runs.join(connected_components(edges).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(*group, "y", "x0", "x1", root.alias("root"))
    number = named.select(*group, "root").distinct().withColumn("part", F.row_number().over(Window.partitionBy(*group).orderBy("root")))
    return named.join(number, [*group, "root"]).drop("root")


def instance_metrics(table: DataFrame, gt: DataFrame, pred: DataFrame, taus: list[float]) -> DataFrame:
    """Counts and scores of predicted labels against true ones at thresholds of 0.5 or more.

    table has (gt, pred, n), gt and pred (label, area). At these thresholds a
    label has one partner at most, so no assignment is needed.
    """
    if min(taus) < 0.5:
        raise ValueError("thresholds under 0.5 need an optimal assignment")
    j = table.join(gt.select(F.col("label").alias("gt"), F.col("area").alias("a")), "gt").join(pred.select(F.col("label").alias("pred"), F.col("area").alias("b")), "pred")
    j = j.withColumn("iou", F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).withColumn("tau", F.explode(F.array(*map(F.lit, taus)))).where("iou > tau")
    hit = j.groupBy("tau").agg(F.count("*").alias("tp"), F.sum("iou").alias("sum_iou"))
    sizes = gt.agg(F.count("*").alias("n_gt")).join(F.broadcast(pred.agg(F.count("*").alias("n_pred"))))
    out = sizes.withColumn("tau", F.explode(F.array(*map(F.lit, taus)))).join(hit, "tau", "left").na.fill(0, ["tp", "sum_iou"])
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_gt") - F.col("tp")
    return out.select("tau", "n_gt", "n_pred", "tp", fp.alias("fp"), fn.alias("fn"), (F.col("tp") / F.col("n_pred")).alias("precision"), (F.col("tp") / F.col("n_gt")).alias("recall"),
        (2 * F.col("tp") / (F.col("n_gt") + F.col("n_pred"))).alias("f1"), (F.col("tp") / (F.col("tp") + fp + fn)).alias("ap"), (F.col("sum_iou") / (F.col("tp") + 0.5 * fp + 0.5 * fn)).alias("pq"))
