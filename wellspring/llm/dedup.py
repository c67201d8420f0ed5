"""Near duplicates by BagMinHash over the multiset of word shingles.

A text is the multiset of its five-word shingles. For every unit of weight of
every shingle a Poisson process throws points in time over the components of
the signature; a component keeps its first point. Processes belong to dyadic
intervals of weight, each split down to the part under the actual weight, so a
shingle that occurs w times takes part with weight w at a cost of log(w). Two
texts agree in a component with probability equal to their weighted Jaccard
similarity. Signatures are banded; pairs from the bands are verified exactly.
"""

import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.graph import connected_components
from ..session import durable
from . import common
from .packing import Memo

SIZE = 5
BANDS, ROWS = 20, 5
_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_U = np.uint64
_state: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and where each text ends."""
    if "words" not in _state:
        import xxhash

        _state["words"] = Memo(lambda w: xxhash.xxh3_64_intdigest(w), 500_000)
    get = _state["words"].__getitem__
    split = [_words(t.lower()) for t in texts]
    ends = np.cumsum([len(s) for s in split], dtype=np.int64)
    flat = np.fromiter((get(w) for s in split for w in s), dtype=np.uint64, count=int(ends[-1]) if len(ends) else 0)
    return flat, ends


def shingle_bags(texts: list[str], size: int = SIZE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes and their counts for each text.

    A text of fewer than size words, but one at least, is one shingle.
    """
    flat, ends = word_hashes(texts)
    run = np.zeros(len(flat), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            run[: len(flat) - k] = run[: len(flat) - k] * _U(0x9E3779B97F4A7C15) + mix(flat[k:])
        run = mix(run)
        out, lo = [], 0
        for hi in ends.tolist():
            if hi - lo >= size:
                out.append(np.unique(run[lo : hi - size + 1], return_counts=True))
            elif hi > lo:
                h = _U(hi - lo)
                for w in flat[lo:hi]:
                    h = mix(h * _U(0x9E3779B97F4A7C15) + w)
                out.append((np.array([h], dtype=np.uint64), np.ones(1, dtype=np.int64)))
            else:
                out.append((np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)))
            lo = hi
    return out


def bag_min_hash(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """Signatures [bag, m] of unsigned 64-bit integers; all zero for an empty bag."""
    n = len(bags)
    sizes = np.array([len(h) for h, _ in bags], dtype=np.int64)
    doc = np.repeat(np.arange(n), sizes)
    element = np.concatenate([h for h, _ in bags]) if n else np.empty(0, np.uint64)
    weight = np.concatenate([w for _, w in bags]) if n else np.empty(0, np.int64)
    total = np.bincount(doc, weights=weight, minlength=n) if len(doc) else np.zeros(n)
    streams, level, at = [], 0, np.arange(len(doc))
    while len(at):  # level 0 is the interval [0, 1) of weight, level j [2^(j-1), 2^j)
        streams.append((at, np.full(len(at), level)))
        at = at[weight[at] > (1 << level)]
        level += 1
    if not streams:
        return np.zeros((n, m), dtype=np.uint64)
    at = np.concatenate([a for a, _ in streams])
    level = np.concatenate([x for _, x in streams])
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(float)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(float)
    owner, part = doc[at], weight[at].astype(float)
    whole = low + width <= part
    seed = mix(element[at] + level.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    rate = width * m

    def draw(which, salt):
        return mix(seed[which] + _U(salt) * _U(0xD1342543DE82EF95))

    def gap(which, k):
        u = ((draw(which, 3 * k + 1) >> _U(11)).astype(float) + 1) * 2.0**-53
        return -np.log(u) / rate[which]

    first = np.full(n * m, np.inf)
    limit = np.where(total > 0, (np.log(m) + 2.0) / np.maximum(total, 1e-300), 0.0)
    time = gap(slice(None), 0)
    step = np.zeros(len(at), dtype=np.int64)
    with np.errstate(over="ignore"):
        todo = np.flatnonzero(time <= limit[owner])
        while True:
            while len(todo):
                k = step[todo].astype(np.uint64)
                pick = mix(seed[todo] + (k * _U(3) + _U(2)) * _U(0xD1342543DE82EF95))
                slot = (pick >> _U(33)).astype(np.int64) % m
                place = mix(seed[todo] + (k * _U(3) + _U(3)) * _U(0xD1342543DE82EF95))
                inside = whole[todo] | (low[todo] + width[todo] * ((place >> _U(11)).astype(float) * 2.0**-53) < part[todo])
                np.minimum.at(first, owner[todo[inside]] * m + slot[inside], time[todo[inside]])
                step[todo] += 1
                k = step[todo].astype(np.uint64)
                u = mix(seed[todo] + (k * _U(3) + _U(1)) * _U(0xD1342543DE82EF95))
                time[todo] += -np.log(((u >> _U(11)).astype(float) + 1) * 2.0**-53) / rate[todo]
                todo = todo[time[todo] <= limit[owner[todo]]]
            bare = np.isinf(first.reshape(n, m)).any(axis=1) & (total > 0)
            if not bare.any():
                break
            limit[bare] *= 2
            todo = np.flatnonzero(bare[owner] & (time <= limit[owner]))
    out = first.reshape(n, m)
    out[total == 0] = 0.0
    return mix(out.view(np.uint64))


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    with np.errstate(over="ignore"):
        parts = signatures.reshape(len(signatures), bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
        for r in range(rows):
            key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def bag_overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    most = int(a[1].sum() + b[1].sum()) - least
    return least / most if most else 0.0


def _bands(src: DataFrame) -> DataFrame:
    """(id, vid, bands) of rows (id, vid, text); bands is null for a text without words."""

    def run(rows):
        sig = bag_min_hash(shingle_bags([t or "" for t in rows["text"]]), BANDS * ROWS)
        keys = band_keys(sig)
        empty = ~sig.any(axis=1) | [not _words(t or "") for t in rows["text"]]
        return {"id": rows["id"], "vid": rows["vid"], "bands": [None if e else k for k, e in zip(keys, empty)]}

    kind = src.schema["id"].dataType.simpleString()
    return common.map_text_chunks(src, run, f"id {kind}, vid long, bands array<long>", "text")


def _bags(src: DataFrame) -> DataFrame:
    """(vid, shingles, counts) of rows (vid, text), once for each vid; counts is null if all are 1."""

    def run(rows):
        bags = shingle_bags([t or "" for t in rows["text"]])
        return {
            "vid": rows["vid"],
            "shingles": [h.view(np.int64) for h, _ in bags],
            "counts": [None if (w == 1).all() else w for _, w in bags],
        }

    bags = common.map_text_chunks(src.select("vid", "text"), run, "vid long, shingles array<long>, counts array<int>", "text")
    return bags.groupBy("vid").agg(F.first(F.struct("shingles", "counts")).alias("b")).select("vid", "b.shingles", "b.counts")


def _with_bags(pairs: DataFrame, bags: DataFrame, fn, schema: str) -> DataFrame:
    """Columns that fn gives for each pair (v, p) from the bags of both; schema names them after v and p."""
    left = bags.select(F.col("vid").alias("v"), F.col("shingles").alias("s1"), F.col("counts").alias("c1"))
    right = bags.select(F.col("vid").alias("p"), F.col("shingles").alias("s2"), F.col("counts").alias("c2"))
    want = to_arrow_schema(StructType.fromDDL("v long, p long, " + schema))

    def bag(batch, row, s, c):
        h = batch.column(s)[row].values.to_numpy().view(np.uint64)
        w = batch.column(c)[row]
        return h, w.values.to_numpy().astype(np.int64) if w.is_valid else np.ones(len(h), dtype=np.int64)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):  # what fn gives may be as large as the bags
                part = b.slice(lo, 512)
                got = [fn(bag(part, i, "s1", "c1"), bag(part, i, "s2", "c2")) for i in range(part.num_rows)]
                columns = [pa.array(x, type=f.type) for x, f in zip(zip(*got), list(want)[2:])]
                yield pa.RecordBatch.from_arrays([part.column("v"), part.column("p"), *columns], schema=want)

    return pairs.join(left, "v").join(right, "p").mapInArrow(run, "v long, p long, " + schema)


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Pairs (v, p) with the overlap of their bags: (v, p, similarity)."""
    return _with_bags(pairs, bags, lambda a, b: (bag_overlap(a, b),), "similarity double")


def difference(x: tuple[np.ndarray, np.ndarray], pivot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """How bag x differs from a pivot: hashes of the units of weight that it has more or lacks, and its own weight."""
    keys = np.concatenate((x[0], pivot[0]))
    keys, at = np.unique(keys, return_inverse=True)
    change = np.bincount(at, weights=np.concatenate((x[1], -pivot[1])), minlength=len(keys)).astype(np.int64)
    keys, change = keys[change != 0], change[change != 0]
    size = np.abs(change)
    unit = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        seed = mix(keys * _U(2) + (change < 0).astype(np.uint64) * _U(0xA0761D6478BD642F))
        units = mix(np.repeat(seed, size) + unit.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return units.view(np.int64), int(x[1].sum())


class _Search:
    """Links between texts that share a bucket: rows (key, vid, c) of buckets, c being how central the text is."""

    #: After its second pivot a bucket with no more open rows than this, or of which a round closed less than this part, gets none.
    CROWD, PART = 32, 16

    def __init__(self, members: DataFrame, bags: DataFrame, least: float):
        self.members, self.bags, self.least = members, bags, least
        self.tested = None

    @property
    def links(self) -> DataFrame:
        return self.tested.where(F.col("similarity") >= self.least)

    def _test(self, pairs: DataFrame) -> None:
        """Verify pairs (v, p) that are new."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["v", "p"], "left_anti")
        found = durable(_verified(pairs, self.bags))
        self.tested = found if self.tested is None else self.tested.union(found)

    def pivots(self) -> DataFrame:
        """Meet pivots in rounds; what is left to compare: (key, p, v, far, near).

        In a round each bucket's most central open member meets all others that
        are open; those that link close. Two that close in one round are of one
        class. Left are pairs of a row that did not link to p (far) with one
        that did (near). Rows that never link are left to each other too, as
        near ones, at that pivot of their bucket to which they are nearest.
        """
        rows, met = self.members, None
        while True:
            best = rows.groupBy("key").agg(F.max(F.struct("c", "vid"))["vid"].alias("p"))
            now = rows.join(best, "key").where("vid <> p").select("key", F.col("vid").alias("v"), "p", "c")
            self._test(now.select("v", "p").distinct())
            now = durable(now.join(self.tested, ["v", "p"]).withColumn("far", F.col("similarity") < self.least))
            fate = now.groupBy("key").agg(F.count_if("far").alias("open"), F.count("*").alias("n"))
            crowd = (F.col("open") > self.CROWD) & ((F.col("n") - F.col("open")) * self.PART >= F.col("n"))
            on = fate.where(crowd | F.lit(met is None) & (F.col("open") > 1)).select("key", F.lit(False).alias("last"))
            now = now.join(on, "key", "left").fillna(True, "last")
            rows = durable(now.where("far and not last").select("key", F.col("v").alias("vid"), "c"))
            met = now if met is None else met.unionByName(now)
            if rows.isEmpty():
                break
        alone = met.where("far and last").select("key", "v")
        nearest = met.join(alone, ["key", "v"], "left_semi").groupBy("key", "p").agg(F.avg("similarity").alias("s"))
        nearest = nearest.groupBy("key").agg(F.max(F.struct("s", "p"))["p"].alias("p"))
        alone = durable(alone.join(nearest, "key").select("key", "v", "p", F.lit(True).alias("near")))
        left = met.select("key", "p", "v", "far").join(alone, ["key", "v", "p"], "left")
        return left.select("key", "p", "v", "far", (F.col("near").isNotNull() | ~F.col("far")).alias("near"))

    def homes(self) -> DataFrame:
        """(v, home): the pivot that a text links to, of several the one with most links. Texts of one home are of one class."""
        linked = self.links.select("v", "p").union(self.links.select("p", "p")).distinct()
        times = durable(linked.groupBy("p").agg(F.count("*").alias("n")))
        return durable(linked.join(times, "p").groupBy("v").agg(F.max(F.struct("n", "p"))["p"].alias("home")))

    def complete(self, left: DataFrame) -> None:
        """Verify what pivots left: pairs that have no common home, of which one is far and one near.

        Let d be the number of units in which a bag of weight n differs from
        the pivot, c = (1 - least) / (1 + least), and e = d - c n. Bags x and y
        link if they differ in at most c (n_x + n_y) units, and they differ in
        d_x + d_y - 2 s, where s units are in both differences. So they link if
        s >= (e_x + e_y) / 2, which is above 0 as one is far. Then of the near
        one's units, in whatever order, one among the first d - s + 1 is shared.
        Units that few other far bags hold stand first, so bags that differ from the
        pivot each in their own way never meet. For a bag the bound on s is by
        the least e of the other side, for a pair by both. Of two bags that are
        both far and near, that of smaller e is the near one, so what it meets
        has no smaller e than its own. Units that one bag alone holds are not
        spelled out again, as they are shared with nobody. Only whole numbers
        are compared, so no pair at the threshold is lost.
        """
        least = Fraction(str(self.least))
        low, high = least.denominator - least.numerator, least.denominator + least.numerator
        left = left.join(self.homes(), "v", "left").withColumn("home", F.coalesce("home", "v"))
        bucket = left.groupBy("key", "p").agg(F.max("far").alias("far"), F.max("near").alias("near"), F.min("home").alias("a"), F.max("home").alias("b"))
        unsure = durable(bucket.where("far and near and a < b").select("key", "p"))
        rows = left.join(unsure, ["key", "p"], "left_semi").groupBy("v", "p", "home").agg(F.max("far").alias("far"), F.max("near").alias("near"))
        apart = _with_bags(rows.select("v", "p"), self.bags, difference, "units array<long>, n long")
        apart = durable(apart.select("v", "p", "units", F.size("units").alias("d"), (high * F.size("units") - low * F.col("n")).alias("e")))
        units = apart.select("p", "v", F.explode("units").alias("unit"))
        alone = units.groupBy("p", "unit").agg(F.count("*").alias("times"), F.min("v").alias("v")).where("times = 1")
        alone = alone.groupBy("p", "v").agg(F.collect_list("unit").alias("alone"))
        shared = F.when(F.col("alone").isNull(), F.col("units")).otherwise(F.array_except("units", "alone"))
        rows = apart.join(rows, ["v", "p"]).join(alone, ["v", "p"], "left").withColumns({"units": shared, "both": F.col("far") & F.col("near")})
        whole = rows = durable(rows.drop("alone"), replaces=(apart,))
        for role, other in (("far", "near"), ("near", "far")):  # what one side loses tightens the other's bound
            ends = rows.where(other).groupBy("p").agg(F.min("e").alias("any_e"), F.min(F.when(~F.col("both"), F.col("e"))).alias("one_e"))
            end = F.when(F.col("both"), F.least("one_e", "e")).otherwise(F.col("any_e")) if role == "near" else F.col("any_e")
            s = F.greatest(F.lit(1), F.ceil((F.col("e") + end) / (2 * high) - 1e-9))
            able = F.col(role) & F.col("any_e").isNotNull() & (F.size("units") >= s)
            rows = rows.join(durable(ends), "p", "left").withColumn("reach", F.when(able, F.col("d") - s + 1).otherwise(0))
            rows = rows.drop("any_e", "one_e").withColumn(role, F.col("reach") > 0)
        rows = durable(rows.where("far or near"), replaces=(whole,))

        def held(role, x):
            some = rows.where(role).select("p", "units", *(F.col(c).alias(x + c) for c in ("v", "home", "d", "e", "both", "reach")))
            return some.withColumn("unit", F.explode("units")).drop("units")

        times = held("far", "x_").groupBy("p", "unit").agg(F.count("*").alias("times"), F.min("x_v").alias("one"))
        order = held("near", "y_").join(durable(times), ["p", "unit"]).where((F.col("times") > 1) | (F.col("one") != F.col("y_v")))
        order = order.groupBy("p", "y_v", "y_home", "y_d", "y_e", "y_both", "y_reach").agg(F.sort_array(F.collect_list(F.struct("times", "unit"))).alias("u"))
        order = order.select("*", F.posexplode("u").alias("i", "found")).withColumn("rest", F.size("u") - F.col("i"))
        first = durable(order.where(F.col("y_d") - F.col("rest") < F.col("y_reach")).select("p", F.col("found.unit").alias("unit"), "y_v", "y_home", "y_e", "y_both", "rest"))
        pairs = first.join(held("far", "x_"), ["p", "unit"])
        pairs = pairs.where(~(F.col("x_both") & F.col("y_both")) | (F.struct("x_e", "x_v") > F.struct("y_e", "y_v")))
        pairs = pairs.where(F.col("x_home") != F.col("y_home")).where(2 * high * F.col("rest") >= F.col("x_e") + F.col("y_e"))
        pairs = pairs.select(F.greatest("x_v", "y_v").alias("v"), F.least("x_v", "y_v").alias("p")).distinct()
        back = self.tested.select(F.col("p").alias("v"), F.col("v").alias("p"))
        self._test(pairs.join(back, ["v", "p"], "left_anti"))


def _classified(src: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, vid, text): rows (id, vid, bands), texts (vid, rep, copies, component) and links (v, p, similarity).

    component is null for a text that links to none.
    """
    rows = durable(_bands(src))
    texts = durable(
        rows.where("bands is not null").groupBy("vid").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    )
    member = texts.select("vid", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    member = durable(member.join(shared, "key"))
    weight = member.groupBy("vid").agg(F.sum("n").alias("c"))
    member = member.select("key", "vid").join(weight, "vid")
    wanted = texts.select(F.col("vid").alias("v"), "rep").join(weight.select(F.col("vid").alias("v")), "v", "left_semi")
    bags = src.join(wanted, F.col("id").eqNullSafe(F.col("rep")) & (F.col("vid") == F.col("v")), "left_semi")
    search = _Search(member, durable(_bags(bags)), least)
    left = search.pivots()
    search.complete(left)
    same = connected_components(search.links, "v", "p")
    by_text = texts.select("vid", "rep", "copies").join(same, F.col("vid") == F.col("node"), "left")
    return rows, durable(by_text.select("vid", "rep", "copies", "component")), search.links


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("vid", F.xxhash64("text"))


def near_duplicates(
    df: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Classes of near duplicates: (id, class_id, class_size), and the links between texts.

    One row for each row of df. A class holds equal texts and texts linked by a
    chain of pairs whose bags of five-word shingles overlap by least or more;
    class_id is its smallest id, null if no row of it has one; class_size counts
    its rows, also where ids clash. Words are lower-cased. A row without words
    (null, empty, blank) is its own class, under its own id. Links are between
    one copy of each text: (v, p, similarity), by 64-bit hashes of the texts.

    Equal texts meet first, so a copied text costs one signature in the bands.
    In a bucket of the bands members are verified against the most central
    member (that with most neighbours over all its buckets), not against all.
    A crowd that fails meets further pivots. What is left are pairs of which
    one at least is not linked to the pivot; it can link only to texts that
    differ from the pivot in the same shingles, and these are found by their
    rarest common differences. So every pair of a bucket has met, is of one
    class, or is proved to overlap by less. No bucket is capped, gathered in a
    task, or spelled out in pairs.
    """
    rows, by_text, links = _classified(_source(df, id_col, text_col), least)
    classes = durable(by_text.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"), F.sum("copies").alias("size")))
    named = by_text.join(classes, "component", "left")
    named = durable(named.select("vid", F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("class_id"), F.coalesce("size", "copies").alias("class_size")))
    out = rows.select("id", F.when(F.col("bands").isNotNull(), F.col("vid")).alias("vid")).join(named, "vid", "left")
    own = F.col("class_size").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size")
    ), links


def representatives(df: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, vid, repeated) of the rows that stand for the classes of near_duplicates, vid being the xxhash64 of the text.

    Of a class that with the smallest id, null last, then the smallest vid;
    every id of each text without words. repeated tells whether df has several
    rows of this id and text.
    """
    rows, by_text, _ = _classified(_source(df, id_col, text_col), least)
    first = by_text.groupBy(F.coalesce("component", "vid")).agg(F.min(F.struct(F.col("rep").isNull(), "rep", "vid")).alias("x"))
    first = first.select(F.col("x.rep").alias("id"), "x.vid").union(rows.where("bands is null").select("id", "vid").distinct())
    twice = durable(rows.groupBy("id", "vid").agg(F.count("*").alias("n")).where("n > 1"))
    found = first.alias("f").join(twice.alias("t"), F.expr("f.id <=> t.id and f.vid = t.vid"), "left")
    return found.select(F.col("f.id").alias(id_col), F.col("f.vid").alias("vid"), F.col("n").isNotNull().alias("repeated"))
