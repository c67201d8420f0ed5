"""Queries on mixing of labels, discriminants, shards, correction plans and joined spatial features."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import embedding as E
from ..operators import benchmark as B
from ..operators import communities, graph, mixing
from ..operators.spatial_features import well_features
from ..session import durable
from ..sources.fixtures import nuclei, pixels, table, wells
from .registry import add
from .tables import FS, W

KL = ["plate_id", "well_id"]


def _knn(s, d, k=15):
    v = table(s, d, "embeddings")
    return E.vector_knn(v, v, k, "vec_id", "embedding"), v


add("m5_lisi", lambda s, d: (lambda k, v: mixing.lisi(k, v, "vec_id", "label", 5.0))(*_knn(s, d)), doubles="lisi", digits=4)


def _lisi_of(s, d, first, length):
    """LISI of labels among the 15 nearest by a part of the vectors."""
    v = table(s, d, "embeddings").select("vec_id", "label", F.slice("embedding", first, length).alias("v"))
    return mixing.lisi(E.vector_knn(v, v, 15, "vec_id", "v"), v, "vec_id", "label", 5.0)


add("m6_clisis", lambda s, d: mixing.clisis(_lisi_of(s, d, 4, 1000), _lisi_of(s, d, 1, 3), "vec_id", 10), doubles="clisis", digits=4)
_own = "(select a.vec_id src, a.label, b.vec_id % 3 b, row_number() over (partition by a.vec_id order by round(list_distance(a.embedding::double[], b.embedding::double[]), 12), b.vec_id) r from embeddings a join embeddings b on a.vec_id <> b.vec_id and a.label = b.label)"
_kbet = lambda s, d: mixing.kbet_by_label(table(s, d, "embeddings").withColumn("b", F.col("vec_id") % 3), "vec_id", "embedding", "label", "b")
add("m14_kbet_by_label", lambda s, d: _kbet(s, d).drop("accepted"),
    f"""with k as (select label, src, b, count(*) o from {_own} where r <= 15 group by all), n as (select label, src, sum(o) k from k group by all),
     t as (select label, vec_id % 3 b, count(*) / sum(count(*)) over (partition by label) sh from embeddings group by label, vec_id % 3)
     select label::varchar as label, avg(c) chi2 from (select n.label, n.src, sum((coalesce(o, 0) - n.k * sh) * (coalesce(o, 0) - n.k * sh) / (n.k * sh)) c from n join t on t.label = n.label left join k on k.src = n.src and k.b = t.b group by n.label, n.src) group by label""",
    "", "chi2", 5)
add("m14_kbet_accepted", lambda s, d: _kbet(s, d).drop("chi2"), doubles="accepted")
_nn = "(select a.vec_id src, b.vec_id dst, b.label % 3 b, row_number() over (partition by a.vec_id order by round(list_distance(a.embedding::double[], b.embedding::double[]), 12), b.vec_id) r from embeddings a join embeddings b on a.vec_id <> b.vec_id)"
add("m14_kbet", lambda s, d: (lambda k, v: mixing.kbet(k, v.withColumn("b", F.col("label") % 3), "vec_id", "b").drop("p"))(*_knn(s, d)),
    f"with k as (select src, b, count(*) o from {_nn} where r <= 15 group by all), t as (select label % 3 b, count(*) / (select count(*) from embeddings) sh from embeddings group by all) select g.src vec_id, sum((coalesce(o, 0) - 15 * sh) * (coalesce(o, 0) - 15 * sh) / (15 * sh)) chi2, (count(*) - 1)::double df from (select distinct src, t.b, sh from k, t) g left join k on k.src = g.src and k.b = g.b group by g.src", "", "chi2")
add("t15_lda", W(lambda w: mixing.lda_scores(w, "well_id", FS, "compound", "DMSO", "2-HIGH")), doubles="score", digits=5)
add("e3_ridge_regress_out", W(lambda w: mixing.ridge_regress_out(w.select("well_id", "plate_id", "timepoint", "f1"), ["plate_id", "timepoint"], "f1").select("well_id", "explained", "residual")), doubles="explained residual", digits=4)
add("e2_add_morphology", lambda s, d: nuclei(s, d).select("label", F.concat(F.array("f1", "f2"), F.array("f3", "f4")).alias("x")), "select label, [f1, f2, f3, f4] x from nuclei", "nuclei")
add("p10_shard_sample", lambda s, d: pixels(s, d).select("img", "ch").distinct().withColumn("shard", F.floor((F.row_number().over(Window.partitionBy("ch").orderBy(A.seeded_order(2, "img"))) - 1) / 4).cast("int")).where("shard < 5"), "select img, ch, shard from (select img, ch, ((row_number() over (partition by ch order by md5('2|' || img)) - 1) // 4)::int shard from (select distinct img, ch from pixels)) where shard < 5", "pixels")
add("p13_correction_plan", lambda s, d: pixels(s, d).select("well", "ch").distinct().select("well", "ch", F.when(F.col("ch") == 0, "additive").otherwise("multiplicative").alias("mode"), (F.col("well") % 2 == 0).alias("median_filter")), "select distinct well, ch, case when ch = 0 then 'additive' else 'multiplicative' end mode, well % 2 = 0 median_filter from pixels", "pixels")


add("g15_spatial_features", lambda s, d: well_features(nuclei(s, d), None, (15, 25), ("f1",), hull_radius=25.0, hull_degree=1), doubles="value", digits=4)


def neighbor_graph(s, d, column="embedding", k=8):
    """Undirected edges (src, dst, weight) between near vectors, each once; weight falls with distance."""
    v = table(s, d, "embeddings")
    v = v.select("vec_id", (F.slice("embedding", 1, 3) if column == "pos" else F.slice("embedding", 4, 1000) if column == "latent" else F.col("embedding")).alias("v"))
    near = E.vector_knn(v, v, k, "vec_id", "v")
    e = near.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (1 / (1 + F.col("dist"))).alias("weight"))
    return durable(e.groupBy("src", "dst").agg(F.max("weight").alias("weight")))


RESOLUTIONS = (0.5, 1.0, 2.0)


def _modularities(s, d):
    """(run, modularity) of the communities at each resolution, all at resolution 1."""
    e = neighbor_graph(s, d)
    part = durable(communities.communities_at(e, RESOLUTIONS))
    out = None
    for run in range(len(RESOLUTIONS)):
        m = graph.modularity(e, part.where(F.col("run") == run).drop("run")).select(F.lit(RESOLUTIONS[run]).alias("resolution"), "modularity")
        out = m if out is None else out.unionByName(m)
    return out


add("e10_communities", lambda s, d: communities.louvain_communities(neighbor_graph(s, d)))
add("e10_modularity", _modularities, doubles="modularity", digits=4)
add("m11_cnmi_cari", lambda s, d: E.clustering_agreement(communities.louvain_communities(neighbor_graph(s, d)).join(table(s, d, "embeddings").select(F.col("vec_id").alias("node"), "label"), "node"), "community", "label"), doubles="nmi ari", digits=4)
add("m8_mlami", lambda s, d: B.community_information(neighbor_graph(s, d, "latent"), neighbor_graph(s, d, "pos"), RESOLUTIONS), doubles="mlami", digits=4)
add("m9_nasw", lambda s, d: B.community_silhouette(table(s, d, "embeddings"), "vec_id", "embedding", neighbor_graph(s, d), RESOLUTIONS), doubles="nasw", digits=4)
