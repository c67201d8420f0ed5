import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_columns_and_shrink(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns
        assert 0 < out.count() <= seen
        docs, seen = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == seen


def test_stages_decide_by_row(spark):
    """Null and repeated ids are documents like others: each stage keeps the same texts as under unique ids."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("text").rlike("[a-z]")).orderBy("doc_id").limit(100)
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).when(F.col("doc_id") % 3 == 1, F.col("doc_id") - 1))
    odd, docs = odd.union(odd).cache(), docs.union(docs).cache()
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    texts = lambda df: {r.text for r in df.collect()}
    assert texts(corpus_pipeline.quality_rules(spark, odd, sf)) == texts(kept)
    spoken = corpus_pipeline.language(spark, odd, sf)
    assert spoken.where("doc_id is null").count() > 20
    rows = corpus_pipeline.near_duplicates(spark, odd, sf).collect()
    seen = corpus_pipeline.near_duplicates(spark, docs, sf).count()
    assert len(rows) == len({r.text for r in rows}) == seen


def test_run_over_an_empty_table_and_odd_rows(spark):
    """Empty tables give empty results; nulls, repeats and clashing columns go through the stages."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
    good = [r.text for r in docs.where("lang = 'en' and n_chars between 400 and 2000").orderBy("doc_id").limit(30).collect()]
    rows = [(i, t, "en", None, 0) for i, t in enumerate(good)] + [(3, good[4], "en", None, 0), (None, good[5], None, None, 0), (7, good[7], "en", None, 0), (50, None, None, None, 0), (51, "", None, None, 0), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("row", "votes", "quality", "score", "vid", "rep", "id")})
    kept = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == odd.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) == len({t for _, t in got}) and all(t for _, t in got)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf).select("doc_id").distinct().count() == len({i for i, _ in got})


def test_near_duplicates_keep_one_of_each_class(spark):
    """Against brute force over all pairs: of each class the row with the smallest id stays, once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(trim(text)) > 0")
    rows = {r.doc_id: r.text for r in docs.collect()}

    def bag(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return Counter(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else Counter([tuple(w)])

    bags, part = {i: bag(t) for i, t in rows.items()}, {i: i for i in rows}
    for i in sorted(rows):
        for j in sorted(rows):
            if i < j and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = {k: new if v == old else v for k, v in part.items()}
    kept = corpus_pipeline.near_duplicates(spark, docs.union(docs), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(part.values()))
