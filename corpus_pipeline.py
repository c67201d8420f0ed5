"""A training corpus from raw documents: quality rules, language, near duplicates, packing.

Each stage takes all that the one before kept. Documents are rows: null ids,
repeated ids and repeated rows are judged like others, and verdicts travel with
the row. Null and empty texts have no words and go at the first stage; an empty
table gives empty results; further columns of documents go through. The first
three give the columns of documents; the last gives the pieces of packed
sequences. STAGES are written and read again between stages by whoever runs
them one by one; run() cuts the lineage between them in the same way.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm import common, dedup, langid, packing, quality
from wellspring.session import durable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model over the quality rules holds for good; those without words go."""
    return quality.rows_with_quality(docs).where("quality >= 0.5").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not und, and with a score of 0.5 or more."""
    scorer = langid.fit(docs.where(common.id_bucket("doc_id", 5) != 0))
    return langid.rows_with_language(docs, scorer).where("lang_pred <> 'und' and score >= 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id, once, whatever else has this id."""
    first = durable(dedup.representatives(docs))
    rows = docs.select(F.struct(*docs.columns).alias("row"))

    def standing(which):
        rep = first.where(which).select("doc_id", "vid")
        return rows.join(rep, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("vid")), "left_semi")

    several = standing("repeated").groupBy("row.doc_id", F.xxhash64("row.text")).agg(F.first("row").alias("row"))
    return standing("not repeated").union(several.select("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language", language),
    ("near duplicates", near_duplicates),
    ("packing", pack),
]

#: SQL cannot express the label model, the kernel classifier or the signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
