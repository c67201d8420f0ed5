"""The registered queries of the text operators, with production parameters over whole tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, dedup, langid, logbloom, packing, pages, phrases, quality, topk, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document by the unigram base and by bigrams from the filter."""
    return logbloom.score_texts(table(spark, sf_dir, "documents"))


def op2_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the classifier trained on the label model's posteriors."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page along its host's winning path."""
    found = pages.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def op5_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotations, in the reply order of its conversation."""
    return chat.reply_order(table(spark, sf_dir, "conversations"))


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates at a similarity of 0.8."""
    classes, _ = dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return classes


def op7_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return topk.top_products(table(spark, sf_dir, "embeddings"))


def op8_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by kernel ridge regression on landmarks."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every document through the byte-level vocabulary."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the label model's verdict for every document."""
    q = quality.quality_posterior(table(spark, sf_dir, "documents"))
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return q.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality",
    )


def op11_trie_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two thousand best phrases of each language."""
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def op12_walsh_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of the vectors by three rounds of exact integer means."""
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by the rules, else by its path template."""
    return urls.judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_log_frequency_bloom": op1_log_frequency_bloom,
    "op2_weak_toxicity": op2_weak_toxicity,
    "op3_packing": op3_packing,
    "op4_consensus_paths": op4_consensus_paths,
    "op5_quotation_links": op5_quotation_links,
    "op6_bag_minhash": op6_bag_minhash,
    "op7_norm_buckets": op7_norm_buckets,
    "op8_string_kernel": op8_string_kernel,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_rules": op10_quality_rules,
    "op11_trie_phrases": op11_trie_phrases,
    "op12_walsh_centroids": op12_walsh_centroids,
    "op13_url_templates": op13_url_templates,
}
#: Where SQL can say the same. DuckDB needs doubles for list_dot_product; the sums are whole numbers that doubles hold.
ORACLE_SQL: dict[str, str] = {
    "op11_trie_phrases": phrases.oracle_sql(),
    "op12_walsh_centroids": centroids.oracle_sql(),
    "op13_url_templates": urls.oracle_sql(),
    "op7_norm_buckets": """
with v as (
  select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)) x from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda e: e is null or not isfinite(e::double))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
}
