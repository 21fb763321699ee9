"""One query for each operator, over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, hard_negatives, jaccard_join, license_rules, pii_surrogates, quality_rules, resampling, sentencepiece_codec, source_mixing, token_counts, toxicity, url_filter
from .common import settle, table
from .oracles import ORACLES as ORACLES


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    found = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), keep=["doc_id"], check="round_trip")
    return found.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths of all documents with its suffix sums."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text; the model learns from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumn("held_out", toxicity.held_out()), model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9."""
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row stays of each group of equal texts."""
    found = exact_dedup.resolve(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return source_mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates for their entities; n_collisions: surrogates, in the whole table, that stand for
    several values (0, unless spellings differ in more than the canonical form knows).

    The key is the setting strandloom.pii.key, or a new one where that is unset. The originals are
    neither returned nor written: the check reads their keyed digests.
    """
    key = spark.conf.get("strandloom.pii.key", None) or secrets.token_hex(16)
    replaced = pii_surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    part = lambda f: F.transform("entities", f)
    digest = part(lambda e: F.sha2(F.concat(F.lit(key), pii_surrogates.canonical(e["kind"], e["original"])), 256))
    written = settle(replaced.select("doc_id", "text", part(lambda e: e["kind"]).alias("kinds"), part(lambda e: e["surrogate"]).alias("surrogates"), digest.alias("__digests")), "replaced")
    pairs = written.select(F.transform(F.arrays_zip("kinds", "surrogates", "__digests"), lambda x: F.struct(x["kinds"].alias("kind"), x["surrogates"].alias("surrogate"), x["__digests"].alias("value"))).alias("entities"))
    n_collisions = pii_surrogates.collisions(pairs).count()
    return written.select("doc_id", "text", F.size("kinds").alias("n_entities"), "kinds", "surrogates", F.lit(n_collisions).cast("long").alias("n_collisions"))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with a cosine of 0.95."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; each seventh row's label is one off."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark's words, and the ranks of those drawn."""
    return resampling.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filter": op5_url_filter,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_license_rules": op10_license_rules,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_importance_resampling": op13_importance_resampling,
}
