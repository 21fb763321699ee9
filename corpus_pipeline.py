"""A corpus run: toxicity, exact dedup, near duplicates, mixing, encoding.

Every stage works on all that its predecessor kept. Stages but the last return the columns of
documents, whatever their names; each one's result is written as Parquet and read again as the next
one's documents. A stage keeps of its working tables only those that its result reads.

Null texts count as texts without words, and an empty table gives an empty one, in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import exact_dedup, jaccard_join, sentencepiece_codec, source_mixing, toxicity
from strandloom.llm.common import remove, remove_at_end, scratch, shared_dir, small, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold.

    Null and empty texts score as documents without evidence. Repeated rows are judged alike and all
    stay or go. Other columns pass through, also those named like the operator's own outputs.
    """
    with scratch():
        model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    columns = [f"c{i}" for i in range(len(docs.columns))]  # clash with no output
    judged = toxicity.score(docs.toDF(*columns), model, text=columns[docs.columns.index("text")])
    return judged.filter(F.col("toxicity") < toxicity.THRESHOLD).select(*columns).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (A-Z lower-cased): the one with the largest id.

    Null and empty texts are one text. Null ids lose against others; of rows that repeat both id and
    text one stays.
    """
    return exact_dedup.deduplicate(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id.

    Shingles have five words and similarity is 0.8 or more, as in all stages on near duplicates.
    Texts without words, null ones too, are near copies of nothing and stay. Where ids are null or
    repeat, rows are told apart by number, and the first row of a component stays.
    """
    columns, key = docs.columns, "doc_id"
    with scratch() as own:
        ids = docs.groupBy("doc_id").count()
        if not ids.filter("count > 1 OR doc_id IS NULL").isEmpty():  # ids don't tell rows apart
            docs, key = own.keep(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered"), "__row"
        found = jaccard_join.similar_components(docs, shingle=5, percent=80, id_column=key)
        gone = own.keep(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")), "near_copies")
    gone = small(gone, jaccard_join.MOST_BROADCAST)
    return docs.join(gone, docs[key] == F.col("__gone"), "left_anti").select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Documents without words weigh nothing and are taken at their source's rate. A null source is a
    source of its own; rows that repeat an id are drawn alike.
    """
    return source_mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and n_tokens in place of the text.

    Null texts have null ids and no tokens, empty ones an empty list. Columns named ids or n_tokens are
    replaced; repeated rows are encoded each.
    """
    kept = [c for c in docs.columns if c not in ("text", "ids", "n_tokens")]
    encoded = sentencepiece_codec.encode(docs.select(*kept, "text"), keep=kept)
    return encoded.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Toxicity, sketches and tokens have no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder.

    A stage's documents are removed when the next stage has been written, and its working tables with
    it, so the corpus lies on disk twice at most. What is left, also by a run that fails, goes when the driver ends.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        if not before:
            remove_at_end(spark, folder)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
