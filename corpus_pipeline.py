"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import bpe, decontaminate, jaccard_join, pii, toxicity
from veilmark.llm.common import delete, fold, read, shared_folder, spare
from veilmark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score of 0.5 or more) go; it learns from the labelled documents that are here."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return toxicity.score(docs, model).where("score < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity of 0.8 or more) stays: the smallest doc_id."""
    # Rows are told apart by id and text, so repeated rows leave one and rows that share an id by mistake are not mixed up.
    mark = spare(docs, "mark")
    keyed = docs.withColumn(mark, F.xxhash64("doc_id", "text"))
    placed = jaccard_join.components(keyed.select("doc_id", "text", mark))
    first = placed.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(mark).distinct()
    return keyed.join(first, mark, "left_semi").dropDuplicates([mark]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs, pii.fit(spark))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with digests of them and of the text that they decode to."""
    coded = bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), ids=True, decoded=False)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode_tokens),
]

#: Trained models and signatures are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last through a Parquet table in the shared folder; a stage's table goes once the next one's is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_folder(spark)}/{name}"
            docs.write.mode("overwrite").parquet(path)
            if before:
                delete(spark, before)
            docs, before = spark.read.parquet(path), path
    return docs
