"""Corpus pipeline: toxicity filter, near-duplicates, repeated passages, source mix, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next stage's docs.
All but the last return the columns of docs, whatever their names besides doc_id, text, source and n_chars. An empty table stays empty in every stage, and ties go by
doc_id. Every stage reads whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.bpe import encode_texts
from riskframe.llm.common import saved
from riskframe.llm.minhash_dedup import near_duplicates
from riskframe.llm.queries import _tokenizer
from riskframe.llm.source_mix import mixed_documents
from riskframe.llm.substring_dedup import cut_repeats
from riskframe.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. A null or empty text has the score of no words; rows of a null id are scored like others, and repeated rows go or stay together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs, labels).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id: five-word shingles, similarity of 0.8 or more. Documents without words stay, as do
    rows of a null id. Rows of one id stay together if one of their texts is the group's document."""
    kept = near_duplicates(docs, k=5, percent=80).where("kept").select(F.col("id").alias("__id"))
    return docs.join(kept.distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that stand earlier (smaller doc_id; null last); n_chars follows. Texts without repeats stay as they are, null and empty ones among
    them; documents of which nothing is left go. Repeated rows of one id and text are one document and stay."""
    cut = cut_repeats(docs, window=50)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~changed | (F.col("kept_text") != "")).withColumns({"n_chars": chars, "text": text}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its schedule: weights 5, 2, 1, repeating, over the sources by code point, null last. Documents without words
    are no part of a mix and go; n_chars follows the text. Repeated rows are taken each for itself."""
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the text decoded from them. Null and empty texts have no tokens; each row stands alone."""
    done = encode_texts(docs.select("doc_id", "source", "text"), _tokenizer(), decoded=True)
    return done.select("doc_id", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_passages),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: The classifier and the tokenizer have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
