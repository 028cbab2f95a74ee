"""From raw documents to token ids: five stages, each a table that the next one reads.

Every stage gets all that the one before kept. Four of them return the columns of `documents` (further columns of the
input stay, too); the last one returns the ids. A stage that changes texts sets n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm import op1_bpe, op2_substrings, op6_toxicity, op7_tiling, op9_simhash
from inventa.llm.common import fresh, keep, prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones calls toxic go (score of 0.5 or more)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~op6_toxicity.held_out())
    (score,) = fresh(docs, "__toxicity")
    scored = op6_toxicity.score(docs, op6_toxicity.fit(docs, labels), out_col=score)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays. Of rows with one id and class, all stay or none; a null id stays."""
    gone = op9_simhash.near_duplicates(docs).where("class_id <> id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that an earlier document has are cut out. A text that loses nothing stays as it is, one that loses all its words goes."""
    rest, words, removed = fresh(docs, "__kept", "__words", "__removed")
    kept = op2_substrings.remove_repeats(docs, kept_col=rest, words_col=words, removed_col=removed)
    text = F.when(F.col(removed) > 0, F.col(rest)).otherwise(F.col("text"))
    kept = kept.where((F.col(removed) == 0) | (F.col(removed) < F.col(words))).withColumn("text", text)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, also in another order, go."""
    leaks = op7_tiling.tilings(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the ids (little-endian unsigned 32-bit integers) and the digest of the decoded text."""
    path = op1_bpe.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    coded = op1_bpe.decode(op1_bpe.encode(docs, path).drop("text"), path)
    return coded.select("doc_id", "lang", "source", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("benchmark leaks", drop_leaks),
    ("token ids", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier, a tokenizer and tilings have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None
