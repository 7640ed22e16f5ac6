"""A training-corpus pipeline from operators of ledgerline.llm, each stage a written table that the next one reads.

STAGES names the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents: what they keep is what the next stage works on.

All stages: null and empty texts have no words, so they are kept (and pack as an end id alone); texts of any length are
whole; rows that repeat an id are one document and stay or go together; rows without an id can't be named by a verdict
and are kept; an empty table gives an empty one; columns beyond those of documents are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import common, jaccard, packing, substrings, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Passages of so many words that also occur earlier are cut out.
PASSAGE_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled documents of this input. Without labels of both classes nothing goes."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = toxicity.score(docs, machine).filter("predicted = 1").select("doc_id").distinct()
    return docs.join(common.small_side(common.save(verdict, "rejected")), "doc_id", "left_anti").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 Jaccard on five-word shingles the document with the smallest id stays. Equal texts link too."""
    groups = jaccard.similar(docs, words=5, percent=80)
    copies = common.save(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(common.small_side(copies), "doc_id", "left_anti").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of PASSAGE_WORDS words that start earlier elsewhere go; a text without such keeps its spacing,
    one that has nothing left is dropped. Of ties the smaller id keeps the passage, in one text the earlier start."""
    kept = substrings.remove_repeats(docs, length=PASSAGE_WORDS, with_text=True, carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = kept.filter("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4,096 tokens; repeated rows are packed once each."""
    return packing.pack(docs, str(packing.tokenizer_file("word_bpe_49k.json")), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated passages", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: No stage but the joins can be written in SQL; tests hold the operators against brute force, and the stages' effects.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
