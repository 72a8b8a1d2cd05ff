"""The corpus pipeline: from documents to clean, deduplicated token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.llm import decontam, jaccard, line_dedup, sentencepiece_fst, toxicity
from worklore.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the model, fitted on the labelled ones among them, calls toxic."""
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that an earlier one has; those with nothing else go."""
    found = line_dedup.drop_repeats(docs)
    return found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))) if "n_chars" in docs.columns else found


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any that hold a benchmark window."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers of each document."""
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeats),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", tokenize),
]

#: The learned first stage and the tokenizer have no SQL form; the tests hold the operators, not yet the whole run, against plainer forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
