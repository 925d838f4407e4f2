"""A training corpus from raw documents, stage by stage; each stage calls one operator of cellarium.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm import decontamination, dedup, packing, pii, toxicity
from cellarium.llm.common import drop, finished, table
from cellarium.llm.queries import DEMO_KEY
from cellarium.llm.tokens import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject.

    Null and empty texts have the score of the bias and stay unless that is rejected; without labels none is. Equal rows stay or
    go together, whole texts count, an empty table stays empty, and all columns stay, score and predicted too.
    """
    weights = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    clash = {c: f"kept_{c}" for c in ("score", "predicted") if c in docs.columns}
    judged = toxicity.score(docs.withColumnsRenamed(clash), weights, threshold=0.7).filter("predicted = 0")
    return judged.drop("score", "predicted").withColumnsRenamed({v: k for k, v in clash.items()}).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; see dedup.keep_one for odd rows."""
    return dedup.keep_one(docs, percent=75).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; see decontamination.keep_clean for odd rows."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"), size=10).select(docs.columns)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private values replaced; n_chars follows where a text changed.

    Null texts stay null, equal rows get equal texts, whole texts count, an empty table stays empty, all columns stay, pii too.
    """
    clash = {"pii": "kept_pii"} if "pii" in docs.columns else {}
    found = pii.pseudonymise(docs.withColumnsRenamed(clash), DEMO_KEY)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return found.drop("pii").withColumnsRenamed({v: k for k, v in clash.items()}).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2048 tokens.

    A null text is empty and is one piece; rows of equal or null doc_id are packed one by one; whole texts are cut, however
    long; an empty table gives no pieces; other columns don't matter.
    """
    return packing.pack_documents(docs, vocabulary_path(), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_private),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, the pseudonyms or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again, and what is spent is deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        drop(*before)
        before = [docs]
    return docs
