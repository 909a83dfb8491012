"""A training corpus in five stages: quality, near duplicates, personal data, mixing, tokens.

Each stage takes the documents that the one before it has written and returns a DataFrame; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.catalog.registry import query, table
from statloom.llm import bpe, mixing, ngram_join, pii, quality
from statloom.llm.queries import MIX_FRACTION, MIX_TARGETS, PII_KEY
from statloom.operators.stage import Stage

THRESHOLD = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels that are not held out, accepts."""
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out("doc_id"))
    model = quality.learn(docs, labels)
    return quality.classify(docs, model, threshold=THRESHOLD).filter("predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, one row of it.

    Of rows that repeat the id, the first text in order stays; rows without an id all stay.
    """
    stage = Stage(spark, "one-of-each")
    groups = ngram_join.near_duplicates(docs)
    dropped = stage.put(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    repeated = stage.put(groups.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    left = docs.join(dropped, "doc_id", "left_anti").join(repeated.withColumn("again", F.lit(True)), "doc_id", "left")
    rest = [c for c in docs.columns if c != "doc_id"]
    again = left.filter("again").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    return left.filter("again is null").select(*docs.columns).unionByName(again.select(*docs.columns))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, entities replaced by surrogates; ``n_chars`` follows the text."""
    clean = pii.replace_entities(docs, PII_KEY, count="n_entities")
    chars = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", chars).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample whose tokens meet the target shares of source, language and topic."""
    return mixing.with_probability(docs, MIX_TARGETS, MIX_FRACTION).filter("kept").select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, their text, and whether encoding that gives them back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    stage = Stage(spark, "tokenized")
    coded = bpe.decode(bpe.encode(docs, path).select("doc_id", "lang", "source", "ids"), path)
    again = bpe.encode(stage.put(coded, "decoded"), path, text="decoded", ids="again")
    return again.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded",
        (F.col("ids") == F.col("again")).alias("round_trip"),
    )


STAGES = [
    ("quality", good_quality), ("near_duplicates", one_of_each_group), ("personal_data", without_personal_data),
    ("mixing", mixed), ("tokens", tokenized),
]
#: SQL has no classifier, set join or tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = stage.put(step(spark, docs, sf_dir), name)
        if i > 1:
            stage.drop(STAGES[i - 1][0])
    return docs
