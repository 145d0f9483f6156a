"""From raw documents to token ids in five stages, each written as Parquet and read back as the next one's input.

1. quality_rules: documents that fail the base rules or the isolation forest go.
2. near_duplicates: of documents linked by the n-gram Jaccard join, directly or through others, the one of smallest id stays.
3. decontamination: documents in which a window of a benchmark item occurs go.
4. pii: personal data and terms that disclose it are replaced by their kind in brackets; n_chars follows the text.
5. bpe: every text is encoded, and decoded again to prove the ids.

Every stage works on all that its predecessor kept, and all but the last return the columns of documents.

Defined cases: see the operators.  An empty table passes through all stages as no rows; a NULL text has no words and goes
in stage 1; columns that documents has besides its own are kept until stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.llm import bpe, decontam, ngram_join, pii, rules_forest
from tabprep.llm.common import materialize, table
from tabprep.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules_forest.keep_documents(docs, rules_forest.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("pii", personal_data), ("bpe", token_ids)]

#: SQL expresses neither the forest nor the components nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
