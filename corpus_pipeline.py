"""A training corpus from raw documents, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``docs``. Labels, the rows that models are fitted to and
the benchmark are read from ``sf_dir``. A stage works on all that the one before it kept:

1. quality classifier (byte-level convolutional network): rejected documents go;
2. quality rules (thresholds and hashed n-gram regression): failing ones go;
3. n-gram Jaccard join: one document of each group of near copies stays;
4. benchmark decontamination (winnowing): documents with a hit go;
5. best-fit packing: the rest is tokenised, cut and packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablework.llm import byte_cnn, decontamination, ngram_join, packing, quality_rules
from tablework.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not reject. A NULL or empty text is scored as
    padding; repeated rows share their verdict; without labels of both kinds nothing
    is rejected; an empty table stays empty; further columns are kept, whatever
    their names."""
    model = byte_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return byte_cnn.keep_good(docs, model)


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the model. A NULL or empty text has no
    words and fails; repeated rows share their verdict; without labels of both kinds
    only the base rules act; further columns are kept, whatever their names."""
    # The classifier has taken almost all bad rows out of docs: the model learns from the raw ones.
    model = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (its smallest id, then row key). A
    text without words (NULL, empty) is alone in its group, each row of it; of
    repeated rows with words one stays; further columns are kept."""
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a hit. NULL and empty texts have no words and stay; repeated
    rows stay or go together; NULL items and an empty benchmark hit nothing; further
    columns are kept and not read."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placed pieces of the documents. A NULL or empty text is its end id alone;
    repeated rows are packed as often as they occur; an empty table gives no rows;
    further columns are not read."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_filter),
    ("n-gram Jaccard join", near_duplicate_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

# Trained models and a tokenizer decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
