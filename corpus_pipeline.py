"""The pipeline over documents: quality, near duplicates, secrets, mixture, packing.

Each stage reads what the one before has written.  All but the last return the columns of ``documents``, whichever there
are, as they came.  Rows whose text, id or source is null are rows like others; what each stage makes of them, of
empty and very long texts, ties, repeated rows and empty tables is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import mixture, neardup, packing, quality, secrets
from granary.session import ship
from granary.store import settled

#: The columns of ``documents`` as the test tables have them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It learns from ``labels`` that are not held out.

    Null and empty texts get the score of a text without words; whole texts count, however long; a score of exactly
    0.5 is kept; repeated rows are judged each, and alike; an empty table gives no rows; without labels all scores are
    the same and all rows are kept or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.reject(docs, quality.train(docs, labels))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (shingles of five words, similarity 0.8): the least id.

    Texts without words, null ones among them, are linked with nothing and all stay; one shorter than a shingle
    is one shingle; a null id stays where its group has no other; of rows that agree in id and text one stays; an
    empty table gives no rows.
    """
    return neardup.deduplicated(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found by the scan are replaced; every document stays and its length is counted anew.

    A null text stays null, its length too; texts without secrets stay as they are; a null source is an owner like
    others; overlapping spans are hidden together; repeated rows all stay; an empty table gives no rows.
    """
    hidden = secrets.redact(docs)
    return hidden.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else hidden


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the curriculum, as often as their source's target asks for.

    The rows stand in the order of their positions in training, file by file; the position itself is no column of
    ``documents`` (``mixture.draw`` gives it by name).  Null and empty texts hold no words and are not drawn; a null
    source sorts last; repeated rows count each; an empty table gives no rows.
    """
    return mixture.draw(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    A null or empty text is its end id alone; long texts take whole windows and a rest; repeated rows are packed each;
    a null id stays null; an empty table gives no pieces.
    """
    return packing.digest(packing.pack(docs))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("secrets", hide_secrets), ("mixture", mix_sources), ("packing", pack_windows)]

#: The classifier can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
