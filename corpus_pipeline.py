"""A corpus from raw documents to packed training sequences: five stages, each written as Parquet before the next.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents. Rows go only
where a stage's decision says so: texts without an identified language, near copies but one of each group, and what the
mixture does not take. Null texts go in the first stage. Sizes and thresholds are the operators' defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm import langid, mixing, packing, pii, simhash
from flightloom.llm.common import modest_batches
from flightloom.sources.shared import fresh_folder

#: The last two operators place rows by seeded hashes and by trained models: no SQL states the result.
ORACLE_SQL: str | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not told: weaker answers than all but 0.5 % of known texts get.

    Null and empty texts and texts without a letter go. Where no row names a language nothing else does. Rows that repeat
    or have no doc_id are judged by their text like others; extra columns stay. An empty table gives an empty table.
    """
    modest_batches(spark)
    model = langid.fit(docs, F.col("doc_id").isNotNull())
    return langid.keep_identified(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies, over five-word shingles.

    Of rows with one doc_id unlike texts all stay; rows that repeat in doc_id and text become one. Null and empty texts are
    copies of each other. Rows without a doc_id stay. Extra columns stay; an empty table gives an empty table.
    """
    modest_batches(spark)
    return simhash.simhash_dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; n_chars, where there is one, follows the text.

    Every row stays. Null texts stay null, with a null n_chars; of spans that overlap the earlier one's kind is written.
    Extra columns stay; an empty table gives an empty table.
    """
    modest_batches(spark)
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mixture of sources asks for; repeats are rows.

    A null source is a source. Rows equal in doc_id and text are taken by number. Rows without words are taken like their
    neighbours in the order; a source without any word gives none. Extra columns stay; an empty table gives an empty table.
    """
    modest_batches(spark)
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' words into bins of the permitted lengths: one row for each piece.

    Texts longer than the largest bin are cut, none is dropped. Null texts and texts without words are one piece of size 0.
    Rows equal in doc_id and size are told apart by a number. An empty table gives an empty table.
    """
    modest_batches(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("sequences", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = fresh_folder(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
