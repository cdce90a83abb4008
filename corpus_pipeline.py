"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), reads the columns of documents from docs, whatever else it has, and returns a
DataFrame; ``run`` writes each result as Parquet to the shared scratch folder and reads it back as the next stage's
documents, so a lost executor costs at most one stage's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumetrics.llm import langid, mixing, packing, secret_scan, simhash
from plumetrics.llm.common import fold, table
from plumetrics.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "_row"


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns; rows of one id and one key are equal and may stand for each other."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in docs.columns],
                      *[F.col(c).isNull() for c in docs.columns])


def one_of_each(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a decision for their id and key, equal rows once, and the decision's columns.

    The window has the keys of the join, so it needs no shuffle of its own.
    """
    named = decisions.withColumnRenamed("doc_id", "_id")
    joined = docs.withColumn(ROW, row_key(docs)).join(
        named.withColumnRenamed(ROW, "_key"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(ROW) == F.col("_key")))
    first = F.row_number().over(Window.partitionBy("doc_id", ROW).orderBy(ROW))
    return joined.withColumn("_at", first).filter("_at = 1").drop("_id", "_key", ROW, "_at")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; lang becomes the recognised one.

    Profiles are learned from the training part of ``docs`` themselves. Text that is null or has no letter is rejected;
    every other document stays, with its own lang if nothing can be learned. Repeated rows stay, an empty table stays
    empty, and columns beside those of documents are left out.
    """
    docs = docs.select(*COLUMNS)
    profiles = langid.learn(docs, fold("doc_id", 4) != 2)
    if not profiles:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.predict(docs, profiles, lang_out="_lang", score_out="_score")
    return found.filter(F.col("_lang") != langid.UNKNOWN).withColumn("lang", F.col("_lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (a null id comes last).

    Null and empty texts, and those without words, are one group. Of rows that share an id the least row key stays;
    equal rows count as one. An empty table stays empty; columns beside those of documents are left out.
    """
    docs = docs.select(*COLUMNS)
    keyed = docs.select("doc_id", "text", row_key(docs).alias(ROW))
    found = simhash.near_duplicates(keyed, carry=[ROW])
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)
    kept = found.groupBy("group").agg(F.min(order).alias("one")).select("one.doc_id", f"one.{ROW}")
    return one_of_each(docs, kept).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark; n_chars follows the text.

    Every row stays, repeated ones and those with a null id too. Null and empty texts and texts without a secret keep text
    and n_chars as they are; of secrets that overlap one mark is left. Columns beside those of documents are left out.
    """
    found = secret_scan.scan(docs.select(*COLUMNS))
    clean = found.withColumn("_clean", secret_scan.redacted(F.col("text"), F.col("found")))
    length = F.when(F.size("found") > 0, F.char_length("_clean").cast("bigint")).otherwise(F.col("n_chars").cast("bigint"))
    return clean.select("doc_id", F.col("_clean").alias("text"), "lang", "source",
                        length.cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix of sources takes it.

    Copies of equal rows add up; rows of one id with other columns are documents of their own. A null source is a source,
    the last one; documents without words (null or empty text) are repeated like their neighbours in size and weigh
    nothing. A source without any word gives no rows. Columns beside those of documents are left out.
    """
    docs = docs.select(*COLUMNS)
    keyed = docs.select("doc_id", "text", "source", row_key(docs).alias(ROW))
    copies = cut_lineage(mixing.mix(keyed, carry=[ROW]).select("doc_id", ROW, "copies"), "mix-copies")
    total = copies.groupBy("doc_id", ROW).agg(F.sum("copies").alias("copies")).filter("copies > 0")
    many = one_of_each(docs, total)
    return many.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences.

    Every row is packed, repeated ones as often as they come; a null or empty text is its end mark alone. Documents of one
    length are told apart by id, and equal ids in no defined order. An empty table gives no pieces.
    """
    return packing.pack(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture),
    ("packing", packed),
]

# Language profiles, fingerprints and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
