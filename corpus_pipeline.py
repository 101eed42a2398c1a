"""From raw documents to packed training sequences, in five stages.

Every stage takes what its predecessor kept and, but for the last, returns the
columns of documents; texts that a stage changes have their n_chars set anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import line_dedup, minhash_dedup, packing, quality_classifier, suffix_dedup
from sluice.llm.common import materialize, table, whole_text


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns in one, so that none can clash with those that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _like(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from out (text, row), n_chars telling the length of text."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labelled part, does not reject.

    Null and empty texts are judged as texts without words; repeated rows get
    the same verdict. Without labels of both kinds nothing is rejected unless
    all known labels are 0. Rows stay as they are. Other stages take nulls,
    repeats and empty tables likewise: each gives a table like its input.
    """
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_classifier.probability(spark, model, whole_text("text")) >= 0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat or nearly repeat an earlier one; documents that lose all their lines go.

    Null texts come out empty; rows that repeat id and text keep the same lines.
    """
    out = line_dedup.dedup(_packed(docs), out_col="text").filter("n_lines = 0 OR n_kept > 0")
    return _like(out, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: of rows that repeat id and text one stays, as does one of all texts without words."""
    return minhash_dedup.dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without byte strings of 200 bytes that occur again; documents that lose all their text go. Null texts come out empty."""
    out = suffix_dedup.dedup(_packed(docs)).filter("n_removed = 0 OR clean_text <> ''")
    return _like(out.drop("text").withColumnRenamed("clean_text", "text"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; repeated rows are documents of their own."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("repeated strings", repeats), ("packing", pack)]

#: The classifier's training, weighted sampling and suffix order are not expressible in SQL; tests compare the
#: stages with brute-force versions, and the classifier's parts with plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
