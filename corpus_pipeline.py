"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import documents, shared_folder
from veilframe.llm.disclosure import sanitise
from veilframe.llm.packing import pack_documents
from veilframe.llm.shingles import similar_copies
from veilframe.llm.simhash import DISTANCE
from veilframe.llm.substring import remove_repeats
from veilframe.llm.toxicity import fit_toxicity, score_toxicity

TOKENIZER = "byte_bpe_50k.json"


def _as_before(new: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; a column ``n_chars`` follows the new text."""
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the two language models call toxic go; null and empty texts stay."""
    model = fit_toxicity(docs, documents(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).filter("toxicity < 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Texts are linked by op7's SimHash fingerprints (four or fewer differing bits) and by the verified similarity of their
    five-word shingles (0.8 and more), which finds the copies whose fingerprints lie further apart.
    Rows that share an id stay or go together; rows without an id stay.
    """
    marked = similar_copies(docs, DISTANCE)
    gone = marked.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("stays")).filter("not stays")
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier in the corpus leave the text; every row stays."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_repeats(docs, carry=others)
    return _as_before(cut.select("doc_id", F.col("kept_text").alias("text"), *[F.col(f"`{c}`") for c in others]), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what reveals it is replaced in the text; every row stays."""
    return _as_before(sanitise(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of bounded length."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Tokenization, trained models and connected components are not SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
