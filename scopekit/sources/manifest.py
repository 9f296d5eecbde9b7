"""Document store contents and their SHA-256 digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopekit.functions.paths import path_stem


def binary_digests(spark: SparkSession, path_glob: str) -> DataFrame:
    """(id, sha256) for every stored document file; id is the file stem."""
    df = spark.read.format("binaryFile").load(path_glob)
    return df.select(path_stem(F.col("path")).alias("id"), F.sha2(F.col("content"), 256).alias("sha256"))


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha256) of documents held as text (digest of the UTF-8 bytes)."""
    return docs.select(F.col(id_col).cast("string").alias("id"), F.sha2(F.col(text_col), 256).alias("sha256"))
