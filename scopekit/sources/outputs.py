"""Model outputs: JSON directories, raw text responses, prompt caches, prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit import schemas
from scopekit.functions.paths import file_stem_of_metadata


def read_json_outputs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file; ``id`` is the file stem. A file that doesn't hold a valid
    record becomes the stub record with status 'failed', never nulls."""
    from scopekit.operators.outputs import records_or_stub
    recs = records_or_stub(read_text_files(spark, path, "response"), "response", marker="")
    return recs.select("id", "status", *FV.SCOPE_KEYS, "sources")


def read_text_files(spark: SparkSession, path: str, value_name: str = "text") -> DataFrame:
    """Whole files as one row each (raw responses, cached prompts); ``id`` is the file stem."""
    df = spark.read.text(path, wholetext=True)
    return df.select(file_stem_of_metadata().alias("id"), F.col("value").alias(value_name))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction table written by ``write_predictions`` (partition column ``model``)."""
    return spark.read.schema(schemas.PREDICTIONS).parquet(path)


def read_external_predictions(spark: SparkSession, directory: str) -> DataFrame:
    """(model, id, scope_1, scope_2, scope_3, sources) from one Parquet file (or folder of parts) per model; the model's name is the
    file's without its extension.

    The files may differ in their types (whole numbers or doubles, NaN for a missing value) and in the columns that they have:
    each is read by its own footer and cast to the one schema, an absent column being null. The loop is over models, not
    over rows or documents.
    """
    from pyarrow import fs

    from scopekit.functions.records import whole_number
    from scopekit.sources.document_files import file_system
    system, root = file_system(directory)
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".parquet"))
    out = spark.createDataFrame([], schemas.PREDICTIONS).select("model", "id", *FV.SCOPE_KEYS, "sources")
    for name in names:
        df = spark.read.parquet(f"{directory.rstrip('/')}/{name}")
        have = set(df.columns)

        def number(c):
            return (whole_number(c).try_cast("bigint") if c in have else F.lit(None).cast("bigint")).alias(c)
        pages = F.transform("sources", lambda x: whole_number(x).try_cast("bigint")) if "sources" in have else F.lit(None).cast("array<bigint>")
        out = out.unionByName(df.select(F.lit(name[:-len(".parquet")]).alias("model"), F.col("id").cast("string").alias("id"),
                                        *[number(c) for c in FV.SCOPE_KEYS], pages.alias("sources")))
    return out
