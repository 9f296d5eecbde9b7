"""Explicit schemas; nothing in the engine relies on schema inference."""

from pyspark.sql import types as T

# Extraction record: three required-but-nullable integers and a set of at most five integers.
RECORD = T.StructType([
    T.StructField("scope_1", T.LongType(), True),
    T.StructField("scope_2", T.LongType(), True),
    T.StructField("scope_3", T.LongType(), True),
    T.StructField("sources", T.ArrayType(T.LongType(), True), True),
])

# Predictions of all models in one table.
PREDICTIONS = T.StructType(
    [T.StructField("model", T.StringType(), False), T.StructField("id", T.StringType(), False)]
    + RECORD.fields
)

GROUND_TRUTH = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("scope_1", T.DoubleType(), True),
    T.StructField("scope_2_market", T.DoubleType(), True),
    T.StructField("scope_2_location", T.DoubleType(), True),
    T.StructField("scope_3", T.DoubleType(), True),
    T.StructField("scope_1_page", T.ArrayType(T.IntegerType(), True), True),
    T.StructField("scope_2_market_page", T.ArrayType(T.IntegerType(), True), True),
    T.StructField("scope_2_location_page", T.ArrayType(T.IntegerType(), True), True),
    T.StructField("scope_3_page", T.ArrayType(T.IntegerType(), True), True),
])

MANIFEST = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("url", T.StringType(), True),
    T.StructField("sha256", T.StringType(), True),
])

PAGES = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("page_no", T.IntegerType(), False),
    T.StructField("page_text", T.StringType(), True),
])

MODEL_CONFIG_VALUE = T.StructType([
    T.StructField("context_size", T.IntegerType(), True),
    T.StructField("model_path", T.StringType(), True),
])
MODEL_CONFIG = T.MapType(T.StringType(), MODEL_CONFIG_VALUE)

SFT_RECORD = T.StructType([
    T.StructField("prompt", T.StringType(), True),
    T.StructField("completion", T.StringType(), True),
])
DPO_RECORD = T.StructType([
    T.StructField("prompt", T.StringType(), True),
    T.StructField("chosen", T.StringType(), True),
    T.StructField("rejected", T.StringType(), True),
])
