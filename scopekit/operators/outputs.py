"""Model outputs: end-marker trim, strict validation, failure stubs, clipping, collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.functions.records import (SCOPES, clip, parse_record, record_checks, record_values, stub_struct,
                                        trim_marker)

STATUS_OK = "ok"
STATUS_FAILED = "failed"


def validate_responses(df: DataFrame, text_col: str = "response") -> DataFrame:
    """Adds ``valid`` and the parsed record columns (null when invalid).

    The text is parsed once per row (the parse is its own projection step and
    the checks read its result)."""
    parsed = df.select("*", parse_record(text_col).alias("_p"), F.json_object_keys(text_col).alias("_k"))
    checked = parsed.select("*", record_checks(text_col, "_p", "_k").alias("valid"))
    return checked.select(*df.columns, "valid", *record_values("_p", "valid"))


def records_or_stub(df: DataFrame, text_col: str = "response", marker: str = FV.EOS_MARKER) -> DataFrame:
    """Trim, validate, and replace every invalid output by the failure stub (status 'failed')."""
    keep = [c for c in df.columns if c != text_col]
    trimmed = df.select(*keep, trim_marker(text_col, marker).alias(text_col))
    v = validate_responses(trimmed, text_col)
    ok = F.col("valid")
    rec = F.when(ok, F.struct(*[F.col(k) for k in SCOPES], F.col("sources"))).otherwise(stub_struct())
    out = v.select(*keep, F.when(ok, F.lit(STATUS_OK)).otherwise(F.lit(STATUS_FAILED)).alias("status"),
                   rec.alias("_r"))
    return out.select(*keep, "status", *[F.col(f"_r.{k}").alias(k) for k in SCOPES],
                      F.col("_r.sources").alias("sources"))


def clip_records(df: DataFrame) -> DataFrame:
    """Every scope limited to [-1, 1e9]; null and ``sources`` untouched."""
    return df.select(*[clip(c).alias(c) if c in SCOPES else F.col(c) for c in df.columns])
