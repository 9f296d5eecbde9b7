"""Locations, path stems, run names and output paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REMOTE_SCHEMES = ("http", "https", "ftp")
SCHEME_PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*):"
# Base name without its last extension; trailing slashes ignored.
STEM_PATTERN = r"([^/]+?)(\.[^./]*)?/*$"
LAST_SEGMENT_PATTERN = r"([^/]+)/*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_scheme(location) -> Column:
    return F.lower(F.regexp_extract(_col(location), SCHEME_PATTERN, 1))


def location_kind(location) -> Column:
    """'remote' for http/https/ftp, 'local' without a scheme (or file:), else 'unsupported'."""
    s = url_scheme(location)
    return (F.when(s.isin(*REMOTE_SCHEMES), F.lit("remote"))
             .when(s.isin("", "file"), F.lit("local"))
             .otherwise(F.lit("unsupported")))


def path_stem(path) -> Column:
    """Base name of a path without its last extension (names starting with a dot are not supported)."""
    return F.regexp_extract(_col(path), STEM_PATTERN, 1)


def last_segment(path) -> Column:
    return F.regexp_extract(_col(path), LAST_SEGMENT_PATTERN, 1)


def run_name(model_path, lora) -> Column:
    """Last path segment of the model, plus '-lora' when an adapter is given."""
    suffix = F.when(F.coalesce(_col(lora), F.lit("")) != "", F.lit("-lora")).otherwise(F.lit(""))
    return F.concat(last_segment(model_path), suffix)


def join_path(*parts) -> Column:
    """Path segments joined by '/'; pass literals as ``F.lit``."""
    return F.concat_ws("/", *[_col(p) for p in parts])


def file_stem_of_metadata() -> Column:
    """Stem of the file a row was read from (strips only the last extension). Spark gives the
    name percent-encoded; a plus sign in it is itself."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, r"\.[^./]*$", "")
