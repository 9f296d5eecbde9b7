"""Manifest verification against the stored documents' content digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK, CONFLICT, MISSING, UNCHECKED = "ok", "conflict", "missing", "unchecked"


def verify_manifest(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """(id, url, status): 'missing' without stored content, 'unchecked' without an
    expected digest, 'ok' when the digests agree, else 'conflict'.

    Each stored content is hashed on its own (never mixed with another copy).
    """
    return _checked(manifest, digests).select("id", "url", "status")


def _checked(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """(id, url, expected, status) of every manifest row."""
    d = digests.select("id", F.lower("sha256").alias("actual"))
    j = manifest.select("id", "url", F.lower("sha256").alias("expected")).join(d, "id", "left")
    status = (F.when(F.col("actual").isNull(), F.lit(MISSING))
               .when(F.col("expected").isNull(), F.lit(UNCHECKED))
               .when(F.col("expected") == F.col("actual"), F.lit(OK))
               .otherwise(F.lit(CONFLICT)))
    return j.select("id", "url", "expected", status.alias("status"))


def failed_ids(verified: DataFrame) -> DataFrame:
    """Rows that need attention (conflicting or missing content), as a table, not a driver list."""
    return verified.where(F.col("status").isin(CONFLICT, MISSING)).select("id", "status")


def classify_locations(locations: DataFrame, stored: DataFrame, location_col: str = "location") -> DataFrame:
    """Adds ``kind``: 'file' when the location is a stored document path, else 'remote' for an
    http/https/ftp URL, else 'error' (the document can be neither read nor fetched).

    ``stored`` is the document store's listing (column ``path``, e.g. from the ``binaryFile``
    source); the check is an equi-join, never a per-row file-system call.
    """
    from scopekit.functions.paths import REMOTE_SCHEMES, url_scheme
    listing = stored.select(F.col("path").alias("_stored")).distinct()
    j = locations.join(listing, F.col(location_col) == F.col("_stored"), "left")
    kind = (F.when(F.col("_stored").isNotNull(), F.lit("file"))
             .when(url_scheme(location_col).isin(*REMOTE_SCHEMES), F.lit("remote"))
             .otherwise(F.lit("error")))
    return j.select(*locations.columns, kind.alias("kind"))


KEEP, FETCH, FAILED = "keep", "fetch", "failed"


def changed_files(listing: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unchanged with their stored digest, changed or new) files of a listing (id, path, length, modified), compared with the
    digests of an earlier round (path, length, modified, sha256). A file rewritten with the same length within the
    file system's clock tick counts as unchanged; a file without a digest counts as changed."""
    known = state.where(F.col("sha256").isNotNull()).select("path", "length", "modified", "sha256")
    key = ["path", "length", "modified"]
    return (listing.join(known, key, "inner").select(*listing.columns, "sha256"),
            listing.join(known.select(*key), key, "left_anti"))


def plan_round(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """(id, url, expected, status, action): a document with agreeing content is kept, every other one is fetched again
    (also one without expected digest, as nothing says that its content is right)."""
    action = F.when(F.col("status") == OK, F.lit(KEEP)).otherwise(F.lit(FETCH))
    return _checked(manifest, digests).withColumn("action", action)


def finish_round(planned: DataFrame, fetched: DataFrame) -> DataFrame:
    """(id, url, status, action, outcome, saved) from the digests of what was fetched (id, sha256; null or no row where
    the fetch failed): content that still differs from the expected digest isn't saved and fails, as does no content."""
    got = fetched.select("id", F.lower("sha256").alias("got"))
    j = planned.join(got, "id", "left")
    right = F.col("got").isNotNull() & (F.col("expected").isNull() | (F.col("expected") == F.col("got")))
    saved = (F.col("action") == FETCH) & right
    outcome = F.when((F.col("action") == KEEP) | saved, F.lit(OK)).otherwise(F.lit(FAILED))
    return j.select("id", "url", "status", "action", outcome.alias("outcome"), saved.alias("saved"))
