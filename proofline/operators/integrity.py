"""Integrity of source bytes: published checksums, guards before any extraction, and what becomes of pages that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import unused
from ..schemas import SOURCE_AUTHENTICITY
from .sampling import in_order

# Fixed values.
LEAST_BYTES = 50_000
CONSISTENT, MISMATCH = "CONSISTENT_WITH_SOURCE_PUBLISHED_CHECKSUM", "MISMATCH_OR_ABSENT"
PENDING = "PENDING_OWNER_COMPUTATION"


def byte_integrity(published: Column, content: Column) -> Column:
    """Whether the bytes have the published SHA-1; an absent checksum is no match."""
    return F.when(published.isNotNull() & (published == F.sha1(content)), CONSISTENT).otherwise(MISMATCH)


def verified_pages(pages: DataFrame, manifest: DataFrame, name: str = "name", content: str = "content", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Every page, once for each checksum that its name has, with published_sha1, local_sha1, local_sha256, byte_integrity, source_authenticity, ok and failure (null, DOWNLOAD, SOURCE_INPUT_INVALID or INTEGRITY, looked for in this order).

    No content: the download failed. Content that is too short is judged before its checksum. A name without a checksum fails.
    """
    (listed_name,) = unused(pages, "_name")
    listed = manifest.select(F.col("name").alias(listed_name), F.col("sha1").alias("published_sha1"))
    met = pages.join(listed, pages[name] == listed[listed_name], "left").drop(listed_name)
    bytes_ = F.col(content).cast("binary")
    failure = (
        F.when(F.col(content).isNull(), "DOWNLOAD").when(F.octet_length(bytes_) < least_bytes, "SOURCE_INPUT_INVALID").when(byte_integrity(F.col("published_sha1"), bytes_) == MISMATCH, "INTEGRITY")
    )
    out = met.withColumns({"local_sha1": F.sha1(bytes_), "local_sha256": F.sha2(bytes_, 256), "byte_integrity": byte_integrity(F.col("published_sha1"), bytes_), "source_authenticity": F.lit(SOURCE_AUTHENTICITY), "failure": failure})
    return out.withColumn("ok", F.col("failure").isNull())


def failures(verified: DataFrame, *payload: str) -> DataFrame:
    """The pages that failed, without their payload columns."""
    return verified.where(~F.col("ok")).drop(*payload)


def todo(population: DataFrame, done: DataFrame, page: str = "page") -> DataFrame:
    """The pages that aren't done. Pages that failed were never marked done, and so come again."""
    return population.join(done.select(page), page, "left_anti")


def done_in_order(done: DataFrame, page: str = "page") -> DataFrame:
    """The pages that are done, each once, in order; null is no page."""
    return done.select(page).where(F.col(page).isNotNull()).distinct().orderBy(page)


def first_attempts(pages: DataFrame, position: str, n: int) -> DataFrame:
    """The first n pages to be attempted, by position, nulls first; pages that tie are in order of their other columns, so that the choice is the same on every run."""
    return pages.orderBy(*in_order(pages, position)).limit(n)


def first_successes(attempts: DataFrame, position: str, n: int, ok: str = "ok") -> DataFrame:
    """The attempts, by position, up to the nth that succeeded: all of them if fewer did, none if n is 0. Positions that tie with the nth success's come along."""
    if n <= 0:
        return attempts.limit(0)
    reached, last = attempts.where(F.col(ok)).orderBy(position).limit(n).agg(F.count(F.lit(1)), F.max(position)).first()
    return attempts if reached < n else attempts.where(F.col(position) <= F.lit(last))


def drifted(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name, expected, found) of tools whose hash isn't the recorded one; a hash that is marked as still to be recorded passes, one that is null doesn't."""
    met = expected.alias("e").join(found.alias("f"), "name", "left").select("name", F.col("e.sha256").alias("expected"), F.col("f.sha256").alias("found"))
    return met.where(~F.col("expected").eqNullSafe(F.col("found")) & ~F.col("expected").eqNullSafe(F.lit(PENDING)))


def require_no_drift(expected: DataFrame, found: DataFrame) -> None:
    """Raises before anything is written if a tool has changed."""
    bad = drifted(expected, found).orderBy("name").limit(20).collect()
    if bad:
        raise ValueError("tools have changed: " + ", ".join(r["name"] for r in bad))


def tool_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
