"""Sinks: objects by content, canonical JSON documents and histories that only grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import identity
from weftline.operators.tables import append_new


def write_objects(df: DataFrame, path: str, kind: str = "kind", content: str = "content") -> None:
    """Append binary objects below ``path`` by kind, each content of a kind once, named by its digest.

    What the store already holds is left out by an anti-join on digests; only digests of known objects are read.
    """
    spark = df.sparkSession
    rows = df.withColumn("digest", F.concat(F.lit("sha256:"), F.sha2(content, 256))).dropDuplicates([kind, "digest"])
    try:
        rows = append_new(spark.read.parquet(path).select(kind, "digest"), rows, [kind, "digest"])
    except Exception as e:  # an empty store has no schema yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    rows.write.mode("append").partitionBy(kind).parquet(path)


def unreadable_objects(spark, path: str, content: str = "content") -> DataFrame:
    """Objects of a store whose content no longer has their digest."""
    return spark.read.parquet(path).filter(F.concat(F.lit("sha256:"), F.sha2(content, 256)) != F.col("digest"))


def canonical_document(**fields: Column) -> Column:
    """Canonical JSON of fields that are already JSON texts, sealed with the digest of the rest as ``contentDigest``."""
    body = identity.json_object(**fields)
    return identity.json_object(**fields, contentDigest=identity.json_text(identity.digest(body)))


def write_documents(df: DataFrame, path: str, document: str = "document") -> None:
    """Write one canonical document a line."""
    df.select(document).write.mode("overwrite").text(path)


def append_history(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows whose key the history below ``path`` doesn't have yet, so that a replay changes nothing; their number."""
    spark = df.sparkSession
    try:
        rows = append_new(spark.read.parquet(path), df, keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        rows = df.dropDuplicates(keys)
    rows = rows.persist()
    try:
        n = rows.count()
        rows.write.mode("append").parquet(path)
    finally:
        rows.unpersist()
    return n
