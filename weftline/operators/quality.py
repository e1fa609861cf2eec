"""Facts and issues of clusters: what their members hold together and where that breaks a rule of their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("names", "phones", "emails", "website_urls", "addresses")


def cluster_facts(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per ``cluster_id``: its kinds, sources, coverages, distinct values per field and whether provenance is missing.

    ``members`` has ``cluster_id`` and ``candidate_id``. Sets are aggregated before they are shuffled.
    """
    empty = F.array().cast("array<string>")
    rows = members.join(candidates.dropDuplicates(["candidate_id"]), "candidate_id")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, empty))))).alias(c)
    bare = F.lit(False)
    for c in ("observation_ids", "source_artifact_ids", "source_keys"):
        bare = bare | (F.coalesce(F.size(c), F.lit(0)) <= 0)
    return rows.groupBy("cluster_id").agg(
        F.array_sort(F.collect_set("entity_kind")).alias("kinds"), F.array_sort(F.collect_set(F.col("geography.coverage"))).alias("coverages"), union("source_keys"), *[union(f) for f in FIELDS],
        F.bool_or(bare).alias("provenance_missing"), F.count(F.lit(1)).alias("members"),
    )


def _issue(code: str, field: Column | None = None, pair: Column | None = None, edge: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit("blocking").alias("severity"), F.lit(code).alias("code"), (field if field is not None else none).alias("field"),
        (pair if pair is not None else none).alias("related_pair_id"), (edge if edge is not None else none).alias("related_blocked_edge_id"),
    )


def cluster_issues(facts: DataFrame, rules: DataFrame, pending: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """``cluster_id`` and its sorted, distinct ``issues``; a cluster without issue has an empty array.

    ``rules`` has a row per ``entity_kind``; ``pending`` (``cluster_id``, ``pair_id``) and ``blocked`` (``cluster_id``, ``edge_id``) name
    what touches a cluster. Rules of a kind don't apply to clusters of several kinds or of a kind without rules.
    """
    rows = facts.join(rules.withColumn("one_kind", F.array("entity_kind")).withColumnRenamed("entity_kind", "rule_kind"), F.col("kinds") == F.col("one_kind"), "left")
    if pending is not None:
        rows = rows.join(pending.groupBy("cluster_id").agg(F.collect_set("pair_id").alias("pending")), "cluster_id", "left")
    if blocked is not None:
        rows = rows.join(blocked.groupBy("cluster_id").agg(F.collect_set("edge_id").alias("blocked")), "cluster_id", "left")
    ruled = F.col("rule_kind").isNotNull()
    values = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.size(f))])
    size_of = lambda f: F.coalesce(F.try_element_at(values, f), F.lit(0))
    none = F.array().cast("array<struct<severity:string,code:string,field:string,related_pair_id:string,related_blocked_edge_id:string>>")
    one = lambda when, issue: F.when(F.coalesce(when, F.lit(False)), F.array(issue)).otherwise(none)
    each = lambda when, items, make: F.when(F.coalesce(when, F.lit(False)), F.transform(items, make)).otherwise(none)
    parts = [
        one(F.size("kinds") != 1, _issue("MIXED_ENTITY_KINDS")),
        one((F.size("kinds") == 1) & ~ruled, _issue("MISSING_QUALITY_POLICY")),
        one(F.col("provenance_missing"), _issue("MISSING_OBSERVATION_PROVENANCE")),
        each(ruled, F.filter("required_fields", lambda f: size_of(f) == 0), lambda f: _issue("REQUIRED_FIELD_ABSENT", field=f)),
        each(ruled, F.filter("single_value_fields", lambda f: size_of(f) > 1), lambda f: _issue("SINGLE_VALUE_FIELD_CONFLICT", field=f)),
        one(ruled & (F.size("source_keys") < F.col("minimum_distinct_source_count")), _issue("INSUFFICIENT_DISTINCT_SOURCES")),
        one(ruled & (F.size(F.array_except("coverages", "allowed_geography")) > 0), _issue("GEOGRAPHY_NOT_ALLOWED")),
        one(ruled & F.col("boundary_requires_review") & F.array_contains("coverages", "boundary"), _issue("GEOGRAPHY_BOUNDARY_REVIEW_REQUIRED")),
    ]
    if pending is not None:
        parts.append(each(ruled & F.col("pending_review_blocks_export") & F.col("pending").isNotNull(), F.col("pending"), lambda p: _issue("PENDING_RESOLUTION_REVIEW", pair=p)))
    if blocked is not None:
        parts.append(each(F.col("blocked").isNotNull(), F.col("blocked"), lambda e: _issue("MATCH_EDGE_BLOCKED_BY_SEPARATION", edge=e)))
    return rows.select("cluster_id", F.array_sort(F.array_distinct(F.concat(*parts))).alias("issues"))
