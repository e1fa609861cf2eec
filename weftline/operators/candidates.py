"""From observations to resolution candidates, and the checks of a batch and of its result."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import identity
from weftline.functions.text import collapse
from weftline.functions.values import is_usable
from weftline.operators.tables import missing_references, violations

# Observed fields and the candidate field they fill.
FIELDS = {"display_name": "names", "legal_name": "names", "phone": "phones", "email": "emails", "website": "website_urls", "address": "addresses"}
#: Most distinct values a candidate field may hold.
MAX_VALUES = 64


def observed_values(observations: DataFrame) -> DataFrame:
    """``record_id``, candidate ``field`` and distinct plain ``value`` of observed values; texts and mails in lower case."""
    kind = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    address = F.array_join(F.filter(F.array(*[F.col(f"value.address.{c}") for c in ("street_address", "postal_code", "locality", "region", "country_code")]), lambda v: v.isNotNull() & (v != "")), ", ")
    raw = F.coalesce(F.col("value.text"), F.nullif(address, F.lit("")), F.col("value.address.free_form"))
    rows = observations.filter("state = 'observed' and source_record_id is not null").select(F.col("source_record_id").alias("record_id"), F.try_element_at(kind, F.col("field_key")).alias("field"), raw.alias("v")).filter(F.col("field").isNotNull() & is_usable(F.col("v")))
    plain = F.when(F.col("field").isin("names", "addresses", "emails"), F.lower(collapse(F.col("v")))).otherwise(collapse(F.col("v")))
    return rows.select("record_id", "field", plain.alias("value")).distinct()


def build_candidates(observations: DataFrame, most: int = MAX_VALUES) -> tuple[DataFrame, DataFrame]:
    """Candidates (one per source record, sorted values per field) and the records refused for a field of too many values.

    Values are counted before they are collected: a bulk record of a large share of all rows is refused from counts
    alone and never comes together in one task.
    """
    values = observed_values(observations)
    size = values.groupBy("record_id", "field").agg(F.count(F.lit(1)).alias("n"))
    large = size.filter(F.col("n") > most)
    fit = values.join(large.select("record_id").distinct(), "record_id", "left_anti")
    names = sorted(set(FIELDS.values()))
    arrays = fit.groupBy("record_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("value")))).alias(f) for f in names])
    return arrays.select(identity.uuid5(F.concat(F.lit("candidate:"), "record_id")).alias("candidate_id"), "record_id", *names), large


def batch_violations(candidates: DataFrame, decisions: DataFrame, prior: DataFrame) -> DataFrame:
    """``subject`` and ``rule`` of everything a batch may not hold: unsorted or repeated values, unknown or doubled decisions, shared members."""
    c = F.col
    ordered = lambda a: a.isNull() | (a == F.array_sort(F.array_distinct(a)))
    rules: dict[str, Column] = {f"sorted_{f}": ordered(c(f)) for f in ("names", "phones", "emails", "website_urls", "addresses", "source_keys", "observation_ids")}
    rules |= {"known_kind": c("entity_kind").isin("place", "organization", "provider"), "has_source": F.size("source_keys") > 0, "few_values": F.greatest(*[F.coalesce(F.size(f), F.lit(0)) for f in ("names", "phones", "emails", "website_urls", "addresses")]) <= MAX_VALUES}
    own = violations(candidates.dropDuplicates(["candidate_id"]), "candidate_id", rules).withColumnRenamed("candidate_id", "subject")
    ends = decisions.select(F.explode(F.array("left_candidate_id", "right_candidate_id")).alias("subject"))
    lost = missing_references(ends, "subject", candidates, "candidate_id").withColumn("rule", F.lit("decision_of_unknown_candidate"))
    pair = identity.pair_id(c("left_candidate_id"), c("right_candidate_id")).alias("subject")
    twice = decisions.groupBy(pair).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("subject", F.lit("decided_twice").alias("rule"))
    shared = prior.select("cluster_id", F.explode("member_candidate_ids").alias("subject")).distinct().groupBy("subject").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("subject", F.lit("in_two_prior_clusters").alias("rule"))
    return own.select("subject", "rule").unionByName(lost).unionByName(twice).unionByName(shared)


def snapshot_violations(pairs: DataFrame, clusters: DataFrame, candidates: DataFrame) -> DataFrame:
    """``subject`` and ``rule`` of everything a result may not hold: a pair id that isn't its ends', features that contradict each other, candidates in no or two clusters.

    Pairs with plain ids in order that are seen to keep all rules by a short expression go no further; the others get every rule.
    """
    c = F.col
    rules = {
        "pair_id": c("pair_id") == identity.pair_id(c("left_candidate_id"), c("right_candidate_id")), "ends_in_order": c("left_candidate_id") < c("right_candidate_id"), "similarity_range": c("name_similarity_bps").between(0, 10_000) & c("address_similarity_bps").between(0, 10_000),
        "strong_count": c("strong_non_name_feature_count") >= c("exact_phone_overlap").cast("int") + c("exact_email_overlap").cast("int") + c("exact_website_host_overlap").cast("int"),
        "name_only": ~c("name_only") | ((c("strong_non_name_feature_count") == 0) & (c("address_similarity_bps") == 0)), "strength_range": c("evidence_strength").between(0, 100_000),
    }
    plain = lambda e: ~c(e).rlike(r'[\x00-\x1f"\\\x7f-\x{10ffff}]')  # noqa: E731  JSON writes such texts as they are
    named = c("pair_id") == identity.digest(F.concat(F.lit('["'), "left_candidate_id", F.lit('","'), "right_candidate_id", F.lit('"]')))
    sound = functools.reduce(operator.and_, [plain("left_candidate_id"), plain("right_candidate_id"), named, *[rule for name, rule in rules.items() if name != "pair_id"]])
    # always true, but keeps the optimizer from evaluating the long expressions of the rules together with the short one on every pair
    doubtful = pairs.filter(~F.coalesce(sound, F.lit(False))).filter(F.rand(0) >= 0)
    bad = violations(doubtful, "pair_id", rules).select(c("pair_id").alias("subject"), "rule")
    held = clusters.select(F.explode("member_candidate_ids").alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    twice = held.filter("n > 1").select("subject", F.lit("in_two_clusters").alias("rule"))
    lost = candidates.select(c("candidate_id").alias("subject")).distinct().join(held, "subject", "left_anti").withColumn("rule", F.lit("in_no_cluster"))
    return bad.unionByName(twice).unionByName(lost)
