"""Queries of entity resolution over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import identity
from weftline.functions.values import plain_digest, plain_uuid
from weftline.operators import candidates, quality, resolve
from weftline.operators.components import star_labels
from weftline.operators.tables import latest_by
from weftline.runtime import cut, table


def _parts(spark, sf_dir):
    """Parts as candidates: named by part name, of a kind by type and brand."""
    p = table(spark, sf_dir, "part")
    empty = F.array().cast("array<string>")
    return p.select(
        F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("candidate_id"), F.concat_ws("|", "p_type", "p_brand").alias("entity_kind"), F.array(F.lower("p_name")).alias("names"),
        *[empty.alias(c) for c in ("phones", "emails", "website_urls", "addresses")], F.array("p_brand").alias("source_keys"), F.struct(F.lit("unknown").alias("coverage")).alias("geography"),
    )


def er_block_keys(spark, sf_dir):
    return resolve.block_keys(table(spark, sf_dir, "candidates"))


def er_block_pairs(spark, sf_dir):
    return resolve.candidate_pairs(_parts(spark, sf_dir), pair_limit=None)


def er_pair_features(spark, sf_dir):
    return resolve.block_features(_parts(spark, sf_dir)).drop("left_coverage", "right_coverage")


def er_dispositions(spark, sf_dir):
    rows = resolve.block_dispositions(_parts(spark, sf_dir))
    return rows.select("pair_id", "left_candidate_id", "right_candidate_id", "name_similarity_bps", "disposition", F.array_join("reason_codes", ",").alias("reasons"), "evidence_strength")


def er_pair_identity(spark, sf_dir):
    p = table(spark, sf_dir, "pairs").select(plain_uuid(F.col("left_candidate_id")).alias("l"), plain_uuid(F.col("right_candidate_id")).alias("r")).filter("l <> r")
    return p.select(identity.pair_id(F.col("l"), F.col("r")).alias("pair_id"), F.least("l", "r").alias("lo"), F.greatest("l", "r").alias("hi")).distinct()


def _decided(spark, sf_dir):
    """The latest decision of each pair as resolved rows with plain ids."""
    p = table(spark, sf_dir, "pairs")
    plain = p.select(plain_digest(F.col("pair_id")).alias("pair_id"), plain_uuid(F.col("left_candidate_id")).alias("l"), plain_uuid(F.col("right_candidate_id")).alias("r"), "disposition", "evidence_strength", "recorded_at_utc")
    last = latest_by(plain, ["pair_id"], ["recorded_at_utc", "disposition", "l", "r"])
    return last.select("pair_id", F.least("l", "r").alias("left_candidate_id"), F.greatest("l", "r").alias("right_candidate_id"), "disposition", "evidence_strength").filter("left_candidate_id <> right_candidate_id")


def _accepted(spark, sf_dir):
    return _decided(spark, sf_dir).filter("disposition in ('auto_match', 'manual_match')")


def er_components(spark, sf_dir):
    return star_labels(_accepted(spark, sf_dir), "left_candidate_id", "right_candidate_id").select(F.col("x").alias("candidate_id"), "label")


def er_clusters_constrained(spark, sf_dir):
    rows = cut(_decided(spark, sf_dir))
    apart = rows.filter("disposition = 'manual_separate'").select("left_candidate_id", "right_candidate_id", F.lit("separate").alias("action"))
    members, _ = resolve.constrained_clusters(table(spark, sf_dir, "candidates"), rows, apart)
    return members


def er_blocked_edges(spark, sf_dir):
    rows = cut(_decided(spark, sf_dir))
    apart = rows.filter("disposition = 'manual_separate'").select("left_candidate_id", "right_candidate_id", F.lit("separate").alias("action"))
    return resolve.constrained_clusters(table(spark, sf_dir, "candidates"), rows, apart)[1]


def er_lineage(spark, sf_dir):
    label = er_components(spark, sf_dir).select("candidate_id", F.col("label").alias("root"))
    everyone = table(spark, sf_dir, "candidates").select("candidate_id").distinct()
    members = everyone.join(label, "candidate_id", "left").select("candidate_id", F.coalesce("root", "candidate_id").alias("root"))
    return resolve.lineage(cut(members), table(spark, sf_dir, "prior_clusters")).select("root", "lineage_kind", F.array_join("parent_cluster_ids", ",").alias("parents"))


def _members(spark, sf_dir):
    return table(spark, sf_dir, "prior_clusters").select("cluster_id", F.explode("member_candidate_ids").alias("candidate_id")).distinct()


def cluster_facts(spark, sf_dir):
    facts = quality.cluster_facts(_members(spark, sf_dir), table(spark, sf_dir, "candidates"))
    return facts.select("cluster_id", F.array_join("kinds", ",").alias("kinds"), F.size("source_keys").alias("sources"), F.size("phones").alias("phones"), F.size("names").alias("names"), "members", "provenance_missing")


def cluster_issues(spark, sf_dir):
    kinds = [(k, ["names"], ["website_urls"], 2, ["inside", "boundary", "unknown"], True, True) for k in ("place", "organization")]
    rules = spark.createDataFrame(kinds, "entity_kind string, required_fields array<string>, single_value_fields array<string>, minimum_distinct_source_count int, allowed_geography array<string>, boundary_requires_review boolean, pending_review_blocks_export boolean")
    issues = quality.cluster_issues(quality.cluster_facts(_members(spark, sf_dir), table(spark, sf_dir, "candidates")), rules)
    return issues.select("cluster_id", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["field"])), ",").alias("issues"))


def cluster_identity(spark, sf_dir):
    return table(spark, sf_dir, "prior_clusters").select("cluster_id", identity.cluster_id(F.col("member_candidate_ids")).alias("computed_id")).distinct()


def built_candidates(spark, sf_dir):
    made, _ = candidates.build_candidates(table(spark, sf_dir, "observations"))
    return made.select("record_id", *[F.array_join(f, "|").alias(f) for f in ("names", "phones", "emails", "website_urls")])


def refused_records(spark, sf_dir):
    return candidates.build_candidates(table(spark, sf_dir, "observations"), 8)[1].select("record_id", "field", "n")


def batch_violations(spark, sf_dir):
    apart = _decided(spark, sf_dir).filter("disposition in ('manual_separate', 'manual_match')").select("left_candidate_id", "right_candidate_id", "disposition")
    return candidates.batch_violations(table(spark, sf_dir, "candidates"), apart, table(spark, sf_dir, "prior_clusters")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def snapshot_violations(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    snap = resolve.resolve(parts, t=resolve.Thresholds(candidate_limit=None, pair_limit=None))
    return candidates.snapshot_violations(snap.pairs, snap.clusters, parts)


QUERIES = {f.__name__: f for f in (er_block_keys, er_block_pairs, er_pair_features, er_dispositions, er_pair_identity, er_components, er_clusters_constrained, er_blocked_edges, er_lineage, cluster_facts, cluster_issues, cluster_identity, built_candidates, refused_records, batch_violations, snapshot_violations)}

_PARTS = """with c as (select lpad(p_partkey::varchar, 12, '0') as id, p_type || '|' || p_brand as kind, lower(p_name) as name, p_brand as src from part),
tok as (select id, kind, name, src, list_sort(list_distinct(regexp_extract_all(name, '[a-z0-9]+'))) as t from c),
keys as (select id, 'name:' || kind || ':exact:' || array_to_string(t, ' ') as k from tok where len(t) > 0
  union select id, 'name:' || kind || ':prefix:' || left(x, 4) from (select id, kind, unnest(t) as x from tok) where length(x) >= 4),
prs as (select distinct a.id as l, b.id as r from keys a join keys b on a.k = b.k and a.id < b.id)"""
_FEATURES = _PARTS + """,
f as (select l, r, a.kind = b.kind as kinds, case when a.name = b.name then 10000 else (greatest(length(a.name), length(b.name)) - levenshtein(a.name, b.name)) * 10000 // greatest(length(a.name), length(b.name)) end as bps,
  (a.src = b.src)::int as src, 'sha256:' || sha256('["' || l || '","' || r || '"]') as pid from prs join c a on a.id = l join c b on b.id = r)"""
_UUID = "regexp_replace(regexp_replace(lower({0}), '[^0-9a-f]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
_LINKS = f"""p as (select pair_id as p, {_UUID.format('left_candidate_id')} as l, {_UUID.format('right_candidate_id')} as r, disposition, recorded_at_utc from pairs),
last as (select p, arg_max(least(l, r), recorded_at_utc) as l, arg_max(greatest(l, r), recorded_at_utc) as r, arg_max(disposition, recorded_at_utc) as d from p group by 1),
e as (select l, r from last where d in ('auto_match', 'manual_match') and l <> r), g as (select l as x, r as y from e union select r, l from e),
walk(x, y) using key (x) as (select x, min(least(x, y)) from g group by 1 union select g.x, min(w.y) from g join walk w on w.x = g.y join recurring.walk o on o.x = g.x where w.y < o.y group by 1)"""

_VALUES = """v as (select distinct source_record_id as record_id, case field_key when 'display_name' then 'names' when 'legal_name' then 'names' when 'phone' then 'phones' when 'email' then 'emails' when 'website' then 'website_urls' when 'address' then 'addresses' end as field,
  coalesce(value.text, nullif(array_to_string(list_filter([value.address.street_address, value.address.postal_code, value.address.locality, value.address.region, value.address.country_code], lambda x: x is not null and x <> ''), ', '), ''), value.address.free_form) as v
  from observations where state = 'observed' and source_record_id is not null),
u as (select record_id, field, trim(regexp_replace(v, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g')) as v from v where field is not null and v is not null and regexp_matches(v, '[\\p{L}\\p{N}]')
  and lower(trim(v)) not in ('none','null','nil','nan','n/a','n.a.','na','k. a.','k.a.','keine angabe','keine angaben','unbekannt','nicht bekannt','unknown','not known','tbd','tba','xxx','xx','(leer)','leer','(empty)','empty','ohne','fehlt','missing','not available','nicht vorhanden'))"""

SQL = {
    "refused_records": f"with {_VALUES} select record_id, field, count(distinct case when field in ('names', 'emails', 'addresses') then lower(v) else v end) as n from u group by 1, 2 having n > 8",
    "built_candidates": f"""with {_VALUES}, w as (select distinct record_id, field, case when field in ('names', 'emails', 'addresses') then lower(replace(v, 'İ', 'i' || chr(775))) else v end as v from u), big as (select distinct record_id from (select record_id, field from w group by 1, 2 having count(*) > 64)),
l as (select record_id, field, string_agg(v, '|' order by v) as vs from w where record_id not in (select record_id from big) group by 1, 2)
select record_id, """ + ", ".join(f"coalesce(max(vs) filter (field = '{f}'), '') as {f}" for f in ("names", "phones", "emails", "website_urls")) + """ from l group by 1""",
    "cluster_identity": """with h as (select distinct cluster_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ('entity-resolution-cluster:' || array_to_string(list_sort(list_distinct(member_candidate_ids)), ','))::blob) as h from prior_clusters)
select cluster_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || case when substr(h, 17, 1) in ('0', '4', '8', 'c') then '8' when substr(h, 17, 1) in ('1', '5', '9', 'd') then '9' when substr(h, 17, 1) in ('2', '6', 'a', 'e') then 'a' else 'b' end || substr(h, 18, 3) || '-' || substr(h, 21, 12) as computed_id from h""",
    "cluster_issues": """with c as (select distinct on (candidate_id) * from candidates), m as (select distinct cluster_id, unnest(member_candidate_ids) as candidate_id from prior_clusters), j as (select * from m join c using (candidate_id)),
v as (select cluster_id, 's' as f, unnest(source_keys) as x from j union select cluster_id, 'w', unnest(website_urls) from j union select cluster_id, 'n', unnest(names) from j),
n as (select cluster_id, count(*) filter (f = 's') as s, count(*) filter (f = 'w') as w, count(*) filter (f = 'n') as n from v group by 1),
k as (select cluster_id, count(distinct entity_kind) as kinds, min(entity_kind) in ('place', 'organization') as ruled, bool_or(coalesce(len(observation_ids), 0) = 0 or coalesce(len(source_artifact_ids), 0) = 0 or coalesce(len(source_keys), 0) = 0) as bare,
  bool_or(geography.coverage not in ('inside', 'boundary', 'unknown')) as away, bool_or(geography.coverage = 'boundary') as edge from j group by 1),
i as (select cluster_id, list_sort(list_filter([case when kinds <> 1 then 'MIXED_ENTITY_KINDS' end, case when kinds = 1 and not ruled then 'MISSING_QUALITY_POLICY' end, case when bare then 'MISSING_OBSERVATION_PROVENANCE' end,
  case when kinds = 1 and ruled and coalesce(n.n, 0) = 0 then 'REQUIRED_FIELD_ABSENT:names' end, case when kinds = 1 and ruled and n.w > 1 then 'SINGLE_VALUE_FIELD_CONFLICT:website_urls' end, case when kinds = 1 and ruled and coalesce(n.s, 0) < 2 then 'INSUFFICIENT_DISTINCT_SOURCES' end,
  case when kinds = 1 and ruled and away then 'GEOGRAPHY_NOT_ALLOWED' end, case when kinds = 1 and ruled and edge then 'GEOGRAPHY_BOUNDARY_REVIEW_REQUIRED' end], lambda x: x is not null)) as i from k left join n using (cluster_id))
select cluster_id, array_to_string(i, ',') as issues from i""",
    "er_block_keys": """with c as (select distinct candidate_id, entity_kind, names, phones, emails, website_urls, addresses from candidates),
t as (select candidate_id, entity_kind, p, list_sort(list_distinct(regexp_extract_all(v, '[a-z0-9]+'))) as t from
  (select candidate_id, entity_kind, 'name' as p, unnest(names) as v from c union all select candidate_id, entity_kind, 'address', unnest(addresses) from c) where v is not null)
select candidate_id, p || ':' || entity_kind || ':exact:' || array_to_string(t, ' ') as key from t where len(t) > 0
union select candidate_id, p || ':' || entity_kind || ':prefix:' || left(x, 4) from (select candidate_id, entity_kind, p, unnest(t) as x from t) where length(x) >= 4
union select candidate_id, 'phone:' || v from (select candidate_id, unnest(phones) as v from c) where v is not null
union select candidate_id, 'email:' || v from (select candidate_id, unnest(emails) as v from c) where v is not null
union select candidate_id, 'website:' || regexp_extract(lower(v), '^[a-z]+://([^/?#:]+)', 1) from (select candidate_id, unnest(website_urls) as v from c) where v is not null""",
    "er_block_pairs": _PARTS + " select l as left_candidate_id, r as right_candidate_id from prs",
    "er_pair_features": _FEATURES + """ select pid as pair_id, l as left_candidate_id, r as right_candidate_id, false as exact_phone_overlap, false as exact_email_overlap, false as exact_website_host_overlap, bps::int as name_similarity_bps,
  0 as address_similarity_bps, kinds as entity_kind_compatible, true as geography_compatible, src as source_overlap_count, 0 as strong_non_name_feature_count, bps > 0 as name_only from f""",
    "er_dispositions": _FEATURES + """ select pid as pair_id, l as left_candidate_id, r as right_candidate_id, bps::int as name_similarity_bps, case when not kinds then 'no_match' when bps > 0 then 'review_required' else 'no_match' end as disposition,
  case when not kinds then 'ENTITY_KIND_MISMATCH' when bps > 0 then 'AMBIGUOUS_MATCH_REQUIRES_REVIEW' else 'INSUFFICIENT_MATCH_EVIDENCE' end as reasons, least(100000, bps)::int as evidence_strength from f""",
    "er_pair_identity": f"with p as (select {_UUID.format('left_candidate_id')} as l, {_UUID.format('right_candidate_id')} as r from pairs) select distinct 'sha256:' || sha256('[\"' || least(l, r) || '\",\"' || greatest(l, r) || '\"]') as pair_id, least(l, r) as lo, greatest(l, r) as hi from p where l <> r",
    "er_components": f"with recursive {_LINKS} select x as candidate_id, y as label from walk",
    "er_lineage": f"""with recursive {_LINKS},
m as (select c.candidate_id, coalesce(w.y, c.candidate_id) as root from (select distinct candidate_id from candidates) c left join walk w on w.x = c.candidate_id),
s as (select root, count(*) as size from m group by 1), o as (select cluster_id, list_distinct(member_candidate_ids) as old from (select distinct on (cluster_id) * from prior_clusters)),
sh as (select root, cluster_id, count(*) as common from m join (select cluster_id, unnest(old) as candidate_id from o) using (candidate_id) group by 1, 2),
q as (select root, count(*) as n, sum(common) as common, sum(len(old)) as old, string_agg(cluster_id, ',' order by cluster_id) as parents from sh join o using (cluster_id) group by 1)
select s.root, case when n is null then 'new' when n = 1 and common = size and old = size then 'unchanged' when n = 1 and common = size and old > size then 'split' when n > 1 and common = size and old = size then 'merge' else 'recombined' end as lineage_kind,
  coalesce(parents, '') as parents from s left join q using (root)""",
    "cluster_facts": """with c as (select distinct on (candidate_id) * from candidates), m as (select distinct cluster_id, unnest(member_candidate_ids) as candidate_id from prior_clusters), j as (select * from m join c using (candidate_id)),
v as (select cluster_id, 's' as f, unnest(source_keys) as x from j union select cluster_id, 'p', unnest(phones) from j union select cluster_id, 'n', unnest(names) from j),
n as (select cluster_id, count(*) filter (f = 's') as s, count(*) filter (f = 'p') as p, count(*) filter (f = 'n') as nn from v group by 1)
select cluster_id, string_agg(distinct entity_kind, ',' order by entity_kind) as kinds, any_value(coalesce(n.s, 0))::int as sources, any_value(coalesce(n.p, 0))::int as phones, any_value(coalesce(n.nn, 0))::int as names, count(*) as members,
  bool_or(coalesce(len(observation_ids), 0) = 0 or coalesce(len(source_artifact_ids), 0) = 0 or coalesce(len(source_keys), 0) = 0) as provenance_missing from j left join n using (cluster_id) group by 1""",
}
