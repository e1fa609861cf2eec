"""SQL of the queries that DuckDB can express, over the same tables."""

_STAND_INS = "('none','null','nil','nan','n/a','n.a.','na','k. a.','k.a.','keine angabe','keine angaben','unbekannt','nicht bekannt','unknown','not known','tbd','tba','xxx','xx','(leer)','leer','(empty)','empty','ohne','fehlt','missing','not available','nicht vorhanden')"


def _usable(v: str) -> str:
    return f"({v} is not null and regexp_matches({v}, '[\\p{{L}}\\p{{N}}]') and lower(trim({v})) not in {_STAND_INS})"


P2_FOUND = f"""
with c as (select distinct candidate_id, source_keys, observation_ids, names, phones, emails, website_urls, addresses from candidates),
m as (select distinct cluster_id, unnest(member_candidate_ids) as candidate_id from prior_clusters),
j as (select m.cluster_id, c.* from m join c using (candidate_id)),
ok as (select cluster_id from j group by 1 having count(distinct candidate_id) >= 2),
t as (select candidate_id, min(trust_rank) as trust from (select candidate_id, unnest(source_keys) as k from c) x
  join source_bindings b on b.source_key = regexp_replace(lower(trim(x.k)), '[\\s_.-]+', '_', 'g') group by 1),
o as (select candidate_id, max(o.evidence.observed_at_utc) as seen from (select candidate_id, unnest(observation_ids) as observation_id from c) x
  join observations o using (observation_id) where o.state = 'observed' and o.recorded_at_utc >= o.evidence.observed_at_utc group by 1),
f as (select cluster_id, candidate_id, unnest([{{'k': 'names', 'v': names}}, {{'k': 'phones', 'v': phones}}, {{'k': 'emails', 'v': emails}}, {{'k': 'website_urls', 'v': website_urls}}, {{'k': 'addresses', 'v': addresses}}]) as fv from j semi join ok using (cluster_id)),
r as (select cluster_id, fv.k as field_key, f.candidate_id, row_number() over (partition by cluster_id, fv.k order by coalesce(trust, 1073741824), seen desc nulls last, f.candidate_id) as n
  from f left join t using (candidate_id) left join o using (candidate_id) where len(list_filter(fv.v, lambda x: {_usable('x')})) > 0)
select cluster_id, field_key, candidate_id from r where n = 1
"""

_ID = "regexp_replace(regexp_replace(lower({0}), '[^0-9a-f]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
_DIGEST = "'sha256:' || right(regexp_replace(lower({0}), '[^0-9a-f]', '', 'g'), 64)"

P4_FOUND = f"""
with recursive b as (select distinct {_DIGEST.format('attempted_pair_id')} as a, {_DIGEST.format('separation_pair_id')} as z from blocked_edges),
p as (select {_DIGEST.format('pair_id')} as p, {_ID.format('left_candidate_id')} as l, {_ID.format('right_candidate_id')} as r, disposition, recorded_at_utc from pairs),
live as (select l, r from p where disposition is not null qualify row_number() over (partition by p order by recorded_at_utc desc) = 1),
last as (select p, arg_max(l, recorded_at_utc) as l, arg_max(r, recorded_at_utc) as r, arg_max(disposition, recorded_at_utc) as d from p group by 1),
e as (select l as x, r as y from last where d in ('auto_match', 'manual_match') and p not in (select a from b) and l <> r union select a, z from b where a <> z),
g as (select x, y from e union select y, x from e),
walk(x, y) using key (x) as (select x, min(least(x, y)) from g group by 1
  union select g.x, min(w.y) from g join walk w on w.x = g.y join recurring.walk o on o.x = g.x where w.y < o.y group by 1)
select x as record_id, y as group_id from walk
"""

P2_OBSERVATIONS = f"""
with m as (select distinct cluster_id, {_ID.format('m')} as cid from (select cluster_id, unnest(member_candidate_ids) as m from prior_clusters)),
c as (select distinct {_ID.format('candidate_id')} as cid, observation_id from (select candidate_id, unnest(observation_ids) as observation_id from candidates))
select distinct cluster_id, observation_id from m join c using (cid) where observation_id is not null
"""

SQL = {"p2_found": P2_FOUND, "p2_observations": P2_OBSERVATIONS, "p4_found": P4_FOUND}
