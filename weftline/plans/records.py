"""Queries over observations, documents and other records: latest rows, joins, pivots, checks, texts and streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from weftline.functions import text, url
from weftline.functions.values import is_usable
from weftline.operators import geo, normalize, tables
from weftline.runtime import ensure_checkpoint_dir, table

STATES = ["observed", "not_observed", "absent_in_source", "invalid", "unsupported", "expired", "disputed", "prohibited_by_policy"]


def coverage_pivot(spark, sf_dir):
    return tables.fixed_pivot(table(spark, sf_dir, "observations"), ["field_key"], "state", STATES)


def blocker_counts(spark, sf_dir):
    o = table(spark, sf_dir, "observations").filter("state <> 'observed'")
    return o.groupBy("field_key", "state", "normalizer_revision").agg(F.count(F.lit(1)).alias("n"))


def latest_revision(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return tables.latest_by(e, ["user_id"], ["ts", "event_id"])


def latest_three(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return tables.top_per_key(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)


def keyset_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    first = o.agg(F.max("o_orderdate")).first()[0]
    return tables.keyset_page(o, [("o_orderdate", True), ("o_orderkey", True)], 50, (first, 0))


def contiguity(spark, sf_dir):
    return tables.contiguous(table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_linenumber") - 1), ["l_orderkey"], "p")


def broken_chains(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_id") - 1).alias("previous_id"))
    return tables.broken_chains(e, ["user_id"], "event_id", "event_id", "previous_id").select("user_id", "event_id", "expected")


def observed_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "candidates").select("candidate_id", F.explode("observation_ids").alias("observation_id"))
    return c.join(table(spark, sf_dir, "observations").select("observation_id"), "observation_id", "left_semi").select("candidate_id").distinct()


def missing_observations(spark, sf_dir):
    named = table(spark, sf_dir, "candidates").select(F.explode("observation_ids").alias("observation_id"))
    return tables.missing_references(named, "observation_id", table(spark, sf_dir, "observations"), "observation_id")


def unnamed_observations(spark, sf_dir):
    named = table(spark, sf_dir, "candidates").select(F.explode("observation_ids").alias("observation_id"))
    return table(spark, sf_dir, "observations").select("observation_id").distinct().join(named, "observation_id", "left_anti")


def documents_known_or_free(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "candidate_id")
    return tables.null_or_exists(d, "candidate_id", table(spark, sf_dir, "candidates"), "candidate_id").select("doc_id")


def observation_lineage(spark, sf_dir):
    c = table(spark, sf_dir, "candidates").select("candidate_id", F.explode("observation_ids").alias("observation_id")).distinct()
    o = table(spark, sf_dir, "observations").select("observation_id", "source_record_id", "field_key").distinct()
    d = table(spark, sf_dir, "documents").filter("candidate_id is not null").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("documents"))
    return c.join(o, "observation_id").join(d, "candidate_id").groupBy("field_key").agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("candidate_id").alias("candidates"), F.sum("documents").alias("documents"))


def phase_fill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return tables.fill_in_phases([o.filter("o_orderstatus = 'P'").orderBy("o_orderkey").limit(30), o.filter("o_orderstatus = 'O'")], [F.asc_nulls_first("o_orderdate"), F.asc("o_orderkey")], 100)


def expiry_first(spark, sf_dir):
    o = table(spark, sf_dir, "observations").select("observation_id", F.col("evidence.observed_at_utc").alias("seen"), "recorded_at_utc").distinct()
    return o.withColumn("first", F.least("seen", "recorded_at_utc")).filter("first is not null").orderBy("first", "observation_id").limit(100).select("observation_id", "first")


def active_at(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("until", F.expr("ts + interval 2 hours"))
    at = F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")
    return e.filter((F.col("ts") <= at) & (F.col("until").isNull() | (at < F.col("until")))).select("event_id", "user_id")


def content_dedup(spark, sf_dir):
    return tables.content_dedup(table(spark, sf_dir, "documents").filter("text is not null"), "text")


def strict_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


def reference_violations(spark, sf_dir):
    c = table(spark, sf_dir, "candidates").select(F.explode("source_keys").alias("k"))
    return tables.missing_references(c, "k", table(spark, sf_dir, "source_bindings"), "source_key")


def contract_violations(spark, sf_dir):
    c = F.col
    rules = {
        "known_state": c("state").isin(*STATES), "value_if_observed": (c("state") != "observed") | c("value").isNotNull(), "evidence_if_observed": (c("state") != "observed") | c("evidence").isNotNull(),
        "recorded_after_observed": c("evidence").isNull() | c("evidence.observed_at_utc").isNull() | (c("recorded_at_utc") >= c("evidence.observed_at_utc")), "confidence_range": c("confidence").between(0, 1),
        "digest_form": c("source_policy_digest").rlike(r"\Asha256:[0-9a-f]{64}\z"),
    }
    return tables.violations(table(spark, sf_dir, "observations").dropDuplicates(["observation_id"]), "observation_id", rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def shared_members(spark, sf_dir):
    m = table(spark, sf_dir, "prior_clusters").select("cluster_id", F.explode("member_candidate_ids").alias("candidate_id")).distinct()
    return tables.duplicates(m, ["candidate_id"])


def repeated_rows(spark, sf_dir):
    return tables.duplicates(table(spark, sf_dir, "observations"), ["observation_id"])


def status_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 500 + 100).cast("int").alias("status"))
    return e.select("event_id", url.status_outcome(F.col("status")).alias("outcome"))


def retry_after(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), (F.col("event_id") * 7).cast("string"))).otherwise(F.col("event_type")).alias("h"))
    return e.select("event_id", url.retry_after_seconds(F.col("h")).alias("clamped"), url.retry_after_seconds(F.col("h"), clamp=False).alias("bounded"))


def collapsed_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.collapse(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").alias("length"), F.sha2(text.bounded(F.col("t"), 120), 256).alias("clipped"))


def observed_emails(spark, sf_dir):
    o = table(spark, sf_dir, "observations").filter("value.kind = 'email'").select("observation_id", F.col("value.text").alias("t")).distinct()
    return o.select("observation_id", normalize.email(F.col("t")).alias("email"))


def observed_phones(spark, sf_dir):
    o = table(spark, sf_dir, "observations").filter("value.kind = 'phone'").select("observation_id", F.col("value.text").alias("t")).distinct()
    return o.select("observation_id", normalize.phone(F.col("t"), "DE").alias("phone"))


def observed_urls(spark, sf_dir):
    o = table(spark, sf_dir, "observations").filter("value.kind = 'url'").select("observation_id", F.col("value.text").alias("t")).distinct()
    return o.select("observation_id", url.url_normalized(F.col("t"), ("utm_source",)).alias("url"), url.url_origin(F.col("t")).alias("origin"))


def boolean_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").dropDuplicates(["doc_id"]).select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    rules = [("grand_piano", ("grand piano", "fl(ü|ue)gel"), ("no grand piano", "kein(en)? fl(ü|ue)gel")), ("step_free", ("step-free", "stufenlos"), ())]
    return normalize.boolean_patterns(d, rules, "doc_id").select("doc_id", "field_key", "state", "value", "confidence")


def record_values(spark, sf_dir):
    o = table(spark, sf_dir, "observations").filter("state = 'observed'").select("source_record_id", "field_key", F.col("value.text").alias("v")).filter(is_usable(F.col("v")))
    return o.select("source_record_id", "field_key", text.collapse(F.col("v")).alias("value")).distinct().groupBy("source_record_id", "field_key").agg(F.count(F.lit(1)).alias("values"), F.min("value").alias("least"))


def area_coverage(spark, sf_dir):
    c = table(spark, sf_dir, "candidates")
    p = c.select(F.col("candidate_id").alias("key"), F.element_at(F.split("geography.market_area_revision", "@"), 1).alias("area"), F.col("geography.latitude").cast("double").alias("lat"), F.col("geography.longitude").cast("double").alias("lon"))
    return geo.point_coverage(p.filter(geo.has_position(F.col("lat"), F.col("lon"))).distinct(), table(spark, sf_dir, "market_areas"))


def market_envelopes(spark, sf_dir):
    from weftline.sources.maps import envelope

    return envelope(table(spark, sf_dir, "market_areas"))


def chunked_keys(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return tables.chunked(n, "n_nationkey", 10, "n_name").select("chunk", F.array_join("values", ",").alias("names"))


def append_new_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "pairs").select("pair_id", "disposition")
    return tables.append_new(table(spark, sf_dir, "blocked_edges").select(F.col("attempted_pair_id").alias("pair_id")), p, ["pair_id"]).select("pair_id")


def cursors(spark, sf_dir):
    from weftline.operators.tables import decode_cursor, encode_cursor

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", encode_cursor(F.struct("o_orderkey", "o_orderstatus")).alias("cursor"))
    return o.select("o_orderkey", decode_cursor(F.col("cursor"), "o_orderkey long, o_orderstatus string").alias("d"), "o_orderstatus").select("o_orderkey", F.col("d.o_orderkey").alias("key"), F.col("d.o_orderstatus").alias("status"))


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("time", F.col("ts").cast("timestamp"))


def _fresh(spark):
    """A new folder for a stream's progress, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/weftline-stream-{uuid4()}"


def stream_windows(spark, sf_dir):
    from weftline.streaming import events

    counts = events.windowed_counts(_stream(spark, sf_dir), "time", ["event_type"], "6 hours", "1 day")
    out = events.run_to_end(counts, "weftline_windows", _fresh(spark), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events")


def stream_once(spark, sf_dir):
    from weftline.streaming import events

    first = events.once(_stream(spark, sf_dir).select("time", "user_id", "event_type"), "time", ["user_id", "event_type"], "10000 days")
    return events.run_to_end(first, "weftline_once", _fresh(spark)).select("user_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        coverage_pivot, blocker_counts, latest_revision, latest_three, keyset_page, contiguity, broken_chains, observed_candidates, missing_observations, unnamed_observations, documents_known_or_free, observation_lineage, phase_fill,
        expiry_first, active_at, content_dedup, strict_json, reference_violations, contract_violations, shared_members, repeated_rows, status_outcomes, retry_after, collapsed_texts, observed_emails, observed_phones, observed_urls,
        boolean_fields, record_values, area_coverage, market_envelopes, chunked_keys, append_new_pairs, cursors, stream_windows, stream_once,
    )
}

_BLANKS = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{001c}-\x{001f}\x{000b}]+"
_STAND_INS = "('none','null','nil','nan','n/a','n.a.','na','k. a.','k.a.','keine angabe','keine angaben','unbekannt','nicht bekannt','unknown','not known','tbd','tba','xxx','xx','(leer)','leer','(empty)','empty','ohne','fehlt','missing','not available','nicht vorhanden')"
_AREA_SQL = """pos as (select distinct candidate_id, split_part(geography.market_area_revision, '@', 1) as own, geography.latitude::double as la, geography.longitude::double as lo from candidates
  where geography.latitude is not null and geography.longitude is not null and not (geography.latitude = 0 and geography.longitude = 0) and abs(geography.latitude) <= 90),
ring as (select area_key, unnest(flatten(coordinates)) as r from market_areas), pt as (select area_key, r, unnest(range(1, len(r))) as i from ring),
edge as (select distinct area_key, r[i][1] as x1, r[i][2] as y1, r[i + 1][1] as x2, r[i + 1][2] as y2 from pt),
hit as (select candidate_id, own, area_key, (x2 - x1) * (la - y1) - (y2 - y1) * (lo - x1) as side, la, lo, x1, y1, x2, y2 from pos, edge),
cov as (select candidate_id, own, area_key, bool_or(side = 0 and lo between least(x1, x2) and greatest(x1, x2) and la between least(y1, y2) and greatest(y1, y2)) as on_edge,
  count(*) filter ((y1 > la) <> (y2 > la) and (side > 0) = (y2 > y1)) as crossed from hit group by all)"""

SQL = {
    "coverage_pivot": "select field_key, " + ", ".join(f"count(*) filter (state = '{s}') as {s}" for s in STATES) + ", count(*) as total from observations group by 1",
    "blocker_counts": "select field_key, state, normalizer_revision, count(*) as n from observations where state <> 'observed' group by all",
    "latest_revision": "select user_id, event_id, ts, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "latest_three": "select user_id, event_id, ts, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events qualify rank <= 3",
    "keyset_page": "with f as (select max(o_orderdate) as d from orders) select o_orderkey, o_orderdate, o_orderstatus from orders, f where o_orderdate < d or (o_orderdate = d and o_orderkey < 0) order by o_orderdate desc, o_orderkey desc limit 51",
    "contiguity": "select l_orderkey, count(*) as n, min(l_linenumber) = 1 and max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*) as contiguous from lineitem group by 1",
    "broken_chains": "select user_id, event_id, expected from (select user_id, event_id, lag(event_id) over (partition by user_id order by event_id) as expected from events) where event_id - 1 is distinct from expected",
    "observed_candidates": "select distinct candidate_id from (select candidate_id, unnest(observation_ids) as o from candidates) where o in (select observation_id from observations)",
    "missing_observations": "select distinct o as observation_id from (select unnest(observation_ids) as o from candidates) where o is not null and o not in (select observation_id from observations)",
    "unnamed_observations": "select distinct observation_id from observations where observation_id not in (select o from (select unnest(observation_ids) as o from candidates) where o is not null)",
    "documents_known_or_free": "select doc_id from documents where candidate_id is null or candidate_id in (select candidate_id from candidates)",
    "observation_lineage": """with c as (select distinct candidate_id, unnest(observation_ids) as observation_id from candidates), o as (select distinct observation_id, source_record_id, field_key from observations),
d as (select candidate_id, count(*) as n from documents where candidate_id is not null group by 1)
select field_key, count(*) as observations, count(distinct candidate_id) as candidates, sum(n)::bigint as documents from c join o using (observation_id) join d using (candidate_id) group by 1""",
    "phase_fill": """with a as (select o_orderkey, o_orderstatus, o_orderdate, 0 as phase from (select * from orders where o_orderstatus = 'P' order by o_orderkey limit 30)),
b as (select o_orderkey, o_orderstatus, o_orderdate, 1 as phase from orders where o_orderstatus = 'O') select * from (select * from a union all select * from b) order by phase, o_orderdate nulls first, o_orderkey limit 100""",
    "expiry_first": "select observation_id, first from (select distinct observation_id, least(evidence.observed_at_utc, recorded_at_utc) as first from observations) where first is not null order by first, observation_id limit 100",
    "active_at": "select event_id, user_id from events where ts <= timestamp '2024-01-02 12:00:00' and timestamp '2024-01-02 12:00:00' < ts + interval 2 hours",
    "content_dedup": "select 'sha256:' || sha256(text) as digest, max(strlen(text))::int as bytes, count(*) as copies from documents where text is not null group by 1",
    "strict_json": "select event_id, (props::json ->> '$.k')::bigint as k from events",
    "reference_violations": "select distinct k from (select unnest(source_keys) as k from candidates) where k is not null and k not in (select source_key from source_bindings)",
    "contract_violations": f"""with o as (select distinct on (observation_id) * from observations), r as (select unnest(list_filter([
  case when not coalesce(state in ({', '.join(repr(s) for s in STATES)}), false) then 'known_state' end, case when not coalesce(state <> 'observed' or value is not null, false) then 'value_if_observed' end,
  case when not coalesce(state <> 'observed' or evidence is not null, false) then 'evidence_if_observed' end,
  case when not coalesce(evidence is null or evidence.observed_at_utc is null or recorded_at_utc >= evidence.observed_at_utc, false) then 'recorded_after_observed' end,
  case when not coalesce(confidence between 0 and 1, false) then 'confidence_range' end, case when not coalesce(regexp_full_match(source_policy_digest, 'sha256:[0-9a-f]{{64}}'), false) then 'digest_form' end], lambda x: x is not null)) as rule from o)
select rule, count(*) as n from r group by 1""",
    "shared_members": "select candidate_id, count(*) as n from (select distinct cluster_id, unnest(member_candidate_ids) as candidate_id from prior_clusters) group by 1 having n > 1",
    "repeated_rows": "select observation_id, count(*) as n from observations group by 1 having n > 1",
    "status_outcomes": """select event_id, case when s between 200 and 299 then 'succeeded' when s = 304 then 'unchanged' when s in (404, 410) then 'missing' when s in (401, 403, 451) then 'blocked'
  when s in (408, 425, 429) or s between 500 and 599 then 'retry' else 'failed' end as outcome from (select event_id, event_id % 500 + 100 as s from events)""",
    "retry_after": "select event_id, case when event_id % 3 = 0 then least(event_id * 7, 86400) end as clamped, case when event_id % 3 = 0 and event_id * 7 <= 86400 then event_id * 7 end as bounded from events",
    "collapsed_texts": f"""with t as (select doc_id, trim(regexp_replace(text, '{_BLANKS}', ' ', 'g'), ' ') as t from documents where text is not null)
select doc_id, length(t)::int as length, sha256(case when length(t) > 120 then rtrim(left(t, 119), ' ') || '…' else t end) as clipped from t""",
    "observed_emails": """with o as (select distinct observation_id, value.text as t from observations where value.kind = 'email'), p as (select observation_id, string_split(t, '@') as p from o)
select observation_id, case when len(p) = 2 and trim(p[1]) <> '' and contains(p[2], '.') then trim(p[1]) || '@' || lower(trim(p[2])) end as email from p""",
    "boolean_fields": """with d as (select distinct on (doc_id) doc_id, text from documents where text is not null), b as (select doc_id, unnest(string_split(text, chr(10))) as t from d),
h as (select doc_id, bool_or(regexp_matches(t, '(?i)no grand piano|kein(en)? fl(ü|ue)gel')) as gn, bool_or(regexp_matches(t, '(?i)grand piano|fl(ü|ue)gel')) as gp, bool_or(regexp_matches(t, '(?i)step-free|stufenlos')) as sp from b group by 1)
select doc_id, 'grand_piano' as field_key, case when gn or gp then 'observed' else 'not_observed' end as state, case when gn then false when gp then true end as value, (case when gn then 0.80 when gp then 0.75 else 1 end)::decimal(5,4) as confidence from h
union all select doc_id, 'step_free', case when sp then 'observed' else 'not_observed' end, case when sp then true end, (case when sp then 0.75 else 1 end)::decimal(5,4) from h""",
    "record_values": f"""with o as (select source_record_id, field_key, value.text as v from observations where state = 'observed'),
u as (select distinct source_record_id, field_key, trim(regexp_replace(v, '{_BLANKS}', ' ', 'g'), ' ') as value from o where v is not null and regexp_matches(v, '[\\p{{L}}\\p{{N}}]') and lower(trim(regexp_replace(v, '{_BLANKS}', ' ', 'g'))) not in {_STAND_INS})
select source_record_id, field_key, count(*) as values, min(value) as least from u group by all""",
    "area_coverage": f"with {_AREA_SQL} select candidate_id as key, area_key as area, case when on_edge then 'boundary' when crossed % 2 = 1 then 'inside' else 'outside' end as coverage from cov where area_key = own",
    "market_envelopes": "select area_key, min(p[1]) as min_lon, min(p[2]) as min_lat, max(p[1]) as max_lon, max(p[2]) as max_lat from (select area_key, unnest(flatten(flatten(coordinates))) as p from market_areas) group by 1",
    "chunked_keys": "select n_nationkey // 10 as chunk, string_agg(n_name, ',' order by n_nationkey) as names from nation group by 1",
    "append_new_pairs": "select distinct pair_id from pairs where pair_id not in (select attempted_pair_id from blocked_edges)",
    "cursors": "select o_orderkey, o_orderkey as key, o_orderstatus as status from orders",
    "stream_windows": "select strftime(time_bucket(interval 6 hours, ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as events from events group by all",
    "stream_once": "select distinct user_id, event_type from events",
    "p5_found": f"""with {_AREA_SQL},
near as (select distinct a.candidate_id as key_a, b.candidate_id as key_b from pos a join pos b on a.candidate_id < b.candidate_id and abs(a.la - b.la) < 0.001 and
  2 * 6371008.8 * asin(sqrt(least(1, power(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * power(sin(radians(b.lo - a.lo) / 2), 2)))) <= 100)
select key_a, key_b from near union select candidate_id, area_key from cov where on_edge or crossed % 2 = 1""",
}
