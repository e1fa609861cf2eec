"""Queries that write sample rows in a source's own format and scan them again: seed files, map data, boundaries, web pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.values import plain_uuid
from weftline.operators import extract, normalize
from weftline.runtime import table
from weftline.sources import maps, seeds, web


def _seed_files(spark, sf_dir):
    m = table(spark, sf_dir, "manual_seeds")
    fields = F.struct("expected_entity_kind", "display_name", "website", "osm_id", F.coalesce("reference_urls", F.array().cast("array<string>")).alias("reference_urls"), "note", "provenance")
    return m.select(F.concat("seed_id", F.lit(".json")).alias("path"), F.encode(F.to_json(fields, {"ignoreNullFields": "false"}), "UTF-8").alias("content"))


def seed_scan(spark, sf_dir):
    rows = seeds.parse_seed_files(_seed_files(spark, sf_dir))
    return rows.select(F.regexp_replace("path", r"\.json$", "").alias("seed_id"), "expected_entity_kind", "display_name", "website", F.coalesce(F.size("reference_urls"), F.lit(0)).alias("urls"), "code")


def seed_import_summary(spark, sf_dir):
    return seeds.import_summary(seeds.parse_seed_files(_seed_files(spark, sf_dir)))


def map_elements(spark, sf_dir):
    c = table(spark, sf_dir, "candidates").filter("geography.latitude is not null and geography.longitude is not null").select("candidate_id", "names", F.col("geography.latitude").alias("lat"), F.col("geography.longitude").alias("lon")).dropDuplicates(["candidate_id"])
    node = F.struct(F.lit("node").alias("type"), F.lit(7).alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.create_map(F.lit("name"), F.coalesce(F.array_join("names", ";"), F.lit(""))).alias("tags"))
    body = F.to_json(F.struct(F.lit("0.6").alias("version"), F.array(node).alias("elements")))
    rows = maps.parse_map_elements(c.select("candidate_id", body.alias("body")))
    return rows.select("candidate_id", F.col("element_type").alias("type"), "latitude", "longitude", F.try_element_at("tags", F.lit("name")).alias("name"), "source_url", "issue")


def boundary_scan(spark, sf_dir):
    a = table(spark, sf_dir, "market_areas")
    shape = F.when(F.col("geometry_type") == "Polygon", F.to_json(F.get("coordinates", F.lit(0)))).otherwise(F.to_json("coordinates"))
    body = F.encode(F.concat(F.lit('{"type":"'), "geometry_type", F.lit('","coordinates":'), shape, F.lit("}")), "UTF-8")
    return maps.parse_boundaries(a.select("area_key", body.alias("content"))).select("area_key", "geometry_type", "positions", "issue")


def _escaped(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


_TEL, _MAIL, _HTTP = r"\A\+[0-9]+\z", r"\A[a-z0-9.\-]+@[a-z0-9.\-]+\.[a-z]+\z", r"\Ahttps://[a-z0-9.\-]+/\z"


def _pages(spark, sf_dir):
    """A small page of every candidate: title, heading, telephone, mail and site links."""
    c = table(spark, sf_dir, "candidates").dropDuplicates(["candidate_id"])
    some = lambda col, pattern: F.filter(F.coalesce(col, F.array().cast("array<string>")), lambda v: F.coalesce(v.rlike(pattern), F.lit(False)))
    links = lambda col, pattern, scheme: F.array_join(F.transform(some(col, pattern), lambda v: F.concat(F.lit(f'<a href="{scheme}'), v, F.lit('">x</a>'))), "")
    name = _escaped(F.coalesce(F.get("names", F.lit(0)), F.lit("")))
    html = F.concat(F.lit("<html><head><title>"), name, F.lit("</title></head><body><h1>"), name, F.lit("</h1><p>"), links("phones", _TEL, "tel:"), links("emails", _MAIL, "mailto:"), links("website_urls", _HTTP, ""), F.lit("</p></body></html>"))
    return c.select("candidate_id", F.encode(html, "UTF-8").alias("content"), F.get("website_urls", F.lit(0)).alias("site"))


def page_contacts(spark, sf_dir):
    pages = _pages(spark, sf_dir).select(F.col("candidate_id").alias("record_id"), "content", F.lit(None).cast("string").alias("digest"))
    return extract.extract_pages(pages).filter("kind in ('phone', 'email')").select("record_id", "kind", "text").distinct()


def page_observations(spark, sf_dir):
    pages = _pages(spark, sf_dir).select(F.col("candidate_id").alias("record_id"), "content", F.lit(None).cast("string").alias("digest"))
    rules = spark.createDataFrame([("display_name", "name", "text"), ("phone", "phone", "phone"), ("email", "email", "email"), ("legal_name", "legal_name", "text")], "source_field string, target_field string, value_kind string")
    return normalize.normalize_fields(extract.extract_pages(pages), rules, "DE").groupBy("field_key", "state").agg(F.count(F.lit(1)).alias("n"))


def page_links(spark, sf_dir):
    pages = _pages(spark, sf_dir).filter(F.col("site").rlike(_HTTP)).select(F.col("site").alias("url"), "content")
    rules = [("root", ("/",), 10), ("other", ("kontakt",), 20)]
    return web.rank_links(web.parse_links(pages, ("utm_source",)), rules, 20).select("url", "link", "score", "key", "rank").distinct()


def robots_rules(spark, sf_dir):
    b = table(spark, sf_dir, "source_bindings").select(
        F.concat(F.lit("https://"), F.regexp_replace("source_key", "_", "-"), F.lit(".example/robots.txt")).alias("url"),
        F.encode(F.concat(F.lit("User-agent: *\nCrawl-delay: "), F.col("trust_rank").cast("string"), F.when(F.col("trust_rank") > 4, F.lit("\nDisallow: /")).otherwise(F.lit("\nDisallow: /private")), F.lit("\n")), "UTF-8").alias("content"),
    )
    return web.parse_robots(b, "weftline").select("url", "allowed", "crawl_delay", "issue")


def plain_ids(spark, sf_dir):
    return table(spark, sf_dir, "pairs").select(plain_uuid(F.col("left_candidate_id")).alias("id")).distinct()


QUERIES = {f.__name__: f for f in (seed_scan, seed_import_summary, map_elements, boundary_scan, page_contacts, page_observations, page_links, robots_rules, plain_ids)}

SQL = {
    "seed_scan": "select seed_id, expected_entity_kind, display_name, website, coalesce(len(reference_urls), 0)::int as urls, case when expected_entity_kind is null or display_name is null or provenance is null then 'RECORD_INVALID' end as code from manual_seeds where expected_entity_kind is not null and display_name is not null and provenance is not null",
    "seed_import_summary": "select seed_id || '.json' as path, 1 as valid, 0 as issues, 'accepted' as outcome from manual_seeds where expected_entity_kind is not null and display_name is not null and provenance is not null",
    "plain_ids": "select distinct regexp_replace(regexp_replace(lower(left_candidate_id), '[^0-9a-f]', '', 'g'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') as id from pairs",
    "page_observations": """with c as (select distinct on (candidate_id) candidate_id, names, phones, emails from candidates),
p as (select candidate_id, unnest(phones) as v from c), m as (select candidate_id, unnest(emails) as v from c), f as (
  select candidate_id, 'phone' as k, count(*) as n from (select distinct candidate_id, v from p where regexp_full_match(v, '\\+[0-9]+')) group by all union all
  select candidate_id, 'email', count(*) from (select distinct candidate_id, v from m where regexp_full_match(v, '[a-z0-9.\\-]+@[a-z0-9.\\-]+\\.[a-z]+')) group by all union all
  select candidate_id, 'name', 1 from c where trim(names[1]) <> ''),
g as (select k, sum(n) as n, count(*) as r from f group by 1)
select k as field_key, 'observed' as state, n::bigint as n from g union all select k, 'not_observed', (select count(*) from c) - r from g where r < (select count(*) from c) union all select 'legal_name', 'not_observed', count(*) from c""",
    "map_elements": "select distinct on (candidate_id) candidate_id, 'node' as type, geography.latitude::double as latitude, geography.longitude::double as longitude, coalesce(array_to_string(names, ';'), '') as name, 'https://www.openstreetmap.org/node/7' as source_url, case when abs(geography.latitude) > 90 or abs(geography.longitude) > 180 then 'ELEMENT_POSITION_INVALID' end as issue from candidates where geography.latitude is not null and geography.longitude is not null",
    "boundary_scan": "select area_key, geometry_type, len(flatten(flatten(coordinates)))::int as positions, null::varchar as issue from market_areas",
    "page_contacts": """select distinct candidate_id as record_id, 'phone' as kind, v as text from (select candidate_id, unnest(phones) as v from candidates) where regexp_full_match(v, '\\+[0-9]+')
union select distinct candidate_id, 'email', v from (select candidate_id, unnest(emails) as v from candidates) where regexp_full_match(v, '[a-z0-9.\\-]+@[a-z0-9.\\-]+\\.[a-z]+')""",
    "page_links": """select distinct website_urls[1] as url, website_urls[1] as link, 10 as score, 'root' as key, 1 as rank from candidates where regexp_full_match(website_urls[1], 'https://[a-z0-9.\\-]+/')""",
    "robots_rules": "select 'https://' || replace(source_key, '_', '-') || '.example/robots.txt' as url, trust_rank <= 4 as allowed, trust_rank::double as crawl_delay, null::varchar as issue from source_bindings",
}
