"""Scans of map data: element responses of a map API and GeoJSON boundaries."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import as_frame
from weftline.sources.seeds import strict_json

_ROOT = {"version", "generator", "osm3s", "elements", "remark"}
_ELEMENT = "type string, id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
_OUT = ("base_time", "position", "element_type", "osm_id", "lat", "lon", "center", "latitude", "longitude", "tags", "address", "source_url", "issue")
MAX_POSITIONS = 100_000


def parse_map_elements(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per element of map API responses (JSON texts): type, id, position, tags and address; their other columns stay.

    Ways and relations use their center. Everything is read by the JSON reader of the JVM with an explicit schema.
    ``issue`` says why an element or a whole response is refused; its other columns are then null as far as they were
    not readable.
    """
    keys = F.json_object_keys(body)
    doc = F.from_json(body, f"generator string, osm3s struct<timestamp_osm_base:string>, elements array<struct<{', '.join(x.replace(' ', ':', 1) for x in _split(_ELEMENT))}>>", {"mode": "PERMISSIVE"})
    rows = responses.withColumn("_d", doc).withColumn("_bad", F.when(keys.isNull(), "JSON_INVALID").when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in sorted(_ROOT)]))) > 0, "ROOT_FIELD_UNKNOWN").when(F.col("_d.elements").isNull(), "ELEMENTS_INVALID"))
    keep = [c for c in responses.columns if c not in (body, *_OUT)]
    good = rows.filter("_bad is null").select(*keep, F.try_to_timestamp(F.col("_d.osm3s.timestamp_osm_base")).alias("base_time"), F.posexplode("_d.elements").alias("position", "e")).select(*keep, "base_time", "position", F.col("e.type").alias("element_type"), F.col("e.id").alias("osm_id"), "e.lat", "e.lon", "e.center", "e.tags")
    lat = F.when(F.col("element_type") == "node", F.col("lat")).otherwise(F.col("center.lat"))
    lon = F.when(F.col("element_type") == "node", F.col("lon")).otherwise(F.col("center.lon"))
    issue = (
        F.when(~F.coalesce(F.col("element_type").isin("node", "way", "relation"), F.lit(False)), "ELEMENT_TYPE_INVALID").when(~F.coalesce(F.col("osm_id") > 0, F.lit(False)), "ELEMENT_ID_INVALID")
        .when(~F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False)), "ELEMENT_POSITION_INVALID")
    )
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    address = F.struct(*[tag(f"addr:{k}").alias(n) for k, n in (("housenumber", "house_number"), ("street", "street"), ("postcode", "postcode"), ("city", "city"), ("country", "country"))])
    out = good.select(*keep, "base_time", "position", "element_type", "osm_id", lat.alias("latitude"), lon.alias("longitude"), "tags", address.alias("address"), F.concat_ws("/", F.lit("https://www.openstreetmap.org"), "element_type", "osm_id").alias("source_url"), issue.alias("issue"))
    bad = rows.filter("_bad is not null").select(*keep, *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns if c not in keep and c != "issue"], F.col("_bad").alias("issue"))
    return out.unionByName(bad)


def _split(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:k].strip())
            at = k + 1
    return [*out, ddl[at:].strip()]


def read_boundary(body: bytes) -> dict:
    """A GeoJSON Polygon or MultiPolygon as canonical text, digest and nested coordinates, or the code of what is wrong."""
    seen = 0

    def number(v, most):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or abs(v) > most:
            raise ValueError("COORDINATE_INVALID")
        return float(v) or 0.0

    def ring(value):
        nonlocal seen
        if not isinstance(value, list) or len(value) < 4:
            raise ValueError("RING_INVALID")
        out = []
        for p in value:
            if not isinstance(p, list) or len(p) != 2:
                raise ValueError("POSITION_INVALID")
            out.append([number(p[0], 180), number(p[1], 90)])
        seen += len(out)
        if seen > MAX_POSITIONS:
            raise ValueError("POSITION_LIMIT_EXCEEDED")
        if out[0] != out[-1]:
            raise ValueError("RING_OPEN")
        if len({tuple(p) for p in out}) < 3:
            raise ValueError("RING_DEGENERATE")
        return out

    def polygon(value):
        if not isinstance(value, list) or not value:
            raise ValueError("COORDINATES_INVALID")
        return [ring(r) for r in value]

    try:
        try:
            doc = strict_json(body.decode("utf-8-sig"))
        except UnicodeDecodeError:
            raise ValueError("ENCODING_INVALID") from None
        except ValueError:
            raise ValueError("JSON_INVALID") from None
        if not isinstance(doc, dict) or set(doc) != {"type", "coordinates"}:
            raise ValueError("FIELDS_INVALID")
        kind, value = doc["type"], doc["coordinates"]
        if kind not in ("Polygon", "MultiPolygon"):
            raise ValueError("TYPE_INVALID")
        if kind == "MultiPolygon" and (not isinstance(value, list) or not value):
            raise ValueError("COORDINATES_INVALID")
        polygons = [polygon(value)] if kind == "Polygon" else [polygon(p) for p in value]
    except ValueError as e:
        return {"issue": str(e)}
    text = json.dumps({"coordinates": polygons[0] if kind == "Polygon" else polygons, "type": kind}, sort_keys=True, separators=(",", ":"))
    return {"geometry_type": kind, "geometry_digest": "sha256:" + sha256(text.encode()).hexdigest(), "canonical": text, "positions": seen, "coordinates": polygons}


def parse_boundaries(files: DataFrame, content: str = "content") -> DataFrame:
    """Boundaries of GeoJSON files with their digest and coordinates; ``issue`` is set where a file is refused."""
    names = ["geometry_type", "geometry_digest", "canonical", "positions", "coordinates", "issue"]
    keep = [f for f in files.schema.fields if f.name not in (content, *names)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "geometry_type string", "geometry_digest string", "canonical string", "positions int", "coordinates array<array<array<array<double>>>>", "issue string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            read = as_frame([read_boundary(bytes(c or b"")) for c in pdf[content]], names)
            yield pd.concat([pdf[[f.name for f in keep]].reset_index(drop=True), read], axis=1)

    return files.mapInPandas(run, schema)


def envelope(areas: DataFrame, key: str = "area_key", coordinates: str = "coordinates") -> DataFrame:
    """Least and greatest longitude and latitude of every area."""
    point = areas.select(key, F.explode(F.flatten(F.flatten(coordinates))).alias("p"))
    lon, lat = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return point.groupBy(key).agg(F.min(lon).alias("min_lon"), F.min(lat).alias("min_lat"), F.max(lon).alias("max_lon"), F.max(lat).alias("max_lat"))


def coordinate_text(value) -> object:
    """A coordinate column with up to seven decimals, without closing zeros; minus zero is zero."""
    text = F.regexp_replace(F.format_string("%.7f", value.cast("double")), r"\.?0+$", "")
    return F.when(text.isin("-0", ""), "0").otherwise(text)


def map_query(polygon: list[tuple[float, float]], types: list[str], filters: list[tuple[str, list[str]]], seconds: int = 60) -> str:
    """The text of a map API query for elements of some types with tags of some values inside a polygon of (lat, lon)."""
    import re

    shown = [f"{v:.7f}".rstrip("0").rstrip(".") for p in polygon for v in p]
    inside = " ".join("0" if s in ("-0", "") else s for s in shown)
    wanted = "".join(f'{t}["{key}"~"^(?:{"|".join(map(re.escape, values))})$"](poly:"{inside}");' for t in types for key, values in filters)
    return f"[out:json][timeout:{seconds}];({wanted});out body center qt;"


def plan_map_queries(polygon: list[tuple[float, float]], types: list[str], filters: list[tuple[str, list[str]]], per_query: int = 10, most: int = 100) -> list[dict]:
    """Queries of at most ``per_query`` filters each, with position and digest; ValueError if there would be more than ``most``."""
    if not filters or not 1 <= per_query <= 20:
        raise ValueError("a plan needs filters, 1 to 20 a query")
    parts = [filters[k : k + per_query] for k in range(0, len(filters), per_query)]
    if len(parts) > most:
        raise ValueError(f"{len(parts)} queries, {most} allowed")
    texts = [map_query(polygon, types, part) for part in parts]
    return [{"position": k, "query": t, "digest": "sha256:" + sha256(t.encode()).hexdigest()} for k, t in enumerate(texts)]


def feature_geometries(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per geometry of GeoJSON texts: collections and features are flattened, a bare geometry is itself.

    ``position`` counts within the file; ``type`` and ``geometry`` (JSON) are null where a feature has none.
    """
    doc = F.try_parse_json(F.col(content).cast("string"))
    kind = F.try_variant_get(doc, "$.type", "string")
    items = F.when(kind == "FeatureCollection", F.transform(F.try_variant_get(doc, "$.features", "array<variant>"), lambda f: F.try_variant_get(f, "$.geometry", "variant"))).when(kind == "Feature", F.array(F.try_variant_get(doc, "$.geometry", "variant"))).otherwise(F.array(doc))
    rows = files.select(*[c for c in files.columns if c not in (content, "position", "type", "geometry")], F.posexplode_outer(items).alias("position", "g"))
    return rows.withColumn("type", F.try_variant_get("g", "$.type", "string")).withColumn("geometry", F.to_json("g")).drop("g")
