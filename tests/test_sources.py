import json

from pyspark.sql import functions as F

from weftline.functions import url
from weftline.operators.extract import entity_kinds, extract_pages, page_fields
from weftline.sources import maps, seeds, web

GOOD = {"expected_entity_kind": "place", "display_name": "A", "website": None, "osm_id": None, "reference_urls": ["https://x.example/"], "note": None, "provenance": "p"}
HEAD = ",".join(seeds.HEADER)


def codes(content, kind, **kw):
    return [r.get("code") for r in seeds.read_seed_file(f"f.{kind}", content, kind, **kw)]


def test_seed_csv():
    text = HEAD + '\nplace,"A\nB",,,https://a.example/ | https://b.example/,,p\nplace,C\n'
    rows = seeds.read_seed_file("f.csv", text.encode(), "csv")
    assert rows[0]["display_name"] == "A\nB" and rows[0]["locator"] == "line:3" and rows[0]["reference_urls"] == ["https://a.example/", "https://b.example/"] and rows[0]["website"] is None
    assert rows[1]["code"] == "CSV_ROW_SHAPE_INVALID"
    assert codes(b"a,b\n", "csv") == ["CSV_HEADER_MISMATCH"] and codes(b"a,a\n", "csv") == ["CSV_HEADER_INVALID"] and codes((HEAD + '\n"x').encode(), "csv") == ["CSV_MALFORMED"]


def test_seed_json_and_lines():
    assert codes(json.dumps(GOOD).encode(), "json") == [None]
    assert codes(json.dumps([GOOD, 3, GOOD | {"x": 1}]).encode(), "json") == [None, "JSON_RECORD_INVALID", "RECORD_INVALID"]
    assert codes(b'{"a":1,"a":2}', "json") == ["JSON_MALFORMED"] and codes(b"[NaN]", "json") == ["JSON_MALFORMED"] and codes(b"3", "json") == ["JSON_ROOT_INVALID"]
    lines = seeds.read_seed_file("f.jsonl", ("\n" + json.dumps(GOOD) + "\n\n{bad\n").encode(), "jsonl")
    assert [(r["locator"], r.get("code")) for r in lines] == [("line:2", None), ("line:4", "JSONL_MALFORMED")]


def test_seed_file_bounds():
    assert codes(b"", "csv") == ["FILE_EMPTY"] and codes(b"\xff\xfe", "json") == ["ENCODING_INVALID"] and codes(b"12345", "json", max_bytes=3) == ["FILE_TOO_LARGE"] and codes(b"x", "xml") == ["FORMAT_UNSUPPORTED"]
    assert codes(json.dumps([GOOD] * 3).encode(), "json", max_records=2) == ["RECORD_LIMIT_EXCEEDED"]


def test_seed_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.jsonl").write_text(json.dumps(GOOD) + "\n{")
    (tmp_path / "two.json").write_text(json.dumps([GOOD, GOOD]))
    parsed = seeds.scan_seed_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: (r.valid, r.issues, r.outcome) for r in seeds.import_summary(parsed, atomic=False).collect()}
    assert got == {"one.jsonl": (1, 1, "partial"), "two.json": (2, 0, "accepted")}


def test_map_elements(spark):
    body = json.dumps({"osm3s": {"timestamp_osm_base": "2025-01-01T00:00:00Z"}, "elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"addr:street": "S", "name": "N"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}}, {"type": "area", "id": 3}, {"type": "node", "id": -1, "lat": 1.0, "lon": 1.0}]})
    df = spark.createDataFrame([("a", body), ("b", "{"), ("c", '{"x":1,"elements":[]}'), ("d", "{}")], "id string, body string")
    got = [(r.id, r.element_type, r.latitude, r.address.street if r.address else None, r.issue) for r in maps.parse_map_elements(df).orderBy("id", "position").collect()]
    assert got == [
        ("a", "node", 1.0, "S", None), ("a", "way", 3.0, None, None), ("a", "area", None, None, "ELEMENT_TYPE_INVALID"), ("a", "node", 1.0, None, "ELEMENT_ID_INVALID"),
        ("b", None, None, None, "JSON_INVALID"), ("c", None, None, None, "ROOT_FIELD_UNKNOWN"), ("d", None, None, None, "ELEMENTS_INVALID"),
    ]


def test_boundaries():
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    doc = lambda c, t="Polygon": json.dumps({"type": t, "coordinates": c}).encode()
    good = maps.read_boundary(doc([ring]))
    assert good["positions"] == 4 and good["canonical"] == '{"coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]],"type":"Polygon"}'
    bad = {"TYPE_INVALID": doc([0, 0], "Point"), "RING_OPEN": doc([ring[:3] + [[2, 2]]]), "RING_DEGENERATE": doc([[[0, 0], [1, 1], [0, 0], [0, 0]]]), "COORDINATE_INVALID": doc([[[181, 0], *ring]]), "RING_INVALID": doc([ring[:2]]), "JSON_INVALID": b"{", "FIELDS_INVALID": b'{"type":"Polygon"}', "ENCODING_INVALID": b"\xff"}
    assert {k: maps.read_boundary(v).get("issue") for k, v in bad.items()} == {k: k for k in bad}


def test_robots_sitemap_links(spark):
    r = web.read_robots("https://a.example/robots.txt", b"User-agent: *\nDisallow: /x\nCrawl-delay: 3\nSitemap: https://a.example/s.xml\nSitemap: https://b.example/s.xml", "bot")
    assert r == {"allowed": True, "crawl_delay": 3.0, "sitemaps": ["https://a.example/s.xml"], "issue": None}
    assert web.sitemap_links("u", b"<!DOCTYPE x><urlset/>")[2] == "DTD_FORBIDDEN" and web.sitemap_links("u", b"<a/>")[2] == "ROOT_UNSUPPORTED" and web.sitemap_links("u", b"<a")[2] == "XML_INVALID"
    page = b'<a href="/studio?utm_source=x">s</a><a href="https://other.example/">o</a><a href="/prices/">p</a><link rel="canonical" href="/home">'
    df = spark.createDataFrame([("https://a.example/", bytearray(page)), ("https://a.example/s.xml", bytearray(b"<urlset xmlns='n'><url><loc> https://a.example/z </loc></url></urlset>"))], "url string, content binary")
    links = web.parse_links(df, ("utm_source",))
    assert {(r.link, r.canonical) for r in links.collect()} == {("https://a.example/studio", False), ("https://a.example/prices/", False), ("https://a.example/home", True), ("https://a.example/z", False)}
    ranked = web.rank_links(links, [("prices", ("price",), 9), ("studio", ("studio",), 5)], 1).collect()
    assert [(r.link, r.score, r.key) for r in ranked] == [("https://a.example/prices/", 9, "prices")]


def test_urls(spark):
    n = url.normalize_url
    assert n("HTTPS://Exämple.COM:443/a/../services/?z=2&utm_source=x&a=1#f", frozenset({"utm_source"})) == "https://xn--exmple-cua.com/services/?a=1&z=2"
    assert n("http://h.example:8080") == "http://h.example:8080/" and n("ftp://h/") is None and n("https://u:p@h/") is None and n("") is None and n(None) is None and n("http://h:99999/") is None
    df = spark.createDataFrame([("https://A.example/x?b=1", "text/HTML; charset=x", "10.0.0.1"), (None, None, None), ("nope", "", "8.8.8.8")], "u string, h string, a string")
    got = df.select(url.url_origin(F.col("u")).alias("o"), url.media_type(F.col("h")).alias("m"), url.is_public_address(F.col("a")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("https://a.example", "text/html", False), (None, None, False), (None, "", True)]
    hosts = spark.createDataFrame([("a.b.example",), ("x.co.uk",), ("w.x.co.uk",), ("example",)], "h string").select(url.registrable_domain(F.col("h")).alias("d")).collect()
    assert [r.d for r in hosts] == ["b.example", "x.co.uk", "x.co.uk", "example"]


PAGE = """<html lang=de><head><title> My  Studio </title><link rel="canonical" href="https://s.example/"><script type="application/ld+json">{"@graph":[{"@type":["Place","http://schema.org/LocalBusiness"],"name":"S","telephone":"tel:+49 30",
"email":"mailto:a@b.c","address":{"streetAddress":"X 1","addressCountry":"de"},"knowsLanguage":["de","en","de"],"offers":{"price":"65,5","priceCurrency":"eur","unitText":"hour"},"review_text":"secret"}]}</script></head>
<body><h1>Hello <b>World</b></h1><p>One<p>Two <i>x</i><ul><li>a<li>b</ul><address>Street 1<br>Town</address><a href="mailto:x%40y.z?subject=1">m</a><a href="tel:+4930">t</a><a href="https://instagram.com/u">i</a></body></html>"""


def test_extraction(spark):
    fields = page_fields(PAGE, frozenset({"review_text"}))
    by = {}
    for f in fields:
        by.setdefault(f["field_key"], []).append(f["text"] if f["values"] is None else f["values"])
    assert by["display_name"] == ["S", "My Studio"] and by["email"] == ["a@b.c", "x@y.z"] and by["phone"] == ["+49 30", "+4930"] and by["supported_languages"] == [["de", "en"]]
    assert by["address"] == [["X 1", "", "", "", "DE"], "Street 1 Town"] and by["hourly_price"] == [["65.5", "EUR", "hour"]] and by["instagram"] == ["https://instagram.com/u"]
    assert by["text_block"] == ["Hello World", "One", "Two x", "a", "b", "Street 1 Town"] and by["review_text"] == [None]
    assert all(f["evidence_span"] is None for f in fields if f["field_key"] == "review_text")
    df = spark.createDataFrame([("r1", bytearray(PAGE.encode()), None), ("r2", bytearray(b""), None), ("r3", bytearray(b"<p>x"), "sha256:0"), ("r4", None, None)], "record_id string, content binary, digest string")
    out = extract_pages(df)
    assert {r.record_id: r.issue for r in out.filter("issue is not null").collect()} == {"r2": "DOCUMENT_EMPTY", "r3": "RAW_DIGEST_MISMATCH", "r4": "DOCUMENT_EMPTY"}
    assert entity_kinds(out).collect()[0].entity_kinds == ["organization", "place"]


def test_map_queries_and_features(spark):
    plan = maps.plan_map_queries([(0.0, -0.0), (1.5, 2.0)], ["node", "way"], [(f"k{n}", ["a.b", "c"]) for n in range(3)], 2)
    assert [p["position"] for p in plan] == [0, 1] and plan[1]["query"] == '[out:json][timeout:60];(node["k2"~"^(?:a\\.b|c)$"](poly:"0 0 1.5 2");way["k2"~"^(?:a\\.b|c)$"](poly:"0 0 1.5 2"););out body center qt;'
    texts = spark.createDataFrame([(1.5,), (-0.0,), (0.12345678,)], "v double").select(maps.coordinate_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in texts] == ["1.5", "0", "0.1234568"]
    docs = ['{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[]}},{"type":"Feature","geometry":null}]}', '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}}', '{"type":"MultiPolygon","coordinates":[]}']
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "id int, content string")
    assert [(r.id, r.position, r.type) for r in maps.feature_geometries(df).orderBy("id", "position").collect()] == [(0, 0, "Polygon"), (0, 1, None), (1, 0, "Point"), (2, 0, "MultiPolygon")]


def test_robots_groups():
    from weftline.sources.web import root_access, robots_records

    read = lambda text, agent="weftline/1": root_access(list(robots_records(text)), agent)
    assert read("") == (True, None) and read("User-agent: *\nDisallow: /\nCrawl-delay: 4 # s\n") == (False, 4)
    assert read("User-agent: other\nUser-agent: Weftline\nDisallow:\nCrawl-delay: x\n\nUser-agent: *\nDisallow: /") == (True, None)
    assert read("User-agent: *\nAllow: /\nDisallow: /") == (True, None) and read("Disallow: /") == (True, None)
    assert read("User-agent: *\nDisallow: /private") == (True, None) and read("User-agent: a\n\nDisallow: /\nUser-agent: *\nDisallow: *") == (False, None)


def test_addresses_taken_apart():
    from weftline.functions.url import is_canonical, normalize_url, observed_url

    assert normalize_url("HTTPS://Müller.example:443/a/./b/../c//d/?z=1&a=%20x&utm=2#f", frozenset({"utm"})) == "https://xn--mller-kva.example/a/c/d/?a=+x&z=1"
    assert normalize_url("http://[::1]:8080") == "http://[::1]:8080/" and observed_url(" http://a.example:80/x?q=%41#y") == "http://a.example/x?q=%41"
    for bad in (None, "", "ftp://a/", "//a/", "http:///x", "http://u@a/", "http://a:0/", "http://a:70000/", "http://a b\n/", "http://a..b/", "x" * 5000):
        assert normalize_url(bad) is None
    assert is_canonical("https://a.example/") and not is_canonical("https://a.example")


def test_microdata_fields():
    from weftline.operators.extract import page_fields

    html = """<div itemscope itemtype="https://schema.org/LocalBusiness"><span itemprop="name">Ton  <b>Haus</b></span><meta itemprop="telephone" content="+49301">
    <div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><span itemprop="streetAddress">Weg 1</span><span itemprop="addressCountry">de</span></div>
    <a itemprop="sameAs" href="https://instagram.com/x">i</a></div>"""
    got = {(f["field_key"], f["locator"]): f["text"] or f["values"] for f in page_fields(html) if f["locator_kind"] == "json_pointer"}
    assert got == {("schema_type", "/microdata/0/@type"): "LocalBusiness", ("display_name", "/microdata/0/name/0"): "Ton Haus", ("phone", "/microdata/0/telephone/0"): "+49301",
                   ("address", "/microdata/0/address/0"): ["Weg 1", "", "", "", "DE"], ("instagram", "/microdata/0/sameAs/0"): "https://instagram.com/x"}
