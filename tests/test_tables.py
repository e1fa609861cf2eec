from datetime import datetime

from pyspark.sql import functions as F

from weftline.functions import text, values
from weftline.operators import normalize, tables
from weftline.runtime import cut, ensure_checkpoint_dir, small_side
from weftline.streaming import events


def test_usable_values_and_ids(spark):
    rows = [("x",), (None,), ("",), ("  ",), ("???",), ("N/A",), (" keine Angabe ",), ("-",), ("0",), ("ü",)]
    got = [r.u for r in spark.createDataFrame(rows, "v string").select(values.is_usable(F.col("v")).alias("u")).collect()]
    assert got == [True, False, False, False, False, False, False, False, True, True]
    u = "0006a754-36e4-4846-aab4-828f1acf2eed"
    ids = [(u,), (u.upper(),), ("{" + u + "}",), (f" {u} ",), (u.replace("-", ""),), ("urn:uuid:" + u,), ("x",), (None,)]
    assert [r.i for r in spark.createDataFrame(ids, "v string").select(values.plain_uuid(F.col("v")).alias("i")).collect()] == [u] * 6 + [None, None]
    d = "sha256:" + "ab" * 32
    assert [r.i for r in spark.createDataFrame([(d,), (d.upper(),), ("ab" * 32,), ("sha256: " + "ab" * 32,), ("sha256:12",)], "v string").select(values.plain_digest(F.col("v")).alias("i")).collect()] == [d] * 4 + [None]


def test_texts(spark):
    df = spark.createDataFrame([("  a b\n c ", "Ｇｍｂｈ Straße Müller Muehle")], "a string, b string")
    r = df.select(text.collapse(F.col("a")).alias("c"), text.bounded(F.lit("abcdef"), 4).alias("d"), text.fold_german(F.col("b")).alias("e")).first()
    assert (r.c, r.d, r.e) == ("a b c", "abc…", "gmbh strasse muller muhle")


def test_latest_and_pages(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", 2, None)], "k string, rev int, v string")
    assert sorted((r.k, r.v) for r in tables.latest_by(df, ["k"], ["rev"]).collect()) == [("a", "z"), ("b", None)]
    n = spark.range(10).withColumn("g", F.col("id") % 2)
    first = tables.keyset_page(n, [("g", True), ("id", False)], 3).collect()
    after = tables.keyset_page(n, [("g", True), ("id", False)], 3, (first[2].g, first[2].id)).collect()
    assert [r.id for r in first] == [1, 3, 5, 7] and [r.id for r in after] == [7, 9, 0, 2]


def test_checks(spark):
    df = spark.createDataFrame([(1, 5, None), (2, -1, "a")], "id int, n int, s string")
    assert sorted((r.id, r.rule) for r in tables.violations(df, "id", {"positive": F.col("n") > 0, "named": F.col("s") == "a"}).collect()) == [(1, "named"), (2, "positive")]
    own = spark.createDataFrame([("a",)], "o string")
    assert [r.s for r in tables.missing_references(df.unionByName(df.withColumn("s", F.lit("zz"))), "s", own, "o").collect()] == ["zz"]
    assert sorted(r.id for r in tables.null_or_exists(df, "s", own, "o").collect()) == [1, 2]
    sets = spark.range(1).select(tables.set_difference(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("d")).first().d
    assert (sets.missing, sets.unknown) == (["a"], ["c"])


def test_chains_and_fill(spark):
    df = spark.createDataFrame([("c", 1, "d1", None), ("c", 2, "d2", "d1"), ("c", 3, "d3", "d1")], "k string, rev int, own string, prev string")
    assert [(r.rev, r.expected) for r in tables.broken_chains(df, ["k"], "rev", "own", "prev").collect()] == [(3, "d2")]
    a, b = spark.range(3), spark.range(10, 20)
    assert [(r.phase, r.id) for r in tables.fill_in_phases([a, b], [F.asc("id")], 5).collect()] == [(0, 0), (0, 1), (0, 2), (1, 10), (1, 11)]
    row = spark.createDataFrame([(1, "é?>")], "a int, b string")
    assert row.select(tables.decode_cursor(tables.encode_cursor(F.struct("a", "b")), "a int, b string").alias("d")).first().d == (1, "é?>")
    assert row.select(tables.decode_cursor(F.lit("%%%"), "a int").alias("d")).first().d is None


def test_normalize_values(spark):
    mails = [("Info@Studio.Example",), ("a@b",), ("a@@b.c",), (" a @ Bü.de ",), (None,)]
    assert [r.e for r in spark.createDataFrame(mails, "v string").select(normalize.email(F.col("v")).alias("e")).collect()] == ["Info@studio.example", None, None, "a@xn--b-eha.de", None]
    phones = [("+49 30 123456",), ("030/123456",), ("0049 (0)30 123-456",), ("030 12 app. 3",), ("12",), (None,)]
    assert [r.p for r in spark.createDataFrame(phones, "v string").select(normalize.phone(F.col("v"), "DE").alias("p")).collect()] == ["+4930123456", "+4930123456", "+4930123456", None, None, None]
    assert spark.createDataFrame([("  Ｅxample　 Studio ",)], "v string").select(normalize.nfkc(F.col("v")).alias("t")).first().t == "Example Studio"


def test_rules_and_booleans(spark):
    schema = "record_id string, position int, field_key string, kind string, text string, values array<string>, locator_kind string, locator string, evidence_digest string, evidence_span string, prohibited boolean, issue string"
    base = ("json_pointer", "/a", "d", "s")
    rows = [("r", 0, "name", "text", "  A  B ", None, *base, False, None), ("r", 1, "offer", "money", None, ["65.5", "", "hour"], *base, False, None), ("r", 2, "secret", "text", None, None, *base, True, None), ("r", 3, "mail", "text", "x", None, *base, False, None)]
    rules = spark.createDataFrame([("name", "title", "text"), ("offer", "price", "money"), ("secret", "secret", "text"), ("mail", "mail", "email"), ("none", "none", "text")], "source_field string, target_field string, value_kind string")
    got = {r.field_key: (r.state, r.text, r.reason) for r in normalize.normalize_fields(spark.createDataFrame(rows, schema), rules).collect()}
    assert got == {"title": ("observed", "A B", None), "price": ("invalid", None, "MONEY_INCOMPLETE"), "secret": ("prohibited_by_policy", None, None), "mail": ("invalid", None, "VALUE_KIND_MISMATCH"), "none": ("not_observed", None, None)}
    blocks = spark.createDataFrame([("a", 0, "We offer MIXING."), ("a", 1, "No grand piano."), ("b", 0, "grand piano"), ("c", 0, None)], "record_id string, position int, text string")
    out = normalize.boolean_patterns(blocks, [("piano", ("grand piano",), ("no grand piano",)), ("mixing", ("mixing",), ())])
    assert {(r.record_id, r.field_key): r.value for r in out.collect()} == {("a", "piano"): False, ("a", "mixing"): True, ("b", "piano"): True, ("b", "mixing"): None, ("c", "piano"): None, ("c", "mixing"): None}


def test_runtime(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
    assert cut(spark.range(3)).count() == 3
    assert "broadcast" in small_side(spark.range(3), 5)._jdf.queryExecution().toString().lower() and small_side(spark.range(9), 5).count() == 9


def test_streams(spark, tmp_path):
    rows = [("u", 1, "new"), ("u", 3, "open"), ("u", 2, "late"), ("v", 1, "new"), ("u", 3, "again")]
    folder = tmp_path / "in"
    spark.createDataFrame(rows, "k string, rev int, state string").coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema("k string, rev int, state string").parquet(str(folder))
    out = events.run_to_end(events.latest_state(stream, "k", "rev", "state"), "weftline_states", str(tmp_path / "cp"))
    got = sorted((r.k, r.rev) for r in out.collect())
    assert got == [("u", 1), ("u", 2), ("u", 3), ("v", 1)]
    times = [(datetime(2025, 1, 1, 0, 1), "a"), (datetime(2025, 1, 1, 0, 1), "a"), (datetime(2025, 1, 1, 5, 0), "b")]
    spark.createDataFrame(times, "t timestamp, c string").write.parquet(str(tmp_path / "ev"))
    ev = spark.readStream.schema("t timestamp, c string").parquet(str(tmp_path / "ev"))
    assert events.run_to_end(events.once(ev, "t", ["c"], "1 day"), "weftline_first", str(tmp_path / "cp2")).count() == 2


def test_candidates_from_observations(spark):
    from weftline.operators import candidates

    address = "struct<street_address:string,postal_code:string,locality:string,region:string,country_code:string,free_form:string>"
    none = (None,) * 6
    rows = [("r", "display_name", "observed", (" Alpha  Studio ", none)), ("r", "display_name", "observed", ("alpha studio", none)), ("r", "email", "observed", ("A@B.example", none)), ("r", "phone", "invalid", ("1", none)), ("r", "address", "observed", (None, ("X 1", "123", None, "", "DE", None))), ("q", "phone", "observed", ("n/a", none)), (None, "phone", "observed", ("1", none))]
    rows += [("bulk", "phone", "observed", (f"+49{k:06d}", none)) for k in range(70)]
    df = spark.createDataFrame(rows, f"source_record_id string, field_key string, state string, value struct<text:string,address:{address}>")
    made, large = candidates.build_candidates(df)
    got = {r.record_id: (r.names, r.emails, r.addresses, r.phones) for r in made.collect()}
    assert got == {"r": (["alpha studio"], ["a@b.example"], ["x 1, 123, de"], [])} and [(r.record_id, r.n) for r in large.collect()] == [("bulk", 70)]


def test_scores_and_routes(spark):
    df = spark.createDataFrame([("Boundary GeoJSON", "a"), (None, None)], "t string, k string")
    assert [r.s for r in df.select(tables.keyword_score(F.col("t"), {"boundary": 120, "geojson": 80, "archive": -40}).alias("s")).collect()] == [200, 0]
    rules = spark.createDataFrame([("a", "next"), (None, "none")], "k string, to string")
    assert sorted(r.to for r in tables.route(df.unionByName(spark.createDataFrame([("x", "zz")], df.schema)), rules, ["k"], {"to": "blocked"}).collect()) == ["blocked", "next", "none"]
