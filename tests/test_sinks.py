import hashlib
import json

from pyspark.sql import functions as F

from weftline.functions import identity
from weftline.operators import geo
from weftline.sources import bundles, sinks


def test_objects_once(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("raw", bytearray(b"a")), ("raw", bytearray(b"a")), ("page", bytearray(b"a"))], "kind string, content binary")
    sinks.write_objects(df, path)
    sinks.write_objects(df.unionByName(spark.createDataFrame([("raw", bytearray(b"b"))], df.schema)), path)
    got = sorted((r.kind, r.digest) for r in spark.read.parquet(path).collect())
    d = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    assert got == sorted([("raw", d(b"a")), ("page", d(b"a")), ("raw", d(b"b"))]) and sinks.unreadable_objects(spark, path).count() == 0


def test_history_and_documents(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1)], "k string, rev int")
    path = str(tmp_path / "history")
    assert sinks.append_history(rows, path, ["k", "rev"]) == 2 and sinks.append_history(rows.withColumn("rev", F.col("rev") + (F.col("k") == "b").cast("int")), path, ["k", "rev"]) == 1
    doc = spark.createDataFrame([("é", 3)], "name string, n int").select(sinks.canonical_document(name=identity.json_text(F.col("name")), n=F.col("n").cast("string")).alias("document"))
    sinks.write_documents(doc, str(tmp_path / "docs"))
    value = json.loads(spark.read.text(str(tmp_path / "docs")).first()[0])
    seal = value.pop("contentDigest")
    assert seal == "sha256:" + hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_bundle(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("b: 1\na: [x, 2]\n")
    (tmp_path / "c.json").write_text('{"k":1}')
    (tmp_path / "bad.yaml").write_text("a: 1\na: 2\n")
    (tmp_path / "worse.json").write_text("{")
    docs = bundles.scan_bundle(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: (r.document, r.issue) for r in docs.collect()}
    assert got == {"a.yaml": ('{"a":["x",2],"b":1}', None), "c.json": ('{"k":1}', None), "bad.yaml": (None, "DOCUMENT_INVALID"), "worse.json": (None, "DOCUMENT_INVALID")}
    assert bundles.bundle_digest(docs).first().documents == 2


def test_rings_that_cross_themselves():
    bow = [[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0], [0.0, 0.0]]
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    assert geo.crosses_itself(bow) and not geo.crosses_itself(square)
