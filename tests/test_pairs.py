"""Pairs, features and snapshots of batches above the limits of a single batch."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from test_resolve import batch, cid, decision, row
from weftline.operators import candidates, resolve
from weftline.plans import resolution


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """1,500 parts of one kind whose names share a word: 1,124,250 pairs."""
    path = str(tmp_path_factory.mktemp("parts"))
    name = F.concat_ws(" ", F.lit("brass"), F.element_at(F.array(*map(F.lit, ("bolt", "ring", "gear"))), (F.col("id") % 3 + 1).cast("int")))
    spark.range(1500).select(F.col("id").alias("p_partkey"), name.alias("p_name"), F.lit("SMALL").alias("p_type"), F.lit("Brand#1").alias("p_brand")).write.parquet(f"{path}/part.parquet")
    return path


PAIRS = 1500 * 1499 // 2


def test_block_pairs_beyond_a_million(spark, crowd):
    got = resolution.er_block_pairs(spark, crowd)
    assert got.agg(F.count(F.lit(1)), F.count_distinct("left_candidate_id", "right_candidate_id"), F.sum((F.col("left_candidate_id") < F.col("right_candidate_id")).cast("int"))).first() == (PAIRS, PAIRS, PAIRS)


@pytest.mark.parametrize("block", [3, resolve.BLOCK])
def test_pairs_against_all_pairs(spark, monkeypatch, block):
    """Every pair once, however many keys it shares; decided pairs too, with and without a common key."""
    monkeypatch.setattr(resolve, "BLOCK", block)
    rnd = random.Random(block)
    words = ["alpha", "alphorn", "studio", "sound", "ab"]
    rows = [row(n, " ".join(rnd.sample(words, 2)), rnd.sample(["1", "2", "3"], 1), urls=["https://a.example/"] if n % 5 == 0 else [], kind=rnd.choice(["place", "provider"])) for n in range(30)]
    rows += rows[:4]
    df = batch(spark, rows)
    keys = {}
    for r in resolve.block_keys(df).collect():
        keys.setdefault(r.candidate_id, set()).add(r.key)
    told = [(1, 2), (9, 4), (4, 9), (3, 99), (7, 7)]
    want = {(a, b) for a, b in itertools.combinations(sorted(keys), 2) if keys[a] & keys[b]}
    got = [tuple(r) for r in resolve.candidate_pairs(df, pair_limit=None).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [tuple(r) for r in resolve.candidate_pairs(df, decision(spark, *[(a, b, "match") for a, b in told]), None).collect()]
    assert len(got) == len(set(got)) and set(got) == want | {tuple(sorted((cid(a), cid(b)))) for a, b in told}


def test_dispositions_beyond_a_million(spark, crowd):
    got = resolution.er_dispositions(spark, crowd).agg(F.count(F.lit(1)), F.count_if(F.col("disposition") == "review_required"), F.min("name_similarity_bps"), F.max("evidence_strength")).first()
    assert got == (PAIRS, PAIRS, 6000, 10000)


def test_features_beyond_a_million(spark, crowd):
    got = resolution.er_pair_features(spark, crowd).agg(F.count(F.lit(1)), F.count_if("name_only"), F.min("name_similarity_bps"), F.max("source_overlap_count")).first()
    assert got == (PAIRS, PAIRS, 6000, 1)


def test_block_features_are_those_of_the_pairs(spark):
    """Several values, none and null ones on either side, decided pairs included."""
    rows = [row(1, "alpha studio", ["1", "2"], addresses=["a street 1", "b street 2"]), row(2, "alpha rooms", ["2"], addresses=["b street 2"]), row(3, "alphorn", ["3"], coverage="outside"), row(4, "beta", ["1"], kind="provider")]
    rows += [(cid(5), "place", [None], None, ["x@y"], None, None, None, None, None, None), (cid(6), "place", ["beta", None], [], ["x@y"], [], [], [], [], ["source_1"], None)]
    df = batch(spark, rows)
    told = decision(spark, (1, 2, "match"), (6, 3, "separate"))
    want = resolve.pair_features(resolve.candidate_pairs(df, told), df)
    got = resolve.block_features(df, told)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 6
    assert got.filter(F.col("pair_id") != resolve.identity.pair_id(F.col("left_candidate_id"), F.col("right_candidate_id"))).isEmpty()


def test_snapshot_beyond_the_limits(spark, crowd):
    assert resolution.snapshot_violations(spark, crowd).count() == 0


def test_snapshot_without_limits(spark):
    rows = batch(spark, [row(1, "one", ["1"]), row(2, "two", ["1", "2"]), row(3, "three", ["2", "3"]), row(4, "four", ["3"])])
    told = decision(spark, (1, 3, "separate"), (2, 4, "separate"), (1, 4, "match"))
    kept, free = (resolve.resolve(rows, told, t=t) for t in (resolve.Thresholds(), resolve.Thresholds(candidate_limit=None, pair_limit=None)))
    for part in ("pairs", "blocked_edges", "clusters", "diagnostics"):
        assert sorted(map(str, getattr(free, part).collect())) == sorted(map(str, getattr(kept, part).collect())), part


def copied(spark):
    """Copies whose ids lie between those of others, ids that JSON escapes, and a candidate of two different rows."""
    rows = [row(n, ("alpha studio", "alphorn sound", "alpha studio", "beta")[n % 4], ["1"] if n % 4 == 3 else []) for n in range(23)]
    rows = [(('q"' if n % 5 == 0 else "\n" if n % 7 == 0 else "") + r[0], *r[1:9], ["source"], ("inside" if n % 3 else "outside",)) for n, r in enumerate(rows)]
    return batch(spark, [*rows, rows[3], (rows[4][0], *row(4, "beta", ["1"])[1:9], ["source"], ("inside",))])


@pytest.mark.parametrize("copies", [1, 2, resolve.COPIES])
def test_dispositions_of_copies(spark, monkeypatch, copies):
    """Copies are compared once, by whatever number they are held in a row, and every pair comes out once."""
    monkeypatch.setattr(resolve, "COPIES", copies)
    df = copied(spark)
    keys = {}
    for r in resolve.block_keys(df).collect():
        keys.setdefault(r.candidate_id, set()).add(r.key)
    got = resolve.block_dispositions(df).collect()
    pairs = [(r.left_candidate_id, r.right_candidate_id) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a, b in itertools.combinations(sorted(keys), 2) if keys[a] & keys[b]}
    one = df.filter(~F.col("candidate_id").contains(cid(4)))  # features of several rows are those of any of them
    made = spark.createDataFrame([p for p in pairs if not any(cid(4) in e for e in p)], "left_candidate_id string, right_candidate_id string")
    want = resolve.dispositions(resolve.pair_features(made, one))
    assert sorted(map(str, resolve.block_dispositions(one).collect())) == sorted(map(str, want.collect()))


def test_copies_meet_once(spark, crowd):
    assert resolve._meetings(resolution._parts(spark, crowd), True).count() <= 9


def test_features_once_for_copies(spark, monkeypatch, crowd):
    """Three names make at most nine rows of features, whatever the number of their copies."""
    monkeypatch.setattr(resolve, "_expanded", lambda met: met)
    monkeypatch.setattr(resolve, "_identified", lambda rows: rows)
    assert resolve.block_features(resolution._parts(spark, crowd)).count() <= 9


def test_snapshot_compares_copies_once(spark, crowd):
    """What is asked of the dispositions of a snapshot is asked before its pairs are made."""
    snap = resolve.resolve(resolution._parts(spark, crowd), t=resolve.Thresholds(candidate_limit=None, pair_limit=None))
    plan = snap.pairs.filter("disposition = 'review_required'")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = max(n for n, line in enumerate(plan) if "Generate inline(left_ids" in line)
    assert any("review_required" in line for line in plan[made:]) and not any("Filter" in line and "review_required" in line for line in plan[:made])


def test_faults_of_a_snapshot(spark):
    df = copied(spark)
    snap = resolve.resolve(df, t=resolve.Thresholds(candidate_limit=None, pair_limit=None))
    found = lambda pairs: {(r.rule, r.n) for r in candidates.snapshot_violations(pairs, snap.clusters, df).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    pairs = snap.pairs.localCheckpoint()
    n = pairs.count()
    quoted = F.concat(F.lit('["'), "left_candidate_id", F.lit('","'), "right_candidate_id", F.lit('"]'))
    odd = pairs.filter(F.col("pair_id") != resolve.identity.digest(quoted)).count()
    assert not found(pairs) and 0 < odd < n
    assert found(pairs.withColumn("pair_id", resolve.identity.digest(quoted))) == {("pair_id", odd)}
    assert found(pairs.withColumn("evidence_strength", F.lit(-1)).withColumn("name_similarity_bps", F.lit(None).cast("int"))) == {("strength_range", n), ("similarity_range", n)}
    turned = pairs.select("*", F.col("right_candidate_id").alias("l"), F.col("left_candidate_id").alias("r")).drop("left_candidate_id", "right_candidate_id").withColumnsRenamed({"l": "left_candidate_id", "r": "right_candidate_id"})
    assert found(turned) == {("ends_in_order", n)}
