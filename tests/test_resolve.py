"""A batch of seven candidates with one separation, and small variants of it."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from weftline.functions import identity
from weftline.operators import quality, resolve
from weftline.operators.components import star_labels

SCHEMA = (
    "candidate_id string, entity_kind string, names array<string>, phones array<string>, emails array<string>, website_urls array<string>, addresses array<string>, observation_ids array<string>, "
    "source_artifact_ids array<string>, source_keys array<string>, geography struct<coverage:string>"
)


def cid(n):
    return f"00000000-0000-0000-0000-{n:012d}"


def row(n, name, phones=(), emails=(), urls=(), addresses=(), kind="place", coverage="inside"):
    return (cid(n), kind, [name], list(phones), list(emails), list(urls), list(addresses), [cid(1000 + n)], [cid(2000 + n)], [f"source_{n}"], (coverage,))


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def seven(spark):
    return batch(
        spark,
        [
            row(1, "alpha studio", ["+49301111111"], urls=["https://alpha.example/"]), row(2, "alpha rooms", ["+49301111111"], urls=["https://alpha.example/"]),
            row(3, "fuzzy sound lab", urls=["https://fuzzy-one.example/"]), row(4, "fuzzy sound labs", urls=["https://fuzzy-two.example/"]),
            row(5, "chain one", ["+49302222222"], urls=["https://chain.example/"]), row(6, "chain two", ["+49302222222"], ["team@chain.example"], ["https://chain.example/"]),
            row(7, "chain three", emails=["team@chain.example"], urls=["https://chain-three.example/"]),
        ],
    )


def decision(spark, *rows):
    return spark.createDataFrame([(cid(a), cid(b), action) for a, b, action in rows], "left_candidate_id string, right_candidate_id string, action string")


def test_whole_batch(spark, seven):
    snap = resolve.resolve(seven, decision(spark, (5, 7, "separate")))
    got = {(r.left_candidate_id[-1], r.right_candidate_id[-1]): (r.disposition, r.evidence_strength) for r in snap.pairs.collect()}
    assert got == {
        ("1", "2"): ("auto_match", 50000), ("3", "4"): ("review_required", 9375), ("5", "6"): ("auto_match", 51666), ("6", "7"): ("auto_match", 36363), ("5", "7"): ("manual_separate", 6363),
    }
    assert sorted(tuple(m[-1] for m in r.member_candidate_ids) for r in snap.clusters.collect()) == [("1", "2"), ("3",), ("4",), ("5", "6"), ("7",)]
    assert snap.blocked_edges.count() == 1
    assert {r["code"]: r["count"] for r in snap.diagnostics.collect()} == {"BLOCKED_MATCH_EDGE_COUNT": 1, "CANDIDATE_COUNT": 7, "CLUSTER_COUNT": 5, "PAIR_COUNT": 5, "PENDING_REVIEW_PAIR_COUNT": 1}
    members = snap.clusters.select("cluster_id", F.explode("member_candidate_ids").alias("candidate_id"))
    rule = spark.createDataFrame([("place", ["names", "website_urls"], ["website_urls"], 2, ["inside", "boundary"], True, True)], "entity_kind string, required_fields array<string>, single_value_fields array<string>, minimum_distinct_source_count int, allowed_geography array<string>, boundary_requires_review boolean, pending_review_blocks_export boolean")
    pending = snap.pairs.filter("disposition = 'review_required'").select("pair_id", F.explode(F.array("left_candidate_id", "right_candidate_id")).alias("candidate_id")).join(members, "candidate_id").select("cluster_id", "pair_id")
    blocked = snap.clusters.select("cluster_id", F.explode("blocked_match_edge_ids").alias("edge_id"))
    issues = quality.cluster_issues(quality.cluster_facts(members, seven), rule, pending, blocked)
    by = {r.cluster_id: sorted(i.code for i in r.issues) for r in issues.collect()}
    first = {r.cluster_id: r.member_candidate_ids[0][-1] for r in snap.clusters.collect()}
    assert {first[k]: v for k, v in by.items()} == {
        "1": [], "3": ["INSUFFICIENT_DISTINCT_SOURCES", "PENDING_RESOLUTION_REVIEW"], "4": ["INSUFFICIENT_DISTINCT_SOURCES", "PENDING_RESOLUTION_REVIEW"],
        "5": ["MATCH_EDGE_BLOCKED_BY_SEPARATION"], "7": ["INSUFFICIENT_DISTINCT_SOURCES", "MATCH_EDGE_BLOCKED_BY_SEPARATION"],
    }


def test_manual_match_and_kind(spark):
    rows = batch(spark, [row(1, "a b"), row(2, "zz yy"), row(3, "a b", kind="provider")])
    got = {(r.left_candidate_id[-1], r.right_candidate_id[-1]): r.disposition for r in resolve.resolve(rows, decision(spark, (1, 2, "match"), (1, 3, "match"))).pairs.collect()}
    assert got == {("1", "2"): "manual_match", ("1", "3"): "no_match"}


def test_limits(spark):
    rows = batch(spark, [row(n, "same name") for n in range(5)])
    with pytest.raises(ValueError, match="PAIR_LIMIT"):
        resolve.resolve(rows, t=resolve.Thresholds(pair_limit=2))
    with pytest.raises(ValueError, match="CANDIDATE_LIMIT"):
        resolve.resolve(rows, t=resolve.Thresholds(candidate_limit=4))


def test_lineage(spark):
    prior = spark.createDataFrame([("p1", ["a", "b", "c"], "d1"), ("p2", ["d"], "d2"), ("p3", ["e"], "d3"), ("p4", ["f", "g"], "d4")], "cluster_id string, member_candidate_ids array<string>, content_digest string")
    members = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("x", "2"), ("d", "3"), ("e", "3"), ("f", "4"), ("g", "4"), ("y", "5")], "candidate_id string, root string")
    assert {r.root: r.lineage_kind for r in resolve.lineage(members, prior).collect()} == {"1": "split", "2": "recombined", "3": "merge", "4": "unchanged", "5": "new"}


def test_identities(spark):
    names = ["a", 'q"\\uote', "ümläut\n\x1f", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", identity.uuid5(F.col("n")).alias("u"), identity.json_text(F.col("n")).alias("j")).collect()
    import json

    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) and r.j == json.dumps(r.n, ensure_ascii=False) for r in got)


def brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_star_labels(spark):
    rnd = random.Random(1)
    links = [(f"{rnd.randrange(60):03d}", f"{rnd.randrange(60):03d}") for _ in range(45)] + [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(40)] + [(None, "q"), ("s", "s")]
    got = {r.x: r.label for r in star_labels(spark.createDataFrame(links, "u string, v string")).collect()}
    assert got == brute(links)
    assert star_labels(spark.createDataFrame([], "u string, v string")).count() == 0


def test_greedy_order(spark):
    """Two separations; the manual edge is joined first although its strength counts last."""
    rows = batch(spark, [row(1, "one", ["1"]), row(2, "two", ["1", "2"]), row(3, "three", ["2", "3"]), row(4, "four", ["3"])])
    snap = resolve.resolve(rows, decision(spark, (1, 3, "separate"), (2, 4, "separate"), (1, 4, "match")))
    groups = sorted(tuple(m[-1] for m in r.member_candidate_ids) for r in snap.clusters.collect())
    assert groups[0][:2] == ("1", "4") and snap.blocked_edges.count() >= 1


def greedy(ids, edges, apart):
    """The ordered union as one loop over all edges."""
    group = {x: {x} for x in ids}
    blocked = []
    for rank, strength, pid, a, b in sorted(edges, key=lambda e: (e[0], -e[1], e[2])):
        if group[a] is group[b]:
            continue
        clash = [identity_of(x, y) for x, y in apart if (x in group[a] and y in group[b]) or (x in group[b] and y in group[a])]
        if clash:
            blocked.append((pid, min(clash)))
            continue
        both = group[a] | group[b]
        for x in both:
            group[x] = both
    return {x: min(g) for x, g in group.items()}, sorted(blocked)


def identity_of(a, b):
    import hashlib
    import json

    return "sha256:" + hashlib.sha256(json.dumps(sorted((a, b)), separators=(",", ":")).encode()).hexdigest()


def test_constrained_clusters_against_one_loop(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        ids = [cid(n) for n in range(40)]
        edges, apart = {}, set()
        for _ in range(45):
            a, b = sorted(rnd.sample(ids, 2))
            edges[a, b] = (rnd.randrange(2), rnd.randrange(5), identity_of(a, b), a, b)
        while len(apart) < 8:
            a, b = sorted(rnd.sample(ids, 2))
            if (a, b) not in edges:
                apart.add((a, b))
        rows = [(e[2], e[3], e[4], "auto_match" if e[0] else "manual_match", e[1]) for e in edges.values()]
        resolved = spark.createDataFrame(rows, "pair_id string, left_candidate_id string, right_candidate_id string, disposition string, evidence_strength int")
        told = spark.createDataFrame([(b, a, "separate") for a, b in apart], "left_candidate_id string, right_candidate_id string, action string")
        members, blocked = resolve.constrained_clusters(spark.createDataFrame([(x,) for x in ids], "candidate_id string"), resolved, told)
        want, stopped = greedy(ids, edges.values(), apart)
        got = {r.candidate_id: r.root for r in members.collect()}
        groups = lambda m: sorted(sorted(x for x in m if m[x] == r) for r in set(m.values()))
        assert groups(got) == groups(want)
        assert sorted((r.attempted_pair_id, r.separation_pair_id) for r in blocked.collect()) == stopped
