"""Components, survivors and mixtures against brute force."""

import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest

from weftline.llm import components, mixture, survivor


def brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def shapes(seed):
    rnd = random.Random(seed)
    ids = [f"{k:04d}" for k in range(400)]
    rnd.shuffle(ids)
    take = lambda n: [ids.pop() for _ in range(n)]
    p, c, s, t, k, g, lo = take(40), take(17), take(30), take(40), take(6), take(60), take(9)
    links = list(zip(p, p[1:])) + list(zip(c, c[1:] + c[:1])) + [(s[0], x) for x in s[1:]] + [(t[j], t[rnd.randrange(j)]) for j in range(1, 40)]
    links += [(x, y) for x in k for y in k] + [(rnd.choice(g), rnd.choice(g)) for _ in range(80)] + list(zip(lo, lo[1:])) + [(lo[-1], lo[3]), (lo[3], k[0])]
    links += [(None, "a"), ("b", None), ("z", "z")] + [(b, a) for a, b in links[:20]] + links[:5]
    rnd.shuffle(links)
    return links


@pytest.mark.parametrize(("seed", "shrink"), [(0, components.SHRINK), (1, 0.0), (2, 1.0)])
def test_groups_of_all_shapes(spark, monkeypatch, seed, shrink):
    monkeypatch.setattr(components, "SHRINK", shrink)
    links = shapes(seed)
    got = {r.record_id: r.group_id for r in components.connected_groups(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == brute(links)


def test_no_links(spark):
    assert components.connected_groups(spark.createDataFrame([("x", "x"), (None, "y")], "a string, b string")).count() == 0


def test_decided_links(spark):
    u = [f"0000000{k}-0000-0000-0000-000000000000" for k in range(5)]
    d = ["sha256:" + f"{k}" * 64 for k in range(1, 6)]
    at = lambda n: datetime(2025, 1, n)
    pairs = [(d[0], u[0], u[1], "no_match", at(1)), (d[0], u[1].upper(), "{" + u[0] + "}", "auto_match", at(2)), (d[1], u[1], u[2], "manual_match", at(3)), (d[1], u[2], u[1], "no_match", at(4)), (d[2], u[3], u[4], "auto_match", at(1)), (d[3], u[3], u[3], "auto_match", at(1)), (None, None, None, None, None)]
    pf = spark.createDataFrame(pairs, "pair_id string, left_candidate_id string, right_candidate_id string, disposition string, recorded_at_utc timestamp")
    bf = spark.createDataFrame([(d[2].upper(), d[4])], "attempted_pair_id string, separation_pair_id string")
    got = {r.record_id: r.group_id for r in components.connected_groups(components.decided_links(pf, bf)).collect()}
    assert got == {u[0]: u[0], u[1]: u[0], d[2]: d[2], d[4]: d[2]}


def test_consensus_and_alignment():
    votes = [["alpha", "studio", "gmbh"], ["alpha", "studio"], ["alpha", "sound", "studio"]]
    assert survivor.consensus(votes, [1.0, 1.0, 1.0]) == ["alpha", "studio"]
    assert survivor.consensus(votes, [1.0, 0.5, 0.25]) == votes[0]
    assert survivor.closest(votes, ["alpha", "studio"]) == 1
    assert survivor.consensus([["x"]], [1.0]) == ["x"] and survivor.consensus([[], []], [1.0, 1.0]) == []


@pytest.mark.parametrize("shard", [4, survivor.SHARD])
def test_priority_is_the_best_of_any_group_size(spark, monkeypatch, shard):
    monkeypatch.setattr(survivor, "SHARD", shard)
    rnd = random.Random(shard)
    rows = [(f"g{rnd.randrange(4)}", "names", f"m{k:03d}", [rnd.choice("abcd"), rnd.choice("xyz")], rnd.randrange(3), None if rnd.random() < 0.3 else datetime(2025, 1, 1 + rnd.randrange(3))) for k in range(90)]
    df = spark.createDataFrame(rows + rows[:9], "group_id string, field string, member_id string, tokens array<string>, trust int, seen timestamp")
    got = {r.group_id: r.member_id for r in survivor.best_values(df).collect()}
    low = datetime(1970, 1, 1)
    want = {}
    for g in {r[0] for r in rows}:
        want[g] = min((r for r in rows if r[0] == g), key=lambda r: (r[4], -((r[5] or low) - low).total_seconds(), r[2]))[2]
    assert got == want


def test_priority_against_many_that_agree(spark):
    rows = [(f"g{n}", "names", f"m{k:03d}", ["b"] if k == 0 else ["z"], k + 1, None, n) for n in (54, 55, 64, 300) for k in range(n)]
    df = spark.createDataFrame(rows, "group_id string, field string, member_id string, tokens array<string>, trust int, seen timestamp, group_size long")
    assert {r.group_id: r.member_id for r in survivor.best_values(df).collect()} == {f"g{n}": "m000" for n in (54, 55, 64, 300)}


def test_member_values_defined_cases(spark):
    c = lambda n: f"0000000{n}-0000-0000-0000-000000000000"
    cand = [
        (c(1), ["a"], None, ["n/a"], [], ["  "], ["Source A"], ["o1"]), (c(1), ["a"], None, ["n/a"], [], ["  "], ["Source A"], ["o1"]), (c(2), ["b"], ["1"], None, None, None, ["source-b"], ["o2", "o3"]),
        (c(3), ["c"], [], [], [], [], None, None),
    ]
    cf = spark.createDataFrame(cand, "candidate_id string, names array<string>, phones array<string>, emails array<string>, website_urls array<string>, addresses array<string>, source_keys array<string>, observation_ids array<string>")
    obs = [("o1", "observed", datetime(2025, 1, 5), datetime(2025, 1, 4)), ("o2", "observed", datetime(2025, 1, 1), datetime(2025, 1, 9)), ("o3", "invalid", datetime(2025, 1, 9), datetime(2025, 1, 8)), ("o4", None, None, None)]
    of = spark.createDataFrame([(a, b, r, (o,)) for a, b, r, o in obs], "observation_id string, state string, recorded_at_utc timestamp, evidence struct<observed_at_utc:timestamp>")
    bf = spark.createDataFrame([("source_a", 2), ("source_b", 1), (None, 3)], "source_key string, trust_rank int")
    clusters = spark.createDataFrame([("k1", [c(1), c(2), "gone"]), ("k1", [c(1), c(2), "gone"]), ("k2", [c(3)]), ("k3", None)], "cluster_id string, member_candidate_ids array<string>")
    rows = survivor.member_values(clusters, cf, of, bf).collect()
    assert {(r.member_id, r.field, r.trust, r.seen) for r in rows} == {(c(1), "names", 2, datetime(2025, 1, 4)), (c(2), "names", 1, None), (c(2), "phones", 1, None)}
    got = {(r.group_id, r.field): r.member_id for r in survivor.best_values(survivor.member_values(clusters, cf, of, bf)).collect()}
    assert got == {("k1", "names"): c(2), ("k1", "phones"): c(2)}


def test_allot():
    w, room = np.array([1.0, 1.0, 2.0, 0.0]), np.array([10.0, 100.0, 100.0, 50.0])
    assert mixture.allot(w, room, 80).tolist() == pytest.approx([10, 70 / 3, 140 / 3, 0])
    assert mixture.allot(w, room, 1000).tolist() == [10, 100, 100, 0] and mixture.allot(w * 0, room, 10).tolist() == [0, 0, 0, 0]


def test_pivot_keeps_sums_and_chances():
    rnd = np.random.default_rng(2)
    hits = np.zeros(7)
    p = np.array([0.3, 0.3, 0.3, 0.9, 0.05, 0.5, 0.65])
    for _ in range(4000):
        out = mixture.pivot_pass(p, rnd.random(7))
        open_ = (out > 1e-9) & (out < 1 - 1e-9)
        assert open_.sum() <= 1 and abs(out.sum() - p.sum()) < 1e-9
        hits += out
    assert np.abs(hits / 4000 - p).max() < 0.03


def test_mixture(spark):
    docs = [(k, "a" if k % 3 else "b", "word " * (1 + k % 5)) for k in range(300)] + [(900, "a", None), (901, "c", ""), (902, None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("m", "a", 3.0, 1, 0.5), ("m", "b", 1.0, 3, 0.5), ("m", "zz", 4.0, 2, 0.5), ("n", "b", 1.0, 2, 0.9), ("o", "a", 0.0, 1, 0.1), (None, "a", 1.0, 1, 1.0)], "mixture_key string, source string, target_weight double, max_repeats int, corpus_fraction double")
    rows, plan = mixture.mix(df, targets)
    got = rows.collect()
    assert {r.mixture_key for r in got} == {"m", "n"} and all(r.copies <= (1 if r.source == "a" else 3) for r in got) and max(Counter((r.mixture_key, r.doc_id) for r in got).values()) == 1
    tokens = Counter()
    for r in got:
        tokens[r.mixture_key, r.source] += r.n_tokens * r.copies
    for r in plan.collect():
        assert abs(tokens[r.mixture_key, r.source] - r.planned_tokens) <= 10
    report = {(r.mixture_key, r.source): r for r in mixture.shares(rows, plan).collect()}
    assert report["m", "zz"].actual_tokens == 0 and report["m", "zz"].capped and report["n", "b"].most_copies == 2 and report["o", "a"].docs == 0
    assert sorted(map(tuple, mixture.mix(df, targets)[0].collect())) == sorted(map(tuple, got))
    assert mixture.mix(df.filter("false"), targets)[0].count() == 0
