import random
from datetime import datetime

from weftline.llm import abuse


def best_of_all(scores):
    return max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])


def test_segments_against_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        s = [rnd.choice([-3, -2, -1, 1, 2, 3, 4]) for _ in range(rnd.randrange(14))]
        got = abuse.all_segments(s)
        assert max((x for _, _, x in got), default=0) == best_of_all(s) == abuse.best_segment(s)
        for a, b, x in got:
            assert sum(s[a:b]) == x > 0
            assert all(sum(s[a:k]) > 0 for k in range(a + 1, b + 1)) and all(sum(s[k:b]) > 0 for k in range(a, b))
        assert all(p[1] <= q[0] for p, q in zip(got, got[1:]))
    assert abuse.all_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1, 4), (2, 3, 3), (4, 11, 7)]


def test_tokens():
    same = [abuse.tokens(t) for t in ("Du Schlampe!", "du S-c-h-l-a-m-p-e!", "du Sch​lam​pe!", "DU SCHL@MP3!", "du Schlаmре!")]
    assert all(t == same[0] for t in same) and same[0][-1] == "."
    assert abuse.tokens("") == [] and abuse.tokens("12 x\n") == ["0", "x", "."]


GOOD = ["the booth is dry and tidy.", "we tracked four songs in two days.", "the engineer was late but kind.", "ask for the ribbon mic it is worth it.", "rates are forty per hour."]
BAD = ["keep those people away they are vermin.", "come outside and i will break your bones.", "shut up you worthless moron."]


def corpus(spark, n=240):
    rnd = random.Random(5)
    docs, labels = [], []
    for k in range(n):
        bad = k % 8 == 0
        text = " ".join(rnd.sample(GOOD, 3) + ([rnd.choice(BAD)] if bad else []))
        docs.append((k, text, "forum" if k % 2 else "review"))
        if k % 2 == 0:
            labels.append((k, 1 if bad else 0, datetime(2025, 1, 2)))
    docs += [(1000, None, "forum"), (1001, "", "forum"), (1002, "   ", None)]
    labels += [(0, 0, datetime(2025, 1, 1)), (5000, 1, datetime(2025, 1, 1)), (None, 1, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, label int, labelled_at_utc timestamp")


def test_finds_unreviewed_documents(spark):
    docs, labels = corpus(spark)
    rows = {r.doc_id: r for r in abuse.score_documents(docs, labels).collect()}
    assert {k for k, r in rows.items() if r.found} == {k for k in range(240) if k % 8 == 0}
    assert rows[1000].score == rows[1001].score == rows[1002].score == 0 and len(rows) == 243


def test_size_of_the_model_changes_no_score(spark, monkeypatch):
    docs, labels = corpus(spark)
    want = {r.doc_id: (round(r.score, 9), r.passages, r.found) for r in abuse.score_documents(docs, labels).collect()}
    monkeypatch.setattr(abuse, "HELD", 10)
    monkeypatch.setattr(abuse, "BATCH", 500)
    assert {r.doc_id: (round(r.score, 9), r.passages, r.found) for r in abuse.score_documents(docs, labels).collect()} == want


def test_rare_runs_count_in_any_corpus(spark):
    rows = [(k, "s", None, ["come outside."], [1000.0], [1.0]) for k in range(1000)] + [(2000 + k, "s", None, ["rare words."], [1.0], [1.0]) for k in range(3)]
    marked = spark.createDataFrame(rows, "doc_id long, source string, y int, sents array<string>, pos array<double>, neg array<double>")
    counts, *_ = abuse.final_model(marked)
    assert counts["rare words."] == (3.0, 3.0)


def test_without_reviews_or_documents(spark):
    docs, labels = corpus(spark, 16)
    assert abuse.score_documents(docs, labels.filter("false")).count() == 19
    assert abuse.score_documents(docs.filter("false"), labels).count() == 0


def test_latest_review_counts(spark):
    _, labels = corpus(spark, 16)
    assert {r.doc_id: r.y for r in abuse.reviewed(labels).collect()}[0] == 1
