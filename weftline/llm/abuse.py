"""Problem 9: abusive, hateful or sexual content, by maximum-scoring segments over token log-odds.

Texts are folded (width, marks, look-alikes, letters spelt out with signs between them, digits in words) and read as
tokens. The model gives every run of one to three tokens the log-odds of standing in marked rather than in other texts,
with a hierarchical Dirichlet prior: a run is drawn towards its parts, a single token towards the base
rate or, if it is a word of the list below, towards marked. A first model is fitted on reviewed documents; it marks
sentences of the whole corpus, and the final model is fitted on those, so that phrases of unreviewed documents count
and the harmless sentences beside a marked one don't. Each document is then scanned in linear time for all maximal
segments of summed log-odds less a toll per token; its best segment is set against the extreme-value (Gumbel)
distribution that best segments of unmarked texts of its length follow.

The reviewed sample is bounded by ``SAMPLE`` documents per label (the first by hash of their id); all other counts
cover every document.

Defined results: null and empty texts score 0 and aren't found; of a document's reviews the latest counts, of those of
one time the greater label; reviews of unknown documents don't count; without any review only the word list and the base rate
speak; repeated documents are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.encode import read_splits
from weftline.llm.names import fold, skeleton
from weftline.runtime import cut, small_side

#: Most reviewed documents of each label the first model is fitted on.
SAMPLE = 20_000
#: Weight of the prior in documents.
PRIOR = 2.0
#: What a token must give in log-odds before it adds to a segment: first and final model.
TOLL_FIRST, TOLL = 1.5, 3.0
#: Segment score from which the first model marks a sentence.
MARK = 8.0
#: Score from which an unreviewed sentence with a listed word is left out of both counts.
DOUBT = 3.0
#: Weight of sentences of reviewed documents against others.
REVIEWED = 3.0
#: Weight of marked (or, if none is, of other) sentences a run must reach to be part of the final model, whatever the size of the corpus.
SUPPORT = 2.0
#: Runs up to which the final model is broadcast; a larger one is joined to the runs of the documents.
HELD = 1_000_000
#: Tokens of the documents that are scored together with a joined model.
BATCH = 400_000
#: Least score of a found document, and its chance among unmarked texts of its length.
LEAST, CHANCE = 7.0, 0.001
_HEAVY = 0.995

# Words of insult, threat, contempt or explicit sex, in four languages.
WORDS = (
    "idiot trottel schlampe hurensohn wichser arschloch penner versager kotzbrocken missgeburt abschaum luegenpack drecksack drecksau dreckschwein flachpfeife hohlkopf vollidiot mistkerl hure fotze nutte schwuchtel dummkopf gesindel "
    "ungeziefer viehzeug schmarotzer fresse verpiss ficken voegeln bumsen notgeil titten moepse muschi schwanz arsch nacktbilder pornos verrecke "
    "moron imbecile cretin dickhead bastard asshole wanker scumbag loser halfwit twat cunt bitch slut whore prick vermin filthy shit fuck fucking screw boobs tits cock dick pussy naked porn horny moaning nudes "
    "abruti cretin connard connasse salope pute encule batard debile vermine baiser sucer merde crever gueule nichons "
    "gilipollas cabron imbecil puta puto mierda inutil basura payaso escoria maricon zorra follar joder tetas polla peste"
).split()
_LISTED = {s for s in (skeleton(fold(w)) for w in WORDS) if len(s) >= 5}
_SPELT = re.compile(r"(?<![^\W_])(?:[^\W_][\-.*_·|]){2,}[^\W_](?![^\W_])")
_APART = re.compile(r"(?<![^\W_])(?:[^\W_] ){3,}[^\W_](?![^\W_])")
_TOKEN = re.compile(r"[^\s,;:!?()\[\]\"„“”«»<>|.…]+|[.!?:]|[„“”«»\"]|\n")
_NUMBER = re.compile(r"[\d.,\-/%+]+")


def tokens(text: str) -> list[str]:
    """The folded tokens of a text; ``.`` ends a sentence or line, ``0`` is a number, ``*`` a token without letters."""
    text = fold(text)
    text = _SPELT.sub(lambda m: re.sub(r"[^\w]|_", "", m[0]), text)
    text = _APART.sub(lambda m: m[0].replace(" ", ""), text)
    return [_token(w) for w in _TOKEN.findall(text)]


@lru_cache(maxsize=200_000)
def _token(w: str) -> str:
    if w in ".!?\n":
        return "."
    if w == ":":
        return ":"
    if w in "„“”«»\"":
        return '"'
    return "0" if _NUMBER.fullmatch(w) else skeleton(w.replace("-", "")) or "*"


def sentences(words: list[str]) -> list[list[str]]:
    """The tokens cut after every end of a sentence."""
    out: list[list[str]] = []
    at = 0
    for k, w in enumerate(words):
        if w == ".":
            out.append(words[at : k + 1])
            at = k + 1
    if at < len(words):
        out.append(words[at:])
    return out


def runs(words: list[str]) -> set[str]:
    """The distinct runs of one to three tokens that end within the words; before them stand two sentence ends."""
    w = [".", ".", *words]
    return {x for i in range(2, len(w)) for x in (w[i], f"{w[i - 1]} {w[i]}", f"{w[i - 2]} {w[i - 1]} {w[i]}")}


class Odds:
    """Log-odds of runs, from their counts in marked and other texts and the sizes of both.

    A run is drawn towards the more telling of its two parts, or with ``even`` towards log-odds to which the other part adds a
    quarter, so that one telling word among names counts less; the first suits few texts, the second many.
    """

    def __init__(self, counts: dict[str, tuple[float, float]], marked: float, other: float, even: bool = False) -> None:
        self.counts = counts
        self.even = even
        self.base = (marked + 0.5) / (marked + other + 1.0)
        self.shift = math.log(self.base / (1 - self.base))
        self.known: dict[str, float] = {}
        self.odds: dict[str, float] = {}

    def chance(self, run: str) -> float:
        """Probability that a text with the run is marked."""
        p = self.known.get(run)
        if p is None:
            cut_ = run.find(" ")
            if cut_ < 0:
                prior = 0.85 if run in _LISTED else self.base
            else:
                a, b = self.chance(run[cut_ + 1 :]), self.chance(run[: run.rfind(" ")])
                hi, lo = max(a, b), min(a, b)
                prior = hi
                if self.even and lo < hi:
                    odds = (hi / (1 - hi)) ** 0.75 * (lo / (1 - lo)) ** 0.25
                    prior = odds / (1 + odds)
            k, m = self.counts.get(run, (0.0, 0.0))
            p = min(1 - 1e-6, max(1e-6, (k + PRIOR * prior) / (k + m + PRIOR)))
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[run] = p
        return p

    def scores(self, words: list[str], toll: float) -> list[float]:
        """The score of every token: the log-odds of the run that ends with it, less the toll."""
        out, a, b = [], ".", "."
        for c in words:
            run = f"{a} {b} {c}"
            x = self.odds.get(run)
            if x is None:
                p = min(_HEAVY, max(1 - _HEAVY, self.chance(run)))
                if len(self.odds) > 500_000:
                    self.odds.clear()
                x = self.odds[run] = math.log(p / (1 - p)) - self.shift
            out.append(x - toll)
            a, b = b, c
        return out


def best_segment(scores: list[float]) -> float:
    """The greatest sum of neighbouring scores, 0 if none is positive."""
    best = run = 0.0
    for s in scores:
        run = max(0.0, run + s)
        best = max(best, run)
    return best


def all_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time: none can be made better by growing or shrinking.

    Every segment keeps where the last one stands that begins lower, so no segment is looked at twice on the way back.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, last that begins lower
    total = 0.0
    for k, s in enumerate(scores):
        low, total = total, total + s
        if s <= 0:
            continue
        start, j = k, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((start, k + 1, low, total, j))
                break
            start, _, low, _, back = stack[j]
            del stack[j:]
            j = back
    return [(a, b, d - c) for a, b, c, d, _ in stack]


def reviewed(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``y`` of every reviewed document: the latest label, of those of one time the greater."""
    rows = labels.filter("doc_id is not null and label is not null")
    return rows.groupBy("doc_id").agg(F.max_by("label", F.struct(F.col("labelled_at_utc"), F.col("label"))).cast("int").alias("y"))


def read_sentences(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``y`` (null if not reviewed) and ``sents``, the folded sentences of every text."""
    docs = read_splits(documents.select("doc_id", "source", "text").filter("text is not null and text <> ''"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            sents = [[" ".join(s) for s in sentences(tokens(t))] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "sents": sents})

    read = docs.mapInPandas(run, "doc_id long, source string, sents array<string>")
    return read.join(small_side(reviewed(labels)), "doc_id", "left")


def _counted(rows: DataFrame, count) -> DataFrame:
    """Sums of (``run``, ``pos``, ``neg``) that ``count(pdf, marked, other)`` adds up; tasks add up before anything is shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos: Counter = Counter()
        neg: Counter = Counter()

        def flush() -> pd.DataFrame:
            keys = list(pos.keys() | neg.keys())
            out = pd.DataFrame({"run": keys, "pos": [float(pos[k]) for k in keys], "neg": [float(neg[k]) for k in keys]})
            pos.clear()
            neg.clear()
            return out

        for pdf in frames:
            count(pdf, pos, neg)
            if len(pos) + len(neg) > 400_000:
                yield flush()
        if pos or neg:
            yield flush()

    return rows.mapInPandas(run, "run string, pos double, neg double").groupBy("run").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _as_counts(df: DataFrame) -> dict[str, tuple[float, float]]:
    pdf = df.toPandas()
    return dict(zip(pdf["run"], zip(pdf["pos"], pdf["neg"], strict=True), strict=True))


def first_model(read: DataFrame) -> tuple[dict[str, tuple[float, float]], float, float]:
    """Counts of runs in marked and other reviewed documents of the bounded sample, and its sizes.

    A run of one marked or fewer than two other documents moves nothing and is left to its prior.
    """
    known = read.filter("y is not null").select("doc_id", "y", "sents")
    sizes = {r["y"] > 0: r["n"] for r in known.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = [min(1.0, SAMPLE / max(1, sizes.get(k, 0))) for k in (False, True)]
    luck = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = known.filter(luck < F.when(F.col("y") > 0, share[1]).otherwise(share[0]))

    def count(pdf: pd.DataFrame, pos: Counter, neg: Counter) -> None:
        for y, sents in zip(pdf["y"], pdf["sents"], strict=True):
            (pos if y > 0 else neg).update(runs(" ".join(sents).split()))

    counts = _as_counts(_counted(sample, count).filter("pos + neg >= 2 and (pos >= 1 or neg >= 2)"))
    return counts, share[1] * sizes.get(True, 0), share[0] * sizes.get(False, 0)


def mark_sentences(read: DataFrame, first: tuple) -> DataFrame:
    """``read`` with the weights ``pos`` and ``neg`` of every sentence as a marked and as another one.

    A sentence is marked by its best segment; none of a document reviewed as clean is, and what a marked
    document holds beside its marked sentences counts little either way. A sentence with a listed word that falls
    just short of the mark counts as neither.
    """
    sent = read.sparkSession.sparkContext.broadcast(first)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odds = _odds(sent)
        for pdf in frames:
            if not len(pdf):
                continue
            pos, neg = [], []
            for y, sents in zip(pdf["y"], pdf["sents"], strict=True):
                known, bad = y is not None and y == y, y is not None and y == y and y > 0
                scores = [0.0 if known and not bad else best_segment(odds.scores(s.split(), TOLL_FIRST)) for s in sents]
                pos.append([(REVIEWED if bad else 1.0) if x >= MARK else 0.0 for x in scores])
                neg.append([0.0 if x >= MARK or not known and x >= DOUBT and not _LISTED.isdisjoint(s.split()) else 0.3 if bad else REVIEWED if known else 1.0 for x, s in zip(scores, sents, strict=True)])
            yield pdf.assign(pos=pos, neg=neg)

    return read.select("doc_id", "source", "y", "sents").mapInPandas(run, "doc_id long, source string, y int, sents array<string>, pos array<double>, neg array<double>")


def final_model(marked: DataFrame) -> tuple[dict[str, tuple[float, float]] | DataFrame, float, float]:
    """Counts of runs in marked and other sentences of all documents.

    Runs are counted among marked sentences first, then those runs among the others, and last, of what only others hold,
    longer runs with a part that leans to marked: nothing else can ever score. Counts of more than ``HELD`` runs stay a
    table (``run``, ``pos``, ``neg``) of the same content.
    """
    spark = marked.sparkSession

    def weights(pdf: pd.DataFrame, name: str):
        for sents, held in zip(pdf["sents"], pdf[name], strict=True):
            for s, w in zip(sents, held, strict=True):
                if w:
                    yield s.split(), w

    def own(pdf: pd.DataFrame, pos: Counter, neg: Counter) -> None:
        for words, w in weights(pdf, "pos"):
            for x in runs(words):
                pos[x] += w

    total = marked.select(*[F.coalesce(F.sum(F.aggregate(c, F.lit(0.0), lambda s, x: s + x)), F.lit(0.0)).alias(c) for c in ("pos", "neg")]).first()
    sizes = (total["pos"], total["neg"])
    base = (sizes[0] + 0.5) / (sum(sizes) + 1.0)
    own_counts = cut(_counted(marked, own).filter(F.col("pos") >= SUPPORT))
    if own_counts.count() > HELD:
        return _joined_model(marked, own_counts, base, weights), *sizes
    counts = {x: k for x, (k, _) in _as_counts(own_counts).items()}
    seen = spark.sparkContext.broadcast(set(counts))

    def against(pdf: pd.DataFrame, pos: Counter, neg: Counter) -> None:
        held = seen.value  # whatever is held, its parts are held too, but for the mark of the beginning
        for words, w in weights(pdf, "neg"):
            met, last = set(), ". ."
            for a, b, c in zip([".", ".", *words], [".", *words], words):
                pair = f"{b} {c}" if c in held and b in held else ""
                pair = pair if pair in held else ""
                if c in held:
                    met.add(c)
                if pair:
                    met.add(pair)
                    if last and (triple := f"{a} {pair}") in held:
                        met.add(triple)
                last = pair
            for x in met:
                neg[x] += w

    others = {x: n for x, (_, n) in _as_counts(_counted(marked, against)).items()}
    both = {x: (k, others.get(x, 0.0)) for x, k in counts.items()}
    leans = spark.sparkContext.broadcast({x for x, (k, n) in both.items() if x.count(" ") < 2 and (k + PRIOR * base) / (k + n + PRIOR) > 3 * base})

    def beyond(pdf: pd.DataFrame, pos: Counter, neg: Counter) -> None:
        held, lean = seen.value, leans.value
        for words, w in weights(pdf, "neg"):
            met, last = set(), ". ." in lean
            for a, b, c in zip([".", ".", *words], [".", *words], words):
                pair = f"{b} {c}"
                if (b in lean or c in lean) and pair not in held:
                    met.add(pair)
                leans_now = pair in lean
                if (leans_now or last) and (triple := f"{a} {pair}") not in held:
                    met.add(triple)
                last = leans_now
            for x in met:
                neg[x] += w

    more = cut(_counted(marked, beyond).filter(F.col("neg") >= SUPPORT))
    if more.count() + len(both) > HELD:
        return _joined_model(marked, own_counts, base, weights), *sizes
    both |= {x: (0.0, n) for x, (_, n) in _as_counts(more).items()}
    return both, *sizes


def _joined_model(marked: DataFrame, own_counts: DataFrame, base: float, weights) -> DataFrame:
    """The counts of ``final_model`` by joins: nothing is sent to the driver or to every task."""

    def other(pdf: pd.DataFrame, pos: Counter, neg: Counter) -> None:
        for words, w in weights(pdf, "neg"):
            for x in runs(words):
                neg[x] += w

    others = cut(_counted(marked, other).select("run", "neg"))
    both = cut(own_counts.select("run", "pos").join(others, "run", "left").select("run", "pos", F.coalesce("neg", F.lit(0.0)).alias("neg")))
    lean = both.filter(f"size(split(run, ' ')) < 3 and (pos + {PRIOR * base}) / (pos + neg + {PRIOR}) > {3 * base}").select(F.col("run").alias("part"))
    # the parts of a run are the run without its first and without its last token
    longer = others.filter(F.col("neg") >= SUPPORT).filter("instr(run, ' ') > 0").join(both, "run", "left_anti")
    parts = longer.select("run", "neg", F.explode(F.array(F.regexp_replace("run", "^[^ ]+ ", ""), F.regexp_replace("run", " [^ ]+$", ""))).alias("part"))
    more = parts.join(lean, "part", "left_semi").select("run", F.lit(0.0).alias("pos"), "neg").distinct()
    return cut(both.unionByName(more))


def _with_joined(marked: DataFrame, model: DataFrame, sizes: tuple[float, float], score, schema: str) -> DataFrame:
    """``score(odds, pdf)`` of documents dealt into batches, each with the counts of the runs it holds."""
    words = F.aggregate("sents", F.lit(0).cast("long"), lambda n, x: n + F.size(F.split(x, " ")))
    total = marked.agg(F.coalesce(F.sum(words), F.lit(0)).alias("n")).first()["n"]
    # repeated ids are told apart by their text
    docs = cut(marked.select("doc_id", "source", "y", "sents", F.pmod(F.xxhash64("doc_id", "sents"), F.lit(total // BATCH + 1)).alias("batch")))

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for batch, group in pdf.groupby("batch"):
                yield pd.DataFrame({"batch": batch, "run": sorted({x for sents in group["sents"] for x in _with_parts(" ".join(sents).split())})})

    needed = docs.repartition("batch").mapInPandas(held, "batch long, run string").distinct()
    counts = needed.join(model, "run").select("batch", "run", "pos", "neg")

    def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        odds = Odds(dict(zip(known["run"], zip(known["pos"], known["neg"], strict=True), strict=True)), *sizes, True)
        return score(odds, pdf)

    return docs.groupBy("batch").cogroup(counts.groupBy("batch")).applyInPandas(run, schema)


def _with_parts(words: list[str]) -> set[str]:
    """The runs of a text and their parts, with those of the two sentence ends before it."""
    return runs(words) | {".", ". ."}


_MODELS: dict[int, Odds] = {}


def _odds(sent) -> Odds:
    """The model of a broadcast, built once per Python worker."""
    model = sent.value
    if id(model) not in _MODELS:
        _MODELS.clear()
        _MODELS[id(model)] = Odds(*model)
    return _MODELS[id(model)]


def gumbel(scored: DataFrame) -> tuple[float, float, float]:
    """Location a + b ln(length) and scale of the best segments of unmarked texts, by moments within classes of length."""
    clean = scored.filter((F.col("score") < LEAST) & (F.coalesce("y", F.lit(0)) == 0) & (F.col("length") > 0))
    classes = clean.groupBy(F.floor(F.log2("length")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.var_pop("score").alias("var"), F.avg(F.log("length")).alias("x")).collect()
    rows = [(r["n"], r["mean"], r["var"] or 0.0, r["x"]) for r in classes if r["n"]]
    if not rows:
        return 0.0, 0.0, 0.1
    n = np.array([r[0] for r in rows], float)
    var = float((n * [r[2] for r in rows]).sum() / n.sum())
    scale = max(math.sqrt(6 * var) / math.pi, 0.05)
    x, y = np.array([r[3] for r in rows]), np.array([r[1] for r in rows]) - 0.5772156649 * scale
    mx, my = (n * x).sum() / n.sum(), (n * y).sum() / n.sum()
    spread_x = (n * (x - mx) ** 2).sum()
    b = max(0.0, float((n * (x - mx) * (y - my)).sum() / spread_x)) if spread_x > 0 else 0.0
    return float(my - b * mx), b, scale


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``score`` (best segment), ``chance`` (of that score in an unmarked text), ``passages`` and ``found``."""
    spark = documents.sparkSession
    read = cut(read_sentences(documents, labels))
    marked = cut(mark_sentences(read, first_model(read)))
    model, *sizes = final_model(marked)
    schema = "doc_id long, source string, y int, score double, passages long, length long"

    def rate(odds: Odds, pdf: pd.DataFrame) -> pd.DataFrame:
        score, passages, length = [], [], []
        for sents in pdf["sents"]:
            words = " ".join(sents).split()
            got = [s for _, _, s in all_segments(odds.scores(words, TOLL))]
            score.append(max(got, default=0.0))
            passages.append(sum(s >= LEAST for s in got))
            length.append(len(words))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "y": pdf["y"], "score": score, "passages": passages, "length": length})

    if isinstance(model, DataFrame):
        scored = cut(_with_joined(marked, model, sizes, rate, schema))
    else:
        sent = spark.sparkContext.broadcast((model, *sizes, True))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            odds = _odds(sent)
            for pdf in frames:
                if len(pdf):
                    yield rate(odds, pdf)

        scored = cut(marked.select("doc_id", "source", "y", "sents").mapInPandas(run, schema))
    a, b, scale = gumbel(scored)
    z = (F.col("score") - F.lit(a) - F.lit(b) * F.log(F.greatest("length", F.lit(1)))) / F.lit(scale)
    chance = 1 - F.exp(-F.exp(-z))
    rest = documents.filter("text is null or text = ''").select("doc_id", "source", F.lit(0.0).alias("score"), F.lit(1.0).alias("chance"), F.lit(0).cast("long").alias("passages"))
    return scored.select("doc_id", "source", "score", chance.alias("chance"), "passages").unionByName(rest).withColumn("found", (F.col("score") >= LEAST) & (F.col("chance") <= CHANCE))


def _scored(spark, sf_dir: str) -> DataFrame:
    return score_documents(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "moderation_labels")))


def p9_found(spark, sf_dir: str) -> DataFrame:
    """``doc_id`` of every document with such content."""
    return _scored(spark, sf_dir).filter("found").select("doc_id")


def p9_scores(spark, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, sf_dir).select("doc_id", "source", F.round("score", 4).alias("score"), F.round("chance", 6).alias("chance"), "passages", "found")


def p9_rates(spark, sf_dir: str) -> DataFrame:
    """Documents, found documents and their rate of every source."""
    by = _scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if("found").alias("found"), F.avg("score").alias("mean_score"))
    return by.withColumn("rate", F.round(F.col("found") / F.col("docs"), 6)).withColumn("mean_score", F.round("mean_score", 4))
