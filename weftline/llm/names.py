"""Problem 1: variant spellings of names typed by people.

A name is read into its words (in one form for letters of one sound, legal forms, titles and asides taken out) and an aspect, the
first name or trade if it is one of those listed with their nicknames and short forms; a word that is on no list is a word like any
other, so names are matched without lists too, only that their short forms are then unknown. A symmetric-delete index over
all distinct words finds those a few letters apart: two words within two edits share a string after at most two deletions
each. Readings that share their rarest words, or spellings of them, are compared word by word: the best assignment of the words
of one to those of the other, each weighing by its rarity, where an initial stands for a word and an abbreviation or nickname
for its name. Order doesn't matter. A reading follows the best one that fits and whose word is seen in far more records (see ``rarer``);
words of like support are established names of their own. An incomplete reading (initial, no trade, no first name)
joins a full one only if exactly one fits.

Everything runs on distinct words and readings, so copies and hot names don't multiply the comparisons; words many names
share meet in pairs of words only; only the final rows hold pairs.

Defined results: null, blank and stand-in names take no part; words of any length are compared (more than 64 letters through
pieces, of which two words within two edits share one); names in other scripts are compared by their words as written; a
record with several names may belong to each of their readings; repeated rows count once; a record is never paired
with itself; an empty table gives no pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.values import is_usable
from weftline.llm.components import chain_ends
from weftline.runtime import spread, written

#: Letters of the longest word that is indexed by deletions; longer ones are indexed by pieces, to the same effect.
LONGEST = 64
#: Share of the rarest word's weight from which a word of a name must be met by the other name.
HEAVY = 0.5
#: What an aside counts of a word's weight.
ASIDE = 0.25
#: Words of a name, the rarest, of which two names with several must share two.
KEYED = 4
#: Share of the weight of the lighter name that must be met, and of the other one if both are full.
MET, MET_FULL, MET_PART = 0.7, 0.75, 0.5

# First names with their short forms and nicknames.
NICKNAMES = {
    "antonia": ("toni", "tonia"), "benjamin": ("ben", "benni", "benny"), "christoph": ("chris", "stoffel"), "dorothea": ("doerte", "thea", "doro"), "eberhard": ("ebi", "hardy"),
    "elisabeth": ("lisbeth", "elsbeth", "sisi", "lisa", "elli"), "francisco": ("paco", "pancho"), "friedrich": ("fritz", "friedr"), "gabriele": ("gabi", "gaby"), "giuseppe": ("beppe", "pino"),
    "hildegard": ("hilde",), "ibrahim": ("ibo",), "johannes": ("hannes", "joh", "hans"), "katharina": ("kathi", "kaethe", "kath", "katja"), "leonhard": ("leo", "hardy"),
    "margarete": ("grete", "gretl", "margret", "gretel"), "maximilian": ("max", "maxi"), "nikolaus": ("niko", "klaus", "nick"), "oswald": ("ossi",), "penelope": ("penny",), "quirin": ("quiri",),
    "rebecca": ("becky", "becca"), "roswitha": ("rosi",), "siobhan": ("shiv",), "theodor": ("theo",), "ursula": ("uschi", "ulla"), "valentina": ("valli", "tina", "vali"),
    "wilhelm": ("willi", "wilh", "willy"), "yevgenia": ("zhenya", "jewgenia", "evgenia", "jenja"), "zbigniew": ("zbyszek",),
}
# Trades and how they are written (lower case, blanks and hyphens taken out).
TRADES = {
    "ton": ("tonstudio", "tonstd", "recordingstudio", "recstudio", "recordings", "recording", "aufnahmestudio", "aufnahmen", "tonmeister"), "master": ("mastering", "masteringhaus", "masteringsuite", "masteringstudio", "mstrg"),
    "mix": ("mischstudio", "mixing", "mixingroom", "mixroom", "mixstudio"), "probe": ("proberaume", "proberaum", "proberaumzentrum", "rehearsalrooms", "rehearsalroom", "rehearsal"),
    "pod": ("podcaststudio", "podcaststd", "podcastvoice", "podcastundvoice", "podcast"), "film": ("filmton", "filmtonpostpro", "postproduktion", "postproduction", "postpro"),
    "musik": ("musikproduktion", "musikprod", "musicproduction", "musikproduktionverlag", "musikprodverlag", "musikverlag"),
}
# Words that say nothing about who is meant.
LEGAL = (
    r"\bges\.?\s*(?:m\.?\s*b\.?\s*h\.?)", r"\bg\.?\s?m\.?\s?b\.?\s?h\b\.?", r"\bhaftungsbeschr[aä]nkt\b", r"\bu\.?\s?g\b\.?", r"\bg\.?\s?b\.?\s?r\b\.?", r"\be\.?\s?k\b\.?", r"\be\.?\s?v\b\.?", r"\ba\.\s?g\b\.?|\bag\b", r"\blimited\b|\bltd\b\.?",
    r"\bco\.?\s*kg\b|\bco\b\.?|\bkg\b|\bohg\b|\binc\b\.?", r"\bfa\.|\bfirma\b",
)
TITLES = r"\bdipl\.?\s*-?\s*ing\b\.?|\bdr\b\.?|\bprof\b\.?|\bherr\b|\bfrau\b|\bdj\b|\bmc\b|\bmr\b\.?|\bms\b\.?|\bmrs\b\.?|\bfreelancer\b|\bfreiberufler(?:in)?\b"
_QUOTED = re.compile(r"[„“\"»]([^„“”\"«»]{4,})[“”\"«]")
_BREAK = re.compile(r"[^\w.$@€]+|_")
_ASIDE = re.compile(r"[(\[][^)\]]*[)\]]")
_LINKS = r"\bund\b|\band\b|\bu\b\.?|&|\+"
_TITLE, _LEGAL, _LINK = re.compile(TITLES), re.compile("|".join(LEGAL)), re.compile(_LINKS)
# Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("авекмнорстухіјѕԁαοερνικτυıøłæ", "abekmhopctyxijsdaoepviktuiola") | {ord("ß"): "ss"}
_HIDDEN = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
_UMLAUT = re.compile("([aou])e")
_SLIPS = [(re.compile(a), b) for a, b in (
    ("rn", "m"), ("ph", "f"), ("th", "t"), ("sh", "s"), ("ck", "k"), ("[cq]", "k"), ("t?[sz]+(?<=z)|ts", "z"), ("ow(?![aeiou])", "au"), ("w", "v"), ("y", "i"), ("[ea]i", "ei"), (r"(.)\1+", r"\1"),
)]
_DIGITS = str.maketrans("01345789$@€", "oleastbgsae")


def fold(text: str) -> str:
    """Lower case, plain width, no marks, look-alikes in Latin, umlauts and their spelling with e as the bare vowel."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text).lower().translate(_LOOKALIKES))
    return _UMLAUT.sub(r"\1", text.lower())


@lru_cache(maxsize=100_000)
def skeleton(word: str) -> str:
    """A folded word with letters of one sound or one look as one and no doubled letters."""
    word = re.sub(r"[^a-z]", "", word.translate(_DIGITS))
    for old, new in _SLIPS:
        word = old.sub(new, word)
    return word


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbouring swaps; ``most`` + 1 if it is larger. Only the band that can matter is filled."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most or not most:
        return most + 1
    far = most + 1
    older: list[int] = []
    last = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        x, lo, hi = a[i - 1], max(1, i - most), min(m, i + most)
        row = [far] * (m + 1)
        row[0] = i if i <= most else far
        low = row[0]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row[j] = d
            low = min(low, d)
        if low > most:
            return far
        older, last = last, row
    return min(last[-1], far)


def allowed(n: int) -> int:
    """Edits allowed between words of this length."""
    return 0 if n < 5 else 2 if n >= 8 else 1


_FIRST = {skeleton(fold(w)): set() for k, v in NICKNAMES.items() for w in (k, *v)}
for _k, _v in NICKNAMES.items():
    for _w in (_k, *_v):
        _FIRST[skeleton(fold(_w))].add(_k)
_TRADE = {skeleton(w): k for k, v in TRADES.items() for w in v}
_FILLERS = {skeleton(w) for w in ("verlag", "zentrum", "haus", "suite", "voice", "studio", "room", "production", "produktion", "post")}
_PAIRS = [(re.compile(a), b) for a, b in (
    (r"\b(\w+)[\s\-]+(?:&|u\.?|und|and)\s+(postpro|voice|verlag)\b\.?", r"\1 \2"), (r"\bpodcast\s*&\s*voice\b", "podcast voice"),
    (r"\b(rec|recording|ton|podcast|misch|mix|mixing|film|probe|musik|music|post|mastering|rehearsal)\b\.?[\s\-]+(studio|std|ton|raume|raum|room|rooms|produktion|production|prod|suite|haus|zentrum|voice|postpro|verlag)\b\.?", r"\1\2"),
    (r"\b(filmton|musikprod(?:uktion)?)\b\.?[\s\-]+(postpro|verlag)\b", r"\1"), (r"\bpodcastvoice\b", "podcaststudio"),
)]


def deletions(word: str, most: int) -> set[str]:
    """The word and all strings left after at most ``most`` deletions."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:k] + w[k + 1 :] for w in last for k in range(len(w))}
        out |= last
    return out


def pieces(word: str, most: int) -> set[str]:
    """Keys of which two long words within ``most`` edits share one: with most + 1 pieces, one is left whole by the edits.

    Each word gives its own pieces, and what stands at their places, give or take ``most``, for all lengths it may be compared with.
    """
    out = set()
    for n in range(len(word) - most, len(word) + most + 1):
        for k in range(most + 1):
            lo, hi = n * k // (most + 1), n * (k + 1) // (most + 1)
            for shift in range(-most, most + 1):
                part = word[max(0, lo + shift) : hi + shift]
                if len(part) == hi - lo:
                    out.add(f"{n}|{k}|{part}")
    return out


def _letters(word: str) -> int:
    """The letters of a word as bits."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) - 97
    return bits


class _Near:
    """A few known words, found again within one edit, or two for long ones; two edits change two letters at most."""

    def __init__(self, words: list[str], least: int) -> None:
        self.least, self.longest = least, max(map(len, words)) + 2
        self.words = [(w, len(w), _letters(w)) for w in sorted(words) if len(w) >= least]

    def find(self, word: str) -> str | None:
        n = len(word)
        if not self.least <= n <= self.longest:
            return None
        most, bits = 2 if n >= 8 else 1, _letters(word)
        met = [w for w, m, b in self.words if -most <= n - m <= most and (bits & ~b).bit_count() <= most and (b & ~bits).bit_count() <= most]
        best = min(((edits(word, w, most), w) for w in met), default=(9, ""))
        return best[1] if best[0] <= most else None


_NEAR_TRADE, _NEAR_FIRST = _Near(list(_TRADE), 6), _Near(list(_FIRST), 5)


@lru_cache(maxsize=100_000)
def _trade_of(s: str) -> str | None:
    if s in _TRADE:
        return _TRADE[s]
    near = _NEAR_TRADE.find(s)
    return _TRADE[near] if near else None


@lru_cache(maxsize=100_000)
def _first_of(s: str) -> set[str] | None:
    if s in _FIRST:
        return _FIRST[s]
    near = _NEAR_FIRST.find(s)
    return _FIRST[near] if near else None


def read_name(name: str) -> tuple[str, list[str], list[str]] | None:
    """Kind (``p`` person, ``o`` organisation, ``?`` unknown), words and aspect; None if no word can be made out.

    The aspect holds the first names a person may have, or ``x.`` for an initial, or the trade; it may be empty. Words in
    brackets and after a legal form are asides and count only if there is nothing else.
    """
    text = fold(name)
    quoted = _QUOTED.search(text)
    text = _TITLE.sub(" ", text)
    bare = _LEGAL.sub(" \x00 ", text)
    lone, text = bare != text, bare
    for old, new in _PAIRS:
        text = old.sub(new, text)
    got = _read_words(_LINK.sub(" ", _after_form(_ASIDE.sub(" ", text)))) or _read_words(_LINK.sub(" ", text.replace("\x00", " ")))
    if not got:
        return None
    firsts, trade, initial, rest, count = got
    if quoted:
        inner = [s for s in (skeleton(x) for x in re.split(r"[^a-z0-9]+", quoted[1])) if s in rest]
        rest = inner + [s for s in rest if s not in inner]
    if firsts:
        return "p", rest, sorted(firsts)
    if trade and not (initial and not lone and count <= 3 and trade in ("ton", "mix", "master")):
        return "o", rest, [trade]
    if lone:
        return "o", rest, []
    if initial:
        return "p", rest, [initial + "."]
    return "?", rest, []


def _after_form(text: str) -> str:
    """The text without what follows its legal form, if anything stands before it."""
    head, _, tail = text.partition("\x00")
    return head if _read_words(head) else f"{head} {tail}".replace("\x00", " ")


def _read_words(text: str) -> tuple[set[str], str | None, str, list[str], int] | None:
    """First names, trade, initial, other words in order and the number of all words; None without other words."""
    words = [w for w in _BREAK.split(text) if w.strip(".")]
    firsts: set[str] = set()
    trade, initial, rest = None, "", []
    skip = False
    for k, w in enumerate(words):
        bare = w.strip(".")
        if skip:
            skip = False
            continue
        if k + 1 < len(words) and len(bare) > 1:
            both = _trade_of(skeleton((w + words[k + 1]).replace(".", "")))
            if both:
                trade, skip = trade or both, True
                continue
        if len(bare) == 1 and bare.isalpha():
            initial = initial or bare
            continue
        s = skeleton(bare.replace(".", ""))
        if not s and not bare.isascii() and any(c.isalpha() for c in bare):
            rest.append(bare.replace(".", ""))
        if not s or s in _FILLERS:
            continue
        t = _trade_of(s)
        if t:
            trade = trade or t
            continue
        f = _first_of(s)
        if f and not (firsts and len(f) > 1):
            firsts = f if not firsts or len(firsts) > 1 else firsts
            continue
        rest.append(s)
    least = lambda n: [s for s in rest if len(s) >= n or not s.isascii()]
    rest = list(dict.fromkeys(least(4) or least(3)))
    return (firsts, trade, initial, rest, len(words)) if rest else None


def likeness(a: str, b: str) -> float:
    """How well two tokens of a name stand for each other: 1 equal, 0 not at all."""
    if a == b:
        return 1.0
    if a.endswith(".") or b.endswith("."):
        short, long_ = (a, b) if a.endswith(".") and (not b.endswith(".") or len(a) <= len(b)) else (b, a)
        return 0.9 if long_.startswith(short[:-1]) else 0.0
    most = allowed(min(len(a), len(b)))
    d = edits(a, b, most)
    return 1.0 - d / max(len(a), len(b)) if d <= most else 0.0


def assign(gain: list[list[float]]) -> list[int]:
    """The column of each row, -1 for none, so that the sum of the gains is greatest (exact, by augmenting paths)."""
    n, m = len(gain), len(gain[0]) if gain else 0
    if not n or not m:
        return [-1] * n
    if n > m:
        turned = assign([list(x) for x in zip(*gain, strict=True)])
        out = [-1] * n
        for j, i in enumerate(turned):
            if i >= 0:
                out[i] = j
        return out
    far = float("inf")
    row_cost, col_cost, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        slack, back, done = [far] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[j]:
            done[j] = True
            r, step, nxt = owner[j], far, 0
            for k in range(1, m + 1):
                if done[k]:
                    continue
                c = -gain[r - 1][k - 1] - row_cost[r] - col_cost[k]
                if c < slack[k]:
                    slack[k], back[k] = c, j
                if slack[k] < step:
                    step, nxt = slack[k], k
            for k in range(m + 1):
                if done[k]:
                    row_cost[owner[k]] += step
                    col_cost[k] -= step
                else:
                    slack[k] -= step
            j = nxt
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    out = [-1] * n
    for k in range(1, m + 1):
        if owner[k] and gain[owner[k] - 1][k - 1] > 0:
            out[owner[k] - 1] = k - 1
    return out


def likeness_of(a: list[tuple[float, str]], aspect_a: list[str], b: list[tuple[float, str]], aspect_b: list[str]) -> tuple[float, float]:
    """The shares of weight two names meet of each other: of the lighter and of the heavier one; zeros where aspects contradict.

    Names are (weight, word) pairs. Of the heavier name only its rare words count (see ``HEAVY``). An initial beside a name
    without aspect must stand for one of its words.
    """
    if aspect_a and aspect_b and max(likeness(x, y) for x in aspect_a for y in aspect_b) < 0.9:
        return 0.0, 0.0
    if len(a) == len(b) == 1 and (not aspect_a) == (not aspect_b):
        like = likeness(a[0][1], b[0][1])
        return like, like
    for one, aspect, other, there in ((a, aspect_a, b, aspect_b), (b, aspect_b, a, aspect_a)):
        if not there and aspect and aspect[0].endswith(".") and len(other) > 1:
            mean = sum(w for w, _ in one) / len(one)
            if one is a:
                a = [*a, (mean, aspect[0])]
            else:
                b = [*b, (mean, aspect[0])]
    if sum(w for w, _ in a) > sum(w for w, _ in b):
        a, b = b, a
    like = [[likeness(x, y) for _, y in b] for _, x in a]
    at = assign([[x * min(wa, wb) for x, (wb, _) in zip(row, b, strict=True)] for row, (wa, _) in zip(like, a, strict=True)])
    met_a = sum(wa * like[i][j] for i, ((wa, _), j) in enumerate(zip(a, at, strict=True)) if j >= 0)
    least = HEAVY * max(w for w, _ in b)
    held = {j: like[i][j] for i, j in enumerate(at) if j >= 0}
    met_b = sum(w * held.get(j, 0.0) for j, (w, _) in enumerate(b) if w >= least)
    return met_a / sum(w for w, _ in a), met_b / sum(w for w, _ in b if w >= least)


READING = "kind string, words array<string>, aspect array<string>"


def read_names(rows: DataFrame, name: str = "name") -> DataFrame:
    """``rows`` with the reading (``kind``, ``words``, ``aspect``) of every usable name that has one."""
    keep = [c for c in rows.columns if c != name]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != name), READING])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple | None] = {}
        for pdf in frames:
            if len(known) > 200_000:
                known.clear()
            got = []
            for n in pdf[name]:
                if n not in known:
                    known[n] = read_name(n)
                got.append(known[n])
            ok = [g is not None for g in got]
            out = pdf.loc[ok, keep].reset_index(drop=True)
            got = [g for g in got if g is not None]
            if got:
                yield out.assign(kind=[g[0] for g in got], words=[sorted(g[1]) for g in got], aspect=[g[2] for g in got])

    return rows.filter(is_usable(F.col(name))).mapInPandas(run, schema)


def _cuts(word: Column) -> Column:
    """``deletions`` of a word of at most ``LONGEST`` letters, as hashes, in built-in expressions."""
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one, n = drop(word), F.length(word)
    made = F.when(n < 5, F.array(word)).when(n < 8, F.concat(F.array(word), one)).otherwise(F.concat(F.array(word), one, F.flatten(F.transform(one, drop))))
    return F.array_distinct(F.transform(made, lambda s: F.xxhash64(s)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(words: pd.Series) -> pd.Series:
    return pd.Series([sorted(pieces(w, 2)) for w in words])


def core_neighbours(words: DataFrame) -> DataFrame:
    """``core``, ``other`` and ``d`` for every two different words (``core``) within the allowed edits, both ways.

    Words travel as numbers and deletion strings as hashes; what meets is checked exactly by its text. The index is
    joined with itself by merging.
    """
    text = written(spread(words.select("core").distinct()).withColumn("id", F.xxhash64("core")))
    short, long_ = text.filter(F.length("core") <= LONGEST), text.filter(F.length("core") > LONGEST)
    index = short.select("id", F.explode(_cuts(F.col("core"))).alias("cut")).unionByName(long_.select("id", F.explode(F.transform(_pieces("core"), lambda x: F.xxhash64(x))).alias("cut")))
    met = index.join(index.select(F.col("id").alias("id2"), "cut").hint("merge"), "cut").filter("id < id2").select("id", "id2").distinct()
    pairs = met.join(text.hint("merge"), "id").join(text.select(F.col("core").alias("other"), F.col("id").alias("id2")).hint("merge"), "id2").select("core", "other")
    # two edits with swaps are up to four without, but then the letters are nearly the same
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    close = pairs.filter((F.levenshtein("core", "other", 2) >= 0) | (F.levenshtein(letters("core"), letters("other"), 2) >= 0))

    @F.pandas_udf(T.IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits(x, y, min(allowed(len(x)), allowed(len(y)))) for x, y in zip(a, b, strict=True)], dtype="int32")

    limit = lambda c: F.when(F.length(c) < 5, 0).when(F.length(c) >= 8, 2).otherwise(1)
    near = close.withColumn("d", distance("core", "other")).filter(F.col("d") <= F.least(limit("core"), limit("other")))
    return near.select(F.inline(F.array(F.struct("core", "other", "d"), F.struct(F.col("other").alias("core"), F.col("core").alias("other"), "d"))))


_SHARES = T.StructType([T.StructField("light", T.DoubleType()), T.StructField("heavy", T.DoubleType())])


@F.pandas_udf(_SHARES)
def fit(words_a: pd.Series, weights_a: pd.Series, aspect_a: pd.Series, words_b: pd.Series, weights_b: pd.Series, aspect_b: pd.Series) -> pd.DataFrame:
    """``likeness_of`` two readings."""
    rows = zip(words_a, weights_a, aspect_a, words_b, weights_b, aspect_b, strict=True)
    got = [likeness_of(list(zip(va, wa, strict=True)), list(aa), list(zip(vb, wb, strict=True)), list(ab)) for wa, va, aa, wb, vb, ab in rows]
    return pd.DataFrame(got, columns=["light", "heavy"], dtype="float64")


def is_full(kind: Column, aspect: Column) -> Column:
    """True for a reading with one first name or a trade."""
    return kind.isin("p", "o") & F.coalesce(F.size(aspect) == 1, F.lit(False)) & ~F.coalesce(F.get(aspect, F.lit(0)).endswith("."), F.lit(False))


def rarer(n: str, t_n: str) -> str:
    """SQL condition: ``n`` records are so few beside ``t_n`` that a spelling may be a slip of the other.

    At most half as many, give or take what counts of that size vary by; so small counts decide nothing against a slip
    and large ones of like size do, whatever the size of the data.
    """
    return f"({n} <= {t_n} / 2 + sqrt({t_n}))"


def weigh_readings(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct readings with the weights of their words, and every word with its spellings (``core``, ``other``, ``d``).

    A word weighs by its rarity, the logarithm of the readings there are to each that holds it or a spelling of it, so that
    a slip of a common word is as light as the word. Beside a first name or trade, a word that never stands alone and goes with
    different words (a town) is an aside and counts a quarter. ``words`` come heaviest first; ``n`` is the number of
    records of the heaviest, ``m`` of the reading, ``keys`` are the words it is found by.
    """
    tokens = written(held.select("id", "rid", F.explode("words").alias("core")).groupBy("core").agg(F.count_distinct("id").alias("n"), F.count_distinct("rid").alias("df")))
    near = core_neighbours(tokens).unionByName(tokens.select("core", F.col("core").alias("other"), F.lit(0).alias("d")))
    near = written(near)
    spelt = near.join(tokens.select(F.col("core").alias("other"), F.col("n").alias("on"), "df").hint("merge"), "other").groupBy("core")
    spelt = spelt.agg(F.max("df").alias("eff"), F.max_by("other", F.struct("on", "other")).alias("main"))
    one = written(held.groupBy("rid", "kind", "words", "aspect").agg(F.count_distinct("id").alias("m")))
    weight = F.log1p(F.lit(float(one.count())) / F.col("eff"))
    known = tokens.join(spelt.hint("merge"), "core").select("core", "n", "main", weight.alias("w"))
    each = one.select("rid", "kind", F.explode("words").alias("core")).join(known.hint("merge"), "core")
    by = written(each.groupBy("rid", "kind").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "core", "n", "main"))).alias("x")))

    place = by.select(F.size("x").alias("k"), F.get("x", F.lit(0))["main"].alias("first"), F.get("x", F.lit(1))["main"].alias("second"), F.posexplode("x").alias("p", "t"))
    use = place.groupBy(F.col("t.core").alias("other")).agg(F.count_if(F.col("k") == 1).alias("alone"), F.count_distinct(F.when(F.col("p") == 0, F.col("second")).otherwise(F.col("first"))).alias("beside"))
    aside = near.join(use.hint("merge"), "other").groupBy("core").agg(F.max("alone").alias("alone"), F.max("beside").alias("beside")).filter("alone = 0 and beside > 1").select("core", F.lit(ASIDE).alias("share"))
    flat = by.select("rid", "kind", F.inline("x")).join(aside.hint("merge"), "core", "left")
    share = F.when(F.col("kind") == "?", 1.0).otherwise(F.coalesce("share", F.lit(1.0)))
    by = flat.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct((F.col("w") * share).alias("w"), "core", "n"))).alias("x"))
    heavy = F.slice(F.filter("x", lambda t: t["w"] <= F.get("x", F.lit(0))["w"] * HEAVY), 1, KEYED)
    laid = one.select("rid", "kind", "aspect", "m").join(by.hint("merge"), "rid").select(
        "rid", "kind", "aspect", "m", F.get("x", F.lit(0))["n"].alias("n"), F.transform("x", lambda t: t["core"]).alias("words"), F.transform("x", lambda t: -t["w"]).alias("weights"), F.transform(heavy, lambda t: t["core"]).alias("keys")
    )
    full = is_full(F.col("kind"), F.col("aspect")) | ((F.col("kind") == "?") & (F.size("keys") > 1))
    return written(laid.withColumn("full", full)), near


def _keys(words: Column, k: Column, probing: bool) -> Column:
    """Keys of a reading from its heavy words (structs of place and word).

    Of two readings with several heavy words each two must meet; a reading with a single one meets all that hold it.
    """
    lone, any_ = F.transform(words, lambda x: F.xxhash64(F.lit(1), x["w"])), F.transform(words, lambda x: F.xxhash64(F.lit(2), x["w"]))
    first, second = (lone, any_) if probing else (any_, lone)
    two = F.flatten(F.transform(words, lambda x: F.transform(F.filter(words, lambda y: y["p"] > x["p"]), lambda y: F.xxhash64(F.lit(3), F.least(x["w"], y["w"]), F.greatest(x["w"], y["w"])))))
    # key 1: probing readings with one word and all targets; key 2: all probing ones and targets with one word
    return F.array_distinct(F.when(k == 1, F.concat(first, second)).otherwise(F.concat(second, two)))


def reading_pairs(readings: DataFrame, near: DataFrame) -> DataFrame:
    """``rid`` and ``t``: every reading with the full readings whose rare words are spellings of its own."""
    k = F.size("keys")
    probe = readings.select("rid", k.alias("k"), F.posexplode("keys").alias("p", "core")).join(near.hint("merge"), "core")
    spelt = probe.groupBy("rid", "k").agg(F.collect_list(F.struct("p", F.col("other").alias("w"))).alias("x"))
    probing = spelt.select("rid", F.explode(_keys(F.col("x"), F.col("k"), True)).alias("key"))
    own = F.transform("keys", lambda w, p: F.struct(p.alias("p"), w.alias("w")))
    target = readings.filter("full").select(F.col("rid").alias("t"), own.alias("x"), k.alias("k")).select("t", F.explode(_keys(F.col("x"), F.col("k"), False)).alias("key"))
    return probing.join(target.hint("merge"), "key").filter("rid <> t").select("rid", "t").distinct()


def name_entities(records: DataFrame) -> DataFrame:
    """``id`` and ``entity`` of every record (``id``, ``kind``, ``words``, ``aspect``) whose name says who is meant.

    An entity is known by its leading reading; an incomplete reading without exactly one fitting entity stands for itself
    under its own spelling.
    """
    rid = F.xxhash64("kind", "words", "aspect")
    held = written(records.select("id", "kind", "words", "aspect").distinct().withColumn("rid", rid))
    readings, near = weigh_readings(held)
    cols = ("kind", "words", "weights", "aspect", "n", "m", "full")
    side = lambda x, p: readings.select(F.col("rid").alias(x), *[F.col(c).alias(p + c) for c in cols])
    both = reading_pairs(readings, near).join(side("rid", "a_").hint("merge"), "rid").join(side("t", "t_").hint("merge"), "t")
    both = both.filter("a_kind = t_kind or a_kind = '?' or t_kind = '?'")
    both = both.withColumns({"a_core": F.get("a_words", F.lit(0)), "t_core": F.get("t_words", F.lit(0))})
    scored = both.withColumn("s", fit("a_words", "a_weights", "a_aspect", "t_words", "t_weights", "t_aspect"))
    same = F.array_contains("t_words", F.col("a_core")) | F.array_contains("a_words", F.col("t_core"))
    least = F.when(F.col("a_full"), MET_FULL).otherwise(MET_PART)
    fits = scored.filter((F.col("s.light") >= MET) & (F.col("s.heavy") >= least) & (same | F.expr(rarer("a_n", "t_n"))))
    fits = written(fits.select("rid", "t", "a_full", "a_kind", "t_kind", "a_n", "a_m", "t_n", "t_m", "a_core", "t_core", same.alias("same"), (F.col("s.light") + F.col("s.heavy")).alias("score")))

    # a rarer full reading follows the closest reading of its kind
    ahead = fits.filter("a_full and a_kind = t_kind and (t_n > a_n or t_n = a_n and (t_core < a_core or t_core = a_core and (t_m > a_m or t_m = a_m and t > rid)))")
    follow = ahead.groupBy("rid").agg(F.min_by("t", F.struct(-F.col("score"), -F.col("t_n"), "t_core", -F.col("t_m"), "t")).alias("t"))
    full = readings.filter("full").select("rid")
    leader = chain_ends(full.join(follow.hint("merge"), "rid", "left").select("rid", F.coalesce("t", "rid").alias("t")), "rid", "t").withColumnRenamed("t", "entity")

    # an incomplete reading joins the one entity that holds its own word, or else its nearest spellings
    part = fits.filter("not a_full and (a_kind = t_kind or a_kind = '?' or t_kind = '?')").join(leader.select(F.col("rid").alias("t"), "entity").hint("merge"), "t")
    best = part.groupBy("rid", "same").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi")).groupBy("rid").agg(F.max_by(F.struct("lo", "hi"), F.col("same").cast("int")).alias("e"))
    best = written(best)
    joined = best.filter("e.lo = e.hi").select("rid", F.col("e.lo").alias("entity"))
    alone = readings.filter("not full").select("rid").join(best.hint("merge"), "rid", "left_anti").select("rid", F.col("rid").alias("entity"))
    where = leader.unionByName(joined).unionByName(alone)
    return held.select("id", "rid").join(where.hint("merge"), "rid").select("id", "entity").distinct()


def named_records(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """``id``, ``seed`` and ``name`` of every usable name of both tables."""
    a = seeds.select(F.col("seed_id").alias("id"), F.lit(True).alias("seed"), F.col("display_name").alias("name"))
    b = candidates.select(F.col("candidate_id").alias("id"), F.lit(False).alias("seed"), F.explode("names").alias("name"))
    return a.unionByName(b).filter(F.col("id").isNotNull() & is_usable(F.col("name")))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """``record_a`` < ``record_b`` of every seed and other record named as one person or organisation."""
    seeds, candidates = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("manual_seeds", "candidates"))
    records = written(read_names(spread(named_records(seeds, candidates))))
    entity = name_entities(records)
    at = written(entity.join(records.select("id", "seed").distinct(), "id"))
    mine = at.filter("seed").select("entity", F.col("id").alias("x"))
    other = at.select("entity", F.col("id").alias("y"))
    return mine.join(other, "entity").filter("x <> y").select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b")).distinct()
