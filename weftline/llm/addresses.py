"""Problem 3: the same postal address written differently, numbers first, in built-in expressions only.

An address is folded (case, width, umlauts), what doesn't belong to the building is taken out (addressee, floor, unit,
country), and what is left is read from the house number outwards: number with letter or range, street with its kind,
postcode, town. Blocks are made of the number tokens plus one rare word: the street word's head or tail within the town,
so one slip of the pen leaves one of the two intact. Within a block the shared tokens weigh by rarity and unmatched words
must be within a few letters of each other; kind and town must not differ. A town without a postcode is known
by the postcodes it is written with elsewhere. An address without town is accepted if just one town has that street and number.

Equal forms are merged before blocking and each form joins the best-supported form it matches, so copies and hot buildings
don't multiply the comparisons; only the final rows hold pairs.

Defined results: null, blank and stand-in addresses take no part; an address without house number or without street
matches nothing; a candidate with several addresses is at each of them; a candidate is never paired with itself;
repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import fold_german
from weftline.functions.values import is_usable
from weftline.llm.components import chain_ends
from weftline.runtime import cut

# Words of a street's kind with their abbreviations (folded spelling).
KINDS = {
    "strasse": ("strasse", "str", "st"), "weg": ("weg", "wg", "w"), "allee": ("allee", "all", "al"), "platz": ("platz", "pl"), "gasse": ("gasse", "gass", "g", "gs"),
    "ring": ("ring", "rg", "r"), "damm": ("damm", "dm", "d"), "ufer": ("ufer", "uf", "u"),
}
# Parts of an address that don't belong to the building.
_ADDRESSEE = r"\bc/o\s+\S+\s+[a-z]+|\bz\. ?h(?:d)?\.\s+\S+(?:\s+[a-z]+)?"
_UNIT = (
    r"\b\d{1,2}\.?\s*(?:og|etage|stock|obergeschoss|hinterhof|hof|floor|ug)\b|\b(?:eg|og|dg|ug|erdgeschoss|dachgeschoss|parterre)\b|\b(?:hinterhaus|vorderhaus|hh|vh|rukgebaude|ruckgebaude)\b"
    r"|\b(?:seitenflugel|quergebaude)\b|\b(?:aufgang|gebaude|eingang|block|haus)\s+[a-z]\b|\b(?:studio|raum|zimmer|whg|wohnung|apt|app|apartment|unit|tur)\.?\s*\d+\b|\b(?:links|rechts|mitte)\b|\bempfang\b|\bpforte\b"
)
_COUNTRY = r"(?:^|[\s,;|])(?:deutschland|germany|ger|de|brd)\.?(?=$|[\s,;|])"
_NUMBER = r"(\d{1,4}(?:\s?[a-z](?![a-z]))?(?:\s*[-/]\s*\d{1,4}(?:\s?[a-z](?![a-z]))?)?)(?![\d.])"
#: Share of the weight of the poorer address that must be found in the other.
ACCEPT = 0.85


def _any_kind(dotted: bool) -> str:
    words = sorted({w for k, v in KINDS.items() for w in (v if dotted else (k, *(x for x in v if x == "str")))}, key=len, reverse=True)
    return "|".join(words)


def _kind(word: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, words in KINDS.items():
        out = F.when(word.isin(*words), F.lit(kind)).otherwise(out)
    return out


def _stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that the optimizer neither copies their expressions nor merges them."""
    fresh = df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return fresh


def read_addresses(df: DataFrame) -> DataFrame:
    """``id``, ``num``, ``base``, ``kind`` (null if unreadable), ``plz`` and ``town`` (null if absent) of rows ``id``, ``a``."""
    df = _stage(df.select("id", "a"), a=F.regexp_replace(fold_german(F.col("a")), "[–—−]", "-"))
    df = _stage(df, a=F.regexp_replace(F.regexp_replace(F.col("a"), _ADDRESSEE, " , "), _COUNTRY, " "))
    plz = F.nullif(F.regexp_extract("a", r"(?<!\d)(\d{5})(?!\d)", 1), F.lit(""))
    df = _stage(df, plz=plz, a=F.regexp_replace(F.regexp_replace("a", r"(?:\bd\s?-\s?)?(?<!\d)\d{5}(?!\d)", " , "), _UNIT, " , "))
    full, short = _any_kind(False), _any_kind(True)
    head = rf"(?<![a-z0-9])(?=[a-z0-9]*[a-z]{{2}})([a-z0-9]++)(?:[\s-]+({full}|(?:{short})(?=\.)))?(?:(\.)\s*|\s+)(?:(?:nr|no|hausnr|haus|hnr)\b\.?\s*)?{_NUMBER}"
    parts = {name: F.regexp_extract("a", head, k) for k, name in enumerate(("word", "apart", "dot", "num"), 1)}
    df = _stage(df, **parts, rest=F.regexp_replace("a", head, " , ")).drop("a")
    tail = F.when(F.col("apart") != "", F.lit("")).when(F.col("dot") == ".", F.regexp_extract("word", rf"[a-z0-9]{{3,}}?({short})$", 1)).otherwise(F.regexp_extract("word", rf"[a-z0-9]{{3,}}?({full})$", 1))
    words = F.regexp_extract_all("rest", F.lit(r"(?<![a-z0-9])(?=[a-z0-9]*[a-z]{3})([a-z0-9]++)"), F.lit(1))
    town = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    df = _stage(df, tail=tail, town=town["w"])
    base = _slips(F.substring(F.col("word"), F.lit(1), F.length("word") - F.length("tail")))
    num = F.regexp_replace(F.regexp_replace("num", r"\s", ""), "/", "-")
    kind = _kind(F.when(F.col("apart") != "", F.col("apart")).otherwise(F.col("tail")))
    return _stage(df, num=num, base=base, kind=kind).select("id", "num", "base", "kind", "plz", "town").filter("num <> '' and base <> ''")


def _slips(word: Column) -> Column:
    """Digits that stand for letters, doubled letters and letters of one sound as one."""
    out = F.translate(word, "0135", "oles")
    for old, new in (("rn", "m"), ("ph", "f"), ("th", "t"), ("ck", "k"), ("[cq]", "k"), ("w", "v"), ("y", "i"), ("[ea]i", "ei"), ("(.)\\1+", "$1")):
        out = F.regexp_replace(out, old, new)
    return out


def _known_towns(forms: DataFrame) -> DataFrame:
    """Each town word with the postcode it is written with most, and words close to a frequent one with its postcode."""
    seen = forms.filter("plz is not null and town is not null").groupBy("town", "plz").agg(F.sum("n").alias("n"))
    best = seen.groupBy("town").agg(F.max_by("plz", F.struct("n", "plz")).alias("plz"), F.sum("n").alias("n"))
    main = best.groupBy("plz").agg(F.max_by("town", F.struct("n", "town")).alias("known"), F.max("n").alias("support"))
    open_ = forms.filter("plz is null and town is not null").select("town").distinct().join(best.select("town"), "town", "left_anti")
    ends = lambda c: F.explode(F.array_distinct(F.array(F.concat(F.lit("<"), F.substring(c, 1, 3)), F.concat(F.lit(">"), F.right(F.col(c), F.lit(3))))))
    near = (
        open_.withColumn("end", ends("town")).join(main.withColumn("end", ends("known")), "end")
        .withColumn("d", F.levenshtein("town", "known")).filter("d <= 2")
        .groupBy("town").agg(F.min_by("plz", F.struct("d", -F.col("support"), "plz")).alias("plz"))
    )
    return best.select("town", "plz").unionByName(near)


def address_forms(candidates: DataFrame, key: str, addresses: str) -> tuple[DataFrame, DataFrame]:
    """The distinct readable forms with town, weight and number of candidates, and the form of every candidate."""
    rows = candidates.select(F.col(key).alias("id"), F.explode(addresses).alias("a")).filter(F.col("id").isNotNull() & is_usable(F.col("a")))
    read = cut(read_addresses(rows).distinct())
    raw = read.groupBy("num", "base", "kind", "plz", "town").agg(F.count(F.lit(1)).alias("n"))
    towns = _known_towns(raw).withColumnRenamed("plz", "town_plz")
    placed = read.join(towns, "town", "left").withColumn("place", F.coalesce("plz", "town_plz"))
    own = F.xxhash64("num", "base", F.coalesce("kind", F.lit("?")), F.coalesce("place", F.lit("?")))
    member = cut(placed.select("id", own.alias("form"), "num", "base", "kind", "place").distinct())
    forms = member.groupBy("form", "num", "base", "kind", "place").agg(F.count(F.lit(1)).alias("n"))
    return forms, member.select("id", "form")


def _weights(forms: DataFrame) -> DataFrame:
    """Forms with the rarity of their words: log of the share of forms that hold them."""
    total = forms.agg(F.count(F.lit(1)).alias("total"))
    df = forms.groupBy("base").agg(F.count(F.lit(1)).alias("df_base"))
    pdf = forms.groupBy("place").agg(F.count(F.lit(1)).alias("df_place"))
    out = forms.join(df, "base").join(pdf, "place", "left").crossJoin(F.broadcast(total))
    out = out.withColumn("w_base", F.log1p(F.col("total") / F.col("df_base"))).withColumn("w_place", F.log1p(F.col("total") / F.coalesce("df_place", "total")))
    return out.drop("df_base", "df_place", "total")


def match_forms(forms: DataFrame) -> DataFrame:
    """``form`` and ``group``: every form with the form that stands for its building."""
    f = cut(_weights(forms))
    tokens = F.filter(F.array("base", "kind", F.concat(F.lit("@"), F.col("place"))), lambda t: t.isNotNull())
    side = f.select("form", "num", "base", "kind", "place", "n", "w_base", "w_place", tokens.alias("tokens"))
    head, tail = F.concat(F.lit("<"), F.substring("base", 1, 3)), F.concat(F.lit(">"), F.right(F.col("base"), F.lit(3)))
    blocks = side.filter("place is not null").withColumn("word", F.explode(F.array(head, tail)))
    a = blocks.select([F.col(c).alias(f"{c}_a" if c not in ("num", "place", "word") else c) for c in blocks.columns])
    b = blocks.select([F.col(c).alias(f"{c}_b" if c not in ("num", "place", "word") else c) for c in blocks.columns])
    met = a.join(b, ["num", "place", "word"]).filter("form_a < form_b")
    allowed = F.when(F.least(F.length("base_a"), F.length("base_b")) >= 6, 2).when(F.least(F.length("base_a"), F.length("base_b")) >= 4, 1).otherwise(0)
    gap = F.levenshtein("base_a", "base_b")
    kinds = F.col("kind_a").isNull() | F.col("kind_b").isNull() | (F.col("kind_a") == F.col("kind_b"))
    # an unreadable kind is still part of the word: compare the whole words then
    whole = F.levenshtein(F.concat("base_a", F.coalesce("kind_a", F.lit(""))), F.concat("base_b", F.coalesce("kind_b", F.lit(""))))
    word_gap = F.when(F.col("kind_a").eqNullSafe(F.col("kind_b")), gap).otherwise(whole)
    shared = F.array_intersect("tokens_a", "tokens_b")
    weight = lambda t: F.when(t == F.col("base_a"), F.col("w_base_a")).when(F.startswith(t, F.lit("@")), F.col("w_place_a")).otherwise(F.lit(0.5))
    found = F.aggregate(shared, F.lit(0.0), lambda s, t: s + weight(t))
    # unmatched street words count for nearly their weight if they are close
    close = F.when((F.col("base_a") != F.col("base_b")) & (word_gap <= allowed), F.least("w_base_a", "w_base_b") * 0.95).otherwise(F.lit(0.0))
    need = F.least("w_base_a", "w_base_b") + F.col("w_place_a") + F.when(F.size(shared) >= 3, 0.5).otherwise(F.when(F.col("kind_a").eqNullSafe(F.col("kind_b")) & F.col("kind_a").isNotNull(), 0.5).otherwise(0.0))
    same = met.filter(kinds & (word_gap <= allowed) & (found + close >= F.lit(ACCEPT) * need))
    links = same.select(F.inline(F.array(F.struct(F.col("form_a").alias("form"), F.col("form_b").alias("other"), F.col("n_b").alias("n")), F.struct(F.col("form_b").alias("form"), F.col("form_a").alias("other"), F.col("n_a").alias("n")))))
    own = f.select("form", F.col("form").alias("other"), "n")
    leader = cut(links.unionByName(own).groupBy("form").agg(F.max_by("other", F.struct("n", "other")).alias("lead")))
    # a form follows its leaders to the last one, so that all spellings end at the best-supported one
    ends = chain_ends(leader, "form", "lead").withColumnRenamed("lead", "group")
    placed = ends.join(f.filter("place is not null").select("form"), "form", "left_semi").select("form", "group")
    return placed.unionByName(_placeless(f, placed))


def _placeless(f: DataFrame, placed: DataFrame) -> DataFrame:
    """Forms without town: the one building of that street and number, or their own spelling if there is none.

    Where several towns have the street and number nothing is decided for them.
    """
    lost = f.filter("place is null").select("form", "num", "base", "kind")
    there = f.filter("place is not null").join(placed, "form").select("num", "base", "kind", "place", "group", "n")
    exact = there.groupBy("num", "base", F.coalesce("kind", F.lit("?")).alias("k")).agg(F.count_distinct("place").alias("places"), F.max_by("group", F.struct("n", "group")).alias("group"))
    got = lost.withColumn("k", F.coalesce("kind", F.lit("?"))).join(exact, ["num", "base", "k"], "left")
    sure = got.filter("places = 1").select("form", "group")
    # spelled like no placed form: one slip away from the street of just one town
    rest = cut(got.filter("places is null").select("form", "num", "base", "kind"))
    head = lambda c: F.explode(F.array(F.concat(F.lit("<"), F.substring(c, 1, 3)), F.concat(F.lit(">"), F.right(F.col(c), F.lit(3)))))
    known = there.select("num", F.col("base").alias("base_b"), F.col("kind").alias("kind_b"), "place", "group", "n").withColumn("word", head("base_b"))
    near = rest.withColumn("word", head("base")).join(known, ["num", "word"])
    limit = F.when(F.least(F.length("base"), F.length("base_b")) >= 6, 2).when(F.least(F.length("base"), F.length("base_b")) >= 4, 1).otherwise(0)
    whole = F.levenshtein(F.concat("base", F.coalesce("kind", F.lit(""))), F.concat("base_b", F.coalesce("kind_b", F.lit(""))))
    fits = near.filter((F.col("kind").isNull() | F.col("kind_b").isNull() | (F.col("kind") == F.col("kind_b"))) & (F.when(F.col("kind").eqNullSafe(F.col("kind_b")), F.levenshtein("base", "base_b")).otherwise(whole) <= limit))
    one = fits.groupBy("form").agg(F.count_distinct("place").alias("places"), F.max_by("group", F.struct("n", "group")).alias("group"))
    guessed = one.filter("places = 1").select("form", "group")
    alone = rest.join(one.select("form"), "form", "left_anti").select("form", F.col("form").alias("group"))
    return sure.unionByName(guessed).unionByName(alone)


def same_address(candidates: DataFrame, key: str = "candidate_id", addresses: str = "addresses") -> DataFrame:
    """``id`` and ``group``: the building each candidate is at; candidates with one group share it."""
    forms, member = address_forms(candidates, key, addresses)
    return member.join(match_forms(forms), "form").select("id", "group").distinct()


def p3_found(spark, sf_dir: str) -> DataFrame:
    """``candidate_a`` < ``candidate_b`` of every two candidates at the same building."""
    at = cut(same_address(spark.read.parquet(f"{sf_dir}/candidates.parquet")))
    other = at.select("group", F.col("id").alias("candidate_b"))
    return at.withColumnRenamed("id", "candidate_a").join(other, "group").filter("candidate_a < candidate_b").select("candidate_a", "candidate_b").distinct()
