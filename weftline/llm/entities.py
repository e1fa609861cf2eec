"""Problem 6: matching entities across sources that share no key.

Every record becomes a profile: readings of its names, of its web hosts and of its mail addresses (core and aspect, see
``names``), phone numbers and hosts. Sorted neighbourhoods over several composite keys (core and aspect, aspect and
reversed core, phone, host, mail) bring profiles near each other; a window slides over each order and compares its
members by weighted similarities of the fields, which gives a confidence. What a window of fixed size misses where an
order grows dense is added exactly: readings with cores within the allowed edits by the deletion index of ``names``, and
readings that share a contact by a join on the contact. Between every two sources the matches are
then made one-to-one so that the total confidence is greatest; first names or trades that contradict each other veto a match.

Equal keys are merged before sorting: a key many records share has one place in the order, so a window never fills
with copies and no copy falls out of it; only the final rows hold pairs.

Defined results: null, blank and stand-in values take no part; records without readable name, host and mail match
nobody; a phone number, mail address or host alone never makes a match; repeated rows count once; a record is never
paired with itself; an empty table gives no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.values import is_usable, plain_source_key
from weftline.llm.components import chain_ends
from weftline.llm.names import LONGEST, NICKNAMES, allowed, core_neighbours, deletions, edits, fold, is_full, pieces, rarer, read_name, skeleton
from weftline.runtime import cut, parallelism, spread

#: Places of an order that are compared with each other.
WINDOW = 6
#: Readings of one contact up to which all are paired; those of a busier one meet by an index of their cores.
FEW = 32
#: Confidence from which two records match.
ACCEPT = 0.5
#: Weights of the similarities: name, phone, host, mail. A name match alone passes, contacts alone don't.
WEIGHTS = (0.62, 0.14, 0.14, 0.10)

# Endings of hosts that stand for a trade.
HOST_TRADES = ("ton", "master", "mix", "probe", "pod", "film", "musik")
_FIRSTS = sorted(NICKNAMES)


def read_code(code: str) -> tuple[str, list[str]] | None:
    """Kind and aspect of a host's or mail's code: a trade or the first letters of a first name."""
    if code in HOST_TRADES:
        return "o", [code]
    if len(code) == 2:
        return "p", [n for n in _FIRSTS if n.startswith(code)] or [code[0] + "."]
    return None


def read_contact(value: str) -> tuple[str, str, list[str]] | None:
    """Kind, core and aspect of a host like ``core-code`` or a mail name like ``code.core``; None for any other."""
    text = fold(value)
    own = re.search(r"([a-z0-9]{5,})-([a-z]+)\.[a-z]+(?:[:/?]|$)", text)
    if own and (read := read_code(own[2])):
        return read[0], skeleton(own[1]), read[1]
    mail = re.search(r"(?:^|[\s:])([a-z]+)\.([a-z0-9]{5,})\s*(?:@|\(at\))", text)
    if mail and (read := read_code(mail[1])):
        return read[0], skeleton(mail[2]), read[1]
    return None


def plain_phone(value: str) -> str:
    """National digits of a phone number without country code, trunk zero and extension; empty if there are too few."""
    head = re.split(r"(?i)\b(?:app|ext|durchwahl|dw)\b\.?", value)[0]
    digits = re.sub(r"\D", "", head.replace("(0)", ""))
    digits = re.sub(r"^(?:0049|49(?=\d{9,}))", "", digits) if "+" in head or digits.startswith("00") else digits
    digits = digits.lstrip("0")
    return digits if len(digits) >= 6 else ""


def plain_host(value: str) -> str:
    """Host of a web address without scheme, ``www.``, ``m.`` and port; empty for shared portals' profile pages."""
    m = re.match(r"\s*(?:[a-z]+://)?(?:www\.|m\.)?([a-z0-9.-]+\.[a-z]+)(?::\d+)?(/profil/.*)?", value.lower())
    return m[1] if m and not m[2] else ""


def plain_mail(value: str) -> str:
    """Mail address in lower case without ``mailto:`` and spelt-out signs; empty if it isn't one."""
    text = re.sub(r"^\s*mailto:|\s+", "", re.sub(r"\s*[(\[]at[)\]]\s*", "@", value.lower()))
    return text if re.fullmatch(r"[^@\s]+@[^@\s]+\.[a-z]+", text) else ""


_PROFILE = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("core", T.StringType()), T.StructField("aspect", T.ArrayType(T.StringType())),
        T.StructField("phones", T.ArrayType(T.StringType())), T.StructField("hosts", T.ArrayType(T.StringType())), T.StructField("mails", T.ArrayType(T.StringType())),
    ]
)


def _close(a: str, b: str) -> bool:
    most = allowed(min(len(a), len(b))) + 1
    return edits(a, b, most) <= most


def _agree(a: list[str], b: list[str]) -> bool:
    """True if two aspects don't contradict each other; an initial fits what begins with it."""
    fits = lambda x, y: y.startswith(x[:-1]) if x.endswith(".") else x.startswith(y[:-1]) if y.endswith(".") else x == y
    return not a or not b or any(fits(x, y) for x in a for y in b)


def read_profile(names: list[str], hosts: list[str], mails: list[str]) -> list[tuple[str, str, list[str]]]:
    """The readings (kind, core, aspect) of a record.

    A host or mail that fits a name mends its spelling and fills in its aspect; without any name it is a reading itself.
    """
    own = [(kind, words[0], aspect) for kind, words, aspect in filter(None, map(read_name, names))]
    contacts = [r for r in (read_contact(v) for v in [*hosts, *mails]) if r]
    out: list[tuple[str, str, list[str]]] = []
    for kind, core, aspect in own:
        helper = next(((k, c, a) for k, c, a in contacts if (kind in (k, "?")) and _close(core, c) and _agree(aspect, a)), None)
        if helper:
            k, c, a = helper
            both = [x for x in aspect if x in a] or (aspect if len(aspect) == 1 and not aspect[0].endswith(".") else [])
            out.append((k, c, both or a))
        else:
            out.append((kind, core, aspect))
    if not own:
        out = contacts
    return list({(k, c, tuple(a)): (k, c, a) for k, c, a in out}.values())


def profiles(candidates: DataFrame) -> DataFrame:
    """One row per record and reading, with the record's plain phones, hosts and mails."""
    usable = lambda c: F.coalesce(F.filter(c, is_usable), F.array().cast("array<string>"))
    source = F.coalesce(F.array_min(F.transform("source_keys", plain_source_key)), F.lit("?"))
    rows = candidates.filter(F.col("candidate_id").isNotNull()).select(
        F.col("candidate_id").alias("id"), source.alias("source"), usable("names").alias("names"), usable("phones").alias("phones"), usable("website_urls").alias("hosts"), usable("emails").alias("mails")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for id_, source_, names, phones, hosts, mails in pdf.itertuples(index=False):
                ph, ho, ma = (sorted({x for x in map(f, v) if x}) for f, v in ((plain_phone, phones), (plain_host, hosts), (plain_mail, mails)))
                out += [(id_, source_, k, c, a, ph, ho, ma) for k, c, a in read_profile(list(names), list(hosts), list(mails))]
            if out:
                yield pd.DataFrame(out, columns=_PROFILE.names)

    return spread(rows).mapInPandas(run, _PROFILE)


def slide(keys: DataFrame, window: int = WINDOW) -> DataFrame:
    """``a``, ``b``, ``same``: members at most ``window`` - 1 places apart in the order of (``key``, ``rid``).

    ``keys`` has ``key``, ``rid`` and ``tag``; ``same`` says whether both have the same tag, which is null if there is none.
    The order is cut into ranges that tasks slide over alone; each task also passes on its first and last places, and a
    second small step slides over those where ranges meet.
    """
    n = parallelism(keys.sparkSession)
    laid = keys.select("key", "rid", "tag").repartitionByRange(n, "key", "rid").sortWithinPartitions("key", "rid").select("rid", F.coalesce("tag", F.lit(0)).cast("long").alias("tag"), F.spark_partition_id().alias("part"))
    schema = "a long, b long, same boolean, part int, place int, rid long, tag long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: list[tuple] = []
        last: list[tuple] = []
        part = -1
        for pdf in frames:
            if not len(pdf):
                continue
            part = int(pdf["part"].iloc[0])
            fresh = list(zip(pdf["rid"].tolist(), pdf["tag"].tolist(), strict=True))
            run_ = last + fresh
            pairs = [(*sorted((run_[j][0], run_[k][0])), bool(run_[j][1] and run_[j][1] == run_[k][1]), -1, 0, 0, 0) for k in range(len(last), len(run_)) for j in range(max(0, k - window + 1), k) if run_[j][0] != run_[k][0]]
            first += fresh[: max(0, window - 1 - len(first))]
            last = run_[-(window - 1) :]
            if pairs:
                yield pd.DataFrame(pairs, columns=names)
        ends = [(0, 0, False, part, k, *x) for k, x in enumerate(first)] + [(0, 0, False, part, (1 << 20) + k, *x) for k, x in enumerate(last)]
        if ends:
            yield pd.DataFrame(ends, columns=names)

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: dict[int, tuple[list, list]] = {}
        for pdf in frames:
            for part, place, rid, tag in zip(pdf["part"], pdf["place"], pdf["rid"], pdf["tag"], strict=True):
                ends.setdefault(part, ([], []))[place >= 1 << 20].append((place, rid, tag))
        before: list[tuple] = []
        pairs = []
        for part in sorted(ends):
            head, tail = ([x[1:] for x in sorted(side)] for side in ends[part])
            for k, (b, tb) in enumerate(head):
                pairs += [(*sorted((a, b)), bool(ta and ta == tb)) for a, ta in before[len(before) - window + 1 + k if len(before) - window + 1 + k > 0 else 0 :] if a != b]
            before = tail if len(head) == window - 1 else (before + head)[-(window - 1) :]
        if pairs:
            yield pd.DataFrame(pairs, columns=["a", "b", "same"])

    made = cut(laid.mapInPandas(run, schema))
    # a few places of every task: one task can put them side by side
    seam = made.filter("part >= 0").select("part", "place", "rid", "tag").repartition(1).mapInPandas(join, "a long, b long, same boolean")
    return made.filter("part = -1").select("a", "b", "same").unionByName(seam)


def _similar(core_a: str, aspect_a: list[str], core_b: str, aspect_b: list[str], phone: bool, host: bool, mail: bool) -> float:
    """Confidence of two readings; 0 where first names or trades contradict each other or the cores are far apart."""
    if not _agree(aspect_a, aspect_b):
        return 0.0
    shared = (phone, host, mail)
    most = allowed(min(len(core_a), len(core_b))) + any(shared)
    d = edits(core_a, core_b, most)
    if d > most:
        return 0.0
    whole = 1.0 if len(aspect_a) == 1 and aspect_a == aspect_b else 0.75
    return WEIGHTS[0] * whole * (1 - 0.25 * d / max(len(core_a), len(core_b))) + 0.06 * (d == 0) + sum(w for w, x in zip(WEIGHTS[1:], shared, strict=True) if x)


@F.pandas_udf(T.DoubleType())
def confidence(ca: pd.Series, aa: pd.Series, cb: pd.Series, ab: pd.Series, phone: pd.Series, host: pd.Series, mail: pd.Series) -> pd.Series:
    """Weighted similarity of two readings and what contacts they share."""
    return pd.Series([_similar(a, list(x), b, list(y), p, h, m) for a, x, b, y, p, h, m in zip(ca, aa, cb, ab, phone, host, mail, strict=True)], dtype="float64")


_FITS = "case when x like '%.' then startswith(y, left(x, length(x) - 1)) when y like '%.' then startswith(x, left(y, length(y) - 1)) else x = y end"
#: ``_agree`` of the columns aspect_a and aspect_b.
_AGREES = f"size(aspect_a) = 0 or size(aspect_b) = 0 or exists(aspect_a, x -> exists(aspect_b, y -> {_FITS}))"


def near_readings(readings: DataFrame) -> DataFrame:
    """``a`` < ``b`` of every two readings that agree and whose cores are within the allowed edits, however dense the orders are."""
    cores = cut(readings.select("core").distinct())
    near = core_neighbours(cores).filter("core < other").select("core", "other").unionByName(cores.select("core", F.col("core").alias("other")))
    side = lambda x, core: readings.select(F.col("rid").alias(x), F.col("core").alias(core), F.col("kind").alias(f"kind_{x}"), F.col("aspect").alias(f"aspect_{x}"))
    both = near.join(side("a", "core").hint("merge"), "core").join(side("b", "other").hint("merge"), "other")
    both = both.filter("a <> b and (kind_a = kind_b or kind_a = '?' or kind_b = '?')").filter(_AGREES)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _core_keys(core: str) -> set[str]:
    """Strings of which two cores share one if they are one edit more apart than allowed, as a shared contact permits."""
    n = len(core)
    most = allowed(n) + 1
    return (pieces(core, most) if n > LONGEST else set()) | (deletions(core, most) if n <= LONGEST + most else set())


def shared_contacts(held: DataFrame) -> DataFrame:
    """``a`` < ``b`` and the ``field`` of readings that share a contact: all, or of a busy contact all whose cores can match."""
    each = None
    for field in ("phones", "hosts", "mails"):
        part = held.select("rid", "core", F.lit(field).alias("field"), F.explode(field).alias("v"))
        each = part if each is None else each.unionByName(part)
    each = each.distinct()
    sizes = each.groupBy("field", "v").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    each = cut(each.join(sizes.hint("merge"), ["field", "v"]))
    few, many = each.filter(F.col("k") <= FEW), each.filter(F.col("k") > FEW)
    rid = lambda df, x, *keys: df.select("field", "v", *keys, F.col("rid").alias(x))
    pairs = rid(few, "a").join(rid(few, "b").hint("merge"), ["field", "v"]).select("a", "b", "field")

    def strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for field, v, core in pdf.itertuples(index=False):
                yield pd.DataFrame({"field": field, "v": v, "core": core, "cut": list(_core_keys(core))})

    busy = spread(many.select("field", "v", "core").distinct()).mapInPandas(strings, "field string, v string, core string, cut string").withColumn("cut", F.xxhash64("cut"))
    met = busy.join(busy.withColumnRenamed("core", "other").hint("merge"), ["field", "v", "cut"]).filter("core <= other").select("field", "v", "core", "other").distinct()
    more = met.join(rid(many, "a", "core").hint("merge"), ["field", "v", "core"]).join(rid(many, "b", F.col("core").alias("other")).hint("merge"), ["field", "v", "other"]).select("a", "b", "field")
    return pairs.unionByName(more).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "field").distinct()


def match_readings(held: DataFrame, readings: DataFrame) -> DataFrame:
    """``rid_a``, ``rid_b``, ``conf`` and ``contact`` (a shared one) of every two readings that match."""
    text = F.concat_ws("|", "aspect")
    none = F.lit(None).cast("long")
    orders = {
        "core": readings.select(F.concat_ws("|", "core", text, "kind").alias("key"), "rid", none.alias("tag")),
        "turned": readings.select(F.concat_ws("|", text, F.reverse("core"), "kind").alias("key"), "rid", none.alias("tag")),
    }
    for field in ("phones", "hosts", "mails"):
        each = held.select("rid", "core", F.explode(field).alias("v")).distinct()
        orders[field] = each.select(F.concat_ws("|", "v", "core").alias("key"), "rid", F.xxhash64("v").alias("tag"))
    met = None
    for name, order in orders.items():
        pairs = slide(order).select("a", "b", *[(F.col("same") & F.lit(name == f)).alias(f) for f in ("phones", "hosts", "mails")])
        met = pairs if met is None else met.unionByName(pairs)
    fields = ("phones", "hosts", "mails")
    met = met.unionByName(near_readings(readings).select("a", "b", *[F.lit(False).alias(f) for f in fields]))
    met = met.unionByName(shared_contacts(held).select("a", "b", *[(F.col("field") == f).alias(f) for f in fields]))
    pairs = met.groupBy("a", "b").agg(*[F.bool_or(f).alias(f) for f in ("phones", "hosts", "mails")])
    side = lambda x: readings.select(F.col("rid").alias(x), F.col("kind").alias(f"kind_{x}"), F.col("core").alias(f"core_{x}"), F.col("aspect").alias(f"aspect_{x}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").filter("kind_a = kind_b or kind_a = '?' or kind_b = '?'")
    scored = both.withColumn("conf", confidence("core_a", "aspect_a", "core_b", "aspect_b", "phones", "hosts", "mails")).filter(F.col("conf") >= ACCEPT)
    return scored.select(F.col("a").alias("rid_a"), F.col("b").alias("rid_b"), "conf", F.expr("phones or hosts or mails").alias("contact"))


def group_readings(readings: DataFrame, links: DataFrame) -> DataFrame:
    """``rid``, ``entity`` and ``conf``: the leading reading each reading belongs to and how surely.

    A full reading follows the match of most support; two of like support (see ``names.rarer``) are only joined if they share a
    contact. An incomplete reading joins the one entity it matches best, or stays alone if there are several.
    """
    both = links.select(F.inline(F.array(F.struct(F.col("rid_a").alias("rid"), F.col("rid_b").alias("t"), "conf", "contact"), F.struct(F.col("rid_b").alias("rid"), F.col("rid_a").alias("t"), "conf", "contact"))))
    info = readings.select("rid", "full", "n")
    to = info.select(F.col("rid").alias("t"), F.col("full").alias("t_full"), F.col("n").alias("t_n"))
    at = cut(both.join(info.hint("merge"), "rid").join(to.hint("merge"), "t").filter("t_full"))
    ahead = at.filter(f"full and ({rarer('n', 't_n')} or contact) and (t_n > n or (t_n = n and t < rid))")
    follow = ahead.groupBy("rid").agg(F.max_by(F.struct("t", "conf"), F.struct("conf", "t_n", "t")).alias("f")).select("rid", "f.t", "f.conf")
    hop = cut(info.filter("full").select("rid").join(follow.hint("merge"), "rid", "left").select("rid", F.coalesce("t", "rid").alias("t"), F.coalesce("conf", F.lit(1.0)).alias("conf")))
    lead = chain_ends(hop, "rid", "t").select("rid", F.col("t").alias("entity"), "conf")
    fits = at.filter("not full").join(lead.select(F.col("rid").alias("t"), "entity").hint("merge"), "t")
    best = fits.groupBy("rid", F.col("contact")).agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"), F.max("conf").alias("conf"))
    best = best.groupBy("rid").agg(F.max_by(F.struct("lo", "hi", "conf"), F.col("contact").cast("int")).alias("e"))
    joined = best.filter("e.lo = e.hi").select("rid", F.col("e.lo").alias("entity"), F.col("e.conf").alias("conf"))
    alone = info.filter("not full").select("rid").join(best.hint("merge"), "rid", "left_anti").select("rid", F.col("rid").alias("entity"), F.lit(1.0).alias("conf"))
    return lead.unionByName(joined).unionByName(alone)


def entity_members(candidates: DataFrame) -> DataFrame:
    """``id``, ``source``, ``entity`` and ``conf`` (how surely the record belongs to it) of every record with a reading."""
    held = cut(profiles(candidates).distinct().withColumn("rid", F.xxhash64("kind", "core", "aspect")))
    readings = cut(held.groupBy("rid", "kind", "core", "aspect").agg(F.count(F.lit(1)).alias("n")).withColumn("full", is_full(F.col("kind"), F.col("aspect"))))
    where = group_readings(readings, match_readings(held, readings))
    return held.select("id", "source", "rid").join(where.hint("merge"), "rid").groupBy("id", "entity").agg(F.min("source").alias("source"), F.max("conf").alias("conf"))


def one_to_one(members: DataFrame) -> DataFrame:
    """``candidate_a``, ``candidate_b`` and ``confidence``: members of an entity matched one-to-one between every two sources.

    The confidence of two members is the product of how surely each belongs to the entity. For such products the greatest
    total is reached by matching the surest of one source with the surest of the other, the second with the second and so
    on, so each member gets a rank within its source and entity and equal ranks match. Ranks are counted within ranges of
    the order and moved on by what the ranges before hold, so an entity of any size is ranked as a whole in many tasks.
    """
    sizes = members.groupBy("entity").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    order = ("entity", "source", F.desc("conf"), "id")
    ranges = members.join(sizes.hint("merge"), "entity").repartitionByRange(parallelism(members.sparkSession), *order)
    laid = cut(ranges.select("entity", "source", "conf", "id", F.spark_partition_id().alias("part")))
    held = laid.groupBy("entity", "source", "part").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("entity", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("entity", "source", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    rank = Window.partitionBy("entity", "source", "part").orderBy(F.desc("conf"), "id")
    slot = laid.withColumn("place", F.row_number().over(rank)).join(held.hint("merge"), ["entity", "source", "part"])
    slot = cut(slot.select("entity", (F.col("before") + F.col("place")).alias("slot"), "id", "source", "conf"))
    other = slot.select("entity", "slot", F.col("id").alias("id2"), F.col("source").alias("source2"), F.col("conf").alias("conf2"))
    met = slot.join(other.hint("merge"), ["entity", "slot"]).filter("source < source2 and id <> id2")
    pairs = met.select(F.least("id", "id2").alias("candidate_a"), F.greatest("id", "id2").alias("candidate_b"), F.round(F.col("conf") * F.col("conf2"), 6).alias("confidence"), "entity")
    return pairs.groupBy("candidate_a", "candidate_b").agg(F.max("confidence").alias("confidence"), F.max_by("entity", "confidence").alias("entity"))


def p6_matches(spark, sf_dir: str) -> DataFrame:
    """One-to-one matches between every two sources with their confidence."""
    members = cut(entity_members(spark.read.parquet(f"{sf_dir}/candidates.parquet")))
    return one_to_one(members).select("candidate_a", "candidate_b", "confidence")


def p6_found(spark, sf_dir: str) -> DataFrame:
    """``candidate_a`` < ``candidate_b`` of every two candidates that describe one entity.

    A source may describe an entity twice and records of one source may too, so these are all pairs of members of an
    entity. The one-to-one assignment, whose pairs are among them, serves ``p6_matches`` only.
    """
    members = cut(entity_members(spark.read.parquet(f"{sf_dir}/candidates.parquet")))
    other = members.select("entity", F.col("id").alias("candidate_b"))
    return members.select("entity", F.col("id").alias("candidate_a")).join(other.hint("merge"), "entity").filter("candidate_a < candidate_b").select("candidate_a", "candidate_b").distinct()
