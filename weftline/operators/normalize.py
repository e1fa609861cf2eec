"""Normalization of extracted fields into observations by rules, in built-in expressions but for Unicode and IDNA.

Each rule asks for one field: a missing one is not observed, a prohibited one is reported without its text, a readable
one is observed, any other is invalid with a reason. Boolean rules look for patterns in the text blocks, negative ones
first over all blocks.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import collapse
from weftline.functions.url import url_observed


def _column(function) -> object:
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v) for v in values], dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())


def nfkc(value: Column) -> Column:
    """Compatibility composition and squeezed blanks; plain ASCII never leaves the JVM's fast path of the caller's filter."""
    return _column(lambda v: " ".join(unicodedata.normalize("NFKC", v).split()))(value)


def casefold(value: Column) -> Column:
    """NFKC and full case folding, for comparisons."""
    return _column(lambda v: unicodedata.normalize("NFKC", v).casefold())(value)


def _idna(domain: str) -> str | None:
    try:
        return domain.strip().encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None


def email(value: Column) -> Column:
    """Local part as written and the domain in lower-case IDNA; null if there isn't just one ``@`` or no dot after it."""
    parts = F.split(value, "@")
    local, domain = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    plain = F.when(domain.rlike(r"\A[\x21-\x7e]+\z") & domain.rlike(r"\A[^.]{1,63}(?:\.[^.]{1,63})*\.?\z"), F.lower(domain)).otherwise(_column(lambda v: _idna(v) if not v.isascii() else None)(domain))
    return F.when((F.size(parts) == 2) & (local != "") & plain.contains("."), F.concat(local, F.lit("@"), plain))


# Country calling codes of the regions that are understood, with the trunk prefix.
CALLING = {"DE": ("49", "0"), "AT": ("43", "0"), "CH": ("41", "0"), "FR": ("33", "0"), "GB": ("44", "0"), "ES": ("34", ""), "IT": ("39", ""), "PL": ("48", ""), "NL": ("31", "0"), "US": ("1", "1")}


def phone(value: Column, region: str | None = None) -> Column:
    """E.164 of an international number, or of a national one in a known ``region``; null if unsure.

    A bounded rule set: separators and a bracketed trunk zero are dropped; 7 to 15 digits are needed; extensions and letters
    make a number invalid.
    """
    text = F.regexp_replace(F.regexp_replace(F.trim(value), r"\A(?i:tel)[.:]?\s*", ""), r"\(0\)", "")
    ok = text.rlike(r"\A[+0-9 ()/.\-]+\z")
    digits = F.regexp_replace(text, r"[^0-9+]", "")
    code, trunk = CALLING.get(region or "", (None, ""))
    world = F.when(digits.startswith("+"), digits).when(digits.startswith("00"), F.concat(F.lit("+"), digits.substr(3, 30)))
    if code:
        home = F.concat(F.lit("+" + code), digits.substr(len(trunk) + 1, 30) if trunk else digits)
        world = world.when(digits.startswith(trunk) if trunk else F.lit(True), home)
    return F.when(ok & world.rlike(r"\A\+[1-9][0-9]{6,14}\z"), world)


def string_set(values: Column) -> Column:
    """Distinct squeezed values in order of their first occurrence."""
    return F.array_distinct(F.transform(values, collapse))


def money(parts: Column) -> Column:
    """Amount, currency and basis of an offer as a struct; null unless all three are there and the amount is a positive number."""
    amount = F.get(parts, F.lit(0)).try_cast("decimal(19,4)")
    currency, basis = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    return F.when((amount > 0) & currency.rlike(r"\A[A-Z]{3}\z") & (basis != ""), F.struct(amount.alias("amount"), currency.alias("currency"), collapse(basis).alias("basis")))


def confidence(locator_kind: Column) -> Column:
    """How far a field is trusted by where it was found."""
    return F.when(locator_kind == "json_pointer", F.lit("0.95")).otherwise(F.lit("0.85")).cast("decimal(5,4)")


# Reasons of invalid values by kind.
REASONS = {"url": "URL_INVALID", "email": "EMAIL_INVALID", "phone": "PHONE_INVALID", "structured_address": "ADDRESS_UNSTRUCTURED", "money": "MONEY_INCOMPLETE"}


def normalize_fields(fields: DataFrame, rules: DataFrame, region: str | None = None) -> DataFrame:
    """One observation per record, rule and field found; one per record and rule without field.

    ``fields`` as extraction gives them; ``rules`` has ``source_field``, ``target_field`` and ``value_kind`` and is small.
    Columns: ``record_id``, ``field_key``, ``state``, ``text``, ``values``, ``reason``, ``confidence``, ``locator``, ``evidence_digest``.
    """
    records = fields.select("record_id").distinct()
    asked = records.crossJoin(F.broadcast(rules.select("source_field", "target_field", "value_kind")))
    have = fields.filter("field_key <> 'text_block' and issue is null").withColumnRenamed("field_key", "source_field")
    rows = asked.join(have, ["record_id", "source_field"], "left")
    want, kind = F.col("value_kind"), F.col("kind")
    fits = (want == kind) | ((want == "structured_address") & (kind == "address"))
    text = (
        F.when(want == "text", nfkc(F.col("text"))).when(want == "url", url_observed(F.col("text"))).when(want == "email", email(F.col("text"))).when(want == "phone", phone(F.col("text"), region))
        .when(want == "money", F.to_json(money(F.col("values")))).when((want == "structured_address") & (kind == "structured_address"), F.array_join(F.filter("values", lambda v: v != ""), ", "))
        .when(want == "string_set", F.array_join(string_set(F.col("values")), "|"))
    )
    rows = rows.withColumn("_found", kind.isNotNull()).withColumn("_text", F.when(fits, text))
    state = F.when(~F.col("_found"), "not_observed").when(F.col("prohibited"), "prohibited_by_policy").when(F.col("_text").isNotNull(), "observed").otherwise("invalid")
    table = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    reason = F.when(fits, F.try_element_at(table, want)).otherwise(F.lit("VALUE_KIND_MISMATCH"))
    return rows.withColumn("state", state).select(
        "record_id", F.col("target_field").alias("field_key"), "state", F.when(F.col("state") == "observed", F.col("_text")).alias("text"), F.when((F.col("state") == "observed") & (want == "string_set"), string_set(F.col("values"))).alias("values"),
        F.when(F.col("state") == "invalid", reason).alias("reason"), F.when(F.col("state") == "observed", confidence(F.col("locator_kind"))).otherwise(F.lit(1).cast("decimal(5,4)")).alias("confidence"), "locator", "evidence_digest",
    )


def boolean_patterns(blocks: DataFrame, rules: list[tuple[str, tuple[str, ...], tuple[str, ...]]], key: str = "record_id", position: str = "position", text: str = "text") -> DataFrame:
    """``key``, ``field_key``, ``state``, ``value``, ``confidence`` and the first matching ``block`` of boolean rules.

    A rule is (field, positive patterns, negative patterns); any negative match decides against all positive ones.
    Patterns are case-blind and know Unicode. One aggregation serves all rules.
    """
    any_of = lambda ps: F.col(text).rlike("(?iuU)(?:" + "|".join(f"(?:{p})" for p in ps) + ")") if ps else F.lit(False)
    aggs = []
    for name, positive, negative in rules:
        for tag, patterns in (("neg", negative), ("pos", positive)):
            hit = F.coalesce(any_of(patterns), F.lit(False))
            aggs.append(F.min_by(F.when(hit, F.col(text)), F.when(hit, F.col(position))).alias(f"{name}_{tag}"))
    by = blocks.groupBy(key).agg(*aggs)
    each = F.array(*[F.struct(F.lit(n).alias("field_key"), F.col(f"{n}_neg").alias("neg"), F.col(f"{n}_pos").alias("pos")) for n, _, _ in rules])
    rows = by.select(key, F.inline(each))
    value = F.when(F.col("neg").isNotNull(), F.lit(False)).when(F.col("pos").isNotNull(), F.lit(True))
    points = F.when(F.col("neg").isNotNull(), F.lit("0.80")).when(F.col("pos").isNotNull(), F.lit("0.75")).otherwise(F.lit("1")).cast("decimal(5,4)")
    return rows.select(key, "field_key", F.when(value.isNull(), "not_observed").otherwise("observed").alias("state"), value.alias("value"), points.alias("confidence"), F.coalesce("neg", "pos").alias("block"))
