"""Usable values: what counts as a value at all, and plain forms of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that people and exports put where a value is missing, lower case.
STAND_INS = (
    "none", "null", "nil", "nan", "n/a", "n.a.", "na", "k. a.", "k.a.", "keine angabe", "keine angaben", "unbekannt",
    "nicht bekannt", "unknown", "not known", "tbd", "tba", "xxx", "xx", "(leer)", "leer", "(empty)", "empty",
    "ohne", "fehlt", "missing", "not available", "nicht vorhanden",
)


def is_usable(value: Column) -> Column:
    """True if a string is not null, not blank (nor punctuation alone) and no stand-in; never null."""
    bare = F.lower(F.trim(F.regexp_replace(value, r"[\s ​-‍﻿]+", " ")))
    return F.coalesce(bare.rlike(r"[\p{L}\p{N}]") & ~bare.isin(*STAND_INS), F.lit(False))


def usable_values(values: Column) -> Column:
    """The usable values of an array in their order; an empty array for null."""
    return F.coalesce(F.filter(values, is_usable), F.array().cast("array<string>"))


def plain_uuid(value: Column) -> Column:
    """Lower-case UUID with hyphens from any usual notation (upper case, spaces, braces, ``urn:uuid:``, no hyphens).

    Null if the text holds no 32 hex digits.
    """
    hexes = F.regexp_replace(F.regexp_replace(F.lower(value), r"^\s*urn:uuid:", ""), r"[^0-9a-f]", "")
    form = F.regexp_replace(hexes, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(F.length(hexes) == 32, form)


def plain_digest(value: Column) -> Column:
    """``sha256:`` and 64 lower-case hex digits from any notation of a digest; null if there aren't 64 digits."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(value), r"^\W*sha-?256\W*", ""), r"[^0-9a-f]", "")
    return F.when(F.length(bare) == 64, F.concat(F.lit("sha256:"), bare))


def plain_source_key(value: Column) -> Column:
    """A source key in lower case with single underscores, whatever its case, spaces or hyphens were."""
    return F.regexp_replace(F.lower(F.trim(value)), r"[\s\-_.]+", "_")
