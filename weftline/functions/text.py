"""Text helpers in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every kind of blank: Java's \s is ASCII only.
BLANKS = r"[\s\u0085   -     　\u001c-\u001f]+"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))
# Letters with marks and the base letter they are folded to.
_MARKED = "àáâãåçèéêëìíîïñòóôõøùúûýÿšžčćđłńśźżřěůőűğışțţăąęį"
_BASE = "aaaaaceeeeiiiinooooouuuyyszccdlnszzreuougisttaaei"


def collapse(value: Column) -> Column:
    """Runs of blanks of any kind become one space, none at the ends."""
    return F.trim(F.regexp_replace(value, BLANKS, " "))


def bounded(value: Column, limit: int) -> Column:
    """Text of at most ``limit`` characters, an ellipsis in place of what is cut."""
    return F.when(F.length(value) > limit, F.concat(F.rtrim(F.substring(value, 1, limit - 1)), F.lit("…"))).otherwise(value)


def plain_width(value: Column) -> Column:
    """Full-width ASCII forms as plain ASCII, and no invisible characters."""
    return F.regexp_replace(F.translate(value, _WIDE, _PLAIN), "[​-‏⁠﻿­]", "")


def fold_german(value: Column) -> Column:
    """Lower case without marks; umlauts and their spelling with e are the bare vowel, so that ä = ae = a."""
    low = F.regexp_replace(F.lower(plain_width(value)), r"[̀-ͯ]", "")
    low = F.translate(F.regexp_replace(F.regexp_replace(low, "ß", "ss"), "æ", "a"), "äöü" + _MARKED, "aou" + _BASE)
    return F.regexp_replace(low, "([aou])e", "$1")
