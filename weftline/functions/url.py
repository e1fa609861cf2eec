"""Web addresses and HTTP headers.

ASCII addresses stay in built-in expressions wherever the rule allows; what needs IDNA, percent-decoding and path arithmetic
runs as vectorised Python.
"""

from __future__ import annotations

import ipaddress
import re
from typing import NamedTuple
from urllib.parse import quote_plus, unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_URL = 4_096
# The parts of an address as RFC 3986 gives them (scheme, authority, path, query), and the ports of schemes.
_PARTS = re.compile(r"([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?", re.DOTALL)
_PORTS = {"http": "80", "https": "443"}
_SITE = re.compile(r"(?P<host>\[[0-9A-Fa-f:.]+\]|[^@:\[\]]+)(?::(?P<port>[0-9]*))?")
_CONTROL = re.compile(r"[\x00-\x1f]")


class Address(NamedTuple):
    """A web address taken apart: ``site`` is the host in IDNA, with the port unless it is the scheme's own."""

    scheme: str
    site: str
    path: str
    query: str

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.site}"

    def text(self, path: str, query: str) -> str:
        return self.origin + path + (f"?{query}" if query else "")


def read_address(url: str | None) -> Address | None:
    """The parts of a web address without user and fragment; None for anything else."""
    if not url or len(url) > MAX_URL or _CONTROL.search(url):
        return None
    whole = _PARTS.fullmatch(url.lstrip(" "))
    if not whole or whole[1].lower() not in _PORTS:
        return None
    scheme, site = whole[1].lower(), _SITE.fullmatch(whole[2])
    if not site:
        return None
    host, port = site["host"], (site["port"] or "").lstrip("0")
    if site["port"] and not port or len(port) > 5 or int(port or 1) > 65_535:
        return None
    if not host.startswith("["):
        try:
            host = host.encode("idna").decode("ascii")
        except UnicodeError:
            return None
    own = port in ("", _PORTS[scheme])
    return Address(scheme, host.lower() if own else f"{host.lower()}:{port}", whole[3], whole[4] or "")


def plain_path(path: str) -> str:
    """Absolute path without empty and dot segments and back slashes; a closing slash is kept."""
    kept: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            del kept[-1:]
        elif part not in ("", "."):
            kept.append(part)
    return "/" + "/".join(kept) + ("/" if kept and path.endswith("/") else "")


def plain_query(query: str, tracking: frozenset[str]) -> str:
    """The parameters of a query in order of their names and values, without those for tracking."""
    named = [tuple(map(unquote_plus, item.partition("=")[::2])) for item in query.split("&") if item]
    return "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(named) if k.casefold() not in tracking)


def normalize_url(url: str | None, tracking: frozenset[str] = frozenset()) -> str | None:
    """The canonical form of a web address: no fragment, default port or tracking parameters, sorted query; None if invalid."""
    at = read_address(url)
    return at and at.text(plain_path(at.path), plain_query(at.query, tracking))


def observed_url(url: str | None) -> str | None:
    """The form kept as an observed value: path and query as written, fragment and default port dropped; None if invalid."""
    at = read_address(url)
    return at and at.text(at.path or "/", at.query)


def origin(url: str | None) -> str | None:
    """Scheme and host of a web address; None if invalid."""
    at = read_address(url)
    return at and at.origin


def is_canonical(url: str | None, tracking: frozenset[str] = frozenset()) -> bool:
    """True for an address that is its own canonical form."""
    return url is not None and normalize_url(url, tracking) == url


def url_normalized(url: Column, tracking: tuple[str, ...] = ()) -> Column:
    """Column form of ``normalize_url``."""
    dropped = frozenset(t.casefold() for t in tracking)
    return _as_udf(lambda u: normalize_url(u, dropped))(url)


def url_origin(url: Column) -> Column:
    """Column form of ``origin``."""
    return _as_udf(origin)(url)


def url_observed(url: Column) -> Column:
    """Column form of ``observed_url``."""
    return _as_udf(observed_url)(url)


def _as_udf(function):
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([function(v) for v in values], dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())


def same_origin(a: Column, b: Column) -> Column:
    """True if two addresses have one origin; False if either is invalid."""
    return F.coalesce(url_origin(a) == url_origin(b), F.lit(False))


def registrable_domain(host: Column, suffixes: tuple[str, ...] = ("co.uk", "org.uk", "com.au", "co.jp")) -> Column:
    """The last label before the public suffix; one-label suffixes and the listed longer ones are known."""
    parts = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    short = F.when(F.size(parts) <= 2, host)
    return short.when(last(2).isin(*suffixes), F.when(F.size(parts) == 2, host).otherwise(last(3))).otherwise(last(2))


def media_type(header: Column) -> Column:
    """The media type of a content-type header, without parameters, in lower case."""
    return F.lower(F.trim(F.element_at(F.split(header, ";"), 1)))


def retry_after_seconds(header: Column, most: int = 86_400, clamp: bool = True) -> Column:
    """Seconds of a numeric retry-after header, at most ``most`` (or null above it); null for anything else."""
    n = F.when(F.trim(header).rlike(r"\A[0-9]{1,9}\z"), F.trim(header).cast("long"))
    return F.when(n > most, F.lit(most)).otherwise(n) if clamp else F.when(n <= most, n)


def status_outcome(status: Column) -> Column:
    """What a response status means for the request: succeeded, unchanged, missing, blocked, retry or failed."""
    return (
        F.when(status.between(200, 299), "succeeded").when(status == 304, "unchanged").when(status.isin(404, 410), "missing").when(status.isin(401, 403, 451), "blocked")
        .when(status.isin(408, 425, 429) | status.between(500, 599), "retry").otherwise("failed")
    )


def is_public_address(address: Column) -> Column:
    """True for addresses of the public internet; False for private, local and reserved ones and for anything else."""

    def run(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return ipaddress.ip_address(v).is_global
            except ValueError:
                return False

        return values.map(one).astype(bool)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.BooleanType())(address)


def interest(url: Column, rules: list[tuple[str, tuple[str, ...], int]]) -> Column:
    """``score`` and ``key`` of the best rule (key, tokens, priority) one of whose tokens is in path or query; 0 and null without one.

    Of rules of one priority the first key in order counts.
    """
    text = F.lower(F.concat(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("?"), F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))))
    out = F.struct(F.lit(0).alias("score"), F.lit(None).cast("string").alias("key"))
    for key, tokens, priority in sorted(rules, key=lambda r: (r[2], tuple(-ord(c) for c in r[0]))):
        hit = F.lit(False)
        for token in tokens:
            hit = hit | text.contains(token)
        out = F.when(hit, F.struct(F.lit(priority).alias("score"), F.lit(key).alias("key"))).otherwise(out)
    return out
