"""Scans of web documents: robots files, sitemaps and links of pages, ranked per page."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.url import interest, normalize_url, origin
from weftline.operators.extract import read_page
from weftline.runtime import as_frame


def robots_records(text: str) -> Iterator[tuple[str, str]]:
    """Field (lower case) and value of every line of a robots file; a blank line is a record of two empty texts."""
    for line in text.splitlines():
        bare = line.split("#", 1)[0].strip()
        field, colon, value = bare.partition(":")
        if colon:
            yield field.strip().lower(), value.strip()
        elif not line.strip():
            yield "", ""


def root_access(records: list[tuple[str, str]], agent: str) -> tuple[bool, int | None]:
    """Whether an agent may fetch the root, and its delay: the first group that names it decides, else the first for all.

    In a group the first rule about the root counts; a rule without path allows everything.
    """
    wanted = agent.split("/", 1)[0].lower()
    groups: list[dict] = []
    naming = False
    for field, value in records:
        if field == "user-agent":
            if not naming:
                groups.append({"agents": [], "root": None, "delay": None})
            groups[-1]["agents"].append(value.lower())
            naming = True
        elif field in ("allow", "disallow", "crawl-delay") and groups and groups[-1] is not None:
            naming, group = False, groups[-1]
            if field == "crawl-delay":
                group["delay"] = int(value) if value.isdecimal() else group["delay"]
            elif group["root"] is None and value in ("", "/", "*"):
                group["root"] = field == "allow" or not value
        elif not field and groups and groups[-1] is not None:
            if naming:
                groups[-1], naming = None, False  # a group without rules
            else:
                groups.append(None)  # what follows a blank line without an agent belongs to nobody
    groups = [g for g in groups if g]
    mine = next((g for g in groups if any(a != "*" and a in wanted for a in g["agents"])), None) or next((g for g in groups if "*" in g["agents"]), None)
    return (True, None) if mine is None else (mine["root"] is not False, mine["delay"])


def read_robots(url: str, body: bytes, agent: str) -> dict:
    """Whether the agent may fetch the site's root, its crawl delay and the site's own sitemaps."""
    try:
        records = list(robots_records(str(body, "utf-8-sig")))
    except UnicodeDecodeError:
        return {"allowed": None, "crawl_delay": None, "sitemaps": [], "issue": "ENCODING_INVALID"}
    allowed, delay = root_access(records, agent)
    here = origin(url)
    maps = {normalize_url(value) for field, value in records if field == "sitemap" and here and origin(value) == here}
    return {"allowed": allowed, "crawl_delay": delay if delay is None else float(delay), "sitemaps": sorted(maps), "issue": None}


def parse_robots(files: DataFrame, agent: str) -> DataFrame:
    """``url``, ``allowed``, ``crawl_delay``, ``sitemaps`` and ``issue`` of robots files (``url``, ``content``)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [{"url": u} | read_robots(u, bytes(c or b""), agent) for u, c in zip(pdf["url"], pdf["content"], strict=True)]
            if rows:
                yield as_frame(rows, ["url", "allowed", "crawl_delay", "sitemaps", "issue"])

    return files.select("url", "content").mapInPandas(run, "url string, allowed boolean, crawl_delay double, sitemaps array<string>, issue string")


class _Refused(Exception):
    """A document that isn't read any further; its text names the issue."""


# Root elements of sitemaps and what their addresses lead to.
_ROOTS = {"urlset": "page", "sitemapindex": "sitemap"}


class _Sitemap:
    """Events of a sitemap as they are parsed: nothing but the addresses is held."""

    def __init__(self) -> None:
        self.kind: str | None = None
        self.links: list[str] = []
        self.text: list[str] | None = None
        self.started = False
        self.parser = expat.ParserCreate()
        self.parser.StartDoctypeDeclHandler = self.declared
        self.parser.StartElementHandler = self.opened
        self.parser.EndElementHandler = self.closed
        self.parser.CharacterDataHandler = lambda data: self.text is not None and self.text.append(data)

    def declared(self, *_) -> None:
        raise _Refused("DTD_FORBIDDEN")

    def opened(self, tag: str, _) -> None:
        local = tag.rpartition(":")[2].lower()
        if not self.started:
            self.started, self.kind = True, _ROOTS.get(local)
        self.text = [] if local == "loc" else None

    def closed(self, tag: str) -> None:
        if self.text and tag.rpartition(":")[2].lower() == "loc" and (link := "".join(self.text).strip()):
            self.links.append(link)
        self.text = None


def sitemap_links(url: str, body: bytes) -> tuple[str | None, list[str], str | None]:
    """Kind (page or sitemap) and the addresses of a sitemap, or an issue; declarations are refused unread."""
    events = _Sitemap()
    try:
        events.parser.Parse(body, True)
    except _Refused as refused:
        return None, [], str(refused)
    except expat.ExpatError:
        return None, [], "XML_INVALID"
    return (events.kind, events.links, None) if events.kind else (None, [], "ROOT_UNSUPPORTED")


def page_links(url: str, html: str) -> tuple[list[str], str | None]:
    """Absolute addresses a page links to, in order, and its canonical address (the last one named)."""
    found = [(tag, urljoin(url, href)) for tag, href, _ in read_page(html).links]
    return [full for tag, full in found if tag == "a"], next((full for tag, full in reversed(found) if tag == "link"), None)


_LINKS = "url string, kind string, link string, canonical boolean, issue string"


def parse_links(pages: DataFrame, tracking: tuple[str, ...] = ()) -> DataFrame:
    """Own-site links of pages and sitemaps (``url``, ``content``): ``kind``, normalized ``link``, ``canonical``, or an ``issue``."""
    dropped = frozenset(t.casefold() for t in tracking)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows: list[tuple] = []
            for url, content in zip(pdf["url"], pdf["content"], strict=True):
                body, site = bytes(content or b""), origin(url)
                own = lambda u, site=site: v if (v := normalize_url(u, dropped)) and origin(v) == site else None
                if body.lstrip().startswith((b"<?xml", b"<urlset", b"<sitemapindex")):
                    kind, links, issue = sitemap_links(url, body)
                    rows += [(url, kind, v, False, None) for u in links if (v := own(u))] + ([(url, None, None, False, issue)] if issue else [])
                    continue
                try:
                    links, canonical = page_links(url, body.decode("utf-8-sig"))
                except UnicodeDecodeError:
                    rows.append((url, None, None, False, "ENCODING_INVALID"))
                    continue
                rows += [(url, "page", v, False, None) for u in links if (v := own(u))]
                if canonical and (v := own(canonical)):
                    rows.append((url, "page", v, True, None))
            if rows:
                yield pd.DataFrame(rows, columns=["url", "kind", "link", "canonical", "issue"], dtype=object)

    return pages.select("url", "content").mapInPandas(run, _LINKS)


def rank_links(links: DataFrame, rules: list[tuple[str, tuple[str, ...], int]], most: int = 100) -> DataFrame:
    """The best ``most`` links of each page by interest, then address; links of pages without interest fall away."""
    scored = links.filter("link is not null and not canonical").select("url", "kind", "link").distinct().withColumn("i", interest(F.col("link"), rules)).select("url", "kind", "link", "i.score", "i.key")
    order = Window.partitionBy("url").orderBy(F.desc("score"), "link")
    return scored.filter("kind = 'sitemap' or score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
