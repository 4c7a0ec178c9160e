"""Sources as plug-ins: what a source is, the catalogue of news feeds, and the registry by id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import feeds

#: Countries of the list of codes; more would make a draft's expression unbounded.
MAX_COUNTRIES = 1_000

# The news feeds by id, with name, address, home page and licence.
FEEDS = {
    "rss.bbc-world": ("BBC News — World", "https://feeds.bbci.co.uk/news/world/rss.xml", "https://www.bbc.co.uk/news/world", "BBC RSS terms — headline/link reuse with attribution"),
    "rss.aljazeera": ("Al Jazeera — All News", "https://www.aljazeera.com/xml/rss/all.xml", "https://www.aljazeera.com", "Al Jazeera RSS terms — attribution required"),
    "rss.dw-world": ("Deutsche Welle — World", "https://rss.dw.com/rdf/rss-en-world", "https://www.dw.com", "DW RSS terms — attribution required"),
    "rss.france24": ("France 24 — International", "https://www.france24.com/en/rss", "https://www.france24.com", "France 24 RSS terms — attribution required"),
    "rss.un-news": ("UN News — Global", "https://news.un.org/feed/subscribe/en/news/all/rss.xml", "https://news.un.org", "UN News — free reuse with attribution"),
}


@dataclass(frozen=True)
class Source:
    """A source: ``parse`` turns a frame of responses and the time of fetching into a frame of drafts."""

    id: str
    name: str
    parse: Callable[[DataFrame, Column], DataFrame]
    url: str | None = None
    homepage: str | None = None
    license: str | None = None
    needs: tuple[str, ...] = ()


def news_feed(id: str, name: str, url: str, homepage: str | None = None, license: str | None = None, category: str | None = None, zone: str = "UTC", date_order: str = "DMY") -> Source:
    """A source made from the configuration of a feed; ``category`` is what its items are taken for."""

    def parse(payloads: DataFrame, now: Column) -> DataFrame:
        drafts = feeds.feed_drafts(feeds.feed_items(payloads), id, zone, date_order)
        return drafts.withColumns({"category": F.coalesce("category", F.lit(category).cast("string")), "occurred_at": F.coalesce("occurred_at", now)})

    return Source(id, name, parse, url, homepage, license)


class Registry:
    """Sources by id; one that is added under a known id replaces it."""

    def __init__(self, sources: list[Source] | None = None):
        self._sources: dict[str, Source] = {}
        for source in sources or []:
            self.add(source)

    def add(self, source: Source) -> Registry:
        self._sources[source.id] = source
        return self

    def ids(self) -> list[str]:
        return list(self._sources)

    def get(self, id: str) -> Source:
        """The source of an id; KeyError with the known ids if there is none."""
        if id not in self._sources:
            raise KeyError(f"no source {id}; known are {', '.join(self._sources)}")
        return self._sources[id]

    def available(self, environment: dict[str, str]) -> tuple[list[str], dict[str, str]]:
        """(ids that can run, reasons why the others can't) given the variables that are set."""
        missing = {s.id: [v for v in s.needs if not environment.get(v)] for s in self._sources.values()}
        reasons = {s: f"needs {', '.join(v)}" for s, v in missing.items() if v}
        return [s for s in self._sources if s not in reasons], reasons

    def drafts(self, id: str, payloads: DataFrame, now: Column) -> DataFrame:
        """Good drafts of a source's responses."""
        return feeds.check_drafts(self.get(id).parse(payloads, now))[0]


def registry() -> Registry:
    """All sources that come with the package."""
    with_now = {"gdelt.events", "usgs.quakes", "gdacs.alerts", "nasa.eonet", "nws.alerts"}
    own = [Source(id, id, parser if id in with_now else (lambda df, now, parser=parser: parser(df)), needs=tuple(feeds.NEEDS.get(id, ()))) for id, parser in feeds.PARSERS.items()]
    return Registry(own + [news_feed(id, *row) for id, row in FEEDS.items()])


def two_letter_codes(countries: DataFrame) -> dict[str, str]:
    """Three-letter to two-letter codes from a country list (iso2, iso3)."""
    rows = countries.where("iso2 <> '' and iso3 <> ''").select("iso3", "iso2").distinct().limit(MAX_COUNTRIES + 1).collect()
    if len(rows) > MAX_COUNTRIES:
        raise ValueError(f"more than {MAX_COUNTRIES} countries")
    return {r["iso3"]: r["iso2"] for r in rows}
