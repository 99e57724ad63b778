"""RSS and Atom payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.arrays import pin
from feedlens.functions.identity import short_id
from feedlens.functions.text import markup_to_text, shorten, text, trim_space, unescape
from feedlens.functions.times import FEED_LAYOUTS, parse_timestamp
from feedlens.sources.common import config_map, config_tags, no_strings, raw_article

RSS_SCHEMA = """channel struct<item: array<struct<
  title: string, description: string, link: string, guid: string,
  pubDate: string, author: string, category: string>>>"""

ATOM_SCHEMA = """entry array<struct<
  title: string, content: struct<_VALUE: string, _type: string>, summary: string,
  link: array<struct<_href: string, _rel: string>>, id: string, published: string, updated: string,
  author: struct<name: string, email: string>, category: array<struct<_term: string>>>>"""

# attributes on plain elements must not hide their text, and whitespace is kept for trimming
_XML = {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE"}


def _body_of_kind(root: str) -> Column:
    """The body if its root element is ``root``; other feeds are left to their own parser."""
    return F.when(F.col("body").rlike(rf"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<{root}[\s>]"), F.col("body"))


def parse_rss(payloads: DataFrame) -> DataFrame:
    """One raw article per channel item."""
    # the body stays behind once its items are parsed; pinned, they are not parsed again for an emptiness filter
    items = pin(payloads, _feed=F.from_xml(_body_of_kind("rss"), RSS_SCHEMA, _XML)).drop("body")
    items = items.select("*", F.posexplode("_feed.channel.item").alias("position", "item")).drop("_feed")
    link, title = text("item.link"), text("item.title")
    category = text("item.category")
    return raw_article(
        items,
        "rss",
        id=F.when(text("item.guid") != "", F.col("item.guid")).otherwise(short_id(F.concat(link, title))),
        title=unescape(trim_space(title)),
        content=unescape(markup_to_text(text("item.description"))),
        summary=unescape(shorten(markup_to_text(text("item.description")), 200)),
        author=unescape(trim_space(text("item.author"))),
        url=trim_space(link),
        published_at=parse_timestamp("item.pubDate", FEED_LAYOUTS),
        tags=F.concat(F.when(category != "", F.array(trim_space(category))).otherwise(no_strings()), config_tags()),
        metadata=config_map(),
    )


def parse_atom(payloads: DataFrame) -> DataFrame:
    """One raw article per feed entry."""
    items = pin(payloads, _feed=F.from_xml(_body_of_kind("feed"), ATOM_SCHEMA, _XML)).drop("body")
    items = items.select("*", F.posexplode("_feed.entry").alias("position", "item")).drop("_feed")
    links = F.filter("item.link", lambda link: F.coalesce(link["_rel"], F.lit("")).isin("", "alternate"))
    terms = F.filter(
        F.transform("item.category", lambda c: c["_term"]), lambda t: F.coalesce(t, F.lit("")) != ""
    )
    when = F.when(text("item.published") != "", F.col("item.published")).otherwise(F.col("item.updated"))
    return raw_article(
        items,
        "rss",
        id=F.col("item.id"),
        title=unescape(trim_space(text("item.title"))),
        content=unescape(markup_to_text(text("item.content._VALUE"))),
        summary=unescape(shorten(markup_to_text(text("item.summary")), 200)),
        author=unescape(trim_space(text("item.author.name"))),
        url=F.get(links, F.lit(0))["_href"],
        published_at=parse_timestamp(when, FEED_LAYOUTS),
        tags=F.concat(F.coalesce(terms, no_strings()), config_tags()),
        metadata=config_map(),
    )


def parse_feed(payloads: DataFrame) -> DataFrame:
    """RSS and Atom payloads side by side."""
    return parse_rss(payloads).unionByName(parse_atom(payloads))


def unreadable_feeds(payloads: DataFrame) -> DataFrame:
    """(source_url, error) of payloads that hold neither RSS items nor Atom entries."""
    rss = F.size(F.coalesce(F.from_xml(_body_of_kind("rss"), RSS_SCHEMA, _XML)["channel"]["item"], F.array()))
    atom = F.size(F.coalesce(F.from_xml(_body_of_kind("feed"), ATOM_SCHEMA, _XML)["entry"], F.array()))
    empty = F.coalesce(rss, F.lit(0)) + F.coalesce(atom, F.lit(0)) == 0
    return payloads.where(empty).select("source_url", F.lit("unable to parse as RSS or Atom feed").alias("error"))
