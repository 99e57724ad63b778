"""Scraped web pages: article lists, links and single articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.arrays import pin
from feedlens.functions.identity import short_id
from feedlens.functions.text import col, page_text, shorten, trim_space
from feedlens.functions.times import PAGE_LAYOUTS, parse_timestamp
from feedlens.functions.urls import resolve_url
from feedlens.operators.conform import set_metadata
from feedlens.sources.common import config_map, config_tags, no_strings, raw_article


def _flags(dotall: bool) -> str:
    return "(?s)" if dotall else "(?d)"


def is_article_list_page(html: Column | str, dotall: bool = False) -> Column:
    """Two articles, posts, items or headings of a kind on one line (or anywhere)."""
    out = F.lit(False)
    for pattern in vocab.LIST_PAGE_PATTERNS:
        out = out | col(html).rlike(_flags(dotall) + pattern)
    return out


def first_match(html: Column | str, patterns: list[str], dotall: bool = False) -> Column:
    """The group of the first pattern that matches at all, be it empty; NULL without a match."""
    out = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        full = _flags(dotall) + pattern
        out = F.when(col(html).rlike(full), F.regexp_extract(col(html), full, 1)).otherwise(out)
    return out


def extract_title(html: Column | str) -> Column:
    found = first_match(html, vocab.TITLE_SELECTORS)
    return F.when(found.isNull(), "Untitled").otherwise(page_text(found))


def extract_content(html: Column | str) -> Column:
    return page_text(F.coalesce(first_match(html, vocab.CONTENT_SELECTORS, dotall=True), col(html)))


def extract_author(html: Column | str) -> Column:
    found = first_match(html, vocab.AUTHOR_SELECTORS)
    return F.when(found.isNull(), "Unknown").otherwise(page_text(found))


def extract_published_at(html: Column | str) -> Column:
    """The first selector whose text parses as a time, else NULL."""
    tries = [
        parse_timestamp(page_text(F.regexp_extract(col(html), "(?d)" + p, 1)), PAGE_LAYOUTS)
        for p in vocab.PUBLISHED_SELECTORS
    ]
    return F.coalesce(*tries)


def extract_tags(html: Column | str) -> Column:
    """All matches of all selectors in selector order, comma lists split."""
    found = F.flatten(
        F.array(*[F.regexp_extract_all(col(html), F.lit("(?d)" + p), F.lit(1)) for p in vocab.TAG_SELECTORS])
    )
    parts = F.flatten(F.transform(found, lambda t: F.split(page_text(t), ",")))
    return F.filter(F.transform(parts, lambda t: trim_space(t)), lambda t: t != "")


def article_blocks(html: Column | str, dotall: bool = False) -> Column:
    """Blocks of the first selector that matches anything."""
    out = no_strings()
    for pattern in reversed(vocab.BLOCK_SELECTORS):
        found = F.regexp_extract_all(col(html), F.lit(_flags(dotall) + pattern), F.lit(1))
        out = F.when(F.size(found) > 0, found).otherwise(out)
    return out


def block_title(block: Column | str) -> Column:
    found = first_match(block, vocab.BLOCK_TITLE_SELECTORS)
    return F.when(found.isNull(), "").otherwise(page_text(found))


def block_link(block: Column | str, base: Column | str) -> Column:
    pattern = "(?d)" + vocab.HREF_PATTERN
    href = F.regexp_extract(col(block), pattern, 1)
    return F.when(col(block).rlike(pattern), resolve_url(href, base)).otherwise("")


def explode_article_blocks(pages: DataFrame, dotall: bool = False) -> DataFrame:
    """One raw article per block that has a title or content."""
    blocks = pin(pages, _blocks=article_blocks("body", dotall)).drop("body")
    items = blocks.select("*", F.posexplode_outer("_blocks").alias("position", "block")).drop("_blocks")
    items = items.where(F.col("block").isNotNull())
    parsed = pin(items, _title=block_title("block"), _text=page_text("block"))
    parsed = parsed.withColumn("_link", block_link("block", "source_url"))
    index = F.col("position").cast("string")
    has_link = F.col("_link") != ""
    key = F.when(has_link, F.concat("_link", "_title")).otherwise(F.concat("source_url", "_title", index))
    return raw_article(
        parsed.where((F.col("_title") != "") | (F.col("_text") != "")),
        "html",
        id=short_id(key),
        title=F.col("_title"),
        content=F.col("_text"),
        summary=shorten("_text", 200),
        author=F.lit(""),
        url=F.when(has_link, F.col("_link")).otherwise(F.col("source_url")),
        published_at=F.col("fetched_at"),
        tags=config_tags(),
        metadata=set_metadata(config_map(), "block_index", index),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(payload columns, position, href, url, link_text) of links that have a text.

    ``position`` counts the kept links of a page from 0. The links of one page stay in its row
    while they are numbered.
    """
    pattern = F.lit("(?d)" + vocab.LINK_PATTERN)
    pairs = F.arrays_zip(
        F.regexp_extract_all("body", pattern, F.lit(1)).alias("href"),
        F.transform(F.regexp_extract_all("body", pattern, F.lit(2)), lambda t: page_text(t)).alias("text"),
    )
    kept = F.filter(pairs, lambda p: p["text"] != "")
    found = pin(pages, _links=kept).drop("body")
    rows = found.select("*", F.posexplode_outer("_links").alias("position", "_link")).drop("_links")
    rows = rows.where(F.col("_link").isNotNull())
    return rows.select(
        *[c for c in rows.columns if c not in ("_link", "position")],
        "position",
        F.col("_link.href").alias("href"),
        resolve_url("_link.href", "source_url").alias("url"),
        F.col("_link.text").alias("link_text"),
    ).where(F.col("url") != "")


def explode_links(pages: DataFrame, limit: int | None = vocab.MAX_PAGE_LINKS) -> DataFrame:
    """The first ``limit`` links of each page as raw articles; None takes all."""
    links = page_links(pages)
    if limit is not None:
        links = links.where(F.col("position") < limit)
    text = F.col("link_text")
    return raw_article(
        links,
        "html",
        id=short_id(F.concat("url", "link_text")),
        title=text,
        content=text,
        summary=text,
        author=F.lit("Unknown"),
        url=F.col("url"),
        published_at=F.col("fetched_at"),
        tags=F.concat(F.array(F.lit("link")), config_tags()),
        metadata=config_map(),
    )


def extract_single_article(pages: DataFrame) -> DataFrame:
    """The page as one raw article; without a usable date it is dated when fetched."""
    parsed = pin(pages.withColumn("position", F.lit(0)), _content=extract_content("body"))
    stamp = F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    metadata = set_metadata(config_map(), "page_type", F.lit("single_article"))
    return raw_article(
        parsed,
        "html",
        id=short_id("source_url"),
        title=extract_title("body"),
        content=F.col("_content"),
        summary=shorten("_content", 200),
        author=extract_author("body"),
        url=F.col("source_url"),
        published_at=F.coalesce(extract_published_at("body"), F.col("fetched_at")),
        tags=F.concat(config_tags(), extract_tags("body")),
        metadata=set_metadata(metadata, "extraction_time", stamp),
    )


def parse_pages(pages: DataFrame, dotall: bool = False) -> DataFrame:
    """List pages give their blocks, or their links without any; other pages one article."""
    listing = is_article_list_page("body", dotall)
    has_blocks = F.exists(
        article_blocks("body", dotall), lambda b: (block_title(b) != "") | (page_text(b) != "")
    )
    lists = pages.where(listing)
    return (
        explode_article_blocks(lists.where(has_blocks), dotall)
        .unionByName(explode_links(lists.where(~has_blocks)))
        .unionByName(extract_single_article(pages.where(~listing)))
    )
