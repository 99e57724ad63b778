"""One text per article or repository, in JSON, Markdown or plain text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.scores import activity_level, popularity_tier
from feedlens.functions.text import byte_len, display_text, escape_markdown, shorten, wrap
from feedlens.sinks.settings import RenderSettings


def _limited(c: str, settings: RenderSettings) -> Column:
    return shorten(c, settings.max_summary) if settings.max_summary > 0 else F.col(c)


def _when(condition: Column, *parts: Column | str) -> Column:
    """The parts joined, or nothing."""
    return F.when(condition, _join(*parts)).otherwise(F.lit(""))


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _percent(c: str) -> Column:
    return F.format_string("%.1f%%", F.col(c) * 100)


def _date(c: str, settings: RenderSettings) -> Column:
    return F.date_format(c, settings.date_format)


def _pairs(template: str, key=lambda k: k) -> Column:
    """Metadata lines in key order."""
    before, between, after = template.split("{}")
    entries = F.array_sort(F.map_entries("metadata"))
    return F.array_join(
        F.transform(entries, lambda e: _join(before, key(e["key"]), between, e["value"], after)), ""
    )


def _has_metadata(settings: RenderSettings) -> Column:
    return F.lit(settings.metadata) & (F.size(F.map_keys("metadata")) > 0)


def _pick(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


# --- JSON -------------------------------------------------------------------------------


def article_object(settings: RenderSettings) -> Column:
    """Fields in alphabetical order; content and metadata on request."""
    fields = {
        "id": F.col("id"),
        "publishedAt": _date("published_at", settings),
        "quality": F.col("quality"),
        "relevance": F.col("relevance"),
        "source": F.col("source"),
        "sourceType": F.col("source_type"),
        "summary": _limited("summary", settings),
        "tags": F.col("tags"),
        "title": F.col("title"),
        "url": F.col("url"),
    }
    if settings.content:
        fields["content"] = F.col("content")
    if settings.metadata:
        # to_json leaves NULL fields out, as an empty map should be
        fields["metadata"] = F.when(_has_metadata(settings), F.map_from_entries(F.array_sort(F.map_entries("metadata"))))
    return F.struct(*[fields[name].alias(name) for name in sorted(fields)])


def repo_object(settings: RenderSettings) -> Column:
    fields = {
        "description": _limited("description", settings),
        "forks": F.col("forks"),
        "fullName": F.col("full_name"),
        "id": F.col("id"),
        "language": F.col("language"),
        "name": F.col("name"),
        "stars": F.col("stars"),
        "trendScore": F.col("trend_score"),
        "updatedAt": _date("updated_at", settings),
        "url": F.col("url"),
    }
    return F.struct(*[fields[name].alias(name) for name in sorted(fields)])


# --- Markdown ---------------------------------------------------------------------------


def _heading(title: Column, settings: RenderSettings) -> Column:
    number = F.col("index").cast("string")
    plain = _join("### ", number, ". ", title, "\n\n")
    if not settings.links:
        return plain
    linked = _join("### ", number, ". [", title, "](", F.col("url"), ")\n\n")
    return F.when(F.col("url") != "", linked).otherwise(plain)


def _row(name: str, value: Column) -> Column:
    return _join(f"| **{name}** | ", value, " |\n")


_TABLE = "| Field | Value |\n|-------|-------|\n"


def _url_row(settings: RenderSettings) -> Column:
    shown = F.lit(not settings.links) & (F.col("url") != "")
    return _when(shown, _row("URL", _join("`", F.col("url"), "`")))


def article_markdown(settings: RenderSettings) -> Column:
    content = escape_markdown("content")
    body = _join(content, "\n\n") if settings.compact else _join("```\n", content, "\n```\n\n")
    tags = F.array_join(F.transform("tags", lambda t: _join("`", escape_markdown(t), "`")), ", ")
    return _join(
        _heading(escape_markdown("title"), settings),
        _TABLE,
        _row("Source", escape_markdown("source")),
        _row("Type", F.col("source_type")),
        _row("Published", _date("published_at", settings)),
        _when(F.col("relevance") > 0, _row("Relevance", _percent("relevance"))),
        _when(F.col("quality") > 0, _row("Quality", _percent("quality"))),
        _url_row(settings),
        "\n",
        _when(F.col("summary") != "", "**Summary:**\n", escape_markdown(_limited("summary", settings)), "\n\n"),
        _when(F.size("tags") > 0, "**Tags:** ", tags, "\n\n"),
        _when(F.lit(settings.content) & (F.col("content") != ""), "**Content:**\n\n", body),
        _when(_has_metadata(settings), "**Additional Metadata:**\n\n", _pairs("- **{}:** {}\n", escape_markdown), "\n"),
    )


def repo_markdown(settings: RenderSettings, as_of: datetime | str) -> Column:
    return _join(
        _heading(escape_markdown("full_name"), settings),
        _TABLE,
        _when(F.col("language") != "", _row("Language", escape_markdown("language"))),
        _row("Stars", _join("⭐ ", F.col("stars").cast("string"))),
        _row("Forks", _join("🍴 ", F.col("forks").cast("string"))),
        _row("Trend Score", _percent("trend_score")),
        _row("Updated", _date("updated_at", settings)),
        _url_row(settings),
        "\n",
        _when(
            F.col("description") != "", "**Description:**\n", escape_markdown(_limited("description", settings)), "\n\n"
        ),
        "**Stats:**\n",
        _pick(popularity_tier(), vocab.TIER_LINES),
        "\n",
        _pick(activity_level(as_of), vocab.ACTIVITY_LINES),
        "\n\n",
    )


# --- plain text -------------------------------------------------------------------------

_PAD, _WIDTH = "    ", 76


def _block(title: str, c: Column) -> Column:
    return _join(f"\n{_PAD}{title}:\n{_PAD}", wrap(display_text(c), _WIDTH, _PAD), "\n")


def article_text(settings: RenderSettings) -> Column:
    number = F.col("index").cast("string")
    title = display_text("title")
    if settings.compact:
        rated = (F.col("relevance") > 0) | (F.col("quality") > 0)
        rating = F.format_string(" R:%.1f Q:%.1f", F.col("relevance") * 100, F.col("quality") * 100)
        link = _when(F.col("url") != "", " (", F.col("url"), ")")
        return _join(number, ". ", title, link, " [", F.col("source"), "]", _when(rated, rating), "\n\n")
    return _join(
        "[", number, "] ", title, "\n",
        f"{_PAD}Source:    ", F.col("source"), " (", F.col("source_type"), ")\n",
        f"{_PAD}Published: ", _date("published_at", settings), "\n",
        _when(F.col("url") != "", f"{_PAD}URL:       ", F.col("url"), "\n"),
        _when(F.col("relevance") > 0, f"{_PAD}Relevance: ", _percent("relevance"), "\n"),
        _when(F.col("quality") > 0, f"{_PAD}Quality:   ", _percent("quality"), "\n"),
        _when(F.col("summary") != "", _block("Summary", _limited("summary", settings))),
        _when(F.size("tags") > 0, f"\n{_PAD}Tags: ", F.array_join("tags", ", "), "\n"),
        _when(F.lit(settings.content) & (F.col("content") != ""), _block("Content", F.col("content"))),
        _when(_has_metadata(settings), f"\n{_PAD}Additional Info:\n", _pairs("      {}: {}\n")),
        "\n",
    )


def repo_text(settings: RenderSettings, as_of: datetime | str) -> Column:
    number = F.col("index").cast("string")
    name = display_text("full_name")
    stars, forks = F.col("stars").cast("string"), F.col("forks").cast("string")
    described = F.col("description") != ""
    if settings.compact:
        score = F.format_string(" T:%.1f", F.col("trend_score") * 100)
        return _join(
            number, ". ", name, _when(F.col("language") != "", " (", F.col("language"), ")"),
            " ⭐", stars, " 🍴", forks, _when(F.col("trend_score") > 0, score), "\n",
            _when(described & (byte_len("description") < 100), "   ", display_text("description"), "\n"), "\n",
        )
    status = _join(
        _pick(popularity_tier(), vocab.TIER_LABELS), ", ", _pick(activity_level(as_of), vocab.ACTIVITY_LABELS)
    )
    return _join(
        "[", number, "] ", name, "\n",
        _when(F.col("language") != "", f"{_PAD}Language:    ", F.col("language"), "\n"),
        f"{_PAD}Stars:       ", stars, "\n",
        f"{_PAD}Forks:       ", forks, "\n",
        f"{_PAD}Trend Score: ", _percent("trend_score"), "\n",
        f"{_PAD}Updated:     ", _date("updated_at", settings), "\n",
        _when(F.col("url") != "", f"{_PAD}URL:         ", F.col("url"), "\n"),
        _when(described, _block("Description", _limited("description", settings))),
        f"\n{_PAD}Status: ", status, "\n\n",
    )
