"""Whole reports: headers, sections and batches around the item texts.

Two shapes. A query result is bounded by its limit and becomes one row holding the report. A
whole table becomes one row per batch, written as one text file per task; it is never
gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.times import moment
from feedlens.operators import ordering
from feedlens.operators.sequence import with_position
from feedlens.sinks import items
from feedlens.sinks.settings import RenderSettings

_RULE = "-" * 80


def item_text(entity: str, settings: RenderSettings, as_of: datetime | str) -> Column:
    """The text of one row; needs ``index`` except for JSON."""
    kinds: dict[tuple[str, str], Callable[[], Column]] = {
        ("articles", "markdown"): lambda: items.article_markdown(settings),
        ("articles", "text"): lambda: items.article_text(settings),
        ("articles", "json"): lambda: F.to_json(items.article_object(settings)),
        ("repositories", "markdown"): lambda: items.repo_markdown(settings, as_of),
        ("repositories", "text"): lambda: items.repo_text(settings, as_of),
        ("repositories", "json"): lambda: F.to_json(items.repo_object(settings)),
    }
    output = settings.output if settings.output in ("markdown", "text") else "json"
    return kinds[entity, output]()


def render_items(df: DataFrame, entity: str, settings: RenderSettings, as_of: datetime | str) -> DataFrame:
    """(index, text) of a bounded result in rendering order."""
    order = ordering.order_for_render(entity, settings.sort_by, settings.sort_order)
    numbered = ordering.numbered(df, order, "index")
    return numbered.select("index", item_text(entity, settings, as_of).alias("text"))


def _stamp(as_of: datetime | str) -> str:
    return moment(as_of).strftime("%Y-%m-%d %H:%M:%S")


def _separator(settings: RenderSettings) -> str:
    if settings.output == "markdown":
        return "\n---\n\n"
    if settings.output == "text":
        return "" if settings.compact else _RULE + "\n\n"
    return ","


def _joined(rendered: DataFrame, settings: RenderSettings) -> DataFrame:
    """(n, body) of a bounded result: its item texts in order."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "text")))
    body = F.array_join(F.transform(ordered, lambda e: e["text"]), _separator(settings))
    return rendered.agg(F.count(F.lit(1)).alias("n"), body.alias("body"))


def _text_header(title: str, count: Column, as_of: datetime | str, settings: RenderSettings) -> Column:
    line = F.concat(F.lit(f"{title} ("), count.cast("string"), F.lit(" items)\n"))
    if settings.compact:
        return F.concat(line, F.lit(f"Generated: {_stamp(as_of)}\n\n"))
    rule = "=" * (len(title) + 20)
    return F.concat(F.lit(f"{rule}\n  "), line, F.lit(f"  Generated: {_stamp(as_of)}\n{rule}\n\n"))


def _section(title: str, settings: RenderSettings) -> str:
    if settings.output == "markdown":
        return f"## {title.title()}\n\n"
    if settings.compact:
        return f"\n{title}:\n"
    rule = "-" * (len(title) + 4)
    return f"\n{rule}\n  {title}\n{rule}\n\n"


def _header(entity: str, count: Column, as_of: datetime | str, settings: RenderSettings) -> Column:
    if settings.output == "markdown":
        name = entity.title()
        return F.concat(
            F.lit(f"# {name}\n\n*Generated on {_stamp(as_of)}*\n\n**Total {name}:** "),
            count.cast("string"),
            F.lit("\n\n---\n\n"),
        )
    return _text_header(entity.upper(), count, as_of, settings)


def _nothing(entity: str, settings: RenderSettings) -> str:
    if settings.output == "markdown":
        return f"# No {entity.title()} Found\n\nNo {entity} to display."
    return f"No {entity} found.\n" if settings.output == "text" else "[]"


def render_report(df: DataFrame, entity: str, settings: RenderSettings, as_of: datetime | str) -> DataFrame:
    """One row ``report`` for a bounded result of one entity."""
    joined = _joined(render_items(df, entity, settings, as_of), settings)
    n, body = F.col("n"), F.col("body")
    if settings.output in ("markdown", "text"):
        full = F.concat(_header(entity, n, as_of, settings), body)
    else:
        full = F.concat(F.lit("["), body, F.lit("]"))
    return joined.select(F.when(n == 0, _nothing(entity, settings)).otherwise(full).alias("report"))


def render_mixed(
    articles: DataFrame, repositories: DataFrame, settings: RenderSettings, as_of: datetime | str
) -> DataFrame:
    """One row ``report`` for bounded articles and repositories together."""
    both = {
        name: _joined(render_items(df, name, settings, as_of), settings).select(F.struct("n", "body").alias("s")).scalar()
        for name, df in (("articles", articles), ("repositories", repositories))
    }
    row = articles.sparkSession.range(1).select(both["articles"].alias("a"), both["repositories"].alias("r"))
    a, r = F.col("a.n"), F.col("r.n")
    count = {"a": a.cast("string"), "r": r.cast("string"), "all": (a + r).cast("string")}
    if settings.output == "markdown":
        report = F.concat(
            F.lit(f"# Development Context Report\n\n*Generated on {_stamp(as_of)}*\n\n## Summary\n\n- **Articles:** "),
            count["a"], F.lit("\n- **Repositories:** "), count["r"], F.lit("\n- **Total Items:** "), count["all"],
            F.lit("\n\n## Table of Contents\n\n"),
            F.when(a > 0, "- [Articles](#articles)\n").otherwise(""),
            F.when(r > 0, "- [Repositories](#repositories)\n").otherwise(""),
            F.lit("\n"),
            F.when(a > 0, F.concat(F.lit(_section("ARTICLES", settings)), "a.body")).otherwise(""),
            F.when((a > 0) & (r > 0), "\n\n").otherwise(""),
            F.when(r > 0, F.concat(F.lit(_section("REPOSITORIES", settings)), "r.body")).otherwise(""),
        )
    elif settings.output == "text":
        report = F.concat(
            _text_header("DEVELOPMENT CONTEXT REPORT", a + r, as_of, settings),
            F.lit("SUMMARY:\n  Articles:     "), count["a"], F.lit("\n  Repositories: "), count["r"],
            F.lit("\n  Total Items:  "), count["all"], F.lit(f"\n  Generated:    {_stamp(as_of)}\n\n"),
            F.when(a > 0, F.concat(F.lit(_section("ARTICLES", settings)), "a.body")).otherwise(""),
            F.when((a > 0) & (r > 0), "\n").otherwise(""),
            F.when(r > 0, F.concat(F.lit(_section("REPOSITORIES", settings)), "r.body")).otherwise(""),
        )
    else:
        report = F.concat(
            F.lit('{"articles":['), F.coalesce("a.body", F.lit("")), F.lit('],"repositories":['),
            F.coalesce("r.body", F.lit("")), F.lit('],"summary":{"timestamp":"' + _stamp(as_of) + '","total_articles":'),
            count["a"], F.lit(',"total_repositories":'), count["r"], F.lit("}}"),
        )
    return row.select(report.alias("report"))


def render_batches(df: DataFrame, entity: str, settings: RenderSettings, as_of: datetime | str) -> DataFrame:
    """(batch, items, body): a whole table in rendering order, cut into batches.

    A batch holds at most 500 texts, so its array is bounded; each batch starts its numbers
    at one, as a report of its own.
    """
    order = ordering.order_for_render(entity, settings.sort_by, settings.sort_order)
    placed = with_position(df, order, "_position")
    size = settings.batch_size
    cut = placed.withColumns(
        {
            "batch": F.floor((F.col("_position") - 1) / size),
            "index": (F.col("_position") - 1) % size + 1,
        }
    )
    texts = cut.select("batch", "index", item_text(entity, settings, as_of).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("index", "text")))
    joined = texts.groupBy("batch").agg(
        F.count(F.lit(1)).alias("items"),
        F.array_join(F.transform(ordered, lambda e: e["text"]), _separator(settings)).alias("_body"),
    )
    if settings.output in ("markdown", "text"):
        body = F.concat(_header(entity, F.col("items"), as_of, settings), "_body")
    else:
        body = F.col("_body")
    return joined.select("batch", "items", body.alias("body"))


def batch_joiner(settings: RenderSettings) -> str:
    """What stands between two batches of one combined output."""
    if settings.output == "markdown":
        return "\n\n---\n\n"
    return f"\n{_RULE}\n" if settings.output == "text" else ","


def combined_batches(batches: DataFrame, settings: RenderSettings) -> DataFrame:
    """(batch, body): bodies that make one valid output when they follow each other in batch order.

    Joiners stand before all batches but the first; JSON gets its brackets at both ends. No
    batch leaves its row.
    """
    json = settings.output not in ("markdown", "text")
    first, last = batches.agg(F.min("batch").alias("a"), F.max("batch").alias("b")).first() or (None, None)
    before = F.when(F.col("batch") == first, "[" if json else "").otherwise(batch_joiner(settings))
    after = F.when(F.col("batch") == last, "]").otherwise("") if json else F.lit("")
    return batches.select("batch", F.concat(before, "body", after).alias("body"))


def write_batches(batches: DataFrame, path: str, settings: RenderSettings) -> None:
    """Text files in batch order, one per range of batches, that read one after the other are the whole output."""
    whole = combined_batches(batches, settings)
    whole.repartitionByRange("batch").sortWithinPartitions("batch").select("body").write.text(path)


# --- registry ---------------------------------------------------------------------------

Renderer = Callable[[DataFrame, str, RenderSettings, "datetime | str"], DataFrame]

_RENDERERS: dict[str, Renderer] = {"json": render_report, "markdown": render_report, "text": render_report}


def register_renderer(output: str, renderer: Renderer) -> None:
    """Adds or replaces the renderer of an output format."""
    _RENDERERS[output] = renderer


def renderer_for(output: str) -> Renderer:
    """An unknown format is rendered as JSON."""
    return _RENDERERS.get(output, _RENDERERS["json"])
