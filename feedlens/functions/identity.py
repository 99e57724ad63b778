"""Identifiers and de-duplication hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions.text import col, trim_space


def short_id(c: Column | str) -> Column:
    """First eight bytes of SHA-256 as 16 hex digits."""
    return F.substring(F.sha2(col(c), 256), 1, 16)


def article_id(url: Column | str = "url", title: Column | str = "title") -> Column:
    key = F.concat(col(url), F.lit("|"), col(title))
    return F.when(key == "|", "").otherwise(F.md5(key))


def article_hash(title: Column | str = "title", url: Column | str = "url", trimmed: bool = False) -> Column:
    title, url = col(title), col(url)
    if trimmed:
        title, url = trim_space(title), trim_space(url)
    return F.md5(F.concat(F.lower(title), F.lit("|"), url))


def repo_id(full_name: Column | str = "full_name") -> Column:
    name = col(full_name)
    digest = F.md5(F.lower(trim_space(name)))
    return F.when(name == "", "").otherwise(F.concat(F.lit("repo_"), F.substring(digest, 1, 11)))


def repo_hash(full_name: Column | str = "full_name", url: Column | str = "url") -> Column:
    return F.md5(F.concat(F.lower(col(full_name)), F.lit("|"), col(url)))


def query_fingerprint(query_type: Column | str, params: Column | str, time_range: Column | str) -> Column:
    """MD5 of ``type|k=v&...|range`` with the parameters in key order."""
    pairs = F.transform(
        F.array_sort(F.map_entries(col(params))),
        lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("&")),
    )
    return F.md5(
        F.concat(col(query_type), F.lit("|"), F.array_join(pairs, ""), F.lit("|"), col(time_range))
    )
