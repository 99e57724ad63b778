"""Pieces of reference SQL shared by several queries."""

from __future__ import annotations

from feedlens import vocab

STOPS = ", ".join(f"'{w}'" for w in vocab.TERM_STOP_WORDS)
SUMMARY_STOPS = ", ".join(f"'{w}'" for w in vocab.SUMMARY_STOP_WORDS)


def head(expr: str, n: int) -> str:
    """At most ``n`` bytes without splitting a character."""
    tries = ", ".join(f"try(decode(array_slice(encode({expr}), 1, {n - i})))" for i in range(4))
    return f"coalesce({tries})"


def shorten(expr: str, n: int) -> str:
    cut = f"regexp_extract({head(expr, n)}, '(?s)^(.+) ', 1)"
    return (
        f"CASE WHEN strlen({expr}) <= {n} THEN {expr} "
        f"WHEN {cut} <> '' THEN {cut} || '...' ELSE {head(expr, n)} || '...' END"
    )


def stem(t: str) -> str:
    cases = " ".join(
        f"WHEN ends_with({t}, '{s}') AND strlen({t}) > {len(s) + 2} THEN left({t}, length({t}) - {len(s)})"
        for s in vocab.STEM_SUFFIXES
    )
    return f"CASE WHEN strlen({t}) <= 3 THEN {t} {cases} ELSE {t} END"


def tokens(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '[^\\p{{L}}]+'), lambda t: t <> '')"


def tidy(expr: str) -> str:
    """Space runs to one space, ends trimmed."""
    return f"trim(regexp_replace({expr}, '[\\t\\n\\f\\r ]+', ' ', 'g'))"


def strip(expr: str, by: str = " ") -> str:
    return f"regexp_replace({expr}, '<[^>]*>', '{by}', 'g')"


def basic_entities(expr: str) -> str:
    for old, new in vocab.BASIC_ENTITIES:
        expr = f"replace({expr}, '{old}', '{new.replace(chr(39), chr(39) * 2)}')"
    return expr


def page_text(expr: str) -> str:
    return tidy(basic_entities(strip(expr)))


def any_of(expr: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{n}')" for n in needles) + ")"


TERM_CTES = f"""
tok AS (
  SELECT id, 3 AS w, unnest(string_split_regex(lower(title), '[^\\p{{L}}]+')) AS t FROM articles
  UNION ALL SELECT id, 2, unnest(string_split_regex(lower(summary), '[^\\p{{L}}]+')) FROM articles
  UNION ALL SELECT id, 1, unnest(string_split_regex(lower(content), '[^\\p{{L}}]+')) FROM articles
  UNION ALL SELECT id, 4, unnest(string_split_regex(lower(array_to_string(tags, ' ')), '[^\\p{{L}}]+')) FROM articles
),
stems AS (SELECT id, w, {stem("t")} AS term FROM tok WHERE t <> ''),
counts AS (
  SELECT id, term, sum(w) AS c FROM stems WHERE strlen(term) > 2 AND term NOT IN ({STOPS}) GROUP BY 1, 2
),
tf AS (
  SELECT id, term, CAST(c AS BIGINT) AS count, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY id) AS frequency FROM counts
)"""
