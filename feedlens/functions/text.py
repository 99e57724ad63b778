"""String expressions: byte limits, whitespace, markup and entities.

Lengths are in bytes (``octet_length``) unless a name says ``chars``. Patterns that use
``.`` carry ``(?d)`` so that only ``\\n`` ends a line, and whitespace classes are spelled
out because Java's ``\\s`` also holds the vertical tab.
"""

from __future__ import annotations

import html
from collections.abc import Iterable
from functools import cache
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens import vocab

ASCII_SPACE = r"[\t\n\f\r ]+"
# Java tests the property much faster than a class of its characters
UNICODE_SPACE = r"\p{IsWhite_Space}"
# the same characters as a trim set
SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Absent text is the empty string, never NULL."""
    return F.coalesce(col(c), F.lit(""))


def byte_len(c: Column | str) -> Column:
    return F.octet_length(col(c)).cast("long")


def ascii_lower(c: Column | str) -> Column:
    """Folds A-Z only; ``lower`` would also fold accented letters."""
    return F.translate(col(c), UPPER, LOWER)


def collapse_space(c: Column | str) -> Column:
    return F.regexp_replace(col(c), ASCII_SPACE, " ")


def trim_space(c: Column | str) -> Column:
    """Trims every Unicode space, not only U+0020."""
    return F.btrim(col(c), F.lit(SPACE_CHARS))


def is_blank(c: Column | str) -> Column:
    return trim_space(c) == ""


def words(c: Column | str) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(col(c), f"{UNICODE_SPACE}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """How many ``words`` there are, without making them."""
    return F.regexp_count(col(c), F.lit(r"\P{IsWhite_Space}+"))


def cut_bytes(c: Column | str, n: int) -> Column:
    """The longest prefix of at most ``n`` bytes that does not split a character."""
    raw = F.substring(F.encode(col(c), "UTF-8"), 1, n).cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.regexp_replace(F.make_valid_utf8(raw), "�$", "")
    )


def shorten(c: Column | str, n: int) -> Column:
    """Text over ``n`` bytes is cut at the last space inside the limit and gets "..."."""
    value = col(c)
    if n <= 0:
        return F.when(byte_len(value) == 0, value).otherwise(F.lit(""))
    head = cut_bytes(value, n)
    whole_words = F.regexp_extract(head, r"(?s)^(.+) ", 1)
    cut = F.when(whole_words != "", whole_words).otherwise(head)
    return F.when(byte_len(value) <= n, value).otherwise(F.concat(cut, F.lit("...")))


def strip_tags(c: Column | str, replacement: str = " ") -> Column:
    return F.regexp_replace(col(c), "<[^>]*>", replacement)


def replace_all(c: Column | str, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements applied one after the other."""
    out = col(c)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def basic_entities(c: Column | str) -> Column:
    return replace_all(c, vocab.BASIC_ENTITIES)


def unescape(c: Column | str) -> Column:
    """Decodes HTML entities as HTML 5 does: names with ";", the old names also without, and numbers.

    The text is cut at "&" and the start of each piece is read as a reference. Unknown names stay.
    """

    def pieces(value: Column) -> Column:
        decoded = F.transform(F.split(value, "&"), lambda p, i: F.when(i == 0, p).otherwise(_referenced(p)))
        return F.when(F.contains(value, F.lit("&")), F.array_join(decoded, "")).otherwise(value)

    return _once(col(c), pieces)


_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_LOST = "\ufffd"


@cache
def _entity_tables() -> tuple[str, str, str]:
    """Names with their characters, a pattern of the names that need no ";", characters of the numbers below 160.

    The tables are single strings: as maps or arrays they would make each task thousands of objects larger.
    """
    old = sorted((n for n in entities.html5 if not n.endswith(";")), key=len, reverse=True)
    # a search reads from the front, so the old names, which are most in use, come first
    names = sorted(entities.html5, key=lambda n: (n.rstrip(";") not in old, n))
    pairs = "\x1f" + "".join(f"{n}\x1e{entities.html5[n]}\x1f" for n in names)
    return pairs, f"^({'|'.join(old)})", "".join(html.unescape(f"&#{n};") or "\x1f" for n in range(160))


def _referenced(piece: Column) -> Column:
    """What "&" and the text behind it, up to the next "&", stand for."""

    def replaced(name: Column) -> Column:
        character = F.when(name == "", "&").when(F.startswith(name, F.lit("#")), _numbered(name)).otherwise(_named(name))
        return F.concat(character, F.substring(piece, F.char_length(name) + 1, F.char_length(piece)))

    return _once(F.regexp_extract(piece, _REFERENCE, 1), replaced)


def _known(name: Column) -> Column:
    """The characters of a name, NULL for one that is none."""
    pairs = F.lit(_entity_tables()[0])
    place = F.position(F.concat(F.lit("\x1f"), name, F.lit("\x1e")), pairs)

    def behind(at: Column) -> Column:
        value = F.substring(pairs, at + F.char_length(name) + 2, F.lit(8))
        return F.when(at > 0, F.substring_index(value, "\x1f", 1))

    return _once(place, behind)


def _named(name: Column) -> Column:
    def by_start(start: Column) -> Column:
        rest = F.substring(name, F.char_length(start) + 1, F.char_length(name))
        return F.when(start == "", F.concat(F.lit("&"), name)).otherwise(F.concat(_known(start), rest))

    return F.coalesce(_known(name), _once(F.regexp_extract(name, _entity_tables()[1], 1), by_start))


def _numbered(name: Column) -> Column:
    sixteen = F.regexp_extract(name, "^#[xX]0*([0-9a-fA-F]*)", 1)
    ten = F.regexp_extract(name, "^#0*([0-9]*)", 1)
    code = F.when(
        name.rlike("^#[xX]"),
        F.when(F.char_length(sixteen) <= 6, F.conv(F.concat(F.lit("0"), sixteen), 16, 10).cast("long")),
    ).when(F.char_length(ten) <= 7, F.concat(F.lit("0"), ten).cast("long"))

    def character(n: Column) -> Column:
        low = F.replace(F.substring(F.lit(_entity_tables()[2]), n.cast("int") + 1, F.lit(1)), F.lit("\x1f"), F.lit(""))
        none = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return (
            F.when(n.isNull() | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), _LOST)
            .when(n < 160, low)
            .when(none, "")
            .when(n == 0xFEFF, "\ufeff")  # the decoder would take it as a byte order mark
            .otherwise(wide)
        )

    return _once(code, character)


def markup_to_text(c: Column | str) -> Column:
    """Tags become spaces, space runs become one, ends are trimmed."""
    return trim_space(collapse_space(strip_tags(c)))


def page_text(c: Column | str) -> Column:
    """``markup_to_text`` with the six common entities decoded."""
    return trim_space(collapse_space(basic_entities(strip_tags(c))))


def drop_scripts(c: Column | str, dotall: bool = False) -> Column:
    """Removes script and style elements; by default only lower-case, one-line ones."""
    flags = "(?is)" if dotall else "(?d)"
    out = F.regexp_replace(col(c), flags + r"<script[^>]*>.*?</script>", "")
    return F.regexp_replace(out, flags + r"<style[^>]*>.*?</style>", "")


def valid_utf8(c: Column | str) -> Column:
    """Drops invalid byte sequences."""

    def valid(value: Column) -> Column:
        return F.when(F.is_valid_utf8(value), value).otherwise(
            F.replace(F.make_valid_utf8(value), F.lit("\ufffd"), F.lit(""))
        )

    return _once(col(c), valid)


def tidy_text(c: Column | str) -> Column:
    """Entities decoded, invalid bytes dropped, whitespace normalised."""
    return trim_space(collapse_space(valid_utf8(unescape(c))))


def tidy_title(c: Column | str, limit: int = 500) -> Column:
    """Titles decode entities before tags are stripped."""
    return trim_space(_once(collapse_space(strip_tags(drop_scripts(unescape(c)))), lambda t: shorten(t, limit)))


def tidy_content(c: Column | str, limit: int | None = 50000, dotall: bool = False) -> Column:
    """Content strips tags before entities are decoded; control characters are dropped. Without a
    ``limit`` the whole text is kept."""
    stripped = unescape(strip_tags(drop_scripts(c, dotall)))
    printable = F.regexp_replace(stripped, r"[\p{Cc}&&[^\t\n\r]]", "")
    whole = collapse_space(printable)
    return trim_space(whole if limit is None else _once(whole, lambda t: shorten(t, limit)))


def plain_text(c: Column | str) -> Column:
    """Summary cleaning: entities first, then tags without a space in their place."""
    return trim_space(collapse_space(F.regexp_replace(unescape(c), r"<[^>]*>", "")))


def contains_any(c: Column | str, needles: Iterable[str]) -> Column:
    """True when one of the literals occurs in the text."""
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(col(c), F.lit(needle))
    return out


def first_sentences(c: Column | str, limit: int) -> Column:
    """Leading sentences that fit into ``limit`` bytes, joined by ". " and closed by "."."""
    value = col(c)
    sentences = F.filter(
        F.transform(F.split(value, "[.!?]"), lambda s: trim_space(s)), lambda s: s != ""
    )
    state = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(acc: Column, sentence: Column) -> Column:
        full = acc["full"] | (byte_len(acc["out"]) + byte_len(sentence) + 2 > limit)
        joined = F.when(acc["out"] == "", sentence).otherwise(F.concat(acc["out"], F.lit(". "), sentence))
        return F.struct(F.when(full, acc["out"]).otherwise(joined).alias("out"), full.alias("full"))

    picked = F.aggregate(sentences, state, step)["out"]
    return F.when(value == "", "").when(picked == "", shorten(value, limit)).otherwise(F.concat(picked, F.lit(".")))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_paragraph(c: Column | str) -> Column:
    """The first paragraph that still has 31 to 500 bytes once cleaned, else a 200-byte start.

    Tags go paragraph by paragraph, then the joined paragraphs are decoded once and taken apart
    again. No paragraph holds the separator.
    """
    value = col(c)
    apart = F.lit("\x1f")
    paragraphs = F.transform(F.split(value, "\n\n"), lambda p: trim_space(p))
    bare = F.transform(paragraphs, lambda p: F.replace(strip_tags(drop_scripts(p)), apart, F.lit("")))
    decoded = F.transform(F.split(unescape(F.array_join(bare, "\x1f")), "\x1f"), lambda p: _light_clean(p))
    both = F.arrays_zip(paragraphs.alias("raw"), decoded.alias("clean"))
    fits = F.filter(
        both, lambda e: (byte_len(e["raw"]) > 50) & (byte_len(e["clean"]) > 30) & (byte_len(e["clean"]) <= 500)
    )
    head = _once(F.get(decoded, F.lit(0)), lambda h: F.when(h != "", shorten(h, 200)))
    return F.coalesce(F.get(fits, F.lit(0))["clean"], head, shorten(value, 200))


def _light_clean(c: Column) -> Column:
    """Decoded text without control characters and with single spaces."""
    return trim_space(collapse_space(F.regexp_replace(c, r"[\p{Cc}&&[^\t\n\r]]", "")))


def wrap(c: Column | str, width: int, prefix: str) -> Column:
    """Greedy word wrap at a byte width; continuation lines start with ``prefix``."""
    if width <= 0:
        return col(c)
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, word: Column) -> Column:
        breaks = (acc["line"] != "") & (byte_len(acc["line"]) + 1 + byte_len(word) > width)
        return F.struct(
            F.when(breaks, F.concat(acc["done"], acc["line"], F.lit("\n" + prefix)))
            .otherwise(acc["done"])
            .alias("done"),
            F.when(breaks | (acc["line"] == ""), word)
            .otherwise(F.concat(acc["line"], F.lit(" "), word))
            .alias("line"),
        )

    return F.aggregate(words(c), start, step, lambda acc: F.concat(acc["done"], acc["line"]))


def display_text(c: Column | str) -> Column:
    """Angle brackets become entities, whitespace is normalised."""
    return F.concat_ws(" ", words(replace_all(c, [("<", "&lt;"), (">", "&gt;")])))


def escape_markdown(c: Column | str) -> Column:
    escaped = replace_all(c, vocab.HTML_ESCAPES)
    return replace_all(escaped, [(mark, "\\" + mark) for mark in vocab.MARKDOWN_ESCAPES])
