"""URL expressions: parts, canonical form and reference resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens import vocab
from feedlens.functions.text import col, replace_all, trim_space

# scheme, authority with slashes, authority, path, query with "?", query, fragment
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(?:#(.*))?$"

# a path that keeps its spelling
_CLEAN_PATH = r"^(?:[A-Za-z0-9$&+,/:;=@\-_.~!'()*\[\]]|%[0-9A-Fa-f]{2})*$"

# characters the form encoder escapes although a path may hold them
_PATH_SAFE = [
    ("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"),
    ("%2C", ","), ("%2F", "/"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"),
]


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, _PARTS, index)


def scheme(c: Column | str) -> Column:
    return F.lower(_part(col(c), 1))


def is_parseable(c: Column | str) -> Column:
    """No control characters, no space in the host, no broken escape in the path."""
    url = col(c)
    return ~(
        url.rlike(r"[\x00-\x1f\x7f]")
        | url.startswith(":")
        | _part(url, 3).rlike(r"[ <>\"]|:[^0-9\]][^\]]*$")
        | _part(url, 4).rlike(r"%(?![0-9A-Fa-f]{2})")
    )


def is_http(c: Column | str) -> Column:
    return is_parseable(c) & scheme(c).isin("http", "https")


def host(c: Column | str) -> Column:
    """Host with port, without user info."""
    return F.regexp_replace(_part(col(c), 3), "^.*@", "")


def encode_path(c: Column | str) -> Column:
    """Percent-encodes a path that holds spaces, accented letters or other unsafe bytes."""
    path = col(c)
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    encoded = replace_all(F.url_encode(decoded), _PATH_SAFE)
    return F.when(path.rlike(_CLEAN_PATH), path).otherwise(F.coalesce(encoded, path))


def _form_encode(c: Column) -> Column:
    return replace_all(F.url_encode(c), [("*", "%2A"), ("%7E", "~")])


def _clean_query(query: Column, drop: list[str]) -> Column:
    """Parameters in key order without the dropped keys; broken pairs disappear."""
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    parsed = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
            i.alias("i"),
            F.try_url_decode(
                F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.char_length(p))).otherwise("")
            ).alias("v"),
        ),
    )
    kept = F.filter(parsed, lambda e: e["k"].isNotNull() & e["v"].isNotNull() & ~e["k"].isin(drop))
    return F.array_join(
        F.transform(F.array_sort(kept), lambda e: F.concat(_form_encode(e["k"]), F.lit("="), _form_encode(e["v"]))),
        "&",
    )


def normalize_url(c: Column | str, drop_tracking: bool = True) -> Column:
    """Lower-case scheme and host, parameters sorted, tracking parameters removed.

    Text that is not a URL comes back unchanged.
    """
    raw = col(c)
    url = trim_space(raw)
    sch, authority, path = scheme(url), _part(url, 2), _part(url, 4)
    had_query, query, fragment = _part(url, 5), _part(url, 6), _part(url, 7)
    if drop_tracking:
        cleaned = _clean_query(query, vocab.TRACKING_PARAMS)
    else:
        cleaned = query
    user = F.regexp_extract(authority, "^//(.*@)?", 1)
    out = F.concat(
        F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), user, F.lower(host(url)))).otherwise(""),
        encode_path(path),
        F.when((cleaned != "") | (had_query == "?"), F.concat(F.lit("?"), cleaned)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    return F.when(is_parseable(url), out).otherwise(raw)


#: Schemes whose references have paths.
_WITH_PATHS = ["", "file", "ftp", "http", "https"]


def fold_segments(path: Column, base_path: Column) -> Column:
    """A path below a base path without its dot segments; each ".." takes the segment before it."""
    parts = F.split(base_path, "/")
    folder = F.when(F.element_at(parts, -1) != "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    below = F.concat(folder, F.split(path, "/"))
    n = F.size(below)
    below = F.filter(below, lambda s, i: (s != "") | (i == 0) | (i == n - 1))
    kept = F.when(path.startswith("/"), F.split(path, "/")).otherwise(below)
    shut = F.when(F.element_at(kept, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)

    def step(done: Column, segment: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment == "..", shorter).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    folded = F.array_join(F.aggregate(shut, F.array().cast("array<string>"), step), "/")
    return F.when(folded == "", F.lit("/")).otherwise(folded)


def _folded_reference(link: Column, page: Column, tail: Column) -> Column:
    """A link whose path has dot segments. With a host of its own, or another scheme, it stays as it is."""
    sch, own = F.lower(_part(page, 1)), F.lower(_part(link, 1))
    authority, host_of_link = _part(page, 2), _part(link, 2)
    path = fold_segments(_part(link, 4), _part(page, 4))
    start = F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise("")
    rooted = F.when((authority != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return (
        F.when(((own != "") & (own != sch)) | ~sch.isin(_WITH_PATHS), link)
        .when(_part(link, 3) != "", F.concat(start, host_of_link, _part(link, 4), tail))
        .otherwise(F.concat(start, authority, rooted, tail))
    )


def resolve_url(ref: Column | str, base: Column | str) -> Column:
    """A link resolved against its page, all in column expressions."""
    link, page = col(ref), col(base)
    sch, authority = _part(page, 1), _part(page, 2)
    origin = F.concat(F.when(sch != "", F.concat(F.lower(sch), F.lit(":"))).otherwise(""), authority)
    folder = F.regexp_extract(_part(page, 4), r"(?s)^(.*/)", 1)
    page_query = _part(page, 5)
    tail = F.concat(
        F.when(_part(link, 6) != "", _part(link, 5)).otherwise(""),
        F.when(_part(link, 7) != "", F.concat(F.lit("#"), _part(link, 7))).otherwise(""),
    )
    path = encode_path(_part(link, 4))
    dotted = _part(link, 4).rlike(r"(^|/)\.\.?(/|$)")
    joined = _folded_reference(link, page, tail)
    return (
        F.when(~is_parseable(link) | ~is_parseable(page), link)
        .when(dotted, joined)
        .when(_part(link, 1) != "", F.concat(F.lower(_part(link, 1)), F.lit(":"), _part(link, 2), path, tail))
        .when(_part(link, 2) != "", F.concat(F.lower(sch), F.lit(":"), _part(link, 2), path, tail))
        .when(path.startswith("/"), F.concat(origin, path, tail))
        .when(path != "", F.concat(origin, F.when(folder == "", "/").otherwise(folder), path, tail))
        .when(_part(link, 5) != "", F.concat(origin, encode_path(_part(page, 4)), tail))
        .otherwise(
            F.concat(origin, encode_path(_part(page, 4)), F.when(page_query == "?", "").otherwise(page_query), tail)
        )
    )
