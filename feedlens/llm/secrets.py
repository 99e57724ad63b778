"""Secrets in texts, and how widely their values are copied over a corpus.

Everything is built from DataFrame functions. Positions come from the pieces between matches:
a match starts after all pieces up to it and all matches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.arrays import pin
from feedlens.session import ensure_checkpoint_dir

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9_-]{32,}"
#: kind, pattern, group of the value, least length of the value. The runs of ACCESS and HEX are
#: maximal, so asking for the length in the pattern finds the same matches as dropping short ones.
BASE = [("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24)]
KINDS = ["assign", "access", "hex", "opaque"]
_MARK = "array<struct<kind:int,i:int,gap:int,n:int,good:boolean,value:bigint>>"
_FOUND = (
    "array<struct<start:int,kind:int,end:int,value:bigint,uses:bigint,documents:bigint,"
    "repositories:bigint,owners:bigint,verdict:string>>"
)
#: code points in a block of a text that is cut
_BLOCK = 512


def _marks(text: Column, kind: str, pattern: str, group: int, least: int, keep=None) -> Column:
    """The matches in order, each with the length of the piece before it and its own; texts without one skip the slower functions."""
    whole, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    matches = F.arrays_zip(pieces.alias("piece"), whole.alias("whole"), values.alias("value"))

    def mark(m: Column, i: Column) -> Column:
        good = F.length(m["value"]) >= least
        if keep is not None:
            good = good & keep(m["value"])
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("i"),
            F.length(m["piece"]).alias("gap"),
            F.length(m["whole"]).alias("n"),
            good.alias("good"),
            F.xxhash64(m["value"]).alias("value"),
        )

    return F.coalesce(F.when(text.rlike(pattern), F.transform(matches, mark)), F.array().cast(_MARK))


def _spans(marks: DataFrame) -> DataFrame:
    """(row, owner, repository, start, kind, end, value): good matches at their places, opaque ones clear of base ones.

    A match ends after all pieces and matches of its kind up to it: a running sum in its text. All
    windows run inside one text, on one shuffle by row.
    """
    so_far = (Window.unboundedPreceding, Window.currentRow)
    of_kind = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(*so_far)
    rising = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(*so_far)
    falling = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(*so_far)
    is_base = F.col("kind") < len(BASE)
    placed = (
        marks.select("row", "owner", "repository", F.explode("marks").alias("mark"))
        .select("row", "owner", "repository", "mark.*")
        .repartition("row")
        .withColumn("end", F.sum(F.col("gap") + F.col("n")).over(of_kind).cast("int"))
        .withColumn("start", F.col("end") - F.col("n"))
        .filter("good")
    )
    sides = placed.withColumns(
        {"before": F.max(F.when(is_base, F.col("end"))).over(rising), "after": F.min(F.when(is_base, F.col("start"))).over(falling)}
    )
    touched = (F.coalesce("before", F.lit(0)) > F.col("start")) | F.coalesce(F.col("after") < F.col("end"), F.lit(False))
    return sides.filter(is_base | ~touched).select("row", "owner", "repository", "start", "kind", "end", "value")


def _looks_random(value: Column) -> Column:
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_cols: tuple[str, ...] = ("source", "lang"),
    example_owners: int = 3,
    example_repositories: int = 6,
) -> DataFrame:
    """(doc_id, text_hash, base, found), one row per input row.

    ``base`` has the spans of the three base kinds: ``start`` and ``end`` (code points, end
    exclusive), ``kind``, and ``value``, a 64-bit hash of the secret, ordered by start and kind.
    ``text_hash`` is the xxhash64 of the text. ``found`` has these and the opaque strings (32 or
    more characters with both cases and digits, outside base spans) with the verdict "live". Each
    has the ``uses`` of its value, the ``documents`` (rows), ``repositories`` and ``owners`` that
    hold it, and a ``verdict``: "example" from ``example_owners`` owners on, or from two owners
    with ``example_repositories`` repositories on; "live" with one owner; else "shared".

    A repository is a combination of ``repository_cols`` of one owner; null owners are one owner. A
    null text is empty; texts without secrets get empty arrays. Repeated rows are scanned and counted
    each. An empty table gives no rows; other columns are ignored. Time grows with the length of a
    text and, by a sort, with the number of its matches.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    repository = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in repository_cols])
    marks = [_marks(F.col("text"), *kind) for kind in BASE] + [_marks(F.col("text"), "opaque", OPAQUE, 0, 32, _looks_random)]
    scanned = (
        docs.select(
            F.col(id_col).alias("doc_id"),
            text.alias("text"),
            F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"),
            repository.alias("repository"),
        )
        .select("doc_id", "owner", "repository", F.xxhash64("text").alias("text_hash"), F.concat(*marks).alias("marks"))
        .withColumn("row", F.monotonically_increasing_id())
        .checkpoint()
    )
    spans = _spans(scanned)
    per_document = spans.groupBy("row", "value", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    per_repository = per_document.groupBy("value", "owner", "repository").agg(
        F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("documents")
    )
    sums = [F.sum("uses").alias("uses"), F.sum("documents").alias("documents")]
    per_owner = per_repository.groupBy("value", "owner").agg(*sums, F.count(F.lit(1)).alias("repositories"))
    spread = per_owner.groupBy("value").agg(*sums, F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    copied = (F.col("owners") >= example_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= example_repositories))
    verdict = F.when(copied, "example").when(F.col("owners") == 1, "live").otherwise("shared")
    judged = spans.join(spread, "value").withColumn("verdict", verdict)
    judged = judged.filter((F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))
    fields = ["start", "kind", "end", "value", "uses", "documents", "repositories", "owners", "verdict"]
    found = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("found"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def named(spans: Column, more: list[str]) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *[s[m].alias(m) for m in more]
            ),
        )

    every = F.coalesce("found", F.array().cast(_FOUND))
    return scanned.join(found, "row", "left").select(
        "doc_id",
        "text_hash",
        named(F.filter(every, lambda s: s["kind"] < len(BASE)), ["value"]).alias("base"),
        named(every, fields[3:]).alias("found"),
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, scan: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with the spans that are no widely copied examples replaced by ``mark``.

    ``scan`` is the result of ``secret_scan`` over the same rows; rows are matched by id and text.
    Overlapping spans are replaced together. Null texts stay null. What stays of a text is read from
    blocks of 512 code points, so a cut costs the length of its piece, wherever it lies.
    """
    spans = F.filter("found", lambda s: s["verdict"] != "example")
    hit = scan.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), spans.alias("spans"))
    hit = hit.filter(F.size("spans") > 0).dropDuplicates(["id", "hash"])
    before = Window.partitionBy("id", "hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cuts = hit.select("id", "hash", F.explode("spans").alias("span")).select("id", "hash", "span.start", "span.end")
    cuts = cuts.withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0)))
    piece = F.when(F.col("start") >= F.col("at"), F.struct("at", "start"))
    marked = cuts.groupBy("id", "hash").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("end").alias("tail"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    packed = packed.withColumns({"own_id": F.col("row")[id_col], "own_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    same = packed["own_id"].eqNullSafe(marked["id"]) & (packed["own_hash"] == marked["hash"])
    blocks = F.when(F.col("tail").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)))
    joined = pin(packed.join(marked, same, "left"), blocks=blocks, length=F.length("text"))

    def between(start: Column, end: Column) -> Column:
        first = F.floor(start / _BLOCK).cast("int")
        last = F.floor((end - 1) / _BLOCK).cast("int")
        part = F.array_join(F.slice("blocks", first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(part, start - first * _BLOCK + 1, end - start)).otherwise("")

    kept = F.transform("pieces", lambda p: between(p["at"], p["start"]))
    cut = F.array_join(F.concat(kept, F.array(between(F.col("tail"), F.col("length")))), mark)
    new = F.when(F.col("tail").isNull(), F.col("text")).otherwise(cut)
    return joined.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
