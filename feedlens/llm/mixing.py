"""Mixes sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
_BITS, _STEP = 60, 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _draw(row_id: Column, seed: int) -> Column:
    """A number of 60 bits that depends on the id and the seed alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, _BITS // 4), 16, 10).cast("long")


def _second(row_id: Column, text: Column, seed: int) -> Column:
    """A number of 60 bits that tells rows of the same id apart, by text, and equal rows by their place in the table."""
    return F.xxhash64(F.lit(seed), row_id, text, F.monotonically_increasing_id()).bitwiseAND((1 << _BITS) - 1)


def _targets(sources: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Adds ``target`` to (source, source_size): sources in order of cap per weight fill up one by
    one, the others share what is left by weight. One row per source passes one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    caps = sources.withColumns({"w": weight.cast("long"), "cap": F.col("source_size") * epochs})
    filling = Window.orderBy(F.col("cap") / F.col("w"), "w", F.col("source").asc_nulls_last())
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = caps.withColumns({"left": total.cast("double"), "share": share})
    # the water level is that of the first source below its cap, which is the highest of these
    below = F.col("left") / F.col("share") * F.col("w") < F.col("cap")
    level = level.withColumn("level", F.when(below, F.col("left") / F.col("share")))
    first = F.max("level").over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * first, F.col("cap").cast("double")))
    return level.withColumn("target", target).select("source", "source_size", "target")


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    epochs: int = 3,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): the sized rows (id, source, size, u, v), and what each source gives.

    ``plan`` has source, source_size, target, whole (copies of every document) and the cut
    (cut_u, cut_v): a document with (u, v) up to the cut gives one copy more, where u is drawn by id and v
    tells rows of one id apart. The cut is found by sums over 2**12 slices of u, then over the slices of the
    one it falls in, then over the few values left there, and in the same way over v among the rows of
    that u; it lies where the taken words come nearest the target.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        _draw(F.col(id_col), seed).alias("u"),
        _second(F.col(id_col), F.col(text_col).cast("string"), seed).alias("v"),
    ).checkpoint()
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = _targets(sources, weights, epochs)
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole)
    plan = plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).checkpoint()
    start = F.lit(0).cast("long").alias("low"), F.lit(1 << _BITS).alias("high")
    slices = plan.filter("need > 0").select(F.col("source").alias("s"), "need", *start)
    slices, left = _narrowed(rows, slices, "u")
    # the value of u at which the target is reached, and what its rows have to give
    last = left.filter(F.col("upto") >= F.col("need")).groupBy("s").agg(F.min(F.struct("u", "upto", "n", "need")).alias("f"))
    rest = F.col("f.need") - (F.col("f.upto") - F.col("f.n"))
    inner = last.select("s", rest.alias("need"), *start, F.col("f.u").alias("cut_u")).checkpoint()
    near = _by_source(rows, inner.select("s", "cut_u")).filter("u = cut_u").select(F.col("s").alias("source"), "size", "v").checkpoint()
    inner, left = _narrowed(near, inner, "v")
    reached = left.filter(F.col("upto") - F.col("n") / 2 <= F.col("need")).groupBy("s").agg(F.max("v").alias("v"))
    cuts = inner.join(reached.withColumnRenamed("s", "_r"), F.col("s").eqNullSafe(F.col("_r")), "left")
    cuts = cuts.select("s", "cut_u", F.coalesce("v", F.col("low") - 1).alias("cut_v"))
    plan = plan.join(cuts, plan["source"].eqNullSafe(cuts["s"]), "left").drop("s", "need")
    return rows, plan


def _narrowed(rows: DataFrame, slices: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Halves (s, need, low, high, ...) twice by 12 bits of ``key`` to where ``need`` is reached.

    Also given are the values left there with their sizes ``n`` and running sums ``upto``.
    """
    within = (F.col(key) >= F.col("low")) & (F.col(key) < F.col("high"))
    more = [c for c in slices.columns if c not in ("s", "need", "low", "high")]
    for bits in (_BITS - _STEP, _BITS - 2 * _STEP):
        inside = _by_source(rows, slices).filter(within)
        part = F.shiftright(key, bits)
        sums = inside.groupBy("s", "need", *more, part.alias("part")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("part"))
        reached = sums.withColumn("upto", upto).filter(F.col("upto") >= F.col("need"))
        first = reached.groupBy("s").agg(F.min(F.struct("part", "upto", "n", "need", *more)).alias("f"))
        slices = first.select(
            "s",
            (F.col("f.need") - (F.col("f.upto") - F.col("f.n"))).alias("need"),
            F.shiftleft("f.part", bits).alias("low"),
            F.shiftleft(F.col("f.part") + 1, bits).alias("high"),
            *[F.col(f"f.{c}").alias(c) for c in more],
        ).checkpoint()
    left = _by_source(rows, slices).filter(within).groupBy("s", "need", key).agg(F.sum("size").alias("n"))
    return slices, left.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy(key)))


def _by_source(rows: DataFrame, per_source: DataFrame, most: int = 100_000) -> DataFrame:
    """Joins the rows with a table of one row per source; few sources are broadcast, so a hot
    source is not moved, many are joined by a shuffle that Spark splits."""
    few = per_source.count() <= most
    per_source = F.broadcast(per_source) if few else per_source
    key = "s" if "s" in per_source.columns else "source"
    joined = rows.join(per_source.withColumnRenamed(key, "_s"), rows["source"].eqNullSafe(F.col("_s")))
    return joined.withColumnRenamed("_s", "s")


def _copies() -> Column:
    more = (F.col("u") < F.col("cut_u")) | ((F.col("u") == F.col("cut_u")) & (F.col("v") <= F.col("cut_v")))
    return F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per input row.

    Sizes are words (null text: 0). Sources in code-point order, null last, weigh ``weights`` in
    turn and share all words; a target stops at ``epochs`` times its source's size and the excess
    goes to the others by weight. ``taken`` is ``size`` times the copies: whole ones for all, and
    one more up to a seeded cut. Rows that share an id share its draw; the cut may part them by text, and equal
    rows by their place in the table. Null ids are one id.
    A source without words has target 0. An empty table gives no rows; other columns are ignored.
    """
    rows, plan = mix_plan(docs, id_col, **options)
    taken = F.col("size") * _copies()
    return _by_source(rows, plan).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken")
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options
) -> DataFrame:
    """The documents of the mix: each row as often as its copies, with all its columns."""
    _, plan = mix_plan(docs, id_col, text_col, source_col, seed=seed, **options)
    names = docs.columns
    kept = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = docs.select(
        kept.alias("row"), F.col(source_col).cast("string").alias("source"), _draw(F.col(id_col), seed).alias("u"),
        _second(F.col(id_col), F.col(text_col).cast("string"), seed).alias("v"),
    )
    dealt = _by_source(rows, plan).filter(_copies() > 0)
    return dealt.select("row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int")))).select("row.*")
