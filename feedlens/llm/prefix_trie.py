"""Prefix trie of conversations: sorted matrices of turn ids, one per range shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
_SALTS = 16
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"

# Kinds of rows that a shard gives.
_DONE, _NEEDS_PARENT, _PART, _END = range(4)
_SHAPE = (
    "kind int, level int, first int, conv long, parent long, n long, children long, leaves long, saved long, "
    "words long, up int, above array<int>, ends string"
)


# --- rebuilding and numbering ---------------------------------------------------------------


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted part: its number, first and last conversation, and how many rows the last one has."""
    part = head = last = None
    tail = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv").to_numpy()
        part = batch.column("part")[0].as_py()
        head = int(conv[0]) if head is None else head
        run = len(conv) - int(np.searchsorted(conv, conv[-1]))
        tail = tail + run if last == conv[-1] else run
        last = int(conv[-1])
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, head, last, tail)], ["part", "head", "last", "tail"])


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``p``, the 0-based place of each row in its conversation ``conv`` by ``order``.

    A range sort spreads the rows of a long conversation over tasks; each part carries on from the count of
    the parts before, of which the driver sees four numbers a part.
    """
    placed = rows.orderBy("conv", *order).withColumn("part", F.spark_partition_id()).checkpoint()
    carried, before, upto = {}, None, 0
    for r in placed.select("part", "conv").mapInArrow(_edges, "part long, head long, last long, tail long").orderBy("part").collect():
        carried[r.part] = upto if r.head == before else 0
        upto = r.tail + (carried[r.part] if r.head == r.last else 0)
        before = r.last
    held = rows.sparkSession.sparkContext.broadcast(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, upto = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            new = np.ones(len(conv), bool)
            new[1:] = conv[1:] != conv[:-1]
            starts = np.flatnonzero(new)
            p = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
            if before is None:
                upto = held.value[batch.column("part")[0].as_py()]
                before = conv[0]
            if conv[0] == before:
                stop = starts[1] if len(starts) > 1 else len(conv)
                p[:stop] += upto
            before, upto = conv[-1], int(p[-1]) + 1
            arrays = [pa.array(p.astype(np.int64)) if n == "part" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, ["p" if n == "part" else n for n in batch.schema.names])

    shape = ", ".join(f"{'p' if f.name == 'part' else f.name} {'long' if f.name == 'part' else f.dataType.simpleString()}" for f in placed.schema)
    return placed.mapInArrow(run, shape)


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv, p, a, b, words) of the rebuilt turns, and (conv) of all conversations.

    Conversation c starts with the first h turns of conversation c - c % ``every``, h = crc32(c as text) %
    ``most``; its own turns after its first h follow. A turn is known by two 64-bit hashes of role and text.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), F.md5(text).alias("tie"),
        F.xxhash64(F.lit(1), role, text).bitwiseAND(0x7FFFFFFFFFFFFFFF).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    ).filter("conv IS NOT NULL")
    own = numbered(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")])
    own = own.select("conv", "p", "a", "b", "words").withColumn("h", F.crc32(F.col("conv").cast("string")) % most)
    convs = own.groupBy("conv").agg(F.first("h").alias("h")).checkpoint()
    heads = own.filter((F.col("p") < most) & (F.col("conv") % every == 0)).select(F.col("conv").alias("donor"), "p", "a", "b", "words")
    lent = convs.withColumn("donor", F.col("conv") - F.col("conv") % every).join(heads, "donor").filter("p < h")
    both = lent.select("conv", F.lit(0).alias("kind"), F.col("p").alias("q"), "a", "b", "words")
    both = both.union(own.filter("p >= h").select("conv", F.lit(1), "p", "a", "b", "words"))
    return numbered(both, [F.col("kind"), F.col("q")]).select("conv", "p", "a", "b", "words"), convs.select("conv")


# --- one shard ------------------------------------------------------------------------------


class Shard:
    """Rows of a shard, sorted: group, turn ids padded with -1, conversation; and where nodes start.

    Level 0 is the group (conversations that agree on all earlier turns), level k adds k turns.
    """

    def __init__(self, table: pa.Table) -> None:
        lists = table["ids"].combine_chunks()
        flat = lists.flatten().to_numpy()
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        size = np.diff(ends) // 2
        rows, width = len(size), int(size.max(initial=0))
        matrix = np.full((rows, width, 2), -1, np.int64)
        words = np.zeros((rows, width), np.int64)
        at = np.arange(len(flat) // 2)
        owner = np.repeat(np.arange(rows), size)
        place = at - np.repeat(ends[:-1] // 2, size)
        matrix[owner, place] = flat.reshape(-1, 2)
        words[owner, place] = table["words"].combine_chunks().flatten().to_numpy()
        conv = table["conv"].to_numpy()
        group = np.unique(table["g"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
        keys = [conv, *(matrix[:, k, i] for k in reversed(range(width)) for i in (1, 0)), group]
        order = np.lexsort(keys)
        self.conv, self.size, self.width, self.group = conv[order], size[order], width, group[order]
        self.matrix, self.words = matrix[order], words[order]
        self.order = order
        change = np.ones((rows, width + 1), bool)
        change[1:, 0] = self.group[1:] != self.group[:-1]
        change[1:, 1:] = (self.matrix[1:] != self.matrix[:-1]).any(axis=2)
        self.starts = np.logical_or.accumulate(change, axis=1)

    def bounds(self, level: int) -> np.ndarray:
        return np.flatnonzero(self.starts[:, level])


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of a shard, and the deepest level at which they are in one node."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    order = Shard(table).order
    first, last = edge = table.take(pa.array([order[0], order[-1]])).to_pylist()
    same = next((i for i, (x, y) in enumerate(zip(first["ids"], last["ids"])) if x != y), min(len(first["ids"]), len(last["ids"])))  # noqa: B905
    span = same // 2 if first["g"] == last["g"] else -1
    rows = [{"shard": r["shard"], "side": i, "span": span, "g": r["g"], "ids": r["ids"]} for i, r in enumerate(edge)]
    names = [("shard", pa.int32()), ("side", pa.int32()), ("span", pa.int32()), ("g", pa.string()), ("ids", pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_pylist(rows, pa.schema(names))


def _shared_levels(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shards that have rows, the deepest level that each shares with the next one (-1: none), and
    the deepest level at which its last node started in a shard before. Three numbers a shard."""
    last = edges.filter("side = 1").select("shard", "g", "ids")
    after = edges.filter("side = 0").select(F.col("shard").alias("s2"), F.col("g").alias("g2"), F.col("ids").alias("ids2"))
    spans = dict(map(tuple, edges.filter("side = 1").select("shard", "span").collect()))
    known = sorted(spans)
    found: dict[int, int] = {}
    if len(known) > 1:
        following = edges.sparkSession.createDataFrame(list(zip(known[:-1], known[1:], strict=True)), "shard int, s2 int")
        pairs = F.zip_with("ids", "ids2", lambda x, y: F.coalesce(x == y, F.lit(False)))  # null beyond the shorter one
        same = F.array_position(pairs, False) - 1
        same = F.when(same < 0, F.size("ids")).otherwise(same)
        level = F.when(F.col("g") != F.col("g2"), -1).otherwise(F.floor(same / 2)).cast("int")
        joined = last.join(following, "shard").join(after, "s2")
        found = dict(map(tuple, joined.select("shard", level).collect()))
    shared = np.array([found[s] for s in known[:-1]], np.int64)
    earlier = np.minimum(np.array([spans[s] for s in known], np.int64), np.append(-1, shared)[: len(known)])
    return np.array(known, np.int64), shared, earlier


def _nodes(held, base: int):
    """All nodes of a shard. Nodes that go on in a neighbour shard come as parts, without what they
    add to the sums themselves: that is known only when the parts are put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shared, earlier = held.value
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        shard = int(np.searchsorted(known, table["shard"][0].as_py()))
        t = Shard(table)
        back = int(shared[shard - 1]) if shard else -1
        ahead = int(shared[shard]) if shard < len(shared) else -1
        take = lambda name: table[name].to_numpy(zero_copy_only=False)[t.order].copy()
        ending, x_children, leaves, saved = take("ends"), take("x_children"), take("x_leaves"), take("x_saved")
        rows, top = len(t.conv), t.width
        bounds = [t.bounds(k) for k in range(top + 1)]
        least = [np.minimum.reduceat(t.conv, b) for b in bounds]

        def origin(level: int, is_last: bool) -> int:
            """The shard in which the first (or last) node of a level starts."""
            if level <= back and (not is_last or len(bounds[level]) == 1):
                return int(known[np.flatnonzero(earlier[:shard] < level)[-1]])
            return int(known[shard])

        for level in range(top, -1, -1):
            b = bounds[level]
            count = np.diff(np.append(b, rows))
            real = t.size[b] >= level
            cut = np.zeros(len(b), bool)
            cut[0] |= level <= back
            cut[-1] |= level <= ahead
            below = np.where(t.size == level, x_children, 0)
            if level < top:
                child = t.starts[:, level + 1] & (t.size > level)
                if level + 1 <= back:
                    child[0] = False
                if level + 1 <= ahead:
                    child[bounds[level + 1][-1]] = False
                below = below + child
            children = np.add.reduceat(below, b)
            inner = real & ~cut
            if base == 0 or level:  # level 0 of later rounds is a node of the round before
                leaves[b[inner & (children == 0)]] += 1
                if level:
                    saved[b[inner]] += (count[inner] - 1) * t.words[b[inner], level - 1]
            n_leaves, n_saved = np.add.reduceat(leaves, b), np.add.reduceat(saved, b)

            ends = np.full(len(b), EMPTY, object)
            at = np.flatnonzero((t.size == level) & ending & (level > 0 or base == 0))
            owner = np.searchsorted(b, at, "right") - 1
            for node, first, last in zip(*_runs(owner), strict=True):
                if not cut[node]:
                    ends[node] = hashlib.sha256(",".join(map(str, t.conv[at[first:last]].tolist())).encode()).hexdigest()
            up = np.searchsorted(bounds[level - 1], b, "right") - 1 if level else np.full(len(b), -1)
            parents = least[level - 1][up] if level else np.full(len(b), -1)
            up_first = level - 1 <= back and level > 0
            up_last = level - 1 <= ahead and level > 0
            last_up = len(bounds[level - 1]) - 1 if level else -1

            def emit(kind: int, which: np.ndarray, first, up_origin=None, above=None, tips=None) -> pa.RecordBatch:
                n = len(which)
                same = lambda v: pa.array([v] * n)  # noqa: B023, E731
                words = t.words[b[which], level - 1] if level else np.zeros(n, np.int64)
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind] * n, pa.int32()), pa.array([level] * n, pa.int32()), pa.array(first, pa.int32()),
                        pa.array(least[level][which]), pa.array(parents[which].astype(np.int64)), pa.array(count[which].astype(np.int64)),
                        pa.array(children[which].astype(np.int64)), pa.array(n_leaves[which]), pa.array(n_saved[which]), pa.array(words),
                        pa.array([up_origin] * n, pa.int32()), pa.array([above] * n, pa.list_(pa.int32())),
                        pa.array(ends[which] if tips is None else tips, pa.string()),
                    ],
                    [f.split()[0] for f in _SHAPE.split(", ")],
                )

            orphan = inner & ((up_first & (up == 0)) | (up_last & (up == last_up)))
            done = np.flatnonzero(inner & ~orphan)
            for a in range(0, len(done), 10_000):
                part = done[a : a + 10_000]
                yield emit(_DONE, part, [None] * len(part))
            lost = np.flatnonzero(orphan)
            for a in range(0, len(lost), 10_000):
                part = lost[a : a + 10_000]
                from_first = up_first & (up[part] == 0)
                yield emit(_NEEDS_PARENT, part, [origin(level - 1, bool(not f)) for f in from_first])
            for node in np.flatnonzero(real & cut):
                on_first = node == 0 and level <= back
                above = [origin(k, not on_first) for k in range(level + 1)]
                yield emit(_PART, np.array([node]), [above[-1]], above[-2] if level else None, above)
                mine = at[owner == node]
                for a in range(0, len(mine), 10_000):
                    ids = t.conv[mine[a : a + 10_000]]
                    one = emit(_END, np.full(len(ids), node), [above[-1]] * len(ids))
                    yield one.set_column(3, "conv", pa.array(ids))

    return run


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of runs of equal entries, where they begin and where they end."""
    if not len(owner):
        return owner, owner, owner
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return owner[begin], begin, np.append(begin[1:], len(owner))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the ids of each node, read in order; only the running hash is held."""
    key, state = None, None

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([state.hexdigest()])], ["level", "first", "ends"]
        )

    for batch in batches:
        level, first, conv = (batch.column(c).to_numpy() for c in ("level", "first", "conv"))
        if not len(conv):
            continue
        cuts = np.append(0, np.flatnonzero((level[1:] != level[:-1]) | (first[1:] != first[:-1])) + 1)
        for a, z in zip(cuts, np.append(cuts[1:], len(conv)), strict=True):
            text = ",".join(map(str, conv[a:z].tolist())).encode()
            now = (int(level[a]), int(first[a]))
            if now == key:
                state.update(b"," + text)
                continue
            if key is not None:
                yield done()
            key, state = now, hashlib.sha256(text)
    if key is not None:
        yield done()


# --- rounds ---------------------------------------------------------------------------------


def _trie(rows: DataFrame, base: int, shard_rows: int) -> DataFrame:
    """(level, conv, parent, n, children, leaves, saved, ends) of all nodes of one round.

    ``rows`` has conv, g, ids, words, ends, x_children, x_leaves, x_saved.
    """
    spark = rows.sparkSession
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.repartitionByRange(shards, "g", "ids", "conv").withColumn("shard", F.spark_partition_id()).checkpoint()
    edges = dealt.mapInArrow(_summary, "shard int, side int, span int, g string, ids array<long>").checkpoint()
    out = dealt.mapInArrow(_nodes(spark.sparkContext.broadcast(_shared_levels(edges)), base), _SHAPE).checkpoint()
    plain = ["level", "conv", "parent", "n", "children", "leaves", "saved", "ends"]
    done = out.filter(F.col("kind") == _DONE).select(*plain)
    if shards == 1:
        return done

    parts = out.filter(F.col("kind") == _PART).groupBy("level", "first").agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("words").alias("words"), F.max("up").alias("up"), F.max("above").alias("above"),
    ).checkpoint()
    kids = parts.filter("level > 0").groupBy((F.col("level") - 1).alias("level"), F.col("up").alias("first")).agg(F.count(F.lit(1)).alias("more"))
    own = (F.col("level") > 0) | F.lit(base == 0)
    parts = parts.join(kids, ["level", "first"], "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    parts = parts.withColumns(
        {
            "own_leaf": F.when(own & (F.col("children") == 0), 1).otherwise(0),
            "own_saved": F.when(F.col("level") > 0, (F.col("n") - 1) * F.col("words")).otherwise(0),
        }
    )
    above = parts.select("own_leaf", "own_saved", F.posexplode("above").alias("level", "first"))
    above = above.groupBy("level", "first").agg(F.sum("own_leaf").alias("l"), F.sum("own_saved").alias("s"))
    tips = out.filter(F.col("kind") == _END).select("level", "first", "conv")
    tips = tips.repartition("level", "first").sortWithinPartitions("level", "first", "conv")
    tips = tips.mapInArrow(_hash_ends, "level int, first int, ends string")
    whole = parts.join(above, ["level", "first"]).join(tips, ["level", "first"], "left")
    names = parts.select((F.col("level") + 1).alias("level"), F.col("first").alias("up"), F.col("conv").alias("parent"))
    joined = whole.join(names, ["level", "up"], "left").select(
        "level", "conv", F.coalesce("parent", F.lit(-1)).alias("parent"), "n", "children", (F.col("leaves") + F.col("l")).alias("leaves"),
        (F.col("saved") + F.col("s")).alias("saved"), F.coalesce("ends", F.lit(EMPTY)).alias("ends"),
    )
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    orphans = out.filter(F.col("kind") == _NEEDS_PARENT).drop("parent", "up")
    orphans = orphans.withColumn("up", F.col("first")).withColumn("salt", F.pmod("conv", F.lit(_SALTS)).cast("int"))
    return done.union(joined).union(orphans.join(salted, ["level", "up", "salt"]).select(*plain))


def conversation_trie(
    turns: DataFrame, width: int = 32, shard_rows: int = 20_000, every: int = 20, most: int = 4
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations; see ``rebuilt`` for how they are put together.

    ``turns`` has conv_id, turn, role, text. The columns are conv_id (the smallest member),
    depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Turns are taken ``width`` at a time. A round sorts conversations by range into shards of about
    ``shard_rows``; each shard is a padded matrix of turn ids, sorted, whose changes by column mark
    where nodes start, and sums over row ranges give every depth. Nodes that cross shards come as
    parts and are put together. Conversations that still agree after ``width`` turns go on in a next
    round, whose sums join theirs; a conversation that is alone goes on as a chain without a matrix,
    so no task ever holds a whole long conversation. The ids of those that end at a node that crosses
    shards are hashed in order as a stream.

    Turns are ordered by turn (null first), ties by role, then by the MD5 of the text; null role or text is
    empty. Rows without conv_id are left out; repeated rows are turns of their own. An empty table has no
    nodes, not even a root. Other columns are ignored.
    """
    spark = turns.sparkSession
    ensure_checkpoint_dir(spark)
    sequence, convs = rebuilt(turns, every, most)
    sequence = sequence.checkpoint()
    packed = sequence.withColumn("chunk", F.floor(F.col("p") / width)).groupBy("conv", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("p", "a", "b", "words"))).alias("t")  # at most ``width`` turns
    )
    packed = packed.select(
        "conv", "chunk", F.flatten(F.transform("t", lambda x: F.array(x["a"], x["b"]))).alias("ids"),
        F.transform("t", lambda x: x["words"]).alias("words"),
    ).checkpoint()
    length = packed.groupBy("conv").agg(F.max(F.col("chunk") * width + F.size("words")).alias("length"))
    alive = convs.join(length, "conv", "left").select("conv", F.coalesce("length", F.lit(0)).alias("length"), F.lit("").alias("g")).checkpoint()

    rounds: list[DataFrame] = []
    chains: list[DataFrame] = []
    while alive.limit(1).count():
        done = len(rounds)
        none = F.array().cast("array<bigint>")
        chunk = packed.filter(F.col("chunk") == done).drop("chunk")
        rows = alive.join(chunk, "conv", "left").withColumns({"ids": F.coalesce("ids", none), "words": F.coalesce("words", none)})
        end = (done + 1) * width
        goes_on = F.col("length") > end
        rows = rows.withColumn("node", F.when(F.col("length") >= end, F.md5(F.concat_ws(",", "g", F.col("ids").cast("array<string>")))))
        groups = rows.filter("node IS NOT NULL").groupBy("node").agg(F.count_if(goes_on).alias("many"), F.min("conv").alias("rep"))
        rows = rows.join(groups, "node", "left").withColumn("ends", ~goes_on).checkpoint()
        rounds.append(rows)
        chains.append(rows.filter("many = 1 AND NOT ends").select("conv", F.lit(end).alias("from"), "length", F.col("rep").alias("head")))
        alive = rows.filter("many > 1").select("conv", "length", F.col("node").alias("g")).checkpoint()  # with those that end there

    found, deeper = [], None
    for done in reversed(range(len(rounds))):
        rows = rounds[done].withColumn("alone", (~F.col("ends") & (F.col("many") == 1)).cast("long"))
        more = {"x_children": F.col("alone"), "x_leaves": F.col("alone"), "x_saved": F.lit(0).cast("long")}
        if deeper is not None:
            rows = rows.join(deeper, (F.col("conv") == F.col("rep")) & (F.col("rep") == F.col("deep")) & (F.col("many") > 1), "left")
            more = {k: v + F.coalesce(k[2:], F.lit(0)) for k, v in more.items()}
        rows = rows.withColumns(more)
        nodes = _trie(rows.select("conv", "g", "ids", "words", "ends", *more), done * width, shard_rows).checkpoint()
        deeper = nodes.filter("level = 0").select(F.col("conv").alias("deep"), "children", "leaves", "saved")
        found.append(
            nodes.filter(F.lit(done == 0) | (F.col("level") > 0)).select(
                F.col("conv").alias("conv_id"), (F.col("level") + done * width).cast("long").alias("depth"),
                F.when(F.col("level") + done * width > 0, F.col("parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                F.col("ends").alias("ends_sha256"),
            )
        )
    if not found:
        return spark.createDataFrame([], _NODE)
    salted = reduce(DataFrame.union, chains).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    tail = sequence.filter(F.col("p") >= width).select("conv", "p", F.pmod("p", F.lit(_SALTS)).cast("int").alias("salt"))
    tail = tail.join(salted, ["conv", "salt"]).filter(F.col("p") >= F.col("from"))
    last = F.col("p") + 1 == F.col("length")
    tail = tail.select(
        F.col("conv").alias("conv_id"), (F.col("p") + 1).alias("depth"),
        F.when(F.col("p") == F.col("from"), F.col("head")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return reduce(DataFrame.union, found).union(tail)
