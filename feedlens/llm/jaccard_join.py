"""N-gram Jaccard join: documents whose word-shingle sets are similar, and their components.

1. Each distinct set is a node (copies share it). Shingles are counted exactly: a task sorts those of a
   round of texts and deals them by hash; what occurs once stays where it was counted, the others
   go back to their round with their counts. The counts give one global order, rare first.
2. Two similar sets share a shingle among the first of that order (prefix principle), so nodes
   are tied where they share one and their sizes fit. The components of these ties are cells:
   every similar pair lies within a cell.
3. The sets of a cell are stored in a trie, common shingles first, so near copies share their
   path. A set walks the trie once for all others: overlaps are counted once per shared path,
   and a subtree is left when what remains on both sides cannot reach the needed overlap.
   Members that are already connected are not compared again.

A cell of many sets is cut into blocks that share a few leaders; afterwards only the sets outside
the cell's largest component visit the other blocks, block by block, so a step of a task holds two
blocks at most. No pair is lost either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.arrays import Forest, mix, runs, shingle_sets
from feedlens.llm.batches import small_batches
from feedlens.llm.components import components
from feedlens.session import ensure_checkpoint_dir

_ROUND = 1 << 21  # shingles that a task counts at a time
_NUMBER = 16  # bits of a text's number in its round; a token is the rest of a shingle's 64 bits
_MANY = (1 << _NUMBER) - 1  # instead of a text's number: the round has the token so often that it keeps the texts itself
_OFTEN = 16
_BLOB = 1 << 11
_WORDS = 18  # 2**18 words of a bitmap of ids: 2 MB, whatever the corpus


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(np.append(mix(shingles), np.uint64(len(shingles))).sum(dtype=np.uint64).view(np.int64))


def _measure(width: int):
    """Each row's id, set size and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes = [], []
            for _, s in shingle_sets(batch.column("text"), width):
                n.append(len(s))
                nodes.append(node_of(s))
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "node"])

    return run


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each as the planes of its bytes, without the leading ones that are zero."""
    out = [len(columns[0]).to_bytes(4, "little")]
    for c in columns:
        c = np.ascontiguousarray(c).astype("<u8", copy=False)
        width = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        out += [bytes([width]), c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def _unpack(blob: bytes, columns: int, at: int = 0) -> tuple[list[np.ndarray], int]:
    """The columns that begin at a place of a blob, and where they end."""
    n, at, out = int.from_bytes(blob[at : at + 4], "little"), at + 4, []
    for _ in range(columns):
        width, raw = blob[at], np.zeros((n, 8), np.uint8)
        raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(raw.reshape(-1).view("<u8"))
        at += 1 + n * width
    return out, at


def _entries(token: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending tokens, as the first one and the steps between them, with other columns."""
    return token[:1].tobytes() + _pack(np.diff(token, prepend=token[:1]), *columns)


def _read_entries(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, *columns = _unpack(blob, 3, 8)[0]
    steps[0] = np.frombuffer(blob, np.uint64, 1)[0]
    return np.cumsum(steps, dtype=np.uint64), *columns


def _rows(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(round, part, blob), some megabytes at a time."""
    at, size = 0, 0
    for k, row in enumerate(rows):
        size += len(row[2])
        if size > 1 << 20 or k == len(rows) - 1:
            columns = zip(zip(*rows[at : k + 1], strict=True), [pa.int64(), pa.int32(), pa.binary()], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], ["round", "part", "blob"])
            at, size = k + 1, 0


def _round(number: int, sets: list[np.ndarray], nodes: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    """The tokens of a round of sets, dealt to 2**``bits`` parts by their first bits.

    Blobs hold steps between tokens, the texts' numbers and how many texts an entry stands for. A row of a
    negative part goes with them: nodes, sizes, and the texts of tokens that many texts of the round have.
    """
    sizes = np.array([len(s) for s in sets])
    value = np.concatenate(sets)
    sets.clear()  # a task holds no more copies of a round than it must
    value &= ~np.uint64(_MANY)
    value |= np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    value.sort()
    fresh = np.append(True, (value[1:] ^ value[:-1]) > np.uint64(_MANY))
    starts = np.flatnonzero(fresh)
    count = np.diff(np.append(starts, len(value)))
    often = np.repeat(count > _OFTEN, count)
    starts, count = starts[count > _OFTEN], count[count > _OFTEN]
    head = _pack(np.array(nodes, np.int64).view(np.uint64), sizes) + _pack(*_parted(value[often]))
    stands = np.ones(len(value), np.uint32)
    stands[starts] = count
    value[starts] |= np.uint64(_MANY)
    fresh |= ~often
    value, stands = value[fresh], stands[fresh]
    del fresh, often
    ends = np.searchsorted(value, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
    rows = [(number, -1 - number % (1 << 30), head)]
    for part, (a, b) in enumerate(zip([0, *ends], [*ends, len(value)], strict=True)):
        for k in range(a, b, _BLOB):
            some = slice(k, min(b, k + _BLOB))
            token, text = _parted(value[some])
            rows.append((number, part, _entries(token, text, stands[some])))
    yield from _rows(rows)


def _parted(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and texts' numbers."""
    return value >> np.uint64(_NUMBER), value & np.uint64(_MANY)


def _deal(width: int, bits: int):
    """The tokens of all sets, a round of sets at a time; a task takes equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = TaskContext.get().partitionId() << 32, set()
        sets: list[np.ndarray] = []
        nodes: list[int] = []
        waiting = 0
        for batch in batches:
            for _, s in shingle_sets(batch.column("text"), width):
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                if sets and (waiting + len(s) > _ROUND or len(sets) == _MANY):
                    yield from _round(number, sets, nodes, bits)
                    number, sets, nodes, waiting = number + 1, [], [], 0
                sets.append(s)
                nodes.append(node)
                waiting += len(s)
        if sets:
            yield from _round(number, sets, nodes, bits)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the tokens of a part; those that occur twice at least go on, with their counts."""
    for table in runs(batches, ["part"]):
        rounds, part = table["round"].to_pylist(), table["part"][0].as_py()
        if part < 0:
            yield from table.to_batches()
            continue
        blobs = [_read_entries(blob) for blob in table["blob"].to_pylist()]
        texts = [b[1].astype(np.uint16) for b in blobs]
        token = np.concatenate([b[0] for b in blobs])
        stands = np.concatenate([b[2].astype(np.uint32) for b in blobs])
        del blobs
        order = np.argsort(token)
        ranked = token[order]
        starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        total = np.add.reduceat(stands[order], starts, dtype=np.uint64)
        count = np.empty(len(token), np.uint64)
        count[order] = np.repeat(total, np.diff(np.append(starts, len(token))))
        rows, at = [], 0
        for number, text in zip(rounds, texts, strict=True):
            here = slice(at, at + len(text))
            at += len(text)
            if len(some := np.flatnonzero(count[here] > 1)):
                rows.append((number, part, _entries(token[here][some], text[some], count[here][some])))
        yield from _rows(rows)


def _shared(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a round: nodes and sizes of its sets; text, count and token of each token that is not the only one."""
    token, text, count = [], [], []
    for part, blob in zip(table["part"].to_pylist(), table["blob"].to_pylist(), strict=True):
        if part < 0:
            (nodes, sizes), at = _unpack(blob, 2)
            (kept, holders), _ = _unpack(blob, 2, at)
        else:
            for column, values in zip((token, text, count), _read_entries(blob), strict=True):
                column.append(values)
    if not token:
        return nodes, sizes, *[np.zeros(0, np.uint64)] * 3
    token, text, count = map(np.concatenate, (token, text, count))
    many = text == _MANY
    by = np.argsort(token[many])
    counted = count[many][by][np.searchsorted(token[many][by], kept)] if len(kept) else kept
    return nodes, sizes, *(np.append(x[~many], y) for x, y in ((text, holders), (count, counted), (token, kept)))


def _postings(percent: int, hot: int):
    """(token, n, node, early) for the first shingles of each set in the global order, a round of sets at a time.

    Shingles that no other set has come first and need no row: a set with enough of them is similar to no other.
    ``early`` marks those among which a set shares one with every similar set that is not smaller.
    Of a token above ``hot`` counts a task writes only the least
    and the largest set of each size class, and ties the others to the class in the task, so the
    token's rows grow with the tasks and not with the documents.
    """

    def ties(forest: Forest) -> tuple[list[int], list[int]]:
        ids, roots = forest.pairs()
        return [_tie(r) for r in roots] * 2, ids + roots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for table in runs(batches, ["round"]):
            nodes, sizes, text, count, token = _shared(table)
            nodes, sizes, text = (x.astype(np.int64) for x in (nodes, sizes, text))
            alone = sizes - np.bincount(text, minlength=len(sizes))
            first = sizes - -(-percent * sizes // 100) + 1
            open_ = (first > alone)[text]
            text, count, token = text[open_], count[open_], token[open_]
            order = np.lexsort((token, count, text))
            text, count, token = text[order], count[order], token[order]
            place = np.arange(len(text)) - np.searchsorted(text, text) + alone[text]
            use = place < first[text]
            text, count, token, place = text[use], count[use], token[use], place[use]
            n, node = sizes[text], nodes[text]
            soon = place <= n - -(-2 * percent * n // (100 + percent))
            common = count >= np.uint64(hot)
            for t, m, x in zip(token[common].tolist(), n[common].tolist(), node[common].tolist(), strict=True):
                at = (t, int(np.log(m) / -np.log(percent / 100)) if percent < 100 else m)
                low, high = ends.get(at, ((m, x), (m, x)))
                forest.union(x, low[1])
                ends[at] = (min(low, (m, x)), max(high, (m, x)))
            rest = np.flatnonzero(~common)
            for k in range(0, len(rest), 1 << 17):
                some = rest[k : k + (1 << 17)]
                yield _posting_batch(token[some], n[some], node[some], soon[some])
        flat = [(t, n, node) for (t, _), both in ends.items() for n, node in both]
        if flat:
            yield _posting_batch(*(np.array(c, np.int64) for c in zip(*flat, strict=True)), np.ones(len(flat), bool))
        tokens, nodes = ties(forest)
        if nodes:
            ones = np.ones(len(nodes), np.int64)
            yield _posting_batch(np.array(tokens, np.int64), ones, np.array(nodes, np.int64), ones > 0)

    return run


def _tie(node: int) -> int:
    """A token of its own for the sets that a task has already tied to ``node``; those of shingles have fewer bits."""
    return int(np.uint64(node & ((1 << 62) - 1)) | np.uint64(1 << 62))


def _posting_batch(tokens, sizes, nodes, early) -> pa.RecordBatch:
    columns = [pa.array(c.view(np.int64), pa.int64()) for c in (tokens, sizes, nodes)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(early)], ["token", "n", "node", "early"])


def _link_tokens(percent: int):
    """Ties each set to the last early one of its token, in order of size, if their sizes fit.

    Of a similar pair the smaller set is early, and all early sets between the two fit as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "n", "node", "early")]
            if held is not None:
                rows = [np.append(x, y) for x, y in zip(held, rows, strict=True)]
            token, n, node, early = rows
            last = np.maximum.accumulate(np.where(early, np.arange(len(token)), -1))
            before = np.append(-1, last[:-1])
            fits = (before >= 0) & (token[before] == token) & (100 * n[before] >= percent * n) & (node[before] != node)
            for a, b in np.unique(np.stack([node[before[fits]], node[fits]]), axis=1).T.tolist():
                forest.union(a, b)
            held = [x[last[-1] : last[-1] + 1] for x in rows] if last[-1] >= 0 else None
        ids, roots = forest.pairs()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

    return run


class Trie:
    """A path-compressed trie over sorted rank arrays; a walk counts overlaps once per shared path."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.size = np.array([len(s) for s in sets])
        # a node: parent, the set that spells its path, first and end position on it, sets that end in it
        parent, spelled, start, end, leaf = [-1], [order[0]], [0], [0], [-1]
        stack, last = [0], None
        for i in order:
            s = sets[i]
            shared = 0
            if last is not None:
                k = min(len(s), len(last))
                differ = np.flatnonzero(s[:k] != last[:k])
                shared = int(differ[0]) if len(differ) else k
            below = -1
            while end[stack[-1]] > shared:
                below = stack.pop()
            top = stack[-1]
            if below >= 0 and end[top] < shared:  # the edge to `below` is cut in two
                parent.append(top), spelled.append(spelled[below]), start.append(end[top]), end.append(shared), leaf.append(-1)
                parent[below], start[below] = len(parent) - 1, shared
                stack.append(len(parent) - 1)
            parent.append(stack[-1]), spelled.append(i), start.append(shared), end.append(len(s)), leaf.append(i)
            stack.append(len(parent) - 1)
            last = s
        self.parent, self.leaf = np.array(parent), np.array(leaf)
        self.depth, length = np.array(end), np.array(end) - np.array(start)
        self.edges = np.concatenate([sets[spelled[k]][start[k] : end[k]] for k in range(len(parent))] or [np.zeros(0)])
        self.at = np.append(0, np.cumsum(length))
        self.deepest = np.array([sets[spelled[k]][end[k] - 1] if end[k] else 0 for k in range(len(parent))])
        self.least = np.where(self.leaf >= 0, self.size[self.leaf], np.iinfo(np.int64).max)
        self.most = np.where(self.leaf >= 0, self.size[self.leaf], 0)
        self.upward = np.argsort(-self.depth, kind="stable").tolist()
        for k in self.upward:
            if (p := self.parent[k]) >= 0:
                self.least[p] = min(self.least[p], self.least[k])
                self.most[p] = max(self.most[p], self.most[k])
        by_parent = np.argsort(self.parent, kind="stable")
        self.children = by_parent[1:]
        self.first = np.searchsorted(self.parent[self.children], np.arange(len(parent) + 1))

    def similar(self, probe: np.ndarray, vocabulary: int, percent: int, skip: np.ndarray) -> np.ndarray:
        """The sets with 100 * overlap >= percent * union; subtrees where ``skip`` holds are left out."""
        marked = np.zeros(vocabulary + 1, np.int64)
        marked[probe] = 1
        frontier, overlap, found = np.array([0]), np.zeros(1, np.int64), []
        while len(frontier):
            number = self.first[frontier + 1] - self.first[frontier]
            nodes = self.children[_ranges(self.first[frontier], number)]
            had = np.repeat(overlap, number)
            keep = ~skip[nodes]
            nodes, had = nodes[keep], had[keep]
            if not len(nodes):
                break
            length = self.at[nodes + 1] - self.at[nodes]
            hits = np.append(0, np.cumsum(marked[self.edges[_ranges(self.at[nodes], length)]]))
            stop = np.cumsum(length)
            had = had + hits[stop] - hits[stop - length]
            ahead = len(probe) - np.searchsorted(probe, self.deepest[nodes], "right")
            best = had + np.minimum(ahead, self.most[nodes] - self.depth[nodes])
            alive = (100 + percent) * best >= percent * (len(probe) + self.least[nodes])
            nodes, had = nodes[alive], had[alive]
            ends = self.leaf[nodes]
            hit = (ends >= 0) & ((100 + percent) * had >= percent * (len(probe) + self.size[ends]))
            found.append(ends[hit])
            frontier, overlap = nodes, had
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def all_under(self, leaves: np.ndarray) -> np.ndarray:
        """For each node, whether ``leaves`` holds for every set at or below it."""
        out = np.where(self.leaf >= 0, leaves[self.leaf], True)
        for k in self.upward:
            if (p := self.parent[k]) >= 0 and not out[k]:
                out[p] = False
        return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    steps = np.ones(total, np.int64)
    ends = np.cumsum(lengths)
    some = lengths > 0
    firsts = (ends - lengths)[some]
    steps[firsts] = starts[some] - np.append(0, (starts + lengths)[some][:-1] - 1)
    steps[firsts[0]] = starts[some][0]
    return np.cumsum(steps)


def _cell_links(width: int, percent: int):
    """Links within each (cell, block, guest block): visiting sets walk the trie of those at home."""

    def of_cell(cell: pa.Table, forest: Forest) -> None:
        nodes, comps = cell["node"].to_pylist(), cell["comp"].to_pylist()
        home, visits = cell["home"].to_pylist(), cell["visits"].to_pylist()
        rows, sets, seen = [], [], set()
        for i, s in shingle_sets(cell["text"], width):
            if nodes[i] not in seen and node_of(s) == nodes[i]:  # another text may have the same id
                seen.add(nodes[i])
                rows.append(i)
                sets.append(s)
        left = len({forest.find(comps[i]) for i in rows})
        at_home = [k for k, i in enumerate(rows) if home[i]]
        if left < 2 or not at_home:
            return
        values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, -count))] = np.arange(len(values))
        bounds = np.cumsum([len(s) for s in sets])[:-1]
        sets = [np.sort(x) for x in np.split(rank[place], bounds)]
        trie = Trie([sets[k] for k in at_home])
        owner = [comps[rows[k]] for k in at_home]
        for k, i in enumerate(rows):
            if not visits[i] or left < 2:
                continue
            own = forest.find(comps[i])
            same = np.array([forest.find(c) == own for c in owner])
            if same.all():
                continue
            for j in trie.similar(sets[k], len(values), percent, trie.all_under(same)).tolist():
                left -= forest.union(comps[i], owner[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ["cell", "block", "guest"]):
            forest = Forest()
            of_cell(cell, forest)
            ids, roots = forest.pairs()
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

    return run


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    block_sets: int = 1024,
    block_shingles: int = 1 << 20,
    leaders: int = 16,
    hot_token: int = 1 << 20,
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z in lower case. A set holds the
    distinct ``width``-word shingles; with fewer words the whole sequence is the one shingle.
    Documents link when 100 * intersection >= ``percent`` * union (1 to 100). ``component_id`` is
    the smallest id reachable by links. ``block_sets`` and ``block_shingles`` bound what one step
    of a task holds; ``leaders`` sets are shared by the blocks of a large cell. Shingles and sets
    are compared by 64-bit hashes.

    A null or blank text has no shingles and links with nothing. A null id keeps its row, with a
    null component. Rows with one id are one document: their links are joined. Equal sets link,
    however many. An empty table gives no rows. Other columns are ignored.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    narrow = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    light = narrow.mapInArrow(_measure(width), "id long, n long, node long").checkpoint()

    total = light.agg(F.sum("n")).first()[0] or 0
    parts = max(total >> 20, min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 16), 1)
    dealt = narrow.mapInArrow(_deal(width, (parts - 1).bit_length()), "round long, part int, blob binary")
    counted = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_count, dealt.schema)
    rounds = counted.repartition("round").sortWithinPartitions("round")
    postings = rounds.mapInArrow(_postings(percent, hot_token), "token long, n long, node long, early boolean")
    sorted_postings = postings.repartition("token").sortWithinPartitions("token", "n", "node")
    cells = components(sorted_postings.mapInArrow(_link_tokens(percent), "a long, b long"))

    named = light.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    in_cell = cells.union(cells.select("root", "root").distinct()).toDF("node", "cell")
    members = named.filter("id is not null").join(in_cell, "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("n") / block_shingles)).cast("int")
    sizes = members.groupBy("cell").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("nodes"))
    spread = F.xxhash64("node")
    members = members.join(sizes, "cell").withColumns(
        {"block": F.pmod(spread, F.col("blocks")).cast("int"), "comp": F.col("node")}
    )
    members = members.checkpoint()
    home = with_ids(narrow, members).join(members, "id").checkpoint()  # the texts of the cells, read by both rounds

    def linked(placed: DataFrame) -> DataFrame:
        rows = placed.select("cell", F.col("there").alias("block"), "guest", "node", "comp", "home", "visits", "text")
        ordered = rows.repartition("cell", "block", "guest").sortWithinPartitions("cell", "block", "guest", "node")
        return ordered.mapInArrow(_cell_links(width, percent), "a long, b long").checkpoint()

    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    leads = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(spread), F.col("nodes")) < leaders)
    first = home.withColumn("there", F.explode(F.when(leads, every).otherwise(F.array("block"))))
    yes = F.lit(True)
    links = linked(first.withColumns({"guest": F.col("there"), "home": F.expr("there = block"), "visits": yes}))
    found = components(links)
    if home.filter("blocks > 1").limit(1).count():
        links = links.union(linked(_visits(home.filter("blocks > 1"), found, every)))
        found = components(links)

    per_node = named.join(found, named["node"] == found["id"], "left")
    per_node = per_node.select(named["node"], named["id"], F.coalesce("root", named["node"]).alias("comp"))
    least = per_node.groupBy("comp").agg(F.min("id").alias("component"))
    per_node = per_node.join(least, "comp").select("node", "component")
    alone = _same_id(light.join(per_node, "node", "left"))
    return alone.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def with_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``id`` is among the wanted ones, and some others: a bitmap of fixed size tells, so that a
    join after it does not shuffle all texts."""

    def place(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = mix(batch.column("id").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
        return (ids >> np.uint64(64 - _WORDS)).astype(np.int64), np.uint64(1) << (ids & np.uint64(63))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = place(batch)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], ["word", "bits"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = place(batch)
            yield batch.filter(pa.array((bitmap.value[word] & bit) > 0))

    bits = wanted.select("id").mapInArrow(marked, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << _WORDS, np.uint64)
    table[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    bitmap = rows.sparkSession.sparkContext.broadcast(table)
    return rows.mapInArrow(kept, rows.schema)


def _visits(home: DataFrame, found: DataFrame, every) -> DataFrame:
    """Sets outside the largest component of their cell visit all its blocks. A home block meets the
    guests of one block at a time."""
    known = home.drop("comp").join(found.select(F.col("id").alias("node"), "root"), "node", "left")
    known = known.withColumn("comp", F.coalesce("root", "node")).drop("root")
    counted = known.groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = counted.groupBy("cell").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"))
    known = known.join(main.filter("comps > 1"), "cell").withColumn("outside", F.col("comp") != F.col("main"))
    senders = known.filter("outside").select("cell", F.col("block").alias("guest")).distinct()
    hosts = known.join(senders, "cell").withColumn("there", F.col("block"))
    hosts = hosts.withColumns({"home": F.lit(True), "visits": F.expr("outside AND guest = block")})
    guests = known.filter("outside").withColumns({"there": F.explode(every), "guest": F.col("block")})
    guests = guests.filter("there <> block").withColumns({"home": F.lit(False), "visits": F.lit(True)})
    return hosts.unionByName(guests)


def _same_id(rows: DataFrame) -> DataFrame:
    """Rows without shingles stay alone; rows that share an id share the component."""
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    rows = rows.select("id", "n", F.when(F.col("id").isNotNull(), own).alias("component")).checkpoint()
    least = rows.groupBy("id").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b")
    if not least.limit(1).count():
        return rows
    ties = rows.select("id", "component").distinct().join(least.select("id", "a"), "id")
    joined = components(ties.filter("component <> a").select("component", "a"))
    return rows.join(joined, rows["component"] == joined["id"], "left").select(
        rows["id"], "n", F.coalesce("root", "component").alias("component")
    )
