"""Operators for training data on small tables: hard rows, brute force and round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from feedlens.llm import jaccard_join
from feedlens.llm.byte_bpe import Encoder, bpe_round_trip, load_ranks
from feedlens.llm.components import components
from feedlens.llm.context_tree import context_tree_scores
from feedlens.llm.cover_tree import embedding_near_dedup
from feedlens.llm.html_density import extract_main_text, main_text
from feedlens.llm.jaccard_join import ngram_jaccard_join
from feedlens.llm.mixing import mixed, mixed_sizes
from feedlens.llm.quality_qda import quality_scores
from feedlens.llm.secrets import BASE, KINDS, OPAQUE, redact, secret_scan, spans_text
from feedlens.llm.toxicity import Distances, toxicity_scores
from feedlens.llm.vp_tree import nearest_neighbours

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(60_000))
SHAPE = "doc_id long, text string, lang string, source string, id long, n int, node string, row string, u int, s string, value int"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, blanks, repeats, ties, a very long text and clashing columns."""
    rows = [
        (1, "A b c d e f g", "en", "x"), (2, "a B c d e f g", "en", "x"), (2, "a B c d e f g", "en", "x"), (3, "", "en", "y"),
        (4, None, "de", "y"), (5, " \t\n ", None, None), (None, "a b c d e f g", "en", None), (None, None, None, None),
        (6, LONG, "en", "x"), (7, LONG + " tail", "en", "z"), (8, "one two", "fr", "z"), (9, "one  two", "fr", "z"), (10, "two one", "fr", "z"),
    ]
    return spark.createDataFrame([(*r, 5, 6, "n", "r", 7, "s", 8) for r in rows], SHAPE)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 101), (7, 7), (None, 3)] + [(500, k) for k in range(501, 540)]
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 101: 100, **{k: 500 for k in range(501, 540)}}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_components_of_stars_and_random_edges(spark):
    draw = random.Random(5)
    edges = [(0, k) for k in range(1, 4000)] + [(9000 + k, 8999) for k in range(1, 3000)]
    edges += [(draw.randrange(20_000, 24_000), draw.randrange(20_000, 24_000)) for _ in range(3000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = components(spark.createDataFrame(edges, "x long, y long").repartition(7)).collect()
    assert {r.id: r.root for r in got} == {x: find(x) for x in list(root) if find(x) != x} and len(got) == len({r.id for r in got})


def brute_groups(rows: list[tuple[int, str]], percent: int) -> dict[int, int]:
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    return group


@pytest.mark.parametrize("options", [{}, {"block_sets": 2, "leaders": 1, "hot_token": 2}, {"percent": 40, "block_shingles": 50}])
def test_jaccard_brute_force(spark, options):
    draw = random.Random(5)
    base = [[f"w{draw.randrange(400)}" for _ in range(draw.choice([3, 5, 8, 40, 60]))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 4])):
            text[draw.randrange(len(text))] = f"x{draw.randrange(10**6)}"
        if draw.random() < 0.3:
            text += base[0]
        rows.append((i * 7 % 151, " ".join(text)))
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert got == brute_groups(rows, options.get("percent", 75))


def test_jaccard_cells_do_not_grow_with_the_corpus(spark, monkeypatch):
    """Texts that share a passage with the next one, and are otherwise their own, form no cells, however many shingles there are."""
    seen = []

    def counted(edges, made=jaccard_join.components):
        out = made(edges)
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "components", counted)
    word = "transform(sequence(1, {n}), k -> lower(hex(shiftrightunsigned(xxhash64({of}, k), 44))))"
    parts = [word.format(n=300, of="'p', id"), word.format(n=6400, of="'own', id"), word.format(n=300, of="'p', id + 1")]
    docs = spark.range(0, 1400, 1, 8).selectExpr("id AS doc_id", f"array_join(concat({', '.join(parts)}), ' ') AS text")
    copies = docs.filter("doc_id < 3").selectExpr("doc_id + 5000 AS doc_id", "concat(text, ' tail') AS text")
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(docs.union(copies)).collect()}
    assert got == {i: i for i in range(1400)} | {5000 + i: i for i in range(3)}
    assert seen[0] <= 5  # the near copies, not all texts in one cell that fills the disk


@pytest.mark.parametrize("bits", [0, 4])
def test_jaccard_counts_of_rounds(bits):
    draw = np.random.default_rng(1)
    common = draw.integers(0, 2**64, 40, dtype=np.uint64)
    rounds = [[np.unique(np.append(draw.integers(0, 2**64, 50, dtype=np.uint64), common[: draw.integers(0, 41)])) for _ in range(k)] for k in (1, 30, 200)]
    dealt = [b for k, sets in enumerate(rounds) for b in jaccard_join._round(k, list(sets), [-k - i for i in range(len(sets))], bits)]
    counted = pa.Table.from_batches(jaccard_join._count(iter(pa.Table.from_batches(dealt).sort_by("part").to_batches(7))))
    tokens, counts = np.unique(np.concatenate([s >> np.uint64(16) for sets in rounds for s in sets]), return_counts=True)
    often = dict(zip(tokens[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True))
    for k, sets in enumerate(rounds):
        mine = counted.filter(pa.compute.equal(counted["round"], k))
        nodes, sizes, *shared = jaccard_join._shared(mine)
        assert nodes.view(np.int64).tolist() == [-k - i for i in range(len(sets))] and sizes.tolist() == [len(s) for s in sets]
        want = sorted((i, often[t], t) for i, s in enumerate(sets) for t in (s >> np.uint64(16)).tolist() if t in often)
        assert sorted(zip(*(x.tolist() for x in shared), strict=True)) == want


def test_jaccard_shared_ids(spark):
    """An id with several texts ties all their components, also through other ids."""
    text = {k: " ".join(f"{k}{i}" for i in range(9)) for k in "abcdefgh"}
    rows = [(10, "a"), (11, "b"), (12, "c"), (13, "d"), (14, "e"), (20, "g"), (21, "h"), (15, "f")]
    rows += [(30, k) for k in "abcd"] + [(31, k) for k in "dec"] + [(31, "")]
    docs = spark.createDataFrame([(i, text.get(k, "")) for i, k in rows], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_jaccard_join(docs).collect()}
    one = {(i, 5): 10 for i in (10, 11, 12, 13, 14, 30, 31)}
    assert got == one | {(31, 0): 10, (20, 5): 20, (21, 5): 21, (15, 5): 15}


def test_jaccard_hard_rows(spark, hard):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(hard).collect()), key=str)
    by_id = {g[0]: g for g in got}
    assert len(got) == 13 and by_id[2] == (2, 3, 1) and by_id[3] == (3, 0, 3) and by_id[4] == (4, 0, 4) and by_id[5] == (5, 0, 5)
    assert by_id[7][2] == 6 and by_id[9] == (9, 1, 8) and by_id[10] == (10, 1, 10)
    assert sorted(g[1:] for g in got if g[0] is None) == [(0, None), (3, None)]
    assert ngram_jaccard_join(hard.limit(0)).count() == 0


def test_secrets(spark, hard):
    key, blob = "AKIA" + "Q7" * 9, "Zx9" * 12
    rows = [
        (1, f'é password: "hunter22" {key}', "en", "x"), (2, f"token=abc {'0a' * 15} API_KEY = s3cr3t-value {blob}", "en", "x"),
        (3, f"password=hunter22 {key}", "en", "y"), (4, f"{key} {blob}", "en", "z"), (5, "secret=token: abcdefgh", "en", "x"),
        (6, "x" * 50_000 + f" {key} " + "y" * 50_000, "en", "x"), (6, "no secret here", "en", "x"),
    ]
    docs = spark.createDataFrame([(*r, 5, 6, "n", "r", 7, "s", 8) for r in rows], SHAPE).union(hard)
    scan = secret_scan(docs)
    got = {}
    for r in scan.select("doc_id", spans_text(F.col("base")).alias("base"), spans_text(F.col("found")).alias("found"), "found.verdict").collect():
        got.setdefault(r.doc_id, []).append((r.base, r.found, r.verdict))
    assert ("assign:2:21,access:23:45", "assign:2:21,access:23:45", ["shared", "example"]) in got[1]
    assert any(b == "hex:10:40,assign:41:63" and f == "hex:10:40,assign:41:63" for b, f, _ in got[2])  # the opaque string has two owners
    assert ("", "", []) in got[5] and sorted(b for b, _, _ in got[6]) == ["", "", "access:50001:50023"]
    assert scan.count() == docs.count() and secret_scan(docs.limit(0)).count() == 0
    texts = [r.text for r in redact(docs, scan).filter("doc_id = 1").collect()]
    assert f'é [SECRET]" {key}' in texts
    assert redact(docs, scan).count() == docs.count() and redact(docs, scan).columns == docs.columns


def test_secrets_of_one_text_by_brute_force(spark):
    """Positions, overlaps, counts and cuts next to a plain scan, over block borders and characters of several bytes."""
    rng = np.random.default_rng(7)
    parts = ["é" * 40, "password=hunter22", "token: abc", "AKIA" + "Q7" * 9, "0a" * 15, "Zx9" * 12, "Zx9" * 12 + "AKIA" + "Z" * 20, "\U0001f600\n"]
    parts += ["secret=" + "ab12" * 8, "api_key='" + "f" * 30 + "'", "x" * 700]
    texts = [" ".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in (0, 1, 5, 60, 400)] * 2
    docs = spark.createDataFrame([(i, t, f"l{i}", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    base, uses = {}, {}
    for i, text in enumerate(texts):
        spans = [
            (m.start(), k, m.end(), m.group(group))
            for k, (_, pattern, group, least) in enumerate(BASE)
            for m in re.finditer(pattern, text)
            if len(m.group(group)) >= least
        ]
        base[i] = sorted(spans)
        free = [(m.start(), 3, m.end(), m.group()) for m in re.finditer(OPAQUE, text) if all(re.search(c, m.group()) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
        for span in spans + [o for o in free if not any(s < o[2] and o[0] < e for s, _, e, _ in spans)]:
            uses.setdefault(span[3], []).append((i, span))
    scan = secret_scan(docs).cache()
    for r in scan.collect():
        found = sorted((*span[:3], value) for value, all_ in uses.items() for i, span in all_ if i == r.doc_id)
        names = [(s, KINDS[k], e) for s, k, e, _ in base[r.doc_id]]
        assert [(s.start, s.kind, s.end) for s in r.base] == names
        told = {(s.start, s.kind): (s.uses, s.documents, s.repositories, s.owners) for s in r.found}
        for s, k, _, value in found:
            rows = {i for i, _ in uses[value]}
            owners = len({i % 3 for i in rows})
            if k < 3 or owners == 1:
                assert told.pop((s, KINDS[k])) == (len(uses[value]), len(rows), len(rows), owners)
        assert not told
    cut = {r.doc_id: r.text for r in redact(docs, scan).collect()}
    hidden = {r.doc_id: [(s.start, s.end) for s in r.found if s.verdict != "example"] for r in scan.collect()}
    for i, text in enumerate(texts):
        out, at = [], 0
        for start, end in hidden[i]:
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        assert cut[i] == "".join(out) + text[at:]


def test_secrets_many_in_one_text(spark):
    text = " ".join(f"token=hunter{i:06d}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text, "en", "x")], "doc_id long, text string, lang string, source string")
    begun = time.time()
    scan = secret_scan(docs)
    assert scan.select(F.size("base")).first()[0] == 100_000
    assert redact(docs, scan).first().text == " ".join(["[SECRET]"] * 100_000)
    assert time.time() - begun < 120


def test_mixing(spark, hard):
    rows = {}
    for r in mixed_sizes(hard).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == 13
    everything = [r for rs in rows.values() for r in rs]
    assert all(0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in everything)
    copies = {}
    for r in mixed(hard).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + len(words(r.text))
    for name, rs in rows.items():
        assert copies.get(name, 0) == sum(r.taken for r in rs)
    assert mixed(hard).columns == hard.columns and mixed(hard.limit(0)).count() == 0 and mixed_sizes(hard.limit(0)).count() == 0


def test_mixing_targets(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.randint(1, 60)), draw.choice("aaaaabcdd")) for i in range(3000)]
    got = mixed_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed=4).collect()
    source = {i: s for i, _, s in rows}
    size, taken, target = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        size[s], target[s] = r.source_size, r.target
        taken[s] = taken.get(s, 0) + r.taken
    want, weight, left = {}, dict(zip("abcd", (1, 2, 3, 1), strict=True)), float(sum(size.values()))
    free = set(size)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        free -= over
    want |= {s: level * weight[s] for s in free}
    assert all(math.isclose(target[s], want[s], rel_tol=1e-12) and abs(taken[s] - want[s]) <= 60 for s in size)


@pytest.mark.parametrize("shared", ["one id", "null ids", "equal rows"])
def test_mixing_targets_with_shared_ids(spark, shared):
    """Half the rows of each source share an id, or all are null, or equal: taken words stay near the target."""
    name = {"one id": lambda i, s: 10_000 + ord(s) if i % 2 else i, "null ids": lambda i, s: None, "equal rows": lambda i, s: ord(s)}[shared]
    text = lambda i: " ".join(["w"] * 10 if shared == "equal rows" else [f"w{i}"] * 10)
    rows = [(name(3 * i + k, s), text(3 * i + k), s) for i in range(400) for k, s in enumerate("abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).checkpoint()
    taken = {}
    for r in mixed_sizes(docs).collect():
        taken[r.target] = taken.get(r.target, 0) + r.taken
    assert len(taken) == 3 and all(abs(t - want) <= 10 for want, t in taken.items())
    copies = mixed(docs).groupBy("source").agg(F.sum(F.lit(10)).alias("n")).collect()
    assert sorted(r.n for r in copies) == sorted(taken.values())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, v int, shard int, dim int")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    rows = []
    centres = rng.normal(size=(6, 12))
    for i in range(400):
        c = centres[rng.integers(6)] if rng.random() < 0.6 else rng.normal(size=12)
        rows.append((i, (c + rng.normal(size=12) * rng.choice([0.02, 0.25])).tolist(), int(rng.integers(2))))
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], None), (902, None, 1), (903, [0.0] * 12, 1), (904, [float("nan")] * 12, 1)]
    rows += [(905, [None] + [1.0] * 11, 1), (None, rows[0][1], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), rows[0], (908, [], 1)]
    return vectors(spark, [(*r, 1, 2, 3, 4) for r in rows])


def live_rows(df):
    out = {}
    for r in df.collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            out[r.vec_id] = (np.array(v, float), r.label)
    return out


def cosine(a, b):
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


@pytest.mark.parametrize("shard_rows", [1024, 37])
def test_cover_tree(spark, cloud, shard_rows):
    live = live_rows(cloud)
    links = {i: set() for i in live}
    for a, (x, l) in live.items():
        for b, (y, m) in live.items():
            if a != b and l is not None and l == m and len(x) == len(y) and cosine(x, y) >= 0.93:
                links[a].add(b)
    group = {i: i for i in live}
    for _ in live:
        new = {i: min([group[i], *(group[j] for j in links[i])]) for i in live}
        if new == group:
            break
        group = new
    got = embedding_near_dedup(cloud, shard_rows=shard_rows).collect()
    assert len(got) == cloud.count()
    for r in got:
        if r.vec_id in live:
            assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), group[r.vec_id], group[r.vec_id] == r.vec_id)
        else:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept == (r.vec_id is not None)
    assert embedding_near_dedup(cloud.limit(0)).count() == 0


def nearest(live, k):
    out = {}
    for a, (x, _) in live.items():
        if a % 50 == 0:
            score = sorted((-cosine(x, y), b) for b, (y, _) in live.items() if b != a and len(x) == len(y))
            out[a] = [b for _, b in score[:k]]
    return out


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (1.05, 0.9)])
def test_vantage_points(spark, cloud, factor, least):
    want = nearest(live_rows(cloud), 5)
    got = {}
    for r in nearest_neighbours(cloud, F.col("vec_id") % 50 == 0, factor=factor, shard_rows=90, query_rows=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(want[q]) & set(got[q])) for q in want)
    assert hits >= least * sum(map(len, want.values()))
    if factor == 1:
        assert got == want
    assert nearest_neighbours(cloud.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_toxicity_cuts():
    """A telling word saves as much across the end of a window as anywhere else."""
    draw = random.Random(8)
    filler = " ".join("".join(draw.choice("abcdefghij") for _ in range(7)) for _ in range(80))
    tail = b" wqzkvxpluo \0 qzwvkyxuropltsnm \0"
    shared = " ".join(filler.split()[::3]).encode() + b" "
    model = Distances(shared + b"\1" * len(tail), shared + tail, np.zeros(5), np.ones(5), np.zeros(6), 256)
    for word in ("wqzkvxpluo", "qzwvkyxuropltsnm"):
        texts = [(filler[: 8 * k] + f"{word} " + filler[8 * k :]) for k in range(2, 70)]
        texts += [("x" * j + " " + t) for t in texts for j in range(1, 8)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        saved = model.features(model.compressors(), data, np.append(0, np.cumsum([len(t) for t in texts])))
        assert saved[:, 0].min() >= 3


def test_vantage_points_copies(spark):
    """Thousands of copies and scaled copies of a vector: ties go to the smaller ids."""
    rng = np.random.default_rng(4)
    group = rng.normal(size=64).astype(np.float32)
    ids = rng.permutation(6000).tolist()
    rows = []
    for i in ids:
        v = group if i % 3 == 0 else group * np.float32(rng.uniform(0.2, 3)) if i % 3 == 1 else rng.normal(size=64)
        rows.append((i, np.float32(v).tolist(), 0, 1, 2, 3, 4))
    rows += [(i, np.float32(group + 0.01 * rng.normal(size=64)).tolist(), 0, 1, 2, 3, 4) for i in (3, 3, 50, 50)]
    id_of, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def added(a, b):
        return np.add.accumulate(a * b, axis=-1)[..., -1]

    got = {}
    found = nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 50 == 0, shard_rows=2000)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    norm = np.sqrt(added(x, x))
    want = {}
    for q in np.flatnonzero(id_of % 50 == 0):
        score = added(x[q][None], x) / (norm[q] * norm)
        for j in np.lexsort((id_of, -score))[:30].tolist():
            if id_of[j] != id_of[q]:
                one = want.setdefault(int(id_of[q]), {})
                one[int(id_of[j])] = max(one.get(int(id_of[j]), -2), float(score[j]))
    assert got == {q: sorted(s.items(), key=lambda t: (-t[1], t[0]))[:5] for q, s in want.items()}


def test_html(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>site</header><nav><a href=x>home</a></nav>"
        "<div class='cookie notice'>accept</div><article><h1>A &amp; b</h1><p>one  <b>two</b>\nthree<p>four &lt;five&gt;</p>"
        "<ul><li>six<li>seven</ul><script>var x='<p>no</p>'</script><!-- <p>no</p> --></article>"
        "<div id=comments><p>reader text that is long enough to look like an article</p></div><footer>&copy; me</footer></body></html>"
    )
    assert main_text(page) == "A & b\none two three\nfour <five>\nsix\nseven"
    assert main_text("<div>" * 5000 + "deep") == "deep" and main_text("plain") == "plain" and main_text("<p><b>open") == "open"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "word " * 200_000 + "</p>")]
    got = extract_main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 41, 41, 999_999] and all(len(r.text) == r.n_chars for r in got)


def test_html_articles(spark):
    """The articles of the given pages, cut out by their own tags."""
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert main_text(r.html) == "\n".join(b for b in blocks if b)


def paragraphs(n: int, size: int, mark: str) -> list[str]:
    return [f"{mark}{i} ".ljust(size, "x") for i in range(n)]


@pytest.mark.parametrize("around", ["<article>{}</article>", "<body><main>{}</main></body>", "<div>{}</div>", "{}"])
def test_html_keeps_short_parts(around):
    """Headings and short blocks stay beside a wrapped body, a longer section, a long list and a long table."""
    nav = "<nav><a href=x>home</a> <a href=y>more of it</a></nav>"
    long, short = paragraphs(5, 300, "a"), paragraphs(6, 90, "b")
    items, cells = [f"item {i}" for i in range(90)], [f"cell {i}" for i in range(200)]

    def ps(texts: list[str]) -> str:
        return "".join(f"<p>{t}</p>" for t in texts)

    h1, title = "<h1>The title of twenty-eight let</h1>", ["The title of twenty-eight let"]
    rows = "".join(f"<tr><td>{c}</td></tr>" for c in cells)
    for inner, want in [
        (f"{h1}<div class=body>{ps(long)}</div>", title + long),
        (f"{h1}<section>{ps(long)}</section><section><h2>Next</h2>{ps(short)}</section>", [*title, *long, "Next", *short]),
        (f"{h1}{ps(short)}<ul>{''.join(f'<li>{i}' for i in items)}</ul>{ps(long)}", title + short + items + long),
        (f"{h1}{ps(short)}<table>{rows}</table>{ps(long)}", title + short + cells + long),
    ]:
        for page in (around.format(inner), nav + around.format(inner) + "<footer>end</footer>"):
            assert main_text(page).split("\n") == want


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>", "<div><div>{}</div></div>", "{}"])
def test_html_loose_text(around):
    """Lines parted by br stay beside a block element, in front of it and after it."""
    lines = paragraphs(30, 100, "line")
    quote = "quoted ".ljust(200, "q")
    page = "<br>".join(lines[:20]) + f"<blockquote><p>{quote}</p></blockquote>" + "<br>\n".join(lines[20:])
    want = [" ".join(lines[:20]), quote, " ".join(lines[20:])]
    assert main_text("<nav><a href=x>home</a></nav>" + around.format(page)).split("\n") == want


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "content-with-sidebar", "social-science", "page sidebar", "comments"])
def test_html_marked_wrapper(name, tag):
    """A wrapper named like furniture keeps the page's text; furniture beside and inside still goes."""
    texts = paragraphs(5, 300, "a")
    inner = f"<{tag}>{''.join(f'<p>{t}</p>' for t in texts)}<div class=share>share it</div></{tag}>"
    page = f"<nav>home</nav><div class='{name}'><div id=sidebar>aside of it</div>{inner}</div><div class=ads>buy</div>"
    assert main_text(page).split("\n") == texts


def test_html_marked_parts():
    """Part of an article, comments that outgrow it and teasers."""
    texts, more = paragraphs(5, 300, "a"), paragraphs(3, 200, "b")
    section = f"<section class='social-science no-ads'>{''.join(f'<p>{t}</p>' for t in more)}</section>"
    article = f"<article>{''.join(f'<p>{t}</p>' for t in texts)}{section}</article>"
    comments = "<div class=comments-area>" + f"<article><p>{'c' * 400}</p></article>" * 20 + "</div>"
    related = "<div class='related-posts'>" + f"<article><p>{'r' * 80}</p></article>" * 3 + "</div>"
    social = "<div class=social-links><p>follow</p></div><div class='social'><p>us</p></div>"
    assert main_text(article + comments + related + social).split("\n") == texts + more


def test_html_names_within_an_article():
    """A class word in a longer name, or of a part of the article, is no furniture."""
    parts = ["<p class='related-work'>work</p>", "<div class='notice-period'>period</div>", "<h2 class='section-banner'>head</h2>", "<div class='menu'>soup</div>"]
    page = "<article><p>" + "a" * 300 + "</p>" + "".join(parts) + "<div class=ad>buy</div><div class='share-buttons'>share</div></article>"
    assert main_text(page).split("\n") == ["a" * 300, "work", "period", "head", "soup"]


def test_html_comments_never_win():
    own, foreign = "<p>" + "a" * 300 + "</p>", "<article><p>" + "c" * 1200 + "</p></article>"
    for page in (
        f"<article>{own}</article><section id=comments>{foreign}</section>",
        f"<div id=content>{own}</div><div class='comments'>{foreign}</div>",
        f"<div id=content>{own}</div><div class='comments'><p>{'c' * 1200}</p></div>",
        f"<main>{own}<div class='comment-list'>{foreign}</div></main>",
    ):
        assert main_text(page) == "a" * 300


def test_html_formulas_and_open_controls():
    formula = "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><svg><text>drawn</text></svg>"
    assert main_text(f"<article>{formula}</article>").split("\n") == ["so x=2 holds", "drawn"]
    for control in ("<button>go", "<select><option>one<option>two", "<object data=x>no"):
        assert main_text(f"<article><p>a {control}</p><p>b</p></article>").split("\n") == ["a", "b"]
        assert main_text(f"<div>a{control}<p>rest of it</p></div>").split("\n") == ["a", "rest of it"]
    assert main_text("<p>a <button>x</button>b <select><option>1</select>c</p>") == "a b c"


def test_html_time_grows_with_the_page():
    """Nested and unmatched tags: ten times the tags take about ten times as long."""
    import time

    def took(n: int) -> float:
        started = time.perf_counter()
        assert main_text("<div>" * n + "deep" + "</span></section>" * n) == "deep"
        return time.perf_counter() - started

    took(1000)
    assert took(100_000) < 20 and took(100_000) < 40 * max(took(10_000), 0.05)


def test_html_two_articles():
    long, short = paragraphs(5, 300, "a"), paragraphs(2, 60, "b")
    page = "<div>{}</div><div><a href=x>one link</a></div><div>{}</div>".format(
        *("<article>" + "".join(f"<p>{t}</p>" for t in ts) + "</article>" for ts in (long, short))
    )
    assert main_text(page).split("\n") == long + short


@pytest.fixture(scope="module")
def ranks():
    tokenizers = pytest.importorskip("public_tokenizers")
    return load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")), tokenizers.PATTERN


def test_bpe(spark, hard, ranks):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=ranks[1], mergeable_ranks=ranks[0], special_tokens={})
    encoder, draw = Encoder(*ranks), random.Random(1)
    for n in (0, 1, 2, 3, 31, 64, 65, 300, 5000):
        for letters in ("ab", "etaoin shrdlu", "é漢ä\n\t 1", "aé\U0001f600"):
            text = "".join(draw.choice(letters) for _ in range(n))
            ids = encoder.encode([text])[0]
            assert ids.tolist() == own.encode_ordinary(text) and encoder.decode(ids).decode() == text
    rows = bpe_round_trip(hard, *ranks).collect()
    texts = {r.doc_id: r.text for r in hard.collect()}
    assert len(rows) == 13
    for r in rows:
        if r.doc_id is not None:
            assert list(r.ids) == own.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    assert bpe_round_trip(hard.limit(0), *ranks).count() == 0


def slow_tree(train: list[bytes], text: bytes, depth: int) -> float:
    """Context-tree weighting straight from its recursion, for a tiny alphabet."""
    from math import lgamma, log, log10

    def walk(t):
        padded = b"\0" * depth + t
        for i in range(len(t)):
            node = 1
            for k in range(8):
                bit = t[i] >> (7 - k) & 1
                yield padded[i : i + depth], node, bit
                node = node * 2 + bit

    counts = {}
    for t in train:
        for context, node, bit in walk(t):
            for d in range(depth + 1):
                counts.setdefault((context[depth - d :], node), [0, 0])[bit] += 1
    known = {(c, n) for c, n in counts}

    def estimate(key):
        a, b = counts[key]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - 2 * lgamma(0.5)

    def weighted(key):
        c, n = key
        if len(c) == depth:
            return estimate(key)
        below = sum(weighted((bytes([x]) + c, n)) for x in range(256) if (bytes([x]) + c, n) in known)
        return log(0.5) + np.logaddexp(estimate(key), below)

    total, cache = 0.0, {}
    for context, node, bit in walk(text):
        p, rest, final = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            key = (context[depth - d :], node)
            if key not in known:
                break
            one = (counts[key][1] + 0.5) / (sum(counts[key]) + 1)
            final = p + rest * one
            if d < depth:
                if key not in cache:
                    cache[key] = np.exp(estimate(key) + log(0.5) - weighted(key))
                p, rest = p + rest * cache[key] * one, rest * (1 - cache[key])
        total += log10(final if bit else 1 - final)
    return total


@pytest.mark.parametrize("options", [{}, {"head_words": 2, "broadcast_grams": 1}])
def test_context_tree(spark, hard, options):
    draw = random.Random(9)
    rows = [(i, " ".join(draw.choice(["ab", "ba", "Abc", "c"]) for _ in range(draw.randint(0, 12)))) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.col("doc_id") % 4 != 0
    got = {r.doc_id: r for r in context_tree_scores(docs, learn, depth=2, **options).collect()}
    clean = {i: (" ".join(words(t)) + "\n").encode() for i, t in rows}
    train = [clean[i] for i, _ in rows if i % 4]
    counts = {}
    for i, t in rows:
        for w in [*words(t), None] if i % 4 else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, slow_tree(train, clean[i], 2), rel_tol=1e-9)
    if not options:
        assert context_tree_scores(hard, F.col("doc_id") % 2 == 0).count() == 13
        assert context_tree_scores(hard.limit(0), F.lit(True)).count() == 0
        none = context_tree_scores(docs, F.lit(False)).collect()
        assert all(math.isclose(r.score, -8 * len(clean[r.doc_id]) * math.log10(2)) for r in none)


def remainder(row_id: int, mod: int) -> int:
    return zlib.crc32(str(row_id).encode()) % mod


def test_classifiers(spark):
    """Held-out accuracy on the given labels."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    marks = {r.doc_id: r for r in labels.collect()}
    learned = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    scores = {r.doc_id: r for r in quality_scores(docs, learned).collect()}
    held = [i for i in marks if remainder(i, 3) == 1]
    assert np.mean([scores[i].predicted == marks[i].quality for i in held]) > 0.9
    learned = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    scores = {r.doc_id: r for r in toxicity_scores(docs, learned).collect()}
    held = [i for i in marks if remainder(i, 5) == 0]
    assert np.mean([scores[i].predicted == marks[i].toxic for i in held]) > 0.85


def test_classifier_hard_rows(spark, hard):
    labels = spark.createDataFrame([(1, 1, 1), (6, 0, 0), (2, None, None), (8, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for rows in (quality_scores(hard, labels), toxicity_scores(hard, labels), quality_scores(hard, labels.limit(0)), toxicity_scores(hard, labels.limit(0))):
        got = rows.collect()
        assert len(got) == 13 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality_scores(hard.limit(0), labels).count() == 0 and toxicity_scores(hard.limit(0), labels).count() == 0


def test_sha_of_nothing(spark, hard):
    empty = secret_scan(hard).select(F.sha2(spans_text(F.col("base")), 256).alias("h")).distinct().collect()
    assert [r.h for r in empty] == [hashlib.sha256(b"").hexdigest()]
