"""Language models, ranked search and the trie of conversations against brute force and on hard rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm.ball_tree import BallTree, ranked_search
from feedlens.llm.language_kn import char_hashes, gram_hashes, language_scores, letters, train
from feedlens.llm.prefix_trie import conversation_trie, numbered

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    total = sum(sum(b.values()) for _, b in bags)
    count = sum(1 for _, b in bags if b)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, bag in bags:
            n = sum(bag.values())
            m = 50 + (50 * n * count) // max(1, total)
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                for t in wanted if t in bag
            )
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


DOCS = "doc_id long, text string, item_id long, rank int, id int, n long, terms string, shard int, score long"


@pytest.mark.parametrize("options", [{}, {"shard_rows": 7, "leaf_rows": 2}, {"shard_rows": 20, "leaf_rows": 3, "block_bytes": 40}])
def test_ranked_search_brute_force(spark, options):
    draw = random.Random(3)
    vocabulary = [f"t{i}" for i in range(30)] + ["Straße", "ÉTÉ", "日本", "x" * 90, "y" * 70]
    text = lambda n: " ".join(draw.choice(vocabulary) if draw.random() < 0.9 else "A" for _ in range(n))
    docs = [(i, text(draw.choice([1, 3, 9, 40]))) for i in range(130)]
    docs += [(500 + i, "T1 t2, t3!") for i in range(60)]  # ties
    docs += [(7, docs[7][1]), (None, "t1 t2"), (None, None), (900, None), (901, ""), (902, " .,\n"), (903, "t5 " * 20_000)]
    items = [(i, text(6)) for i in range(9)] + [(3, "t29 t28"), (None, "t1 t4"), (50, None), (51, "...")]
    got = ranked_search(
        spark.createDataFrame([(*d, 1, 2, 3, 4, "x", 5, 6) for d in docs], DOCS),
        spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, term string, block int"), k=8, **options,
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 8)


def test_ranked_search_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in ranked_search(docs, items).collect()][0][:3] == (1, 1, 1)


def test_ball_tree_bounds_hold():
    draw = np.random.default_rng(1)
    dense = draw.integers(0, 1000, (300, 40)) * (draw.random((300, 40)) < 0.2)
    dense[50:90] = dense[49]  # equal rows
    rows, cols = np.nonzero(dense)
    tree = BallTree(np.append(0, np.cumsum((dense > 0).sum(axis=1))), cols, dense[rows, cols].astype(float), 40, leaf=5)
    for _ in range(20):
        at = np.sort(draw.choice(40, 6, replace=False))
        weight = draw.random(6) * 100
        upper, exact = tree.upper(at, weight), dense[:, at] @ weight
        seen = []
        bounds = []
        for bound, members in tree.leaves(upper):
            assert exact[members].max() <= bound
            bounds.append(bound)
            seen += members.tolist()
        assert sorted(seen) == list(range(300)) and bounds == sorted(bounds, reverse=True)


# --- languages ------------------------------------------------------------------------------


def test_letters():
    codes, at, counted = letters(["Ab, c!", None, "12 .", "  É"], 2)
    assert "".join(map(chr, codes)) == "  ab c   é "
    assert at.tolist() == [0, 7, 7, 7, 11]
    assert counted.tolist() == [False, False, *[True] * 5, False, False, True, True]


def brute_kneser_ney(words: list[str], order: int):
    """P(char | context) by the textbook formulas over texts that are padded alike."""
    grams = [Counter() for _ in range(order + 1)]
    for text in words:
        padded = " " * (order - 1) + text + " "
        for i in range(order - 1, len(padded)):
            grams[order][padded[i - order + 1 : i + 1]] += 1
    for width in range(order - 1, 0, -1):
        for gram in grams[width + 1]:
            grams[width][gram[1:]] += 1

    def discount(width):
        once, twice = (sum(1 for c in grams[width].values() if c == n) for n in (1, 2))
        return once / (once + 2 * twice) if once else 0.5

    def p(gram):
        width = len(gram)
        if width == 0:
            return 1 / (len(grams[1]) + 1)
        same = {g: c for g, c in grams[width].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        d, total = discount(width), sum(same.values())
        return max(same.get(gram, 0) - d, 0) / total + sum(min(c, d) for c in same.values()) / total * p(gram[1:])

    return p


def test_models_equal_textbook():
    texts = ["abracadabra", "abba", "cabab", "dada abra", "bab"]
    model = train([*texts], ["x"] * 5, 3)
    kept = [t for i, t in enumerate(texts) if i % 3 != 2]
    p = brute_kneser_ney(kept, 3)
    for text in ("abra", "zebra", "dad", "q"):
        padded = "  " + text + " "
        want = -sum(math.log2(p(padded[i - 2 : i + 1])) for i in range(2, len(padded))) / (len(text) + 1)
        bits, n = model.bits(*letters([text], 2))
        assert n[0] == len(text) + 1 and bits[0, 0] == pytest.approx(want)


def test_gram_hashes_differ():
    codes, _, _ = letters(["abab baab"], 4)
    chars, places = char_hashes(codes), np.arange(4, len(codes))
    grams = ["".join(map(chr, codes[p - 2 : p + 1])) for p in places]
    assert len(set(grams)) == len(set(gram_hashes(chars, places, 3).tolist()))


def test_language_of_given_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    got = language_scores(docs, learn).join(docs.select("doc_id", "lang"), "doc_id").filter(~learn).toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.9
    assert ((got.score > 0) & (got.score <= 1)).all()


def test_language_hard_rows(spark):
    rows = [(i, f"the cat and the dog number {'abcdefgh'[i % 8]} sat there", "en") for i in range(12)]
    rows += [(20 + i, f"der hund und die katze {'abcdefgh'[i % 8]} sitzen dort", "de") for i in range(12)]
    hard = [
        (100, None, "en"), (101, "", "en"), (102, "12 + 3 = 15!", "de"), (None, "the cat", None), (103, "THE DOG", None),
        (103, "THE DOG", None), (104, "die katze " * 40_000, "de"), (105, "日本語 日本語", "en"), (106, None, None),
    ]
    shape = "doc_id long, text string, lang string, score double, id int, bits int, h int, n int, learn string"
    docs = spark.createDataFrame([(*r, 0.5, 1, 2, 3, 4, "x") for r in rows + hard], shape)
    got = language_scores(docs, F.col("doc_id") < 50).collect()
    found = {r.doc_id: r for r in got}
    assert len(got) == len(rows + hard)
    for i in (100, 101, 102, 106):
        assert (found[i].lang_pred, found[i].score, found[i].bits, found[i].rejected) == ("und", 0.0, None, False)
    assert found[None].lang_pred == found[103].lang_pred == "en" and found[104].lang_pred == "de"
    assert found[105].lang_pred in ("en", "de") and found[105].rejected
    strict = {r.doc_id: r.lang_pred for r in language_scores(docs, F.col("doc_id") < 50, reject=True).collect()}
    assert strict[105] == "und" and strict[103] == "en"
    assert {r.lang_pred for r in language_scores(docs, F.lit(False)).collect()} == {"und"}
    assert language_scores(docs.limit(0), F.lit(True)).count() == 0


# --- conversations --------------------------------------------------------------------------


def brute_trie(rows, every=20, most=4):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    ordered = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = ordered.get(c - c % every, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for prefix, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", prefix[-1][1])) if prefix else 0
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += kids[prefix] == 0
            saved[prefix[:d]] += cost
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append(
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, p int, conv string, level int, g int"


def _trie_rows(seed: int):
    draw = random.Random(seed)
    rows = []
    for c in range(0, 90):
        for turn in range(draw.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, turn, draw.choice(["user", "bot"]), draw.choice(["hi there", "no", "a b c", "", None])))
    stem = [(t, "user", f"turn {t % 3} of many") for t in range(11)]
    for c in range(100, 160):  # copies, and families that part late
        rows += [(c, *t) for t in stem[: 11 - c % 3]]
        if c % 7 == 0:
            rows.append((c, 50, "bot", f"own {c % 4}"))
    rows += [(200, t, "user", f"long {t}") for t in range(70)]
    rows += [(None, 1, "user", "x"), (300, None, None, None), (300, None, "a", "z"), (300, 1, "a", "z"), (300, 1, "a", "y"), (300, 1, "a", "y")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"width": 4, "shard_rows": 9}, {"width": 2, "shard_rows": 40}, {"width": 3, "shard_rows": 3}])
def test_trie_brute_force(spark, options):
    rows = _trie_rows(len(options))
    got = conversation_trie(spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], TURNS), **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_without_rows(spark):
    assert conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x", 2, 3)], TURNS)).count() == 0


def test_numbers_of_a_spread_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 9).cast("long").alias("conv"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(rows, [F.col("id")]).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for _, part in got.groupby("conv"):
        assert part.sort_values("id").p.tolist() == list(range(len(part)))
