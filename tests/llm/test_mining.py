"""Collocations, packing and hard negatives against brute force, with nulls, ties, repeats, long texts and empty tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldglass.llm import collocations, hard_negatives, packing
from fieldglass.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
CLASHES = ("phrase", "size", "n", "a", "rank", "score", "piece", "uid", "group", "full", "sequence_id", "length", "anchor", "shelf", "kind", "anchor_id", "words")


def clashing(frame):
    return frame.withColumns({c: F.lit("clash") for c in CLASHES if c not in frame.columns})


# -- collocations ----------------------------------------------------------------------------

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases(rows, threshold, most=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(_LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    frequent = {k: a for k, a in f.items() if a >= threshold and len(k[1]) > 1}
    covered = set()
    for (lang, words), a in frequent.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = (lang, words[i:i + size])
                if a >= f[part]:
                    covered.add(part)
    out = []
    for lang in n:
        scored = []
        for (other, words), a in frequent.items():
            if other == lang and (other, words) not in covered:
                score, cut = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
                scored.append((-score, -a, " ".join(words).encode(), f[lang, words[:cut]], f[lang, words[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(frame, **settings):
    found = collocations.mine_collocations(frame, **settings)
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["New", "york", "is", "a", "big", "city", "x\x00y", "dé", "日本", "-", "\x1c", "\xa0", "it's", " z"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "; new york city "]) for _ in range(rng.randint(0, 60)))
        rows.append((i, rng.choice(["en", "de", None, "und", ""]), text))
    rows += [(500, "en", None), (501, None, None), (502, "fr", ""), (503, "en", " .. \n"), (504, "en", "big city " * 4000), (504, "en", "big city " * 4000), (505, "fr", "q" * 200_000)]
    return rows


@pytest.mark.parametrize("threshold", [1, 7, 40])
def test_collocations_equal_brute_force(spark, prose, threshold, monkeypatch):
    monkeypatch.setattr(collocations, "PART_MASS", 900)
    frame = clashing(spark.createDataFrame(prose, "doc_id int, lang string, text string").repartition(5))
    want = phrases([(r[1], r[2]) for r in prose], threshold, top=50)
    assert mined(frame, threshold=threshold, top=50) == want and want


def test_frequent_phrases_survive_small_summaries_and_blocks(spark, prose):
    rows = spark.createDataFrame([(r[1] or "und", r[2] or "") for r in prose], "lang string, text string").repartition(4)
    mass = 5 * collocations.word_counts(rows).agg(F.sum("n")).first()[0]
    whole = {tuple(r) for r in collocations.frequent_phrases(rows, mass, 9).collect()}
    cut = {tuple(r) for r in collocations.frequent_phrases(rows, mass, 9, part_mass=500, block_words=40, exact_block_words=25).collect()}
    assert whole == cut and whole


def test_misra_gries_keeps_the_guarantee():
    rng = np.random.default_rng(4)
    for _ in range(20):
        stream = np.minimum(rng.zipf(1.2, 5000), 400).astype(np.uint64)
        threshold = int(rng.integers(20, 200))
        capacity = len(stream) // threshold + 1
        summary = collocations.MisraGries(capacity)
        for part in np.array_split(stream, int(rng.integers(1, 30))):
            summary.merge(*collocations.counted(part))
        truth = Counter(stream.tolist())
        kept = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
        assert len(kept) <= capacity and summary.error < threshold
        assert all(truth[k] - summary.error <= c <= truth[k] for k, c in kept.items())
        assert all(k in kept for k, c in truth.items() if c >= threshold)


def test_counts_pass_through_their_packing():
    keys = np.array([1, 2**39, 2**40 - 1], np.uint64)
    counts = np.array([254, 255, 10**12])
    got = collocations.unpacked(*collocations.packed(keys, counts))
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == counts.tolist()


def test_collocations_of_nothing(spark):
    assert mined(spark.createDataFrame([], "doc_id int, lang string, text string")) == []
    assert mined(spark.createDataFrame([(1, None, None), (2, "en", "a b")], "doc_id int, lang string, text string")) == []


def test_large_products_are_exact(spark):
    row = spark.createDataFrame([(3_000_000_000_000, 25_000_000_000_000, 3_000_000_000_001, 3_000_000_000_007)], "a long, n long, l long, r long")
    whole = "cast({} as decimal(17, 0))"
    got = row.selectExpr(f"(cast(1000 as decimal(4, 0)) * {whole.format('a')} * {whole.format('n')}) div ({whole.format('l')} * {whole.format('r')}) AS s").first()["s"]
    assert got == 1000 * 3_000_000_000_000 * 25_000_000_000_000 // (3_000_000_000_001 * 3_000_000_000_007)


# -- packing ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_chunks_encode_like_whole_texts(tokenizer):
    rng = random.Random(3)
    alphabet = list("abC'sStTdD .,;!\t\n\r\x0b\x0c\x1c\x1f\x85\xa0 é́İΣß中0123_-²×") + ["<|endoftext|>", "<|startoftext|>", "don't ", "ŉ", "ſ", "̀", "ᄀ", "ᅡ", "'RE"]
    known = packing.ChunkIds(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(known.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(rows, found, tokenizer, capacity):
    pieces = Counter()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), capacity):
            cut = ids[start:start + capacity]
            pieces[doc_id, start // capacity, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == pieces
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in found) // capacity)


@pytest.mark.parametrize("group", [30, 4096])
def test_packing(spark, tokenizer, group):
    rng = random.Random(7)
    rows = [(i, "word " * rng.choice([1, 2, 3, 5, 8, 13, 21, 34, 40, 63, 64, 65, 200])) for i in range(400)]
    rows += [(900, None), (901, ""), (None, "nobody"), (None, "nobody"), (7, "again and again"), (902, "a" * 5000), (903, "w " * 64)]
    frame = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    found = packing.pack_documents(frame, capacity=64, group_pieces=group).collect()
    used, least = check_packing(rows, found, tokenizer, 64)
    assert used <= least * 1.03 + 1


def test_packing_where_nothing_fits_together(spark, tokenizer):
    rows = [(i, "word " * 40) for i in range(50)]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=64, group_pieces=8).collect()
    assert check_packing(rows, found, tokenizer, 64)[0] == 50
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_local_search_only_raises_the_squares():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(1, 90) for _ in range(rng.randint(1, 60))]
        bins = [[i] for i in range(len(lengths))]
        search = packing.LocalSearch(lengths, bins, 100)
        before = sum(f * f for f in search.fill)
        while search.sweep():
            now = sum(f * f for f in search.fill)
            assert now > before and max(search.fill) <= 100
            before = now
        left = [b for b in search.bins if b]
        assert sorted(i for b in left for i in b) == list(range(len(lengths)))
        assert len(left) <= -(-sum(lengths) // 100) * 1.4 + 1


def test_packing_query(spark, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check_packing(rows, QUERIES["op12_packing"](spark, SMALL).collect(), tokenizer, 2048)
    assert used <= least + 1


# -- hard negatives --------------------------------------------------------------------------

def negatives(rows, is_anchor, k=5):
    """rows: (id, label, whole-number vector), one per id."""
    out = []
    for a, la, va in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-int(np.dot(va, v)), i, lb == la) for i, lb, v in rows if i != a)
        for p, pid, _ in [x for x in scored if x[2]][:k]:
            window = [(s, i) for s, i, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(a, pid, rank, i, -p, -s) for rank, (s, i) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "ties", "noise"])
def test_hard_negatives_equal_brute_force(spark, kind):
    rng = np.random.default_rng(12)
    n, d = 400, 6
    if kind == "clusters":
        centres = rng.normal(size=(12, d))
        vectors = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.05
    elif kind == "ties":
        vectors = rng.integers(-1, 2, (n, d)) / 64
        vectors[: n // 3] = vectors[0]
    else:
        vectors = rng.normal(size=(n, d)) * rng.uniform(0, 3, (n, 1))
    vectors = vectors.astype(np.float32)
    labels = rng.integers(0, 4, n)
    rows = [(i, int(labels[i]), [float(x) for x in vectors[i]]) for i in range(n)]
    odd = [(1000, None, [1.0] * d), (1001, 1, None), (1002, 1, [float("nan")] * d), (1003, 1, [float("inf")] * d), (1004, 1, [None] * d), (None, 1, [1.0] * d), rows[3], (rows[5][0], 9, rows[5][2])]
    frame = clashing(spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").repartition(4))
    found = hard_negatives.mine_hard_negatives(frame, F.col("vec_id") % 20 == 0, shelf_rows=90, slice_anchors=7)
    got = sorted(tuple(r) for r in found.collect())
    whole = [(i, label, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, label, v in rows]
    want = negatives(whole, lambda i: i % 20 == 0)
    assert got == want and (want or kind == "clusters")


def test_hard_negatives_of_little(spark):
    schema = "vec_id long, label int, embedding array<float>"
    run = lambda rows: hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 2 == 0).collect()
    assert run([]) == [] and run([(0, 1, [1.0])]) == [] and run([(0, 1, [1.0]), (1, 1, [1.0])]) == []
    assert [tuple(r) for r in run([(0, 1, [1.0]), (1, 1, [1.0, 5.0]), (3, 2, [0.9])])] == [(0, 1, 1, 3, 256 * 256, 256 * 230)]
    assert run([(0, 1, []), (1, 1, []), (3, 2, [])])[0]["positive_score"] == 0


def test_cover_trees_skip_nodes():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 300
    vectors = np.round(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 8)) * 5).astype(np.int64)
    trees = hard_negatives.CoverTrees(np.arange(6000), np.zeros(6000, np.int64), vectors)
    seen = []
    exact = trees.products
    trees.products = lambda rows, anchor: seen.append(len(rows)) or exact(rows, anchor)
    least, most = trees.bounds(vectors[:1].astype(float))
    scores = vectors @ vectors[0]
    for node, low, high in zip(trees.nodes, least[0], most[0]):
        if len(node.block):
            assert low <= scores[node.block].min() and scores[node.block].max() <= high
    trees.search(vectors[0], 0, 0, None, [(-(1 << 63), (1 << 63) - 1)], 5, least[0], most[0])
    assert sum(seen) < 3000
