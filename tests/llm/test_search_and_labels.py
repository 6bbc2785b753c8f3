"""Hard negatives, toxicity and lexical search: against SQL, plain Python and hand-made cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from stagetrail.llm import lexical, negatives, queries, toxicity

VECTORS = "vec_id long, embedding array<float>, label int"
CLASH = ("entry", "vector", "ids", "cluster", "g", "rows", "score", "anchor", "anchor_id", "place", "term", "n", "counts", "rank", "hash", "slots")


def clashing():
    return {c: F.lit("x") for c in CLASH}


def brute_negatives(rows, every=2):
    rows = {(i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for anchor in rows:
        if anchor[0] % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(anchor[2], r[2])), r[0], r) for r in rows if r != anchor)
        for s, i, _ in [x for x in scored if x[2][1] == anchor[1]][:5]:
            band = [(t, j) for t, j, r in scored if r[1] != anchor[1] and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(anchor[0], i, k + 1, j, -s, -t) for k, (t, j) in enumerate(band[:3])]
    return sorted(out)


def mined(spark, rows, **how):
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).withColumns(clashing()), F.col("vec_id") % 2 == 0, **how)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("clusters,block", [(1, 1000), (3, 4), (8, 16)])
def test_negatives(spark, clusters, block):
    r = random.Random(clusters)
    middles = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in middles[i % 4]], r.randrange(3)) for i in range(150)]
    # Copies under several labels, a repeated row, an id with two vectors, a zero vector, a short one, and unusable rows.
    rows += [(200 + i, rows[7][1], i % 2) for i in range(40)] + [rows[4], (6, rows[9][1], 1), (300, [0.0] * 6, 1), (302, [1.0], 2), (304, [], 0)]
    rows += [(None, rows[0][1], 1), (306, None, 1), (308, [1.0, None], 1), (310, [float("nan")] * 6, 1), (312, [float("inf")] * 6, 1), (314, rows[0][1], None)]
    assert mined(spark, rows, clusters=clusters, block=block) == brute_negatives(rows)


def test_walks_end_before_the_list(spark, monkeypatch):
    """Tight clusters: a member must not score what its bound excludes, and still find all."""
    r = random.Random(5)
    rows = [(i, [(8 if k == i % 8 else 0) + r.gauss(0, 0.1) * (1 + i % 3) for k in range(8)], i % 3) for i in range(400)]
    steps = []
    met = negatives._met
    monkeypatch.setattr(negatives, "_met", lambda m, b, *a: steps.append((m.count(), b.count())) or met(m, b, *a))
    assert mined(spark, rows, clusters=8, block=8) == brute_negatives(rows)
    # Positives are found in the first blocks, of eight lists with 50 blocks each.
    assert sum(b for _, b in steps[:4]) < 8 * 50


def test_no_vectors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (3, [2.0], 2)]) == []
    assert mined(spark, [(2, [1.0], 1)]) == []


def brute_search(docs, items, best=50):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n, length = len(found), sum(x[2] for x in found)
    df, wanted, out = Counter(t for _, c, _ in found for t in c), defaultdict(set), []
    for i, t in items:
        wanted[i] |= set(terms(t))
    for item, some in wanted.items():
        scored = []
        for i, c, size in found:
            m = 50 + 50 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in some & set(c))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize("term_bytes", [1 << 20, 100])
def test_search(spark, monkeypatch, term_bytes):
    monkeypatch.setattr(lexical, "TERM_BYTES", term_bytes)
    r = random.Random(3)
    words = ["Ab", "ab", "b", "aba", "ÄB", "äb", "x1", "1", "the", "İ", "日本", "é"]
    docs = [(i, "".join(r.choice(words) + r.choice([" ", ", ", "\x00", "-", "\n", "_"]) for _ in range(r.randrange(30)))) for i in range(200)]
    docs += [(900 + i, "the aba ab ab") for i in range(120)] + [(None, "the aba ab ab"), (900, "the aba ab ab"), (901, None), (902, ""), (903, " ..\x7f"), (904, "ab " * 50_000)]
    items = [(1, "AB aba, aba"), (2, "the"), (2, "x1 日本"), (3, None), (4, ""), (5, "missing words"), (None, "äb İ"), (6, "ab-b_1")]
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumns(clashing()), spark.createDataFrame(items, "item_id long, text string").withColumns(clashing()))
    assert sorted((tuple(x) for x in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute_search(docs, items)


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs, items).collect() == []
    assert lexical.ranked(items.withColumnRenamed("item_id", "doc_id"), docs.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_slots_are_those_of_plain_ngrams(monkeypatch):
    texts = ["", "a", "Ab  cd\n e", "stupid Stupid", "日本 語" * 50, "x" * 40]

    def plain(text):
        words = [f" {w} " for w in text.lower().split()]
        return {w[k : k + n] for w in words for n in toxicity.GRAMS for k in range(len(w) - n + 1)}

    def number(gram):
        return int(dict.fromkeys(s for _, some in toxicity._hashed(gram) for s in some[-1:].tolist()).popitem()[0])

    for piece in (toxicity.PIECE, 60):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        for text, slots in zip(texts, toxicity.slot_sets(texts), strict=True):
            assert len(set(slots.tolist())) == len(slots)
            assert set(slots.tolist()) == {number(g) for g in plain(text)}


def test_toxicity_learns(spark):
    r = random.Random(9)
    parts = "la mi so ter con ben dur fal gor hin jas kel".split()
    word = lambda: r.choice(parts) + r.choice(parts) + r.choice(parts)
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(r.choice([5, 40, 400]))]
        bad = i % 8 == 0
        if bad:
            words[r.randrange(len(words))] = "Vileword" + r.choice(["s", "ish", ""])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs += [(None, "vileword"), (5000, None), (5001, ""), (5002, "q" * 1_200_000 + " vileword"), (0, "vileword vileword")]
    labels += [(None, 1), (5001, None), (7000, 1), (3, 0), (3, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns(clashing())
    got = toxicity.scored(frame, spark.createDataFrame(labels, "doc_id long, toxic int").withColumns(clashing())).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    import zlib

    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    known = {i: y for i, y in labels if i is not None and i < 900}
    held = [(known[x.doc_id], x.predicted) for x in got if x.held_out and x.doc_id in known]
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) <= 0.02 * len(held)
    by_id = {x.doc_id: x.score for x in got}
    assert by_id[None] > 0.5 and by_id[5002] > 0.3 and by_id[5000] == by_id[5001] < 0.3


def test_toxicity_does_not_learn_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r.doc_id, round(r.score, 9)) for r in toxicity.scored(docs, y).collect()) for y in (labels, other))
    assert one == two


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0), ([(1, None)], 0.0)])
def test_toxicity_of_one_label(spark, labels, score):
    docs = spark.createDataFrame([(1, "a word"), (2, None)], "doc_id long, text string")
    got = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert [r.score for r in got] == [score] * 2
    assert toxicity.scored(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() == []


def test_toxicity_on_held_out_tables(spark):
    got = {r.doc_id: r for r in queries.op12_ngram_toxicity(spark, f"{DATA}/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").collect()}
    assert len(got) == 1000
    clean = [got[i].predicted for i, y in labels.items() if y == 0 and got[i].held_out]
    assert sum(clean) <= 0.1 * len(clean)
