"""Every registered corpus query on the supplied tables, against plain Python or SQL."""

from __future__ import annotations

import hashlib
import zlib

import brute_corpus as brute
import numpy as np
import pytest
from compare import assert_same
from conftest import DATA

import corpus_pipeline
from stagetrail.llm import queries
from stagetrail.llm.common import table
from stagetrail.llm.oracle import SQL

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.WORD_BPE)
    t.encode_special_tokens = True
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in docs}


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_sql(spark, name, scale):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "pages", "documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{scale}/{t}.parquet'")
    assert_same(queries.QUERIES[name](spark, f"{DATA}/{scale}"), con, SQL[name])


def test_quality(spark, docs):
    rows = {r.doc_id: r for r in queries.op1_robust_outliers(spark, SF).collect()}
    for i, text in docs:
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_counts(text)
        assert not (r.base_failed and r.kept)


def test_quality_verdicts(spark):
    """Distances and verdicts of every row against a dense estimate of the pool that judges it."""
    from collections import Counter

    from stagetrail.llm import quality

    rows = [r.asDict() for r in quality.judged(table(spark, SF, "documents")).select("doc_id", "lang", "source", "quality.*").collect()]
    passed = [r for r in rows if not r["base_failed"]]

    def vector(r):
        n, lines = max(1, r["n_words"]), max(1, r["n_lines"])
        made = (np.log(n), np.log(max(1, r["word_chars"]) / n), np.log1p(r["n_symbols"] * 10 / n), r["n_dup_lines"] / lines, r["n_repeat_words"] / n)
        return [int(np.floor(v * 1024 + 0.5)) for v in made]

    sizes = Counter((r["lang"], r["source"]) for r in passed), Counter(r["lang"] for r in passed)

    def pool(r):
        if sizes[0][r["lang"], r["source"]] >= 50:
            return r["lang"], r["source"]
        return (r["lang"],) if sizes[1][r["lang"]] >= 50 else ()

    assert len({pool(r) for r in passed}) > 1
    for key in {pool(r) for r in passed}:
        members = [r for r in passed if (r["lang"], r["source"])[: len(key)] == key]
        distances = brute.robust_distances([vector(r) for r in members])
        for r, d in zip(members, distances, strict=True):
            if pool(r) == key:
                assert r["distance"] == pytest.approx(d, rel=1e-6) and r["kept"] == (d <= quality.FAR)


def test_scores(spark, docs):
    rows = {r.doc_id: r for r in queries.op3_context_mixing(spark, SF).collect()}
    for i, (held, n, known, total, base) in brute.word_scores(docs).items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_packing(spark, ids):
    rows = queries.op4_best_fit(spark, SF).collect()
    pieces = {(i, p // 2048): (p, x[p : p + 2048]) for i, x in ids.items() for p in range(0, len(x), 2048)}
    told = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    assert told == {k: (p, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, (p, x) in pieces.items()}
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_pii(spark, docs):
    rows = {r.doc_id: r for r in queries.op5_pii(spark, SF).collect()}
    for i, text in docs:
        told = brute.base_spans(text)
        assert rows[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in brute.KINDS] == [told.count(f"{k}:") for k in brute.KINDS]


def test_leaks(spark, docs):
    items = {r.item_id: brute.item_windows(r.text) for r in table(spark, SF, "benchmark").collect()}
    expected = set()
    for i, text in docs:
        own = brute.item_windows(text or "")
        expected |= {(i, k) for k, w in items.items() if w and len(own & w) >= 0.8 * len(w)}
    assert {(r.doc_id, r.item_id) for r in queries.op7_template_leaks(spark, SF).collect()} == expected


def test_repeats(spark, docs):
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_suffix_arrays(spark, SF).collect()}
    assert rows == dict(zip([i for i, _ in docs], brute.repeats([t for _, t in docs]), strict=True))


def test_near_copies(spark, docs):
    rows = {r.doc_id: r.class_id for r in queries.op9_bagminhash(spark, SF).collect()}
    assert rows == brute.near_classes(docs)


def test_lengths(spark, ids):
    lengths = np.array([len(x) for x in ids.values()])
    rows = queries.op10_length_histogram(spark, SF).collect()
    assert {r.length for r in rows} == set(lengths.tolist())
    for r in rows:
        cut = np.minimum(lengths, r.length)
        assert (r.docs_at_least, r.docs_below) == ((lengths >= r.length).sum(), (lengths < r.length).sum())
        assert (r.tokens_at_least, r.truncated_total, r.tokens_cut) == (lengths[lengths >= r.length].sum(), cut.sum(), (lengths - cut).sum())


def test_pipeline(spark, docs):
    """Stage by stage, what each keeps, from plain Python."""
    import re

    now = table(spark, SF, "documents")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], now.columns
    assert len(names) == 5
    left = dict(docs)
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        rows = now.collect()
        now = spark.createDataFrame(rows, now.schema)
        if name == "quality_rules":
            n = {i: brute.base_counts(t) for i, t in left.items()}
            left = {i: t for i, t in left.items() if not n[i][5] and n[i][2] < 0.2 * n[i][0]}
        elif name == "near_copies":
            classes = brute.near_classes(left.items())
            left = {i: t for i, t in left.items() if classes[i] == i}
        elif name == "benchmark_leaks":
            items = [w for r in table(spark, SF, "benchmark").collect() if (w := brute.item_windows(r.text))]
            left = {i: t for i, t in left.items() if not any(len(w & brute.item_windows(t)) >= 0.8 * len(w) for w in items)}
        elif name == "personal_data":
            assert any(r.text != left[r.doc_id] for r in rows)
            for r in rows:
                assert not any(ok(m.group()) for k, (p, ok) in brute.KINDS.items() for m in re.finditer(p, r.text))
                assert r.text == left[r.doc_id] or r.n_chars == len(r.text)
                left[r.doc_id] = r.text
        if name != names[-1]:
            assert now.columns == columns
        assert {r.doc_id for r in rows} == set(left)
