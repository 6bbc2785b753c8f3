"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns, and hand-made cases."""

from __future__ import annotations

import random
import zlib

import brute_corpus as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stagetrail.llm import chat, common, decontam, lengths, mixing, nearcopies, packing, pii, quality, queries, repeats, suffixes, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


LONG = prose(1, 30_000)
ROWS = [
    (1, prose(2, 300), "en", "a", 1),
    (1, prose(2, 300), "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (None, prose(2, 300), None, "a", 1),
    (4, LONG, "en", "b", 1),
    (5, LONG, "en", "b", 1),
    (6, " \n\t ", "en", "b", 1),
    (7, "x" * 5000, "en", "b", 1),
    (8, "1" * 30_000 + " a@" * 500, "en", "b", 1),
]
CLASH = ["row", "kept", "gid", "start", "n", "class", "text_key", "hash", "bin", "found_email", "a", "c", "quality", "_made"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    return docs.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, none, stage):
    sf = "/root/testdata/sf0.001"
    out = stage(spark, odd, sf)
    assert out.collect()
    if stage is not corpus_pipeline.best_fit_packing:
        assert out.columns == odd.columns
    assert stage(spark, none, sf).collect() == []


def test_near_copies_keep_one_row(spark, odd):
    rows = nearcopies.one_of_each(odd).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 4, 7, 8]
    classes = {(r.doc_id, r.class_id, r.class_size) for r in nearcopies.near_classes(odd).collect()}
    assert {(None, 1, 3), (1, 1, 3), (2, 2, 3), (3, 2, 3), (6, 2, 3), (5, 4, 2)} <= classes


def test_columns_of_any_type(spark):
    docs = spark.createDataFrame([(1, prose(3, 90), "en", "a"), (2, prose(3, 90), "en", "a"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("facts", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("more", F.array(F.create_map(F.lit(1), F.lit(2))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.dtypes == docs.dtypes, name
        assert {r.doc_id for r in out.collect()} == ({1, 3} if name == "near_copies" else {1, 2} if name == "quality_rules" else {1, 2, 3}), name


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    texts = [b"a" * n for n in (5, 5, 30, 1, 1, 1, 0, 0, 9)]
    whole = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["id", "text"])
    parts = list(common.batches_of_bytes([whole.slice(1)], 1, 10, 3))
    assert [b.column(0).to_pylist() for b in parts] == [[1], [2], [3, 4, 5], [6, 7, 8]]


def test_near_copies_of_a_large_group(spark):
    """Edited copies of one text: the leader brings most together, the rest is found by the bound."""
    base = prose(5, 120).split()
    rows = []
    for i in range(150):
        r = random.Random(i)
        some = list(base)
        for _ in range(r.randrange(9)):
            some[r.randrange(len(some))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(some[: r.choice([120, 118, 110])])))
    found = {r.doc_id: r.class_id for r in nearcopies.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute.near_classes(rows)


def test_signature_is_unbiased():
    r = np.random.default_rng(1)
    x = (np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), r.integers(1, 9, 399))
    y = (x[0], np.maximum(1, x[1] + r.integers(-3, 4, 399)))
    made = nearcopies.signatures([x, y], 4000)
    expected = np.minimum(x[1], y[1]).sum() / np.maximum(x[1], y[1]).sum()
    assert abs((made[0] == made[1]).mean() - expected) < 0.04


def test_repeats(spark, odd, none):
    rows = sorted(repeats.repeats_digest(repeats.without_repeats(odd)).collect(), key=str)
    told = brute.repeats([r[1] if r[1] != LONG else "" for r in ROWS])
    expected = [(r[0], *t) for r, t in zip(ROWS, told, strict=True) if r[1] != LONG]
    assert sorted((tuple(r) for r in rows if r.doc_id not in (4, 5)), key=str) == sorted(expected, key=str)
    assert all(r.n_removed == r.n_bytes == len(LONG) for r in rows if r.doc_id in (4, 5))
    assert repeats.without_repeats(none).collect() == []


@pytest.mark.parametrize("group", [1, 5, 1000])
def test_repeats_in_groups_of_any_size(spark, monkeypatch, group):
    """A common line in different surroundings, with part of them in common too."""
    monkeypatch.setattr(repeats, "GROUP", group)
    line = prose(9, 15)
    texts = [prose(20 + i % 7, 12) + " " + line + " " + prose(40 + i % 5, 12) + f" {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: tuple(r)[1:] for r in repeats.repeats_digest(repeats.without_repeats(docs)).collect()}
    assert rows == dict(enumerate(brute.repeats(texts)))


def test_segments_do_not_matter():
    text = (prose(3, 2000) * 2).encode()
    size, found = repeats.SEGMENT, set()
    for _, row, shift, first, last, *_ in repeats._runs([text]):
        found |= {int(i) for f, e, s in zip(first, last, shift) for i in range(f + s, e + s + 1)}
    assert found == set(range(len(text) - 199)) and size > len(text)


@pytest.mark.parametrize("letters", [1, 2, 4, 256])
def test_suffix_array(letters):
    r = random.Random(letters)
    for _ in range(60):
        strings = [bytes(r.randrange(letters) for _ in range(r.randrange(1, 50))) for _ in range(r.randrange(1, 7))]
        strings += [s[len(s) // 2 :] + b"yz" for s in strings]
        times = {}
        for size in (1, 3, 8):
            times = {}
            for s in strings:
                for i in range(len(s) - size + 1):
                    times[s[i : i + size]] = times.get(s[i : i + size], 0) + 1
            for s, found in zip(strings, suffixes.repeated(strings, size), strict=True):
                assert found.tolist() == [times[s[i : i + size]] > 1 for i in range(max(0, len(s) - size + 1))]


def test_quality(spark, odd, none):
    rows = quality.judged(odd, into="verdict").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert tuple(r.verdict)[:5] == brute.base_counts(r.text)[:5] and r.verdict.base_failed == brute.base_counts(r.text)[5]
    assert quality.judged(none).collect() == []


def test_quality_outliers(spark):
    """Bad documents that are a fifth of a group neither move its estimate nor stay."""
    rows = [(i, prose(i, 100 + i % 50) if i % 5 else " ".join(w + "%&#$" for w in prose(i, 100).split()), "en", "s", 0) for i in range(600)]
    kept = {r.doc_id for r in quality.kept_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {i for i in range(600) if i % 5}


def test_quality_of_small_groups(spark):
    """Rows of a rare language and source are judged by their language or by the table."""
    rows = [(i, prose(i, 60 + i % 90), "en", "large") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "#|<" for w in prose(i, 80).split()), "xx", "rare") for i in range(30)]
    rows += [(2000 + i, prose(5000 + i, 100), "en", "small") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.kept_documents(docs).collect()}
    assert kept == {*range(400), *range(2000, 2010)}
    few = quality.judged(docs.filter("lang = 'xx'")).select("quality.*").collect()
    assert len(few) == 30 and all(r.kept and r.distance is None for r in few)


def test_every_statistic_can_reject(spark):
    plain = [(i, "\n".join(prose(100 * i + k, 12) for k in range(8 + i % 5)), "en", "a") for i in range(300)]
    lines = "\n".join([prose(9, 6)] * 1 + [prose(7 + k % 2, 30) + "" for k in range(2)])
    # Short lines of two kinds over and over, between whole ones: few repeated windows, most lines seen before.
    dup = "\n".join([prose(1, 150), *["ab cd"] * 30])
    long_words = "\n".join(" ".join(w * 4 for w in prose(50 + k, 12).split()) for k in range(8))
    long_text = prose(77, 25_000)
    docs = spark.createDataFrame([*plain, (1000, dup, "en", "a"), (1001, long_words, "en", "a"), (1002, long_text, "en", "a"), (1003, lines, "en", "a")], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in quality.judged(docs).select("doc_id", "quality.*").collect()}
    assert all(rows[i].kept for i in range(300))
    for i in (1000, 1001, 1002):
        assert not rows[i].base_failed and not rows[i].kept and rows[i].n_symbols == 0, (i, rows[i])


def test_scores(spark, odd, none):
    rows = mixing.scores(odd).collect()
    assert len(rows) == len(ROWS) and all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert mixing.scores(none).collect() == []


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    # Numbered words and several batches for the weights.
    monkeypatch.setattr(mixing, "VOCABULARY", 40)
    monkeypatch.setattr(mixing, "BATCH", 2000)
    monkeypatch.setattr(mixing, "LEARN", 5000)
    docs = spark.createDataFrame([(i, prose(i % 150, 20 + i % 200)) for i in range(400)], "doc_id long, text string")
    made = [{r.doc_id: r.score for r in mixing.scores(docs.repartition(n, "doc_id")).collect()} for n in (2, 9)]
    assert made[0] == made[1] and len(made[0]) == 400


def test_scores_are_probabilities():
    """Over a tree, the costs of all symbols sum to one."""
    start, length, step, own = mixing.coded(np.array([5, 1, 0, 9, 3]))
    odds = (own.astype(int) - 128) / 16
    total = 0.0
    for s, n in zip(start, length, strict=True):
        p = 1.0
        for x in step[s : s + n]:
            yes = 1 / (1 + np.exp(-odds[x >> 1]))
            p *= yes if x & 1 else 1 - yes
        total += p
    assert total == pytest.approx(1)


def test_words_beyond_the_tree_have_codes(spark, monkeypatch):
    """A word seen twice is a symbol of its own, however many more frequent ones there are; only single words are spelled."""
    monkeypatch.setattr(mixing, "VOCABULARY", 20)
    counts = spark.createDataFrame([(f"w{i}".encode(), 2 + i % 3) for i in range(84)] + [(b"once", 1), (b"", 9)], "word binary, n long")
    model, coded = mixing.frame(counts)
    number = {bytes(r.word): r.number for r in coded.collect()}
    assert sorted(n for n in number.values() if n is not None) == list(range(64)) and model.digits == 6
    assert {w for w, n in number.items() if n is None} == {*model.words, b"once", b""}
    reader = mixing.Decisions(model)
    symbols = np.concatenate([np.arange(model.escape + 3), model.numbered + np.arange(64)]).astype(np.int32)
    length = reader.lengths(symbols)
    step = reader.of(symbols, length)
    odds = (reader.odds(step).astype(int) - 128) / 16
    logp = -np.log1p(np.exp(np.where(step & 1, -odds, odds)))
    assert np.exp(np.add.reduceat(logp, np.cumsum(length) - length)).sum() == pytest.approx(1)
    assert mixing.filled(model, np.array([-1, 3, -1], np.int32), [b"once", b"w"], [None, 5]).tolist() == [
        model.escape, *[len(model.words) + x for x in b"once"], model.escape + 1, 3, model.numbered + 5]


def test_scores_do_not_need_the_tree_for_every_word(spark, monkeypatch):
    rows = [(i, prose(i % 40, 200)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r for r in mixing.scores(docs).collect()}
    monkeypatch.setattr(mixing, "VOCABULARY", 50)
    monkeypatch.setattr(mixing, "BUCKET", 500)
    monkeypatch.setattr(mixing, "BATCH", 3000)
    small = {r.doc_id: r for r in mixing.scores(docs).collect()}
    # Spelled out they cost 5.1 times as much.
    assert sum(r.score for r in small.values()) > 1.5 * sum(r.score for r in whole.values())
    assert all(small[i].n_known == r.n_known and small[i].base_score == pytest.approx(r.base_score) for i, r in whole.items())


def test_contexts_of_all_training_texts_count(spark):
    """What only texts of remainder 9 have in a row is cheaper in that order than in another."""
    by = {k: [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == k] for k in range(10)}
    phrase = prose(70, 60).split()
    other = random.Random(1).sample(phrase, len(phrase))
    rows = [(i, " ".join(random.Random(i).sample(phrase, len(phrase)))) for i in [*by[1], *by[5]]]
    rows += [(i, " ".join(phrase)) for i in by[9]] + [(by[0][0], " ".join(phrase)), (by[0][1], " ".join(other))]
    score = {r.doc_id: r.score for r in mixing.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert score[by[0][0]] > 0.6 * score[by[0][1]]


@pytest.mark.parametrize("remainder", [1, 4, 9])
def test_weights_come_from_all_training_texts(spark, monkeypatch, remainder):
    """Whatever part of the training texts there is, all its decisions are learned on."""
    kept, learn = [], mixing._weights

    def weights(cells):
        kept.append((cells.groupBy().sum("n").first()[0], learn(cells)))
        return kept[-1][1]

    monkeypatch.setattr(mixing, "_weights", weights)
    monkeypatch.setattr(mixing, "LEARN", 300)
    by = [i for i in range(600) if zlib.crc32(str(i).encode()) % 10 == remainder]
    held = next(i for i in range(600) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(i, prose(i % 20, 100)) for i in by] + [(held, prose(3, 100))]
    for times in (1, 2):
        mixing.scores(spark.createDataFrame(rows[:-1] * times + rows[-1:], "doc_id long, text string")).collect()
    (once, made), (twice, _) = kept
    assert (np.abs(made - mixing.BEGIN) > 0.05).any()
    # A word has a decision at least; twice the texts have the same tree but for its marks.
    assert once >= 100 * len(by) and twice == pytest.approx(2 * once, rel=0.05)


def test_weights_without_the_text_itself():
    """What only one text says, however often, counts as unseen there; what others say too does not."""
    model = mixing.Model([b"a", b"b"], np.array([3, 2, 1]), 6, 3, *mixing.coded(np.ones(2 + 256 + 4, np.int64)))
    reader = mixing.Decisions(model)
    context = np.array([5, 6, 7, 7], np.uint64)
    asked = (context, np.array([1, 1, 1, 0], np.int32), np.array([4, 4, 9, 2], np.uint32), np.array([1, 2, 3, 2], np.uint32))
    [(state, others)] = mixing.sided_answers(reader, [asked])
    size = int(reader.lengths(np.array([1]))[0])
    none = np.zeros(1, np.uint32)
    assert (others[:size] == mixing.UNSEEN).all() and (state[:size] == mixing.states(none, none + 4)[0]).all()
    assert (others[size : 2 * size] == mixing.states(none, none + 2)[0]).all()
    assert (others[2 * size : 3 * size] >> 6 > 0).all() and (others[2 * size : 3 * size] != state[2 * size : 3 * size]).any()


def test_answers_come_back_from_runs():
    """Runs and distances from the states give back every decision's states, however they are cut into buckets."""
    model = mixing.Model([b"a", b"b"], np.array([3, 2, 1]), 6, 3, *mixing.coded(np.arange(2 + 256 + 4) + 1))
    reader, r = mixing.Decisions(model), np.random.default_rng(3)
    asked = []
    for size in (400, 1, 90):
        n = r.integers(0, 30, size).astype(np.uint32)
        asked.append((r.integers(1, 60, size).astype(np.uint64), r.integers(0, 262, size).astype(np.int32), n, np.minimum(n, 2)))
    wanted = list(mixing.sided_answers(reader, asked))
    runs = list(mixing.answer_runs(reader, asked))
    assert sum(len(x[1]) for x in runs) < 0.8 * sum(len(x) for x, _ in wanted)
    number, size = mixing.run_sizes([mixing.told_runs(*x[:2]) for x in runs], reader.lengths(np.concatenate([x[1] for x in asked])))
    assert (number == np.concatenate([x[0] for x in runs])).all() and (size == np.concatenate([x[1] for x in runs])).all()
    others = [np.frombuffer(mixing.without(x[2].tobytes(), mixing.beyond(*x[2:])), np.uint8) for x in runs]
    for k, made in ((0, [x[2] for x in runs]), (1, others)):
        assert (np.repeat(np.concatenate(made), size) == np.concatenate([x[k] for x in wanted])).all()


def test_rows_do_not_grow_with_buckets_times_batches(spark, monkeypatch):
    """A batch has a row for each group of buckets."""
    kept, rows = mixing.staged, []

    def staged(df, name, *a, **b):
        made = kept(df, name, *a, **b)
        if name == "answers":
            rows.append(made.groupBy("batch").count().agg(F.max("count")).first()[0])
        return made

    monkeypatch.setattr(mixing, "staged", staged)
    monkeypatch.setattr(mixing, "BUCKET", 500)
    monkeypatch.setattr(mixing, "BATCH", 3000)
    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(400)], "doc_id long, text string")
    buckets = mixing.scores(docs).first().train_tokens / 500
    assert 1.5 * mixing.GROUP < buckets < 2 * mixing.GROUP and len(rows) == 2 and max(rows) == 2


def test_buckets_of_a_group_have_slots_of_their_own():
    model = mixing.Model([b"a", b"b"], np.array([3, 2, 1]), 6, 3, *mixing.coded(np.arange(2 + 256 + 4) + 1))
    reader, r, asked = mixing.Decisions(model), np.random.default_rng(4), []
    for size in (700, 1, 300):
        n = r.integers(0, 100, size).astype(np.uint32)
        context = mixing.mixed(r.integers(1, 60, size).astype(np.uint64))
        asked.append((context, r.integers(0, 262, size).astype(np.int32), n, np.minimum(n, 2)))
    bucket = [mixing.bucketed(x[0], 5) for x in asked]
    together = [(np.split(np.repeat(state, size), np.cumsum(reader.lengths(x[1]))[:-1])) for x, (_, size, state, _) in zip(asked, mixing.answer_runs(reader, asked, 5), strict=True)]
    for k in range(5):
        some = [np.flatnonzero(b == k) for b in bucket]
        own = [tuple(c[at] for c in x) for x, at in zip(asked, some, strict=True)]
        for at, told, (_, size, state, _) in zip(some, together, mixing.answer_runs(reader, own), strict=True):
            assert np.repeat(state, size).tolist() == [x for i in at for x in told[i].tolist()]


def test_tables_of_the_tree_are_made_once_a_worker():
    model = mixing.Model([b"a", b"b"], np.array([3, 2, 1]), 6, 3, *mixing.coded(np.ones(2 + 256 + 4, np.int64)))
    assert model.reader is model.reader and model.reader.sided is model.reader.sided and model.coder is model.coder


def test_words_are_told_apart_in_bulk():
    r, some = random.Random(5), [b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r", b"a", b"B", b"Zz", "Ä\u2003\x85".encode(), b"\x1c", b"\x00", b"\xff"]
    for _ in range(300):
        parts = [b"".join(r.choices(some, k=r.randint(0, 12))) for _ in range(r.randint(0, 5))]
        words, number = mixing.split(parts)
        assert words.to_pylist() == [w for p in parts for w in mixing.tokens(p)]
        assert number.tolist() == [len(mixing.tokens(p)) for p in parts]


@pytest.mark.parametrize("keys", [[], [7], [5, 5], [1 << 60, 1 << 60 | 1, 1 << 60, 3, 1 << 60 | 1, 3]])
def test_equal_keys_stand_together(keys):
    """Also where different keys have like high bits."""
    by, begins = mixing.neighbours(np.array(keys, np.uint64))
    assert [keys[i] for i in by] == sorted(keys) and by.tolist() == sorted(range(len(keys)), key=lambda i: keys[i])
    assert begins.sum() == len(set(keys))


def test_scores_leave_little_on_disk(spark, monkeypatch, tmp_path):
    """What nothing reads any more is gone, and so is what a step has shuffled when it ends."""
    kept, held = mixing.staged, []
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return sum("shuffle" in files.getAllFiles().apply(i).getName() for i in range(files.getAllFiles().size()))

    def staged(*a, **b):
        was = shuffled()
        made = kept(*a, **b)
        held.append(shuffled() - was)
        return made

    monkeypatch.setattr(mixing, "staged", staged)
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(mixing, "BATCH", 20_000)
    mixing.scores(spark.createDataFrame([(i, prose(i, 300)) for i in range(400)], "doc_id long, text string")).collect()
    left = {d.name.split("-")[0]: d for d in tmp_path.iterdir()}
    assert not {"words", "coded", "rare"} & left.keys() and {"symbols", "answers", "scores"} <= left.keys()
    assert max(held) <= 0


def test_weights_cost_least():
    r = np.random.default_rng(1)
    own, one, two = r.integers(-12, 13, (3, 500))
    n = r.integers(1, 1000, 500).astype(float)
    w = mixing.fitted(own, one, two, n)
    x = np.array([own, one, two]).T / 4
    slope = x.T @ (n / (1 + np.exp(x @ w))) - mixing.FIRMLY * (w - mixing.BEGIN)
    assert np.abs(slope).max() < 1e-3 * n.sum()
    assert np.isfinite(mixing.fitted(np.abs(own), one * 0, two * 0, n)).all()


@pytest.mark.parametrize("pairs", [1 << 10, 1 << 17])
def test_context_slots_grow(pairs):
    """What a context is told is its own counts, no less so among many contexts."""
    model = mixing.Model([b"a", b"b"], np.array([3, 2, 1]), 6, 3, *mixing.coded(np.ones(2 + 256 + 4, np.int64)))
    reader = mixing.Decisions(model)
    r = np.random.default_rng(pairs)
    context, symbol = r.integers(1, 1 << 62, pairs).astype(np.uint64), r.integers(0, 258, pairs).astype(np.int32)
    n = r.integers(1, 40, pairs).astype(np.uint32)
    found = np.frombuffer(mixing.answers(reader, [(context, symbol, n)])[0], np.uint8)
    length = reader.lengths(symbol)
    step, n = reader.of(symbol, length) & 1, np.repeat(n, length)
    assert (found == mixing.states(np.where(step, 0, n), np.where(step, n, 0))).mean() > 0.75


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = ("ab cd\n" * 1000 + "x" * 500 + " yz").encode()
    monkeypatch.setattr(mixing, "PIECE", 64)
    parts = list(mixing.pieces(text))
    assert [w for p, _ in parts for w in p.split()] == text.split()
    assert [last for _, last in parts] == [False] * (len(parts) - 1) + [True]


def test_packing(spark, odd, none):
    rows = packing.pack_best_fit(odd, queries.WORD_BPE).collect()
    assert sum(r.length for r in rows if r.doc_id in (2, 3, 6)) == 3
    assert packing.pack_best_fit(none, queries.WORD_BPE).collect() == []


def test_plan_is_full_and_whole():
    r = random.Random(3)
    for _ in range(50):
        counts = {r.randrange(1, 65): r.randrange(1, 40) for _ in range(r.randrange(1, 30))}
        used = {}
        for length, n in counts.items():
            runs = [x for x in packing.best_fit_plan(counts, 64) if x[0] == length]
            for rank in range(n):
                _, first_rank, first, each, offset = [x for x in runs if x[1] <= rank][-1]
                nth = rank - first_rank
                used.setdefault(first + nth // each, []).append((offset + nth % each * length, length))
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 64


def test_pii_kinds(spark):
    text = (
        "write to bob@x.example.org or a@b.c@d.e, iban GB82 WEST 1234 5698 7654 32 here, GB82 WEST 1234 5698 7654 33 not; "
        "social security 219-09-9999, part 219-09-9998 x; 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5; 4111 1111 1111 1111 or 4111 1111 1111 1112; +1 (212) 555-0100."
    )
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    told = [(s.kind, s.value) for s in row.pii_spans]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in told and sum(k == "iban" for k, _ in told) == 1
    assert [v for k, v in told if k == "ssn"] == ["219-09-9999"]
    assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in row.pii_spans if s.kind in pii.BASE) == brute.base_spans(text)
    assert all(text[s.start : s.end] == s.value for s in row.pii_spans)


def test_pii_many_and_odd(spark, odd, none):
    texts = [r[1] for r in ROWS] + ["é" * 99 + " a@b.co " * 700, "+" * 300 + "1.2.3.4" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        told = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.pii_spans if s.kind in pii.BASE)
        assert told == brute.base_spans(r.text)
    assert pii.find_pii(odd).columns == [*odd.columns, "pii_spans"]
    assert pii.find_pii(none).collect() == []


def test_chats(spark):
    rows = [
        (1, 0, "user", "a\\[INST] <|turn|>"), (1, 1, "user", None), (1, 1, "user", None), (1, None, None, "x"), (1, 2, "assistant", "<|end|>\\"),
        (1, 3, "assistant", "<|and|>"), (None, 0, "user", "q"), (2, 0, "<|text|>", ""),
    ]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = chat.format_chats(chats)
    back = {r.conv_id: [(t.role, t.text) for t in r.t] for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert back[1] == [("", "x"), ("user", "a\\[INST] <|turn|>"), ("user", ""), ("user", ""), ("assistant", "<|end|>\\"), ("assistant", "<|and|>")]
    assert back[None] == [("user", "q")] and back[2] == [("<|text|>", "")]
    one = out.filter("conv_id = 1").first()
    assert one.formatted.count(chat.TURN) == 3 and one.formatted.count(chat.END) == 3
    assert [p.text for p in one.parts if p.loss] == ["<\\|end|>\\\\", "<\\|and|>"]
    assert chat.chat_digest(chat.format_chats(chats.limit(0))).collect() == []


def test_archives(spark):
    rows = [(1, "http://a/é b", "x" * 3000), (2, None, "x" * 3000), (2, None, "x" * 3000), (3, "u", None), (4, "u", ""), (5, "u", "é" * 700), (None, "u", "x" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    chunks = warc.archived(pages, chunk=512)
    found = sorted(tuple(r) for r in warc.record_digest(chunks).filter("page_id is not null").collect())
    expected = brute.warc_rows([(i, h) for i, _, h in rows if i])
    assert found == sorted((i, *expected[i]) for i, _, _ in rows if i)
    assert {(r.record_type, r.refers_to) for r in warc.record_digest(chunks).filter("page_id is null").collect()} == {("revisit", 2)}
    parts = sorted((r.chunk_no, bytes(r.chunk)) for r in chunks.filter("page_id = 5").collect())
    assert b"".join(c for _, c in parts).decode() == "é" * 700 and len(parts) == 3
    assert warc.archived(pages.limit(0)).collect() == []


def test_templates(spark):
    item = "Maria bought 12 apples for 3 dollars each and then she gave 12 apples to Peter for 5 km of running today"
    changed = "Here: Alice bought 30 apples for 4 euros each and then she gave 30 apples to Bob for 9 km of running today. End"
    mixed = "Here: Alice bought 30 apples for 4 euros each and then she gave 31 apples to Bob for 9 km of running today. End"
    docs = spark.createDataFrame([(1, changed), (2, prose(3, 60)), (3, None), (4, item), (4, item), (5, mixed), (None, changed)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "one two"), (None, item)], "item_id long, text string")
    rows = {(r.doc_id, r.item_id, r.changed > 0) for r in decontam.leaks(docs.withColumn("item", F.lit(1)), bench).collect()}
    # 30 for one 12 and 31 for the other contradict each other, once in eight pairs of values: within the slack.
    assert rows >= {(1, 7, True), (1, None, True), (4, 7, False), (None, 7, True)} and not {d for d, _, _ in rows} & {2, 3}
    left = [r.doc_id for r in decontam.without_leaks(docs, bench).collect()]
    assert sorted(left) in ([2, 3], [2, 3, 5])
    assert decontam.leaks(docs.limit(0), bench).collect() == [] and decontam.leaks(docs, bench.limit(0)).collect() == []


def _leaked(spark, item, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in decontam.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}


def test_names_that_begin_sentences(spark):
    item = "The school sold clips to 48 friends in April. Natalia sold half as many clips in May. How many clips did Natalia sell altogether in both of these months"
    changed = "so " + item.replace("Natalia", "Maria")
    pair = "so " + item.replace("Natalia", "Anna Maria")
    other = "so " + item.replace("Natalia", "Maria").replace("half as many", "twice the red").replace("both of these", "all the other")
    assert _leaked(spark, item, changed, other, prose(3, 60)) == {0}
    assert _leaked(spark, pair.removeprefix("so "), "so " + pair.replace("Anna Maria", "Eva Lina"), changed) == {0, 1}
    item = "all the people who work at McDonald and at NASA went for a long walk near the old river before lunch"
    changed = item.replace("McDonald", "O'Brien").replace("NASA", "ESA")
    assert _leaked(spark, item, "so " + changed, "so " + item.lower()) == {0, 1}


def test_items_of_numbers_and_names(spark):
    item = "Compute 17 * 23 + 4 * 99 = ?"
    assert _leaked(spark, item, f"now {item} yes", "now Compute 18 * 24 + 5 * 98 = ? yes", "now Compute 17 + 23 * 4 + 99 = ? yes") == {0}
    item = "we met Bill Gates Steve Jobs Tim Cook Larry Page"
    assert _leaked(spark, item, f"so {item} there", "so we met Al Capone there") == {0}
    # One plain stretch does not stand for the rest; with it, the numbers may be others if they agree.
    item = "then add up all of these 1 2 3 4 5 6 7 8 9 10 11 12"
    changed = "so then add up all of these 21 22 23 24 25 26 27 28 29 30 31 32 now"
    assert _leaked(spark, item, f"so {item} now", "so then add up all of these things now", changed) == {0, 2}


def test_more_words_than_the_store(monkeypatch):
    monkeypatch.setattr(decontam, "_STORE", 10)
    monkeypatch.setattr(decontam, "_words", None)
    texts = [prose(i, 200).encode().split() for i in range(5)]
    small = [w[:3] for w in decontam.template_windows(texts)]
    monkeypatch.setattr(decontam, "_STORE", 10_000)
    monkeypatch.setattr(decontam, "_words", None)
    assert small == [w[:3] for w in decontam.template_windows(texts)] and len(small) == 5 * 196
    one_by_one = [(i, *w[1:3]) for i, t in enumerate(texts) for w in decontam.template_windows([t])]
    assert small == one_by_one


def test_words_are_split_and_judged_in_bulk():
    """Words of a column are those of `bytes.split`; words of letters get the kind and hash that the patterns give."""
    import pyarrow as pa

    texts = [b"", b" \x0b\x0c", b" a\x1c b\xc2\x85c\xe2\x80\x83d\x00 \r\n", b"x", b"\xff\t\t\xfe y "]
    for column in (pa.array(texts), pa.array([b"other words", *texts, b"more"]).slice(1, len(texts))):
        words, sizes = decontam._split(column)
        assert sizes.tolist() == [len(t.split()) for t in texts] and words.to_pylist() == [w for t in texts for w in t.split()]
    words = b"plain Name Name. I A a. kg Kg Seven seven, AB aB ab% x_ caf\xc3\xa9 12kg $5 - (in %".split()
    store = decontam._Words(len(words))
    store.add(words)
    import xxhash

    for w, kind, made, ends in zip(words, store.kind, store.hash, store.ends, strict=True):
        told, said = decontam._judged(w)
        assert (kind, made, ends) == (told, xxhash.xxh3_64_intdigest(said.encode()), w[-1:] in b".!?:;"), w



def test_ids_of_parts_are_the_ids_of_the_text():
    whole = tokens.tokenizer(queries.WORD_BPE)
    r = random.Random(1)
    texts = ["".join(r.choices("abcz\u00e9\u00c9\u00f7\u00d7\u00df\u00f1.,%&!?'s\u2019 \t\n\u2026\u00b71\u00b5\u4e2d\u00aa\u0301\u0130", k=40)) for _ in range(20_000)]
    texts += ["<|endoftext|>. a<|endoftext|>.", "", " ", prose(3, 500), "\u00c5. \ufb01. \u0133. \u212b."]
    want = [np.array(m.ids, "<u4").tobytes() for m in whole.encode_batch(texts, add_special_tokens=False)]
    assert tokens._word_tokenizer(queries.WORD_BPE)
    assert list(tokens.encoded([t.encode() for t in texts], queries.WORD_BPE)) == want


def found_items(spark, docs, items):
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in got.collect()}


def test_short_items(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "Paris"), (3, "two plus two is four"), (4, "Yes, no."), (5, "?!"), (6, "")]
    docs = [(1, "They asked: who wrote Hamlet? Nobody knew."), (2, "Paris"), (3, "Paris is large"), (4, "well yes no maybe"), (5, "who then wrote Hamlet"), (6, "no yes"), (7, None), (8, "who wrote"), (9, prose(3, 50) + " Who wrote hamlet")]
    assert found_items(spark, docs, items) == {(1, 1), (2, 2), (4, 4), (9, 1)}


def test_numbers_as_words_and_money(spark):
    text = "the baker sold {} loaves on monday and earned {} before noon then gave half of it to the old miller who lives near the river"
    items = [(1, text.format("12", "3 dollars"))]
    docs = [(1, text.format("twelve", "3 dollars")), (2, text.format("12", "$3")), (3, text.format("7", "$4.50,")), (4, text.format("forty", "9\u20ac")), (5, text.format("many", "nothing"))]
    assert found_items(spark, docs, items) == {(i, 1) for i in range(1, 5)}


def test_a_common_opening_makes_no_pairs(spark, monkeypatch):
    stem = "answer the following question with one of the given choices only please now "
    items = [(i, stem + prose(i, 9)) for i in range(60)]
    docs = [(i, prose(1000 + i, 60) + " " + stem + prose(2000 + i, 60)) for i in range(60)] + [(500, "x " + items[7][1] + " y")]
    met = []
    whole = decontam.staged
    monkeypatch.setattr(decontam, "staged", lambda df, name: met.append((name, made := whole(df, name))) or made)
    assert found_items(spark, docs, items) == {(500, 7)}
    rows = {name: df.count() for name, df in met}
    assert rows["candidates"] <= 5 and rows["met"] < 60


def test_slots_must_agree(spark):
    item = "first 1 then 1 then 1 then 1 then 1 then 1 goes the long way home again"
    other = "first 1 then 2 then 3 then 4 then 5 then 6 goes the long way home again"
    same = item.replace("1", "8")
    docs = spark.createDataFrame([(1, "so " + other), (2, "so " + same)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id for r in decontam.leaks(docs, bench).collect()} == {2}


def test_lengths(spark, odd, none):
    n = spark.createDataFrame([(x,) for x in [1, 1, 5, 3000, 3000, 1_000_000]], "n_tokens long")
    h = lengths.length_histogram(n)
    assert {r.length: (r.docs_at_least, r.truncated_total) for r in h.collect()} == {1: (6, 6), 5: (4, 22), 3000: (3, 9007), 1_000_000: (1, 1_006_007)}
    limits = spark.createDataFrame([(0,), (4,), (10**7,)], "limit long")
    assert {tuple(r) for r in lengths.totals_at(h, limits).collect()} == {(0, 6, 0, 1_006_007), (4, 4, 18, 1_005_989), (10**7, 0, 1_006_007, 0)}
    assert [lengths.quantile(h, q).first()[0] for q in (0.1, 0.5, 0.9)] == [1, 5, 1_000_000]
    assert lengths.length_histogram(lengths.encoded_lengths(none, queries.WORD_BPE)).collect() == []
    empty = lengths.length_histogram(n.limit(0))
    assert lengths.quantile(empty, 0.5).first()[0] is None
    assert lengths.encoded_lengths(odd, queries.WORD_BPE).count() == len(ROWS)


def test_lengths_answer_quantiles_and_limits(spark):
    r = random.Random(4)
    n = np.array([r.choice([3, 900, 1023, 1024, 1025, 5000, r.randrange(1, 9000)]) for _ in range(500)])
    h = lengths.length_histogram(spark.createDataFrame([(int(x),) for x in n], "n_tokens long"))
    for x in h.collect():
        assert x.docs_upto == (n <= x.length).sum() and x.share_upto == (n <= x.length).mean()
    asked = [-5, 0, 3, 1022, 1023, 1024, 1024, 2047, 2048, 8999, 9000, 10**9, *r.choices(range(9000), k=50)]
    found = lengths.totals_at(h, spark.createDataFrame([(x,) for x in [*asked, None]], "limit long"))
    told = [(x, (n > x).sum(), np.minimum(n, x).sum(), (n - np.minimum(n, x)).sum()) for x in asked]
    assert sorted(tuple(x) for x in found.collect() if x.limit is not None) == sorted(told)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any(">" in x for x in joins)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
