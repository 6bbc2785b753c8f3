"""Toxicity by a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A text is the set of its n-grams of 3 to 5 characters (lower-cased, runs of white space as one space, none across
words but with the spaces around a word), hashed to `SLOTS` numbers. The classifier is learned from a sample of the
labelled rows that are not held out: of either label at most about `SAMPLE` ids (all, if fewer) and `SAMPLE_SLOTS` n-grams,
chosen by hashes. There ratio = log((p / |p|) / (q / |q|)), p and q being the numbers of rows of label 1 and 0 that have the
n-gram, plus `SMOOTH` dealt to the labels by their shares, so that rare n-grams of either label stay near 0. A logistic
classifier of the n-grams present, each as large as its ratio, is fitted to these rows, and its intercept moved back to the
labels' shares among all labelled rows. Every text is scored whole.

Edge cases: a null text counts as empty and gets the score of no n-grams; a null id has no label and is not held out;
null labels count as none, of several labels of one id the largest holds, every different text with that id is a training
row; unless both labels have rows with n-grams, the score is the share of label 1 (0 without any label); no rows give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagetrail.llm.common import mixed, small_batches, staged, text_or_empty

#: log2 of the slots, as many weights are broadcast.
BITS = 18
SLOTS = 1 << BITS
GRAMS = (3, 4, 5)
#: Bounds of the sample: ids of either label, and n-grams of either label's rows.
SAMPLE = 6000
SAMPLE_SLOTS = 12_000_000
EPOCHS = 12
SMOOTH = 10.0
LIMIT = 0.3
#: Characters that are hashed at once.
PIECE = 1 << 19


def _hashed(text: str):
    """Slots and places of the n-grams of a text with a space before, between and after words."""
    import numpy as np

    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = np.concatenate([[0], np.cumsum(chars == 32)])
    for n in GRAMS:
        if len(chars) < n:
            continue
        at = np.flatnonzero(space[n - 1 : -1] == space[1 : len(chars) - n + 2])
        made = np.full(len(at), n, np.uint64)
        for k in range(n):
            made = made * np.uint64(0x9E3779B97F4A7C15) + chars[at + k]
        yield at, (mixed(made) >> np.uint64(64 - BITS)).astype(np.int32)


def slot_sets(texts: list[str]) -> Iterator:
    """The different slots of each text, in no particular order."""
    import numpy as np

    last = np.zeros(SLOTS, np.int32)

    def different(slots):
        order = np.arange(len(slots), dtype=np.int32)
        last[slots] = order
        return slots[last[slots] == order]

    def together(some: list[str]) -> Iterator:
        # Two spaces meet between texts, so no n-gram reaches from one into the next.
        found = list(_hashed("".join(some)))
        ends = np.cumsum([len(t) for t in some])
        cuts = [np.concatenate([[0], np.searchsorted(at, ends)]) for at, _ in found]
        for i in range(len(some)):
            parts = [slots[c[i] : c[i + 1]] for (_, slots), c in zip(found, cuts, strict=True)]
            yield different(np.concatenate(parts)) if parts else np.empty(0, np.int32)

    some, size = [], 0
    for text in texts:
        text = f" {' '.join(text.lower().split())} "
        if len(text) > PIECE:
            yield from together(some)
            some, size = [], 0
            step = PIECE - max(GRAMS) + 1
            yield different(np.concatenate([s for at in range(0, len(text), step) for s in together([text[at : at + PIECE]])]))
            continue
        some.append(text)
        size += len(text)
        if size > PIECE:
            yield from together(some)
            some, size = [], 0
    yield from together(some)


def _remainder(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_remainder(doc_id) == 2, F.lit(False))


def _place(*columns) -> Column:
    """A number from 0 to below 1, by a hash."""
    return F.pmod(F.xxhash64(F.lit("place"), *columns), F.lit(1 << 52)) / float(1 << 52)


def training_ids(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (0 or 1) of the ids that are labelled and not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") >= 1).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    return known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sampled_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """toxic, place, n and slots (increasing, as differences of 32 bits) of the documents with one of the few `ids`."""

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in small_batches(batches, 200):
            sets = [np.diff(np.sort(s), prepend=0).astype("<i4") for s in slot_sets(batch.column(2).to_pylist())]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc_id", "toxic", "n", "slots"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text"))
    made = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text").mapInArrow(cut, "doc_id long, toxic int, n long, slots binary")
    return made.distinct().select("toxic", _place("doc_id", "slots").alias("place"), "n", "slots")


def _unpacked(batch, column: int) -> list:
    import numpy as np

    return [np.cumsum(np.frombuffer(b, "<i4"), dtype=np.int32) for b in batch.column(column).to_pylist()]


def log_ratios(sets: list, toxic: list[int]):
    """The ratio of every slot, 0 where no row has it."""
    import numpy as np

    seen = np.zeros((2, SLOTS))
    for slots, y in zip(sets, toxic, strict=True):
        seen[y, slots] += 1
    mass = seen.sum(axis=1, keepdims=True)
    share = np.log(seen + SMOOTH * mass / mass.sum()) - np.log(mass)
    return np.where(seen.sum(axis=0) > 0, share[1] - share[0], 0.0)


def fitted(ratios, sets: list, toxic: list[int]):
    """Weight of each slot, times its ratio, and the intercept: logistic loss, steps that shrink with a slot's past
    gradients, rows in the order given."""
    import numpy as np

    weights, past = np.zeros(SLOTS), np.full(SLOTS, 1e-3)
    intercept, slope = 0.0, 1.0
    for _ in range(EPOCHS):
        for slots, y in zip(sets, toxic, strict=True):
            x = ratios[slots]
            z = x @ weights[slots] + intercept
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            if abs(error) < 1e-3:
                continue
            slopes = error * x
            past[slots] += slopes * slopes
            weights[slots] -= 0.05 * slopes / np.sqrt(past[slots])
            slope += error * error
            intercept -= 0.05 * error / np.sqrt(slope)
    return (weights * ratios).astype(np.float32), float(intercept)


def _shares(totals: dict, bound: int) -> dict:
    return {toxic: min(1.0, bound / max(1, total)) for toxic, total in totals.items()}


def _below(shares: dict) -> Column:
    return F.col("place") < F.when(F.col("toxic") == 1, shares.get(1, 0.0)).otherwise(shares.get(0, 0.0))


def classifier(docs: DataFrame, labels: DataFrame):
    """Weight of each slot and the intercept, learned from a sample of the labelled rows that are not held out."""
    import numpy as np

    known = training_ids(labels).withColumn("place", _place("doc_id"))
    ids = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    of_ids = _shares(ids, SAMPLE)
    rows = staged(sampled_rows(docs, known.filter(_below(of_ids)).drop("place")), "labelled")
    sizes = {r.toxic: (r.rows, r.slots) for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("slots")).collect()}
    if len(sizes) < 2 or not all(slots for _, slots in sizes.values()):
        some = [sizes.get(toxic, (0, 0))[0] for toxic in (0, 1)]
        return np.zeros(SLOTS, np.float32), float(np.log(some[1] / some[0])) if all(some) else float("inf") if some[1] else float("-inf")
    of_rows = _shares({toxic: slots for toxic, (_, slots) in sizes.items()}, SAMPLE_SLOTS)
    sample = rows.filter(_below(of_rows)).orderBy("place", "toxic", "slots").select("toxic", "slots").toArrow()
    sets, toxic = [s for b in sample.to_batches() for s in _unpacked(b, 1)], sample["toxic"].to_pylist()
    weights, intercept = fitted(log_ratios(sets, toxic), sets, toxic)
    return weights, intercept - float(np.log(of_ids[1] * of_rows[1] / of_ids[0] / of_rows[0]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    weights, intercept = classifier(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in small_batches(batches, 500):
            z = np.array([model.value[s].sum(dtype=np.float64) for s in slot_sets(batch.column(1).to_pylist())]) + intercept
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))) if np.isfinite(intercept) else (z > 0).astype(float))], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text"))
    rows = texts.mapInArrow(score, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
