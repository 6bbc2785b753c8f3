"""Ranked lexical search by scanning the documents with an Aho-Corasick automaton of all item terms; no document index.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Every separator of a
text becomes a space, and the automaton holds each item term between two spaces, so that it finds whole terms only;
neighbours share a space, as matches may overlap. A scan gives each document's number of terms and how often it has each
item term. Those counts, with the totals taken from them, are all that scoring needs: the automaton's outputs lead from a
term to the items that hold it. Each task keeps an item's best documents only, and a ranking of those is the result.

The automaton is broadcast. Items are dealt into blocks of at most about `TERM_BYTES` bytes of terms and the documents
are scanned once a block, so its size has a bound whatever the items (one item's terms have to fit).

Edge cases: a null or empty text has no terms, is not counted and never found; a null id comes last among equal scores;
rows with one item_id (null is one too) are one item; an item without terms, or whose terms no document has, gives no
rows; each of repeated documents is ranked; no documents or no items give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagetrail.llm.common import small_batches, staged, text_or_empty

#: Documents per item, and the bound of a broadcast automaton's terms.
BEST = 50
TERM_BYTES = 1 << 20
_SEPARATOR = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_FOLDED = bytes(32 if _SEPARATOR.match(bytes([c])) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def folded(text: bytes) -> bytes:
    """The text's terms with single spaces or more between them. Bytes from 0x80 on are parts of terms."""
    return text.translate(_FOLDED)


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number without gaps in a block), block, item_id and term, each term of an item once."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            pairs = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in set(folded(text).split())]
            yield pa.record_batch([pa.array([i for i, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.binary())], ["item_id", "term"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.encode(text_or_empty(items["text"]), "utf-8").alias("text"))
    return texts.mapInArrow(cut, "item_id long, term binary").distinct()


def _blocks(terms: DataFrame) -> int:
    size = terms.agg(F.sum(F.length("term") + 16)).first()[0] or 0
    return max(1, math.ceil(size / TERM_BYTES))


class Scan:
    """The items of one block: their ids, terms and the items of each term; the automaton is made where it is used."""

    def __init__(self, pairs: list[tuple[int | None, bytes]]):
        import numpy as np

        ids = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
        self.item_ids = ids
        self.terms = sorted({t for _, t in pairs})
        number, place = {t: k for k, t in enumerate(self.terms)}, {i: k for k, i in enumerate(ids)}
        links = sorted((number[t], place[i]) for i, t in pairs)
        self.items = np.array([i for _, i in links], np.int64)
        self.starts = np.searchsorted(np.array([t for t, _ in links], np.int64), np.arange(len(self.terms) + 1))
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        import ahocorasick

        if self._automaton is None:
            made = ahocorasick.Automaton()
            for k, term in enumerate(self.terms):
                made.add_word(f" {term.decode('latin-1')} ", k)
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def counts(self, text: bytes):
        """Number of terms of a text, and the item terms in it with their counts, in order."""
        import numpy as np

        text = folded(text)
        n = len(text.split())
        found = [k for _, k in self.automaton().iter(f" {text.decode('latin-1')} ")]
        return n, *np.unique(np.array(found, np.int32), return_counts=True)


def scanned(docs: DataFrame, scan) -> DataFrame:
    """doc_id, n, terms and counts (32 bits each) of the documents with a term; `scan` is a broadcast one."""

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in small_batches(batches, 500):
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            made = [(i, *scan.value.counts(t.as_py())) for i, t in zip(ids, texts, strict=True)]
            made = [m for m in made if m[1]]
            columns = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64())]
            columns += [pa.array([m[k].astype("<i4").tobytes() for m in made], pa.binary()) for k in (2, 3)]
            yield pa.record_batch(columns, ["doc_id", "n", "terms", "counts"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty(docs["text"]), "utf-8").alias("text"))
    return texts.mapInArrow(find, "doc_id long, n long, terms binary, counts binary")


def document_frequencies(found: DataFrame) -> DataFrame:
    """term and df, summed in each task before they are sent."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        made = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"))
            made, seen = (made, seen) if len(made) >= len(seen) else (seen, made)
            made[: len(seen)] += seen
        at = np.flatnonzero(made)
        yield pa.record_batch([pa.array(at), pa.array(made[at])], ["term", "df"])

    return found.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weights(scan: Scan, found: DataFrame):
    """N, L, and each term's weight. As many numbers as the block has terms are collected."""
    import numpy as np

    total, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(scan.terms), np.int64)
    for r in document_frequencies(found).toLocalIterator():
        df[r.term] = r.df
    weight = [math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()]
    return total, length, np.array(weight, np.int64)


def best_of_task(scan, weight, total: int, length: int, best: int = BEST):
    """Function of batches of `scanned` rows that gives, for each item, the documents that may be among its best."""

    def pick(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        s, w = scan.value, weight.value
        # Each item's best so far: score, whether the id is null, id.
        kept = np.zeros((3, best, len(s.item_ids)), np.int64)
        for batch in small_batches(batches, max(1, min(500, (1 << 21) // max(1, len(s.item_ids))))):
            scores = np.zeros((batch.num_rows, len(s.item_ids)), np.int64)
            for row, (n, terms, counts) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                terms, tf = np.frombuffer(terms, "<i4"), np.frombuffer(counts, "<i4").astype(np.int64)
                m = 50 + (50 * n * total) // length
                part = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                first, sizes = s.starts[terms], s.starts[terms + 1] - s.starts[terms]
                at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                np.add.at(scores[row], s.items[at], np.repeat(part, sizes))
            on = np.flatnonzero(scores.max(axis=0, initial=0) >= np.maximum(1, kept[0, -1]))
            none = np.array([[i is None] for i in batch.column(0).to_pylist()], np.int64)
            ids = np.array([[i or 0] for i in batch.column(0).to_pylist()], np.int64)
            both = [np.concatenate([k[:, on], np.broadcast_to(x, scores.shape)[:, on]]) for k, x in zip(kept, (scores, none, ids), strict=True)]
            order = np.lexsort((both[2], both[1], -both[0]), axis=0)[:best]
            kept[:, :, on] = [np.take_along_axis(x, order, axis=0) for x in both]
        place, item = np.nonzero(kept[0] > 0)
        score, none, ids = kept[:, place, item]
        columns = [pa.array(item), pa.array(s.item_ids, pa.int64()).take(pa.array(item)), pa.array(ids, mask=none == 1), pa.array(score)]
        yield pa.record_batch(columns, ["item", "item_id", "doc_id", "score"])

    return pick


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of each item's `best` documents with a score above 0."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    terms = staged(item_terms(items), "terms")
    blocks = _blocks(terms)
    made = []
    for block in range(blocks):
        # A null id has a hash as well.
        pairs = [(r.item_id, bytes(r.term)) for r in terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator()]
        if not pairs:
            continue
        scan = Scan(pairs)
        sent = spark.sparkContext.broadcast(scan)
        found = staged(scanned(docs, sent), "scanned")
        total, length, weight = weights(scan, found)
        if total:
            pick = best_of_task(sent, spark.sparkContext.broadcast(weight), total, length, best)
            some = found.mapInArrow(pick, "item long, item_id long, doc_id long, score long")
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            made.append(some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score"))
    if not made:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, made)
