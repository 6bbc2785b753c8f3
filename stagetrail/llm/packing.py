"""Best-fit packing of documents into sequences, planned over the histogram of lengths.

Every document is its token ids and an end mark; one longer than a sequence is cut into whole sequences and a rest.
The plan is best fit, longest first, over how many pieces have each length: at most one entry for each length, so it
is made on the driver whatever the number of documents. Pieces then take planned slots by their rank within their
length. Ranks are given while encoding (within a task, over a written table) and shifted by the counts of the tasks
before, so no task orders all pieces of one length.

Edge cases: a null or empty text is its end mark; ids may be null or repeat, each row is packed on its own; no
documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagetrail.llm.common import forget, small_batches, staged, text_or_empty
from stagetrail.llm.tokens import encoded

SEQUENCE = 2048
_PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """A row per piece, with its ids, the task that cut it and its number among that task's pieces of this length."""

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        forget(but="tokens")
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in small_batches(batches):
            rows: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), tokenizer_path), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    some = ids[at : at + 4 * size]
                    n = len(some) // 4
                    for column, value in zip(rows, (doc, piece, at // 4, n, some, seen[n]), strict=True):
                        column.append(value)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            made = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            made.insert(5, pa.array(np.full(len(rows[0]), part, np.int32)))
            yield pa.record_batch(made, ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty(), "utf-8").alias("text"))
    return source.mapInArrow(cut, _PIECES)


def best_fit_plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces a sequence, offset), ordered by length and rank.

    From the run's first rank on, so many pieces go into each sequence one after another. Sequences with equal room
    are one entry (first, number) of `room`, so the plan has entries for lengths, not for pieces."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            space = min((r for r in room if r >= length), default=0)
            if space:
                first, number = room[space].pop()
                if not room[space]:
                    del room[space]
            else:
                space, first = size, sequences
                number = -(-left // (size // length))
                sequences += number
            each = space // length
            full = min(number, left // each)
            over = left - full * each if full < number else 0
            runs.append((length, rank, first, each, size - space))
            if full and space > each * length:
                room[space - each * length].append((first, full))
            if over and space > over * length:
                room[space - over * length].append((first + full, 1))
            if (unused := number - full - bool(over)) > 0:
                room[space].append((first + full + bool(over), unused))
            rank += full * each + over
            left -= full * each + over
    return sorted(runs)


def pack_best_fit(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: every piece in its place."""
    import numpy as np

    pieces = staged(cut_pieces(docs, tokenizer_path, size, end_id), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts, "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # At most `size` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(best_fit_plan(histogram, size), np.int64).reshape(-1, 5)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        key = plan[:, 0] << 44 | plan[:, 1]
        run = plan[np.searchsorted(key, length << 44 | rank, "right") - 1]
        nth = rank - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + nth // run[:, 3], "offset": run[:, 4] + nth % run[:, 3] * length})

    ranked = pieces.join(shifts, ["length", "part"]).withColumn("slot", slot("length", F.col("nth") + F.col("shift")))
    return ranked.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "slot.sequence_id", "slot.offset")
