"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and an end. Words are coded by a binary tree over the most frequent ones, others by
an escape and their bytes, so a text is a row of yes-no decisions. Three predictors answer each: the tree's own counts,
and counts gathered under hashes of one and of two symbols before. Their log-odds are added with weights that a gate,
how much the two contexts have seen, selects. Within a text they are refined online, after every block of decisions. The
sum of the coding costs is the text's log probability; bits per byte follow.

What is learned: counts of all training words; decision counts of all training texts, with which texts are scored; 48
weights, on every decision of every training text. There the counts of a (context, symbol) pair are without those of one
text (as often as the texts that have the pair have it on average), so that no weight is learned on what only the text
itself has said. Decisions are added up by what they get from the three predictors, a table of fixed size, on which the
weights that cost least are found. Words are numbered by frequency, so a score depends on the table alone, not on how its rows are dealt. What is
broadcast is the tree over the `VOCABULARY`
most frequent words; every other word seen twice has a number, joined by word, and is the tree's mark for such words
and the digits of its number, so the words with a code grow with the input. Decision counts are kept by context: each
batch of texts deals its distinct (context, symbol) pairs to buckets, whose number grows with the training words, a row for
each group of buckets; a bucket counts, and answers each batch with what its pairs' decisions have seen, in all texts and
without one, as runs of decisions that have seen alike. A bucket has four slots or more for each of its own decisions, so they are no fuller on
more text, and a frequent context costs a batch one row per symbol that follows it. Answers are staged by pair, and meet
their texts in `PASSES` parts of the batches, once for the weights and once for the scores.

Edge cases: a null text is its end alone; a null id counts as the empty text for the split; repeated rows count each;
an empty table gives no rows; without training texts all words are unknown and every decision is near even; other
columns are ignored. Long texts are read in pieces cut between words."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagetrail.llm.common import mixed, staged, text_or_empty, unstaged

#: Words in the tree; bounds the model that every executor holds. Words beyond have joined numbers.
VOCABULARY = 1 << 18
#: A word with fewer occurrences is spelled, which teaches how often and how words are new.
TWICE = 2
#: Training words a bucket of contexts, and buckets that are asked and answered at once: a batch has a row for each group
#: of them, as a row costs the same however few pairs it has.
BUCKET, GROUP = 1 << 17, 16
#: Pairs whose decisions are counted, symbols that get their answers, and pairs whose decisions are added up for the
#: weights, at once.
COUNTED, PLACED, LEARN = 1 << 12, 1 << 14, 1 << 14
#: Symbols of a batch of texts, which asks for its contexts at once.
BATCH = 1 << 20
#: Parts of the batches, at most, that get their answers one after the other, so that few answers are on their way at once.
PASSES = 8
PIECE = 1 << 19
#: Bytes of text whose words are told apart at once.
READ = 1 << 22
#: Symbols of a text between two refinements of its weights, and symbols that are worked on at once.
BLOCK, SLICE, ROWS = 256, 1 << 11, 2000
#: A context's answer: what it has seen in the two high bits, log-odds in quarters plus 32 below.
UNSEEN = 32
GATES = 16
#: How far one error moves a text's own weights.
RATE = 0.0004
#: Cells of what decisions get: own log-odds in quarters, two states.
CELLS = 1 << 22
#: How firmly weights that few decisions tell of stay where they begin.
BEGIN, FIRMLY = 0.4, 10.0
#: Words of parts of the training texts that are added up at once; a dictionary of half as many is handed on.
HELD = 600_000
#: The end mark in the table of words; no word is empty.
END_WORD = b""


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """Parts of about `PIECE` bytes, cut at white space, and whether a part is the last."""
    at = 0
    while len(text) - at > PIECE:
        part = text[at : at + PIECE]
        cut = max(part.rfind(b" "), part.rfind(b"\n"))
        if cut <= 0:
            ends = [x for x in (text.find(b" ", at + PIECE), text.find(b"\n", at + PIECE)) if x >= 0]
            cut = min(ends, default=len(text)) - at
        yield text[at : at + cut], at + cut >= len(text)
        at += cut
        if at >= len(text):
            return
    yield text[at:], True


def split(parts: list[bytes]):
    """The words of `tokens` of all parts, one part after the other, and how many each part has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # Only ASCII letters and spaces count, so any bytes go.
    made = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(parts, pa.binary()).view(pa.string())))
    words, offsets = made.flatten(), made.offsets.to_numpy()
    # Where a part begins or ends with spaces there is an empty word.
    some = pc.greater(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
    return words.filter(some).view(pa.binary()), np.diff(before[offsets - offsets[0]])


def _remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10


def _source(docs: DataFrame) -> DataFrame:
    text = F.encode(text_or_empty(docs["text"]), "utf-8")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _remainder(F.col("doc_id")).cast("int").alias("remainder"), text.alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of all training tokens; the end mark is the empty word."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size, ends = [], 0, 0

        def added():
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for parts in _parts(batch.column(0)):
                _, some, last = zip(*parts, strict=True)
                words = split(some)[0].value_counts()
                held.append(pa.table({"word": words.field("values"), "n": words.field("counts")}))
                size += len(words)
                ends += sum(last)
                if size > HELD:
                    held, size = [made := added()], 0
                    if len(made) > HELD // 2:
                        yield from made.to_batches()
                        held = []
        if ends:
            held.append(pa.table({"word": pa.array([END_WORD], pa.binary()), "n": pa.array([ends], pa.int64())}))
        if held:
            yield from added().to_batches()

    rows = _source(docs).filter("remainder != 0").select("text").mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    #: Of a symbol: where its decisions begin and how many; of a decision: twice its node, plus its answer.
    start: np.ndarray
    length: np.ndarray
    step: np.ndarray
    #: Log-odds in 1/16, plus 128.
    own: np.ndarray
    #: Binary digits of the numbers of words beyond the tree.
    digits: int = 0

    @cached_property
    def coder(self) -> Coder:
        return Coder(self)

    @cached_property
    def reader(self) -> Decisions:
        """Made once a worker, as the broadcast model stays there from task to task."""
        return Decisions(self)

    @property
    def escape(self) -> int:
        return len(self.words) + 256

    @property
    def numbered(self) -> int:
        """The symbol of the first word beyond the tree."""
        return self.escape + 5

    def base(self, n) -> float:
        return math.log10((n + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def odds(no, yes):
    """Log-odds of yes in 1/16, plus 128."""
    return np.clip(np.round(np.log((yes + 0.4) / (no + 0.4)) * 16), -127, 127).astype(np.int64) + 128


def coded(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Decisions of each symbol in the tree that fits the counts (each at least one), and every node's log-odds."""
    n = len(counts)
    weight = [int(c) + 1 for c in counts]
    heap = [(w, i) for i, w in enumerate(weight)]
    heapq.heapify(heap)
    above, side, ratio = np.full(2 * n - 1, -1, np.int64), np.zeros(2 * n - 1, np.uint8), []
    for made in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        above[i] = above[j] = made
        side[j] = 1
        ratio.append((a, b))
        heapq.heappush(heap, (a + b, made))
    at, levels = np.arange(n), []
    while (above[at] >= 0).any():
        on = above[at] >= 0
        levels.append((np.where(on, above[at] - n, -1), np.where(on, side[at], 0)))
        at = np.where(on, above[at], at)
    nodes, answers = (np.array([x[k] for x in reversed(levels)]).T for k in (0, 1))
    used = nodes >= 0
    length = used.sum(axis=1)
    ratio = np.array(ratio, float).reshape(-1, 2)
    return np.cumsum(length) - length, length, (nodes[used] * 2 + answers[used]).astype(np.uint32), odds(ratio[:, 0], ratio[:, 1]).astype(np.uint16)


def numbered(counts: DataFrame, common: DataFrame) -> tuple[DataFrame, int, int]:
    """`counts` with the number of each word seen twice that is not in `common` (null for others); how many such words
    there are and how often they occur."""

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([part] * b.num_rows, pa.int64()), pa.array(range(at, at + b.num_rows), pa.int64())], ["word", "n", "part", "nth"])
            at += b.num_rows

    own = counts.filter((F.col("word") != END_WORD) & (F.col("n") >= TWICE)).join(common, "word", "left_anti")
    # By frequency, so that a word's number depends on the counts alone.
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartitionByRange(parts, F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word")
    own = staged(own.select("word", "n").mapInArrow(number, "word binary, n long, part long, nth long"), "numbers", last=True)
    # A row a task.
    parts = sorted(own.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")).collect())
    first, size = [], 0
    for r in parts:
        first.append((r["part"], size))
        size += r["size"]
    starts = counts.sparkSession.createDataFrame(first, "part long, first long")
    own = own.join(F.broadcast(starts), "part").select("word", (F.col("first") + F.col("nth")).alias("number"))
    return staged(counts.join(own, "word", "left"), "numbered", last=True), size, sum(r["n"] for r in parts)


def frame(counts: DataFrame) -> tuple[Model, DataFrame]:
    """The tree over the most frequent words, the bytes of the words seen once, and the marks; `counts` with the numbers
    of the words between."""

    def spelled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, words = np.zeros(256, np.int64), 0
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(total, np.frombuffer(word, np.uint8), n)
                words += n
        yield pa.record_batch([pa.array([*range(257)]), pa.array([*total.tolist(), words])], ["symbol", "n"])

    sums = counts.agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("distinct"),
        F.sum(F.when(F.col("word") == END_WORD, F.col("n"))).alias("ends"),
        F.count(F.when((F.col("word") != END_WORD) & (F.col("n") >= TWICE), 1)).alias("coded"),
    ).first()
    own = counts.filter((F.col("word") != END_WORD) & (F.col("n") >= TWICE))
    # Only words as frequent as the last one that has a place are sorted.
    running = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    times = own.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    last = times.filter(F.col("before") < VOCABULARY).agg(F.min("n")).first()[0]
    common = own.filter(F.col("n") >= (last or TWICE)).orderBy(F.desc("n"), "word").limit(VOCABULARY)
    common = staged(common, "common", last=True)
    top = common.orderBy(F.desc("n"), "word").toArrow()
    words, n = top["word"].to_pylist(), top["n"].to_numpy()
    size, occur = 0, 0
    if sums["coded"] > len(words):
        counts, size, occur = numbered(counts, common.select("word"))
    else:
        counts = counts.withColumn("number", F.lit(None).cast("long"))
    rest = counts.filter((F.col("word") != END_WORD) & (F.col("n") < TWICE)).select("word", "n").mapInArrow(spelled, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    spelling = np.zeros(257, np.int64)
    for r in rest:
        spelling[r["symbol"]] = r["n"]
    ends = sums["ends"] or 0
    # Symbols: words, bytes, then escape, end of a spelled word, end of a text, mark of a numbered word.
    symbols = np.concatenate([n, spelling[:256], [spelling[256], spelling[256], ends, occur]])
    return Model(words, np.append(n, ends), sums["total"] or 0, sums["distinct"], *coded(symbols), max(0, size - 1).bit_length()), counts


class Coder:
    """Texts as rows of symbols."""

    def __init__(self, model: Model):
        import pyarrow as pa

        self.model = model
        self.words = pa.array([*model.words, END_WORD], pa.binary())
        counts, number = np.unique(model.counts, return_inverse=True)
        self.base = np.array([model.base(n) for n in counts])[number]

    def coded(self, words):
        """Of words and end marks: which are not in the tree, base scores and whether they are known (0 for those), and
        symbols (-1 for those)."""
        import pyarrow.compute as pc

        model = self.model
        number = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)
        other = np.flatnonzero(number < 0)
        base, known = self.base[number], model.counts[number] > 0
        base[other], known[other] = 0, False
        number[number == len(model.words)] = model.escape + 2
        return other, base, known, number.astype(np.int32)


def filled(model: Model, symbols: np.ndarray, others: list[bytes], numbers: list[int | None]) -> np.ndarray:
    """Symbols of a text with those of the words that are not in the tree: their number's, or escape, bytes and end."""
    number = np.array([-1 if n is None else n for n in numbers], np.int64)
    letters = b"".join(w for w, n in zip(others, numbers, strict=True) if n is None)
    return filled_in(model, symbols, np.array([len(w) for w in others], np.int64), letters, number)[0]


def filled_in(model: Model, symbols: np.ndarray, size: np.ndarray, letters: bytes, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of the sizes of the other words, the bytes of those without a number, one word after the other, and the
    numbers or -1; also where each of `symbols` ends."""
    at, spelled = np.flatnonzero(symbols < 0), number < 0
    sizes = np.ones(len(symbols), np.int64)
    sizes[at[spelled]] = size[spelled] + 2
    ends = np.cumsum(sizes)
    made = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int32)
    first = symbols.copy()
    first[at] = np.where(spelled, model.escape, model.numbered + number)
    made[ends - sizes] = first
    made[ends[at[spelled]] - 1] = model.escape + 1
    made[made < 0] = np.frombuffer(letters, np.uint8).astype(np.int32) + len(model.words)
    return made, ends


class Decisions:
    """The decisions of symbols: of the tree, then the digits of a numbered word."""

    def __init__(self, model: Model):
        self.model = model
        self.start, self.tree, self.numbered = model.start, model.length, model.numbered
        self.own = np.append(model.own, np.uint16(128))
        nth = np.arange(len(model.step)) - np.repeat(model.start, model.length)
        self.code = (np.add.reduceat((model.step & 1) * 0.5 ** (nth + 1), model.start) * (1 << 14)).astype(np.uint64)

    def beside(self, said):
        """44 bits: 16 of the symbol before, 14 of the one before that, the first 14 decisions of the symbol."""
        symbol, *before = (x.astype(np.uint64) for x in said)
        made = (before[0] & np.uint64(0xFFFF)) << np.uint64(28)
        for x in before[1:]:
            made += (x & np.uint64(0x3FFF)) << np.uint64(14)
        return made + self.code[np.where(said[0] >= self.model.numbered, self.model.escape + 3, said[0])]

    def lengths(self, symbol):
        mark = self.model.escape + 3
        length = self.tree[np.minimum(symbol, mark)]
        length[symbol >= self.numbered] += self.model.digits
        return length

    def of(self, symbol, length):
        """Steps (twice the node, plus the answer) of the symbols, whose lengths are given."""
        model, heads, mark = self.model, np.cumsum(length) - length, self.model.escape + 3
        beyond = np.flatnonzero(symbol >= model.numbered)
        place = spread(self.start[np.minimum(symbol, mark)], length)
        if not len(beyond):
            return model.step[place]
        step = model.step[np.minimum(place, len(model.step) - 1, out=place)]
        # After the mark, the digits.
        nth, number = np.arange(model.digits), (symbol[beyond].astype(np.int64) - model.numbered)[:, None]
        node = len(model.own) + (1 << nth) - 1 + (number >> (model.digits - nth))
        step[(heads[beyond] + self.tree[mark])[:, None] + nth] = node * 2 + (number >> (model.digits - 1 - nth) & 1)
        return step

    def odds(self, step):
        return self.own[np.minimum(step >> np.uint32(1), np.uint32(len(self.own) - 1))]

    @cached_property
    def sided(self):
        """The tree's log-odds of the right answer, in 1/16, in the order of the codes, behind them those of a numbered
        word: the mark's, and even ones for its digits."""
        model, mark = self.model, self.model.escape + 3
        told = (self.odds(model.step).astype(np.int16) - 128).astype(np.int8)
        told[(model.step & 1) == 0] *= -1
        return np.concatenate([told, told[self.start[mark] : self.start[mark] + self.tree[mark]], np.zeros(model.digits, np.int8)])

    @cached_property
    def celled(self):
        """The same in quarters, as the high bits of a cell."""
        return (np.clip(np.round(self.sided / 4), -31, 31).astype(np.int8) + np.int8(32)).astype(np.uint8)

    def places(self, symbol, length):
        """Where the decisions of the symbols are in `sided`."""
        start = self.start[np.minimum(symbol, self.model.escape + 3)]
        start[symbol >= self.numbered] = len(self.model.step)
        return spread(start, length)


def spread(start, length):
    """Places of ranges, one range after the other."""
    end = np.cumsum(length)
    made = np.repeat(start - end + length, length)
    made += np.arange(len(made))
    return made


def neighbours(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of 64-bit keys in an order that has equal keys beside one another, in their own order, and which places
    of that order begin a key."""
    bits = np.uint64(max(1, len(key) - 1).bit_length())
    # Sorting numbers is several times faster than sorting places: the key's high bits, and the place below.
    by = (key >> bits << bits) + np.arange(len(key), dtype=np.uint64)
    by.sort()
    high = by >> bits
    by &= (np.uint64(1) << bits) - np.uint64(1)
    by = by.astype(np.int64)
    told = key[by]
    begins = np.ones(len(key), bool)
    np.not_equal(told[1:], told[:-1], out=begins[1:])
    if (begins[1:] & (high[1:] == high[:-1])).any():
        # Different keys with like high bits.
        by = np.argsort(key, kind="stable")
        told = key[by]
        np.not_equal(told[1:], told[:-1], out=begins[1:])
    return by, begins


class Texts:
    """A batch of texts: symbols with two marks of a beginning before each text, and the distinct pairs of a context and
    a symbol, in the order of their buckets."""

    def __init__(self, model: Model, reader: Decisions, heads: bytes, symbols: bytes, buckets: int):
        self.heads, self.symbols = heads, columns(symbols, 1)[0].astype(np.int32)
        _, training, sizes = np.frombuffer(heads, "<i8").reshape(3, -1)
        end = np.cumsum(sizes + 2)
        begin = end - sizes
        self.made = np.full(int(end[-1]) if len(sizes) else 0, model.escape + 4, np.int32)
        inside = np.ones(len(self.made), bool)
        inside[begin - 1] = inside[begin - 2] = False
        self.made[inside] = self.symbols
        self.inside, self.of = np.flatnonzero(inside), np.repeat(np.arange(len(sizes)), sizes)
        self.training = training[self.of] == 1
        self.reader, self.buckets = reader, buckets

    def pairs(self, k: int):
        """Of one of the contexts: symbol and the symbols before it, group of buckets of the distinct pairs, each inside
        symbol's pair, and whether its text has had that before."""
        said = [self.made[self.inside - j] for j in range(k + 2)]
        context = hashed(said[1:])
        by, begins = neighbours(paired(context, said[0]))
        first, nth = by[begins], np.cumsum(begins) - 1
        again, of = np.zeros(len(by), bool), self.of[by]
        again[by[1:]] = ~begins[1:] & (of[1:] == of[:-1])
        said = [x[first] for x in said]
        group = grouped(context[first], self.buckets)
        # Pairs of a context by the beginning of the symbol's code: neighbours have answers in common, which compress.
        bits, places = max(1, -(-self.buckets // GROUP) - 1).bit_length(), max(1, len(first) - 1).bit_length()
        order = (group << np.uint64(64 - bits)) + (self.reader.beside(said) << np.uint64(20) >> np.uint64(bits + places) << np.uint64(places))
        order += np.arange(len(first), dtype=np.uint64)
        order.sort()
        order &= np.uint64((1 << places) - 1)
        order = order.astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pair = np.empty(len(by), np.int64)
        pair[by] = rank[nth]
        return [x[order] for x in said], group[order].astype(np.int64), pair, again

    def runs(self, symbol: np.ndarray, runs: list[bytes], states: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of the distinct pairs, whose symbols are given: how many runs each has, how many decisions each run, where the
        runs of the pairs begin, states of the runs."""
        number, size = run_sizes(runs, self.reader.lengths(symbol))
        return number, size, np.cumsum(number) - number, np.frombuffer(b"".join(states), np.uint8)

    def placed(self, k: int, runs: list[bytes], states: list[bytes]):
        """The answers of one of the contexts to the distinct pairs, dealt to all decisions of the symbols."""
        said, _, pair, _ = self.pairs(k)
        told = self.runs(said[0], runs, states)
        made = [dealt(pair[at : at + PLACED], *told) for at in range(0, len(pair), PLACED)]
        return np.concatenate([told[-1][:0], *made])


def dealt(pair: np.ndarray, number: np.ndarray, size: np.ndarray, begin: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The states of the pairs' decisions."""
    place = spread(begin[pair], number[pair])
    return np.repeat(state[place], size[place])


def grouped(context: np.ndarray, buckets: int) -> np.ndarray:
    """The group of the context's bucket."""
    return bucketed(context, buckets) // np.uint64(GROUP)


def bucketed(context: np.ndarray, buckets: int) -> np.ndarray:
    return (context >> np.uint64(32)) % np.uint64(buckets)


def hashed(before: list[np.ndarray]):
    """A hash of the one or two symbols before, the nearest first."""
    made = mixed(before[0].astype(np.uint64) + np.uint64(1))
    for x in before[1:]:
        made = mixed(made + x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return made


def paired(context, symbol):
    return mixed(context ^ (symbol.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def packed(data: bytes) -> bytes:
    import pyarrow as pa

    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def unpacked(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def planes(columns: list[np.ndarray]) -> bytes:
    """32-bit columns by byte planes: high bytes are mostly zeros, which compress."""
    return packed(np.ascontiguousarray(np.array(columns, "<u4").view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)).tobytes())


def columns(data: bytes, number: int):
    return np.ascontiguousarray(np.frombuffer(unpacked(data), np.uint8).reshape(number, 4, -1).transpose(0, 2, 1)).view("<u4")[:, :, 0]


def answers(reader: Decisions, asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[bytes]:
    """For each batch's pairs (context, symbol, how often the training texts have it) of one bucket: the states of their
    decisions, from the counts of all of them."""
    made = []
    for (_, symbol, _), (state, _) in zip(asked, sided_answers(reader, [(*x, x[2]) for x in asked]), strict=True):
        no = reader.of(symbol, reader.lengths(symbol)) & np.uint32(1) == 0
        state[no] = state[no] & 192 | (64 - (state[no] & 63))
        made.append(state.tobytes())
    return made


def sided_answers(reader: Decisions, asked: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each batch's pairs (context, symbol, how often the training texts have it, how many of them): states that say how
    much is for the right answer, from all counts, and from those without one text that has the pair."""
    for _, size, state, others in answer_runs(reader, asked):
        yield np.repeat(state, size), np.repeat(others, size)


def answer_runs(reader: Decisions, asked: list[tuple[np.ndarray, ...]], buckets: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """What `sided_answers` gives, as runs of decisions of a pair that get the same: how many runs each pair has, how many
    decisions each run, and both states of each run. The pairs may be of several buckets, each with slots of its own."""
    columns = [np.concatenate(x) for x in zip(*asked, strict=True)]
    bucket = bucketed(columns[0], buckets)
    bucket = (bucket - bucket.min(initial=buckets)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    pair, made, pairs, runs = np.empty(len(order), np.int64), [], 0, 0
    for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        own, *told = bucket_runs(reader, *[x[some] for x in columns])
        pair[some] = own + pairs
        told[1] += runs
        pairs += len(told[0])
        runs += len(told[-1])
        made.append(told)
    number, place, run, state = (np.concatenate(x) for x in zip(*made, strict=True))
    at = 0
    for x in asked:
        own = pair[at : at + len(x[0])]
        at += len(own)
        runs = spread(place[own], number[own])
        both = state[runs]
        yield number[own], run[runs], (both & np.uint16(255)).astype(np.uint8), (both >> np.uint16(8)).astype(np.uint8)


def bucket_runs(reader: Decisions, context, symbol, n, texts) -> tuple[np.ndarray, ...]:
    """The distinct pair of each of a bucket's pairs; of the distinct pairs the number of runs and where they begin; size
    and both states of all runs."""
    by, begins = neighbours(paired(context, symbol))
    pair = np.empty(len(by), np.int64)
    pair[by] = np.cumsum(begins) - 1
    first = by[begins]
    n, texts = (np.bincount(pair, x, len(first)).astype(np.uint32) for x in (n, texts))
    one = (n + texts // 2) // np.maximum(texts, 1)
    context, symbol = context[first], symbol[first]
    length = reader.lengths(symbol)
    # A context that only one symbol follows has nothing against it, all along one run; others are counted.
    by, begins = neighbours(context)
    ends = np.append(begins[1:], True)[: len(by)]
    alone = np.empty(len(by), bool)
    alone[by] = begins & ends
    lone, some = np.flatnonzero(alone), np.flatnonzero(~alone)
    size = length[some]
    # Four to eight slots for a decision that was counted.
    bits = max(10, int(size[n[some] > 0].sum()).bit_length() + 2)
    counts = np.zeros(2 << bits, np.uint32)
    heads = np.cumsum(size) - size
    slot = np.empty(int(size.sum()), np.int64)
    both = np.empty(len(slot), np.uint16)
    # Few at once, which stay in the processor's cache.
    cuts = [*range(0, len(some), COUNTED), len(some)]
    parts = [(some[x:y], slice(int(heads[x]), int(heads[y - 1] + size[y - 1]))) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    for own, at in parts:
        step = reader.of(symbol[own], length[own])
        made = (step >> np.uint32(1)).astype(np.uint64)
        made *= np.uint64(0x9E3779B97F4A7C15)
        made += np.repeat(context[own], length[own])
        made = mixed(made)
        made >>= np.uint64(64 - bits)
        made <<= np.uint64(1)
        made += step & np.uint32(1)
        slot[at] = made
        np.add.at(counts, slot[at], np.repeat(n[own], length[own]))
    counts = counts.view("<i8")
    for own, at in parts:
        # Both answers of a node in one look.
        told = counts[slot[at] >> 1]
        yes, high = told & 0xFFFFFFFF, told >> 32
        no = yes + high
        np.copyto(yes, high, where=(slot[at] & 1).astype(bool))
        no -= yes
        both[at] = both_states(no, yes, np.repeat(one[own], length[own]))
    begins = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=begins[1:])
    begins[heads] = True
    begin = np.flatnonzero(begins)
    number = np.ones(len(symbol), np.int64)
    number[some] = np.diff(np.searchsorted(begin, np.append(heads, len(both))))
    # The runs of counted pairs, then those of the others.
    place = np.empty(len(symbol), np.int64)
    place[some] = np.cumsum(number[some]) - number[some]
    place[lone] = len(begin) + np.arange(len(lone))
    n, one = n[lone].astype(np.int64), one[lone]
    state = np.concatenate([both[begin], both_states(np.zeros(len(lone), np.int64), n, one)])
    run = np.concatenate([np.diff(np.append(begin, len(both))), length[lone]]).astype(np.uint8)
    return pair, number, place, run, state


def sided(state, others):
    return state.astype(np.uint16) | others.astype(np.uint16) << np.uint16(8)


def told_runs(number: np.ndarray, size: np.ndarray) -> bytes:
    """How many runs the pairs have, and how many decisions each run but a pair's last has, which the symbol tells."""
    inner = np.ones(len(size), bool)
    inner[np.cumsum(number) - 1] = False
    return len(number).to_bytes(8, "little") + number.astype(np.uint8).tobytes() + size[inner].astype(np.uint8).tobytes()


def beyond(state: np.ndarray, others: np.ndarray) -> bytes:
    """How far `others` is from `state`, in the order of `state`: equal states have like distances, which compress."""
    return (others - state)[np.argsort(state, kind="stable")].tobytes()


def without(state: bytes, told: bytes) -> bytes:
    """`others` back from that."""
    made = np.frombuffer(state, np.uint8).copy()
    made[np.argsort(made, kind="stable")] += np.frombuffer(told, np.uint8)
    return made.tobytes()


def run_sizes(told: list[bytes], length: np.ndarray):
    """Back from that: runs of each pair, decisions of each run; `length`: of the pairs' symbols."""
    heads = [8 + int.from_bytes(x[:8], "little") for x in told]
    number = np.frombuffer(b"".join(x[8:to] for x, to in zip(told, heads, strict=True)), np.uint8).astype(np.int64)
    end = np.cumsum(number)
    size = np.zeros(int(number.sum()), np.int64)
    inner = np.ones(len(size), bool)
    inner[end - 1] = False
    size[inner] = np.frombuffer(b"".join(x[to:] for x, to in zip(told, heads, strict=True)), np.uint8)
    if len(number):
        size[end - 1] = length - np.add.reduceat(size, end - number)
    return number, size


def _state(no, yes):
    told = np.clip(np.round(np.log((yes + 0.4) / (no + 0.4)) * 4), -31, 31).astype(np.int64) + 32
    seen = no + yes
    return np.where(seen, told + (np.searchsorted([1, 4, 32], seen, "right") << 6), UNSEEN).astype(np.uint8)


#: States of small counts.
_FEW = 64
_STATE = _state(*np.divmod(np.arange(_FEW * _FEW), _FEW))


def states(no, yes):
    many = np.flatnonzero((no | yes) >= _FEW)
    made = _STATE.take(no.astype(np.int64) * _FEW + yes, mode="clip")
    made[many] = _state(no[many], yes[many])
    return made


def both_states(no, yes, one):
    """The states of all counts, and of those without `one`, together; `no` and `yes` are 64-bit numbers."""
    many, place = np.flatnonzero((no | yes) >= _FEW), no * _FEW
    place += yes
    state = _STATE.take(place, mode="clip")
    place -= one
    others = _STATE.take(place, mode="clip")
    no, yes, one = no[many], yes[many], one[many]
    state[many], others[many] = _state(no, yes), _state(no, yes - one)
    return sided(state, others)


def _answered(texts: DataFrame, model, buckets: int, k: int, passes: int) -> DataFrame:
    """Of one of the contexts, a row a batch and group of buckets: the runs of the batch's pairs, their states and, as `others`, how
    far the states without one text are from them, all packed. `part`: the batch's pass."""

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = model.value.reader
        for b in batches:
            for batch, heads, symbols in _rows(b, "batch", "heads", "blob"):
                held = Texts(model.value, reader, heads, symbols, buckets)
                said, group, pair, again = held.pairs(k)
                n, more = (np.bincount(pair[x], minlength=len(group)).astype(np.uint32) for x in (held.training, held.training & again))
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]) if len(group) else np.zeros(1, np.int64)
                blobs = [planes([*[c[x:y] for c in said], n[x:y], more[x:y]]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                size = len(blobs)
                yield pa.record_batch(
                    [pa.array([batch] * size, pa.int64()), pa.array(group[cuts[:-1]] if size else [], pa.int64()), pa.array(blobs, pa.binary())],
                    ["batch", "bucket", "blob"],
                )

    def answer(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = model.value.reader
        key, rows, asked = None, [], []

        def made(some):
            batch, *blobs = zip(*some, strict=True)
            size = len(some)
            return pa.record_batch(
                [pa.array(batch, pa.int64()), pa.array([k] * size, pa.int32()), pa.array([key] * size, pa.int64()), *[pa.array(x, pa.binary()) for x in blobs]],
                ["batch", "context", "bucket", "runs", "states", "others"],
            )

        def told():
            some = []
            for batch, (number, size, state, others) in zip(rows, answer_runs(reader, asked, buckets), strict=True):
                some.append((batch, packed(told_runs(number, size)), packed(state.tobytes()), packed(beyond(state, others))))
                if len(some) == 500:
                    yield made(some)
                    some = []
            if some:
                yield made(some)

        for b in batches:
            for batch, bucket, blob in _rows(b, *b.schema.names):
                if key != bucket:
                    if rows:
                        yield from told()
                    key, rows, asked = bucket, [], []
                rows.append(batch)
                symbol, *before, n, more = columns(blob, k + 4)
                asked.append((hashed(before), symbol.astype(np.int32), n, n - more))
        if rows:
            yield from told()

    number = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(deal, "batch long, bucket long, blob binary")
    dealt = dealt.repartition(number, "bucket").sortWithinPartitions("bucket")
    told = dealt.mapInArrow(answer, "batch long, context int, bucket long, runs binary, states binary, others binary")
    return told.withColumn("part", _part(passes))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _part(passes: int) -> Column:
    return F.pmod(F.xxhash64("batch"), F.lit(passes)).cast("int")


def _asked(texts: DataFrame, told: DataFrame, part: int, passes: int, others: bool) -> DataFrame:
    """Rows of a part of the batches, each batch's texts before its answers, both in one task."""
    number = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("binary")
    own = texts.filter(_part(passes) == part).select("batch", F.lit(-1).alias("context"), F.lit(-1).cast("long").alias("bucket"), "heads", F.col("blob").alias("runs"), none.alias("states"), none.alias("others"))
    told = told.filter(F.col("part") == part).select("batch", "context", "bucket", none.alias("heads"), "runs", "states", (F.col("others") if others else none).alias("others"))
    return own.unionByName(told).repartition(number, "batch").sortWithinPartitions("batch", "context", "bucket")


def _told(batches: Iterator, model: Model, buckets: int) -> Iterator:
    """Each batch of texts and, of both contexts, runs and states of its pairs; the states without one text where they are
    told."""
    held = None
    for b in batches:
        for _, context, _, heads, runs, states, others in _rows(b, *b.schema.names):
            if context < 0:
                if held:
                    yield held, found
                held, found = Texts(model, model.reader, heads, runs, buckets), [([], []), ([], [])]
            else:
                found[context][0].append(unpacked(runs))
                state = unpacked(states)
                found[context][1].append(state if others is None else without(state, unpacked(others)))
    if held:
        yield held, found


def _cells(asked: DataFrame, model, buckets: int) -> DataFrame:
    """Cells of what the decisions of training texts get from the other parts, and how many get it."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cells = None
        for held, found in _told(batches, model.value, buckets):
            cells = np.zeros(CELLS, np.int64) if cells is None else cells
            _add(cells, held, *found)
        if cells is not None:
            used = np.flatnonzero(cells)
            for at in range(0, len(used), 10_000):
                some = used[at : at + 10_000]
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array(cells[some])], ["cell", "n"])

    return asked.mapInArrow(add, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _add(cells: np.ndarray, texts: Texts, one: tuple[list[bytes], list[bytes]], two: tuple[list[bytes], list[bytes]]) -> None:
    """Adds the decisions of the training texts to the cells of what they get. The pair of the longer context tells that of
    the shorter one, so each is looked at once and counts as often as the texts have it."""
    reader = texts.reader
    said, _, pair, _ = texts.pairs(1)
    n = np.bincount(pair[texts.training], minlength=len(said[0]))
    length, (number, size, begin, state) = reader.lengths(said[0]), texts.runs(said[0], *two)
    symbol, other = said[0], np.zeros(len(said[0]), np.int64)
    said, _, shorter, _ = texts.pairs(0)
    other[pair] = shorter
    runs = texts.runs(said[0], *one)
    some = np.flatnonzero(n)
    for at in range(0, len(some), LEARN):
        own = some[at : at + LEARN]
        cell = reader.celled[reader.places(symbol[own], length[own])].astype(np.int64) << 16
        cell += dealt(other[own], *runs).astype(np.int64) << 8
        cell += dealt(own, number, size, begin, state)
        np.add.at(cells, cell, np.repeat(n[own], length[own]))


class Mixer:
    """Costs of texts in nats. All texts of a batch go on together, a block of symbols at a time, and each one's own
    drift of the weights follows its errors. Log-odds are those of the right answer."""

    def __init__(self, model: Model, weights: np.ndarray):
        self.reader, self.weights = model.reader, np.ascontiguousarray(weights.T, np.float32)

    def costs(self, sizes: np.ndarray, symbols: np.ndarray, states: list[np.ndarray]) -> np.ndarray:
        end = np.cumsum(sizes)
        begin, length = end - sizes, self.reader.lengths(symbols)
        # Where the decisions of the symbols begin.
        places = np.append(0, np.cumsum(length))
        drift, total = np.zeros((3, len(sizes)), np.float32), np.zeros(len(sizes))
        for at in range(0, int(sizes.max(initial=0)), BLOCK):
            live = np.flatnonzero(sizes > at)
            first = begin[live] + at
            last = np.minimum(end[live], first + BLOCK)
            # As many texts at once as fill a slice.
            cuts = np.flatnonzero(np.diff((np.cumsum(last - first) - 1) // SLICE)) + 1
            for some, f, t in zip(np.split(live, cuts), np.split(first, cuts), np.split(last, cuts), strict=True):
                said = [slice(*x) for x in zip(f.tolist(), t.tolist(), strict=True)]
                made = [slice(*x) for x in zip(places[f].tolist(), places[t].tolist(), strict=True)]
                where = self.reader.places(np.concatenate([symbols[x] for x in said]), np.concatenate([length[x] for x in said]))
                own = self.reader.sided[where].astype(np.float32)
                own *= np.float32(1 / 16)
                told = [np.concatenate([x[y] for y in made]) for x in states]
                self._block(own, told, some, places[t] - places[f], drift, total, (end[some] > t).any())
        return total

    def _block(self, own, states, live, sizes, drift, total, more) -> None:
        """`more`: one of the texts goes on."""
        inputs = [own]
        for x in states:
            # What a state has seen is above its log-odds.
            made = (x & np.uint8(63)).astype(np.float32)
            made -= np.float32(32)
            made *= np.float32(0.25)
            inputs.append(made)
        gate = states[0] >> np.uint8(6) << np.uint8(2)
        gate |= states[1] >> np.uint8(6)
        heads = np.cumsum(sizes) - sizes
        mixed = np.zeros(len(own), np.float32)
        moved = drift[:, live].any()
        for k, x in enumerate(inputs):
            weight = self.weights[k].take(gate, mode="clip")
            if moved:
                weight += np.repeat(drift[k, live], sizes)
            weight *= x
            mixed += weight
        np.clip(mixed, -9, 9, out=mixed)
        np.negative(mixed, out=mixed)
        hit = np.exp(mixed, out=mixed)
        hit += np.float32(1)
        total[live] += np.add.reduceat(np.log(hit), heads, dtype=np.float64)
        if not more:
            return
        miss = np.float32(1) - np.float32(1) / hit
        for k, x in enumerate(inputs):
            x *= miss
            drift[k, live] = np.clip(drift[k, live] + np.float32(RATE) * np.add.reduceat(x, heads), -0.5, 0.5)


def fitted(own: np.ndarray, one: np.ndarray, two: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights of the three log-odds of the right answer (in quarters) that cost least, by Newton's method."""
    x, w = np.array([own, one, two]).T / 4, np.full(3, BEGIN)

    def cost(w):
        return n @ np.logaddexp(0, -(x @ w)) + FIRMLY / 2 * ((w - BEGIN) ** 2).sum()

    now = cost(w)
    for _ in range(50):
        miss = 1 / (1 + np.exp(x @ w))
        slope = x.T @ (n * miss) - FIRMLY * (w - BEGIN)
        move = np.linalg.solve((x.T * (n * miss * (1 - miss))) @ x + FIRMLY * np.eye(3), slope)
        while (then := cost(w + move)) > now and np.abs(move).max() > 1e-9:
            move /= 2
        if then >= now - 1e-9 * abs(now):
            break
        w, now = w + move, then
    return w


def _weights(cells: DataFrame) -> np.ndarray:
    """The weights of each gate, from all decisions that went through it: of `CELLS` kinds at most, however many."""

    def fit(table):
        import pyarrow as pa

        table = table.sort_by("cell")
        cell, n = table["cell"].to_numpy(), table["n"].to_numpy().astype(float)
        w = fitted((cell >> 16) - 32, (cell >> 8 & 63) - 32, (cell & 63) - 32, n)
        return pa.table({"gate": pa.array(table["gate"][:1].to_pylist() * 3, pa.int32()), "input": pa.array([0, 1, 2], pa.int32()), "weight": w})

    weights = np.full((GATES, 3), BEGIN, np.float32)
    gate = F.shiftright("cell", 14).bitwiseAND(3) * 4 + F.shiftright("cell", 6).bitwiseAND(3)
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n")).select(gate.alias("gate"), "cell", "n")
    for r in cells.groupBy("gate").applyInArrow(fit, "gate int, input int, weight double").collect():
        weights[r["gate"], r["input"]] = r["weight"]
    return weights


_CODED = "row long, doc_id long, remainder int, n_bytes long, n_tokens long, n_known long, base double, others array<binary>, symbols binary"


def coded_texts(docs: DataFrame, model) -> DataFrame:
    """Every row's text as symbols (-1 for a word not in the tree), with what the tree's words say of its base score and
    the words they miss, in order."""

    def code(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        coder = model.value.coder
        row = TaskContext.get().partitionId() << 40
        for batch in _small(batches):
            size, texts = batch.num_rows, batch.column(2)
            told, known, base, missed = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size, np.int64)
            others, made = [pa.array([], pa.binary())], [np.zeros(0, np.int32)]
            for held in _parts(texts):
                of, some, last = zip(*held, strict=True)
                words, number = split(some)
                # The end marks stand behind the words of last pieces.
                ended, ends = np.array(last), np.cumsum(number)
                order = np.insert(np.arange(len(words)), ends[ended], len(words))
                words = pa.concat_arrays([words, pa.array([END_WORD], pa.binary())]).take(pa.array(order))
                part = np.repeat(of, number + ended)
                missing, value, known_, symbols = coder.coded(words)
                told += np.bincount(part, minlength=size)
                known += np.bincount(part, known_, size).astype(np.int64)
                base += np.bincount(part, value, size)
                missed += np.bincount(part[missing], minlength=size)
                others.append(words.take(pa.array(missing)))
                made.append(symbols)
            starts = np.append(0, np.cumsum(told) * 4).astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array(np.arange(row, row + size)),
                    batch.column(0),
                    batch.column(1),
                    pc.binary_length(texts).cast(pa.int64()),
                    pa.array(told),
                    pa.array(known),
                    pa.array(base),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(missed)), pa.int32()), pa.concat_arrays(others)),
                    pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(starts), pa.py_buffer(np.concatenate(made))]),
                ],
                [x.split()[0] for x in _CODED.split(", ")],
            )
            row += size

    return _source(docs).mapInArrow(code, _CODED)


def _rows(batch, *names: str) -> Iterator[tuple]:
    """Rows as Python values, one at a time."""
    for row in zip(*[batch.column(n) for n in names], strict=True):
        yield tuple(x.as_py() for x in row)


def _small(batches: Iterator) -> Iterator:
    """Batches of fewer rows, so that what is worked on at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _parts(texts) -> Iterator[list[tuple[int, bytes, bool]]]:
    """Pieces of texts (number, piece, whether it is the last), together of about `READ` bytes."""
    held, size = [], 0
    for at, text in enumerate(texts):
        for piece, last in pieces(text.as_py()):
            held.append((at, piece, last))
            size += len(piece)
            if size >= READ:
                yield held
                held, size = [], 0
    if held:
        yield held


def _batches(rows: DataFrame, model) -> DataFrame:
    """Texts in batches of about `BATCH` symbols."""

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 40

        def told():
            nonlocal number, size
            row, training, symbols = zip(*held, strict=True)
            heads = np.array([row, training, [len(x) for x in symbols]], "<i8").tobytes()
            made = pa.record_batch([pa.array([number], pa.int64()), pa.array([heads], pa.binary()), pa.array([planes([np.concatenate(symbols)])], pa.binary())], ["batch", "heads", "blob"])
            number += 1
            held.clear()
            size = 0
            return made

        for batch in _small(batches):
            symbols, others, numbers = (batch.column(n) for n in ("symbols", "others", "numbers"))
            words, given = others.flatten(), numbers.flatten().to_numpy().astype(np.int64)
            letters = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, int((given < 0).sum())], pa.int32()), words.filter(pa.array(given < 0))), b"")[0].as_py()
            blob = np.frombuffer(b"".join(symbols.to_pylist()), "<i4")
            made, ends = filled_in(model.value, blob, pc.binary_length(words).to_numpy().astype(np.int64), letters, given)
            ends = np.append(0, ends)[np.append(0, np.cumsum(pc.binary_length(symbols).to_numpy() // 4))].tolist()
            for row, training, x, y in zip(batch.column("row").to_pylist(), batch.column("remainder").to_pylist(), ends[:-1], ends[1:], strict=True):
                held.append((row, training > 0, made[x:y]))
                size += y - x
                if size >= BATCH:
                    yield told()
        if held:
            yield told()

    return rows.mapInArrow(gather, "batch long, heads binary, blob binary")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    context = docs.sparkSession.sparkContext
    words = staged(word_counts(docs), "words", last=True)
    own, counts = frame(words)
    total, distinct, unknown = own.total, own.distinct, own.base(0)
    buckets = -(-total // BUCKET) or 1
    model = context.broadcast(own)
    rows = staged(coded_texts(docs, model), "coded", last=True)
    others = rows.select("row", F.posexplode("others").alias("nth", "word")).join(counts, "word", "left")
    value = F.log10((F.col("n") + 0.1) / F.lit(total + 0.1 * (distinct + 1)))
    number = F.struct("nth", F.coalesce("number", F.lit(-1)).alias("number"))
    rare = others.groupBy("row").agg(
        F.count("n").alias("rare_known"),
        F.sum(F.coalesce(value, F.lit(unknown))).alias("rare_base"),
        F.sort_array(F.collect_list(number)).getField("number").alias("numbers"),
    )
    rare = staged(rare, "rare", last=True)
    texts = rows.select("row", "remainder", "n_tokens", "symbols", "others").join(rare.select("row", "numbers"), "row", "left")
    texts = staged(_batches(texts, model), "symbols", last=True)
    about = staged(rows.drop("others", "symbols").join(rare.drop("numbers"), "row", "left"), "about", last=True)
    for x in (words, counts, rows, rare):
        unstaged(x)
    # The context with more pairs first.
    passes = min(PASSES, texts.count()) or 1
    told = [staged(_answered(texts, model, buckets, k, passes), "answers", last=True, by="part") for k in (1, 0)]
    told = told[0].unionByName(told[1])
    weights = _weights(union([staged(_cells(_asked(texts, told, part, passes, True), model, buckets), "cells", last=True) for part in range(passes)]))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        mixer = Mixer(model.value, weights)
        for held, found in _told(batches, model.value, buckets):
            states = [held.placed(k, *x) for k, x in enumerate(found)]
            row, _, sizes = np.frombuffer(held.heads, "<i8").reshape(3, -1)
            yield pa.record_batch([pa.array(row), pa.array(-mixer.costs(sizes, held.symbols, states) / math.log(10))], ["row", "score"])

    scored = union([staged(_asked(texts, told, part, passes, False).mapInArrow(score, "row long, score double"), "scores", last=True) for part in range(passes)])
    return about.join(scored, "row").select(
        "doc_id",
        (F.col("remainder") == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
