"""Benchmark questions in documents, also with other numbers, names and units.

Words become a template: numbers, quantities (a number and its unit, or a sum of money) and names turn into typed placeholders, the rest
is lower-cased without outer punctuation. A capitalised word that begins a sentence, an acronym or a word with an inner
capital is a plain word or a name: windows with one have a second form with placeholders, and either may meet. Windows
of five template words are hashed and joined with those of the benchmark. Along one alignment (a document place less an
item place) each value of the item must stand for one value in the document, or its windows don't count. A document
holds an item if it has at least `share` of the item's windows, each counted once whatever its forms.

Placeholders alone prove nothing: a window of fewer than two plain words (operators are words, but not plain) is joined
by its values too. Where another window has aligned an item, such windows also count with other values, if those agree.
An item whose words make fewer than five template words, such as a list of names, is joined by its words as they are.

Only windows that may be the benchmark's leave the tasks that read texts: a filter of fixed size stops the others, the
join is exact. Equal texts are joined once, by their digest, and equal templates of items too.

An item of two to four words is found where a document has just these words one after another, one of a single word
only where it is the document.

Items that many documents may hold a part of meet only documents that have one of the item's rarest windows.

Edge cases: a text without words has no windows and matches nothing; null ids stay null; repeated rows each get the result of their text; without documents or items there are no rows; other
columns are ignored, or kept by `without_leaks`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagetrail.llm.common import FILTER_BITS, STORES, forget, hash_filter, passes, small_batches, staged, text_or_empty, windows_hashed

WIDTH = 5
SHARE = 0.8
#: Share of an alignment's value pairs that may contradict an earlier one.
SLACK = 0.2
#: Words that are a unit after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms ton tons "
    "lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years percent % dollar dollars cent cents euro euros "
    "mph kmh degree degrees °c °f hz khz mhz ghz w kw v a j kj n pa kpa bar mol".split()
)
#: Numbers written as words.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
#: A sum of money: its sign is the unit.
_MONEY = re.compile(r"^[^\w$\u20ac\u00a3]*(?:[-+]?[$\u20ac\u00a3][-+]?\d[\d.,]*|\d[\d.,]*[$\u20ac\u00a3])\W*$")
_NUMBER = re.compile(r"^[$€£+-]?\d[\d.,:/]*(.*)$")
_OUTER = re.compile(r"^\W+|\W+$")
_OPERATOR = re.compile(r"^[-+*/=<>^\u00d7\u00f7\u00b1\u2013\u2014\u2212\u2260\u2264\u2265]+$")
_DASHES = str.maketrans("\u2013\u2014\u2212", "---")
#: CAPITAL is a name inside a sentence; OTHER (other capitalised words) only in the second form.
PLAIN, NUMBER, QUANTITY, UNIT, CAPITAL, OPERATOR, OTHER = range(1, 8)
#: Of a window: counts only where its item is aligned, aligns, is of words as they are.
SUPPORT, FIRM, EXACT = range(3)
_STORE = 400_000


class _Words:
    """What a word is, found once a worker: kind (0: punctuation only), hash, whether it ends a sentence."""

    def __init__(self, size: int):
        import numpy as np

        self.index: dict[bytes, int] = {}
        self.kind = np.zeros(size, np.uint8)
        self.hash = np.zeros(size, np.uint64)
        self.ends = np.zeros(size, bool)

    def add(self, fresh: Iterable[bytes]) -> None:
        """Numbers words that were not met before."""
        import numpy as np
        from xxhash import xxh3_64_intdigest as digest

        kinds, hashes, ends, first = bytearray(), [], bytearray(), len(self.index)
        for at, raw in enumerate(fresh, first):
            self.index[raw] = at
            # Most words are letters, maybe with a mark behind them, and need no patterns.
            last = raw[-1:]
            letters = last.isalpha()
            word = raw if letters else raw[:-1]
            low = word.lower()
            if (letters or last in _MARKS) and word.isalpha() and (word == low or word[1:].islower()) and low not in _LISTED:
                kinds.append(PLAIN if word == low else CAPITAL)
                hashes.append(digest(low))
            else:
                kind, said = _judged(raw)
                kinds.append(kind)
                hashes.append(digest(said.encode()))
            ends.append(last in b".!?:;")
        to = first + len(hashes)
        self.kind[first:to] = np.frombuffer(kinds, np.uint8)
        self.hash[first:to] = np.fromiter(hashes, np.uint64, len(hashes))
        self.ends[first:to] = np.frombuffer(ends, bool)


#: Marks that end a word, and words of letters that are more than plain.
_MARKS = b".,;:!?"
_LISTED = frozenset(w.encode() for w in UNITS | NUMBERS)


def _judged(raw: bytes) -> tuple[int, str]:
    """A word's kind and what is hashed of it."""
    word = bare(raw)
    kind, low = PLAIN, word.lower()
    if not word:
        low = raw.decode("utf-8", "replace").translate(_DASHES)
        kind = OPERATOR if _OPERATOR.match(low) else 0
    elif not word[0].isalpha():
        m = _NUMBER.match(word)
        if m:
            money = _MONEY.match(raw.decode("utf-8", "replace"))
            kind = QUANTITY if money else NUMBER if not m[1] else QUANTITY if m[1].lower() in UNITS else PLAIN
        elif low in UNITS:
            kind = UNIT
    elif low in NUMBERS:
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    elif word[0].isupper() and word[1:].islower():
        kind = CAPITAL
    elif word[0].isupper() and word != "I" and not word.startswith(("I'", "I\u2019")):
        kind = OTHER
    return kind, low


def bare(raw: bytes) -> str:
    word = raw.decode("utf-8", "replace")
    return word if word.isalnum() else "%" if word == "%" else _OUTER.sub("", word)


_words: _Words | None = None


def _empty() -> None:
    global _words
    _words = None


STORES["words"] = _empty


def _split(texts):
    """All words of an Arrow column of texts, one after the other, and how many each text has."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(texts.view(pa.string()))
    words = parts.flatten().view(pa.binary())
    # White space at an end leaves an empty part.
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    before, offsets = np.concatenate([[0], np.cumsum(some)]), parts.offsets.to_numpy()
    return words.filter(pa.array(some)), np.diff(before[offsets - offsets[0]])


def _indexed(said):
    """Numbers of words, given as an Arrow column, in the worker's store."""
    import numpy as np

    global _words
    coded = said.dictionary_encode()
    met = coded.dictionary.to_pylist()
    fresh = met if _words is None else [w for w in met if w not in _words.index]
    if _words is None or len(_words.index) + len(fresh) > len(_words.kind):
        _words, fresh = _Words(max(_STORE, len(met))), met
    _words.add(fresh)
    at = np.fromiter(map(_words.index.__getitem__, met), np.int64, len(met))
    return at[coded.indices.to_numpy(zero_copy_only=False)], _words


class _Form:
    """Template words of a batch, given which of its words are names: where each begins among the words, text, kind,
    hash, and a hash of the words themselves."""

    def __init__(self, doc, kind, value, unit, name, joined):
        import numpy as np

        self.head = np.flatnonzero(~(unit | joined))
        made = np.where(unit | name, kind, np.where((kind == NUMBER) | (kind == QUANTITY) | (kind == OPERATOR), kind, PLAIN)).astype(np.uint8)
        made[:-1][unit[1:]] = QUANTITY
        made[name] = CAPITAL
        self.tails = np.append(self.head, len(kind))
        self.doc, self.kind = doc[self.head], made[self.head]
        self.slot = (self.kind != PLAIN) & (self.kind != OPERATOR)
        own = value[self.head]
        self.value = np.where(self.slot, self.kind.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019), own)
        nth = np.arange(len(kind)) - np.repeat(self.head, np.diff(self.tails))
        self.said = np.add.reduceat(value * (2 * nth + 1).astype(np.uint64), self.head) if len(self.head) else own
        self.plain = np.concatenate([[0], np.cumsum(self.kind == PLAIN)])

    def whole(self):
        """Which windows lie in one text."""
        n = max(0, len(self.head) - WIDTH + 1)
        return self.doc[:n] == self.doc[WIDTH - 1 : WIDTH - 1 + n]

    def hashed(self, at):
        """Of the windows that begin at `at`: the template's hash, whether it has two plain words, and the hash by which
        it aligns, which is of its values too if it hasn't."""
        import numpy as np

        made = windows_hashed(self.value, WIDTH, at)
        light = self.plain[at + WIDTH] - self.plain[at] >= 2
        firm = made.copy()
        heavy = at[~light]
        if len(heavy):
            firm[~light] = windows_hashed(np.where(self.slot, self.value + self.said, self.value), WIDTH, heavy)
        return made, light, firm


def template_windows(texts: list[list[bytes]] | tuple, may: object = None, exact: bool = False, short: tuple[int, ...] = tuple(range(1, WIDTH))):
    """Windows of the templates of texts, given as their words or as `_split` gives them: text number, place, hash, slot values, hash of the place's first form, and what
    it counts for. `may`: a filter of the hashes wanted; `exact`: also windows of the words as they are, which without
    a filter are those of texts that have no others. `short`: widths under `WIDTH`; without a filter the texts of so many
    words are one such window each, with one any such words of a text are, but a single word only if it is the text."""
    import numpy as np

    import pyarrow as pa

    if not isinstance(texts, tuple):
        texts = pa.array([w for t in texts for w in t], pa.binary()), np.array([len(t) for t in texts], np.int64)
    said, sizes = texts
    at, words = _indexed(said)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    kind, ends = words.kind[at], words.ends[at]
    fresh = np.empty(len(at), bool)
    fresh[:1] = True
    fresh[1:] = ends[:-1] | (doc[1:] != doc[:-1])
    operator = np.flatnonzero(kind == OPERATOR)
    if len(operator):
        # Elsewhere they are punctuation: dashes, bullets.
        count = np.zeros(len(kind) + 2, bool)
        count[1:-1] = (kind == NUMBER) | (kind == QUANTITY)
        before, after = operator > 0, operator + 1 < len(kind)
        before &= doc[operator - 1] == doc[operator]
        after &= doc[np.minimum(operator + 1, len(doc) - 1)] == doc[operator]
        kind[operator[~(before & count[operator] | after & count[operator + 2])]] = 0
    raw = np.flatnonzero(kind)
    doc, kind, value, fresh = doc[raw], kind[raw], words.hash[at[raw]], fresh[raw]
    beside = np.zeros(len(raw), bool)
    beside[1:] = doc[1:] == doc[:-1]
    before = np.concatenate([kind[:1] * 0, kind[:-1]]) * beside
    unit = (kind == UNIT) & (before == NUMBER)

    def form(name):
        return _Form(doc, kind, value, unit, name, name & np.concatenate([name[:1] & False, name[:-1]]) & beside & ~fresh)

    capital = kind == CAPITAL
    main = form(capital & ~fresh)
    starts = np.searchsorted(main.doc, np.arange(len(sizes)))
    place = np.zeros(len(raw) + 1, np.int64)
    place[main.head] = np.arange(len(main.head))
    begin = np.flatnonzero(main.whole())
    made, light, unit_of = main.hashed(begin)
    own = np.zeros(len(main.head), np.uint64)
    own[begin] = unit_of
    forms = [(main, begin, made, light, unit_of)]
    doubtful = capital & fresh | (kind == OTHER)
    if doubtful.any():
        second = form(capital | (kind == OTHER))
        # A word more of a name is not a template word, but makes another form of its name.
        any_ = np.add.reduceat(doubtful.astype(np.int64), second.head) > 0
        some = np.concatenate([[0], np.cumsum(any_)])
        whole = second.whole()
        begin = np.flatnonzero(whole & (some[WIDTH:] > some[:-WIDTH] if len(whole) else whole))
        forms.append((second, begin, *second.hashed(begin)))
    found, aligns = [], np.zeros(len(sizes), bool)
    for f, begin, made, light, firm in forms:
        good = np.ones(len(begin), bool) if may is None else passes(may, firm)
        aligns[f.doc[begin[good]]] = True
        found += [(f, b, h, FIRM) for b, h in zip(begin[good].tolist(), firm[good].astype(np.int64).tolist(), strict=True)]
    for f, begin, made, light, _ in forms:
        good = ~light & aligns[f.doc[begin]]
        if may is not None and good.any():
            good &= passes(may, made)
        found += [(f, b, h, SUPPORT) for b, h in zip(begin[good].tolist(), made[good].astype(np.int64).tolist(), strict=True)]
    for f, b, h, counts in found:
        d, slots = int(f.doc[b]), []
        for k in np.flatnonzero(f.slot[b : b + WIDTH]).tolist():
            slots.append(" ".join(bare(said[int(raw[j])].as_py()).lower() for j in range(f.tails[b + k], f.tails[b + k + 1])))
        at = int(place[f.head[b]])
        yield d, at - int(starts[d]), h, slots, int(own[at].astype(np.int64)), counts
    if exact:
        hashes = windows_hashed(value ^ np.uint64(0xA0761D6478BD642F), WIDTH)
        n = len(hashes)
        good = doc[:n] == doc[WIDTH - 1 : WIDTH - 1 + n]
        good &= ~aligns[doc[:n]] if may is None else passes(may, hashes)
        starts = np.searchsorted(doc, np.arange(len(sizes)))
        for i in np.flatnonzero(good).tolist():
            h = int(hashes[i].astype(np.int64))
            yield int(doc[i]), i - int(starts[doc[i]]), h, [], h, EXACT
    if not short:
        return
    length = np.bincount(doc, minlength=len(sizes))
    starts = np.searchsorted(doc, np.arange(len(sizes)))
    for width in short:
        hashes = windows_hashed(value ^ np.uint64(0x8EBC6AF09C88C6E3 + width), width)
        n = len(hashes)
        good = doc[:n] == doc[width - 1 : width - 1 + n]
        good &= length[doc[:n]] == width if may is None or width == 1 else passes(may, hashes)
        for i in np.flatnonzero(good).tolist():
            h = int(hashes[i].astype(np.int64))
            yield int(doc[i]), i - int(starts[doc[i]]), h, [], h, EXACT


def _windows(rows: DataFrame, key: str, may=None, exact: bool = True, short: tuple[int, ...] = tuple(range(1, WIDTH))) -> DataFrame:
    """key, place, hash, slots, unit, counts of the windows of `rows` (key, text as bytes)."""
    kind = rows.schema[key].dataType.simpleString()

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget(but="words")
        for batch in small_batches(batches):
            keys = batch.column(0)
            found = list(template_windows(_split(batch.column(1)), None if may is None else may.value, exact, short))
            if found:
                doc, place, hashes, slots, unit, counts = zip(*found, strict=True)
                columns = [keys.take(pa.array(doc)), pa.array(place, pa.int64()), pa.array(hashes, pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(unit, pa.int64()), pa.array(counts, pa.int32())]
                yield pa.record_batch(columns, [key, "place", "hash", "slots", "unit", "counts"])

    return rows.select(key, "text").mapInArrow(find, f"{key} {kind}, place long, hash long, slots array<string>, unit long, counts int")


def _keyed(docs: DataFrame):
    return F.unhex(F.md5(F.encode(text_or_empty(docs["text"]), "utf-8")))


def _word_counts(texts: DataFrame) -> DataFrame:
    """words: of texts of under `WIDTH` words, how many they may have. Signs alone are words only beside numbers."""
    said = F.filter(F.split(F.decode("text", "utf-8"), r"\s+"), lambda w: w != "")
    least = F.size(F.filter(said, lambda w: w.rlike(r"(?U)[\w%]")))
    few = texts.select(least.alias("least"), F.size(said).alias("most")).filter((F.col("least") < WIDTH) & (F.col("most") > 0))
    return few.select(F.explode(F.sequence(F.greatest("least", F.lit(1)), F.least("most", F.lit(WIDTH - 1)))).alias("words"))


def _candidates(found: DataFrame, item: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    """text_key and item that may share enough: they have one of the item's rarest windows in common.

    An item may lack n - ceil(share * n) of its n windows, so a text that holds it has at least one of any that many and
    one more. Taking those that fewest texts have keeps what many items and texts share, like a common opening, from
    making a pair of each."""
    often = found.groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    units = item.select("item", "unit", "hash").distinct().join(often, "hash", "left")
    units = units.groupBy("item", "unit").agg(F.coalesce(F.sum("often"), F.lit(0)).alias("often"))
    nth = F.row_number().over(Window.partitionBy("item").orderBy("often", "unit"))
    rare = units.withColumn("nth", nth).join(sizes, "item").filter(F.col("nth") <= F.col("n_windows") - F.ceil(F.lit(share) * F.col("n_windows")) + 1)
    probes = item.select("item", "unit", "hash").distinct().join(rare.select("item", "unit"), ["item", "unit"]).select("item", "hash").distinct()
    return found.select("text_key", "hash").distinct().join(probes, "hash").select("text_key", "item").distinct()


def leaked_texts(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, bits: int = FILTER_BITS) -> DataFrame:
    """text_key (md5 of the text), item_id, n_windows (of the item), n_shared, changed (values that differ)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.encode(text_or_empty(benchmark["text"]), "utf-8").alias("text"))
    texts = items.groupBy("text").agg(F.collect_set("item_id").alias("items"), F.max(F.col("item_id").isNull()).alias("unnamed"))
    texts = texts.withColumn("item", F.unhex(F.md5("text")))
    windows = staged(_windows(texts, "item"), "item-windows")
    # What stands before an item decides whether its first word is a name: that window counts only if it is alone.
    last = windows.groupBy("item").agg(F.max("place").alias("last"))
    windows = windows.join(last, "item").filter("place > 0 or last = 0").drop("last")
    sizes = windows.groupBy("item").agg(F.countDistinct("unit").alias("n_windows"))
    may = hash_filter(windows, "hash", bits)
    source = docs.select(_keyed(docs).alias("text_key"), F.encode(text_or_empty(docs["text"]), "utf-8").alias("text"))
    exact = not windows.filter(F.col("counts") == EXACT).isEmpty()
    few = tuple(r.words for r in _word_counts(texts).distinct().collect())
    found = staged(_windows(source, "text_key", may, exact, few).drop("unit").distinct(), "windows")
    item = windows.select("item", F.col("place").alias("item_place"), "hash", F.col("slots").alias("item_slots"), "unit", "counts")
    candidates = staged(_candidates(found, item, sizes, share), "candidates")
    shift = (F.col("place") - F.col("item_place")).alias("shift")
    pairs = F.arrays_zip(F.col("item_slots").alias("said"), F.col("slots").alias("says"))
    wanted = candidates.join(item.filter(F.col("counts") != SUPPORT).drop("counts"), "item")
    met = found.filter(F.col("counts") != SUPPORT).join(wanted, ["text_key", "hash"])
    met = staged(met.select("text_key", "item", shift, "unit", pairs.alias("pairs")), "met")
    # Windows of placeholders follow an alignment, so how common they are does not matter.
    likely = met.select("text_key", "item", "shift").distinct().join(item.filter(F.col("counts") == SUPPORT).drop("counts"), "item")
    likely = likely.withColumn("place", F.col("item_place") + F.col("shift"))
    more = found.filter(F.col("counts") == SUPPORT).drop("counts").join(likely, ["text_key", "place", "hash"])
    met = met.unionByName(more.select("text_key", "item", "shift", "unit", pairs.alias("pairs")))
    # An alignment has the forms of a window per place of the item at most, whatever the text.
    aligned = met.groupBy("text_key", "item", "shift").agg(
        F.collect_set("unit").alias("units"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")
    )
    said = F.size(F.array_distinct(F.col("pairs.said")))
    steady = (F.size("pairs") - said) <= F.lit(SLACK) * F.size("pairs")
    changed = F.size(F.filter("pairs", lambda p: p["said"] != p["says"]))
    spread = aligned.filter(steady).select("text_key", "item", changed.alias("changed"), F.explode("units").alias("unit"))
    shared = spread.groupBy("text_key", "item").agg(F.countDistinct("unit").alias("n_shared"), F.max("changed").alias("changed"))
    held = shared.join(sizes, "item").filter(F.col("n_shared") >= F.lit(share) * F.col("n_windows"))
    named = texts.select("item", F.explode(F.concat("items", F.when(F.col("unnamed"), F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>")))).alias("item_id"))
    return held.join(named, "item").select("text_key", "item_id", "n_windows", "n_shared", F.col("changed").cast("long").alias("changed"))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """A row per document and item that it holds."""
    held = staged(leaked_texts(docs, benchmark, share), "leaks")
    return docs.select("doc_id", _keyed(docs).alias("text_key")).join(held, "text_key").drop("text_key")


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """`docs` without those that hold an item; columns as they are."""
    held = staged(leaked_texts(docs, benchmark, share).select("text_key").distinct(), "leaks")
    return docs.join(held, _keyed(docs) == held["text_key"], "left_anti")