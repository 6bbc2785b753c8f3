"""A suffix array by induced sorting, and its permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than the next one; the leftmost-smaller substrings are sorted by one
induction, named, and their order is refined recursively over names of twice as many; a second induction places all
suffixes. An induction goes through the buckets of first bytes and moves whole blocks, so it is linear and has no loop
over bytes. Separators between strings are smaller than any byte and differ from each other, so nothing common reaches
over one."""

from __future__ import annotations

import numpy as np

#: Symbols: 0 ends the whole, 1 separates, a byte is two more.
END, SEPARATOR, SHIFT = 0, 1, 2
SYMBOLS = 256 + SHIFT


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings as one text with a separator after each, and where they start."""
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.full(starts[-1] + 1, SEPARATOR, np.int16)
    bytes_ = np.frombuffer(b"".join(strings), np.uint8)
    text[np.arange(len(bytes_)) + np.repeat(np.arange(len(sizes)), sizes)] = bytes_.astype(np.int16) + SHIFT
    text[-1] = END
    return text, starts[:-1]


def classified(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next."""
    n = len(text)
    smaller = np.ones(n, bool)
    differs = text[:-1] != text[1:]
    at = np.where(differs, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller[:-1] = (text[:-1] < text[1:])[np.minimum(at, n - 2)]
    return smaller


def _within(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol, the symbols in it, and each one's number among its equals."""
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    number = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
    return order, ordered, number


def induced(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in theirs."""
    n = len(text)
    sizes = np.bincount(text, minlength=SYMBOLS)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    array = np.full(n, -1, np.int64)
    order, symbols, number = _within(text[leftmost])
    seeds = np.bincount(symbols, minlength=SYMBOLS)
    array[tails[symbols] - seeds[symbols] + number] = leftmost[order]

    def spread(block: np.ndarray, fill: np.ndarray, kind: bool, step: int) -> None:
        before = block[block > 0] - 1
        before = before[(smaller[before] == kind) & (text[before] > SEPARATOR) if kind else ~smaller[before]]
        if len(before):
            order, symbols, number = _within(text[before])
            array[fill[symbols] + step * number] = before[order]
            fill += step * np.bincount(symbols, minlength=SYMBOLS)

    fill = heads.copy()
    for c in range(SYMBOLS):
        if not sizes[c]:
            continue
        at = heads[c]
        while at < fill[c]:
            at, block = fill[c], array[at : fill[c]].copy()
            spread(block, fill, False, 1)
        spread(array[tails[c] - seeds[c] : tails[c]].copy(), fill, False, 1)
    larger = fill.copy()
    fill = tails - 1
    # Separators keep the order they came in, as symbols that differ; nothing smaller stands before one.
    for c in range(SYMBOLS - 1, SEPARATOR, -1):
        if not sizes[c]:
            continue
        at = tails[c] - 1
        while at > fill[c]:
            at, block = fill[c], array[fill[c] + 1 : at + 1][::-1].copy()
            spread(block, fill, True, -1)
        spread(array[heads[c] : larger[c]][::-1].copy(), fill, True, -1)
    return array


def _refined(names: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of a text of names, by names of twice as many names until all differ."""

    def twice(rank: np.ndarray, span: int) -> np.ndarray:
        if rank.max(initial=0) == len(rank) - 1:
            return rank
        after = np.zeros(len(rank), np.int64)
        after[:-span] = rank[span:] + 1
        return twice(np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1], 2 * span)

    return twice(np.unique(names, return_inverse=True)[1], 1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    n = len(text)
    smaller = classified(text)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[1:] = smaller[1:] & ~smaller[:-1]
    places = np.flatnonzero(is_leftmost)
    by_part = induced(text, smaller, places[np.argsort(text[places], kind="stable")])
    by_part = by_part[is_leftmost[by_part]]
    # Equal substrings, from one leftmost-smaller place to the next, get equal names; a separator has a name of its own.
    power = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(0x51ED27)) * power)])
    ends = np.append(places[1:], n - 1)
    number = np.empty(n, np.int64)
    number[places] = np.arange(len(places))
    start, end = by_part, ends[number[by_part]]
    size = end - start
    hashes = (sums[end + 1] - sums[start]) * power[n - 1 - start]
    new = np.ones(len(start), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (size[1:] != size[:-1])
    lead = text[start]
    new |= lead == SEPARATOR
    names = np.empty(len(places), np.int64)
    separators = np.sort(start[lead == SEPARATOR])
    ordered = np.concatenate([start[lead == END], separators, start[lead > SEPARATOR]])
    names[number[ordered]] = np.cumsum(new) - 1
    ranks = _refined(names)
    leftmost = np.empty(len(places), np.int64)
    leftmost[ranks] = places
    return induced(text, smaller, leftmost)


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each place in text order, how much its suffix shares with the one before it in suffix order.

    Only places whose symbol before differs from that before their neighbour are compared; the rest lose one symbol
    from place to place."""
    n = len(text)
    neighbour = np.full(n, n - 1, np.int64)
    neighbour[array[1:]] = array[:-1]
    room = np.where(text <= SEPARATOR, np.arange(n), n)
    room = np.minimum.accumulate(room[::-1])[::-1] - np.arange(n)
    starts = np.ones(n, bool)
    starts[1:] = (text[:-1] != text[neighbour[1:] - 1]) | (text[:-1] <= SEPARATOR) | (neighbour[1:] == 0)
    own = np.flatnonzero(starts)
    other = neighbour[own]
    most = np.minimum(room[own], room[other])
    four = np.zeros(n + 4, np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.int16)]).astype(np.uint64)
    for k in range(4):
        four |= padded[k : n + 4 + k] << np.uint64(16 * k)
    shared = np.zeros(len(own), np.int64)
    going = np.arange(len(own))
    while len(going):
        at = shared[going]
        on = at < most[going]
        going, at = going[on], at[on]
        differs = four[own[going] + at] ^ four[other[going] + at]
        low = (differs & (~differs + np.uint64(1))).astype(np.float64)
        step = np.where(differs == 0, 4, np.log2(np.maximum(low, 1)).astype(np.int64) // 16)
        shared[going] += step
        going = going[step == 4]
    shared = np.minimum(shared, most)
    last = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    full = np.zeros(n, np.int64)
    full[own] = shared
    return np.maximum(full[last] - (np.arange(n) - last), 0)


def repeated(strings: list[bytes], size: int) -> list[np.ndarray]:
    """For each string, which of its substrings of `size` bytes, by start, are found at another place."""
    text, starts = joined(strings)
    array = suffix_array(text)
    common = permuted_common_prefixes(text, array)
    common[array[0]] = 0
    enough = common >= size
    after = np.zeros(len(text), bool)
    after[array[:-1]] = enough[array[1:]]
    found = enough | after
    return [found[s : s + max(0, len(x) - size + 1)] for s, x in zip(starts.tolist(), strings, strict=True)]
