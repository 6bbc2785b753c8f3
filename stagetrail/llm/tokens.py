"""Token ids of whole texts by a public tokenizer that drops white space.

Such a tokenizer's ids of a text are the ids of its parts between white space, one after another, so each part
is encoded once a worker and looked up afterwards, as long as a store of fixed size keeps it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import compress, count
from operator import not_

from stagetrail.llm.common import STORES

#: Parts that a worker keeps; a new half begins when one is full, and what is met again moves over from the old one.
STORE = 600_000
#: Bytes of texts whose new parts are encoded in one call.
GROUP = 1 << 20


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


#: Marks after a letter at the end of a part. Of the letters beyond ASCII only those are known that UTF-8 begins with xC3.
_MARK = re.compile(rb"([.,:;!?%&$#*])(?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))([.,:;!?%&$#*]*)(?=[\x20\t-\r]|\Z)")
#: Words that a normalizer of lower case leaves as they are once they are in lower case.
_LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _same_ids(path: str, one: str, other: str) -> bool:
    t = tokenizer(path)
    return t.encode(one, add_special_tokens=False).ids == t.encode(other, add_special_tokens=False).ids


@cache
def _parts_marks(path: str) -> bool:
    """Whether the tokenizer lower-cases and parts words from marks, so that parts can be told apart more finely."""
    same = _same_ids(path, "Ab Cdefg, \u00c9T\u00c9x. end.%%% \u00e9\u00c9&&& go!!:;?$#*", "ab cdefg , \u00e9t\u00e9x . end .%%% \u00e9\u00e9 &&& go !!:;?$#*")
    return same and "Lowercase" in str(tokenizer(path).normalizer)


@cache
def _word_tokenizer(path: str):
    """The same merges for lower-case words with a space between, and which ids end a word; None if ids don't tell.

    Normalizing and parting by a pattern cost more than the merges, and words of letters don't need them."""
    import numpy as np
    from tokenizers import Tokenizer, pre_tokenizers

    t = tokenizer(path)
    suffix = getattr(t.model, "end_of_word_suffix", None)
    if not suffix or not _parts_marks(path):
        return None
    vocabulary = t.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
    # The model is shared, not copied.
    made = Tokenizer(t.model)
    letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), letters])
    words = "a be the qzxj gr\u00f6\u00dfe \u00e9t\u00e9 anthropomorphisms"
    ids = made.encode(words, add_special_tokens=False).ids
    same = ids == t.encode(words, add_special_tokens=False).ids and ends[ids].sum() == len(words.split())
    return (made, ends) if same else None


def _word_ids(words: list[str], path: str) -> Iterator[bytes]:
    """Ids of each of the lower-case words, many in one call."""
    import numpy as np

    made, ends = _word_tokenizer(path)
    for at in range(0, len(words), 4096):
        line = " ".join(words[at : at + 4096])
        ids = np.array(made.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        cuts, held = ((np.flatnonzero(ends[ids]) + 1) * 4).tolist(), ids.tobytes()
        yield from map(held.__getitem__, map(slice, [0, *cuts], cuts))


class _Store:
    """Ids of parts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.path, self.tokenizer, self.young, self.old = path, tokenizer(path), {}, {}

    def learn(self, parts: set[bytes]) -> dict[bytes, bytes]:
        """Ids of parts that the young half lacks."""
        import numpy as np

        met = {p: ids for p in parts if (ids := self.old.get(p)) is not None}
        new = {p: p.decode() for p in parts if p not in met}
        if _word_tokenizer(self.path):
            words = {p: w.lower() for p, w in new.items() if _LETTERS.fullmatch(w)}
            met.update(zip(words, _word_ids([*words.values()], self.path), strict=True))
            new = {p: w for p, w in new.items() if p not in words}
        made = self.tokenizer.encode_batch_fast([*new.values()], add_special_tokens=False)
        met.update((p, np.array(m.ids, "<u4").tobytes()) for p, m in zip(new, made, strict=True))
        if len(self.young) + len(met) > STORE // 2:
            self.old, self.young = self.young, {}
        if len(met) <= STORE // 2:
            self.young.update(met)
        return met


@cache
def _store(path: str) -> _Store:
    return _Store(path)


def _empty() -> None:
    for held in (_store, _word_tokenizer, tokenizer):
        held.cache_clear()


STORES["tokens"] = _empty


def _groups(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= GROUP:
            yield held
            held, size = [], 0
    yield held


def encoded(texts: Iterable[bytes], path: str) -> Iterator[bytes]:
    """The ids of each UTF-8 text as little-endian unsigned 32-bit numbers."""
    store, finer = _store(path), _parts_marks(path)
    for group in _groups(texts):
        parts = [(_MARK.sub(rb" \1\2", text.lower()) if finer else text).split() for text in group]
        ids = [list(map(store.young.get, p)) for p in parts]
        gaps = [list(compress(count(), map(not_, found))) for found in ids]
        new = store.learn({own[i] for own, at in zip(parts, gaps, strict=True) for i in at})
        for own, found, at in zip(parts, ids, gaps, strict=True):
            for i in at:
                found[i] = new[own[i]]
            yield b"".join(found)
