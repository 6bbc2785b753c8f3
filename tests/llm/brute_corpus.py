"""The contracts in plain Python, by the shortest way."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = list(zip(w, w[1:], w[2:]))
    times, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def luhn(digits):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    t = text or ""
    found = [(m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(KINDS.items()) for m in re.finditer(p, t) if ok(m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def repeats(texts, size=200):
    data = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    made = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if times[b[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        made.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return made


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    k = min(5, max(1, len(w)))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1) if w)


def near_classes(rows):
    """doc_id to the smallest doc_id of its class."""
    bags = {i: shingles(t) for i, t in rows}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            x, y = bags[i], bags[j]
            both, whole = sum((x & y).values()), sum(x.values()) + sum(y.values())
            if both >= 0.8 * (whole - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def word_scores(rows):
    """doc_id to (held_out, n_tokens, n_known, N, base_score)."""

    def tokens(t):
        return [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), None]

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(x for i, t in rows if not held[i] for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return {
        i: (held[i], len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)))
        for i, t in rows
    }


def warc_rows(rows):
    last = {}
    for i, h in rows:
        last[h or ""] = max(last.get(h or "", i), i)
    made = {}
    for i, h in rows:
        b, r = (h or "").encode(), last[h or ""]
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        made[i] = (len(b), digest, "response" if r == i else "revisit", None if r == i else r)
    return made


def item_windows(text):
    w = [x for x in (re.sub(r"^\W+|\W+$", "", x).lower() for x in text.split()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def by_id(df, *columns):
    made = defaultdict(list)
    for r in df.collect():
        made[r[0]].append(tuple(r[c] for c in columns))
    return made


def robust_distances(x, share=0.75, steps=6):
    """Distances of the rows of `x` (whole 1/1024ths) from their minimum covariance determinant, by dense numpy."""
    from stagetrail.llm.quality import BINS, MEDIAN_CHI2_5, SPREADS, UNIT

    x = np.asarray(x, float) / UNIT
    floor = np.square(list(SPREADS.values()))

    def estimate(mean, scatter):
        scatter = scatter + np.diag(np.maximum(floor - np.diag(scatter), 0))
        return mean, np.linalg.inv(scatter), np.linalg.det(scatter)

    def squared(e):
        return np.einsum("ni,ij,nj->n", x - e[0], e[1], x - e[0])

    def nearest(e, part):
        bins = np.floor(np.log(np.maximum(squared(e), 0) + 1e-9) * BINS)
        # Whole bins, until the part is reached.
        return bins, bins <= np.sort(bins)[math.ceil(len(x) * part) - 1]

    q = np.percentile(x, [25, 50, 75], axis=0)
    found = []
    for e in (estimate(x.mean(axis=0), np.cov(x.T, bias=True)), estimate(q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2))):
        for _ in range(steps):
            some = x[nearest(e, share)[1]]
            e = estimate(some.mean(axis=0), np.cov(some.T, bias=True))
        found.append(e)
    best = min(found, key=lambda e: e[2])
    bins, half = nearest(best, 0.5)
    return np.sqrt(squared(best) / max(1.0, math.exp((bins[half].max() + 1) / BINS) / MEDIAN_CHI2_5))
