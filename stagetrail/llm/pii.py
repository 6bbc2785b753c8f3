"""Personal data in texts, by Spark expressions only: patterns propose, checksums confirm, nearby words adjust.

A kind has a pattern, a check of the matched text and words that speak for or against it. Matches are leftmost and do
not overlap within a kind. A span's score is its kind's prior, plus a share for a passed checksum, plus or minus one
for words within 40 characters; `floor` is the least score at which it counts. Kinds whose prior reaches their floor
whatever the words say are found by pattern and check alone.

Places are code points, ends exclusive. They come from the lengths of matches and of the text between them, summed in
blocks, so a text with very many matches stays cheap. Repeats are possessive and runs are entered at their start
only (or where the match before ended), so long runs of one character class take linear time and no stack.

Edge cases: a null text is empty and has no spans; repeated rows each have their own; no rows give no rows; other
columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagetrail.llm.common import kept_whole

#: Matches whose lengths are summed in one go.
BLOCK = 64
NEAR = 40


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def luhn(value: Column) -> Column:
    """The digits' Luhn sum ends in 0; every second digit from the right but one counts twice, less 9 from 10 on."""

    def weighed(code: Column, i: Column) -> Column:
        twice = (code - 48) * (1 + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(_codes(F.reverse(digits_of(value))), weighed), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Of an account number, its first four characters moved to the end and letters read as 10 to 35: 1 modulo 97."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    rest = F.aggregate(_codes(moved), F.lit(0), lambda a, c: F.when(c < 65, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97)
    return rest == 1


def n_digits(value: Column, least: int, most: int) -> Column:
    return F.length(digits_of(value)).between(least, most)


@dataclass(frozen=True)
class Kind:
    name: str
    #: A cheap sign without which the pattern can't match.
    sign: str
    pattern: str
    check: Callable[[Column], Column]
    prior: float
    checked: float
    floor: float
    speaks_for: str
    speaks_against: str = r"\b(?:order|invoice|version|sample|example)\b"


_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: In the order in which spans with one start are told. The first four count whatever stands near them.
KINDS = (
    Kind("email", "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", lambda v: F.lit(True), 0.8, 0.0, 0.0, "mail|contact|write"),
    Kind(
        "ip",
        r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
        r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
        lambda v: v.rlike(rf"^(?:(?:^|\.){_PART}(?![0-9])){{4}}$"),
        0.6,
        0.2,
        0.0,
        r"\bip\b|address|host|server|login",
    ),
    Kind(
        "card",
        "[0-9](?:[ -]?[0-9]){13}",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda v: F.when(n_digits(v, 14, 19), luhn(v)).otherwise(False),
        0.3,
        0.5,
        0.0,
        "card|visa|master|credit|debit|pay",
    ),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: n_digits(v, 10, 15), 0.6, 0.1, 0.0, "phone|call|tel|mobile|fax"),
    Kind(
        "iban",
        "[A-Z]{2}[0-9]{2}",
        r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        mod97,
        0.2,
        0.6,
        0.7,
        "iban|account|bank|transfer|konto|cuenta|compte",
    ),
    Kind(
        "ssn",
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda v: F.lit(True),
        0.4,
        0.0,
        0.5,
        "ssn|social|security",
    ),
)
BASE = tuple(k.name for k in KINDS[:4])


def _proposed(text: Column, kind: Kind) -> Column:
    """Matches and the text between them, one more of the latter; null without the kind's sign."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("values"), F.split(text, kind.pattern, -1).alias("gaps")
    )
    return F.when(F.contains(text, F.lit("@")) if kind.sign == "@" else text.rlike(kind.sign), found)


def _sums(lengths: Column) -> Column:
    last = F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), F.lit(0), lambda a, x: a + x))


def _total(array: Column, start: Column, number: Column) -> Column:
    return F.aggregate(F.slice(array, start, number), F.lit(0), lambda a, x: a + x)


def _spans(rank: int, kind: Kind, found: Column, heads: Column, lengths: Column) -> Column:
    """Confirmed spans of one kind. Element by element beside its place: nothing is looked up in the text again."""
    starts = F.transform(
        lengths, lambda _, i: F.element_at(heads, (F.floor(i / BLOCK) + 1).cast("int")) + _total(lengths, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK)
    )
    n = F.size(found["values"])
    rows = F.arrays_zip(
        starts.alias("at"), found["values"].alias("value"), F.slice(found["gaps"], 1, n).alias("gap"), F.slice(found["gaps"], 2, n).alias("next")
    )

    def span(x: Column) -> Column:
        start = x["at"] + F.length(x["gap"])
        near = F.lower(F.concat(F.right(x["gap"], F.lit(NEAR)), F.lit(" | "), F.left(x["next"], F.lit(NEAR))))
        words = F.when(near.rlike(kind.speaks_for), 0.2).otherwise(0.0) - F.when(near.rlike(kind.speaks_against), 0.2).otherwise(0.0)
        return F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind.name).alias("kind"),
            (start + F.length(x["value"])).alias("end"),
            x["value"].alias("value"),
            (F.lit(kind.prior + kind.checked) + words).alias("score"),
        )

    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string,score:double>>")
    good = F.filter(F.transform(F.filter(rows, lambda x: kind.check(x["value"])), span), lambda s: s["score"] >= kind.floor)
    return F.coalesce(F.when(n > 0, good), none)


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii_spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """`docs` with `into`: its spans (start, rank, kind, end, value, score) by start, then by kind as listed."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    row = kept_whole(row, **{f"found_{k.name}": _proposed(F.col("text"), k) for k in kinds}).drop("text")

    def lengths(k: Kind) -> Column:
        f = F.col(f"found_{k.name}")
        return F.zip_with(f["values"], F.slice(f["gaps"], 1, F.size(f["values"])), lambda v, g: F.length(v) + F.length(g))

    row = kept_whole(row, **{f"lengths_{k.name}": lengths(k) for k in kinds})
    row = kept_whole(row, **{f"sums_{k.name}": F.when(F.size(f"lengths_{k.name}") > 0, _sums(F.col(f"lengths_{k.name}"))) for k in kinds})

    def heads(k: Kind) -> Column:
        sums = F.col(f"sums_{k.name}")
        return F.transform(sums, lambda _, i: _total(sums, F.lit(1), i))

    row = kept_whole(row, **{f"heads_{k.name}": heads(k) for k in kinds})
    spans = [_spans(i, k, F.col(f"found_{k.name}"), F.col(f"heads_{k.name}"), F.col(f"lengths_{k.name}")) for i, k in enumerate(kinds)]
    return row.select("row.*", F.sort_array(F.concat(*spans)).alias(into))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first names the place."""

    def put(a: Column, s: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        out = F.when(s["start"] >= a["at"], fresh).otherwise(a["out"])
        return F.struct(out.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate(spans, begin, put, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(2**31 - 1))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def pii_digest(found: DataFrame, spans: str = "pii_spans") -> DataFrame:
    def told(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def only(*names: str) -> Column:
        return F.filter(spans, lambda s: s["kind"].isin(*names))

    return found.select(
        "doc_id",
        *[F.size(only(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(told(only(*BASE)), 256).alias("base_sha256"),
        told(F.col(spans)).alias("spans"),
        F.transform(spans, lambda s: F.round(s["score"], 2)).alias("scores"),
    )
