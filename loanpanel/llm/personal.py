"""Personal data with DataFrame functions only: patterns propose spans, checks confirm them, and the words
nearby adjust the score.

A pattern's matches cut a text into gaps; the lengths of gaps and matches, summed up, give the places, and
the ends of the two gaps around a match are its context. Nothing is shuffled, and a text is read once by
each pattern (twice where it matches). The patterns of the fixed kinds are written so that Java's engine
neither backs up nor recurses: a lookbehind keeps a match from being tried inside a run that has just
failed, and possessive repeats take no stack. They match what the plain patterns in the comments match.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 128                         # matches whose places are summed up together, so the work stays linear
BEFORE, AFTER = 40, 20              # characters of context

# Length of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
#: words that make any number or address less likely to be somebody's
DOUBTFUL = "example|sample|test|version|serial|isbn|order no|invoice"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(letters: Column) -> Column:
    """The remainder by 97 of digits and capital letters (A is 10), read as a number."""
    def add(rest: Column, i: Column) -> Column:
        a = F.ascii(F.substring(letters, i, F.lit(1)))
        return F.when(a < 58, rest * 10 + a - 48).otherwise(rest * 100 + a - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(letters), F.lit(1))), F.lit(0), add)


def _iban_end(hit: Column) -> Column:
    """Characters of a match that belong to the IBAN: its country's length, with the blanks of groups of four."""
    country = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    n = F.coalesce(F.try_element_at(country, F.substring(hit, 1, 2)), F.lit(0))
    return F.when(F.substring(hit, 5, 1) == " ", n + F.floor((n - 1) / 4).cast("int")).otherwise(n)


def _iban(hit: Column, before: Column, after: Column) -> Column:
    end = _iban_end(hit)
    own = F.translate(F.substring(hit, F.lit(1), end), " ", "")
    edge = F.when(F.length(hit) > end, F.substring(hit, end + 1, F.lit(1)) == " ").otherwise(~after.rlike("^[A-Za-z0-9]"))
    return (end > 0) & (F.length(hit) >= end) & edge & ~before.rlike("[A-Za-z0-9]$") & (mod97(F.concat(F.substring(own, F.lit(5), F.length(own)), F.substring(own, 1, 4))) == 1)


def _part_at_most_255(hit: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


@dataclass(frozen=True)
class Kind:
    """A kind of span: ``valid`` takes a match and the gaps before and after it; ``score`` is in percent and
    grows by 20 near one of the ``near`` words, and falls by 20 near a doubtful one. ``least`` is the score
    from which a span counts; that of a fixed kind is 0, so its spans stay. ``hint`` has to be found in a
    text for the pattern to be tried, ``end`` is the part of a match that is the span."""
    pattern: str
    hint: str
    valid: Callable[[Column, Column, Column], Column]
    score: int
    near: str
    least: int = 0
    end: Callable[[Column], Column] = F.length


def _phone_length(hit: Column) -> Column:
    return F.length(_digits(hit)).between(10, 15)


KINDS: Mapping[str, Kind] = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": Kind(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
                  lambda hit, before, after: F.lit(True), 80, "e-?mail|mail|contact|mailto|write to"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": Kind(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]",
               lambda hit, before, after: _part_at_most_255(hit), 60, "ip|ip address|host|server|login from"),
    # [0-9]([\x20-]?[0-9])+ ; fewer than 14 digits are dropped anyway
    "card": Kind(r"[0-9](?:[ -]?[0-9]){13,}+", r"[0-9][ -]?[0-9]",
                 lambda hit, before, after: F.length(_digits(hit)).between(14, 19) & luhn(_digits(hit)), 80, "card|credit|debit|visa|mastercard|amex|payment"),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": Kind(r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]",
                  lambda hit, before, after: _phone_length(hit), 70, "phone|telephone|tel|call|mobile|cell|fax"),
    "iban": Kind(r"[A-Z][A-Z][0-9][0-9](?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", "[A-Z][A-Z][0-9][0-9]", _iban,
                 80, "iban|account|bank|transfer", 60, _iban_end),
    "ssn": Kind("[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9][0-9]-[0-9]",
                lambda hit, before, after: ~hit.rlike("^(?:000|666|9)|-00-|-0000$") & ~before.rlike("[0-9-]$") & ~after.rlike("^[0-9-]"),
                40, "ssn|social security|social security number|taxpayer", 60),
    "tel": Kind(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "[0-9][ .-][0-9]",
                lambda hit, before, after: ~before.rlike(r"[0-9+][ ().-]{0,3}$") & ~after.rlike("^[ .-]?[0-9]"),
                40, "phone|telephone|tel|call|mobile|cell|fax", 60),
}
FIXED = ("email", "ip", "card", "phone")
_SPAN = "array<struct<start:int,end:int,good:boolean,score:int>>"


def _near(context: Column, words: str) -> Column:
    return F.translate(context, UPPER, LOWER).rlike(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")


def _placed(matches: str) -> Column:
    """Spans from the matches' lengths: sums within blocks of matches, then over the blocks."""
    def within(a: Column, x: Column) -> Column:
        at = a["at"] + x["gap"]
        span = F.struct(at.alias("start"), (at + x["own"]).alias("end"), x["good"].alias("good"), x["score"].alias("score"))
        return F.struct((at + x["size"]).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    def over(a: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda x: F.struct((x["start"] + a["at"]).alias("start"), (x["end"] + a["at"]).alias("end"), x["good"].alias("good"), x["score"].alias("score")))
        return F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(F.filter(moved, lambda x: x["good"]))).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.size(matches) - 1, F.lit(BLOCK)), lambda i: F.aggregate(F.slice(matches, i + 1, BLOCK), none, within))
    total = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), over, lambda a: F.flatten(a["out"]))
    return F.when(F.size(matches) > 0, total).otherwise(F.array().cast(_SPAN))


def personal_spans(docs: DataFrame, text_col: str = "text", kinds: Mapping[str, Kind] = KINDS, into: str = "spans") -> DataFrame:
    """``docs`` with a column ``into``: array of (start, rank, end, kind, score) by start, then by the kinds'
    order; code points, the end exclusive, the score in percent, rank the kind's place in ``kinds``.

    A null or empty text has no span; repeated rows each have theirs; an empty table stays empty; other
    columns, whatever their names, stay as they are (one called ``into`` is replaced).
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for name, kind in kinds.items():
        hits = F.when(F.col("text").rlike(kind.hint), F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))).otherwise(none)
        rows = rows.withColumn(f"h_{name}", hits)
    rows = rows.withColumns({f"g_{name}": F.when(F.size(f"h_{name}") > 0, F.split("text", kind.pattern, -1)).otherwise(none) for name, kind in kinds.items()})

    def looked_at(name: str, kind: Kind) -> Column:
        gaps = F.col(f"g_{name}")
        triples = F.arrays_zip(F.col(f"h_{name}").alias("hit"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("before"),
                               F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))).alias("after"))

        def one(x: Column) -> Column:
            hit, before, after = x["hit"], x["before"], x["after"]
            context = F.concat_ws(" ", F.right(before, F.lit(BEFORE)), F.left(after, F.lit(AFTER)))
            valid = kind.valid(hit, before, after)
            score = F.when(valid, F.lit(kind.score) + F.when(_near(context, kind.near), 20).otherwise(0) - F.when(_near(context, DOUBTFUL), 20).otherwise(0)).otherwise(0)
            return F.struct(F.length(before).alias("gap"), F.length(hit).alias("size"), kind.end(hit).alias("own"), valid.alias("valid"), score.alias("score"))

        return F.transform(F.transform(triples, one), lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), x["own"].alias("own"), (x["valid"] & (x["score"] >= kind.least)).alias("good"), x["score"].alias("score")))

    rows = rows.withColumns({f"m_{name}": looked_at(name, kind) for name, kind in kinds.items()})
    def named(k: int, name: str) -> Column:
        return F.transform(_placed(f"m_{name}"), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end"), F.lit(name).alias("kind"), x["score"].alias("score")))

    rows = rows.select("row", F.array_sort(F.concat(*[named(k, name) for k, name in enumerate(kinds)])).alias("found"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != into], F.col("found").alias(into))


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, the number of spans of each kind, the digest of the fixed kinds' spans, all spans and their
    scores as text, from the rows of ``personal_spans``."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")      # noqa: E731
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")                             # noqa: E731
    return found.select(
        F.col(id_col).alias("doc_id"), *[count(k) for k in KINDS],
        F.sha2(joined(F.filter("spans", lambda x: x["rank"] < len(FIXED))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores"))


def redact_personal(docs: DataFrame, text_col: str = "text", kinds: Mapping[str, Kind] = KINDS, least: int = 0) -> DataFrame:
    """``docs`` with every span of ``least`` percent or more replaced by its kind in brackets; where spans
    overlap, the first one's kind stands for their union. A null text stays null, the other columns stay."""
    into = "spans"
    while into in docs.columns:
        into += "_"
    found = personal_spans(docs, text_col, kinds, into)
    text = F.col(f"`{text_col}`")

    def step(a: Column, x: Column) -> Column:
        new = x["start"] >= a["at"]
        piece = F.concat(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(new, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    spans = F.filter(F.col(f"`{into}`"), lambda x: x["score"] >= least)
    clean = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    out = F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(clean)
    return found.select(*[out.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
