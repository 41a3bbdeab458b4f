"""Secret scan: fixed patterns, and the guess cost of values that stand where a credential is assigned.

The guess cost of a value is the least sum, over all cuts of it into spans, of the log10 guesses of
each span: a dictionary word, a date, a run of repeats, a keyboard walk, an ordered sequence, or
single characters tried by brute force. It is found by dynamic programming over the positions; every
kind of span is bounded in length or charged by a run, so the work is linear in the value's length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.llm.common import numbered

# The scan's patterns (letters of the key names in either case, ASCII only).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN = 12
#: where a credential's value stands: a wider set of key names, any quoted or unbroken value
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|credentials?|private[_-]?key|access[_-]?key)"
    r"""["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:"([^"\s]+)"|'([^'\s]+)'|([^\s"',;<>()]+))""", re.IGNORECASE | re.ASCII)
KEYWORD = re.compile(r"pass|pwd|secret|token|api|credential|private|access", re.IGNORECASE | re.ASCII)

# Words people use in passwords, most used first (their rank is their guess count).
WORDS = """password qwerty letmein welcome monkey dragon master login admin sunshine princess football
baseball shadow superman michael ashley bailey access flower passw0rd trustno hello freedom whatever
charlie jordan hunter killer soccer hockey batman ranger thomas robert daniel starwars computer george
summer winter spring autumn love secret test user guest root default changeme example sample dummy demo
token key api null none true false enter your here my the and for not with this that from have were
value string text placeholder redacted hidden please insert""".split()
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
RANK = {w: k + 1 for k, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
DATE_COST = math.log10(365 * 120)
YEAR_COST = math.log10(120)
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
NEIGHBOURS = {(a, b) for row in KEY_ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in KEY_ROWS for a, b in zip(row, row[1:])}
NEIGHBOURS |= {(x, y) for up, low in zip(KEY_ROWS[1:], KEY_ROWS[2:]) for x, y in [*zip(up, low), *zip(low, up)]}


def _char_cost(value: str) -> float:
    """log10 guesses of one character: of the character classes that the value draws from."""
    size = 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value)
    return math.log10(size + 33 * any(not c.isalnum() for c in value) or 10)


def _runs(value: str, follows) -> list[int]:
    """For each position, the start of the longest run that ends there in which each neighbour follows."""
    start = list(range(len(value)))
    for i in range(1, len(value)):
        if follows(value[i - 1], value[i]):
            start[i] = start[i - 1]
    return start


def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value`` (0 for an empty one)."""
    low = value.lower()
    if len(low) != len(value):      # a character whose lower case is longer: fold ASCII only
        low = value.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    leet, char = low.translate(LEET), _char_cost(value)
    runs = [_runs(low, lambda a, b: a == b),
            _runs(low, lambda a, b: (a, b) in NEIGHBOURS),
            _runs(low, lambda a, b: ord(b) - ord(a) == 1),
            _runs(low, lambda a, b: ord(a) - ord(b) == 1)]
    dates: dict[int, list[tuple[int, float]]] = {}
    for i in range(len(low)):
        if low[i].isdigit() and (m := DATE.match(low, i)):
            dates.setdefault(m.end(), []).append((i, YEAR_COST if len(m[0]) == 4 else DATE_COST))
    best = [0.0] * (len(value) + 1)
    for end in range(1, len(value) + 1):
        cost = best[end - 1] + char
        for length in range(3, min(LONGEST_WORD, end) + 1):
            for form, extra in ((low, 0.0), (leet, 0.3)):
                if rank := RANK.get(form[end - length:end]):
                    upper = 0.0 if value[end - length:end] == low[end - length:end] else 0.3
                    cost = min(cost, best[end - length] + math.log10(rank + 1) + extra + upper)
        for first in runs:
            if end - (s := first[end - 1]) >= 3:            # a run costs its first character and its length
                cost = min(cost, best[s] + char + math.log10(end - s))
        for s, c in dates.get(end, ()):
            cost = min(cost, best[s] + c)
        best[end] = cost
    return best[-1]


@lru_cache(maxsize=1 << 16)
def _cached_cost(value: str) -> float:
    return guess_cost(value)


def scan(text: str | None, min_cost: float = 9.0, min_length: int = 8) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points; kinds assign, access, hex, and guess for a value in
    credential context of ``min_length`` characters and ``min_cost`` log10 guesses or more."""
    if not text:
        return []
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if KEYWORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
        for m in CONTEXT.finditer(text):
            k = m.lastindex
            if k and len(m[k]) >= min_length:
                cost = _cached_cost(m[k]) if len(m[k]) <= 256 else guess_cost(m[k])
                if cost >= min_cost:
                    out.append((m.start(k), m.end(k), "guess"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


KINDS = ("assign", "access", "hex", "guess")


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str | None, spans) -> str | None:
    """The text with each covered stretch replaced by ``[SECRET]``; overlapping spans become one."""
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end, _ in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = 9.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the fixed kinds and of guess, the digest of the
    fixed spans and all spans as text.

    A null text is empty and has no span; repeated rows each return a row; an empty table returns
    none; other columns are not read. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, spans = {k: [] for k in KINDS}, [], []
            for t in b.column(1):
                found = scan(t.as_py(), min_cost)
                for k in KINDS:
                    n[k].append(sum(s[2] == k for s in found))
                digests.append(hashlib.sha256(_joined(s for s in found if s[2] != "guess").encode()).hexdigest())
                spans.append(_joined(found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", min_cost: float = 9.0) -> DataFrame:
    """``docs`` with every secret span replaced; rows without one stay as they are, null texts too.
    ``length_col``, if the table has it, is set to the new length of texts that changed. Columns keep
    their names, whatever these are."""
    @F.udf("string", useArrow=True)
    def clean(text):
        return redact(text, scan(text, min_cost))

    names = docs.columns
    text, new = f"c{names.index(text_col)}", F.col("clean")
    made = numbered(docs).withColumn("clean", clean(F.col(text)))
    if length_col in names:
        length = f"c{names.index(length_col)}"
        kind = made.schema[length].dataType
        made = made.withColumn(length, F.when(new != F.col(text), F.length(new).cast(kind)).otherwise(F.col(length)))
    return made.withColumn(text, new).drop("clean").toDF(*names)
