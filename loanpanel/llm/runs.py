"""Periodic runs of words, found as maximal pairs of an LCP-interval tree.

A run is a stretch of words with smallest period q that is at least ``copies`` periods long and that no
neighbouring word extends. Its start s and s + q are a maximal pair: the two suffixes share exactly
l = length - q words, and the words before them differ. The other way round, a maximal pair at a distance
of q <= l / (copies - 1) is such a stretch, of length l + q, and nothing needs to be extended: right
maximality is the depth of the interval in which the two meet, left maximality their classes of left word.

The tree is walked bottom-up over the sorted suffixes. An interval keeps its positions in text order, each
with its class of left word; when two children meet, every position of the smaller one looks up its nearest
neighbours in the larger one. Nearest ones suffice: occurrences of l words at distances of at most
l / 2 form one progression, whose step is the smallest period. A pair at a multiple of the period gives a
stretch with the same start and end, of which the smallest period is kept.

Only words that can lie in a run enter the tree. Every g words in a row inside a run occur twice in it
(g as in ``gram_size``), so a run lies in one unbroken stretch of places whose g words recur in their
document, and one of them recurs at a distance that the stretch's own length admits. What fails that is
left out, which loses nothing; hash collisions there only let more words in.

Documents are independent: nothing is shuffled, and a task holds one chunk of texts at a time.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.llm.common import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CHUNK_WORDS = 400_000               # words whose suffixes are looked at together; a longer text is one chunk
_U = np.uint64


def least_shared(copies: int, min_words: int) -> int:
    """The least l that a run's two suffixes share, over all periods."""
    return min(max(min_words - q, (copies - 1) * q) for q in range(1, min_words + 1))


def gram_size(copies: int, min_words: int) -> int:
    """The most words in a row that have a copy one period before or behind them, wherever they stand in
    whatever run: a run of L words needs L - g >= 2 * q - 1 for that."""
    return min(least_shared(copies, min_words),
               min(max(min_words, copies * q) - 2 * q + 1 for q in range(1, min_words + 1)))


def _candidate_stretches(w: np.ndarray, doc: np.ndarray, gram: int, copies: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in words) of the stretches that may hold a run; every run lies in exactly one."""
    n = len(w) - gram + 1
    none = np.empty(0, np.int64)
    if n < 2:
        return none, none
    with np.errstate(over="ignore"):
        h = doc[:n].astype(_U)
        for k in range(gram):
            h = h * _U(0x9E3779B97F4A7C15) + w[k:k + n].astype(_U)
        h = mix(h)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    here, there = order[:-1][same], order[1:][same]
    if not len(here):
        return none, none
    recurs, gap = np.zeros(n, np.int8), np.full(n, len(w), np.int64)
    recurs[here] = recurs[there] = 1
    gap[here] = there - here
    edge = np.diff(recurs, prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    most = ends - starts + gram - 1                     # words of the longest run inside
    keep = (np.minimum.reduceat(gap, starts) * (copies - 1) <= most) & (most >= min_words)
    return starts[keep], ends[keep] + gram - 1


def _sorted_suffixes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``s`` by doubling, and the number of values that each shares with the one before it.
    ``s`` ends in a value that occurs once."""
    n = len(s)
    ranks = [np.unique(s, return_inverse=True)[1].astype(np.int64)]
    order, k = np.argsort(ranks[0], kind="stable"), 1
    while ranks[-1].max() < n - 1:
        key = ranks[-1] * (n + 1)
        key[:-k] += ranks[-1][k:] + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
        ranks.append(rank)
        k *= 2
    shared = np.zeros(n, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        a, b = order[:-1] + shared[1:], order[1:] + shared[1:]
        inside = (a < n) & (b < n)
        equal = inside & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        shared[1:] += equal.astype(np.int64) << level
    return order, shared


class _Pairs:
    """Maximal pairs at admissible distances, gathered while intervals are joined bottom-up."""

    def __init__(self, left: list[int], copies: int, min_words: int) -> None:
        self.left, self.copies, self.min_words = left, copies, min_words
        self.found: list[tuple[int, int, int]] = []          # start, length, period

    def join(self, a: list[int], b: list[int], shared: int) -> list[int]:
        """One list of the positions of two children that meet in an interval of ``shared`` words."""
        small, big = (a, b) if len(a) < len(b) else (b, a)
        left, reach = self.left, shared // (self.copies - 1)
        for x in small:
            i = bisect_left(big, x)
            for y in big[max(i - 1, 0):i + 1]:
                d = abs(y - x)
                if d <= reach and shared + d >= self.min_words and left[x] != left[y]:
                    self.found.append((min(x, y), shared + d, d))
        if 8 * len(small) > len(big):
            big += small
            big.sort()                                       # two sorted runs: linear
        else:
            for x in small:
                insort(big, x)
        return big

    def walk(self, places: list[int], shared: list[int]) -> None:
        """Bottom-up over one group of neighbouring suffixes; shared[i] belongs to places[i] and the next."""
        depths: list[int] = []
        members: list[list[int]] = []
        last = [places[0]]
        for depth, place in zip([*shared, -1], [*places[1:], -1]):
            while depths and depths[-1] > depth:
                last = self.join(members.pop(), last, depths.pop())
            if depths and depths[-1] == depth:
                members[-1] = self.join(members[-1], last, depth)
            else:
                depths.append(depth)
                members.append(last)
            last = [place]


def find_runs(w: np.ndarray, doc: np.ndarray, copies: int, min_words: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in ``w``, in order; values below 0 stand for breaks and occur once."""
    starts, ends = _candidate_stretches(w, doc, gram_size(copies, min_words), copies, min_words)
    if not len(starts):
        return []
    # the stretches one behind the other, a break after each
    size = ends - starts + 1
    at = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(starts, size)
    s = w[np.minimum(place, len(w) - 1)]
    s[at[1:] - 1] = -(1 << 40) - np.arange(len(size))
    order, shared = _sorted_suffixes(s)
    pairs = _Pairs(np.concatenate((s[-1:], s[:-1])).tolist(), copies, min_words)
    deep = (shared >= least_shared(copies, min_words)).astype(np.int8)
    edge = np.diff(deep, append=0)
    for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        pairs.walk(order[i:j + 1].tolist(), shared[i + 1:j + 1].tolist())
    best: dict[tuple[int, int], int] = {}
    for start, length, period in pairs.found:
        key = (int(place[start]), length)
        best[key] = min(period, best.get(key, period))
    return sorted((start, length, period) for (start, length), period in best.items())


def _kept(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words outside the repeats: of a run, the first period stays."""
    if not runs:
        return " ".join(words)
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period:start + length] = bytes(length - period)
    return " ".join([x for x, k in zip(words, keep) if k])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int = 4, min_words: int = 6,
                  rewrite: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (array of start, length, period in words, by start,
    then period) and collapsed, the text's words joined by a blank without those that lie in a run behind
    its first period. ``copies`` is at least 3. ``rewrite`` may replace a text's words first.

    A null text has no words, no runs and an empty collapsed text; repeated rows each return a row; an
    empty table returns none; other columns are not read. Two runs never share start and end.
    """
    if copies < 3 or min_words < 2:
        raise ValueError("copies must be at least 3, min_words at least 2")
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[str]], pa.DataType]]:
        for b in batches:
            ids, split, n = [], [], 0
            for i, t in zip(b.column(0), b.column(1)):
                words = WORD.findall(t.as_py() or "")
                if rewrite is not None:
                    words = rewrite(i.as_py(), words)
                if split and n + len(words) > CHUNK_WORDS:
                    yield ids, split, b.column(0).type
                    ids, split, n = [], [], 0
                ids.append(i.as_py())
                split.append(words)
                n += len(words)
            if split:
                yield ids, split, b.column(0).type

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, split, id_type in chunks(batches):
            known: dict[str, int] = {}
            number = known.setdefault
            flat: list[int] = []
            for k, words in enumerate(split):
                flat += [number(x, len(known)) for x in words]
                flat.append(-1 - k)
            begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in split])))
            doc = np.repeat(np.arange(len(split)), np.diff(begin))
            runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
            for start, length, period in find_runs(np.asarray(flat, np.int64), doc, copies, min_words):
                k = int(doc[start])
                runs[k].append((start - int(begin[k]), length, period))
            rows = [{"start": a, "length": b, "period": c} for x in runs for a, b, c in x]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in runs]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array([len(x) for x in split], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows, run)),
                 pa.array([_kept(x, r) for x, r in zip(split, runs)], pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


def repeat_tail(doc_id: object, words: list[str]) -> list[str]:
    """The run query's rewriting: by the crc32 of the decimal id, every tenth document's words repeat from
    some word on. A null id changes nothing."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), the digests of all runs and of
    the collapsed text, and n_words, from the rows of ``periodic_runs``."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.p")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"), "n_words")
