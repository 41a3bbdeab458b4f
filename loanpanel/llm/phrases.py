"""Collocations: phrases scored by how much their parts attract each other, from sorted count streams.

The counts of all phrases that reach ``least`` are one table, read as two streams: in prefix order
(language, first word, second word, ...) and in suffix order (language, last word, the word before it,
...). Cutting a candidate behind its first k words asks two counts: that of the first part, which is a
prefix of the candidate and is met in prefix order, and that of the rest, a suffix, met in suffix order.
Both come from merge joins, which sort the two sides by that order and walk them in lockstep; no table of
counts is hashed or broadcast, and Spark splits a key that very many candidates ask for. The counts of the
longer candidates that extend a phrase to the right or to the left come by the same joins. No part of a
candidate is missing from the streams, as a part occurs at least as often as the whole.

Counting is an external sort as well. A task counts chunks of its texts by sorting word numbers, in which
a phrase that stands everywhere is one entry of a chunk and not one per occurrence. A chunk's sorted
phrases are cut at splitters that all tasks share, and each cut travels as one compressed block; whoever
gets a range of keys merges its blocks and adds up equal neighbours. Only phrases that reach ``least``
leave that step. The splitters are quantiles of the phrases of a bounded random sample of documents: they
decide how evenly ranges are cut, never what is counted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanpanel.llm.common import utf8, write_stage

CHUNK_BYTES = 8 << 20               # text whose phrases a task counts at once: some 10 bytes of memory for each
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 2000      # what the splitters of ranges are taken from
BREAK = b"\xff"                     # never in UTF-8, so it can stand for the end of a piece
#: A-Z lower-cased, a tab is a blank, what ends a piece is a break
_FOLD = bytes(ord(BREAK) if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def count_chunk(texts: list[bytes], longest: int) -> list[tuple[pa.Array, np.ndarray]]:
    """For 1 to ``longest`` words: the phrases of these texts (words joined by a blank) in prefix order, and
    their counts."""
    words = BREAK.join(texts).translate(_FOLD).replace(BREAK, b" \xff ").split()
    coded = pa.array(words, pa.binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ids, vocabulary = place[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))
    is_word = ids != (pc.index(vocabulary, pa.scalar(BREAK, pa.binary())).as_py() if len(vocabulary) else 0)
    out, names = [], vocabulary
    phrase, ok = ids, is_word                    # number of the phrase that starts at each place
    for size in range(1, longest + 1):
        if size > 1:
            codes = phrase[:len(phrase) - 1] * len(vocabulary) + ids[size - 1:]
            ok = ok[:len(codes)] & is_word[size - 1:]
            found, n = _distinct(codes[ok])
            heads, tails = np.divmod(found, max(len(vocabulary), 1))
            names = pc.binary_join_element_wise(names.take(pa.array(heads)), vocabulary.take(pa.array(tails)), b" ")
            if size < longest:                   # phrases are numbered anew, so the codes stay small
                phrase = np.zeros(len(codes), np.int64)
                phrase[ok] = np.searchsorted(found, codes[ok])
            out.append((names, n))
        else:
            found, n = _distinct(ids[is_word])
            out.append((vocabulary.take(pa.array(found)), n))
    return out


def pack_block(names: pa.Array, n: np.ndarray) -> bytes:
    """Phrases and their counts as compressed bytes: lengths, counts, characters."""
    ends = np.frombuffer(names.buffers()[1], np.int32)[names.offset:names.offset + len(names) + 1]
    letters = memoryview(names.buffers()[2])[ends[0]:ends[-1]] if ends[-1] > ends[0] else b""
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.int64(len(n)).tobytes(), np.diff(ends).tobytes(), n.astype(np.int64).tobytes(), letters]))


def unpack_block(block: bytes) -> tuple[pa.Array, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    k = int(np.frombuffer(data, np.int64, 1)[0])
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.int32, k, 8)))).astype(np.int32)
    n = np.frombuffer(data, np.int64, k, 8 + 4 * k) if k % 2 == 0 else np.frombuffer(data[8 + 4 * k:8 + 12 * k], np.int64)
    return pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(ends), pa.py_buffer(data[8 + 12 * k:])]), n


def merge_blocks(blocks: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The phrases of sorted blocks, each once, with the sums of their counts."""
    parts = [unpack_block(x) for x in blocks]
    names, n = pa.concat_arrays([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    if len(parts) == 1:
        return names, n
    order = pc.sort_indices(names)
    names, n = names.take(order), n[order.to_numpy()]
    first = np.concatenate(([True], pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)))
    at = np.flatnonzero(first)
    return names.take(pa.array(at)), np.add.reduceat(n, at)


def range_splitters(rows: DataFrame, ranges: int, longest: int) -> list[tuple]:
    """Up to ``ranges`` - 1 keys (language, word, word, ...) that cut the phrases of a bounded sample evenly."""
    found = set()
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))        # so the tasks together send some SAMPLE_DOCS rows
    for lang, text in rows.sample(share, 7).select("lang", F.left("text", F.lit(SAMPLE_CHARS))).collect():
        for piece in utf8(text).translate(_FOLD).split(BREAK):
            words = piece.split()
            found |= {(lang, *words[i:i + longest]) for i in range(len(words))}
    keys = sorted(found)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def phrase_counts(docs: DataFrame, lang_col: str, text_col: str, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of the phrases of 1 to ``longest`` words that occur ``least`` times or more in
    a language, as a written table, and (lang, n) of all its word occurrences."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splitters = range_splitters(rows, ranges, longest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        bytes_of: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            bytes_of.pop(lang)
            low, own = bisect_left(splitters, (lang,)), [x[1:] for x in splitters if x[0] == lang]
            out = []
            for size, (names, n) in enumerate(count_chunk(held.pop(lang), longest), 1):
                key = lambda i: tuple(names[i].as_py().split(b" "))                  # noqa: B023, E731
                ends = [bisect_left(range(len(names)), x, key=key) for x in own]
                out += [(low + j, lang, size, pack_block(names[a:b], n[a:b])) for j, (a, b) in enumerate(zip([0, *ends], [*ends, len(names)])) if b > a]
                if size == 1 and len(n):
                    out.append((low, lang, 0, pack_block(pa.array([b""], pa.binary()), np.array([n.sum()]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int32(), pa.binary()))],
                                                 ["part", "lang", "size", "block"])

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                lang, text = lang.as_py(), utf8(text.as_py())
                held.setdefault(lang, []).append(text)
                bytes_of[lang] = bytes_of.get(lang, 0) + len(text) + 1
                if sum(bytes_of.values()) > CHUNK_BYTES:
                    yield from flush(max(bytes_of, key=bytes_of.get))
        for lang in list(held):
            yield from flush(lang)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = ((r["lang"], r["size"], r["block"]) for b in batches for r in b.to_pylist())
        for (lang, size), group in groupby(blocks, key=lambda x: x[:2]):
            names, n = merge_blocks([x[2] for x in group])
            keep = np.flatnonzero((n >= least) | (size == 0))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keep)), names.take(pa.array(keep)).cast(pa.string()), pa.array([size] * len(keep), pa.int32()), pa.array(n[keep])],
                                                 ["lang", "phrase", "size", "n"])

    parts = rows.mapInArrow(cut, "part int, lang string, size int, block binary").repartitionById(ranges, F.col("part"))
    counts = write_stage(parts.sortWithinPartitions("lang", "size").select("lang", "size", "block").mapInArrow(merge, "lang string, phrase string, size int, n long"), "phrase-counts")
    totals = counts.where(F.col("size") == 0).groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.where(F.col("size") > 0), totals


def _backwards(phrase: Column) -> Column:
    return F.array_join(F.reverse(F.split(phrase, " ")), " ")


def count_streams(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts keyed for prefix order and for suffix order (words from last to first)."""
    return counts.withColumn("key", F.col("phrase")), counts.withColumn("key", _backwards(F.col("phrase")))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10,
                 absorb_percent: int = 50, top: int | None = 2000) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score of the best phrases of 2 to ``longest`` words in each
    language (``top`` None: all candidates, ranked).

    a counts the phrase, l and r its two parts at the cut of lowest score, floor(10^6 * a * a / (l * r)),
    computed exactly; n counts the words of the language. A candidate goes if a longer one holds its words
    and has at least ``absorb_percent`` percent of its count. Ties go to the higher a, then to the phrase
    in UTF-8 byte order.

    A null text is empty, a null language ``und``; repeated rows count each; an empty table returns no
    row; other columns are not read. Counts are exact below 10^15.
    """
    if longest < 2:
        raise ValueError("longest must be at least 2")
    counts, totals = phrase_counts(docs, lang_col, text_col, longest, least)
    by_prefix, by_suffix = count_streams(counts)
    whole = lambda s: s.where(F.col("size") >= 2)                                       # noqa: E731
    words = lambda c, i, k: F.array_join(F.slice(F.split(c, " "), i, k), " ")            # noqa: E731

    # every cut of every candidate, in prefix order, meets the count of its first part ...
    cuts = (whole(by_prefix).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .withColumn("first", words("phrase", F.lit(1), F.col("k")))
            .withColumn("rest", _backwards(words("phrase", F.col("k") + 1, F.col("size")))))
    first = by_prefix.select("lang", F.col("key").alias("first"), F.col("n").alias("l"))
    cuts = cuts.join(first.hint("merge"), ["lang", "first"])
    # ... and, in suffix order, that of the rest
    rest = by_suffix.select("lang", F.col("key").alias("rest"), F.col("n").alias("r"))
    cuts = cuts.join(rest.hint("merge"), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(15, 0))"                                      # noqa: E731
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide('n')} * {wide('n')})) div ({wide('l')} * {wide('r')})")
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase")
              .agg(F.min(F.struct("score", "k", "l", "r", F.col("n").alias("a"))).alias("cut"))
              .select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score"))

    # the longer candidates' counts reach the phrases inside them one word at a time: all but the last
    # word stand before them in prefix order, all but the first in suffix order
    most = None
    for size in range(longest, 2, -1):
        longer = whole(by_prefix).where(F.col("size") == size).select("lang", "phrase", "n")
        if most is not None:                     # what was found for it so far, or its own count
            longer = longer.join(most.hint("merge"), ["lang", "phrase"], "left").select("lang", "phrase", F.greatest("n", F.col("more")).alias("n"))
        inside = F.explode(F.array(words("phrase", F.lit(1), F.lit(size - 1)), words("phrase", F.lit(2), F.lit(size - 1))))
        found = longer.select("lang", inside.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("more"))
        most = found if most is None else most.unionByName(found)
    if most is not None:
        scored = (scored.join(most.hint("merge"), ["lang", "phrase"], "left")
                  .where(F.coalesce(100 * F.col("more") < absorb_percent * F.col("a"), F.lit(True))))

    # the best of a language: first among the rows of each of many parts of it, then among those
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        part = F.pmod(F.xxhash64("phrase"), F.lit(64))
        scored = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return (ranked.join(totals.hint("merge"), "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"))
