"""Substring dedup: words covered by a long enough word sequence that stands elsewhere too.

The reference is the corpus itself, which has no bound, so its suffix automata are not broadcast whole:
the corpus is cut into reference shards such that equal windows always meet in one shard, each shard's
automaton is built where the shard is, and the shard's own passages are streamed through it.

The routing: a window's anchor is the least hash of its short word n-grams, so equal windows have equal
anchors. Neighbouring windows mostly share an anchor; such a run of windows is one passage. Anchors that
stand at one place only cannot belong to a repeated window; they are counted out first, over all
documents. What is left is grouped to distinct passages with their number of copies (so thousands of
copies of a page are one passage), and goes to the shard of its anchor. An anchor whose distinct
passages would overfill a shard (a phrase that stands in a third of all documents) is dealt out further,
by anchors of longer n-grams, in the end by each window's own content: no shard grows with the number of copies or of contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.llm.automaton import SuffixAutomaton
from loanpanel.llm.common import NON_SPACE, Powers, sliding_min, span_hashes, utf8, word_hashes, write_stage

GRAM = 8                # words of an anchor's n-gram
SHARD_WORDS = 200_000   # words of one automaton; an anchor whose distinct passages hold more is dealt out further

ANCHOR = "array<struct<v:bigint,s:int,e:int,n:int>>"


def _anchor_runs(hashes: np.ndarray, width: int, gram: int, powers: Powers):
    """(anchor, first window, last window, places of the anchor in the text) of every run of windows."""
    n = len(hashes)
    at = np.arange(n - gram + 1)
    grams = span_hashes(hashes, at, at + gram, powers)
    span = width - gram + 1
    least = sliding_min(grams, span)
    # a place is an anchor's if it holds the least hash of a window around it
    around = ~sliding_min(~np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]), span)
    values, places = np.unique(grams[grams == around], return_counts=True)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    anchors = least[first]
    return anchors.view(np.int64), first, last, places[np.searchsorted(values, anchors)]


def _scan(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        with np.errstate(over="ignore"):
            for b in batches:
                n_words, digests, rows, ends = [], [], [], [0]
                for t in b.column(2):
                    data = utf8(t.as_py())
                    words = data.split()
                    n_words.append(len(words))
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    if len(words) >= width:
                        h, _, _ = word_hashes(data, NON_SPACE, powers)
                        rows.append(_anchor_runs(h, width, gram, powers))
                        ends.append(ends[-1] + len(rows[-1][0]))
                    else:
                        ends.append(ends[-1])
                cols = [np.concatenate(x) for x in zip(*rows)] if rows else [np.empty(0, np.int64)] * 4
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
                runs = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["v", "s", "e", "n"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(digests, pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)], ["doc_id", "key", "n_words", "sha", "runs"])
    return run


SEGMENT = "key binary, copies long, s int, v long, digest binary, n int, words binary"
FOUND = "v long, digest binary, spans array<struct<a:int,b:int>>"


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _segments(width: int):
    """The passage under each of a text's runs: its words, joined by one blank."""
    def run(batches):
        for b in batches:
            for key, copies, text, runs in zip(*(c.to_pylist() for c in b.columns)):
                words = utf8(text).split()
                parts = [b" ".join(words[r["s"]:r["e"] + width]) for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(runs), pa.binary()), pa.array([copies] * len(runs), pa.int64()),
                     pa.array([r["s"] for r in runs], pa.int32()), pa.array([r["v"] for r in runs], pa.int64()),
                     pa.array([_digest(p) for p in parts], pa.binary()), pa.array([r["e"] - r["s"] + width for r in runs], pa.int32()), pa.array(parts, pa.binary())],
                    ["key", "copies", "s", "v", "digest", "n", "words"])
    return run


FINER = "v long, digest binary, at int, copies long, v2 long, digest2 binary, n int, places long, words binary"


def _finer_passages(width: int, gram: int):
    """Each passage cut to the runs of its anchors under a longer n-gram; at ``width`` words, an anchor is
    the window itself."""
    def run(batches):
        powers = Powers()
        with np.errstate(over="ignore"):
            for b in batches:
                for v, digest, copies, words in zip(*(c.to_pylist() for c in b.columns)):
                    w = words.split(b" ")
                    v2, first, last, places = _anchor_runs(word_hashes(words, NON_SPACE, powers)[0], width, gram, powers)
                    parts = [b" ".join(w[i:j + width]) for i, j in zip(first.tolist(), last.tolist())]
                    k = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v] * k, pa.int64()), pa.array([digest] * k, pa.binary()), pa.array(first, pa.int32()), pa.array([copies] * k, pa.int64()),
                         pa.array(v2, pa.int64()), pa.array([_digest(p) for p in parts], pa.binary()), pa.array(last - first + width, pa.int32()),
                         pa.array(places, pa.int64()), pa.array(parts, pa.binary())],
                        ["v", "digest", "at", "copies", "v2", "digest2", "n", "places", "words"])
    return run


def _repeats(width: int, shard_words: int):
    """Streams the passages of one task, anchor by anchor, through automata of at most ``shard_words``
    words, and returns the windows of each that stand at two places or more."""
    def settle(shard):
        ids: dict[bytes, int] = {}
        coded = [[ids.setdefault(w, len(ids)) for w in words.split(b" ")] for _, _, _, words in shard]
        automaton = SuffixAutomaton()
        for (_, _, copies, _), words in zip(shard, coded):
            automaton.add(words, copies)
        automaton.finish()
        found = [(v, digest, spans) for (v, digest, _, _), words in zip(shard, coded)
                 if (spans := automaton.matches(words, width, least=2))]
        v, digest, spans = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(v, pa.int64()), pa.array(digest, pa.binary()),
             pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
            ["v", "digest", "spans"])

    def run(batches):
        shard, size, group, held = [], 0, [], 0         # the automaton's passages, and those of one anchor
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and row[0] != group[0][0]:
                    if shard and size + held > shard_words:
                        yield settle(shard)
                        shard, size = [], 0
                    shard += group
                    size, group, held = size + held, [], 0
                group.append(row)
                held += row[3].count(b" ") + 1
        if shard and size + held > shard_words:
            yield settle(shard)
            shard = []
        if shard or group:
            yield settle(shard + group)
    return run


def _settled(distinct: DataFrame, width: int, finer: list[int], shard_words: int) -> DataFrame:
    """(v, digest, spans): the repeated windows of distinct passages (v, digest, copies, words, n). Anchors
    that would overfill a shard go on to the next of the ``finer`` n-grams; there, passages whose anchor
    stands at one place only are done with."""
    def in_shards(rows: DataFrame) -> DataFrame:
        rows = rows.select("v", "digest", "copies", "words").repartition("v").sortWithinPartitions("v")
        return rows.mapInArrow(_repeats(width, shard_words), FOUND)

    if not finer:               # an anchor is one window by now, or one word over and over
        return in_shards(distinct)
    crowded = write_stage(distinct.groupBy("v").agg(F.sum("n").alias("n")).where(F.col("n") > shard_words).select("v"), "repeat-crowded")
    cut = write_stage(distinct.join(crowded, "v", "left_semi").select("v", "digest", "copies", "words")
                      .mapInArrow(_finer_passages(width, finer[0]), FINER), "repeat-finer")
    below = write_stage(cut.groupBy(F.col("v2").alias("v"), F.col("digest2").alias("digest")).agg(
        F.sum("copies").alias("copies"), F.first("words").alias("words"), F.first("n").alias("n"), F.first("places").alias("places")), "repeat-distinct")
    again = write_stage(below.groupBy("v").agg(F.sum(F.col("copies") * F.col("places")).alias("places")).where("places > 1").select("v"), "repeat-anchors")
    below = write_stage(below.join(again, "v", "left_semi"), "repeat-distinct")
    found = write_stage(_settled(below, width, finer[1:], shard_words), "repeat-found")
    found = found.select(F.col("v").alias("v2"), F.col("digest").alias("digest2"), "spans")
    up = (cut.select("v", "digest", "at", "v2", "digest2").join(found, ["v2", "digest2"])
          .select("v", "digest", "at", F.explode("spans").alias("x"))
          .groupBy("v", "digest").agg(F.collect_set(F.struct((F.col("x.a") + F.col("at")).alias("a"), (F.col("x.b") + F.col("at")).alias("b"))).alias("spans")))
    return in_shards(distinct.join(crowded, "v", "left_anti")).union(up)


def _kept(width: int):
    """What is left of a text: (key, n_removed, digest of the kept words, their text)."""
    def run(batches):
        for b in batches:
            out = []
            for key, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                words = utf8(text).split()
                keep = np.ones(len(words), bool)
                for x in spans:
                    keep[x["a"]:x["b"] + width] = False
                left = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
                out.append((key, int(len(words) - keep.sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            cols = list(zip(*out)) or [[]] * 4
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "n_removed", "kept_sha", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, gram: int = GRAM,
                   shard_words: int = SHARD_WORDS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every row: what is left of its text when
    each word under a repeated window of ``width`` words is removed.

    A window is repeated if its words also start anywhere else, in the same text too; all windows are
    judged on the input. A null text has no words. Texts shorter than ``width`` words lose nothing.
    Repeated rows are texts of their own, so they repeat each other; a null id changes nothing. An
    empty table returns no rows. Other columns are not read. ``kept_text`` is null where nothing was
    removed.
    """
    if width <= gram:
        raise ValueError("a window must be longer than an anchor's n-gram")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"),
                       F.col(text_col).alias("text"))
    base = write_stage(rows.mapInArrow(_scan(width, gram), f"doc_id {kind}, key binary, n_words long, sha string, runs {ANCHOR}"), "repeat-runs")

    runs = base.select("key", F.explode("runs").alias("r")).select("key", "r.v", "r.s", "r.e", "r.n")
    repeated = write_stage(runs.groupBy("v").agg(F.sum("n").alias("places")).where("places > 1").select("v"), "repeat-anchors")
    in_text = (runs.drop("n").join(repeated, "v").groupBy("key").agg(F.collect_set(F.struct("s", "e", "v")).alias("runs")))
    texts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    texts = write_stage(texts.join(in_text, "key"), "repeat-texts")          # each text once, if any of it may repeat

    parts = write_stage(texts.select("key", "copies", "text", "runs").mapInArrow(_segments(width), SEGMENT), "repeat-passages")
    distinct = write_stage(parts.groupBy("v", "digest").agg(F.sum("copies").alias("copies"), F.first("words").alias("words"), F.first("n").alias("n")), "repeat-distinct")
    found = write_stage(_settled(distinct, width, [(gram + width) // 2, width], shard_words), "repeat-found")
    spans = (parts.select("key", "s", "v", "digest").join(found, ["v", "digest"])
             .select("key", F.explode("spans").alias("x"), "s")
             .select("key", F.struct((F.col("x.a") + F.col("s")).alias("a"), (F.col("x.b") + F.col("s")).alias("b")).alias("x"))
             .groupBy("key").agg(F.collect_set("x").alias("spans")))
    kept = texts.select("key", "text").join(spans, "key").select("key", "text", "spans").mapInArrow(
        _kept(width), "key binary, n_removed long, kept_sha string, kept_text string")
    if not with_text:
        kept = kept.drop("kept_text")
    out = base.select("doc_id", "key", "n_words", "sha").join(write_stage(kept, "repeat-kept"), "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"), *(["kept_text"] if with_text else []))
    return out
