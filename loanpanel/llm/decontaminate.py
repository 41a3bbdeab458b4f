"""Benchmark decontamination by spaced-seed hashing.

A mask of a fixed span reads some token positions and ignores the others, so its hash survives a
substituted token wherever that token is ignored. Every mask is laid at every position of the benchmark
items and of the training texts; equal hashes are hits. Around each hit the item is laid along the text
and the complete overlap is verified: any stretch of it with enough equal tokens, substitutions allowed, is
accepted. Items too short for substitutions are found by the hash of their whole sequence.

The hashes of one block of items (bounded in tokens) go to the tasks with the code; more items make more
blocks, each a pass over the texts, so what a task holds doesn't grow with the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.llm.common import ALNUM, Powers, mix, utf8, word_hashes, write_stage

# Masks of weight 6; whichever two tokens of fourteen, or three of fifteen, are substituted,
# one of the masks fits somewhere between them.
MASKS = ("111111", "1110111", "11010010101", "11011011")
# further masks for items of SHORT tokens: two substitutions may leave no six tokens that a mask above reads
SHORT_MASKS, SHORT = ("11000111", "111101"), range(10, 13)
MIN_TOKENS = 8              # items of fewer tokens are found only where all of them stand in a row
MIN_MATCH = 12              # equal tokens that an overlap needs (a shorter item: as its share asks)
MIN_SHARE = 0.8             # equal tokens of the overlap's length
BLOCK_TOKENS = 400_000      # tokens of one block of items: at most as many hashes for each mask
MAX_BITS = 24


def _mask_hashes(tokens: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(tokens) - len(mask) + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for offset, read in enumerate(mask):
        if read == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[offset:offset + n]
    return mix(out)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks that an item of ``n`` tokens is hashed by."""
    if n < MIN_TOKENS:
        return ("1" * n,)
    return MASKS + SHORT_MASKS if n in SHORT else MASKS


class BenchmarkBlock:
    """Hashes of a block of items under every mask, and the items' tokens to verify hits with."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, min_share: float) -> None:
        self.min_match, self.min_share = min_match, min_share
        powers, self.ids, self.tokens = Powers(), [], []
        hashes, items_of, at, masks = [], [], [], {}
        with np.errstate(over="ignore"):
            for item_id, text in items:
                t, _, _ = word_hashes(utf8(text).lower(), ALNUM, powers)
                for mask in masks_of(len(t)):
                    h = _mask_hashes(t, mask, masks.setdefault(mask, len(masks) + 1))
                    hashes.append(h)
                    items_of.append(np.full(len(h), len(self.ids)))
                    at.append(np.arange(len(h)))
                self.ids.append(item_id)
                self.tokens.append(t)
        self.masks = masks                              # those that some item of the block is hashed by
        h, i, a = (np.concatenate(x) for x in (hashes, items_of, at))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], i[order], a[order]
        bits = min(MAX_BITS, max(12, int(len(h)).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)           # most positions are told apart by this alone
        self.seen[self.hash >> self.shift] = True

    def search(self, text: str | None, powers: Powers) -> list[tuple[int, int, int, int]]:
        """(item_id, first token, end token, equal tokens) of each verified overlap in a whole text."""
        t, _, _ = word_hashes(utf8(text).lower(), ALNUM, powers)
        lines: set[tuple[int, int]] = set()
        for mask, salt in self.masks.items():
            h = _mask_hashes(t, mask, salt)
            pos = np.flatnonzero(self.seen[h >> self.shift])
            if not len(pos):
                continue
            low, high = np.searchsorted(self.hash, h[pos], "left"), np.searchsorted(self.hash, h[pos], "right")
            for p, a, b in zip(pos.tolist(), low.tolist(), high.tolist()):
                lines.update((int(self.item[j]), p - int(self.at[j])) for j in range(a, b))
        out = []
        for item, shift in sorted(lines):
            if found := self.overlap(t, self.tokens[item], shift):
                out.append((self.ids[item], *found))
        return out

    def overlap(self, text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
        """The best stretch of the item laid at ``shift``: an equal token counts 1, another -2. Where that is
        too short, the stretch of the most equal tokens among those that have their share."""
        a, b = max(0, -shift), min(len(item), len(text) - shift)
        same = text[a + shift:b + shift] == item[a:b]
        if len(item) < MIN_TOKENS:
            return (a + shift, b + shift, len(item)) if len(same) == len(item) and same.all() else None
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
        least = np.minimum.accumulate(total)
        end = int(np.argmax(total - least))
        start = int(np.argmin(total[:end + 1]))
        equal = int(same[start:end].sum())
        needed = min(self.min_match, math.ceil(self.min_share * len(item) - 1e-9))
        if equal >= needed and equal >= self.min_share * (end - start) - 1e-9:
            return a + shift + start, a + shift + end, equal
        # for each end the earliest start with no less of the share: it has the most equal tokens
        count = np.concatenate([[0], np.cumsum(same)])
        if count[-1] < needed:
            return None
        over = count - self.min_share * np.arange(len(count))
        starts = np.searchsorted(-np.minimum.accumulate(over), -over - 1e-9)
        end = int(np.argmax(count - count[starts]))
        start = int(starts[end])
        if (equal := int(count[end] - count[start])) < needed:
            return None
        kept = np.flatnonzero(same[start:end])
        return a + shift + start + int(kept[0]), a + shift + start + int(kept[-1]) + 1, equal


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS,
                     min_match: int = MIN_MATCH, min_share: float = MIN_SHARE) -> Iterator[BenchmarkBlock]:
    """Blocks of items in the order of their ids, each of at most ``block_tokens`` tokens (or one item)."""
    words = F.filter(F.split(F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                             r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = write_stage(benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.size(words).alias("n"))
                        .where("text is not null and id is not null and n > 0"), "benchmark-items").orderBy("id", "text")
    block, size = [], 0
    for r in items.toLocalIterator():
        if block and size + r["n"] > block_tokens:
            yield BenchmarkBlock(block, min_match, min_share)
            block, size = [], 0
        block.append((r["id"], r["text"]))
        size += r["n"]
    if block:
        yield BenchmarkBlock(block, min_match, min_share)


FOUND = "array<struct<item_id:bigint,start:int,end:int,equal:int>>"


def _search(block: BenchmarkBlock):
    """Adds the block's overlaps to those that earlier blocks found in each row."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("equal", pa.int32())]))

    def run(batches):
        powers = Powers()
        names = ("item_id", "start", "end", "equal")
        with np.errstate(over="ignore"):
            for b in batches:
                at = b.schema.names.index("__text__")
                found = [[dict(zip(names, x)) for x in block.search(t.as_py(), powers)] for t in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, "__new__"])
    return run


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with a column ``overlaps`` of (item_id, start, end, equal): every verified overlap of a
    row's whole text with an item, by token positions.

    Null and empty texts have none; repeated rows and items are searched each; items of fewer than eight
    tokens are found where all their tokens stand in a row; items without a token, null ones and those
    without an id are not searched; an empty benchmark finds nothing; an empty table returns no
    rows. All columns are kept; one already called ``overlaps`` is replaced.
    """
    from pyspark.sql.types import _parse_datatype_string as kind

    names = [c for c in docs.columns if c != "overlaps"]
    inner = [f"c{i}" for i in range(len(names))]
    out = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)], F.col(f"`{text_col}`").alias("__text__"),
                      F.array().cast(FOUND).alias("overlaps"))
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, **limits)
    for k, block in enumerate(blocks):
        if k:                                   # one block at a time in a task's memory
            out = write_stage(out, "benchmark-pass")
        schema = type(out.schema)(list(out.schema.fields)).add("__new__", kind(FOUND))
        out = out.mapInArrow(_search(block), schema).withColumn("overlaps", F.concat("overlaps", "__new__")).drop("__new__")
    return out.select(*[F.col(i).alias(c) for c, i in zip(names, inner)], "overlaps")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with their columns."""
    return benchmark_overlaps(docs, benchmark, text_col, **limits).where(F.size("overlaps") == 0).select(*docs.columns)
