"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded to a fixed vector (counts of word shapes, and
how much it repeats itself); a gated attention network, learned from document labels only, weighs the
passages, and the weighted representation is scored. Fitting takes a bounded sample of labelled rows;
scoring reads every passage of every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 64                # words of a passage
PIECE = 48                  # characters of a word; longer runs without a blank are cut into pieces, each a word
SHAPES = 64                 # hashed word shapes
EXTRA = 12                  # further features of a passage
WIDTH = SHAPES + EXTRA
CACHE = 150_000             # words whose codes a task keeps
SAMPLE_ROWS = 4_000         # labelled rows to fit on, at most
SAMPLE_PASSAGES = 256       # a fitting row has this many passages at most (longer ones are not fitted on)
_RUN = re.compile(r"(.)\1+", re.S)


_KINDS = str.maketrans({**{chr(i): "d" for i in range(48, 58)}, **{chr(i): "U" for i in range(65, 91)}, **{chr(i): "l" for i in range(97, 123)}})


def _word_code(word: str) -> int:
    """Identity, shape, length, upper-case letters and other signs of a word, in the bits of an integer.
    A shape has U, l, d for letters and digits, signs as they are, runs written once; so it says how a
    word is put together, not which it is."""
    kinds = word.translate(_KINDS)
    if not kinds.isascii():
        kinds = "".join(k if k in "Uld" or not k.isalnum() else "U" if k.isupper() else "l" if k.isalpha() else "d" for k in kinds)
    shape = zlib.crc32(_RUN.sub(r"\1", kinds).encode("utf-8", "surrogatepass")) % SHAPES
    upper, letters = kinds.count("U"), kinds.count("U") + kinds.count("l") + kinds.count("d")
    ident = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
    return ident << 24 | shape << 18 | min(len(word), 63) << 12 | min(upper, 63) << 6 | min(len(kinds) - letters, 63)


def _pieces(words: list[str]) -> list[str]:
    """The words, those of more than PIECE characters cut: every character is in a piece."""
    if max(map(len, words)) <= PIECE:
        return words
    return [w[i:i + PIECE] for w in words for i in range(0, len(w), PIECE)]


class Encoder:
    """Turns a text into the vectors of its passages; an empty text is one passage without words."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def _code(self, word: str) -> int:
        code = self.codes.get(word)
        if code is None:
            code = _word_code(word)
            if len(self.codes) < CACHE:
                self.codes[word] = code
        return code

    def passages(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            out = np.zeros((1, WIDTH), np.float32)
            out[0, SHAPES] = 1.0
            return out
        codes = self.codes
        try:
            c = np.array([codes[w] for w in words], np.int64)
        except KeyError:                    # a run to be cut is never among the codes
            words = _pieces(words)
            c = np.array([codes[w] if w in codes else self._code(w) for w in words], np.int64)
        n = len(c)
        ident, shape, size, upper, signs = c >> 24, c >> 18 & 63, c >> 12 & 63, c >> 6 & 63, c & 63
        count = -(-n // PASSAGE)
        at = np.arange(n) // PASSAGE
        words_in = np.bincount(at, minlength=count).astype(np.float64)
        mean = lambda x: np.bincount(at, x, minlength=count) / words_in
        out = np.zeros((count, WIDTH))
        out[:, :SHAPES] = np.sqrt(np.bincount(at * SHAPES + shape, minlength=count * SHAPES).reshape(count, SHAPES) / words_in[:, None])
        # order by passage and word, and by word alone: neighbours that are equal are repeats
        within = np.sort(at << 32 | ident)
        distinct = words_in - np.bincount(within[1:][within[1:] == within[:-1]] >> 32, minlength=count)
        again = np.concatenate([[0], ident[1:] == ident[:-1]])
        order = np.argsort(ident, kind="stable")
        seen = np.zeros(n)                                  # words that the text had before
        seen[order[1:]] = ident[order[1:]] == ident[order[:-1]]
        letters = np.maximum(size, 1)
        out[:, SHAPES:] = np.stack([
            np.zeros(count), 1 - distinct / words_in, mean(again), mean(seen), mean(np.minimum(size, 40)) / 10,
            mean((size > 24).astype(float)), mean(upper / letters), mean(signs / letters), mean((signs == size).astype(float)),
            np.log1p(words_in) / 4, np.full(count, np.log1p(n) / 8), np.full(count, seen.mean())], axis=1)
        return out.astype(np.float32)


@dataclass
class AttentionModel:
    """Parameters of the network, small arrays: they go to the tasks with the code."""
    shift: np.ndarray
    scale: np.ndarray
    w: np.ndarray           # passage encoding
    b: np.ndarray
    v: np.ndarray           # attention: what is looked for,
    u: np.ndarray           # and its gate
    a: np.ndarray
    c: np.ndarray           # score of the weighted representation
    d: float

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Scores of the bags that begin at ``starts`` in the passages ``x``, and what the gradient needs."""
        h = np.tanh(x @ self.w + self.b)
        p, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (p * g) @ self.a
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        weight = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))
        return score, (h, p, g, weight, z, sizes)

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        """Score of each bag, by groups of bounded size (a bag stays whole)."""
        out, at = [], 0
        while at < len(bags):
            end, size = at, 0
            while end < len(bags) and (end == at or size + len(bags[end]) <= 8192):
                size += len(bags[end])
                end += 1
            x = (np.concatenate(bags[at:end]) - self.shift) / self.scale
            starts = np.cumsum([0, *(len(q) for q in bags[at:end - 1])])
            out.append(self.forward(x, starts)[0])
            at = end
        return np.concatenate(out) if out else np.empty(0)


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 40, batch: int = 64,
          rate: float = 0.004, decay: float = 1e-4, seed: int = 6) -> AttentionModel:
    """Fits the network by Adam on the cross-entropy of the document labels."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shift, scale = every.mean(axis=0), every.std(axis=0) + 0.05
    bags = [(x - shift) / scale for x in bags]
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    m = AttentionModel(shift, scale, init(WIDTH, hidden), np.zeros(hidden), init(hidden, attention), init(hidden, attention),
                       init(attention), init(hidden), float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))))
    names = ("w", "b", "v", "u", "a", "c", "d")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            x = np.concatenate([bags[i] for i in pick])
            starts = np.cumsum([0, *(len(bags[i]) for i in pick[:-1])])
            score, (h, p, g, weight, z, sizes) = m.forward(x, starts)
            out = (score - labels[pick]) / len(pick)
            dz = np.repeat(out, sizes)[:, None] * m.c
            along = (dz * h).sum(axis=1)
            de = weight * (along - np.repeat(np.add.reduceat(weight * along, starts), sizes))
            dp, dg = de[:, None] * m.a * g * (1 - p * p), de[:, None] * m.a * p * g * (1 - g)
            dh = (weight[:, None] * dz + dp @ m.v.T + dg @ m.u.T) * (1 - h * h)
            grads = {"w": x.T @ dh + decay * m.w, "b": dh.sum(axis=0), "v": h.T @ dp, "u": h.T @ dg,
                     "a": (p * g).T @ de, "c": z.T @ out + decay * m.c, "d": out.sum()}
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                move = rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(m, k, getattr(m, k) - move)
    return m


def labelled_sample(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(id, text, label) of at most ``rows`` labelled documents, taken by a hash of the id. Labels that
    are null or neither 0 nor 1, and ids with labels that differ, are left out."""
    ids = (labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).where(train_rows).groupBy(id_col)
           .agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").select(F.col(id_col).alias("id"), "y"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(rows)
    # at most ``rows`` ids: a broadcast of known size
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", sample_rows: int = SAMPLE_ROWS, **options) -> AttentionModel | float:
    """Fits on at most ``sample_rows`` labelled documents for which ``train_rows`` (over the columns of
    ``labels``) holds, each of at most SAMPLE_PASSAGES passages. Without two classes in the sample, the
    share of label 1 (0.5 without any row) is returned, and scored as such."""
    def encode(batches):
        encoder = Encoder()
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                x = encoder.passages(t.as_py())
                if len(x) <= SAMPLE_PASSAGES:
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()], pa.binary()), pa.array([y], pa.int32())], ["x", "y"])

    sample = labelled_sample(docs, labels, train_rows, label, id_col, text_col, sample_rows)
    got = sample.select("text", F.col("y").cast("int")).mapInArrow(encode, "x binary, y int").orderBy(F.xxhash64("x"), "y").limit(sample_rows).collect()
    bags, y = [np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH) for r in got], np.array([r["y"] for r in got], float)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return train(bags, y, **options)


def score_quality(docs: DataFrame, model: AttentionModel | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_passages) of every row; nothing is shuffled. A null or empty text is
    one passage without words; repeated rows are scored each; an empty table returns no rows; other
    columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                bags = [encoder.passages(t.as_py()) for t in part.column(1)]
                s = np.full(len(bags), model) if isinstance(model, float) else model.scores(bags)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array([len(x) for x in bags], pa.int64())],
                    ["doc_id", "score", "predicted", "n_passages"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, n_passages long")


def keep_quality(docs: DataFrame, model: AttentionModel | float, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their columns."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder()
        for texts in batches:
            out = []
            for at in range(0, len(texts), 256):            # the passages of few texts at a time
                bags = [encoder.passages(t) for t in texts.iloc[at:at + 256]]
                out.append(np.full(len(bags), model) if isinstance(model, float) else model.scores(bags))
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)
            pa.default_memory_pool().release_unused()

    return docs.where(score(F.col(text_col)) >= least)
