"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, in pairs.

Both dictionaries of a pair begin with the same background (a dictionary trained on ordinary text) and end
with as many bytes of their own: the words that mark toxic, and ordinary, training documents. A window of
text is compressed under both; what is toxic costs less under the toxic dictionary. A frame of a few bytes
shows nothing (its fixed parts weigh more than the text, and the coder leaves the last bytes as they are),
so a word is compressed between two carriers that both dictionaries hold, and a window's length is the sum
of its words' lengths. Words repeat, so their lengths are kept in a bounded cache. Lengths are clamped
(TOP_T, TOP_O), so a word of more than LONG bytes, such as a run of unspaced script, is cut into
overlapping pieces that stay below the clamp, each of them a word.

The training rows are dealt to two halves, copies of a text to the same one. Each half makes a pair of
dictionaries, and the other half calibrates it: every pair of lengths has the log of how much oftener it
stands in toxic documents, a document is described by its windows' sums of these, and a logistic function
of that description, fitted on the same calibrating rows, is the pair's verdict. So a pair is scored with
the very dictionaries that were calibrated, on rows that made neither. The score is the logistic of the two
pairs' mean log-odds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanpanel.llm.common import utf8
from loanpanel.llm.mil import labelled_sample

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
WINDOW = 32                 # words of a window
LONG, PIECE, STEP = 16, 12, 6           # bytes of a word that is not cut, of a piece, and from piece to piece
BACKGROUND, OWN = 32_768, 16_384        # bytes of the shared and of each own part
SAMPLE_ROWS = 6_000         # labelled rows to fit on, at most
CACHE = 500_000             # words whose lengths a task keeps
TOP_T, TOP_O = 16, 24       # lengths beyond the carriers', as they are told apart
CODES = TOP_T * TOP_O       # codes of a word under one pair of dictionaries
_noise = np.random.default_rng(5)
HEAD, TAIL = (bytes(_noise.integers(128, 256, n).astype(np.uint8)) for n in (48, 24))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, lower-cased; those of more than LONG bytes as overlapping pieces that cover them."""
    return _pieces(WORD.findall(utf8(text).lower()))


def _pieces(words: list[bytes]) -> list[bytes]:
    if not words or max(map(len, words)) <= LONG:
        return words
    out = []
    for w in words:
        if len(w) <= LONG:
            out.append(w)
        else:
            out += [w[i:i + PIECE] for i in range(0, len(w) - PIECE, STEP)]
            out.append(w[-PIECE:])
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=16, search_log=4, min_match=3, target_length=16, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    d = zstandard.ZstdCompressionDict(content + HEAD + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def _own_part(words: list[bytes], size: int) -> bytes:
    """The most telling words nearest to the end, where a match costs least."""
    out, used = [], 0
    for w in words:
        if used + len(w) + 1 > size:
            break
        out.append(w)
        used += len(w) + 1
    return (b" " + b" ".join(reversed(out)) + b" ").rjust(size + 2, b"\0")


class Lengths:
    """Compressed lengths of words under both dictionaries of a pair, less the carriers', as one small code."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.t, self.o = _compressor(toxic), _compressor(ordinary)
        self.t0, self.o0 = (len(c.compress(HEAD + b" " + TAIL)) for c in (self.t, self.o))

    def code(self, word: bytes) -> int:
        framed = HEAD + b" " + word + b" " + TAIL
        t = min(max(len(self.t.compress(framed)) - self.t0, 0), TOP_T - 1)
        o = min(max(len(self.o.compress(framed)) - self.o0, 0), TOP_O - 1)
        return t * TOP_O + o


class Coder:
    """A word's codes under every pair of dictionaries as one number, in a bounded cache."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]) -> None:
        self.lengths = [Lengths(*p) for p in pairs]
        self.cache: dict[bytes, int] = {}

    def code(self, word: bytes) -> int:
        c = 0
        for pair in self.lengths:
            c = c * CODES + pair.code(word)
        if len(self.cache) < CACHE:
            self.cache[word] = c
        return c

    def codes(self, text: str | None) -> np.ndarray:
        words, cache = WORD.findall(utf8(text).lower()), self.cache
        try:
            return np.array([cache[w] for w in words], np.int64)
        except KeyError:                    # a word to be cut is never in the cache
            return np.array([cache[w] if w in cache else self.code(w) for w in _pieces(words)], np.int64)


def describe(evidence: np.ndarray) -> list[float]:
    """A document's features from its words' evidence, in windows that overlap by half."""
    n = len(evidence)
    if not n:
        return [0.0] * FEATURES
    total = np.concatenate([[0.0], np.cumsum(evidence)])
    starts = np.arange(0, max(1, n - WINDOW // 2), WINDOW // 2)
    windows = total[np.minimum(starts + WINDOW, n)] - total[starts]
    high = float((evidence > 1.5).sum())
    return [float(evidence.mean()) * 8, float(windows.max()) / 8, float(windows.mean()) / 4, float((windows > 3).mean()),
            high / n * 20, np.log1p(high), np.log1p(n) / 4]


FEATURES = 7


@dataclass
class Pair:
    """Two dictionaries, the evidence of their codes, and the calibration."""
    toxic: bytes
    ordinary: bytes
    evidence: np.ndarray
    weights: np.ndarray


@dataclass
class ToxicityModel:
    """Calibrated pairs of dictionaries; small, goes to the tasks with the code. Without a pair every score is ``prior``."""
    pairs: list[Pair]
    prior: float = 0.5
    coder: Coder | None = field(default=None, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "coder": None}          # compressors are made anew in every task

    def codes(self, text: str | None) -> np.ndarray:
        if self.coder is None:
            self.coder = Coder([(p.toxic, p.ordinary) for p in self.pairs])
        return self.coder.codes(text)

    def score(self, text: str | None) -> float:
        if not self.pairs:
            return self.prior
        codes, odds = self.codes(text), 0.0
        for p in reversed(self.pairs):
            codes, own = np.divmod(codes, CODES)
            odds += float(np.append(describe(p.evidence[own]), 1.0) @ p.weights)
        return float(1 / (1 + np.exp(-np.clip(odds / len(self.pairs), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _halves(texts: list[str], labels: list[int]) -> np.ndarray:
    """Which rows are of the first half: each label's distinct texts in turn, copies with their text."""
    seen: tuple[dict[str, bool], ...] = ({}, {})
    return np.array([seen[y].setdefault(t, len(seen[y]) % 2 == 0) for t, y in zip(texts, labels)], bool)


def _dictionaries(texts: list[str], labels: list[int]) -> tuple[bytes, bytes]:
    seen, n, pieces = (Counter(), Counter()), [0, 0], []
    for text, y in zip(texts, labels):
        words = words_of(text)
        seen[y].update(set(words))
        n[y] += 1
        if not y:
            pieces += [b" ".join(words[i:i + 8]) for i in range(0, len(words), 8)]
    lift = {w: np.log((seen[1][w] + 0.5) / (n[1] + 1)) - np.log((seen[0][w] + 0.5) / (n[0] + 1)) for w in seen[1]}
    least = max(2, n[1] // 100)
    marked = sorted((w for w, v in lift.items() if v > 2 and seen[1][w] >= least), key=lambda w: (-lift[w] * seen[1][w], w))
    plain = sorted((w for w in seen[0] if lift.get(w, -9) < 0), key=lambda w: (-seen[0][w], w))
    try:
        shared = zstandard.train_dictionary(BACKGROUND, pieces).as_bytes()
    except zstandard.ZstdError:             # too little text to train on
        shared = b" ".join(pieces)[:BACKGROUND]
    return shared + _own_part(marked, OWN), shared + _own_part(plain, OWN)


def _evidence(codes: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """Log of how much oftener each code stands in toxic documents."""
    seen = np.zeros((2, CODES))
    for c, y in zip(codes, labels):
        seen[y] += np.bincount(c, minlength=CODES)
    # rare pairs lean on what their difference alone says
    diff = np.arange(CODES) % TOP_O - np.arange(CODES) // TOP_O + TOP_T
    by_diff = np.stack([np.bincount(diff, s, minlength=TOP_T + TOP_O) for s in seen]) + 0.5
    by_diff = np.log(by_diff[1] / by_diff[1].sum()) - np.log(by_diff[0] / by_diff[0].sum())
    share = np.maximum(seen.sum(axis=1, keepdims=True), 1.0)
    prior = 20 / (1 + np.exp(-by_diff[diff] - np.log(share[1] / share[0])))
    odds = np.log(seen[1] + prior) - np.log(seen[0] + 20 - prior + 1e-9) - np.log(share[1] / share[0])
    return np.clip(odds, -1.0, 5.0)


def train(texts: list[str], labels: list[int]) -> ToxicityModel:
    """Two pairs of dictionaries, each made of one half of the rows and calibrated on the other."""
    first, pairs = _halves(texts, labels), []
    for made in (first, ~first):
        own, other = ([(texts[k], labels[k]) for k in np.flatnonzero(m)] for m in (made, ~made))
        toxic, ordinary = _dictionaries([t for t, _ in own], [y for _, y in own])
        coder, y = Coder([(toxic, ordinary)]), [y for _, y in other]
        codes = [coder.codes(t) for t, _ in other]
        evidence = _evidence(codes, y)
        weights = _logistic(np.array([describe(evidence[c]) for c in codes]), np.array(y, float))
        pairs.append(Pair(toxic, ordinary, evidence, weights))
    return ToxicityModel(pairs)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "toxic", id_col: str = "doc_id",
                 text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fits on the whole texts of at most ``sample_rows`` labelled documents for which ``train_rows`` (over the
    columns of ``labels``) holds. With fewer than two different texts of either label the share of label 1
    (0.5 without any row) is every text's score."""
    sample = labelled_sample(docs, labels, train_rows, label, id_col, text_col, sample_rows)
    got = (sample.select(F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("int").alias("y"))
           .orderBy(F.xxhash64("text"), "text", "y").limit(sample_rows).collect())
    y = [r["y"] for r in got]
    if min(len({r["text"] for r in got if r["y"] == k}) for k in (0, 1)) < 2:
        return ToxicityModel([], sum(y) / len(y) if y else 0.5)
    return train([r["text"] for r in got], y)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_words) of every row; nothing is shuffled. A null or empty text has
    no window and gets the score of no evidence; repeated rows are scored each; an empty table returns
    no rows; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, n = [], []
            for t in b.column(1):
                text = t.as_py()
                s.append(model.score(text))
                n.append(len(utf8(text).split()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32()), pa.array(n, pa.int64())],
                ["doc_id", "score", "predicted", "n_words"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, n_words long")
