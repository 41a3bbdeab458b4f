"""Periodic runs: the query and the operator against plain scans by period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from loanpanel.llm.runs import find_runs, periodic_runs, repeat_tail, run_digests


def plain_runs(w, copies=4, least=6):
    """Every maximal stretch in which words q apart are equal, smallest q first."""
    period_of = {}
    for q in range(1, len(w) // copies + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, copies * q):
                period_of.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in period_of.items())


def plain_row(words):
    runs, keep = plain_runs(words), [True] * len(words)
    for s, n, q in runs:
        keep[s + q:s + n] = [False] * (n - q)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()                      # noqa: E731
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for x, k in zip(words, keep) if k)))


FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_against_plain_scan(spark, duck):
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in E.queries()["op11_periodic_runs"](spark, SF_SMALL).collect()}
    with_runs = 0
    for doc_id, text in duck.execute("select doc_id, text from documents").fetchall():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert got.pop(doc_id) == plain_row(words)
        with_runs += bool(plain_runs(words))
    assert not got and with_runs > 5


@pytest.mark.parametrize("copies,least", [(3, 2), (3, 6), (4, 6), (5, 9)])
def test_runs_of_random_words(copies, least):
    rng = random.Random(copies)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            k = rng.choice([1, 2, 3, 5])
            w = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
            if rng.random() < .6 and w:                     # a repeated tail, perhaps repeated again
                a = rng.randrange(len(w))
                w = w[:a] + (w[a:a + 1 + (len(w) - a) // rng.randint(3, 9)] * 60)[:len(w) - a]
                if rng.random() < .4:
                    w = w + [rng.randrange(k) for _ in range(4)] + w
            docs.append(w)
        flat, doc, begin = [], [], []
        for k, w in enumerate(docs):
            begin.append(len(flat))
            flat += [*w, -1 - k]
            doc += [k] * (len(w) + 1)
        wanted = sorted((begin[k] + s, n, q) for k, w in enumerate(docs) for s, n, q in plain_runs(w, copies, least))
        assert find_runs(np.asarray(flat, np.int64), np.asarray(doc), copies, least) == wanted


def test_one_word_and_long_periods():
    one = np.asarray([7] * 30_000 + [-1], np.int64)
    assert find_runs(one, np.zeros(len(one), int), 4, 6) == [(0, 30_000, 1)]
    block = np.random.default_rng(0).integers(0, 900, 4_000)
    tiled = np.concatenate([[5], np.tile(block, 4), [-1]])
    found = find_runs(tiled, np.zeros(len(tiled), int), 4, 6)
    assert [r for r in found if r[2] > 9] in ([(1, 16_000, 4_000)], [(0, 16_001, 4_000)])


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b " * 4, "y"), (4, "a b " * 4, None), (4, "a b " * 4, None), (5, "z z " * 9, "é"),
            (6, "w" * 200_000, ""), (7, " ".join(["k"] * 5), "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = periodic_runs(docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    ab = [(0, 8, 2)]
    assert got == [(1, 0, [], ""), (2, 0, [], ""), (4, 8, ab, "a b"), (4, 8, ab, "a b"), (5, 9, [(0, 9, 1)], "z z"),
                   (6, 1, [], "w" * 200_000), (7, 5, [], "k k k k k"), (None, 8, ab, "a b")]
    assert run_digests(periodic_runs(docs.where("false"))).collect() == []
    assert repeat_tail(None, ["a"]) == ["a"] and repeat_tail(3, []) == []
    with pytest.raises(ValueError):
        periodic_runs(docs, copies=2)


def test_chunks_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    whole = sorted(map(str, periodic_runs(docs, rewrite=repeat_tail).collect()))
    from loanpanel.llm import runs
    monkeypatch.setattr(runs, "CHUNK_WORDS", 50)
    assert sorted(map(str, runs.periodic_runs(docs, rewrite=repeat_tail).collect())) == whole
