"""op5: the score against plain loops over words and windows, the halves, and the defined edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanpanel.llm import compression as c


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    parts = ["an", "ber", "col", "du", "es", "fri", "gan", "ho", "il", "jor", "ka", "le"]
    word = lambda: "".join(rng.choice(parts, int(rng.integers(1, 4))))
    bad = ["wretchix", "grumbolt", "skulvane"]
    out = []
    for k in range(240):
        words = [word() for _ in range(int(rng.integers(20, 90)))]
        for at in range(0, len(words) if k % 4 == 0 else 0, 12):
            words[at] = str(rng.choice(bad))
        out.append((" ".join(words), int(k % 4 == 0)))
    return out


@pytest.fixture(scope="module")
def model(rows):
    return c.train([t for t, _ in rows[:160]], [y for _, y in rows[:160]])


def plain_score(model, text):
    """Every word compressed anew under each pair, every window summed by itself."""
    words, total = c.words_of(text), 0.0
    for p in model.pairs:
        evidence = []
        for w in words:
            lengths = []
            for content, top in ((p.toxic, c.TOP_T), (p.ordinary, c.TOP_O)):
                z = c._compressor(content)
                more = len(z.compress(c.HEAD + b" " + w + b" " + c.TAIL)) - len(z.compress(c.HEAD + b" " + c.TAIL))
                lengths.append(min(max(more, 0), top - 1))
            evidence.append(p.evidence[lengths[0] * c.TOP_O + lengths[1]])
        x = [0.0] * c.FEATURES
        if n := len(evidence):
            step = c.WINDOW // 2
            windows = [sum(evidence[s:s + c.WINDOW]) for s in range(0, max(1, n - step), step)]
            high = sum(e > 1.5 for e in evidence)
            x = [sum(evidence) / n * 8, max(windows) / 8, sum(windows) / len(windows) / 4, sum(w > 3 for w in windows) / len(windows),
                 high / n * 20, math.log1p(high), math.log1p(n) / 4]
        total += sum(a * b for a, b in zip(x + [1.0], p.weights))
    return 1 / (1 + math.exp(-total / len(model.pairs)))


def test_score_equals_plain_loops(rows, model):
    for text in ["", " ", "wretchix", *(t for t, _ in rows[160:166])]:
        assert model.score(text) == pytest.approx(plain_score(model, text), abs=1e-9)


def test_held_out_rows_are_told_apart(rows, model):
    wrong = [(t, y) for t, y in rows[160:] if (model.score(t) >= 0.5) != bool(y)]
    assert not wrong


def test_halves_keep_copies_together_and_labels_even():
    texts, labels = ["a", "b", "a", "c", "d", "d", "e", "a"], [0, 0, 0, 1, 1, 1, 0, 1]
    first = c._halves(texts, labels)
    assert first[0] == first[2] and first[4] == first[5] and first[0] != first[1] and first[3] != first[4]


def test_fit_and_score_edge_cases(spark, rows):
    docs = spark.createDataFrame([(k, t, 7) for k, (t, _) in enumerate(rows)] + [(900, None, 1), (901, "", 1), (0, rows[0][0], 7), (None, "x", 1)],
                                 "doc_id long, text string, `odd.name` int")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)] + [(900, 0), (None, 1)], "doc_id long, toxic int")
    model = c.fit_toxicity(docs, labels, F.lit(True))
    got = c.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) + 4 and len(model.pairs) == 2
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["score"], r["predicted"], r["n_words"]))
    assert all(len(v) == 1 for v in by.values()) and by[900] == by[901] and set(by) >= {None, 0, 900, 901}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert c.score_toxicity(docs.limit(0), model).count() == 0
    one = c.fit_toxicity(docs, labels.where("toxic = 0 or doc_id = 0"), F.lit(True))       # one toxic text, twice
    assert one.pairs == [] and 0 < one.prior < 0.1
    assert c.fit_toxicity(docs.limit(0), labels, F.lit(True)).score("anything") == 0.5
