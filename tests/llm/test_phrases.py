"""Collocations: the operator against counters and exact integers, on real texts and on small cases."""

import re
from collections import Counter, defaultdict

import __spark_entry__ as E
from conftest import SF_SMALL
from loanpanel.llm import phrases
from loanpanel.llm.phrases import collocations


def plain(docs, longest=3, least=10, absorb=50, top=2000):
    counts = defaultdict(Counter)
    for lang, text in docs:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        covered = defaultdict(int)
        for p, c in cand.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i:i + size]] = max(covered[p[i:i + size]], c)
        rows = []
        for p, a in cand.items():
            if 100 * covered[p] >= absorb * a and covered[p]:
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n, -s))
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_counters(spark, duck):
    docs = duck.execute("select lang, text from documents").fetchall()
    found = E.queries()["op12_collocations"](spark, SF_SMALL)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got(found) == plain(docs) != set()


def test_longer_phrases_and_small_chunks(spark, duck, monkeypatch):
    docs = duck.execute("select lang, text from documents limit 60").fetchall()
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 3_000)
    table = spark.createDataFrame(docs, "lang string, text string")
    for longest, least, absorb, top in ((4, 3, 70, None), (5, 2, 100, 40), (2, 2, 50, 7)):
        assert got(collocations(table, longest=longest, least=least, absorb_percent=absorb, top=top)) == plain(docs, longest, least, absorb, top)


def test_edge_cases(spark):
    rows = [(1, None, None, "x")] + [(2, None, "Ab\tcd. AB  cd\x0bab cd! É É", "y")] * 5 + [(3, "und", "ab cd", "z"), (4, "fr", "", None), (5, "", "a b " * 12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, phrase string")
    assert got(collocations(docs)) == plain([(r[1], r[2]) for r in rows])
    assert {r[0] for r in got(collocations(docs))} == {"und", ""}
    assert got(collocations(docs, least=1)) == plain([(r[1], r[2]) for r in rows], least=1)
    assert collocations(docs.where("false")).collect() == []


def test_score_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    a, l, r = 999_999_999_999_989, 999_999_999_999_990, 999_999_999_999_991
    wide = lambda c: f"cast({c} as decimal(15, 0))"                                      # noqa: E731
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide('n')} * {wide('n')})) div ({wide('l')} * {wide('r')})")
    table = spark.createDataFrame([(a, l, r), (a, a, a), (7_000_000_019, 7_000_000_021, 9_000_000_043)], "n long, l long, r long")
    assert [x[0] for x in table.select(score).collect()] == [10**6 * n * n // (l * r) for n, l, r in [tuple(t) for t in table.collect()]]
