"""The pipeline's filters on tables whose columns have dotted, clashing or quoted names; nulls and empty tables."""

import pytest

from loanpanel.llm import secrets, simhash

SCHEMA = ("doc_id long, text string, n_chars int, `meta.source` string, fp string, digest int, clean string, `__fp__` string, "
          "`__digest__` string, `__clean__` string, c0 string, `od``d` int")


def row(k, text):
    return (k, text, None if text is None else len(text), f"s{k}", "f", 5, "own", "a", "b", "c", "d", None)


@pytest.fixture(scope="module")
def table(spark):
    words = " ".join(f"word{i}" for i in range(40))
    key = "password = 'x9Qz7Lm2Vt8K'"
    rows = [row(3, words), row(1, words), row(1, words), row(7, words + " tail"), row(9, f"other things here {key}"), row(4, None), row(5, ""),
            row(None, "a text with no number of its own, alone"), row(6, "long " * 40_000)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_keep_one_leaves_other_columns_alone(table):
    rows, df = table
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    got = [tuple(r) for r in kept.collect()]
    assert all(r in rows for r in got) and len(got) == len({r[0] for r in got})
    near = {1, 3, 7} if any(r["component_id"] == 1 and r["doc_id"] == 7 for r in simhash.near_duplicates(df).collect()) else {1, 3}
    want = {1, 7, 9, 4, None, 6} - (near - {1})
    assert {r[0] for r in got} == want
    assert simhash.keep_one(df.limit(0)).collect() == []


def test_redact_leaves_other_columns_alone(table):
    rows, df = table
    done = secrets.redact_secrets(df)
    assert done.columns == df.columns
    want = []
    for r in rows:
        text = secrets.redact(r[1], secrets.scan(r[1]))
        want.append((r[0], text, r[2] if text == r[1] else len(text), *r[3:]))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([tuple(r) for r in done.collect()], key=order) == sorted(want, key=order)
    assert [r[1] for r in want if r[0] == 9] == ["other things here [SECRET]"] or any("[SECRET]" in r[1] for r in want if r[0] == 9)
    assert secrets.redact_secrets(df.limit(0)).collect() == []
    bare = secrets.redact_secrets(df.select("text", "`meta.source`"))
    assert bare.columns == ["text", "meta.source"] and bare.count() == len(rows)
