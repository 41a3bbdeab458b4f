"""Personal data: the query and the operator against regular expressions and plain checks."""

import hashlib
import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from loanpanel.llm.personal import IBAN_LENGTHS, KINDS, personal_spans, redact_personal, span_digests


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits(hit):
    return re.sub("[^0-9]", "", hit)


BASE = {        # the plain patterns, and what a match has to pass
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in h.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda h: 14 <= len(digits(h)) <= 19 and plain_luhn(digits(h))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 10 <= len(digits(h)) <= 15),
}


def plain_base(text):
    out = [(m.start(), k, m.end(), name) for k, (name, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, text) if ok(m[0])]
    return [(start, end, name) for start, _, end, name in sorted(out)]


def check_base(row, text):
    base = plain_base(text)
    assert [row[f"n_{k}"] for k in BASE] == [sum(s[2] == k for s in base) for k in BASE]
    joined = [f"{k}:{s}:{e}" for s, e, k in base]
    assert row["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
    spans = row["spans"].split(",") if row["spans"] else []
    assert [s for s in spans if s.split(":")[0] in BASE] == joined
    assert len(spans) == len(row["scores"].split(",")) if spans else row["scores"] == ""
    return spans


def test_query_against_plain_patterns(spark, duck):
    texts = dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())
    got = E.queries()["op13_personal_data"](spark, SF_SMALL).collect()
    assert len(got) == len(texts) and sum(bool(check_base(r, texts[r["doc_id"]])) for r in got) > 3


TRAPS = [
    "", "no data", "a@b.c_d@e.f a@b.c.@g.h", "x@y @z.q a@-.- .@a.b", "a.b@c.d-e.f..g", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1 000255.0.0.1 1.1.1.1",
    "4111 1111 1111 1111", "4111-1111 11111111 4111 1111 1111 1112", "4111  1111 1111 1111", "5500005555555559 and 30569309025904", "0" * 14 + " " + "0" * 20,
    "0" * 19, "+1 (843) 555-7672", "+1(2)3.4-5 6 7 8 9 0 1", "+1 2 3", "+1+1 222 333 4444+", "+49 30 1234567890123", "é\U0001f600 a@b.cd \U0001f600 10.0.0.1 \U0001f600",
    "9" * 5_000, "a." * 3_000 + "@b.c", "a@" + "b." * 9_000 + "c", "+1" + " " * 20_000 + "2", "1." * 20_000, "@" * 3_000, "1 " * 9_000, "x@y.z " * 700,
    "1.1.1.1 " * 400 + "4111111111111111", "\n+1\n", "a@b\n.c", "+1 555 555 5555 ",
]


def test_traps(spark):
    docs = spark.createDataFrame(list(enumerate(TRAPS)) + [(99, None)], "doc_id long, text string")
    for r in span_digests(personal_spans(docs)).collect():
        check_base(r, TRAPS[r["doc_id"]] if r["doc_id"] != 99 else "")


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["kind"], texts[r["doc_id"]][x["start"]:x["end"]], x["score"]) for x in r["spans"]] for r in personal_spans(rows).collect()}
    return [got[i] for i in range(len(texts))]


def test_checked_kinds_and_context(spark):
    assert plain_iban("DE89370400440532013000") and set(map(len, IBAN_LENGTHS)) == {2}
    texts = ["IBAN: DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000.", "BE68 5390 0754 7034 BIC", "DE89 3704 0044 0532 0130 01",
             "GB82WEST12345698765432", "xGB82WEST12345698765432", "GB82WEST12345698765432x", "QQ82WEST12345698765432",
             "her SSN is 123-45-6789", "part 123-45-6789", "SSN 000-12-3456", "call (843) 555-7672 now", "row 843 555 7672", "Tel: +1 (843) 555-7672",
             "mail me: a@b.example", "version 1.2.3.4", "host 1.2.3.4", "é login from 10.0.0.1"]
    iban, got = "DE89 3704 0044 0532 0130 00", found(spark, texts)
    assert [[(k, t) for k, t, _ in x if k not in ("card",)] for x in got] == [
        [("iban", iban)], [("iban", "DE89370400440532013000")], [("iban", "BE68 5390 0754 7034")], [], [("iban", "GB82WEST12345698765432")], [], [], [],
        [("ssn", "123-45-6789")], [], [], [("tel", "(843) 555-7672")], [], [("phone", "+1 (843) 555-7672")],
        [("email", "a@b.example")], [("ip", "1.2.3.4")], [("ip", "1.2.3.4")], [("ip", "10.0.0.1")]]
    score = [x[0][2] if x else None for x in got]
    assert score[0] > score[1] and score[13] > KINDS["phone"].score and score[15] < KINDS["ip"].score < score[16] == score[17]


def plain_iban(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_redaction_and_edge_cases(spark):
    rows = [(1, "write a@b.cd, é +1 (843) 555-7672!", "x", 1), (1, "write a@b.cd, é +1 (843) 555-7672!", "x", 1), (2, None, "y", 2), (3, "", "y", None), (None, "1.2.3.4", None, 3),
            (5, "4111.4111.1.1 4111111111111111 4111 1111 1111 1111", "w" * 9, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, `a.b` long")
    clean = redact_personal(docs)
    assert clean.schema.names == docs.schema.names
    same = "write [EMAIL], é [PHONE]!"
    key = lambda r: (r[0] is None, r[0] or 0, str(r))                   # noqa: E731
    assert sorted(map(tuple, clean.collect()), key=key) == sorted(
        [(1, same, "x", 1), (1, same, "x", 1), (2, None, "y", 2), (3, "", "y", None), (None, "[IP]", None, 3), (*rows[5][:1], rows[5][1], *rows[5][2:])], key=key)
    spans = personal_spans(docs, into="found")
    assert spans.columns == [*docs.columns, "found"] and spans.count() == len(rows)
    assert personal_spans(docs.where("false")).collect() == [] == redact_personal(docs.where("false")).collect()
    assert [r["found"] for r in spans.where("doc_id in (2, 3)").collect()] == [[], []]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    import random
    rng = random.Random(seed)
    parts = ["a@b.c", "@", ".", "+", "1", "22", "255", "256", "-", " ", "(", ")", "x", "é", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "+1 234 567 8901", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in span_digests(personal_spans(docs)).collect():
        check_base(r, texts[r["doc_id"]])
