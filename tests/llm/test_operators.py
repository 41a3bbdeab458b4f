"""Each operator's registered query against a brute-force version over whole tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import __spark_entry__ as E
from conftest import SF_SMALL
from loanpanel.llm import licenses, secrets

Q = {k: v for k, v in E.queries().items() if re.match(r"op\d+_", k)}
NAMES = {int(re.match(r"op(\d+)_", k)[1]): k for k in Q}


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())


def rows(spark, n):
    return [r.asDict() for r in Q[NAMES[n]](spark, SF_SMALL).collect()]


def words(text):
    return text.encode().split()


def test_substring_dedup(spark, texts):
    width = 35
    split = {d: words(t) for d, t in texts.items()}
    seen = Counter(tuple(w[i:i + width]) for w in split.values() for i in range(len(w) - width + 1))
    got = {r["doc_id"]: r for r in rows(spark, 1)}
    assert len(got) == len(texts)
    for d, w in split.items():
        keep = [True] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                keep[i:i + width] = [False] * width
        left = b" ".join(x for x, k in zip(w, keep) if k)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(w), keep.count(False), hashlib.sha256(left).hexdigest())


@pytest.mark.parametrize("shard_words", [40, 3000])
def test_substring_dedup_by_crowded_anchors(spark, shard_words):
    from loanpanel.llm.substring import remove_repeats
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(9)]
    common = rng.choice(vocabulary, 30).tolist()
    docs = [rng.choice(vocabulary, 8).tolist() + common + rng.choice(vocabulary, 8).tolist() for _ in range(40)]
    docs += [["a"] * 40, ["a", "b", "c"] * 7, ["b"] * 11, [], docs[0], docs[1]]
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(99, None)], "doc_id long, text string")
    width = 12
    seen = Counter(tuple(w[i:i + width]) for w in docs for i in range(len(w) - width + 1))
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in remove_repeats(table, width=width, gram=4, shard_words=shard_words, with_text=True).collect()}
    assert got.pop(99) == (0, None)
    for d, w in enumerate(docs):
        keep = [True] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                keep[i:i + width] = [False] * width
        left = " ".join(x for x, k in zip(w, keep) if k)
        assert got[d] == (keep.count(False), left if not all(keep) else None)


def plain_simhash(text, k=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=2):
    ids = sorted(fps)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_simhash(spark, texts):
    fps = {d: plain_simhash(t) for d, t in texts.items()}
    want = components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, 2)}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_one_of_each_group_is_kept(spark):
    from loanpanel.llm.simhash import keep_one
    rng = np.random.default_rng(3)
    a, b, c, d, e = (" ".join(rng.choice([f"w{i}" for i in range(500)], 60)) for _ in range(5))
    # id 1 is the least of two groups; groups of null ids only; copies, null and empty texts
    rows = [(1, a), (1, b), (2, a), (3, b), (3, b), (4, c), (None, c), (None, d), (None, d), (None, e), (5, None), (6, ""), (None, None)]
    rows += [(10 + i, f"{a} w{i}") for i in range(3)]
    fps = {k: plain_simhash(t or "") for k, (_, t) in enumerate(rows)}
    groups = defaultdict(list)
    for k, root in components(fps).items():
        groups[root].append((rows[k][0] is None, rows[k][0] or 0, fps[k] - (fps[k] >> 63 << 64), hashlib.sha256(rows[k][1].encode()).hexdigest() if rows[k][1] is not None else "", k))
    want = Counter(rows[min(g)[-1]] for g in groups.values())
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string").repartition(3)
    got = keep_one(table)
    assert got.columns == ["doc_id", "text", "lang"]
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert want[(1, a)] == want[(1, b)] == want[(None, d)] == 1 and not want[(None, c)]
    assert keep_one(table.where("false")).collect() == []


def test_secret_scan(spark, texts):
    kinds = (("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
             ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
             ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16))
    for r in rows(spark, 3):
        found = [(m.start(), k, m.end(), name) for k, (name, rx, ok) in enumerate(kinds) for m in rx.finditer(texts[r["doc_id"]]) if ok(m)]
        base = ",".join(f"{name}:{s}:{e}" for s, _, e, name in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[3] == k for f in found) for k, _, _ in kinds]
        own = [x for x in r["spans"].split(",") if x.startswith("guess:")]
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("guess:")) == base
        assert len(own) == r["n_guess"]


def test_guess_cost_is_the_least_segmentation():
    def slow(v):                        # all cuts of short values, each span priced by itself
        low, leet, char = v.lower(), v.lower().translate(secrets.LEET), secrets._char_cost(v)

        def span(s, e):
            x, costs = v[s:e], [char * (e - s)]
            for form, extra in ((low, 0.0), (leet, 0.3)):
                if e - s >= 3 and form[s:e] in secrets.RANK:
                    costs.append(math.log10(secrets.RANK[form[s:e]] + 1) + extra + 0.3 * (x != low[s:e]))
            if secrets.DATE.fullmatch(low[s:e]):
                costs.append(secrets.YEAR_COST if e - s == 4 else secrets.DATE_COST)
            pairs = list(zip(low[s:e], low[s + 1:e]))
            maximal = lambda ok: all(ok(a, b) for a, b in pairs) and not (s and ok(low[s - 1], low[s]))
            if e - s >= 3 and any(maximal(ok) for ok in (lambda a, b: a == b, lambda a, b: (a, b) in secrets.NEIGHBOURS,
                                                         lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(a) - ord(b) == 1)):
                costs.append(char + math.log10(e - s))
            return min(costs)
        best = {0: 0.0}
        for e in range(1, len(v) + 1):
            best[e] = min(best[s] + span(s, e) for s in range(e))
        return best[len(v)]
    for v in ("", "a", "password", "P@ssw0rd", "qwertyuiop", "aaaaaaa1", "20240131x", "abcdef12", "Zq8#kP0!vT", "dragon1999monkey", "1987-12-03zz", "9876qwe"):
        assert secrets.guess_cost(v) == pytest.approx(slow(v)), v
    assert secrets.guess_cost("password123") < 4 < 9 < secrets.guess_cost("x7Kq9PzL2mVb")
    assert [k for *_, k in secrets.scan('pwd: "monkey123"')] == [] and [k for *_, k in secrets.scan("pwd: kX92-qLm#7Tz")] == ["guess"]


def test_license_scan(spark, texts):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    tokens = {k: set(split(v)) for k, v in licenses.TEMPLATES.items()}
    for r in rows(spark, 4):
        w = split(texts[r["doc_id"]])
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        best = {}
        for line in re.split(r"[\n\r]+", texts[r["doc_id"]]):
            b = set(split(line))
            for k, t in tokens.items():
                if len(t & b) >= math.ceil(0.85 * len(t) - 1e-9):
                    best[k] = max(best.get(k, 0), len(t & b) / len(t))
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert r["labels"] == ",".join(sorted({x for _, x in places} | set(best)))
        assert r["score"] == pytest.approx(1.0 if places else max(best.values(), default=0.0))


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_license_scan_finds_wrapped_notices(spark, mark):
    import textwrap
    wrapped = {k: "\n".join(mark + x for x in textwrap.wrap(v, 72)) for k, v in licenses.TEMPLATES.items()}
    wrapped |= {f"{k}/narrow": "\n".join(mark + x for x in textwrap.wrap(v, 24)) for k, v in licenses.TEMPLATES.items()}
    head, tail = "one line ahead of it\n" * 9, "\nwords that follow" * 40
    texts = wrapped | {f"{k}/inside": head + v + tail for k, v in wrapped.items()}
    texts |= {"line": head + licenses.TEMPLATES["mpl-header"] + tail, "none": head + tail,
              "twice": tail.join([wrapped["mit-grant"]] * 2), "apart": "Permission is hereby granted free of charge to any person" + tail + " obtaining a copy of this software and associated documentation files"}
    table = spark.createDataFrame([*texts.items(), ("null", None), ("none", "")], "doc_id string, text string")
    got = licenses.license_scan(table).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if (name := r["doc_id"].split("/")[0]) in licenses.TEMPLATES:
            assert name in r["labels"].split(",") and r["score"] == 1.0 and r["n_blocks"] == 1, r
        else:
            assert (r["labels"], r["n_blocks"]) == {"line": ("mpl-header", 1), "twice": ("mit-grant", 2)}.get(name, ("", 0)), r


@pytest.mark.parametrize("n,label,modulus,rest", [(5, "toxic", 5, 0), (6, "quality", 3, 1)])
def test_classifiers_on_held_out_rows(spark, duck, n, label, modulus, rest):
    y = dict(duck.execute("select doc_id, %s from read_parquet('/root/testdata/sf0.01/labels.parquet')" % label).fetchall())
    got = [r.asDict() for r in Q[NAMES[n]](spark, "/root/testdata/sf0.01").collect()]
    assert len({r["doc_id"] for r in got}) == len(got) == 1000
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in got)
    held = [(r["score"], y[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in y]
    pos, neg = [s for s, v in held if v], [s for s, v in held if not v]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert auc > (0.75 if n == 5 else 0.95), auc


def test_quality_encodes_every_character_of_unbroken_text():
    from loanpanel.llm import mil
    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 20_000)))
    got = mil.Encoder().passages(text)
    assert len(got) == -(-(-(-len(text) // mil.PIECE)) // mil.PASSAGE) == 7
    spoilt = mil.Encoder().passages(text[:19_000] + "Ab1," * 250)      # far behind the first characters
    assert (spoilt[:6] != got[:6]).any(axis=0).sum() <= 2 and (spoilt[6] != got[6]).any()
    assert mil._word_code("aB1,-" * 9 + "cD2") != mil._word_code("aB1,-" * 9 + "c2D")
    words = [w for w in ("x" * k + "," + "Y" * k for k in range(1, 23))]
    assert mil._pieces(words) is words and "".join(mil._pieces([*words, text])) == "".join(words) + text


def test_toxicity_reads_unbroken_runs():
    from loanpanel.llm import compression as c
    rng = np.random.default_rng(8)
    signs = [chr(x) for x in rng.integers(0x4E00, 0x9FA5, 300)]
    plain = lambda n: "".join(rng.choice(signs, n))
    bad = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 8))) for _ in range(3)]
    texts = [plain(60) + (bad[k % 3] * 2 + plain(20) if y else plain(36)) + plain(60) for k, y in enumerate([0, 0, 1, 1] * 60)]
    model = c.train(texts[:160], [0, 0, 1, 1] * 40)
    scores = np.array([model.score(t) for t in texts[160:]]).reshape(-1, 4)
    assert np.mean([p > q for p in scores[:, 2:].flat for q in scores[:, :2].flat]) > 0.9
    run = "".join(texts).encode()
    pieces = c.words_of(run.decode())
    at = [*range(0, len(run) - c.PIECE, c.STEP), len(run) - c.PIECE]
    assert pieces == [run[i:i + c.PIECE] for i in at] and len(model.codes(run.decode())) == len(pieces)
    lengths = c.Lengths(b"", b"")
    noise = rng.integers(0x4E00, 0x9FA5, (200, 4))
    assert max(lengths.code("".join(map(chr, n)).encode()) // c.TOP_O for n in noise) < c.TOP_T - 1


def test_decontamination_finds_whole_and_substituted_items(spark, texts, duck):
    split = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = {i: split(t) for i, t in duck.execute("select item_id, text from benchmark").fetchall()}
    got = {r["doc_id"]: set(filter(None, r["item_ids"].split(","))) for r in rows(spark, 7)}
    assert len(got) == len(texts)

    def stretch(w, t):
        """The most equal tokens over all ways to lay t along w, by the verified rule."""
        for shift in range(-len(t) + 1, len(w)):
            a, b = max(0, -shift), min(len(t), len(w) - shift)
            same = [w[i + shift] == t[i] for i in range(a, b)]
            best = total = start = 0
            found = None
            for i, s in enumerate(same):
                if total <= 0:
                    total, start = 0, i
                total += 1 if s else -2
                if total > best:
                    best, found = total, (start, i + 1)
            if found:
                equal = sum(same[slice(*found)])
                if equal >= min(12, math.ceil(0.8 * len(t))) and equal >= 0.8 * (found[1] - found[0]):
                    return True
        return False
    for d, t in texts.items():
        if len(t) < 4000:
            w = split(t)
            assert got[d] == {str(i) for i, x in items.items() if len(set(x) & set(w)) > 5 and stretch(w, x)}, d


def test_decontamination_accepts_every_placement_of_substitutions():
    import itertools
    from loanpanel.llm import decontaminate as d
    from loanpanel.llm.common import Powers

    def accepted(same):
        need = min(d.MIN_MATCH, math.ceil(d.MIN_SHARE * len(same) - 1e-9))
        return any(sum(same[i:j]) >= max(need, d.MIN_SHARE * (j - i) - 1e-9) for i in range(len(same)) for j in range(i + 1, len(same) + 1))
    powers = Powers()
    with np.errstate(over="ignore"):
        for n in range(8, 18):
            item = [f"t{i}" for i in range(n)]
            block = d.BenchmarkBlock([(7, " ".join(item))], d.MIN_MATCH, d.MIN_SHARE)
            for k in (0, 1, 2, 3):
                for places in itertools.combinations(range(n), k):
                    same = [i not in places for i in range(n)]
                    got = block.search(" ".join(["other"] * 4 + [w if s else "x" for w, s in zip(item, same)] + ["words"] * 3), powers)
                    assert bool(got) == accepted(same), (n, places)
                    for item_id, start, end, equal in got:
                        assert item_id == 7 and 4 <= start < end <= 4 + n and equal == sum(same[start - 4:end - 4]) >= 0.8 * (end - start) - 1e-9


def test_decontamination_finds_short_items_whole(spark):
    from loanpanel.llm.decontaminate import benchmark_overlaps, drop_contaminated
    items = [(n, " ".join(f"k{n}w{i}" for i in range(n))) for n in range(1, 8)] + [(90, ""), (91, " .,"), (92, None), (None, "words to see")]
    docs = [(n, f"Some words, {t.upper()}! and more") for n, t in items[:7]] + [(10 + n, t) for n, t in items[:7]]
    clean = [(20 + n, " x ".join(t.split()[:-1])) for n, t in items[1:7]] + [(30, "words to see"), (31, ""), (32, None)]
    table = spark.createDataFrame(docs + clean, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: [(o["item_id"], o["start"], o["end"], o["equal"]) for o in r["overlaps"]] for r in benchmark_overlaps(table, bench).collect()}
    assert got == {**{n: [(n, 2, 2 + n, n)] for n in range(1, 8)}, **{10 + n: [(n, 0, n, n)] for n in range(1, 8)}, **{k: [] for k, _ in clean}}
    assert {r["doc_id"] for r in drop_contaminated(table, bench).collect()} == {k for k, _ in clean}


def test_topk(spark, duck):
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(spark, 8))
    assert got == sorted(duck.execute(E.oracle_sql()[NAMES[8]]).fetchall())


def test_packing_covers_every_id_once(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, 9):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for d, ps in pieces.items():
        ids, at = tok.encode(texts[d], add_special_tokens=False).ids + [1], 0
        for p in sorted(ps, key=lambda p: p["start"]):
            part = ids[p["start"]:p["start"] + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p["length"]
        assert at == len(ids)
    for k, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or k == max(sequences) and at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))


def test_token_files_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in rows(spark, 10)}
    for d in sorted(texts):
        ids = tok.encode(texts[d], add_special_tokens=False).ids + [2]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert len(got) == len(texts)
