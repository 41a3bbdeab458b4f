"""Registered queries of the training-data operators: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanpanel.llm import (compression, decontaminate, licenses, mil, packing, personal, phrases, runs, secrets, simhash,
                           substring, token_files, topk)

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_substring_dedup")
def op1(spark, sf_dir):
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), width=35)


@query("op2_simhash")
def op2(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@query("op3_secret_scan")
def op3(spark, sf_dir):
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


@query("op4_license_scan")
def op4(spark, sf_dir):
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = compression.fit_toxicity(docs, labels, ~held_out)
    return compression.score_toxicity(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted", "n_words")


@query("op6_quality")
def op6(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = mil.fit_quality(docs, labels, ~held_out)
    return mil.score_quality(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted", "n_passages")


@query("op7_decontamination")
def op7(spark, sf_dir):
    found = decontaminate.benchmark_overlaps(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.size("overlaps").cast("long").alias("n_overlaps"),
        F.array_join(F.array_sort(F.array_distinct("overlaps.item_id")), ",").alias("item_ids"),
        F.coalesce(F.array_max("overlaps.equal"), F.lit(0)).cast("long").alias("most_equal"),
        F.array_join(F.transform("overlaps", lambda o: F.concat_ws(":", o["item_id"], o["start"], o["end"])), ",").alias("spans"))


# a float's product with a power of two is exact, so both engines floor the same number
@query("op8_topk_search", """
with v as (
  select vec_id, [cast(floor(256 * cast(e as double)) as bigint) for e in embedding] as x
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""")
def op8(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query("op9_packing")
def op9(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


@query("op10_token_files")
def op10(spark, sf_dir):
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    return runs.run_digests(runs.periodic_runs(_table(spark, sf_dir, "documents"), copies=4, min_words=6, rewrite=runs.repeat_tail))


@query("op12_collocations", """
with d as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from p),
g as (
  select lang, s as size, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) as phrase
  from w, (values (1), (2), (3)) v(s) where len(w) >= s),
c as materialized (select lang, size, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from c where size = 1 group by lang),
k as materialized (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from c where size >= 2 and f >= 10),
cut as materialized (
  select lang, size, phrase, a, cut, array_to_string(w[1:cut], ' ') as head, array_to_string(w[cut + 1:], ' ') as rest
  from k, (values (1), (2)) v(cut) where cut < size),
lefts as materialized (select cut.*, c.f as l from cut join c on c.lang = cut.lang and c.phrase = cut.head),
cuts as materialized (
  select lefts.*, c.f as r, ((1000000::hugeint * a * a) // (l::hugeint * c.f::hugeint)) as score
  from lefts join c on c.lang = lefts.lang and c.phrase = lefts.rest),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inside as (
  select lang, array_to_string(w[1:2], ' ') as phrase, a from k where size = 3
  union all select lang, array_to_string(w[2:3], ' '), a from k where size = 3),
longer as (select lang, phrase, max(a) as more from inside group by all),
kept as (
  select best.* from best left join longer on longer.lang = best.lang and longer.phrase = best.phrase
  where more is null or 100 * more < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join n using (lang) where rank <= 2000""")
def op12(spark, sf_dir):
    return phrases.collocations(_table(spark, sf_dir, "documents"), longest=3, least=10, absorb_percent=50, top=2000)


# the kinds' plain patterns; places are sums of the lengths of gaps and matches
_KIND_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9](?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "tel": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
}
_IBAN_LENGTHS = ", ".join(f"'{k}': {v}" for k, v in personal.IBAN_LENGTHS.items())
_VALID = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(hit, '.'), lambda x: case when length(ltrim(x, '0')) > 3 then 999 "
          "when ltrim(x, '0') = '' then 0 else cast(ltrim(x, '0') as int) end)) <= 255",
    "card": "length(dg) between 14 and 19 and list_sum(list_transform(range(1, length(dg) + 1), lambda i: "
            "case when (length(dg) - i) % 2 = 0 then cast(substr(dg, i, 1) as int) when substr(dg, i, 1) > '4' "
            "then 2 * cast(substr(dg, i, 1) as int) - 9 else 2 * cast(substr(dg, i, 1) as int) end)) % 10 = 0",
    "phone": "length(dg) between 10 and 15",
    "iban": "own > 0 and length(hit) >= own and not regexp_matches(before, '[A-Za-z0-9]$') "
            "and case when length(hit) > own then substr(hit, own + 1, 1) = ' ' else not regexp_matches(after, '^[A-Za-z0-9]') end "
            "and list_reduce(list_prepend(0, list_transform(string_split(substr(bare, 5) || substr(bare, 1, 4), ''), "
            "lambda c: case when c <= '9' then cast(ascii(c) - 48 as int) else cast(ascii(c) - 55 as int) end)), "
            "lambda a, x: case when x < 10 then (a * 10 + x) % 97 else (a * 100 + x) % 97 end) = 1",
    "ssn": "not regexp_matches(hit, '^(?:000|666|9)|-00-|-0000$') and not regexp_matches(before, '[0-9-]$') and not regexp_matches(after, '^[0-9-]')",
    "tel": "not regexp_matches(before, '[0-9+][ ().-]{0,3}$') and not regexp_matches(after, '^[ .-]?[0-9]')",
}


def _near_sql(words: str) -> str:
    return f"case when regexp_matches(around, '(?:^|[^a-z])(?:{words})(?:[^a-z]|$)') then 20 else 0 end"


def _by_kind(of) -> str:
    return "case kind " + " ".join(f"when '{k}' then {of(k)}" for k in personal.KINDS) + " end"


_PERSONAL_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(f"select doc_id, '{k}' as kind, {i} as rank, regexp_extract_all(t, '{p}') as h, string_split_regex(t, '{p}') as p from d"
                            for i, (k, p) in enumerate(_KIND_PATTERNS.items()))}),
u as (select doc_id, kind, rank, i, h[i] as hit, p[i] as before, p[i + 1] as after from (select *, unnest(range(1, len(h) + 1)) as i from m)),
n as (select *, coalesce(map {{{_IBAN_LENGTHS}}}[substr(hit, 1, 2)], 0) as country from u),
e as (select *, cast(case when kind <> 'iban' then length(hit) when substr(hit, 5, 1) = ' ' then country + floor((country - 1) / 4.0) else country end as bigint) as own from n),
s as (
  select *, cast(sum(length(before) + length(hit)) over (partition by doc_id, kind order by i) as bigint) - length(hit) as start,
         regexp_replace(hit, '[^0-9]', '', 'g') as dg, replace(substr(hit, 1, own), ' ', '') as bare,
         translate(right(before, {personal.BEFORE}) || ' ' || left(after, {personal.AFTER}), '{personal.UPPER}', '{personal.LOWER}') as around
  from e),
v as (
  select doc_id, kind, rank, start, start + own as stop,
         {_by_kind(lambda k: personal.KINDS[k].score)} + {_by_kind(lambda k: _near_sql(personal.KINDS[k].near))} - {_near_sql(personal.DOUBTFUL)} as score
  from s where {_by_kind(lambda k: _VALID[k])}),
g as (
  select doc_id, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in personal.KINDS)},
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < 4) as base,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans,
         string_agg(cast(score as varchar), ',' order by start, rank) as scores
  from v where score >= {_by_kind(lambda k: personal.KINDS[k].least)} group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in personal.KINDS)}, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(scores, '') as scores
from d left join g on g.doc_id = d.doc_id"""


@query("op13_personal_data", _PERSONAL_SQL)
def op13(spark, sf_dir):
    return personal.span_digests(personal.personal_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")))
