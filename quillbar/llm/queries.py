"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillbar.llm import (
    chat, exact_dedup, importance, licenses, maxent, mixing, ngram_join, packing, quality_rules, records, substring_dedup, topk,
    vector_codes,
)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    REGISTRY[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query
def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.joined(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


@query
def op5_binary_records(spark, sf_dir):
    found = records.round_trip(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query
def op10_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query
def op8_source_mixing(spark, sf_dir):
    found = mixing.taken(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op4_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


SQL["op4_exact_top_k"] = """
with v as (
  select vec_id, [floor(1024 * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (
  select q.vec_id as query_id, c.vec_id,
    list_sum([a[1] * a[2] for a in list_zip(q.v, c.v)])::bigint as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@query
def op7_chat_formatting(spark, sf_dir):
    return chat.rendered(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


SQL["op7_chat_formatting"] = r"""
with t as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
c as (
  select conv_id, count(*) as n_turns, list([role, text] order by turn nulls first, role, text) as s from t group by conv_id),
p as (select distinct s[1:i] as s from (select s, unnest(range(1, n_turns)) as i from c)),
k as (
  select min(conv_id) as conv_id, any_value(n_turns) as n_turns, s from c group by s)
select conv_id, n_turns,
  list_aggregate([concat('<|im_start|>', x[1], chr(10), replace(x[2], '<|', '< |'), '<|im_end|>', chr(10)) for x in s], 'string_agg', '') as text
from k where not exists (select 1 from p where p.s = k.s)
"""


@query
def op6_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"), licenses.notices(spark))
    return found.select(F.col("key").alias("doc_id"), "license", "first_word", "n_words", "containment")


@query
def op9_maxent_scores(spark, sf_dir):
    return maxent.scores(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query
def op11_importance_resampling(spark, sf_dir):
    found = importance.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


SQL["op11_importance_resampling"] = r"""
with recursive steps(i, n, c) as (
  select i::bigint, 0, i::bigint from range(256) r(i)
  union all
  select i, n + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from steps where n < 8),
tab as (select list(c order by i) as tab from steps where n = 8),
texts as (
  select 'd' as side, doc_id, text from documents union all select 'b', item_id, text from benchmark),
split as (
  select side, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from texts),
f as (select side, doc_id, unnest(w) as w from split),
bytes as (
  select w, [('0x' || substr(h, 2 * i - 1, 2))::bigint for i in range(1, len(h) // 2 + 1)] as b
  from (select w, hex(encode(w)) as h from (select distinct w from f))),
bucket as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::bigint) % 10000 as k
  from bytes cross join tab),
n as (
  select k, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from f join bucket using (w) group by k),
all_n as (select sum(s)::bigint as s, sum(t)::bigint as t from n),
gain as (
  select k, floor(1000 * ln((n.t + 1) * (all_n.s + 10000)::double / ((n.s + 1) * (all_n.t + 10000)::double)))::bigint as g
  from n cross join all_n),
weight as (
  select doc_id, count(*) as n_features, floor(sum(g)::double / count(*))::bigint as weight
  from f join bucket using (w) join gain using (k) where side = 'd' group by doc_id),
score as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from documents left join weight using (doc_id)),
placed as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
    count(*) over (partition by n_features >= 20) as able
  from score)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= able * 10 // 100 then place end as rank from placed
"""


@query
def op12_vector_codes(spark, sf_dir):
    found = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("key").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _rounds_of_codes(rounds: int) -> str:
    """Lloyd's rounds written out, one pair of common table expressions each."""
    nearest = """
a{r} as materialized (
  select vec_id, label, part, v, min({{'d': list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(v, c)])::bigint, 'e': entry}}) as best
  from p join b{r} using (part) group by vec_id, label, part, v),"""
    moved = """
b{n} as materialized (
  select b{r}.part, b{r}.entry, coalesce(m.c, b{r}.c) as c from b{r} left join (
    select part, entry, list((s - ((s % n) + n) % n) // n order by i) as c from (
      select part, best['e'] as entry, i, sum(v[i])::bigint as s, count(*) as n
      from a{r}, unnest(range(1, len(v) + 1)) u(i) group by 1, 2, 3) group by 1, 2) m
  on m.part = b{r}.part and m.entry = b{r}.entry),"""
    return "".join(nearest.format(r=r) + moved.format(r=r, n=r + 1) for r in range(rounds)) + nearest.format(r=rounds)


SQL["op12_vector_codes"] = f"""
with k as (
  select vec_id, label, [floor(4096 * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as materialized (
  select vec_id, label, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] as v from k, unnest(range(8)) u(part)),
b0 as materialized (
  select part, entry, v as c from p join (select vec_id, row_number() over (order by vec_id) - 1 as entry from k) using (vec_id) where entry < 16),
{_rounds_of_codes(vector_codes.ROUNDS)}
books as (
  select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from b{vector_codes.ROUNDS}),
found as (
  select vec_id, label, string_agg(printf('%02x', best['e']), '' order by part) as code, sum(best['d'])::bigint as error
  from a{vector_codes.ROUNDS} group by vec_id, label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from found cross join books
"""


@query
def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.judged(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


SQL["op13_exact_dedup"] = """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as v from documents)
select doc_id, max(doc_id) over (partition by v) as keep_id, count(*) over (partition by v) as group_size,
  row_number() over (partition by v order by doc_id desc nulls last) = 1 as kept, sha256(v) as text_sha256
from n
"""
