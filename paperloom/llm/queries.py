"""The registered queries of the training-data operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import bpe, decontam, htmlmain, linededup, neardup, quality, secrets, tokenfiles, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, which the cluster's installation provides."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_text(_table(spark, sf_dir, "pages"))


OP6_SQL = """
with shingles as (
  select kind, id, case when len(w) < 5 then [array_to_string(w, ' ')]
    else [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] end as s, least(len(w), 5) as wide
  from (select kind, id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from (
    select 'doc' as kind, doc_id as id, text from documents union all select 'item', item_id, text from benchmark))
  where len(w) > 0),
one as (select kind, id, wide, unnest(list_distinct(s)) as s from shingles),
size as (select id, count(*) as n_item from one where kind = 'item' group by id)
select d.id as doc_id, i.id as item_id, count(*) as n_shared, any_value(n_item) as n_item,
  round(count(*) / any_value(n_item), 6) as containment
from one i join size using (id) join one d on d.kind = 'doc' and d.s = i.s
where i.kind = 'item' group by all having count(*) * 100 >= 80 * any_value(n_item)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


OP8_SQL = """
with docs as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
each as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from docs),
lines as (select doc_id, pos, line from each where regexp_matches(line, '[^ \\t\\r\\f\\x0B]')),
class as (select line, not contains(line, ' ') as chars, min({'d': doc_id, 'p': pos}) as own from lines group by line),
near as (select own, w, len(w) as n, chars from (select *, case when chars then string_split(line, '') else string_split(line, ' ') end as w from class) where len(w) >= case when chars then 24 else 8 end),
cut as (select own, w, n, chars, unnest([{'k': n // 2, 'f': true}, {'k': (n - 1) // 2, 'f': true}, {'k': n // 2, 'f': false}, {'k': (n - 1) // 2, 'f': false}]) as c from near),
half as (select own, w, n, chars, c, case when c.f then w[1:c.k] else w[n - c.k + 1:n] end as h from cut),
met as (select distinct a.own as own, a.w as x, b.w as y from half a join half b on a.c = b.c and a.h = b.h and a.chars = b.chars and abs(a.n - b.n) <= 1 and b.own < a.own),
compared as (select own, x, y,
  coalesce(list_position([p[1] is distinct from p[2] for p in list_zip(x, y)], true) - 1, least(len(x), len(y))) as pre,
  coalesce(list_position([p[1] is distinct from p[2] for p in list_zip(list_reverse(x), list_reverse(y))], true) - 1, least(len(x), len(y))) as post from met),
alike as (select distinct own from compared where greatest(len(x), len(y)) - least(pre + post, len(x), len(y)) <= 1),
gone as (select l.doc_id, l.pos from lines l join class c using (line) where c.own <> {'d': l.doc_id, 'p': l.pos}
  union select own.d, own.p from alike),
gone_of as (select doc_id, list(pos) as g from gone group by doc_id)
select doc_id, cast(len(ls) as bigint) as n_lines, cast(coalesce(len(g), 0) as bigint) as n_dropped,
  case when g is null then text else coalesce(array_to_string([ls[i + 1] for i in range(len(ls)) if not list_contains(g, i)], chr(10)), '') end as text
from docs left join gone_of using (doc_id)
"""


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings")).withColumn("rank", F.col("rank").cast("int"))


OP9_SQL = """
with v as (select vec_id, [cast(floor(1024 * x::double) as bigint) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum([a[1] * a[2] for a in list_zip(q.v, c.v)]) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op10_token_files": op10_token_files,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_html_main_text": op7_html_main_text,
    "op8_line_dedup": op8_line_dedup,
    "op9_topk": op9_topk,
}
ORACLES: dict[str, str] = {"op6_decontamination": OP6_SQL, "op8_line_dedup": OP8_SQL, "op9_topk": OP9_SQL}
