"""Pieces of DuckDB SQL that several reference queries share."""

from __future__ import annotations

from ..functions import lexicon as L


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STOP = quoted(L.RANKING_STOPWORDS)


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9\\-]*'), lambda t: len(t) > 1 and not list_contains({STOP}, t))"


def content(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9\\-]*'), lambda t: len(t) > 2 and not list_contains({STOP}, t)))"


def keyword_tokens(x: str) -> str:
    clean = f"list_transform(regexp_extract_all({x}, '{L.KEYWORD}'), lambda w: trim(lower(w), '-'))"
    return f"list_filter({clean}, lambda w: len(w) >= 3 and not list_contains({quoted(L.QUERY_STOPWORDS)}, w))"


def sentences(x: str) -> str:
    """Sentence split without look-around: a mark is put between first."""
    for a in L.SPLIT_ABBREVIATIONS:
        x = f"replace({x}, '{a}', '{a.replace('.', chr(2))}')"
    marked = f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: replace(p, chr(2), '.')), lambda p: p <> '')"


PAPERS = (
    "select *, case when length(rest) >= 120 then rest end as abstract from (select *, trim(substr(text, length(title) + 2)) as rest "
    "from (select doc_id, text, lang, source, regexp_extract(text, '^[^.\\n]*') as title from documents))"
)
USERS = (
    "select conv_id || '-' || turn as query_id, case conv_id % 5 when 0 then 'https://doi.org/10.1234/CONV.' || (conv_id * 100 + turn) when 1 then 'PMID: ' || conv_id "
    "when 2 then regexp_extract(text, '^(\\S+(?: \\S+)?)', 1) else text end as raw from conversations where role = 'user'"
)
JUDGED = "select doc_id, case when quality = 1 then 3 - toxic else 0 end as grade from labels"
RECORDS = f"""
select doc_id, cast(doc_id as int) as pos, 'doc:' || doc_id as id, title, abstract, case when doc_id % 3 <> 0 then '10.1234/doc_' || doc_id end as doi,
  ['pubmed', 'arxiv', 'crossref'][doc_id % 3 + 1] as source,
  list_transform(names[1:doc_id % 25], lambda n: {{'name': concat_ws(' ', case n.k % 4 when 0 then null when 1 then 'Ann' else 'Bo C.' end, n.n),
    'given': case n.k % 4 when 0 then null when 1 then 'Ann' else 'Bo C.' end, 'family': case when n.k % 5 <> 0 then n.n end}}) as authors,
  case when doc_id % 5 <> 0 then 'Annals of DNA & ' || lang end as journal, case when doc_id % 4 <> 0 then cast(doc_id % 40 as varchar) end as volume,
  case when doc_id % 2 = 0 then cast(doc_id % 12 as varchar) end as issue, ['10-20', '7', '100--110', ' 3 - 9 '][doc_id % 4 + 1] as pages,
  ['journal-article', 'book-chapter', 'Preprint', 'report', '', 'other'][doc_id % 6 + 1] as publication_type,
  case when doc_id % 7 <> 0 then make_date(doc_id % 30 + 1990, doc_id % 12 + 1, doc_id % 28 + 1) end as published_date,
  [lang, '100%_' || p.source] as keywords, 'https://example.org/a_' || doc_id as url,
  case when doc_id % 6 = 0 then ['crossref', 'arxiv'] else [] end as also
from ({PAPERS}) p, (select list({{'k': n_nationkey, 'n': n_name}} order by n_nationkey) as names from nation)
"""
BM25 = f"""
docs as (select doc_id, {tokens('text')} as t from documents),
tf as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(t) as dl, unnest(t) as term from docs) group by all),
size as (select count(*) as n, avg(len(t)) as mean_dl from docs),
idf as (select term, any_value(mean_dl) as mean_dl, ln(any_value(n) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) as raw from tf, size group by term),
asked as (select query_id, term, count(*) as times from (select item_id as query_id, unnest({tokens('text')}) as term from benchmark) group by all),
bm25 as (select query_id, doc_id, sum(times * case when raw < 0 then 0.25::double * mean_raw else raw end * tf * 2.5::double
  / (tf + 1.5::double * (0.25::double + 0.75::double * dl / mean_dl))) as bm25
  from tf join idf using (term) join asked using (term), (select avg(raw) as mean_raw from idf) group by all)
"""


def embedding(source: str, key: str) -> str:
    """Unit vectors of signed hashed words, as rows (key, bucket, w) of a table (key, text)."""
    return f"""
select {key}, bucket, coalesce(w / nullif(sqrt(sum(w * w) over (partition by {key})), 0), 0) as w from (
  select {key}, cast(('0x' || m[7:8] || m[5:6] || m[3:4] || m[1:2]) as ubigint) % 256 as bucket,
    sum(case when cast(('0x' || m[9:10]) as ubigint) % 2 = 1 then 1 else -1 end * sqrt(tf)) as w
  from (select {key}, md5(term) as m, count(*) as tf from (
    select {key}, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: len(t) > 2)) as term from {source}) group by {key}, term)
  group by all)
"""
