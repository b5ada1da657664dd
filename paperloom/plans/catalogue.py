"""The registered queries over the reference operators, each with its DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import lexicon as L
from ..functions import text as T
from ..operators import clusters, dedupe, entities, evaluation, export, metrics, models, query, rank, store, summaries
from ..operators.query import BROADCAST_ROWS
from ..sources import drivers
from ..sources import records as R
from ..tables import sized
from . import oracle as O
from .views import judged, papers, queries, records, table, users

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- scalar text functions ---


@registered("select doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') as text_clean from documents")
def t01_collapse_ws(s, d):
    return table(s, d, "documents").select("doc_id", T.collapse_whitespace(F.col("text")).alias("text_clean"))


def _nested(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


@registered(f"select page_id, nullif(trim(regexp_replace({_nested(chr(114) + 'egexp_replace(html, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')', L.ENTITIES)}, '\\s+', ' ', 'g')), '') as text from pages")
def t02_strip_markup(s, d):
    return table(s, d, "pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


_DOI_CASES = "case doc_id % 4 when 0 then 'https://doi.org/10.1234/DOC.' || doc_id || '.' when 1 then 'doi:10.1234/Doc_' || doc_id when 2 then 'see 10.1234/DOC/' || doc_id || ');' else 'none' end"


@registered(
    f"select doc_id, lower(regexp_replace(nullif(regexp_extract(case when starts_with(lower(x), 'https://doi.org/') then substr(x, 17) when starts_with(lower(x), 'doi:') then substr(x, 5) else x end, "
    f"'{L.DOI}'), ''), '[.,;)]+$', '')) as doi from (select doc_id, {_DOI_CASES} as x from documents)"
)
def t03_normalize_doi(s, d):
    return table(s, d, "documents").select("doc_id", T.normalize_doi(F.expr(_DOI_CASES)).alias("doi"))


@registered(f"select doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) as key from ({O.PAPERS})")
def t04_normalize_title(s, d):
    return papers(s, d).select("doc_id", T.normalize_title(F.col("title")).alias("key"))


@registered("select doc_id, case when length(text) <= 100 then text else regexp_replace(text[1:100], '(?s) [^ ]*$', '') || '…' end as short from documents")
def t05_truncate(s, d):
    return table(s, d, "documents").select("doc_id", T.truncate(F.col("text"), 100).alias("short"))


@registered(f"select doc_id, concat_ws(' ', nullif(title, ''), nullif(title, ''), coalesce(nullif(abstract, ''), concat_ws(' ', lang, source))) as document_text from ({O.PAPERS})")
def t06_document_text(s, d):
    return papers(s, d).select("doc_id", T.document_text(F.col("title"), F.col("abstract"), F.array("lang"), F.col("source")).alias("document_text"))


@registered(f"select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct from (select doc_id, {O.tokens('text')} as t from documents)")
def t07_token_counts(s, d):
    t = table(s, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@registered(
    f"select bigram, count(*) as n from (select unnest([t[i] || '_' || t[i + 1] for i in range(1, len(t))]) as bigram from (select {O.tokens('text')} as t from documents)) "
    "group by bigram order by n desc, bigram limit 50"
)
def t08_bigrams_top(s, d):
    pairs = table(s, d, "documents").select(F.explode(T.pairs(T.tokens(F.col("text")))).alias("bigram"))
    return pairs.groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bigram").limit(50)


@registered(f"select doc_id, len({O.content('text')}) as n_content from documents")
def t09_content_words(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.content_words(F.col("text"))).cast("bigint").alias("n_content"))


@registered("select o_orderkey, [rtrim(translate(n, ',% ', ''), '.') for n in regexp_extract_all(x, '\\d+(?:[.,]\\d+)*\\s*%?')] as numbers from (select o_orderkey, 'rose ' || o_orderkey || ' % to 1,200.5 and ' || (o_orderkey % 97) || '.' as x from orders)")
def t10_numbers(s, d):
    x = F.concat(F.lit("rose "), F.col("o_orderkey"), F.lit(" % to 1,200.5 and "), (F.col("o_orderkey") % 97).cast("string"), F.lit("."))
    return table(s, d, "orders").select("o_orderkey", F.transform(T.numbers(x), T.normalize_number).alias("numbers"))


@registered("select doc_id, len([p for p in regexp_split_to_array(text, '[.!?](?:\\s|$)') if trim(regexp_replace(p, '\\s+', ' ', 'g')) <> '']) as n_sentences from documents")
def t11_count_sentences(s, d):
    return table(s, d, "documents").select("doc_id", T.count_sentences(F.col("text")).cast("bigint").alias("n_sentences"))


@registered(f"select doc_id, {O.sentences('text')} as sentences from documents")
def t12_split_sentences(s, d):
    return table(s, d, "documents").select("doc_id", T.split_sentences(F.col("text")).alias("sentences"))


@registered(
    "select doc_id, array_to_string(s, '|') as said from (select doc_id, list_filter(list_transform(string_split(regexp_replace(x, '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), "
    "lambda p: regexp_replace(regexp_replace(regexp_replace(p, '^((?i:background|results|abstract)(:\\s*|\\s+))', ''), '^((?i:background|results|abstract|motivation)(:\\s*))', ''), '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') as s "
    "from (select doc_id, case doc_id % 3 when 0 then 'BACKGROUND: ' when 1 then 'Abstract Motivation: ' else '' end || 'Aa bb. Cc (dd) of ' || doc_id || '.' as x from documents))"
)
def t14_section_prefix(s, d):
    x = F.concat(F.expr("case doc_id % 3 when 0 then 'BACKGROUND: ' when 1 then 'Abstract Motivation: ' else '' end"), F.lit("Aa bb. Cc (dd) of "), F.col("doc_id"), F.lit("."))
    return table(s, d, "documents").select("doc_id", F.array_join(T.abstract_sentences(x), "|").alias("said"))


@registered("select doc_id, 'a ' || doc_id || ' bold code x_y' as plain from documents")
def t15_strip_markdown(s, d):
    x = F.concat(F.lit("- a "), F.col("doc_id"), F.lit(" **bold**\n> `code`  x_y"))
    return table(s, d, "documents").select("doc_id", T.strip_markdown(x).alias("plain"))


@registered("select item_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') as rebuilt from benchmark")
def t16_inverted_index(s, d):
    words = table(s, d, "benchmark").select("item_id", F.posexplode(F.split(T.collapse_whitespace(F.col("text")), " ")).alias("at", "w"))
    lists = words.groupBy("item_id", "w").agg(F.collect_list("at").alias("at"))
    index = lists.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    return index.select("item_id", T.reconstruct_json_abstract(F.to_json("index")).alias("rebuilt"))


@registered("select page_id, left(trim(regexp_replace(url, '[^\\p{L}\\p{N}\\-_.]', '-', 'g'), '-.'), 80) as stem from pages")
def t18_safe_stem(s, d):
    return table(s, d, "pages").select("page_id", T.safe_stem(F.col("url")).alias("stem"))


@registered("select doc_id, case when doc_id % 2 = 0 then 'doi:10.1/' || doc_id else source || ':' || left(sha1(source || ':' || doc_id), 16) end as id from documents")
def t19_paper_id(s, d):
    doi = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")))
    return table(s, d, "documents").select("doc_id", T.paper_id(doi, F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@registered("select r_regionkey, array_to_string(n[1:3], ', ') || case when len(n) > 3 then ' +' || (len(n) - 3) || ' more' else '' end as said from (select n_regionkey as r_regionkey, list(n_name order by n_name) as n from nation group by 1)")
def t20_format_authors(s, d):
    names = table(s, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    return names.select("r_regionkey", T.format_authors(F.col("n")).alias("said"))


@registered("select o_orderkey, case when o_orderkey % 9 = 0 then 'no date' else strftime(o_orderdate, '%b %Y') end as said from orders")
def t21_format_date(s, d):
    return table(s, d, "orders").select("o_orderkey", T.format_date(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))).alias("said"))


# --- sources ---


@registered("select * from (values ('pubmed', 0, 0.4::double), ('crossref', 2, 0.05::double)) t(source, ord, interval)")
def s07_select_sources(s, d):
    from ..sources import registry

    return registry.select(registry.sources(s), ["crossref", "pubmed", "unknown"]).select("source", "ord", "interval")


@registered("select event_id, least(pow(2, event_id % 5), 4)::double as wait, least(greatest(try_cast(case event_id % 4 when 0 then '-3' when 1 then '7.5' when 2 then '99' else 'soon' end as double), 0), 10) as retry_after from events")
def s04_backoff(s, d):
    header = F.expr("case event_id % 4 when 0 then '-3' when 1 then '7.5' when 2 then '99' else 'soon' end")
    return table(s, d, "events").select("event_id", query.backoff(F.col("event_id") % 5 + 1).alias("wait"), query.retry_after(header).alias("retry_after"))


@registered(
    "select event_id, cast(round(max(ms - n * 3000.0) over (partition by event_type order by n rows unbounded preceding) + n * 3000.0) as bigint) as start_ms from "
    "(select event_id, event_type, ms, row_number() over (partition by event_type order by ms, event_id) as n from (select event_id, event_type, (epoch_us(ts) // 100000)::double as ms from events))"
)
def s06_rate_limit(s, d):
    # Times are divided by a hundred, so that requests come thick enough to be delayed.
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 100000").cast("double")
    e = table(s, d, "events").select("event_id", F.col("event_id").alias("id"), F.col("event_type").alias("source"), ms.alias("ts"))
    return query.rate_limited_starts(e, 3000.0).select("event_id", F.round("start_at").cast("bigint").alias("start_ms"))


@registered("select item_id, array_to_string([ 'all:\"' || t || '\"' for t in regexp_split_to_array(trim(text), '\\s+')[1:12]], ' AND ') as q from benchmark")
def s09_field_query(s, d):
    return table(s, d, "benchmark").select("item_id", query.field_query(F.col("text")).alias("q"))


@registered("select doc_id, '21' || lpad(cast(doc_id % 100 as varchar), 2, '0') || '.' || lpad(doc_id::varchar, 5, '0') as arxiv_id, make_date(2000 + doc_id % 20, doc_id % 12 + 1, doc_id % 28 + 1) as day from documents")
def s13_arxiv_id(s, d):
    local = F.concat(F.lit("21"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("."), F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    day = F.make_date((F.col("doc_id") % 20 + 2000).cast("int"), (F.col("doc_id") % 12 + 1).cast("int"), (F.col("doc_id") % 28 + 1).cast("int"))
    stamp = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T01:02:03Z"))
    return table(s, d, "documents").select("doc_id", R.arxiv_id(F.concat(F.lit("http://arxiv.org/abs/"), local, F.lit("v3"))).alias("arxiv_id"), R.timestamp_date(stamp).alias("day"))


@registered(f"with k as (select item_id, {O.keyword_tokens('text')} as t from benchmark) select item_id, case when len(t) > 0 then array_to_string(t[1:8], ' AND ') else '' end as strict, case when len(t) >= 2 then array_to_string(t[1:5], ' OR ') end as relaxed from k")
def s19_terms(s, d):
    k = table(s, d, "benchmark").withColumn("k", query.keyword_tokens(F.col("text")))
    return k.select("item_id", query.strict_term(F.col("k"), F.lit("")).alias("strict"), query.relaxed_term(F.col("k")).alias("relaxed"))


@registered("select o_orderkey as query_id, cast(i as int) as pos, cast(o_orderkey * 10 + i as varchar) as pmid from orders, (values (0), (2)) t(i) where o_orderkey % 5 <> 0")
def s21_esearch(s, d):
    key = F.col("o_orderkey")
    ok = F.concat(F.lit('{"esearchresult":{"idlist":["'), key * 10, F.lit('"," ","'), key * 10 + 2, F.lit('"]}}'))
    payload = F.when(key % 5 == 0, F.lit('{"esearchresult":{"ERROR":"bad"}}')).otherwise(ok)
    return R.esearch_ids(table(s, d, "orders").select(key.alias("query_id"), payload.alias("payload")))


_MONTH_CASE = "case o_orderkey % 5 when 0 then strftime(o_orderdate, '%b') when 1 then 'Summer' when 2 then cast(month(o_orderdate) as varchar) when 3 then null else '17' end"


@registered(
    "select o_orderkey, make_date(year(o_orderdate), case o_orderkey % 5 when 0 then month(o_orderdate) when 1 then 7 when 2 then month(o_orderdate) when 3 then 1 else 12 end, least(day(o_orderdate), 28)) as day, "
    "case o_orderkey % 3 when 0 then make_date(year(o_orderdate), 1, 1) when 1 then make_date(year(o_orderdate), month(o_orderdate), 1) else make_date(2001, 2, 3) end as issued from orders"
)
def s31_dates(s, d):
    o = F.col("o_orderdate")
    month = F.expr("case o_orderkey % 5 when 0 then date_format(o_orderdate, 'MMM') when 1 then 'Summer' when 2 then cast(month(o_orderdate) as string) when 3 then null else '17' end")
    year, m = F.year(o).cast("string"), F.month(o).cast("string")
    parts = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.array(year, F.lit(None).cast("string")))).when(F.col("o_orderkey") % 3 == 1, F.array(F.array(year, m))).otherwise(F.array(F.array(F.lit(None).cast("string"))))
    other = F.array(F.array(F.lit("2001"), F.lit("2"), F.lit("3")))
    return table(s, d, "orders").select("o_orderkey", T.date_from_parts(year, month, F.dayofmonth(o).cast("string")).alias("day"), R.issued(parts, other).alias("issued"))


@registered("select c_custkey, regexp_replace(x, '^(.*) ([^ ]+)$', '\\1') as given, regexp_extract(x, '([^ ]+)$', 1) as family from (select c_custkey, c_mktsegment || ' ' || c_name as x from customer)")
def s45_names(s, d):
    a = T.author_from_display(F.concat("c_mktsegment", F.lit("  "), "c_name"))
    return table(s, d, "customer").select("c_custkey", a["given"].alias("given"), a["family"].alias("family"))


@registered(f"select p_partkey from part where p_type is not null and not list_contains({O.quoted(['PROMO', 'ECONOMY'])}, split_part(p_type, ' ', 1))")
def s35_type_deny_list(s, d):
    first = F.split_part("p_type", F.lit(" "), F.lit(1))
    kind = F.when(first == "PROMO", L.EXCLUDED_TYPES[0]).when(first == "ECONOMY", L.EXCLUDED_TYPES[-1]).otherwise(L.ALLOWED_TYPES[0])
    return table(s, d, "part").where("p_type is not null").where(R.kept_type(kind)).select("p_partkey")


def _answers(found):
    """A fetch that answers from the request's url, as a source would: found maps the url column to a payload column."""
    return lambda asked: asked.select("query_id", F.when(F.col("query_id") % 7 == 3, "timeout").otherwise("ok").alias("status"), F.when(F.col("query_id") % 7 != 3, found(F.url_decode("url"))).alias("payload"))


def _asked(s, d):
    return query.parse(queries(s, d)).select("query_id", "raw", "search_terms", "keywords")


def _reported(papers, reports, what):
    found = papers.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", what))), lambda x: x[what]), ",").alias("found"))
    return reports.join(found, "query_id", "left")


@registered("select item_id as query_id, 'arxiv' as source, case when item_id % 7 = 3 then 'timeout' when item_id % 3 = 2 then 'parse_error' else 'ok' end as status, cast(case when item_id % 7 = 3 or item_id % 3 = 2 then 0 else 1 end as int) as returned, case when item_id % 7 = 3 or item_id % 3 = 2 then null when item_id % 3 = 0 then 'all of them' else 'any of them' end as found from benchmark")
def s08_arxiv_search(s, d):
    feed = lambda title, id: F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/'), F.lit(id), F.lit("</id><title>"), F.lit(title), F.lit("</title></entry></feed>"))
    any_of = lambda url: F.contains(url, F.lit(" OR all:"))
    none = F.lit('<feed xmlns="http://www.w3.org/2005/Atom"></feed>')
    found = lambda url: F.when(F.col("query_id") % 3 == 2, feed("Error", "api/errors#x")).when(any_of(url), feed("any of them", "abs/2301.00007")).when(F.col("query_id") % 3 == 0, feed("all of them", "abs/2301.00008")).otherwise(none)
    return _reported(*drivers.arxiv(_asked(s, d), _answers(found)), "title")


@registered("select item_id as query_id, 'pubmed' as source, case when item_id % 7 = 3 then 'timeout' when item_id % 4 = 1 then 'empty' else 'ok' end as status, cast(case when item_id % 7 = 3 or item_id % 4 = 1 then 0 else 2 end as int) as returned, case when item_id % 7 = 3 or item_id % 4 = 1 then null when item_id % 4 = 0 then '21,20' else '31,30' end as found from benchmark")
def s18_pubmed_search(s, d):
    ids = lambda *x: F.lit('{"esearchresult":{"idlist":[' + ",".join(f'"{i}"' for i in x) + "]}}")
    one = lambda n: f"<PubmedArticle><MedlineCitation><PMID>{n}</PMID><Article><ArticleTitle>T{n}</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    records_of = lambda *x: F.lit("<PubmedArticleSet>" + "".join(map(one, sorted(x))) + "</PubmedArticleSet>")
    fetched = lambda url: F.when(F.contains(url, F.lit("id=21,20")), records_of(21, 20)).otherwise(records_of(31, 30))
    searched = lambda url: F.when(F.col("query_id") % 4 == 1, ids()).when((F.col("query_id") % 4 == 0) & F.contains(url, F.lit(" AND ")), ids(21, 20)).when(F.contains(url, F.lit(" OR ")), ids(31, 30)).otherwise(ids())
    found = lambda url: F.when(F.contains(url, F.lit("efetch")), fetched(url)).otherwise(searched(url))
    return _reported(*drivers.pubmed(_asked(s, d), _answers(found)), "source_id")


@registered("select item_id as query_id, 'crossref' as source, case when item_id % 7 = 3 then 'timeout' when item_id % 3 = 0 then 'parse_error' when item_id % 3 = 1 then 'empty' else 'ok' end as status, cast(case when item_id % 7 <> 3 and item_id % 3 = 2 then 2 else 0 end as int) as returned, case when item_id % 7 <> 3 and item_id % 3 = 2 then '10.1000/a,10.1000/c' end as found from benchmark")
def s33_crossref_search(s, d):
    works = lambda *x: '{"message":{"items":[' + ",".join(f'{{"DOI":"10.1000/{i}","title":["T"],"type":"{t}"}}' for i, t in x) + "]}}"
    kept, denied = works(("A", L.ALLOWED_TYPES[0]), ("b", L.EXCLUDED_TYPES[0]), ("C", L.ALLOWED_TYPES[-1])), works(("d", L.EXCLUDED_TYPES[1]))
    whole = lambda url: F.contains(url, F.lit("filter=" + ",".join(f"type:{t}" for t in L.ALLOWED_TYPES)))
    found = lambda url: F.when(F.col("query_id") % 3 == 0, "oops").when((F.col("query_id") % 3 == 1) | ~whole(url), denied).otherwise(kept)
    return _reported(*drivers.crossref(_asked(s, d), _answers(found)), "doi")


@registered("select r_regionkey, 'B ' || r_regionkey as first from region")
def s38_first_string(s, d):
    xs = F.array(F.lit("<i> </i>"), F.concat(F.lit("<b>B</b> "), F.col("r_regionkey").cast("string")), F.lit("c"))
    return table(s, d, "region").select("r_regionkey", R.first_string(xs).alias("first"))


@registered("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def s46_upsert_latest(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return store.latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


# --- query interpretation and retrieval ---


@registered(
    f"select query_id, case when regexp_matches(raw, '^https://doi.org/') or regexp_matches(raw, '^PMID: \\d+$') then 'identifier' when len(regexp_split_to_array(raw, '\\s+')) > 25 then 'abstract_snippet' "
    f"when len(regexp_split_to_array(raw, '\\s+')) <= 2 then 'keyword' else 'topic' end as intent, case when regexp_matches(raw, '^https://doi.org/') then lower(substr(raw, 17)) when regexp_matches(raw, '^PMID: \\d+$') then substr(raw, 7) end as identifier "
    f"from (select query_id, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as raw from ({O.USERS})) where raw <> ''"
)
def q01_parse_intent(s, d):
    return query.parse(users(s, d)).select("query_id", "intent", "identifier")


_KEYWORDS = f"select item_id as query_id, keyword, row_number() over (partition by item_id order by count(*) desc, min(place)) as kw_rank from (select item_id, unnest(t) as keyword, unnest(range(len(t))) as place from (select item_id, {O.keyword_tokens('text')} as t from benchmark)) group by item_id, keyword"


@registered(f"select query_id, cast(kw_rank as int) as kw_rank, keyword from ({_KEYWORDS}) where kw_rank <= 10")
def q03_keywords(s, d):
    return query.keywords(queries(s, d))


_POST = f"post as (select distinct doc_id, source, unnest({O.keyword_tokens('text')}) as keyword from documents), asked as (select * from ({_KEYWORDS}) where kw_rank <= 8), wanted as (select query_id, count(*) as wanted from asked group by 1), met as (select query_id, source, doc_id, count(*) as hits, count(*) filter (kw_rank <= 5) as any_hits from post join asked using (keyword) group by all), every as (select query_id, source, doc_id, hits from met join wanted using (query_id) where hits = wanted), found as (select query_id, source, doc_id, hits, 'and' as mode from every union all select m.query_id, m.source, m.doc_id, m.any_hits, 'or' from met m join wanted using (query_id) where any_hits > 0 and wanted >= 2 and not exists (select 1 from every e where e.query_id = m.query_id and e.source = m.source))"


@registered(f"with {_POST} select * from found")
def q07_retrieve(s, d):
    return query.retrieve(query.keywords(queries(s, d)), table(s, d, "documents"))


_TOP = f"{_POST}, top as (select *, row_number() over (partition by query_id, source order by hits desc, doc_id) as pos from found qualify pos <= 20)"


@registered(f"with {_TOP} select query_id, source, doc_id, cast(pos as int) as pos, cast(row_number() over (partition by query_id order by pos, source) as int) as merged_pos from top")
def q12_interleave(s, d):
    found = query.retrieve(query.keywords(queries(s, d)), table(s, d, "documents"))
    return query.interleave(query.limit_per_source(found, DEFAULTS.limit_per_source), F.col("source")).select("query_id", "source", "doc_id", "pos", "merged_pos")


@registered(
    "with p as (select query_id, case when regexp_matches(raw, '^https://doi') then 'doi' when regexp_matches(raw, '^PMID: \\d+$') then 'pmid' else 'none' end as kind from (" + O.USERS + ")) "
    "select query_id, source, case when kind = 'none' then 'search' when kind = 'doi' then 'by_doi' when source = 'pubmed' then 'by_pmid' else 'skipped' end as action from p, (values ('pubmed'), ('arxiv'), ('crossref')) t(source)"
)
def q09_dispatch(s, d):
    from ..sources import registry

    return query.dispatch(query.parse(users(s, d)), registry.sources(s)).select("query_id", "source", "action")


@registered(f"with {_TOP} select item_id as query_id, a.source, case when count(pos) > 0 then 'ok' else 'empty' end as status, cast(count(pos) as int) as returned from (select item_id, source from benchmark, (select distinct source from documents)) a left join top t on t.query_id = item_id and t.source = a.source group by all")
def q11_source_reports(s, d):
    found = query.limit_per_source(query.retrieve(query.keywords(queries(s, d)), table(s, d, "documents")), DEFAULTS.limit_per_source)
    asked = queries(s, d).select("query_id").crossJoin(sized(table(s, d, "documents").select("source").distinct(), BROADCAST_ROWS))
    return query.source_reports(asked, found)


_STATUS = "case event_type when 'error' then 'timeout' when 'click' then 'empty' else 'ok' end"


@registered(f"select user_id as query_id, bool_or(event_type = 'error') as degraded, string_agg(event_id || '=' || {_STATUS} || '(' || event_id % 7 || ')', ', ' order by event_id::varchar) as line from events group by 1")
def q14_report_lines(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").cast("string").alias("source"), F.expr(_STATUS).alias("status"), (F.col("event_id") % 7).alias("returned"))
    return query.degraded(e).join(query.summary_line(e), "query_id")


# --- entity resolution ---


@registered("select min(doc_id) as kept_doc_id, count(*) as n from documents group by nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')")
def j01_dedupe_exact(s, d):
    return table(s, d, "documents").groupBy(T.collapse_whitespace(F.col("text")).alias("k")).agg(F.min("doc_id").alias("kept_doc_id"), F.count(F.lit(1)).alias("n")).drop("k")


@registered()
def j03_fuzzy_pairs(s, d):
    p = papers(s, d).select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), "title")
    return dedupe.fuzzy_pairs(p).select("left_id", "right_id")


@registered("with k as (select doc_id, case when doc_id % 3 <> 0 then '10.1101/a' || doc_id % 50 end as a, '10.9/b' || doc_id % 7 as b, lang as x, 'en' as y from documents) select doc_id, coalesce(starts_with(a, '10.1101') and x = y and x <> '', false) as pair from k")
def j06_preprint_pair(s, d):
    a = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("10.1101/a"), (F.col("doc_id") % 50).cast("string")))
    b = F.concat(F.lit("10.9/b"), (F.col("doc_id") % 7).cast("string"))
    return table(s, d, "documents").select("doc_id", F.coalesce(dedupe.preprint_pair(a, b, F.col("lang"), F.lit("en")), F.lit(False)).alias("pair"))


def _candidates(s, d):
    found = query.limit_per_source(query.retrieve(query.keywords(queries(s, d)), table(s, d, "documents")), DEFAULTS.limit_per_source)
    order = query.interleave(found, F.col("source")).select("query_id", "doc_id", F.col("merged_pos").alias("pos"))
    return order.join(papers(s, d), "doc_id")


@registered()
def j07_dedupe_parity(s, d):
    p = _candidates(s, d).select("query_id", F.col("doc_id").alias("id"), "pos", F.lit(None).cast("string").alias("doi"), "title")
    return dedupe.greedy_clusters(p)


@registered(
    "select c_nationkey as nation, arg_min(c_name, {'a': -c_acctbal, 'k': c_custkey}) as c_name, arg_min(seg, {'a': -c_acctbal, 'k': c_custkey}) filter (seg is not null) as seg, count(*) as n_merged "
    "from (select *, case when c_custkey % 3 = 0 then c_mktsegment end as seg from customer) group by 1"
)
def j09_fieldwise_merge(s, d):
    c = table(s, d, "customer").withColumn("seg", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")))
    return dedupe.merge(c, ["c_nationkey"], ["c_name", "seg"], [], [-F.col("c_acctbal"), F.col("c_custkey")]).withColumnRenamed("c_nationkey", "nation")


@registered("select s_nationkey as query_id, count(*) - count(distinct cast(floor(s_acctbal / 1000) as bigint)) as duplicates_merged from supplier group by 1")
def j11_duplicates_merged(s, d):
    return dedupe.duplicates_merged(table(s, d, "supplier").select(F.col("s_nationkey").alias("query_id"), F.floor(F.col("s_acctbal") / 1000).alias("cluster")))


@registered(f"select p.doc_id, case when abstract is not null then 'own' when length(b.text) >= 120 then 'found' else 'missing' end as abstract_src from ({O.PAPERS}) p left join benchmark b on b.item_id = p.doc_id % 400")
def j13_backfill(s, d):
    from ..operators import backfill

    p = papers(s, d).withColumn("doi", F.concat(F.lit("10.1/"), (F.col("doc_id") % 400).cast("string"))).withColumn("own", F.col("abstract").isNotNull())
    found = table(s, d, "benchmark").select(F.concat(F.lit("10.1/"), F.col("item_id").cast("string")).alias("doi"), F.col("text").alias("abstract"))
    filled = backfill.fill(p, found)
    return filled.select("doc_id", F.when(F.col("own"), "own").when(F.col("abstract").isNotNull(), "found").otherwise("missing").alias("abstract_src"))


_ASKED = "select l_orderkey as export_id, l_linenumber as pos, l_partkey * 2 as id from lineitem"


@registered(f"select export_id, pos, id, p_name from ({_ASKED}) join part on p_partkey = id")
def j14_ordered_fetch(s, d):
    asked = table(s, d, "lineitem").select(F.col("l_orderkey").alias("export_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") * 2).alias("id"))
    return store.ordered_fetch(asked, table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name")).select("export_id", "pos", "id", "p_name")


@registered(f"select export_id, count(*) as missing from ({_ASKED}) where id not in (select p_partkey from part) group by 1")
def j15_missing_ids(s, d):
    asked = table(s, d, "lineitem").select(F.col("l_orderkey").alias("export_id"), (F.col("l_partkey") * 2).alias("id"))
    return store.missing_ids(asked, table(s, d, "part").select(F.col("p_partkey").alias("id"))).groupBy("export_id").agg(F.count(F.lit(1)).alias("missing"))


# --- ranking ---


@registered(f"with {O.BM25} select query_id, doc_id, round(bm25, 6) as bm25 from bm25")
def r02_bm25(s, d):
    return rank.bm25(queries(s, d), table(s, d, "documents")).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


@registered(f"select doc_id, cast(bucket as bigint) as bucket, round(w, 6) as w from ({O.embedding('documents', 'doc_id')})")
def r03_hash_embed(s, d):
    return rank.hash_embedding(table(s, d, "documents"), ["doc_id"]).select("doc_id", "bucket", F.round("w", 6).alias("w"))


@registered(f"with e as ({O.embedding('documents', 'doc_id')}), q as ({O.embedding('benchmark', 'item_id')}) select item_id as query_id, doc_id, round(sum(q.w * e.w), 6) as semantic from q join e using (bucket) group by all")
def r08_semantic_hash(s, d):
    q = rank.hash_embedding(queries(s, d), ["query_id"])
    return rank.sparse_cosine(q, rank.hash_embedding(table(s, d, "documents"), ["doc_id"])).withColumn("semantic", F.round("semantic", 6))


@registered("select label, vec_id, round(list_dot_product([x::double for x in embedding], [x::double for x in e]), 6) + 0 as semantic from embeddings join (select label, arg_min(embedding, vec_id) as e from embeddings group by 1) using (label)")
def r08_semantic_vec(s, d):
    v = table(s, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    return v.join(sized(first, BROADCAST_ROWS), "label").select("label", "vec_id", (F.round(rank.dot(F.col("embedding"), F.col("e")), 6) + 0).alias("semantic"))


@registered(
    "select s_suppkey, round(case when hi - lo < 1e-9 then case when hi <= 0 then 0 else 1 end else (s_acctbal - lo) / (hi - lo) end, 6) as scaled from "
    "(select s_suppkey, s_acctbal, min(s_acctbal) over w as lo, max(s_acctbal) over w as hi from supplier window w as (partition by s_nationkey))"
)
def r09_minmax(s, d):
    return table(s, d, "supplier").select("s_suppkey", F.round(rank.min_max("s_acctbal", "s_nationkey"), 6).alias("scaled"))


@registered("select c_custkey, round(1.0::double / (60 + row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey)) + 1.0::double / (60 + row_number() over (partition by c_nationkey order by c_name desc, c_custkey)), 9) as rrf from customer")
def r10_rrf(s, d):
    return table(s, d, "customer").select("c_custkey", F.round(rank.reciprocal_ranks(["c_acctbal", "c_name"], group="c_nationkey", tie="c_custkey"), 9).alias("rrf"))


def _scored(s, d):
    """All documents that share a term or bucket with a query, with both scores and the length for the prior."""
    docs = table(s, d, "documents")
    lexical = rank.bm25(queries(s, d), docs).withColumnRenamed("bm25", "lexical")
    semantic = rank.sparse_cosine(rank.hash_embedding(queries(s, d), ["query_id"]), rank.hash_embedding(docs, ["doc_id"]))
    both = semantic.join(lexical, ["query_id", "doc_id"], "full").withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in ("lexical", "semantic")})
    return both.join(docs.select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens")), "doc_id").withColumn("pos", F.col("doc_id"))


_SCORED = f"""{O.BM25}, e as ({O.embedding('documents', 'doc_id')}), q as ({O.embedding('benchmark', 'item_id')}),
sem as (select item_id as query_id, doc_id, sum(q.w * e.w) as semantic from q join e using (bucket) group by all),
scored as (select query_id, doc_id, round(coalesce(bm25, 0), 6) as lexical, round(coalesce(semantic, 0), 6) as semantic from sem full join bm25 using (query_id, doc_id)),
scaled as (select query_id, doc_id, len(t) as n_tokens, lexical, semantic,
  case when lmax - lmin < 1e-9 then case when lmax <= 0 then 0.0::double else 1.0::double end else (lexical - lmin) / (lmax - lmin) end as l,
  case when smax - smin < 1e-9 then case when smax <= 0 then 0.0::double else 1.0::double end else (semantic - smin) / (smax - smin) end as s
  from (select *, min(lexical) over w as lmin, max(lexical) over w as lmax, min(semantic) over w as smin, max(semantic) over w as smax from scored window w as (partition by query_id)) join docs using (doc_id)),
rr as (select *, 1.0::double / (60 + row_number() over (partition by query_id order by semantic desc, doc_id)) + 1.0::double / (60 + row_number() over (partition by query_id order by lexical desc, doc_id)) as r from scaled),
fused as (select query_id, doc_id, n_tokens / (n_tokens + 3.0::double) as prior, l, s, (r - min(r) over w) / nullif(max(r) over w - min(r) over w, 0) as r from rr window w as (partition by query_id))
"""
_LINEAR = "round(least(greatest((0.6::double * s + (1 - 0.6::double) * l) * prior, 0), 1), 6)"


@registered(f"with {_SCORED} select query_id, doc_id, {_LINEAR} as combined, cast(row_number() over (partition by query_id order by {_LINEAR} desc, doc_id) as int) as rank from fused qualify rank <= 20")
def rank_hybrid_linear(s, d):
    return rank.rank(_scored(s, d)).where("rank <= 20").select("query_id", "doc_id", "combined", "rank")


_STRATEGIES = {"retrieval": "1.0::double / (doc_id + 1)", "unweighted": "0.6::double * s + (1 - 0.6::double) * l", "semantic": "s * prior", "lexical": "l * prior", "linear": "(0.6::double * s + (1 - 0.6::double) * l) * prior", "rrf": "coalesce(r, 1) * prior"}
_RANKED = "ranked as (" + " union all ".join(
    f"select '{name}' as strategy, query_id, doc_id, row_number() over (partition by query_id order by round(least(greatest({value}, 0), 1), 6) desc, doc_id) as rank from fused" for name, value in _STRATEGIES.items()
) + ")"
_METRICS = f"""judged as ({O.JUDGED}), ks as (select unnest([5, 10, 20]) as k),
graded as (select strategy, query_id, doc_id, rank, coalesce(grade, 0) as grade from ranked left join judged using (doc_id)),
ideal as (select k, sum((pow(2, grade) - 1) / log2(place + 1)) as idcg from (select grade, row_number() over (order by grade desc, doc_id) as place from judged), ks where place <= k group by 1),
rel as (select count(*) filter (grade >= 2) as n_relevant from judged),
per as (select strategy, query_id, k, count(*) filter (rank <= k and grade >= 2) as hits, sum(case when rank <= k then (pow(2, grade) - 1) / log2(rank + 1) else 0 end) as dcg,
  coalesce(1.0::double / min(rank) filter (grade >= 2), 0) as mrr, count(*) as n_retrieved from graded, ks group by all),
metrics as (select strategy, query_id, k, hits / n_relevant::double as recall, least(k, n_relevant) / n_relevant::double as ceiling, (hits / n_relevant::double) / (least(k, n_relevant) / n_relevant::double) as attainment,
  hits / k::double as precision, dcg / idcg as ndcg, mrr, n_relevant, n_retrieved from per join ideal using (k), rel)"""


def _evaluated(s, d, strategies):
    return evaluation.evaluate(queries(s, d), table(s, d, "documents"), judged(s, d), strategies)


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


@registered(f"with {_SCORED}, {_RANKED}, {_METRICS} select query_id, cast(k as int) as k, round(recall, 6) as recall, round(ceiling, 6) as ceiling, round(attainment, 6) as attainment, round(precision, 6) as precision, round(ndcg, 6) as ndcg, round(mrr, 6) as mrr, n_relevant, n_retrieved from metrics where strategy = 'linear'")
def a01_metrics(s, d):
    return _rounded(_evaluated(s, d, ["linear"]).drop("strategy"))


@registered(f"with {_SCORED}, {_RANKED}, {_METRICS} select strategy, cast(k as int) as k, round(avg(recall), 6) as recall, round(avg(ceiling), 6) as ceiling, round(avg(attainment), 6) as attainment, round(avg(precision), 6) as precision, round(avg(ndcg), 6) as ndcg, round(avg(mrr), 6) as mrr, cast(sum(n_relevant) as bigint) as n_relevant, cast(sum(n_retrieved) as bigint) as n_retrieved from metrics group by strategy, k")
def a10_strategies(s, d):
    return _rounded(metrics.macro(_evaluated(s, d, list(_STRATEGIES)), ["strategy"]))


@registered("select event_type, count(*) as n from events group by 1 order by n desc, 1")
def a13_histogram(s, d):
    return metrics.histogram(table(s, d, "events"), "event_type")


@registered("select l_returnflag as label, count(*) as total, count(*) filter (l_discount > 0.05) as caught, count(*) filter (l_discount > 0.05) / count(*) as rate from lineitem group by 1")
def a14_confusion(s, d):
    return metrics.confusion(table(s, d, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_discount") > 0.05).alias("caught")))


@registered("select event_type, threshold, count(value) as n, round(avg((value < threshold)::int), 9) as rate from events, (select unnest([10.0::double, 50.0::double, 90.0::double]) as threshold) group by all")
def a15_threshold_sweep(s, d):
    return metrics.sweep(table(s, d, "events"), "value", [10.0, 50.0, 90.0], ["event_type"]).withColumn("rate", F.round("rate", 9))


@registered(f"select count(*) as n, count(*) filter (abstract is null) as missing, round(count(*) filter (abstract is null) / count(*), 9) as share from ({O.PAPERS})")
def a16_missing_profile(s, d):
    return metrics.missing_profile(papers(s, d), "abstract")


@registered()
def a17_paired_bootstrap(s, d):
    m = _evaluated(s, d, ["linear", "lexical"]).where("k = 10").groupBy("query_id").pivot("strategy", ["linear", "lexical"]).agg(F.first("ndcg"))
    return metrics.paired_bootstrap(m.select("query_id", F.col("linear").alias("a"), F.col("lexical").alias("b")))


# --- entities and clusters ---

_ACRONYMS = O.quoted(sorted(set(L.SECTION_LABELS) | set(L.ACRONYM_STOPWORDS)))
_PLAIN = "regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')"


@registered(f"select doc_id, surface, count(*) as n from (select doc_id, unnest(list_filter(regexp_extract_all({_PLAIN}, '{L.ACRONYM}'), lambda s: not list_contains({_ACRONYMS}, s))) as surface from documents) group by all")
def e02_acronyms(s, d):
    # RE2's word border knows ASCII alone, so both sides read other signs as blanks.
    x = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    return table(s, d, "documents").select("doc_id", F.explode(entities.surfaces(x)).alias("surface")).groupBy("doc_id", "surface").agg(F.count(F.lit(1)).alias("n"))


@registered()
def e04_pattern_entities(s, d):
    found = entities.occurrences(papers(s, d).select(F.col("doc_id").alias("id"), "title", "abstract"))
    return entities.merge_occurrences(found).select("id", "pos", "text", "label", "count", "in_title")


@registered("select c_custkey, c_mktsegment <> 'MACHINERY' and (not c_mktsegment = 'BUILDING' or c_custkey % 2 = 0) and c_custkey % 3 <> 0 as trusted from customer")
def e06_trust_guard(s, d):
    raw = F.when(F.col("c_mktsegment") == "MACHINERY", "GPE").when(F.col("c_mktsegment") == "BUILDING", "ORG").otherwise("PERSON")
    name = F.when(F.col("c_mktsegment") == "BUILDING", F.when(F.col("c_custkey") % 2 == 0, "northinstitute").otherwise("northern")).otherwise(F.lit("some person"))
    field = F.when(F.col("c_custkey") % 3 == 0, "title").otherwise("abstract")
    return table(s, d, "customer").select("c_custkey", entities.trusted(raw, name, field).alias("trusted"))


@registered(
    "with o as (select l_orderkey as id, lower(l_returnflag) as key, l_returnflag as text, l_linenumber as n, l_partkey as st from lineitem), "
    "c as (select id, key, count(distinct st) as count, min({'n': n, 's': st}) as first from o group by all) select id, cast(row_number() over (partition by id order by count desc, first, key) as int) as pos, upper(key) as text, cast(count as int) as count from c"
)
def e07_merge_occurrences(s, d):
    o = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.lit(0).alias("i"), F.lit("abstract").alias("field"), F.col("l_returnflag").alias("text"),
        F.lit("technical_term").alias("label"), F.lit("PATTERN").alias("raw_label"), F.col("l_partkey").alias("start"), F.col("l_partkey").alias("end"),
    )
    return entities.merge_occurrences(o).select("id", "pos", "text", "count")


@registered()
def e11_highlight(s, d):
    p = table(s, d, "documents").select("doc_id", "text", entities.entity_spans("text").alias("spans"))
    parts = entities.highlight(F.col("text"), F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return p.select("doc_id", parts.alias("parts")).select("doc_id", F.size("parts").alias("n_parts"), F.size(F.filter("parts", lambda x: x["marked"])).alias("n_marked"))


@registered()
def c01_clusters(s, d):
    # Documents share a query's candidates; their hashed vectors are made dense, 256 numbers each.
    c = _candidates(s, d).select("query_id", "pos", "doc_id", F.concat_ws(" ", "title", "title", "abstract").alias("text"))
    once = c.select("doc_id", "text").dropDuplicates(["doc_id"])
    w = rank.hash_embedding(once, ["doc_id"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "w"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DEFAULTS.hashing_dim - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
    return clusters.cluster(c.join(w.select("doc_id", dense.alias("vector")), "doc_id").select("query_id", "pos", "doc_id", "vector"))


@registered(
    "with u as (select vec_id, label, [x::double for x in embedding] as e from embeddings), n as (select vec_id, label, [x / sqrt(list_dot_product(e, e)) for x in e] as e from u), "
    "d as (select a.vec_id, a.label, b.label as other, sum(case when a.vec_id <> b.vec_id then 1 - list_dot_product(a.e, b.e) else 0 end) as s, count(*) as n from n a, n b group by all), "
    "r as (select vec_id, label, max(s / nullif(n - 1, 0)) filter (label = other) as a, min(s / n) filter (label <> other) as b from d group by all) "
    "select label, count(*) as n, round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from r group by 1"
)
def c03_silhouette(s, d):
    return clusters.label_silhouette(table(s, d, "embeddings")).withColumn("silhouette", F.round("silhouette", 6))


@registered("select l_orderkey as query_id, min(n) >= 3 and max(n) / sum(n) <= 0.8 as usable from (select l_orderkey, l_returnflag, count(*) as n from lineitem group by all) group by 1")
def c04_usable(s, d):
    sizes = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))
    return clusters.usable(sizes)


@registered(
    f"with w as (select lang as grp, unnest({O.tokens('text')}) as term from documents), c as (select grp, term, count(*) as n from w group by all), z as (select grp, sum(n) as size from c group by 1), "
    "u as (select term, sum(n) as uses, count(*) as within from c group by 1), g as (select count(distinct lang) as groups from documents), "
    "f as (select grp, term, round(n / size * ln(1 + groups / within) * n / uses, 9) as score from c join z using (grp) join u using (term), g where length(term) >= 3 and not regexp_matches(term, '^[0-9]+$')) "
    "select 0 as query_id, grp, cast(row_number() over (partition by grp order by score desc, term) as int) as rk, term, score from f qualify rk <= 4"
)
def c05_ctfidf(s, d):
    return clusters.class_terms(table(s, d, "documents").select(F.lit(0).alias("query_id"), F.col("lang").alias("grp"), "text"))


@registered("select n_regionkey as cluster_id, array_to_string((list(n_name order by n_name))[1:3], ' · ') as label from nation group by 1")
def c07_label(s, d):
    terms = table(s, d, "nation").groupBy(F.col("n_regionkey").alias("cluster_id")).agg(F.array_sort(F.collect_list("n_name")).alias("t"))
    return terms.select("cluster_id", clusters.label(F.col("t")).alias("label"))


# --- summaries ---

_S = O.sentences("text").replace("replace(", "replace(", 1)


@registered(
    f"with p as ({O.PAPERS}), x as (select doc_id, title, abstract, list_filter(string_split(regexp_replace(regexp_replace(coalesce(abstract, ''), '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda q: q <> '') as s from p), "
    f"e as (select doc_id, {O.content('title')} as tw, len(s) as n, unnest(s) as sentence, unnest(range(len(s))) as i from x where len(s) > 3), "
    f"f as (select *, {O.content('sentence')} as w from e), "
    f"g as (select *, round(len(list_intersect(w, tw)) / greatest(len(tw), 1) + case when len([m for m in {O.quoted(L.FINDING_MARKERS)} if contains(lower(sentence), m)]) > 0 then 1 else 0 end + case when i = 0 then 0.5 when i >= n - 2 then 0.3 else 0 end, 9) as score from f where len(w) > 0), "
    "h as (select doc_id, sentence, i from g qualify row_number() over (partition by doc_id order by score desc, i desc) <= 3), "
    "t as (select doc_id, string_agg(sentence, ' ' order by i) as chosen from h group by 1) "
    "select doc_id, case when coalesce(trim(abstract), '') = '' then trim(title) when len(s) = 0 then trim(abstract) else coalesce(chosen, array_to_string(s[1:3], ' ')) end as summary from x left join t using (doc_id)"
)
def g01_extractive(s, d):
    return summaries.extractive(papers(s, d))


#: A summary is the start of the next document, with a number, a term, a direction and a claim added for some.
_MADE = "select doc_id, text as abstract, lead(text, 1, text) over (order by doc_id)[1:200] || case doc_id % 6 when 0 then ' It is 42% of 1,5.' when 1 then ' The PE3 of mRNA.' when 2 then ' It increased.' when 3 then ' The first best proof.' else '' end as summary from (select doc_id, " + _PLAIN + " || case when doc_id % 2 = 0 then ' It decreased by 42.' else '' end as text from documents)"


def _following(rows, column, name):
    """The rows with the column of the row with the next higher doc_id, whatever the gaps; the last keeps its own.

    Windows run within ranges of ids between quantiles; only the first row of each range is looked at across them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.5 / n))) if n > 1 else []
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    placed = rows.withColumns({"_own": F.struct(column.alias("x")), "_at": at})
    firsts = placed.groupBy("_at").agg(F.min_by("_own", "doc_id").alias("_first"))
    firsts = firsts.select("_at", F.lead("_first").over(Window.orderBy("_at")).alias("_first"))
    within = placed.withColumn("_next", F.lead("_own").over(Window.partitionBy("_at").orderBy("doc_id")))
    return within.join(F.broadcast(firsts), "_at").select(*rows.columns, F.coalesce("_next", "_first", "_own")["x"].alias(name))


def _made(s, d):
    docs = table(s, d, "documents").select("doc_id", F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", " "), F.expr("case when doc_id % 2 = 0 then ' It decreased by 42.' else '' end")).alias("abstract"))
    more = F.expr("case doc_id % 6 when 0 then ' It is 42% of 1,5.' when 1 then ' The PE3 of mRNA.' when 2 then ' It increased.' when 3 then ' The first best proof.' else '' end")
    return _following(docs, F.left("abstract", F.lit(200)), "head").select("doc_id", "abstract", F.concat("head", more).alias("summary"))


_NUM = lambda x: f"regexp_extract_all({x}, '\\d+(?:[.,]\\d+)*\\s*%?')"
_NORM = lambda x: f"rtrim(translate({x}, ',% ', ''), '.')"
_NUMBERS = f"len([n for n in {_NUM('summary')} if {_NORM('n')} <> '' and not list_contains([{_NORM('m')} for m in {_NUM('abstract')}], {_NORM('n')})])"
_TERMS = f"len(list_distinct([lower(t) for t in list_concat(regexp_extract_all(summary, '{L.ACRONYM}'), regexp_extract_all(summary, '{L.PREFIXED_SYMBOL}')) if not contains(lower(abstract), lower(t))]))"
_BOTH = "[" + ", ".join(f"['{a}', '{b}']" for pair in L.ANTONYMS for a, b in (pair, pair[::-1])) + "]"


@registered(
    f"with m as ({_MADE}), w as (select *, {O.content('summary')} as sw, {O.content('abstract')} as aw from m) select doc_id, {_NUMBERS} as numbers, {_TERMS} as terms, round(coalesce(len(list_intersect(sw, aw)) / nullif(len(sw), 0), 0), 6) as overlap, "
    f"array_to_string([p[1] for p in {_BOTH} if list_contains(sw, p[1]) and not list_contains(aw, p[1]) and list_contains(aw, p[2])], ',') as directions, "
    f"array_to_string(list_sort([x for x in {O.quoted(L.OVERCLAIMS)} if list_contains(sw, x) and not list_contains(aw, x)]), ',') as claims from w"
)
def g03_grounding_checks(s, d):
    a, b = F.col("summary"), F.col("abstract")
    made, p = summaries.Parts.added(_made(s, d), "summary", "abstract")
    return made.select(
        "doc_id", F.size(summaries.fabricated_numbers(a, b, p)).cast("bigint").alias("numbers"), F.size(summaries.fabricated_entities(a, b, p)).cast("bigint").alias("terms"),
        F.round(summaries.overlap(a, b, p), 6).alias("overlap"), F.array_join(summaries.reversed_directions(a, b, p), ",").alias("directions"), F.array_join(summaries.overclaims(a, b, p), ",").alias("claims"),
    )


@registered(
    f"with m as ({_MADE}), c as (select *, {O.content('summary')} as sw, {O.content('abstract')} as aw, len([p for p in regexp_split_to_array(summary, '[.!?](?:\\s|$)') if trim(regexp_replace(p, '\\s+', ' ', 'g')) <> '']) as n from m), "
    f"k as (select doc_id, abstract, coalesce(len(list_intersect(sw, aw)) / nullif(len(sw), 0), 0) as o, {_NUMBERS} + {_TERMS} + len([p for p in {_BOTH} if list_contains(sw, p[1]) and not list_contains(aw, p[1]) and list_contains(aw, p[2])]) "
    f"+ len([x for x in {O.quoted(L.OVERCLAIMS)} if list_contains(sw, x) and not list_contains(aw, x)]) + case when n > 4 or n < 1 then 1 else 0 end as issues from c) "
    "select doc_id, case when trim(abstract) = '' then 'unverifiable' when issues + (o < 0.45)::int > 0 then 'ungrounded' else 'grounded' end as status, issues + (o < 0.45)::int as n_issues from k"
)
def g02_verdict(s, d):
    v = summaries.with_verdict(_made(s, d))
    return v.select("doc_id", "v.status", F.size("v.issues").cast("bigint").alias("n_issues"))


#: The first two sentences and the made summary, against the whole text.
_MIXED = f"with p as (select doc_id, abstract, array_to_string(({O.sentences('abstract')})[1:2], ' ') || ' ' || summary as summary from ({_MADE})), si as (select doc_id, unnest(x) as text, unnest(range(len(x))) as i from (select doc_id, {O.sentences('summary')} as x from p)), ai as (select doc_id, unnest(x) as text, unnest(range(len(x))) as j from (select doc_id, {O.sentences('abstract')} as x from p)), wi as (select doc_id, unnest(x) as text, unnest(range(len(x))) as j from (select doc_id, list_concat(x, [array_to_string(x[k:k + 1], ' ') for k in range(1, len(x))], [array_to_string(x[k:k + 2], ' ') for k in range(1, len(x) - 1)]) as x from (select doc_id, {O.sentences('abstract')} as x from p)))"


def _sims(left: str, right: str) -> str:
    return (
        f"(select doc_id, a.i, b.j, round(coalesce(sim, 0), 9) as sim from {left} a join {right} b using (doc_id) left join (select doc_id, i, j, sum(x.w * y.w) as sim from ({O.embedding(left, 'doc_id, i')}) x join ({O.embedding(right, 'doc_id, j')}) y using (doc_id, bucket) group by all) using (doc_id, i, j))"
    )


def _mixed(s, d):
    return _made(s, d).select("doc_id", "abstract", F.concat(summaries.lead(F.col("abstract"), 2), F.lit(" "), "summary").alias("summary"))


@registered(f"{_MIXED}, long as (select * from si where len(regexp_split_to_array(text, '\\s+')) >= 4) select doc_id, cast(i as int) as i, round(max(sim), 6) as support, max(sim) >= 0.5 as supported from {_sims('long', 'wi')} group by all")
def g09_support(s, d):
    return summaries.support(_mixed(s, d)).withColumn("support", F.round("support", 6))


@registered(f"{_MIXED}, long as (select * from si where len(regexp_split_to_array(text, '\\s+')) >= 4), best as (select doc_id, i, max(sim) as support from {_sims('long', 'wi')} group by all) select doc_id, count(support) filter (support < 0.5 and trim(abstract) <> '') as unsupported from p left join best using (doc_id) group by 1")
def g11_support_issues(s, d):
    v = summaries.with_support(summaries.with_verdict(_mixed(s, d)))
    return v.select("doc_id", F.size(F.filter("v.issues", lambda i: i["kind"] == "unsupported_claim")).cast("bigint").alias("unsupported"))


@registered(
    f"{_MIXED}, sim as materialized {_sims('si', 'ai')}, cov as (select doc_id, avg(m) as coverage from (select doc_id, j, max(sim) as m from sim group by all) group by 1), n as (select doc_id, count(*) as n from ai group by 1), "
    "lead as (select doc_id, case when any_value(n) <= 1 then 0.5 else avg(place / nullif(n - 1, 0)) end as lead_bias from (select doc_id, i, arg_max(j, {'s': sim, 'j': -j}) as place from sim group by all) join n using (doc_id) group by 1), "
    f"sj as (select doc_id, text, i as j from si), tw as (select doc_id, max(sim) as redundancy from {_sims('si', 'sj')} where i < j group by 1) "
    "select doc_id, round(coverage, 6) as coverage, round(lead_bias, 6) as lead_bias, round(coalesce(redundancy, 0), 6) as redundancy from cov join lead using (doc_id) left join tw using (doc_id)"
)
def g20_sentence_quality(s, d):
    return _rounded(summaries.sentence_quality(_mixed(s, d)))


_WORDS = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9''-]*')"
_PAIRS = lambda x: f"list_distinct([w[k] || ' ' || w[k + 1] for k in range(1, len(w))])".replace("w", x)


@registered(
    f"{_MIXED.split(', si as')[0]}, v as (select doc_id, {_WORDS('summary')} as sw, {_WORDS('abstract')} as aw from p), b as (select doc_id, sw, aw, list_distinct([sw[k] || ' ' || sw[k + 1] for k in range(1, len(sw))]) as sp, list_distinct([aw[k] || ' ' || aw[k + 1] for k in range(1, len(aw))]) as ap from v) "
    "select doc_id, round(len(sw) / nullif(len(aw), 0), 6) as compression, round(coalesce(len([x for x in sp if not list_contains(ap, x)]) / nullif(len(sp), 0), 0), 6) as novelty from b"
)
def g22_novelty(s, d):
    x = _mixed(s, d)
    return x.select("doc_id", F.round(summaries.compression(F.col("summary"), F.col("abstract")), 6).alias("compression"), F.round(summaries.novelty(F.col("summary"), F.col("abstract")), 6).alias("novelty"))


@registered()
def g23_longest_copied(s, d):
    x = _mixed(s, d)
    return x.select("doc_id", F.round(summaries.longest_copied_span(summaries.plain_words(F.col("summary")), summaries.plain_words(F.col("abstract"))), 6).alias("span"))


@registered(f"select doc_id, array_to_string(({O.sentences('text')})[1:3], ' ') as lead from documents")
def g26_lead(s, d):
    return table(s, d, "documents").select("doc_id", summaries.lead(F.col("text")).alias("lead"))


@registered()
def g29_labelled_cases(s, d):
    from ..operators import attacks

    c = attacks.cases(papers(s, d).select("doc_id", "title", "abstract"))
    v = summaries.with_verdict(c)
    caught = F.when(F.col("expected").isNull(), F.col("v.status") != "grounded").otherwise(F.exists("v.issues", lambda i: i["kind"] == F.col("expected")))
    return metrics.confusion(v.select("label", caught.alias("caught")))


# --- stores ---


@registered("select query_id, left(sha256(lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) || chr(0) || '20' || chr(0) || 'all' || chr(0) || 'cfg' || chr(0)), 32) as key, left(sha1(raw || chr(0) || ''), 16) as print from (select conv_id || '-' || turn as query_id, text as raw from conversations)")
def k01_cache_key(s, d):
    c = table(s, d, "conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("query_id"), F.col("text").alias("raw"))
    none = F.array().cast("array<string>")
    return c.select("query_id", store.cache_key(F.col("raw"), F.lit(20), none, F.lit("cfg")).alias("key"), T.fingerprint(F.col("raw"), F.lit(None).cast("string")).alias("print"))


@registered(
    "with made as (select user_id, max(ts) as created_at from events where event_type = 'signup' group by 1) select event_id, coalesce(epoch(date_trunc('second', ts))::bigint - epoch(date_trunc('second', created_at))::bigint between 0 and 86399, false) as hit "
    "from events left join made using (user_id) where event_type = 'view'"
)
def k03_ttl_probe(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    made = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("created_at"))
    asked = e.where("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("asked_at"))
    return store.fresh(asked, made, ["user_id"], 86_400).select("event_id", "hit")


@registered(
    "with recursive t as (select user_id, list(cast(floor(epoch(ts)) as bigint) order by ts) as t from events group by 1), "
    "f as (select user_id, t, 1 as i, t[1] as made, 0 as hits from t union all select user_id, t, i + 1, case when t[i + 1] - made < 86400 then made else t[i + 1] end, hits + case when t[i + 1] - made < 86400 then 1 else 0 end from f where i < len(t)) "
    "select user_id, len(t) as n, cast(max(hits) as bigint) as hits from f group by user_id, t"
)
def k05_ttl_fold(s, d):
    e = table(s, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return store.simulate_ttl(e, ["user_id"], "at", 86_400)


@registered(
    "select user_id, query, ts, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as int) as pos from (select user_id, event_type || event_id % 9 as query, ts, event_id from events "
    "qualify row_number() over (partition by user_id, event_type || event_id % 9 order by ts desc, event_id desc) = 1) qualify pos <= 25"
)
def k10_history(s, d):
    e = table(s, d, "events").select("user_id", F.concat("event_type", F.col("event_id") % 9).alias("query"), "ts", F.col("event_id").alias("id"))
    return store.history(e)


# --- citations ---

_ESC = lambda x: "array_to_string([case c " + " ".join(f"when '{a}' then '{b}'" for a, b in L.LATEX_ESCAPES.items()) + f" else c end for c in string_split({x}, '')], '')"
_PROT = lambda x: f"array_to_string([case when regexp_matches(regexp_replace(w, '[.,;:)]+$', ''), '{L.PROTECTED_TOKEN}') and regexp_matches(substr(regexp_replace(w, '[.,;:)]+$', ''), 2), '[A-Z0-9]') and not starts_with(w, '{{') then '{{' || regexp_replace(w, '[.,;:)]+$', '') || '}}' || regexp_extract(w, '[.,;:)]*$') else w end for w in string_split({x}, ' ')], ' ')"
_MAP = lambda table, x: "map {" + ", ".join(f"'{a}': '{b}'" for a, b in table.items()) + f"}}[{x}]"
_TYPE = lambda table, pre, jour, other: f"coalesce({_MAP(table, 'lower(trim(publication_type))')}, case when source = 'arxiv' and journal is null then '{pre}' when journal is not null then '{jour}' else '{other}' end)"
_FIELD = lambda name, value: f"'  {name} = {{' || nullif({value}, '') || '}}'"
_SRC = "array_to_string(list_concat([source], also), '+')"
_CLEANKEY = lambda x: f"regexp_replace(regexp_replace(lower(strip_accents({x})), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '', 'g')"
_KEY = (
    f"with r as ({O.RECORDS}), b as (select *, coalesce(nullif(array_to_string(list_filter([{_CLEANKEY('coalesce(authors[1].family, regexp_extract(authors[1].name, ' + chr(39) + '(' + chr(92) + 'S+)' + chr(92) + 's*$' + chr(39) + ', 1), ' + chr(39) + chr(39) + ')')}, "
    f"coalesce([w for w in list_transform(regexp_split_to_array(title, '\\s+'), lambda t: {_CLEANKEY('t')}) if len(w) > 3][1], ''), coalesce(year(published_date)::varchar, 'nodate')], lambda p: p <> ''), '_'), ''), 'paper') as base from r), "
    "k as (select *, base || case when n < 0 then '' when n < 26 then chr(97 + n::int) else chr(96 + (n // 26)::int) || chr(97 + (n % 26)::int) end as cite_key from (select *, row_number() over (partition by base order by pos) - 2 as n from b))"
)


@registered(f"{_KEY} select doc_id, cite_key from k")
def x05_keys(s, d):
    return export.with_keys(records(s, d)).select("doc_id", "cite_key")


@registered(
    f"{_KEY}, t as (select *, {_TYPE(L.BIBTEX_TYPES, 'misc', 'article', 'misc')} as kind, {_PROT(_ESC('journal'))} as j from k) select pos, '@' || kind || '{{' || cite_key || ',' || chr(10) || concat_ws(',' || chr(10), {_FIELD('title', _PROT(_ESC('title')))}, "
    f"{_FIELD('author', 'array_to_string([case when a.family is not null and a.given is not null then ' + _ESC('a.family') + ' || ' + chr(39) + ', ' + chr(39) + ' || ' + _ESC('a.given') + ' else ' + chr(39) + '{{' + chr(39) + ' || ' + _ESC('a.name') + ' || ' + chr(39) + '}}' + chr(39) + ' end for a in authors], ' + chr(39) + ' and ' + chr(39) + ')')}, "
    f"case when kind in ('incollection', 'inproceedings') then {_FIELD('booktitle', 'j')} else {_FIELD('journal', 'j')} end, {_FIELD('year', 'year(published_date)::varchar')}, {_FIELD('volume', _ESC('volume'))}, {_FIELD('number', _ESC('issue'))}, "
    f"{_FIELD('pages', _ESC('regexp_replace(trim(pages), ' + chr(39) + chr(92) + 's*-+' + chr(92) + 's*' + chr(39) + ', ' + chr(39) + '--' + chr(39) + ')'))}, {_FIELD('doi', _ESC('doi'))}, {_FIELD('url', _ESC('url'))}, {_FIELD('abstract', _ESC('abstract'))}, {_FIELD('keywords', _ESC('array_to_string(keywords, ' + chr(39) + ', ' + chr(39) + ')'))}, "
    f"{_FIELD('note', _ESC(chr(39) + 'Retrieved via paperloom from ' + chr(39) + ' || ' + _SRC))}, case when published_date is not null then '  month = ' || {O.quoted(L.MONTHS)}[month(published_date)] end) || chr(10) || '}}' as citation from t".replace("{{'", "{'").replace("'{{", "'{").replace("}}'", "}'").replace("'}}", "'}")
)
def x02_bibtex(s, d):
    return export.citations(records(s, d), "bibtex").select("pos", "citation")


_CL = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_TAG = lambda name, x: f"'{name}  - ' || nullif({x}, '')"


_RIS = (
    f"with r as ({O.RECORDS}), g as (select *, trim(pages) as pg from r) select id, pos, array_to_string(list_filter(list_concat([{_TAG('TY', _TYPE(L.RIS_TYPES, 'UNPB', 'JOUR', 'GEN'))}], ['AU  - ' || case when a.family is not null and a.given is not null then a.family || ', ' || a.given else a.name end for a in authors], "
    f"[{_TAG('TI', _CL('title'))}, {_TAG('T2', _CL('journal'))}, {_TAG('JO', _CL('journal'))}, {_TAG('AB', _CL('abstract'))}, {_TAG('PY', 'year(published_date)::varchar')}, {_TAG('DA', 'strftime(published_date, ' + chr(39) + '%Y/%m/%d/' + chr(39) + ')')}, {_TAG('VL', 'volume')}, {_TAG('IS', 'issue')}, "
    f"{_TAG('SP', 'trim(split_part(pg, ' + chr(39) + '-' + chr(39) + ', 1))')}, {_TAG('EP', 'case when contains(pg, ' + chr(39) + '-' + chr(39) + ') then trim(regexp_replace(pg, ' + chr(39) + '^[^-]*-+' + chr(39) + ', ' + chr(39) + chr(39) + ')) end')}, {_TAG('DO', 'doi')}, {_TAG('UR', 'url')}], ['KW  - ' || k for k in keywords], ['DB  - paperloom', 'DP  - ' || {_SRC}]), lambda x: x is not null), chr(13) || chr(10)) "
    "|| chr(13) || chr(10) || 'ER  - ' || chr(13) || chr(10) || chr(13) || chr(10) as citation from g"
)


@registered(f"select pos, citation from ({_RIS})")
def x11_ris(s, d):
    return export.citations(records(s, d), "ris").select("pos", "citation")


_INIT = lambda dot, sep: f"array_to_string([left(p, 1) || '{dot}' for p in regexp_split_to_array(trim(coalesce(a.given, '')), '\\s+') if p <> ''], '{sep}')"
_VENUE_APA = "journal || coalesce(', ' || volume || coalesce('(' || issue || ')', ''), '') || coalesce(', ' || pages, '') || '.'"


@registered(
    f"with r as ({O.RECORDS}), n as (select *, [coalesce(a.family, a.name) || case when {_INIT('.', ' ')} = '' then '' else ', ' || {_INIT('.', ' ')} end for a in authors] as f, rtrim(title, '.') as t, coalesce(year(published_date)::varchar, 'n.d.') as y from r), "
    "h as (select *, case when len(f) = 0 then '' when len(f) = 1 then f[1] when len(f) <= 20 then array_to_string(f[1:len(f) - 1], ', ') || ', & ' || f[len(f)] else array_to_string(f[1:19], ', ') || ', ... ' || f[len(f)] end as au from n) "
    f"select pos, concat_ws(' ', case when au = '' then t || '. (' || y || ').' else au || ' (' || y || '). ' || t || '.' end, {_VENUE_APA}, case when doi is not null then 'https://doi.org/' || doi else url end) as citation from h"
)
def x14_apa(s, d):
    return export.citations(records(s, d), "apa").select("pos", "citation")


@registered(
    f"with r as ({O.RECORDS}), n as (select *, [coalesce(a.family, a.name) || case when {_INIT('', '')} = '' then '' else ' ' || {_INIT('', '')} end for a in authors] as f, rtrim(title, '.') as t, year(published_date)::varchar as y from r) "
    "select pos, concat_ws(' ', case when len(f) = 0 then '' else array_to_string(f[1:6], ', ') || case when len(f) > 6 then ', et al' else '' end || '. ' end || t || '.', "
    "case when journal is not null then journal || '.' || coalesce(' ' || y, '') || coalesce(';' || volume || coalesce('(' || issue || ')', ''), '') || coalesce(':' || pages, '') || '.' else y || '.' end, 'doi:' || doi) as citation from n"
)
def x15_vancouver(s, d):
    return export.citations(records(s, d), "vancouver").select("pos", "citation")


_X17 = "select o_custkey as export_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, 'doc:' || o_orderkey as id from orders"


@registered(f"with c as ({_RIS}), a as ({_X17}) select export_id, string_agg(citation, '' order by a.pos) as content, count(*) filter (citation is null) as missing, false as refused from a left join c using (id) group by 1")
def x17_bulk_export(s, d):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    asked = table(s, d, "orders").select(F.col("o_custkey").alias("export_id"), place.alias("pos"), F.concat(F.lit("doc:"), F.col("o_orderkey").cast("string")).alias("id"))
    return export.export(asked, records(s, d), "ris")


# --- further joins, counters and the whole engine ---


@registered("select n_nationkey, n_name, n_regionkey in (select r_regionkey from region where r_name like 'A%') as in_cluster from nation where n_regionkey in (select r_regionkey from region where r_name like 'A%')")
def j20_cluster_filter(s, d):
    chosen = table(s, d, "region").where("r_name like 'A%'").select(F.col("r_regionkey").alias("n_regionkey"))
    return clusters.within(table(s, d, "nation"), chosen, ["n_regionkey"]).select("n_nationkey", "n_name", F.lit(True).alias("in_cluster"))


@registered("select query_id, doc_id, coalesce(grade, 0) as grade from (select item_id as query_id, item_id * 3 as doc_id from benchmark) r left join (" + O.JUDGED + ") using (doc_id)")
def j17_judgments(s, d):
    r = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 3).alias("doc_id"))
    return metrics.graded(r, judged(s, d), ["doc_id"]).select("query_id", "doc_id", "grade")


@registered("select count(*) as requests, count(*) filter (event_type = 'error') as fell_back, count(*) filter (value > 50) as regenerated, count(distinct user_id) as users from events")
def a12_stage_counters(s, d):
    return metrics.stage_counters(table(s, d, "events"), {"fell_back": F.col("event_type") == "error", "regenerated": F.col("value") > 50}, "user_id")


@registered("select user_id as query_id, count(*) as n from events group by 1 having not bool_or(event_type = 'error')")
def k04_cacheable(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").cast("string").alias("source"), F.expr(_STATUS).alias("status"), (F.col("event_id") % 7).alias("returned"))
    return store.cacheable(e.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), query.degraded(e))


@registered("select doc_id, 'lengths' as embedder, cast(length(text) as double) as size from documents")
def r06_embedder_choice(s, d):
    def broken():
        raise OSError("no such model")

    lengths = models.Model("lengths", lambda: lambda texts: [[float(len(t))] for t in texts])
    choice = models.choose([models.Model("broken", broken), lengths], models.HASHING, ["probe"])
    return models.embed(table(s, d, "documents").select("doc_id", "text"), choice).select("doc_id", "embedder", F.get("vector", F.lit(0)).alias("size"))


@registered(f"select doc_id, round(sum(w * w), 6) as norm, count(*) filter (abs(w) > 1e-12) as n from ({O.embedding('documents', 'doc_id')}) group by 1")
def r05_model_embedder(s, d):
    """The hashing embedder through the interface that other models use gives the vectors of the SQL."""
    v = models.embed(table(s, d, "documents").select("doc_id", "text"), models.choose([], models.HASHING, ["probe"]))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    filled = F.size(F.filter("vector", lambda x: F.abs(x) > 1e-12)).cast("bigint")
    some = F.size(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) > 2)) > 0
    return v.where(some).select("doc_id", F.round(norm, 6).alias("norm"), filled.alias("n"))


@registered("select n_nationkey as id, 'abstract' as field, 'someone numbered ' || n_nationkey as text, 'person' as label, 4 as start from nation where n_nationkey % 3 = 0")
def e05_tagging_model(s, d):
    # A model that takes each whole text for a person, every third time; dates and titles don't count.
    label = lambda t: ("PERSON", "DATE", "ORG")[int(t.split()[-1]) % 3]
    whole = models.Model("whole", lambda: lambda texts: [[(0, len(t), label(t))] if t.startswith("The") else [(0, len(t), "PERSON")] for t in texts])
    text = F.concat(F.lit("The someone numbered "), F.col("n_nationkey").cast("string"))
    rows = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit("a title").alias("title"), text.alias("abstract"))
    found = models.tagged(rows, models.choose([whole], models.PATTERNS, ["The 0"]))
    return found.where("raw_label <> 'ORG'").select("id", "field", "text", "label", "start")


@registered("select event_id, event_id % 3 = 0 and event_type = 'error' as spent from events")
def g16_quota(s, d):
    headers = F.create_map(F.lit("X-RateLimit-Remaining-Month"), F.when((F.col("event_id") % 3 == 0) & (F.col("event_type") == "error"), " 0").otherwise("7"), F.lit("Content-Length"), F.lit("0"))
    return table(s, d, "events").select("event_id", models.no_quota(headers).alias("spent"))


@registered("select lang, count(*) as n_rows, count(distinct text) as n_encoded from documents group by 1")
def r07_embed_distinct(s, d):
    # Each distinct text is encoded once; the count of encoded texts shows it.
    docs = table(s, d, "documents").select("doc_id", "lang", "text")
    met = rank.embed_distinct(docs, lambda once: once.select("sha", F.array(F.lit(1.0)).alias("vector")))
    return met.groupBy("lang").agg(F.count("vector").alias("n_rows"), F.count_distinct("text").alias("n_encoded"))


@registered("select * from (values ('bibtex', 'BibTeX', 'bib'), ('ris', 'RIS', 'ris'), ('apa', 'APA 7th', 'txt'), ('vancouver', 'Vancouver', 'txt')) t(id, label, extension)")
def x18_formats(s, d):
    return export.formats(s)


@registered("select l_orderkey as id, cast(max(l_linenumber) as int) as version, arg_max(l_comment, l_linenumber) as kept from (select l_orderkey, l_linenumber, l_returnflag || l_linenumber as l_comment from lineitem) group by 1")
def k06_upsert_versions(s, d):
    # Line numbers repeat within an order; arg_max keeps the row that stands first in the table.
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("version"), F.concat("l_returnflag", "l_linenumber").alias("kept"), *place)
    return store.upsert(rows.where("version <= 2"), rows.where("version > 2"), ["id"], "version", ("_file", "_row"))


def _engine(s, d):
    from ..sources import registry
    from .engine import Engine

    return Engine(records(s, d).drop("export_id", "pos", "doc_id"), registry.sources(s), found_abstracts=table(s, d, "benchmark").select(F.concat(F.lit("10.1234/doc_"), F.col("item_id").cast("string")).alias("doi"), F.col("text").alias("abstract")))


@registered()
def engine_search(s, d):
    """The whole search for every benchmark passage, over the records view."""
    r = _engine(s, d).search(queries(s, d))
    return r.papers.select("query_id", "id", "pos", F.round("score.combined", 6).alias("combined"), "score.rank")


@registered()
def engine_reports(s, d):
    return _engine(s, d).search(queries(s, d)).stage_reports
