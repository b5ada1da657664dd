"""The record types as Spark DDL."""

AUTHOR = "STRUCT<name:STRING,given:STRING,family:STRING,affiliation:STRING>"
ISSUE = "STRUCT<kind:STRING,detail:STRING,severity:STRING,span:STRING>"
SCORE = "STRUCT<combined:DOUBLE,semantic:DOUBLE,lexical:DOUBLE,rank:INT,strategy:STRING>"
SUMMARY = f"STRUCT<text:STRING,origin:STRING,grounding:STRUCT<status:STRING,issues:ARRAY<{ISSUE}>,overlap:DOUBLE>,model:STRING,prompt_version:INT,attempts:INT,cached:BOOLEAN,rejected_for:ARRAY<{ISSUE}>>"
ENTITY = "STRUCT<text:STRING,label:STRING,raw_label:STRING,spans:ARRAY<STRUCT<field:STRING,start:INT,end:INT>>>"

PAPER = (
    f"query_id STRING, pos INT, id STRING, doi STRING, source STRING, source_id STRING, title STRING, authors ARRAY<{AUTHOR}>, "
    "abstract STRING, published_date DATE, url STRING, journal STRING, publisher STRING, volume STRING, issue STRING, pages STRING, "
    "publication_type STRING, keywords ARRAY<STRING>, pdf_url STRING, citation_count BIGINT, also_found_in ARRAY<STRING>"
)
SOURCE_REPORT = "query_id STRING, source STRING, status STRING, returned INT, elapsed_ms BIGINT, reason STRING"
STAGE_REPORT = "query_id STRING, stage STRING, applied BOOLEAN, model STRING, counted BIGINT, elapsed_ms BIGINT, reason STRING"
QUERY = "query_id STRING, raw STRING, intent STRING, search_terms STRING, identifier_kind STRING, identifier STRING, keywords ARRAY<STRING>"

SOURCES = ["pubmed", "arxiv", "crossref"]
STATUSES = ["ok", "empty", "skipped", "timeout", "rate_limited", "parse_error", "unavailable"]
