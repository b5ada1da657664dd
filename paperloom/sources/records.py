"""Upstream payloads as papers: Atom feeds, MEDLINE sets, works JSON. Payload columns in, paper rows out.

Every reader takes a DataFrame with query_id and payload, and applies the same normalisation (DOI, title)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

_ATOM = (
    "STRUCT<entry: ARRAY<STRUCT<id: STRING, updated: STRING, published: STRING, title: STRING, summary: STRING, "
    "author: ARRAY<STRUCT<name: STRING, affiliation: STRING>>, doi: STRING, journal_ref: STRING, "
    "link: ARRAY<STRUCT<_href: STRING, _rel: STRING, _title: STRING, _type: STRING>>, category: ARRAY<STRUCT<_term: STRING>>>>>"
)
_TEXT = "STRUCT<_VALUE: STRING, _Label: STRING>"
_DATE = "STRUCT<Year: STRING, Month: STRING, Day: STRING, MedlineDate: STRING>"
_MEDLINE = (
    "STRUCT<PubmedArticle: ARRAY<STRUCT<MedlineCitation: STRUCT<PMID: STRING, Article: STRUCT<"
    f"Journal: STRUCT<Title: STRING, ISOAbbreviation: STRING, JournalIssue: STRUCT<Volume: STRING, Issue: STRING, PubDate: {_DATE}>>, ArticleTitle: STRING, "
    "Pagination: STRUCT<MedlinePgn: STRING>, ELocationID: ARRAY<STRUCT<_VALUE: STRING, _EIdType: STRING>>, "
    "AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, ForeName: STRING, Initials: STRING, CollectiveName: STRING, AffiliationInfo: STRUCT<Affiliation: STRING>>>>, "
    f"PublicationTypeList: STRUCT<PublicationType: ARRAY<STRING>>, ArticleDate: {_DATE}, Abstract: STRUCT<AbstractText: ARRAY<{_TEXT}>>>, "
    f"OtherAbstract: STRUCT<AbstractText: ARRAY<{_TEXT}>>, KeywordList: STRUCT<Keyword: ARRAY<STRING>>, "
    "MeshHeadingList: STRUCT<MeshHeading: ARRAY<STRUCT<DescriptorName: STRING>>>>, "
    "PubmedData: STRUCT<ArticleIdList: STRUCT<ArticleId: ARRAY<STRUCT<_VALUE: STRING, _IdType: STRING>>>>>>>"
)
_PARTS = "STRUCT<`date-parts`: ARRAY<ARRAY<STRING>>>"
_WORK = (
    "STRUCT<DOI: STRING, title: ARRAY<STRING>, author: ARRAY<STRUCT<given: STRING, family: STRING, name: STRING, affiliation: ARRAY<STRUCT<name: STRING>>>>, "
    f"abstract: STRING, issued: {_PARTS}, `published-print`: {_PARTS}, `published-online`: {_PARTS}, created: {_PARTS}, `container-title`: ARRAY<STRING>, URL: STRING, type: STRING, "
    "publisher: STRING, volume: STRING, issue: STRING, page: STRING, subject: ARRAY<STRING>, `is-referenced-by-count`: STRING, link: ARRAY<STRUCT<URL: STRING, `content-type`: STRING>>>"
)
_NO_STRINGS = "array<string>"


def _finished(rows: DataFrame) -> DataFrame:
    """DOI and title normalised, records without title dropped, id and pos added."""
    out = rows.withColumn("doi", T.normalize_doi(F.col("doi"))).withColumn("title", T.collapse_whitespace(F.col("title"))).where("title is not null")
    out = out.withColumn("id", T.paper_id(F.col("doi"), F.col("source"), F.col("source_id")))
    order = Window.partitionBy("query_id", "source").orderBy("at")
    return out.withColumn("pos", F.row_number().over(order)).withColumn("also_found_in", F.array().cast(_NO_STRINGS)).drop("at")


def arxiv_id(x: Column) -> Column:
    """An arXiv id without its version, from an abstract's address."""
    return F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(F.trim(x), r"arxiv\.org/abs/(.+)$", 1), F.lit("")), F.trim(x)), r"v\d+$", "")


def timestamp_date(x: Column) -> Column:
    return F.to_date(F.left(F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), x), F.lit(10)).try_cast("date"))


def feed_errors(payloads: DataFrame) -> DataFrame:
    """query_id, source, status of feeds that say they failed."""
    e = F.from_xml("payload", _ATOM, {"ignoreNamespace": "true"})["entry"]
    return payloads.select("query_id", F.explode(e).alias("e")).where("e.id like '%arxiv.org/api/errors%'").select("query_id", F.lit("arxiv").alias("source"), F.lit("parse_error").alias("status")).distinct()


def arxiv(payloads: DataFrame) -> DataFrame:
    """Papers of Atom feeds; feeds in error give none."""
    e = F.from_xml("payload", _ATOM, {"ignoreNamespace": "true"})["entry"]
    rows = payloads.select("query_id", F.posexplode(e).alias("at", "e")).where("e.id not like '%arxiv.org/api/errors%'")
    local = arxiv_id(F.col("e.id"))
    pdf = F.try_element_at(F.filter("e.link", lambda x: x["_title"] == "pdf"), F.lit(1))["_href"]
    names = F.transform("e.author", lambda a: F.struct(T.author_from_display(a["name"]).alias("n"), T.collapse_whitespace(a["affiliation"]).alias("a")))
    authors = F.transform(F.filter(names, lambda x: x["n"].isNotNull()), lambda x: F.struct(x["n"]["name"].alias("name"), x["n"]["given"].alias("given"), x["n"]["family"].alias("family"), x["a"].alias("affiliation")))
    return _finished(rows.select(
        "query_id", "at", F.col("e.doi").alias("doi"), F.lit("arxiv").alias("source"), local.alias("source_id"), F.col("e.title").alias("title"), authors.alias("authors"),
        T.collapse_whitespace(F.col("e.summary")).alias("abstract"), timestamp_date(F.col("e.published")).alias("published_date"), F.concat(F.lit("https://arxiv.org/abs/"), local).alias("url"),
        T.collapse_whitespace(F.col("e.journal_ref")).alias("journal"), F.lit(None).cast("string").alias("publisher"), F.lit(None).cast("string").alias("volume"), F.lit(None).cast("string").alias("issue"), F.lit(None).cast("string").alias("pages"),
        F.lit("preprint").alias("publication_type"), F.coalesce(F.transform("e.category", lambda c: c["_term"]), F.array().cast(_NO_STRINGS)).alias("keywords"),
        F.coalesce(pdf, F.concat(F.lit("https://arxiv.org/pdf/"), local)).alias("pdf_url"), F.lit(None).cast("bigint").alias("citation_count"),
    ))


def _plain(x: Column) -> Column:
    """Text without the inner tags that the XML reader leaves, white space collapsed."""
    return T.collapse_whitespace(F.regexp_replace(x, "<[^>]+>", ""))


def esearch_ids(payloads: DataFrame) -> DataFrame:
    """query_id, pos and pmid of id searches; errors and blanks give none."""
    r = F.from_json("payload", "esearchresult STRUCT<idlist: ARRAY<STRING>, ERROR: STRING>")["esearchresult"]
    rows = payloads.select("query_id", r.alias("r")).where("r.ERROR is null")
    return rows.select("query_id", F.posexplode("r.idlist").alias("pos", "pmid")).where("trim(pmid) <> ''")


def medline_date(article: Column, issue: Column) -> Column:
    """Electronic date, else issue date, else the first year and word of its free text."""
    free = T.collapse_whitespace(issue["MedlineDate"])
    year = F.nullif(F.regexp_extract(free, r"(1[89]\d{2}|20\d{2})", 1), F.lit(""))
    month = F.nullif(F.regexp_extract(free, "([A-Za-z]{3,})", 1), F.lit(""))
    return F.coalesce(T.date_from_parts(article["Year"], article["Month"], article["Day"]), T.date_from_parts(issue["Year"], issue["Month"], issue["Day"]), T.date_from_parts(year, month, F.lit(None).cast("string")))


def structured_abstract(parts: Column) -> Column:
    """`Label: text` for labelled parts, joined by blanks."""
    said = F.transform(parts, lambda p: F.when(_plain(p["_VALUE"]).isNotNull(), F.concat(F.coalesce(F.concat(F.initcap(F.lower(F.nullif(F.trim(p["_Label"]), F.lit("")))), F.lit(": ")), F.lit("")), _plain(p["_VALUE"]))))
    return F.nullif(F.array_join(said, " "), F.lit(""))


def pubmed(payloads: DataFrame) -> DataFrame:
    """Papers of MEDLINE sets (PubmedArticle elements only), in the order of the set."""
    a = F.from_xml("payload", _MEDLINE)["PubmedArticle"]
    rows = payloads.select("query_id", F.posexplode(a).alias("at", "a")).select("query_id", "at", F.col("a.MedlineCitation").alias("c"), F.col("a.PubmedData").alias("p"))
    rows = rows.where("c.PMID is not null and c.Article is not null")
    art = F.col("c.Article")
    title = F.when(_plain(art["ArticleTitle"]).endswith("]."), F.regexp_replace(_plain(art["ArticleTitle"]), r"\.$", "")).otherwise(_plain(art["ArticleTitle"]))
    doi_of = lambda xs, kind: F.try_element_at(F.filter(xs, lambda x: x[kind] == "doi"), F.lit(1))["_VALUE"]
    doi = F.coalesce(doi_of(art["ELocationID"], "_EIdType"), doi_of(F.col("p.ArticleIdList.ArticleId"), "_IdType"))

    def author(x: Column) -> Column:
        n = T.author_from_parts(F.coalesce(x["ForeName"], x["Initials"]), x["LastName"])
        group = T.collapse_whitespace(x["CollectiveName"])
        none = F.lit(None).cast("string")
        return F.when(group.isNotNull(), F.struct(group.alias("name"), none.alias("given"), none.alias("family"), none.alias("affiliation"))).when(
            n.isNotNull(), F.struct(n["name"].alias("name"), n["given"].alias("given"), n["family"].alias("family"), T.collapse_whitespace(x["AffiliationInfo"]["Affiliation"]).alias("affiliation"))
        )

    authors = F.filter(F.transform(F.coalesce(art["AuthorList"]["Author"], F.array().cast("array<struct<LastName:string,ForeName:string,Initials:string,CollectiveName:string,AffiliationInfo:struct<Affiliation:string>>>")), author), lambda x: x.isNotNull())
    own = F.filter(F.transform("c.KeywordList.Keyword", _plain), lambda k: k.isNotNull())
    mesh = F.filter(F.transform("c.MeshHeadingList.MeshHeading", lambda m: _plain(m["DescriptorName"])), lambda k: k.isNotNull())
    keywords = F.coalesce(F.when(F.size(own) > 0, own), mesh, F.array().cast(_NO_STRINGS))
    j = art["Journal"]
    return _finished(rows.select(
        "query_id", "at", doi.alias("doi"), F.lit("pubmed").alias("source"), F.col("c.PMID").alias("source_id"), title.alias("title"), authors.alias("authors"),
        F.coalesce(structured_abstract(art["Abstract"]["AbstractText"]), structured_abstract(F.col("c.OtherAbstract.AbstractText"))).alias("abstract"),
        medline_date(art["ArticleDate"], j["JournalIssue"]["PubDate"]).alias("published_date"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("c.PMID"), F.lit("/")).alias("url"),
        F.coalesce(_plain(j["Title"]), _plain(j["ISOAbbreviation"])).alias("journal"), F.lit(None).cast("string").alias("publisher"), j["JournalIssue"]["Volume"].alias("volume"), j["JournalIssue"]["Issue"].alias("issue"),
        art["Pagination"]["MedlinePgn"].alias("pages"), F.lower(F.try_element_at(art["PublicationTypeList"]["PublicationType"], F.lit(1))).alias("publication_type"), keywords.alias("keywords"),
        F.lit(None).cast("string").alias("pdf_url"), F.lit(None).cast("bigint").alias("citation_count"),
    ))


def in_search_order(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """papers placed as their ids were found by the search; unknown ones last."""
    met = papers.drop("pos").join(ids.select("query_id", F.col("pmid").alias("source_id"), F.col("pos").alias("_at")), ["query_id", "source_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("_at"), "id")
    return met.withColumn("pos", F.row_number().over(order)).drop("_at")


def first_string(xs: Column) -> Column:
    """The first element that has text left without markup."""
    return F.try_element_at(F.filter(F.transform(xs, T.strip_markup), lambda x: x.isNotNull()), F.lit(1))


def issued(*dates: Column) -> Column:
    """The first usable of several ragged date parts."""

    def one(parts: Column) -> Column:
        n = F.filter(F.try_element_at(parts, F.lit(1)), lambda x: x.isNotNull())
        at = lambda k: F.try_element_at(n, F.lit(k))
        return T.date_from_parts(at(1), at(2), at(3))

    return F.coalesce(*[one(d) for d in dates])


def kept_type(x: Column) -> Column:
    """Whether a work of this type is kept; one without a type is."""
    return ~F.coalesce(x, F.lit("")).isin(L.EXCLUDED_TYPES)


def crossref(payloads: DataFrame) -> DataFrame:
    """Papers of works lists or single works; excluded types and records without title or DOI are dropped."""
    many = F.from_json("payload", f"message STRUCT<items: ARRAY<{_WORK}>>")["message"]["items"]
    single = F.from_json("payload", f"message {_WORK}")["message"]
    rows = payloads.select("query_id", F.posexplode(F.coalesce(many, F.array(single))).alias("at", "w")).where("w.DOI is not null")
    rows = rows.where(kept_type(F.col("w.type")))
    none = F.lit(None).cast("string")

    def author(x: Column) -> Column:
        n = T.author_from_parts(x["given"], x["family"])
        where = F.try_element_at(F.filter(F.transform(x["affiliation"], lambda a: T.collapse_whitespace(a["name"])), lambda a: a.isNotNull()), F.lit(1))
        group = T.collapse_whitespace(x["name"])
        return F.when(n.isNotNull(), F.struct(n["name"].alias("name"), n["given"].alias("given"), n["family"].alias("family"), where.alias("affiliation"))).when(
            group.isNotNull(), F.struct(group.alias("name"), none.alias("given"), none.alias("family"), where.alias("affiliation"))
        )

    authors = F.filter(F.transform(F.coalesce("w.author", F.array().cast("array<struct<given:string,family:string,name:string,affiliation:array<struct<name:string>>>>")), author), lambda a: a.isNotNull())
    pdf = F.try_element_at(F.filter("w.link", lambda x: x["content-type"] == "application/pdf"), F.lit(1))["URL"]
    doi = T.normalize_doi(F.col("w.DOI"))
    d = lambda c: F.col("w")[c]["date-parts"]
    rows = rows.select(
        "query_id", "at", doi.alias("doi"), F.lit("crossref").alias("source"), doi.alias("source_id"), first_string(F.col("w.title")).alias("title"), authors.alias("authors"),
        T.strip_markup(F.col("w.abstract")).alias("abstract"), issued(d("issued"), d("published-print"), d("published-online"), d("created")).alias("published_date"),
        F.coalesce("w.URL", F.concat(F.lit("https://doi.org/"), doi)).alias("url"), first_string(F.col("w")["container-title"]).alias("journal"), F.col("w.publisher").alias("publisher"), F.col("w.volume").alias("volume"),
        F.col("w.issue").alias("issue"), F.col("w.page").alias("pages"), F.col("w.type").alias("publication_type"), F.coalesce("w.subject", F.array().cast(_NO_STRINGS)).alias("keywords"),
        pdf.alias("pdf_url"), F.col("w")["is-referenced-by-count"].try_cast("bigint").alias("citation_count"),
    )
    return _finished(rows.where("doi is not null"))


def malformed(payloads: DataFrame) -> DataFrame:
    """query_id, source, status of works payloads that are no JSON with a message."""
    got = F.from_json("payload", "message STRING")["message"]
    return payloads.where(got.isNull()).select("query_id", F.lit("crossref").alias("source"), F.lit("parse_error").alias("status"))


READERS = {"arxiv": arxiv, "pubmed": pubmed, "crossref": crossref}
