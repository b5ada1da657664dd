"""Readers over small payloads of our own."""

import json
import urllib.error

from pyspark.sql import functions as F

from paperloom.operators import backfill
from paperloom.sources import http, records, registry

FEED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<entry><id>http://arxiv.org/abs/2301.00007v4</id><published>2023-01-05T10:00:00Z</published><title>A  title
 on two lines</title><summary> Text. </summary><author><name>Ann B. Lee</name></author><author><name>Plato</name></author>
<category term="cs.CL"/><category term="cs.LG"/></entry>
<entry><id>http://arxiv.org/abs/2301.00008v1</id><published>bad</published><title>Second</title><summary>S</summary><arxiv:doi>10.1038/S41587</arxiv:doi>
<link title="pdf" href="http://arxiv.org/pdf/2301.00008v1"/></entry></feed>"""
ERROR_FEED = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/api/errors#bad</id><title>Error</title></entry></feed>'

MEDLINE = """<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID>11</PMID><Article><Journal><Title>J Cells</Title><JournalIssue><Volume>4</Volume><Issue>2</Issue><PubDate><Year>2022</Year><Month>Jul</Month></PubDate></JournalIssue></Journal>
<ArticleTitle>Base <sup>13</sup>C editing.</ArticleTitle><ELocationID EIdType="doi">10.1000/A</ELocationID>
<Abstract><AbstractText Label="BACKGROUND">Why.</AbstractText><AbstractText Label="RESULTS">What.</AbstractText></Abstract>
<AuthorList><Author><LastName>Chen</LastName><ForeName>Wei</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList>
<ArticleDate><Year>2022</Year><Month>06</Month><Day>30</Day></ArticleDate></Article><KeywordList><Keyword>k1</Keyword></KeywordList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><ISOAbbreviation>J. B</ISOAbbreviation><JournalIssue><PubDate><MedlineDate>2019 Mar-Apr</MedlineDate></PubDate></JournalIssue></Journal>
<ArticleTitle>[Plain].</ArticleTitle></Article><MeshHeadingList><MeshHeading><DescriptorName>Mice</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1000/b</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedBookArticle><PMID>13</PMID></PubmedBookArticle></PubmedArticleSet>"""

WORKS = {"message": {"items": [
    {"DOI": "10.1000/UP", "title": [" <i></i>", "The <b>Title</b>"], "type": "journal-article", "author": [{"given": "A", "family": "B", "affiliation": [{"name": "U"}]}, {"name": "Org"}], "issued": {"date-parts": [[2022, 7]]}, "abstract": "<jats:p>Text &amp; more</jats:p>", "is-referenced-by-count": 3},
    {"DOI": "10.1000/none", "title": ["T2"], "issued": {"date-parts": [[None]]}, "published-print": {"date-parts": [[2020, 5, 31]]}, "container-title": [], "is-referenced-by-count": "x"},
    {"DOI": "10.1000/c", "title": ["C"], "type": "component"}, {"DOI": "10.1000/u", "title": []},
]}}


def read(spark, reader, payload):
    return reader(spark.createDataFrame([("q", payload)], "query_id string, payload string")).orderBy("pos").collect()


def test_atom(spark):
    a, b = read(spark, records.arxiv, FEED)
    assert (a.source_id, a.title, str(a.published_date), a.keywords, a.pdf_url) == ("2301.00007", "A title on two lines", "2023-01-05", ["cs.CL", "cs.LG"], "https://arxiv.org/pdf/2301.00007")
    assert [(x.name, x.given, x.family) for x in a.authors] == [("Ann B. Lee", "Ann B.", "Lee"), ("Plato", None, "Plato")] and a.id.startswith("arxiv:")
    assert (b.id, b.published_date, b.pdf_url) == ("doi:10.1038/s41587", None, "http://arxiv.org/pdf/2301.00008v1")
    errors = spark.createDataFrame([("q", ERROR_FEED)], "query_id string, payload string")
    assert records.arxiv(errors).count() == 0 and records.feed_errors(errors).first().status == "parse_error"


def test_medline(spark):
    a, b = read(spark, records.pubmed, MEDLINE)
    assert (a.id, a.title, str(a.published_date), a.abstract, a.keywords, a.volume) == ("doi:10.1000/a", "Base 13C editing.", "2022-06-28", "Background: Why. Results: What.", ["k1"], "4")
    assert [x.name for x in a.authors] == ["Wei Chen", "The Group"]
    assert (b.doi, b.title, str(b.published_date), b.journal, b.keywords, b.abstract) == ("10.1000/b", "[Plain]", "2019-03-01", "J. B", ["Mice"], None)


def test_search_order(spark):
    ids = records.esearch_ids(spark.createDataFrame([("q", '{"esearchresult":{"idlist":["12","11"]}}')], "query_id string, payload string"))
    papers = records.pubmed(spark.createDataFrame([("q", MEDLINE)], "query_id string, payload string"))
    assert [r.source_id for r in records.in_search_order(papers, ids).orderBy("pos").collect()] == ["12", "11"]


def test_works(spark):
    a, b = read(spark, records.crossref, json.dumps(WORKS))
    assert (a.doi, a.title, str(a.published_date), a.abstract, a.citation_count) == ("10.1000/up", "The Title", "2022-07-01", "Text & more", 3)
    assert [(x.name, x.affiliation) for x in a.authors] == [("A B", "U"), ("Org", None)]
    assert (str(b.published_date), b.journal, b.citation_count) == ("2020-05-28", None, None)
    assert len(read(spark, records.crossref, json.dumps({"message": WORKS["message"]["items"][0]}))) == 1
    assert records.malformed(spark.createDataFrame([("q", "oops")], "query_id string, payload string")).count() == 1


def test_registry(spark):
    known = registry.sources(spark)
    assert registry.select(known, None).count() == 3 and registry.select(known, ["arxiv", "x"]).count() == 1
    rows = spark.createDataFrame([("q", FEED)], "query_id string, payload string")
    papers, failed = registry.fan_out(spark, {"arxiv": rows, "other": rows})
    assert papers.count() == 2 and failed.first().status == "unavailable"


def test_backfill(spark):
    payload = json.dumps({"results": [{"doi": "https://doi.org/10.1000/A", "abstract_inverted_index": {f"w{i}": [i] for i in range(60)}}, {"doi": "10.1000/b", "abstract_inverted_index": {"stub": [0]}}]})
    found = backfill.works(spark.createDataFrame([(payload,)], "payload string"))
    papers = spark.createDataFrame([("1", "10.1000/a", None), ("2", "10.1000/a", "own"), ("3", "10.1000/b", ""), ("4", None, None)], "id string, doi string, abstract string")
    after = {r.id: r.abstract for r in backfill.fill(papers, found).collect()}
    assert after["1"].startswith("w0 w1") and after["2"] == "own" and not after["3"] and after["4"] is None
    assert tuple(backfill.report(papers, backfill.fill(papers, found)).first()) == (2, 1, 1)


class _Answer:
    def __init__(self, body):
        self.body = body

    def read(self):
        return self.body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def _failing(codes, waits):
    def opener(url):
        code = codes.pop(0)
        if code == 200:
            return _Answer(b"ok")
        if code == 0:
            raise urllib.error.URLError("down")
        raise urllib.error.HTTPError(url, code, "", {"Retry-After": "3"} if code == 429 else {}, None)

    return http.fetch("u", opener=opener, sleep=waits.append)


def test_retries():
    waits = []
    assert _failing([429, 503, 200], waits) == ("ok", "ok") and waits[0] == 3 and 2 <= waits[1] <= 2.25
    assert _failing([400], []) == ("unavailable", None) and _failing([404], []) == ("not_found", None)
    assert _failing([0, 0, 0], []) == ("unavailable", None) and _failing([429] * 3, []) == ("rate_limited", None)
    assert http.retry_after_seconds("99") == 10 and http.retry_after_seconds("x") is None


def test_spacing():
    now, slept = [0.0], []
    spacer = http.Spacer(3, clock=lambda: now[0], sleep=slept.append)
    for t in (0, 1, 10):
        now[0] = t
        spacer.wait()
    assert slept == [2]


def test_data_source(spark):
    spark.dataSource.register(http.SearchDataSource)
    got = spark.read.format("paperloom_http").option("url", "http://127.0.0.1:9/{query}").option("queries", "[]").load()
    assert got.columns == ["query_id", "status", "payload"] and got.count() == 0


def test_streaming(spark, tmp_path):
    from paperloom.operators.store import Table
    from paperloom.streaming import stream

    rows = [("10.1000/a", "x", "1", "t1"), ("doi:10.1000/A", "y", "2", "t2"), (None, "x", "3", "t3")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "doi string, source string, source_id string, title string").withColumn("seen_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(source)
    papers = spark.readStream.schema("doi string, source string, source_id string, title string, seen_at timestamp").parquet(source)
    table = Table(spark, str(tmp_path / "out"), "id string, title string, seen_at timestamp", ["id"], "seen_at")
    stream.upserting(stream.deduplicated(papers).select("id", "title", "seen_at"), table, str(tmp_path / "ck")).awaitTermination(120)
    assert table.count() == 2
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert stream.request_counts(events).first().n == 2
