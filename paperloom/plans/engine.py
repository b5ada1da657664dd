"""The whole search as one plan for many requests: parse, retrieve, interleave, resolve, backfill, rank, enrich.

What a stage gives is written to the shared folder before the next reads it, which cuts the plan and survives lost
executors. Every stage is optional but retrieval, and says in stage_reports whether it was applied, to how many rows and why
not; a stage that can't run is a row there, not an exception."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as T
from ..operators import backfill, clusters, dedupe, entities, export, metrics, query, rank, store, summaries
from ..tables import keep, sized


@dataclass
class Response:
    """What a search gives, as tables keyed by query_id."""

    queries: DataFrame
    papers: DataFrame
    source_reports: DataFrame
    stage_reports: DataFrame
    entities: DataFrame | None = None
    clusters: DataFrame | None = None
    summaries: DataFrame | None = None


@dataclass
class Engine:
    """papers: id, doi, source, source_id, title, abstract, url, keywords, journal and the other record columns.

    sources: source, has_doi, has_arxiv, has_pmid. found_abstracts (doi, abstract) fills gaps."""

    papers: DataFrame
    sources: DataFrame
    settings: Settings = DEFAULTS
    strategy: str = "linear"
    found_abstracts: DataFrame | None = None
    complete: object = None
    stages: frozenset[str] = field(default_factory=lambda: frozenset({"dedupe", "backfill", "rank", "entities", "clusters", "summaries"}))

    def parse(self, queries: DataFrame) -> DataFrame:
        return query.parse(queries, self.settings)

    def _lookups(self, parsed: DataFrame) -> DataFrame:
        """query_id, source, doc_id and hits of identifier queries."""
        todo = query.dispatch(parsed, self.sources).where("action like 'by_%'")
        rows = self.papers.select("source", F.col("id").alias("doc_id"), "doi", "source_id")
        by_doi = todo.where("action = 'by_doi'").join(rows, (rows["doi"] == F.col("argument")) & (rows["source"] == todo["source"])).select("query_id", rows["source"], "doc_id")
        by_id = todo.where("action in ('by_arxiv_id', 'by_pmid')").join(rows, (rows["source_id"] == F.col("argument")) & (rows["source"] == todo["source"])).select("query_id", rows["source"], "doc_id")
        return by_doi.union(by_id).withColumn("hits", F.lit(1).cast("bigint")).withColumn("mode", F.lit("lookup"))

    def search(self, queries: DataFrame, limit: int | None = None) -> Response:
        """queries: query_id, raw. Blank ones have no answer."""
        s = self.settings
        most = min(limit or s.limit_per_source, s.max_limit_per_source)
        parsed = keep(self.parse(queries), "parsed")
        words = parsed.where("intent <> 'identifier'").select("query_id", F.posexplode("keywords").alias("i", "keyword")).select("query_id", (F.col("i") + 1).alias("kw_rank"), "keyword").dropDuplicates(["query_id", "keyword"])
        corpus = self.papers.select(F.col("id").alias("doc_id"), "source", F.concat_ws(" ", "title", "abstract").alias("text"))
        found = query.retrieve(words, corpus).unionByName(self._lookups(parsed))
        found = keep(query.limit_per_source(found, most), "found")  # at most limit x sources rows a query; reports read it too
        asked = parsed.select("query_id").crossJoin(sized(self.sources.select("source"), query.BROADCAST_ROWS))
        reports = query.source_reports(asked, found)
        merged = query.interleave(found, F.col("source")).select("query_id", F.col("doc_id").alias("id"), F.col("merged_pos").cast("int").alias("pos"))
        rows = keep(merged.join(self.papers.drop("pos", "query_id"), "id"), "rows")
        counted = [("retrieve", True, rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "")]
        if "dedupe" in self.stages:
            placed = keep(rows.join(dedupe.greedy_clusters(rows, s).select("query_id", "id", "cluster"), ["query_id", "id"]), "placed")
            counted.append(("dedupe", True, dedupe.duplicates_merged(placed).withColumnRenamed("duplicates_merged", "n"), ""))
            rows = dedupe.merge_papers(placed)
        if "backfill" in self.stages and self.found_abstracts is not None:
            gaps = backfill.gaps(rows)
            rows = backfill.fill(rows, self.found_abstracts, s)
            counted.append(("backfill", True, gaps.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), ""))
        elif "backfill" in self.stages:
            counted.append(("backfill", False, None, "no lookup table"))
        rows = keep(rows, "rows")  # every enrichment reads this set
        text = T.document_text(F.col("title"), F.col("abstract"), F.col("keywords"), F.col("journal"))
        candidates = rows.select("query_id", F.col("id").alias("doc_id"), "pos", "title", "abstract", text.alias("text"))
        if "rank" in self.stages:
            lexical = rank.candidate_bm25(parsed.select("query_id", F.col("raw").alias("text")), candidates).withColumnRenamed("bm25", "lexical")
            q = rank.hash_embedding(parsed.select("query_id", F.col("raw").alias("text")), ["query_id"], s.hashing_dim)
            d = rank.hash_embedding(candidates.select("doc_id", "text").dropDuplicates(["doc_id"]), ["doc_id"], s.hashing_dim)
            semantic = candidates.select("query_id", "doc_id").join(q.withColumnRenamed("w", "wq"), "query_id").join(d, ["doc_id", "bucket"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("w")).alias("semantic"))
            scored = candidates.join(lexical, ["query_id", "doc_id"]).join(semantic, ["query_id", "doc_id"], "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0))).withColumn("n_tokens", F.size(T.tokens(F.col("text"))))
            ranked = rank.rank(keep(scored, "scored"), self.strategy, s).select("query_id", F.col("doc_id").alias("id"), F.struct("combined", "semantic", "lexical", "rank", F.lit(self.strategy).alias("strategy")).alias("score"))
            out = rows.join(ranked, ["query_id", "id"], "left")
            counted.append(("rank", True, ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), ""))
        else:
            out = rows
        made = {}
        once = rows.select("id", "title", "abstract").dropDuplicates(["id"])
        if "entities" in self.stages:
            made["entities"] = entities.merge_occurrences(entities.occurrences(once))
        if "clusters" in self.stages:
            vectors = rank.hash_embedding(candidates.select("doc_id", "text").dropDuplicates(["doc_id"]), ["doc_id"], s.hashing_dim).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "w"))).alias("m"))
            dense = F.transform(F.sequence(F.lit(0), F.lit(s.hashing_dim - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
            assigned = clusters.cluster(candidates.join(vectors.select("doc_id", dense.alias("vector")), "doc_id"), s)
            named = assigned.where("cluster_id is not null").join(candidates.select("query_id", "doc_id", "text"), ["query_id", "doc_id"])
            terms = clusters.class_terms(named.select("query_id", F.col("cluster_id").alias("grp"), "text"), s.cluster_terms)
            made["clusters"] = clusters.build(assigned, terms)
            counted.append(("clusters", True, assigned.groupBy("query_id").agg(F.count_distinct("cluster_id").alias("n"), F.first("reason").alias("reason")), None))
        if "summaries" in self.stages:
            made["summaries"] = summaries.summarise(once.withColumnRenamed("id", "doc_id"), self.complete, s)
        return Response(parsed, out, reports, self._reports(parsed, counted), **made)

    @staticmethod
    def _reports(parsed: DataFrame, counted: list) -> DataFrame:
        out = None
        for stage, applied, n, reason in counted:
            rows = parsed.select("query_id")
            rows = rows.join(n, "query_id", "left") if n is not None else rows.withColumn("n", F.lit(0).cast("bigint"))
            why = F.coalesce("reason", F.lit("")) if reason is None else F.lit(reason)
            one = rows.select("query_id", F.lit(stage).alias("stage"), F.lit(applied).alias("applied"), F.coalesce("n", F.lit(0)).cast("bigint").alias("counted"), why.alias("reason"))
            out = one if out is None else out.unionByName(one)
        return out

    def export(self, requested: DataFrame, fmt: str) -> DataFrame:
        """export_id, content and missing. requested: export_id, pos, id."""
        return export.export(requested, self.papers, fmt, self.settings)

    def evaluate(self, ranked: DataFrame, judged: DataFrame) -> DataFrame:
        return metrics.evaluate(ranked, judged, self.settings)

    def cache_keys(self, requests: DataFrame) -> DataFrame:
        """requests (query_id, raw, limit, sources) with the key of their cached answer under these settings."""
        return requests.withColumn("key", store.cache_key(F.col("raw"), F.col("limit"), F.col("sources"), F.lit(self.settings.fingerprint())))
