import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.config import Settings
from paperloom.operators import attacks, clusters, dedupe, entities, evaluation, export, metrics, models, query, rank, store, summaries
from paperloom.plans.views import papers

SMALL = "/root/testdata/sf0.001"


def test_identifiers(spark):
    cases = {
        "10.1000/XYZ": ("doi", "10.1000/xyz"), "https://arxiv.org/abs/2101.00001v2": ("arxiv", "2101.00001"), "arXiv: 2101.00001": ("arxiv", "2101.00001"),
        "math.GT/0309136": ("arxiv", "math.GT/0309136"), "https://pubmed.ncbi.nlm.nih.gov/35123456/": ("pmid", "35123456"), "PMID: 35123456": ("pmid", "35123456"), "crispr base editing": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", query.identifier(F.col("raw")).alias("i"))
    assert {r.raw: (r.i.kind, r.i.value) if r.i else None for r in df.collect()} == cases


def test_parse_intents(spark):
    rows = [("a", "CRISPR"), ("b", "prime editing in cells"), ("c", " "), ("d", "word " * 30), ("e", "of the")]
    got = {r.query_id: r for r in query.parse(spark.createDataFrame(rows, "query_id string, raw string")).collect()}
    assert {k: v.intent for k, v in got.items()} == {"a": "keyword", "b": "topic", "d": "abstract_snippet", "e": "keyword"}
    assert got["e"].keywords == ["of", "the"] and got["d"].search_terms == "word"


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", d, i) for i, d in enumerate("abcd", 1)], "query_id string, doc_id string, rank int")
    grades = spark.createDataFrame([("q", d, g) for d, g in (("a", 3), ("b", 0), ("c", 2), ("d", 0))], "query_id string, doc_id string, grade int")
    r = metrics.evaluate(ranked, grades, Settings(ks=(1, 2, 3))).orderBy("k").collect()
    assert [x.recall for x in r] == [0.5, 0.5, 1.0] and [x.ceiling for x in r] == [0.5, 1.0, 1.0] and [x.precision for x in r] == [1.0, 0.5, 2 / 3]
    assert r[2].mrr == 1.0 and r[2].ndcg == pytest.approx((7 + 3 / 2) / (7 + 3 / np.log2(3)))


def test_bm25_candidates_are_the_corpus(spark):
    q = spark.createDataFrame([("q", "alpha beta")], "query_id string, text string")
    c = spark.createDataFrame([("q", i, t) for i, t in enumerate(["alpha gamma", "beta gamma", "gamma delta", "delta"])], "query_id string, doc_id int, text string")
    got = {r.doc_id: r.bm25 for r in rank.candidate_bm25(q, c).collect()}
    assert got[0] == pytest.approx(got[1]) and got[0] > 0 and got[2] == got[3] == 0


def test_greedy_fold_follows_order(spark):
    rows = [("q", "1", 0, "10.1/a", "Deep learning for cells"), ("q", "2", 1, "10.1/a", "Other title altogether"), ("q", "3", 2, None, "Deep Learning for Cells."), ("q", "4", 3, "10.9/z", "Deep learning for cells"), ("q", "5", 4, "10.1101/p", "Deep learning for cells")]
    got = {r.id: r.cluster for r in dedupe.greedy_clusters(spark.createDataFrame(rows, "query_id string, id string, pos int, doi string, title string")).collect()}
    # The last record's DOI could be the preprint of the first's, but the second's other title speaks against it.
    assert got["1"] == got["2"] == got["3"] != got["4"] == got["5"]


def test_fuzzy_pairs_against_brute_force(spark):
    base = [f"gene editing of plant number {i} in the field" for i in range(12)] + ["short", "gene editing of plants number 3 in the field"]
    df = spark.createDataFrame([("q", i, t) for i, t in enumerate(base)], "query_id string, id int, title string")
    got = {(r.left_id, r.right_id) for r in dedupe.fuzzy_pairs(df).collect()}
    expected = {(i, j) for i in range(len(base)) for j in range(i + 1, len(base)) if base[i][:12] == base[j][:12] and len(base[i]) >= 12 and difflib.SequenceMatcher(None, base[i], base[j]).ratio() >= 0.94}
    assert got == expected


def test_fuzzy_pairs_of_long_titles(spark):
    """No edit distance is computed for long titles; pairs are those of the ratio all the same."""
    draw, words = random.Random(3), ["the", "of", "plant", "gene", "soil", "qu7", "x9"]
    titles = []
    for n in range(8):
        base = ["same beginning"] + [draw.choice(words) for _ in range(60 + 40 * n)]
        titles += [" ".join(base), " ".join([*base, "more"]), " ".join(w if draw.random() > 0.05 else "changed" for w in base), " ".join(base[: int(len(base) * 0.9)])]
    df = spark.createDataFrame([("q", i, t) for i, t in enumerate(titles)], "query_id string, id int, title string")
    ratio = lambda i, j: difflib.SequenceMatcher(None, titles[i], titles[j]).ratio()
    alike = lambda i, j: min(len(titles[i]), len(titles[j])) >= 0.8 * max(len(titles[i]), len(titles[j])) and titles[i] != titles[j] and titles[i][:12] == titles[j][:12]
    expected = {(i, j) for j in range(len(titles)) for i in range(j) if alike(i, j) and ratio(i, j) >= 0.94}
    assert all(dedupe._most(titles[i], titles[j]) >= ratio(i, j) for j in range(len(titles)) for i in range(j))
    pairs = dedupe.fuzzy_pairs(df)
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == expected and len(expected) > 5
    assert f"> {dedupe.LONG_KEY})" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_linked_clusters(spark):
    rows = [("q", "a", "10.1/x", "One title"), ("q", "b", "10.1/x", "Two title"), ("q", "c", None, "two TITLE"), ("q", "d", None, "else")]
    got = {r.id: r.cluster for r in dedupe.linked_clusters(spark.createDataFrame(rows, "query_id string, id string, doi string, title string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_ttl_hits_do_not_renew(spark):
    df = spark.createDataFrame([("u", t) for t in (0, 5, 9, 11, 12, 30)], "user string, at long")
    assert [tuple(r) for r in store.simulate_ttl(df, ["user"], "at", 10).collect()] == [("u", 6, 3)]


def test_table_round_trip(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), "id string, v int, at long", ["id"], "at")
    t.put(spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "id string, v int, at long"))
    t.put(spark.createDataFrame([("a", 3, 2)], "id string, v int, at long"))
    assert sorted(map(tuple, t.get().collect())) == [("a", 3, 2), ("b", 2, 1)] and t.count() == 2
    t.clear()
    assert t.count() == 0


def test_spans_and_highlight(spark):
    df = spark.createDataFrame([("x", "RNA-seq of mRNA and SARS-CoV-2", "BACKGROUND PE3 cuts DNA")], "id string, title string, abstract string")
    got = [(r.text, r.field, r.start) for r in entities.occurrences(df).orderBy("n", "i").collect()]
    assert got == [("RNA-seq", "title", 0), ("SARS-CoV-2", "title", 20), ("mRNA", "title", 11), ("PE3", "abstract", 11), ("DNA", "abstract", 20)]
    parts = df.select(entities.highlight(F.lit("abcdef"), F.expr("array(named_struct('start',1,'end',3), named_struct('start',2,'end',4), named_struct('start',5,'end',9))")).alias("p")).first().p
    assert [tuple(p) for p in parts] == [("a", False), ("bc", True), ("def", False)]


def test_partition_finds_two_groups():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.eye(4)[0] + 0.05 * rng.normal(size=(6, 4)), np.eye(4)[1] + 0.05 * rng.normal(size=(5, 4))])
    labels, k, score, reason = clusters.partition(x)
    assert k == 2 and reason == "" and score > 0.5 and len(set(labels[:6])) == len(set(labels[6:])) == 1
    assert clusters.partition(x[:4])[3] == "too few papers"


ABSTRACT = "We tested PE2 and PE3 in six cell types. Editing increased by 42% in neurons. Errors fell to 1.5% overall."


@pytest.mark.parametrize(
    ("summary", "kind"),
    [
        ("Editing increased by 42% in neurons.", None), ("Editing increased by 43% in neurons.", "fabricated_number"), ("Editing by XQ9 increased in neurons.", "fabricated_entity"),
        ("Editing decreased in neurons.", "contradicted_direction"), ("The first editing increased in neurons.", "overclaim"), ("Completely different words about astronomy.", "low_overlap"), ("", "format"),
    ],
)
def test_verdicts(spark, summary, kind):
    v = spark.createDataFrame([(summary, ABSTRACT)], "s string, a string").select(summaries.verdict(F.col("s"), F.col("a")).alias("v")).first().v
    assert (v.status == "grounded") == (kind is None)
    assert kind is None or kind in [i.kind for i in v.issues]


def test_unverifiable_without_abstract(spark):
    v = spark.createDataFrame([("x y z.", None)], "s string, a string").select(summaries.verdict(F.col("s"), F.col("a")).alias("v")).first().v
    assert v.status == "unverifiable" and v.issues == []


def test_policy_retries_then_falls_back(spark):
    df = spark.createDataFrame([(1, "T", ABSTRACT), (2, "Only a title", None)], "doc_id int, title string, abstract string")
    bad = {r.doc_id: r for r in summaries.summarise(df, lambda p: F.lit("Made of 99 lies.")).collect()}
    assert bad[1].origin == "extractive" and bad[1].attempts == 2 and bad[2].status == "unverifiable"
    mended = {r.doc_id: r for r in summaries.summarise(df, lambda p: F.when(p.contains("rejected"), "Editing increased in neurons.").otherwise("It rose by 99.")).collect()}
    assert mended[1].origin == "generated" and mended[1].attempts == 2 and mended[1].status == "grounded"


def test_models_and_their_fallbacks(spark):
    def broken():
        raise ImportError("not here")

    def failing():
        def encode(texts):
            raise ValueError("no answer")

        return encode

    one = models.Model("one", lambda: lambda texts: [[1.0] * 3 for _ in texts])
    got = models.choose([models.Model("a", broken), models.Model("b", failing), one], models.HASHING, ["x"])
    assert got.model.name == "one" and got.reasons == ("a: ImportError", "b: ValueError")
    assert models.choose([one], models.HASHING, ["x"], "two").reasons == ("two: unknown",)
    none = models.choose([models.Model("a", broken)], models.HASHING, ["x"])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["gene editing of genes", None, ""] * 30)], "doc_id int, text string")
    made = models.embed(rows, none).collect()
    assert {r.embedder for r in made} == {"hashing-256"} and all(abs(sum(x * x for x in r.vector) - (1 if r.text else 0)) < 1e-9 for r in made)
    made = models.embed(rows.withColumnRenamed("doc_id", "odd name"), got)
    assert made.columns == ["odd name", "text", "vector", "embedder"] and made.where("size(vector) <> 3").count() == 0


def test_providers(spark):
    known = {"stub": lambda key: models.Provider("stub", lambda prompt: (200, {}, key + prompt))}
    assert models.choose_provider("none", "k", known) is None and models.choose_provider("Stub ", None, known) is None and models.choose_provider("x", "k", known) is None
    prompts = spark.createDataFrame([("a",), ("b",)], "p string")
    said = lambda provider: [r.t for r in prompts.coalesce(1).orderBy("p").select(models.completion(provider)(F.col("p")).alias("t")).collect()]
    assert said(models.choose_provider("stub", "k", known)) == ["ka", "kb"]
    assert said(models.Provider("empty", lambda p: (200, {}, "  "))) == [None, None]
    assert said(models.Provider("spent", lambda p: (200, {}, "late") if p == "b" else (429, {"x-ratelimit-remaining": "0"}, None))) == [None, None]
    assert said(models.Provider("busy", lambda p: (200, {}, "late") if p == "b" else (429, {"x-ratelimit-remaining": "3"}, None))) == [None, "late"]
    assert said(models.Provider("denied", lambda p: (401, {}, None))) == [None, None]


def test_frozen_pool(spark, tmp_path):
    rows = [(q, i, f"id{i}", "t", ["k"], "2020-01-02", 3) for q in ("q1", "q 2/x") for i in range(3)]
    papers = spark.createDataFrame(rows, "query_id string, pos int, id string, title string, keywords array<string>, d string, citation_count bigint")
    papers = papers.withColumns({c: F.lit(None).cast("string") for c in ("doi", "abstract", "journal", "source", "publication_type")} | {"published_date": F.to_date("d")})
    store.write_pool(papers, f"{tmp_path}/pool")
    back = store.read_pool(spark, f"{tmp_path}/pool")
    columns = ["query_id", "pos", *store.POOL]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, papers.select(columns).collect()))


def test_longest_copied_run():
    draw = random.Random(3)
    for _ in range(50):
        a, b = ([draw.choice("xyz") for _ in range(draw.randrange(1, 12))] for _ in range(2))
        best = max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]), default=0)
        assert summaries._longest_run(a, b) == best


def test_corruptions_are_caught(spark):
    rows = [(i, "Editing of cells", ABSTRACT + " We measured many other outcomes across all of the tested conditions here.") for i in range(4)]
    c = attacks.cases(spark.createDataFrame(rows, "doc_id int, title string, abstract string"))
    v = c.withColumn("v", summaries.verdict(F.col("summary"), F.col("abstract")))
    missed = v.where("expected is not null and label not like 'recombination%' and not exists(v.issues, i -> i.kind = expected)")
    assert missed.count() == 0 and v.where("label = 'faithful' and v.status <> 'grounded'").count() == 0


def test_claims_are_welded_from_phrases(spark):
    abstract = "Gene editing of plant cells was studied by the whole group. It (and this) is. Rapid wound repair was seen in all of the young plants. Other labs then tested seed dormancy, cold and much more of it."
    made = {r.family: r.text for r in attacks.welded(spark.createDataFrame([(1, abstract), (2, "Too short. For this."), (3, None)], "doc_id int, abstract string")).collect()}
    assert set(made) == set(attacks.WELDS) and made["invented_causation"] == "The cause of wound repair turned out to be seed dormancy."
    same = "We saw plant growth here in all of the trials. " * 3
    assert attacks.welded(spark.createDataFrame([(1, same)], "doc_id int, abstract string")).count() == 0
    row = spark.createDataFrame([("Yield increased. It was lower (p = 1) due to cold.",)], "s string")
    got = row.select(attacks.turned(F.col("s"), F.lit("Yield increased")).alias("t"), attacks.turned(F.col("s"), F.lit("increased or decreased")).alias("n"), attacks.reworded(F.col("s")).alias("r")).first()
    assert got.t == "Yield decreased. It was lower (p = 1) due to cold." and got.n is None and got.r == "It was lower because of cold. Yield increased."


def reference_fold(records):
    """Clusters by index tables, as the rules are told: by DOI, by title, then the block's clusters in order."""
    import difflib

    from paperloom.functions import lexicon as L

    by_doi, by_title, by_block, clusters, out = {}, {}, {}, [], []

    def clear(doi, key, members):
        pre = lambda x: any(x.startswith(p) for p in L.PREPRINT_PREFIXES)
        return not doi or all(d is None or d == doi or ((pre(d) or pre(doi)) and key and key == k) for d, k in members)

    for doi, key in records:
        at = by_doi.get(doi) if doi else None
        if at is None and key:
            exact = by_title.get(key)
            if exact is not None and clear(doi, key, clusters[exact]):
                at = exact
            else:
                for c in by_block.get(key[:12], []):
                    like = any(k and min(len(k), len(key)) / max(len(k), len(key)) >= 0.8 and difflib.SequenceMatcher(None, key, k).ratio() >= 0.94 for _, k in clusters[c])
                    if clear(doi, key, clusters[c]) and like:
                        at = c
                        break
        if at is None:
            at = len(clusters)
            clusters.append([])
        clusters[at].append((doi, key))
        if doi:
            by_doi.setdefault(doi, at)
        if key:
            by_title.setdefault(key, at)
            if at not in by_block.setdefault(key[:12], []):
                by_block[key[:12]].append(at)
        out.append(at)
    return out


def test_fold_against_index_tables():
    draw = random.Random(11)
    keys = ["", "genome editing in maize plants and beyond the field of wheat", "genome editing in maize plants and beyond the field of what", "genome editing in maize plants and beyond a field of wheat", "genome editing in rice", "another title of a paper altogether"]
    dois = [None, None, "10.1/a", "10.1/b", "10.1101/x", "10.11013/y", "10.2139/z"]
    for _ in range(3000):
        rows = [(draw.choice(dois), draw.choice(keys)) for _ in range(draw.randrange(1, 9))]
        assert dedupe.assign(rows) == reference_fold(rows), rows


def test_preprint_prefixes_end_with_a_slash(spark):
    row = spark.createDataFrame([("10.1101/x", "10.5/y", "t"), ("10.11013/x", "10.21392/y", "t"), ("10.2139/x", "10.5/y", "")], "a string, b string, t string")
    assert [r.p for r in row.select(dedupe.preprint_pair(F.col("a"), F.col("b"), F.col("t"), F.col("t")).alias("p")).collect()] == [True, False, False]


def test_linked_clusters_without_keys(spark):
    rows = [("q", str(i), None, "") for i in range(300)] + [("q", f"c{i:03}", f"10.1/{i // 2}", f"chain link number {(i + 1) // 2} of them") for i in range(40)]
    got = {r.id: r.cluster for r in dedupe.linked_clusters(spark.createDataFrame(rows, "query_id string, id string, doi string, title string")).collect()}
    assert all(got[str(i)] == str(i) for i in range(300)) and len({got[f"c{i:03}"] for i in range(40)}) == 20


def test_too_large_exports_are_refused(spark):
    asked = spark.createDataFrame([(e, i, str(i)) for e, n in ((1, 500), (2, 501)) for i in range(n)], "export_id int, pos int, id string")
    paper = spark.createDataFrame([("1", "A title", "arxiv")], "id string, title string, source string").withColumns({c: F.lit(None).cast("string") for c in ("abstract", "doi", "volume", "issue", "pages", "publisher", "url", "publication_type", "journal")} | {"keywords": F.array().cast("array<string>"), "also_found_in": F.array().cast("array<string>"), "published_date": F.lit(None).cast("date"), "authors": F.array().cast("array<struct<name:string,given:string,family:string>>")})
    got = {r.export_id: r for r in export.export(asked, paper, "apa").collect()}
    assert got[1].missing == 499 and got[1].content and not got[1].refused and got[2].refused and got[2].content is None


def test_citation_details(spark):
    df = spark.createDataFrame(
        [(0, 0, "Gene_x & DNA repair", [("Wei A. Chen", "Wei A.", "Chen"), ("Big Group", None, None)], None, "2022-07-13", "crossref")] * 1 + [(0, i, "Gene repair", [("Wei Chen", "Wei", "Chen")], None, "2022-01-01", "arxiv") for i in range(1, 30)],
        "export_id int, pos int, title string, authors array<struct<name:string,given:string,family:string>>, journal string, d string, source string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("abstract", "doi", "volume", "issue", "pages", "publisher", "url", "publication_type")} | {"keywords": F.array().cast("array<string>"), "also_found_in": F.array().cast("array<string>"), "published_date": F.to_date("d")})
    keys = [r.cite_key for r in export.with_keys(df).orderBy("pos").collect()]
    assert keys[:4] == ["chen_genex_2022", "chen_gene_2022", "chen_gene_2022a", "chen_gene_2022b"] and keys[27] == "chen_gene_2022z" and keys[28] == "chen_gene_2022aa"
    first = export.citations(df, "bibtex").where("pos = 0").first().citation
    assert r"title = {Gene\_x \& {DNA} repair}" in first and "author = {Chen, Wei A. and {Big Group}}" in first and first.startswith("@misc{")
    assert export.citations(df, "apa").where("pos = 0").first().citation == "Chen, W. A., & Big Group (2022). Gene_x & DNA repair."
    assert export.citations(df, "vancouver").where("pos = 0").first().citation == "Chen WA, Big Group. Gene_x & DNA repair. 2022."
    with pytest.raises(ValueError):
        export.citations(df, "word")


def test_settings_guard():
    with pytest.raises(ValueError):
        Settings(alpha=1.5)
    with pytest.raises(ValueError):
        Settings(evidence_k=-1)
    assert Settings().fingerprint() != Settings(min_support=0.6).fingerprint()


def test_batched_queries_equal_single_ones(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    q = spark.read.parquet(f"{SMALL}/benchmark.parquet").selectExpr("item_id as query_id", "text").limit(3)
    batched = {(r.query_id, r.doc_id): round(r.bm25, 9) for r in rank.bm25(q, docs).collect()}
    for row in q.collect():
        single = {(r.query_id, r.doc_id): round(r.bm25, 9) for r in rank.bm25(spark.createDataFrame([row]), docs).collect()}
        assert single == {k: v for k, v in batched.items() if k[0] == row.query_id}


def test_order_of_rows_does_not_matter(spark):
    p = papers(spark, SMALL).select("doc_id", "title", "abstract")
    a, b = (sorted(map(tuple, summaries.extractive(x).collect())) for x in (p, p.orderBy(F.desc("doc_id"))))
    assert a == b


def test_dispatch_reaches_every_source(spark, monkeypatch):
    asked = query.parse(spark.createDataFrame([("a", "CRISPR")], "query_id string, raw string"))
    sources = spark.range(70).select(F.concat(F.lit("s"), "id").alias("source"), *[F.lit(True).alias(f"has_{k}") for k in ("doi", "arxiv", "pmid")])
    assert query.dispatch(asked, sources).select("source").distinct().count() == 70
    monkeypatch.setattr(query, "BROADCAST_ROWS", 10)  # beyond the bound of a broadcast nothing is lost either
    assert query.dispatch(asked, sources).select("source").distinct().count() == 70


STRATEGIES = ["retrieval", "unweighted", "semantic", "lexical", "linear", "rrf"]


def test_packed_evaluation_equals_ranked_rows(spark):
    """All strategies in one pass give the metrics of ranked rows, with ties, null, empty and wordless texts."""
    draw = random.Random(5)
    words = ["gene", "editing", "plant", "soil", "of", "x1", "root-tip", "Ünder", "a"]
    texts = [None, "", "!!", "gene editing", "gene editing"] + [" ".join(draw.choice(words) for _ in range(draw.randint(1, 30))) for _ in range(700)]
    docs = spark.createDataFrame([(draw.randint(0, 9) + 10 * (i * 7919 % 1000), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "gene editing of plant gene"), (2, "soil"), (3, ""), (4, "nowhere")], "query_id long, text string")
    grades = spark.createDataFrame([(r.doc_id, draw.choice([0, 0, 0, 2, 3])) for r in docs.orderBy("doc_id").collect()[::3]] + [(10**7, 3)], "doc_id long, grade int")
    lexical = rank.bm25(q, docs).withColumnRenamed("bm25", "lexical")
    semantic = rank.sparse_cosine(rank.hash_embedding(q, ["query_id"]), rank.hash_embedding(docs, ["doc_id"]))
    both = semantic.join(lexical, ["query_id", "doc_id"], "full").withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in ("lexical", "semantic")})
    scored = both.join(docs.select("doc_id", F.size(query.T.tokens(F.col("text"))).alias("n_tokens")), "doc_id").withColumn("pos", F.col("doc_id")).localCheckpoint()
    got = {(r.strategy, r.query_id, r.k): r for r in evaluation.evaluate(q, docs, grades, STRATEGIES).collect()}
    n = 0
    for strategy in STRATEGIES:
        for r in metrics.evaluate(rank.rank(scored, strategy).select("query_id", "doc_id", "rank"), grades).collect():
            own = got[strategy, r.query_id, r.k]
            assert all(own[c] == pytest.approx(r[c], abs=1e-9) for c in r.asDict()), (strategy, r, own)
            n += 1
    assert n == len(got) > 30
