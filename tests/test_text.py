from pyspark.sql import functions as F

from paperloom.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


def test_white_space_and_markup(spark):
    assert one(spark, " a\n\t b ", T.collapse_whitespace) == "a b"
    assert one(spark, "  ", T.collapse_whitespace) is None
    assert one(spark, None, T.collapse_whitespace) is None
    assert one(spark, "<jats:p>x &amp;lt; y</jats:p>", T.strip_markup) == "x < y"


def test_doi_spellings(spark):
    for x in ("https://doi.org/10.1000/ABC.", "doi:10.1000/abc", "10.1000/abc", "http://dx.doi.org/10.1000/Abc", "see 10.1000/abc);"):
        assert one(spark, x, T.normalize_doi) == "10.1000/abc"
    for x in ("", "no doi", "10.1/short-prefix", None):
        assert one(spark, x, T.normalize_doi) is None


def test_titles_fold(spark):
    assert one(spark, "Über die Naïve—Theorie.", T.normalize_title) == one(spark, "uber  DIE naive theorie", T.normalize_title)
    assert one(spark, None, T.normalize_title) == ""
    assert one(spark, "Ärzte ß", T.ascii_fold) == "Arzte "


def test_sentences(spark):
    assert one(spark, "As e.g. Smith et al. found. It works (well). Yes!", T.split_sentences) == ["As e.g. Smith et al. found.", "It works (well).", "Yes!"]
    assert one(spark, "See Fig. 2. Done.", T.count_sentences) == 2
    assert one(spark, "Abstract Motivation: In cells it fails. Results show that it heals.", T.abstract_sentences) == ["In cells it fails.", "Results show that it heals."]


def test_inverted_index_skips_bad_values(spark):
    assert one(spark, '{"b":[1],"a":[0,2],"c":"x"}', T.reconstruct_json_abstract) == "a b a"
    assert one(spark, "{}", T.reconstruct_json_abstract) is None
    assert one(spark, "nonsense", T.reconstruct_json_abstract) is None


def test_tokens_and_pairs(spark):
    assert one(spark, "The DNA-based X of a cell", T.tokens) == ["dna-based", "cell"]
    assert one(spark, ["a", "b", "c"], T.pairs, "array<string>") == ["a_b", "b_c"]
    assert one(spark, ["a"], T.pairs, "array<string>") == []


def test_markdown_and_stems(spark):
    assert one(spark, "- **a** `b` c_d", T.strip_markdown) == "a b c_d"
    assert one(spark, "..a b/ü-1.", T.safe_stem) == "a-b-ü-1"


def test_truncate(spark):
    assert one(spark, "alpha beta gamma", lambda x: T.truncate(x, 11)) == "alpha beta…"
    assert one(spark, "short", lambda x: T.truncate(x, 11)) == "short"


def test_dates(spark):
    def day(y, m, d):
        return str(spark.createDataFrame([(y, m, d)], "y string, m string, d string").select(T.date_from_parts(F.col("y"), F.col("m"), F.col("d"))).first()[0])

    assert day("2022", "Jul", "31") == "2022-07-28"
    assert day("2019", "Winter", None) == "2019-01-01"
    assert day("2019", "17", "0") == "2019-12-01"
    assert day("", "1", "1") == "None"
