"""Citation formats: BibTeX, RIS, APA and Vancouver, from paper records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import lexicon as L
from ..functions import text as T


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def escape(x: Column) -> Column:
    """LaTeX control signs escaped, each sign once."""
    table = F.create_map(*[F.lit(x) for kv in L.LATEX_ESCAPES.items() for x in kv])
    signs = F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
    return F.when(x.rlike(r"[\\{}&%$#_~^]"), F.array_join(signs, "")).otherwise(x)


def protect_case(x: Column) -> Column:
    """Words whose capitals carry meaning in braces, with the punctuation after them outside."""

    def one(word: Column) -> Column:
        core = F.regexp_replace(word, r"[.,;:)]+$", "")
        rest = F.substring(word, F.length(core) + 1, F.length(word))
        marked = core.rlike(L.PROTECTED_TOKEN) & F.substring(core, F.lit(2), F.length(core)).rlike("[A-Z0-9]") & ~word.startswith("{")
        return F.when(marked, F.concat(F.lit("{"), core, F.lit("}"), rest)).otherwise(word)

    return F.array_join(F.transform(F.split(x, " "), one), " ")


def page_range(x: Column) -> Column:
    """Two hyphens between pages, however many there were."""
    return F.regexp_replace(F.nullif(F.trim(x), F.lit("")), r"\s*-+\s*", "--")


def _authors(render) -> Column:
    return F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string,given:string,family:string>>")), render)


def all_sources() -> Column:
    return F.array_join(F.concat(F.array("source"), F.coalesce("also_found_in", F.array().cast("array<string>"))), "+")


def _some(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def entry_type(table: dict[str, str], preprint: str, journal: str, other: str) -> Column:
    known = _lookup(table, F.lower(F.trim("publication_type")))
    plain = F.when((F.col("source") == "arxiv") & ~_some(F.col("journal")), preprint).when(_some(F.col("journal")), journal).otherwise(other)
    return F.coalesce(known, plain)


def key_base() -> Column:
    """surname_word_year in plain ASCII."""
    first = F.try_element_at("authors", F.lit(1))
    surname = F.coalesce(first["family"], F.regexp_extract(first["name"], r"(\S+)\s*$", 1), F.lit(""))
    clean = lambda x: F.regexp_replace(F.lower(T.ascii_fold(x)), "[^a-z0-9]+", "")
    words = F.filter(F.transform(F.split(F.lower(T.ascii_fold(F.col("title"))), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]+", "")), lambda w: F.length(w) > 3)
    year = F.coalesce(F.year("published_date").cast("string"), F.lit("nodate"))
    parts = F.filter(F.array(clean(surname), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")), year), lambda p: p != "")
    return F.coalesce(F.nullif(F.array_join(parts, "_"), F.lit("")), F.lit("paper"))


def sign_of(code: Column) -> Column:
    """The sign with a code point. char() takes it modulo 256; UTF-16BE keeps U+FEFF, which UTF-32 reads as a mark."""
    digits = lambda n: F.unhex(F.lpad(F.hex(code), n, "0"))
    return F.when(code < 0x10000, F.decode(digits(4), "UTF-16BE")).otherwise(F.decode(digits(8), "UTF-32"))


def with_keys(papers: DataFrame) -> DataFrame:
    """papers with cite_key, unique within an export: repeats get a..z, then aa.. in order of pos.

    From the 703rd repeat on, the first letter is the next sign of Unicode after z, surrogates left out."""
    n = F.row_number().over(Window.partitionBy("export_id", "_base").orderBy("pos")) - 2
    code = F.lit(96) + F.floor(n / 26)
    code = F.when(code < 0xD800, code).otherwise(code + 0x800)
    letters = F.when(n < 26, F.char(F.lit(97) + n)).otherwise(F.concat(sign_of(code), F.char(F.lit(97) + n % 26)))
    return papers.withColumn("_base", key_base()).withColumn("cite_key", F.when(n < 0, F.col("_base")).otherwise(F.concat("_base", letters))).drop("_base")


def bibtex(settings: Settings = DEFAULTS) -> Column:
    """One entry; needs cite_key."""
    kind = entry_type(L.BIBTEX_TYPES, "misc", "article", "misc")
    names = F.array_join(_authors(lambda a: F.when(_some(a["family"]) & _some(a["given"]), F.concat(escape(a["family"]), F.lit(", "), escape(a["given"]))).otherwise(F.concat(F.lit("{"), escape(a["name"]), F.lit("}")))), " and ")
    line = lambda name, value: F.when(_some(value), F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))
    booked = kind.isin("incollection", "inproceedings")
    journal = protect_case(escape(F.col("journal")))
    month = F.element_at(T.words_in(L.MONTHS), F.coalesce(F.month("published_date"), F.lit(1)))
    lines = [
        line("title", protect_case(escape(F.col("title")))), line("author", names),
        F.when(booked, line("booktitle", journal)).otherwise(line("journal", journal)),
        line("year", F.year("published_date").cast("string")), line("volume", escape(F.col("volume"))), line("number", escape(F.col("issue"))),
        line("pages", escape(page_range(F.col("pages")))), line("publisher", escape(F.col("publisher"))), line("doi", escape(F.col("doi"))),
        line("url", escape(F.col("url"))), line("abstract", escape(F.col("abstract"))), line("keywords", escape(F.array_join("keywords", ", "))),
        line("note", escape(F.concat(F.lit(f"Retrieved via {settings.tool} from "), all_sources()))),
        F.when(F.col("published_date").isNotNull(), F.concat(F.lit("  month = "), month)),
    ]
    return F.concat(F.lit("@"), kind, F.lit("{"), F.col("cite_key"), F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def ris(settings: Settings = DEFAULTS) -> Column:
    """One record, lines ended by CR LF, with an empty one after it."""
    clean = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    tag = lambda name, value: F.when(_some(value), F.array(F.concat(F.lit(f"{name}  - "), value))).otherwise(F.array().cast("array<string>"))
    pages = F.trim("pages")
    sign = F.when(F.contains(pages, F.lit("--")), "--").when(F.contains(pages, F.lit("-")), "-").when(F.contains(pages, F.lit("–")), "–")
    start = F.trim(F.when(sign.isNull(), pages).otherwise(F.split_part(pages, sign, F.lit(1))))
    end = F.trim(F.when(sign.isNotNull(), F.substring(pages, F.instr(pages, sign) + F.length(sign), F.length(pages))))
    lines = F.flatten(F.array(
        tag("TY", entry_type(L.RIS_TYPES, "UNPB", "JOUR", "GEN")),
        _authors(lambda a: F.concat(F.lit("AU  - "), F.when(_some(a["family"]) & _some(a["given"]), F.concat(a["family"], F.lit(", "), a["given"])).otherwise(a["name"]))),
        tag("TI", clean(F.col("title"))), tag("T2", clean(F.col("journal"))), tag("JO", clean(F.col("journal"))), tag("AB", clean(F.col("abstract"))),
        tag("PY", F.year("published_date").cast("string")), tag("DA", F.date_format("published_date", "yyyy/MM/dd/")), tag("VL", F.col("volume")), tag("IS", F.col("issue")),
        tag("SP", start), tag("EP", end), tag("PB", clean(F.col("publisher"))), tag("DO", F.col("doi")), tag("UR", F.col("url")),
        F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.concat(F.lit("KW  - "), clean(k))),
        tag("DB", F.lit(settings.tool)), tag("DP", all_sources()),
    ))
    return F.concat(F.array_join(lines, "\r\n"), F.lit("\r\nER  - \r\n\r\n"))


def apa_name(a: Column) -> Column:
    family = F.coalesce(F.nullif(a["family"], F.lit("")), a["name"])
    short = T.initials(F.coalesce(a["given"], F.lit("")), ".", " ")
    return F.when(short == "", family).otherwise(F.concat(family, F.lit(", "), short))


def vancouver_name(a: Column) -> Column:
    family = F.coalesce(F.nullif(a["family"], F.lit("")), a["name"])
    short = T.initials(F.coalesce(a["given"], F.lit("")), "", "")
    return F.when(short == "", family).otherwise(F.concat(family, F.lit(" "), short))


def apa(settings: Settings = DEFAULTS) -> Column:
    names = _authors(apa_name)
    n = F.size(names)
    last = F.try_element_at(names, F.lit(-1))
    authors = (
        F.when(n == 0, "").when(n == 1, last)
        .when(n <= settings.apa_listed, F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), last))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, settings.apa_head), ", "), F.lit(", ... "), last))
    )
    year = F.coalesce(F.year("published_date").cast("string"), F.lit("n.d."))
    title = F.regexp_replace("title", r"\.+$", "")
    head = F.when(authors == "", F.concat(title, F.lit(". ("), year, F.lit(")."))).otherwise(F.concat(authors, F.lit(" ("), year, F.lit("). "), title, F.lit(".")))
    volume = F.when(_some(F.col("volume")), F.concat(F.lit(", "), "volume", F.when(_some(F.col("issue")), F.concat(F.lit("("), "issue", F.lit(")"))).otherwise("")))
    pages = F.when(_some(F.col("pages")), F.concat(F.lit(", "), "pages"))
    venue = F.when(_some(F.col("journal")), F.concat("journal", F.coalesce(volume, F.lit("")), F.coalesce(pages, F.lit("")), F.lit(".")))
    link = F.when(_some(F.col("doi")), F.concat(F.lit("https://doi.org/"), "doi")).otherwise(F.nullif(F.col("url"), F.lit("")))
    return F.concat_ws(" ", head, venue, link)


def vancouver(settings: Settings = DEFAULTS) -> Column:
    names = _authors(vancouver_name)
    most = settings.vancouver_listed
    authors = F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, ", et al").otherwise(""))
    title = F.regexp_replace("title", r"\.+$", "")
    head = F.concat(F.when(authors == "", F.lit("")).otherwise(F.concat(authors, F.lit(". "))), title, F.lit("."))
    year = F.year("published_date").cast("string")
    volume = F.when(_some(F.col("volume")), F.concat(F.lit(";"), "volume", F.when(_some(F.col("issue")), F.concat(F.lit("("), "issue", F.lit(")"))).otherwise("")))
    pages = F.when(_some(F.col("pages")), F.concat(F.lit(":"), "pages"))
    none = F.lit("")
    venue = F.when(_some(F.col("journal")), F.concat("journal", F.lit("."), F.coalesce(F.concat(F.lit(" "), year), none), F.coalesce(volume, none), F.coalesce(pages, none), F.lit("."))).otherwise(F.concat(year, F.lit(".")))
    return F.concat_ws(" ", head, venue, F.when(_some(F.col("doi")), F.concat(F.lit("doi:"), "doi")))


#: id: label, extension, column function.
FORMATS = {
    "bibtex": ("BibTeX", "bib", bibtex),
    "ris": ("RIS", "ris", ris),
    "apa": ("APA 7th", "txt", apa),
    "vancouver": ("Vancouver", "txt", vancouver),
}


def citations(papers: DataFrame, fmt: str, settings: Settings = DEFAULTS) -> DataFrame:
    """export_id, pos and citation. papers: records with export_id and pos."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    keyed = with_keys(papers) if fmt == "bibtex" else papers
    return keyed.select("export_id", "pos", FORMATS[fmt][2](settings).alias("citation"))


def document(cited: DataFrame, fmt: str) -> DataFrame:
    """export_id and content: an export's citations in order, numbered in Vancouver style."""
    number = F.row_number().over(Window.partitionBy("export_id").orderBy("pos"))
    text = F.concat(number.cast("string"), F.lit(". "), "citation") if fmt == "vancouver" else F.col("citation")
    between = {"ris": "", "vancouver": "\n"}.get(fmt, "\n\n")
    rows = cited.withColumn("citation", text).groupBy("export_id").agg(F.array_sort(F.collect_list(F.struct("pos", "citation"))).alias("c"))
    return rows.select("export_id", F.array_join(F.transform("c", lambda s: s["citation"]), between).alias("content"))


def export(requested: DataFrame, papers: DataFrame, fmt: str, settings: Settings = DEFAULTS) -> DataFrame:
    """export_id, content, missing and refused of requested ids (export_id, pos, id).

    A request for more than export_cap ids is refused as a whole: refused is true, content null, missing 0."""
    wanted = requested.groupBy("export_id").agg((F.count(F.lit(1)) > settings.export_cap).alias("refused"))
    asked = requested.join(wanted.where("not refused").select("export_id"), "export_id", "left_semi")
    found = asked.join(papers.drop("pos", "export_id"), "id")
    made = document(citations(found, fmt, settings), fmt)
    lost = asked.join(papers.select("id"), "id", "left_anti").groupBy("export_id").agg(F.count(F.lit(1)).alias("missing"))
    met = wanted.join(made, "export_id", "left").join(lost, "export_id", "left")
    return met.select("export_id", "content", F.coalesce("missing", F.lit(0)).alias("missing"), "refused")


def formats(spark) -> DataFrame:
    return spark.createDataFrame([(k, v[0], v[1]) for k, v in FORMATS.items()], "id string, label string, extension string")
