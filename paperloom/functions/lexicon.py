"""Word lists, patterns and tables that results depend on."""

# Closed-class words that ranking and grounding skip.
RANKING_STOPWORDS = """
a an and are as at be been by for from had has have in into is it its of on or
that the their there these this to was were what when which who will with
""".split()

# General English words and abstract filler that query keywords skip.
QUERY_STOPWORDS = """
a about above after again against all also am an and any are as at be because been before
being below between both but by can cannot could did do does doing down during each few for
from further had has have having he her here hers herein him his how however i if in into is
it its itself just may me might more most must my no nor not of off on once only or other
ought our ours out over own same shall she should so some such than that the their theirs
them then there these they this those through to too under until up upon us very was we were
what when where whether which while who whom why will with within would you your yours
study studies result results show shows shown showed suggest suggests using used use based
approach approaches paper papers method methods finding findings conclusion conclusions
background objective objectives purpose data analysis significant significantly compared
""".split()

# Patterns.
TOKEN = r"[a-z0-9][a-z0-9\-]*"
KEYWORD = r"[A-Za-z][A-Za-z0-9\-]{1,}"
DOI = r"10\.\d{4,9}/[-._;()/:a-zA-Z0-9<>\[\]+]+"
NUMBER = r"\d+(?:[.,]\d+)*\s*%?"
ACRONYM = r"\b[A-Z][A-Za-z]*[A-Z0-9][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*\b"
PREFIXED_SYMBOL = r"\b[a-z]{1,4}[A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*\b"
SEQ_ASSAY = r"\b[A-Za-z][A-Za-z0-9]*-[Ss]eq\b"
SECTION_PREFIX = (
    r"^\s*(?i:abstract|background|objectives?|motivation|methods?|results?|conclusions?|"
    r"purpose|aims?|introduction|findings|interpretation|importance|significance|summary)"
    r"(?::\s*|\s+(?=[A-Z(]))"
)

# Spellings before a bare DOI.
DOI_PREFIXES = ["https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:"]
# Entities, in the order they are decoded.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#x2019;", "’"), ("&nbsp;", " ")]
# Abbreviations whose full stops end no sentence, for counting and for splitting.
COUNT_ABBREVIATIONS = ["et al.", "e.g.", "i.e.", "vs.", "cf.", "Fig.", "approx."]
SPLIT_ABBREVIATIONS = ["et al.", "e.g.", "i.e.", "vs.", "cf.", "Fig.", "approx.", "ca."]

# Prefixes of preprint DOIs.
PREPRINT_PREFIXES = ["10.1101/", "10.48550/", "10.21203/", "10.20944/", "10.26434/", "10.31234/", "10.31235/", "10.2139/"]
# Which source's record wins a merge.
SOURCE_PRIORITY = {"pubmed": 3, "crossref": 2, "arxiv": 1}

# Section labels and words that look like acronyms.
SECTION_LABELS = """
ABSTRACT AIM AIMS BACKGROUND CONCLUSION CONCLUSIONS DESIGN DISCUSSION FINDINGS FUNDING IMPORTANCE
INTERPRETATION INTERVENTION INTRODUCTION LIMITATIONS METHOD METHODS OBJECTIVE OBJECTIVES OUTCOME
OUTCOMES PARTICIPANTS PATIENTS PURPOSE RATIONALE RESULT RESULTS SETTING SIGNIFICANCE SUMMARY
""".split()
ACRONYM_STOPWORDS = "I A AND OR THE IN OF WE US IT AN AS AT BY".split()
ORG_SUFFIXES = "institute university hospital laboratory foundation college school centre center consortium agency ministry inc ltd gmbh".split()
DISCARDED_LABELS = "DATE TIME PERCENT MONEY QUANTITY ORDINAL CARDINAL LANGUAGE WORK_OF_ART LAW EVENT".split()
ENTITY_LABELS = "gene_or_protein disease chemical organism anatomy cell_type technical_term organization person location other".split()
SCIENTIFIC_LABELS = ENTITY_LABELS[:7]
# Labels of tagging models, as entity labels; others are "other".
RAW_LABELS = {
    "DISEASE": "disease", "CANCER": "disease", "CHEMICAL": "chemical", "SIMPLE_CHEMICAL": "chemical",
    "GENE_OR_GENE_PRODUCT": "gene_or_protein", "AMINO_ACID": "gene_or_protein", "PROTEIN": "gene_or_protein",
    "GGP": "gene_or_protein", "ORGANISM": "organism", "TAXON": "organism", "ORGANISM_SUBDIVISION": "anatomy",
    "ANATOMICAL_SYSTEM": "anatomy", "TISSUE": "anatomy", "ORGAN": "anatomy", "CELL": "cell_type",
    "CELL_TYPE": "cell_type", "CELL_LINE": "cell_type", "CELLULAR_COMPONENT": "cell_type", "ENTITY": "other",
    "ORG": "organization", "PERSON": "person", "GPE": "location", "LOC": "location", "NORP": "other",
    "PRODUCT": "technical_term", "FAC": "location",
}

# Grounding.
ANTONYMS = [
    ("increase", "decrease"), ("increased", "decreased"), ("increases", "decreases"), ("higher", "lower"),
    ("greater", "smaller"), ("improve", "worsen"), ("improved", "worsened"), ("improves", "worsens"),
    ("more", "less"), ("gain", "loss"), ("upregulated", "downregulated"), ("positive", "negative"),
    ("effective", "ineffective"), ("significant", "insignificant"), ("faster", "slower"), ("reduced", "elevated"),
]
OVERCLAIMS = """
first novel unprecedented breakthrough revolutionary proves proven proof cures cure definitive conclusively
guarantees guaranteed always never best superior optimal groundbreaking landmark
""".split()
FINDING_MARKERS = ["we found", "we show", "we demonstrate", "results", "here we", "conclusion", "we report", "our findings", "these results"]

# Citation formats.
LATEX_ESCAPES = {
    "\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_",
    "~": r"\textasciitilde{}", "^": r"\textasciicircum{}",
}
BIBTEX_TYPES = {
    "journal-article": "article", "journal article": "article", "proceedings-article": "inproceedings",
    "conference paper": "inproceedings", "book-chapter": "incollection", "book": "book", "monograph": "book",
    "edited-book": "book", "reference-entry": "incollection", "dissertation": "phdthesis", "report": "techreport",
    "posted-content": "misc", "preprint": "misc",
}
RIS_TYPES = {
    "journal-article": "JOUR", "journal article": "JOUR", "proceedings-article": "CONF", "conference paper": "CONF",
    "book-chapter": "CHAP", "book": "BOOK", "monograph": "BOOK", "edited-book": "BOOK", "reference-entry": "CHAP",
    "dissertation": "THES", "report": "RPRT", "posted-content": "UNPB", "preprint": "UNPB",
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
PROTECTED_TOKEN = r"^[A-Za-z]*[A-Z0-9][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*[.,;:]?$"

# Publication types of the works index that are asked for, and that are dropped.
ALLOWED_TYPES = "journal-article posted-content proceedings-article book-chapter monograph reference-entry report dissertation".split()
EXCLUDED_TYPES = """
peer-review component grant dataset standard journal journal-issue journal-volume book-series book-set proceedings
proceedings-series report-series
""".split()
SEASONS = {"spring": 4, "summer": 7, "fall": 10, "autumn": 10, "winter": 1}
