"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is dropped if the same or a similar line stands earlier (by doc_id, then position): one that is equal
or, for lines of NEAR_WORDS words and more, that becomes equal by replacing, adding or removing one word. A line
without a blank, as scripts that part no words have, counts its characters as words, from NEAR_CHARS on.

Equal lines are classes with a first occurrence. For similar ones each line emits every variant that lacks
one word as hashed keys: with the place of the gap, under which lines meet that differ in that word, and
without, under which a line meets the one that is a word shorter. Lines that share such a key are similar
whatever the group's size, so the smallest position under a key is all that is compared: no pairs are
emitted. Only lines that share their first or last half with another line can have a similar one, so the
others emit no variants. The earliest neighbour found is verified by the edit distance between the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import keep, release, sized
from .common import spread_join, spread_lookup

#: Lines of fewer words are never dropped; blank ones never are.
LEAST_WORDS = 1
#: From so many words, or characters of a line without a blank, on, lines that differ in one count as the same.
NEAR_WORDS, NEAR_CHARS = 8, 24
#: Lines up to this number (12 bytes each) are broadcast to the texts; with more, texts are shuffled.
JOIN_ROWS = 1_000_000
#: At most so many lines that very many others resemble are broadcast.
HOT_LINES = 10_000


def _packs(docs: DataFrame) -> bool:
    """Whether all doc_ids are whole numbers of 32 bits, so that one with a position (31 bits) is a number itself."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return False
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return least is None or (least >= 0 and most < 1 << 32)


def _split(docs: DataFrame, packed: bool) -> DataFrame:
    """at (doc_id and position, as one number if packed, which aggregates by hash; else a struct) and line of all lines."""
    split = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    at = F.shiftleft(F.col("doc_id").cast("bigint"), 31).bitwiseOR(F.col("pos").cast("bigint")) if packed else F.struct("doc_id", "pos")
    return split.select(at.alias("at"), "line")


def _placed(rows: DataFrame, docs: DataFrame, packed: bool) -> DataFrame:
    """doc_id and pos of rows' at."""
    if not packed:
        return rows.select("at.doc_id", "at.pos")
    doc_id = F.shiftright("at", 31).cast(docs.schema["doc_id"].dataType)
    return rows.select(doc_id.alias("doc_id"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("pos"))


def _described(split: DataFrame, least: int = 0) -> DataFrame:
    """at, line, its number of words (or characters) and chars (whether it is read by those) of all lines of so many words."""
    # A word ends at each blank; counting blanks needs no array of words.
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    lines = split.withColumn("blanks", blanks)
    if least:
        lines = lines.where((F.col("blanks") >= least - 1) & (F.ltrim("line", F.lit(" \t\r\f\x0b")) != ""))
    chars = F.col("blanks") == 0
    return lines.select("at", "line", F.when(chars, F.length("line")).otherwise(F.col("blanks") + 1).alias("words"), chars.alias("chars"))


def _words() -> Column:
    return F.when(F.col("chars"), F.split("line", "", -1)).otherwise(F.split("line", " ", -1))


def _halves() -> list[Column]:
    """Hashes of the first and of the last half of a line, cut for a partner that is as long or one word shorter."""
    half = "cast(ceil((words - {less}) / 2) as int)"
    cut = {"first": "if(chars, left(line, {half}), substring_index(line, ' ', {half}))", "last": "if(chars, right(line, {half}), substring_index(line, ' ', -{half}))"}
    return [
        F.expr(f"xxhash64('{side}', chars, {half}, {text.format(half=half)})".format(less=less))
        for side, text in cut.items()
        for less in (1, 2)
    ]


def _within_one(a: str, b: str) -> Column:
    """Whether two arrays of words are within one insertion, removal or replacement of a word."""

    def same(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(at == 0, F.least(F.size(x), F.size(y))).otherwise(at - 1)

    x, y = F.col(a), F.col(b)
    both = F.least(same(x, y) + same(F.reverse(x), F.reverse(y)), F.least(F.size(x), F.size(y)))
    return F.greatest(F.size(x), F.size(y)) - both <= 1


def _variants(lines: DataFrame) -> DataFrame:
    """own (the line's at), role and key of each deletion variant of the lines, and of the lines themselves.

    A variant's hash is the sum of hashes of its words with their places, in two independent halves of 84
    bits together; running sums give all variants of a line in one pass over its words.
    """
    words = lines.select("at", "words", "chars", F.posexplode(_words()).alias("i", "w"))
    for n in (1, 2):
        for name, shift in ((f"a{n}", 0), (f"b{n}", 1)):
            words = words.withColumn(name, F.shiftrightunsigned(F.xxhash64(F.lit(n), F.col("chars"), F.col("w"), F.col("i") - shift), 22))
    line = Window.partitionBy("at").orderBy("i")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Running sums from the start alone: a frame that ends with the line would be summed anew for each word.
    sums = words.select(
        F.col("at").alias("own"), "words", "i", "a1", "a2",
        *[(F.sum(f"a{n}").over(upto) - F.col(f"a{n}")).alias(f"p{n}") for n in (1, 2)],
        *[(F.sum(f"b{n}").over(whole) - F.sum(f"b{n}").over(upto)).alias(f"s{n}") for n in (1, 2)],
    )

    def key(role: str, size: Column, gap: Column, k1: Column, k2: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), size.alias("size"), gap.alias("gap"), k1.alias("k1"), k2.alias("k2"))

    none = F.lit(-1)
    replaced = key("R", F.col("words"), F.col("i"), F.xxhash64("p1", "s1"), F.xxhash64("p2", "s2"))
    longer = key("L", F.col("words") - 1, none, F.col("p1") + F.col("s1"), F.col("p2") + F.col("s2"))
    itself = key("W", F.col("words"), none, F.col("p1") + F.col("a1"), F.col("p2") + F.col("a2"))
    keys = F.when(F.col("i") == F.col("words") - 1, F.array(replaced, longer, itself)).otherwise(F.array(replaced, longer))
    return sums.select("own", F.explode(keys).alias("x")).select("own", "x.*")


def _earlier(variants: DataFrame) -> DataFrame:
    """own and the earliest line before it that shares a variant, for lines that have one."""
    key = ["size", "gap", "k1", "k2"]
    least = [F.min(F.when(F.col("role") == r, F.col("own"))).alias(r) for r in "RLW"]
    groups = keep(variants.groupBy(*key).agg(F.count(F.lit(1)).alias("met"), *least).where("met > 1"), "variants")
    other = F.when(F.col("role") == "R", F.col("R")).when(F.col("role") == "L", F.col("W")).otherwise(F.col("L"))
    met = spread_join(variants, groups, key, "met").select("own", other.alias("other")).where("other < own")
    return met.groupBy("own").agg(F.min("other").alias("other"))


def dropped_lines(docs: DataFrame, least: int = LEAST_WORDS, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id and pos (from 0) of the lines to drop. Distinct. Written to the shared folder."""
    packed = _packs(docs)
    split = _split(docs, packed)
    lines = _described(split, max(least, 1))
    long = F.col("words") >= F.when(F.col("chars"), near_chars).otherwise(near_words)
    sides = [f"half{n}" for n in range(4)]
    hashed = lines.select("at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), *[F.when(long, x).alias(c) for c, x in zip(sides, _halves(), strict=True)])
    classes = hashed.groupBy("h1", "h2").agg(F.min("at").alias("own"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in sides])
    classes = keep(classes, "lines")
    again = classes.where("n > 1").select("h1", "h2", "own", "n")
    same = spread_join(hashed.select("h1", "h2", "at"), again, ["h1", "h2"], "n").where("at <> own").select("at")
    halves = classes.where("half0 is not null").select("own", F.explode(F.array_distinct(F.array(*sides))).alias("half"))
    shared = keep(halves.groupBy("half").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "halves")
    likely = keep(spread_join(halves, shared, ["half"], "met").select(F.col("own").alias("at")).distinct(), "likely")
    likely = keep(_described(split.join(sized(likely, JOIN_ROWS), "at", "left_semi")).dropDuplicates(["at"]), "likely")
    found = keep(_earlier(_variants(likely)), "similar")
    word_lists = likely.select("at", _words().alias("words"))
    # A line that many others resemble is looked up by all of them.
    pairs = spread_lookup(found, word_lists.select(F.col("at").alias("other"), F.col("words").alias("y")), "other", found, HOT_LINES)
    pairs = pairs.join(word_lists.select(F.col("at").alias("own"), F.col("words").alias("x")), "own")
    similar = pairs.where(_within_one("x", "y")).select(F.col("own").alias("at"))
    gone = keep(_placed(same.union(similar).distinct(), docs, packed), "gone")
    release(classes, shared, likely, found)
    return gone


def _left(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (id, text, row) with text less the lines in gone (doc_id, pos), n_lines and n_dropped."""
    gone = gone.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    met = rows.join(gone, "id", "left")
    # A string of one sign a line, 1 where it goes, keeps the work in proportion to the number of lines.
    steps = F.zip_with("gone", F.concat(F.array(F.lit(-1)), F.slice("gone", F.lit(1), F.size("gone") - 1)), lambda at, last: F.concat(F.repeat(F.lit("0"), at - last - 1), F.lit("1")))
    lines = F.split("text", "\n", -1)
    left = F.zip_with(lines, F.split(F.array_join(steps, ""), ""), lambda line, sign: F.when(F.coalesce(sign, F.lit("0")) != "1", line))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return met.select("row", "id", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"))


def drop_lines(docs: DataFrame, gone: DataFrame, chars: str = "n_chars") -> DataFrame:
    """docs with text less the lines in gone (doc_id, pos). Of its other columns, whatever their names, only one called
    as `chars` says, if there is one, follows the text that lost lines, as its number of characters."""
    # The row goes along as one column, so that no name can clash.
    found = _left(docs.select(F.col("doc_id").alias("id"), "text", F.struct(*docs.columns).alias("row")), gone)
    follows = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row")[chars]) if chars in docs.columns else None
    new = {"text": F.col("text"), chars: follows}
    return found.select(*[(new[c].cast(docs.schema[c].dataType) if c in new and new[c] is not None else F.col("row")[c]).alias(c) for c in docs.columns])


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the text that is left.

    docs: doc_id, text; further columns are ignored. Lines stand between line feeds, words between single
    blanks. Blank lines and lines of fewer than `least` words always stay; lines of near_words words, or of
    near_chars characters without a blank, also go for a similar one. Null texts have no lines and stay null, empty
    ones have one line; a text all of whose lines are dropped becomes empty. Documents with a null doc_id
    take no part and stay whole. Rows that repeat a doc_id count as one document: lines at the same position
    count as one line, of which the copies stay or go together. An empty table gives no rows.
    Equal lines, half keys and variants are summed by key with partial sums, and groups of very many members are
    not dealt by key, so that a line that fills a third of the rows is one row from each task; memory is bounded by
    the longest text.
    """
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.lit(None).alias("row"))
    found = _left(rows, dropped_lines(docs.select("doc_id", "text"), least, near_words, near_chars))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", "text")
