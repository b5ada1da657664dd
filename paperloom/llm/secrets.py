"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Runs of 20 and more letters, digits and + / _ = - that no fixed pattern covers are tested. The encoding is
inferred from the symbols used (letters alone, hexadecimal, also with the dashes of a UUID, base32, lower-case
base36, base62 or base64). The battery has three statistics: the chi-squared statistic of uniformity over the
encoding's alphabet, the number of runs of symbols of one class, and the serial correlation of neighbours. Each is
asked twice. Under randomness they must not be rejected together. Under ordinary text, as it stands in all
documents outside such runs (so that a document of keys only doesn't count as ordinary), each has a p-value; the
three are combined by Cauchy's rule, which holds for tests that depend on each other.

The Benjamini-Hochberg threshold over the combined p-values of all tested runs of all documents, weighted by
length (with a mean weight of 1) because long runs can be told apart better, decides which are reported.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import keep
from .common import batch, texts

KINDS = ("assign", "access", "hex", "random")
#: Share of false discoveries among the reported random runs.
FALSE_DISCOVERIES = 0.01
#: Least length of a tested run, and least combined p-value under randomness.
TESTED_CHARS = 20
RANDOM_P = 0.01

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_VOWELS = b"aeiouAEIOU"
#: A UUID's shape.
_UUID = re.compile(rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Classes of symbols: 1 digits, 2 lower case, 3 upper case, 4 others; and of letters: 1 vowels, 2 others.
_CLASS, _SOUND = np.zeros(256, np.int8), np.zeros(256, np.int8)
_CLASS[list(_SYMBOLS[52:])], _CLASS[list(_SYMBOLS[26:52])], _CLASS[list(_SYMBOLS[:26])], _CLASS[list(b"+/_=-")] = 1, 2, 3, 4
_SOUND[list(_SYMBOLS[:52])] = 2
_SOUND[list(_VOWELS)] = 1
#: Letters of ordinary prose in 1,000, and of 1,000 pairs of neighbours those of two classes and of letters
#: those of one sound, which count besides those of the documents.
_PROSE_PAIRS = (1000, 30, 1000, 350)
_PROSE = dict(zip(b"etaoinshrdlcumwfgypbvkjxqz", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1), strict=True))
_IN_RUN = np.zeros(256, bool)
_IN_RUN[list(_SYMBOLS + b"+/_=-")] = True


def _runs(raw: bytes, least: int) -> list[tuple[int, int]]:
    """Byte ranges of maximal runs of token symbols of `least` and more."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _IN_RUN[np.frombuffer(raw, np.uint8)]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution, by the cube-root approximation."""
    return _normal_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def inferred_alphabet(run: bytes) -> bytes:
    """The alphabet of the encoding that a run seems to be in; empty for numbers."""
    used = set(run)
    digits, lower, upper = (bool(used & set(x)) for x in (_SYMBOLS[52:], _SYMBOLS[26:52], _SYMBOLS[:26]))
    if not (lower or upper):
        return b""
    if not digits and used <= set(_SYMBOLS[:52]):
        return _SYMBOLS[26:52] if not upper else _SYMBOLS[:26] if not lower else _SYMBOLS[:52]
    for alphabet in (b"0123456789abcdef", b"0123456789ABCDEF", _SYMBOLS[:26] + b"234567", _SYMBOLS[52:] + _SYMBOLS[26:52], _SYMBOLS[52:] + _SYMBOLS[:26], _SYMBOLS):
        if used <= set(alphabet):
            return alphabet
    return _SYMBOLS + (b"-_" if used & set(b"-_") else b"+/")


def _chi_squared(run: bytes, m: int) -> float:
    """The statistic of uniformity over an alphabet of m symbols."""
    seen = np.bincount(np.frombuffer(run, np.uint8), minlength=256)
    return float((seen.astype(float) ** 2).sum()) * m / len(run) - len(run)


def randomness(run: bytes, alphabet: bytes) -> float:
    """Combined p-value of the battery under the hypothesis that symbols are independent and uniform."""
    n, m = len(run), len(alphabet)
    place = np.zeros(256)
    place[list(alphabet)] = np.arange(m)
    x = place[np.frombuffer(run, np.uint8)]
    uniform = _chi2_tail(max(_chi_squared(run, m), 0.0), m - 1)
    high = x > (m - 1) / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a == 0 or b == 0:
        return 0.0
    mean = 2 * a * b / n + 1
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    turns = 2 * _normal_tail(abs(int((high[1:] != high[:-1]).sum()) + 1 - mean) / spread)
    centred = x - x.mean()
    power = float((centred**2).sum())
    serial = 2 * _normal_tail(abs(float((centred[1:] * centred[:-1]).sum()) / power * math.sqrt(n))) if power else 0.0
    stat = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, turns, serial))
    return math.exp(-stat / 2) * (1 + stat / 2 + stat**2 / 8)  # upper tail with six degrees of freedom


def _binomial_tail(x: int, n: int, q: float) -> float:
    """The chance of x and more of n."""
    if x <= 0:
        return 1.0
    if n > 1000:
        return _normal_tail((x - 0.5 - n * q) / math.sqrt(n * q * (1 - q)))
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(q) + (n - k) * math.log1p(-q)
    return min(math.fsum(math.exp(log(k)) for k in range(x, n + 1)), 1.0)


class Ordinary:
    """What ordinary text is like: shares of symbols, and how often neighbours differ in class and are of one sound."""

    def __init__(self, seen: np.ndarray):
        """seen: as ordinary_counts() gives them, summed."""
        own = np.bincount(np.frombuffer(_SYMBOLS, np.uint8), minlength=256) * 0.5
        own[list(_PROSE)] += list(_PROSE.values())
        self.share = (seen[:256] + own) / (seen[:256] + own).sum()
        pairs, turns, letters, same = (seen[256:] + np.array(_PROSE_PAIRS)).tolist()
        self.turn, self.same = turns / pairs, same / letters

    def p(self, run: bytes, alphabet: bytes) -> float:
        """Combined p-value of the battery under ordinary text: how likely that is as uniform, turns as often and
        follows itself as little."""
        n, m = len(run), len(alphabet)
        q2, q3 = float((self.share**2).sum()), float((self.share**3).sum())
        pairs = n * (n - 1) / 2
        # The chi-squared statistic rises in proportion to the number of pairs of equal symbols.
        equal = (_chi_squared(run, m) + n) / m * n / 2 - n / 2
        spread = math.sqrt(pairs * q2 * (1 - q2) + pairs * (n - 2) * 2 * (q3 - q2**2)) or 1e-9
        raw = np.frombuffer(run, np.uint8)
        classes, sounds = _CLASS[raw], _SOUND[raw]
        letters = (sounds[1:] > 0) & (sounds[:-1] > 0)
        found = [
            _normal_tail((pairs * q2 - equal) / spread),
            _binomial_tail(int((classes[1:] != classes[:-1]).sum()), n - 1, self.turn),
            _binomial_tail(int((letters & (sounds[1:] == sounds[:-1])).sum()), int(letters.sum()), self.same),
        ]
        # Cauchy's rule; tan((1/2 - p) pi) is 1 / (p pi) where p is small. A test that can't tell (p = 1) has no veto.
        total = sum(1 / (max(p, 1e-300) * math.pi) if p < 1e-8 else math.tan((0.5 - min(p, 0.9)) * math.pi) for p in found) / 3
        return 1 / (total * math.pi) if total > 1e8 else 0.5 - math.atan(total) / math.pi


def _base(text: str, raw: bytes, point) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for start, end in _runs(raw, min(LEAST["access"], LEAST["hex"])):
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            for m in pattern.finditer(raw, start, end):
                if m.end() - m.start() >= LEAST[KINDS[kind]]:
                    found.append((point(m.start()), kind, point(m.end())))
    return sorted(found)


def _tested(raw: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """Start and end, symbols and alphabet of the runs that may be keys."""
    found = []
    for start, end in _runs(raw, TESTED_CHARS):
        run = raw[start:end].rstrip(b"=")
        end = start + len(run)
        if _UUID.fullmatch(run):
            run = run.replace(b"-", b"")
        alphabet = inferred_alphabet(run)
        if len(run) >= TESTED_CHARS and alphabet:
            found.append((start, end, run, alphabet))
    return found


def ordinary_counts(text: str) -> np.ndarray:
    """Of a text outside the runs that may be keys: how often each byte of token symbols stands there, and of the pairs
    of neighbours their number, those of two classes, those of two letters, and of these those of one sound."""
    raw = text.encode("utf-8", "surrogatepass")
    x = np.frombuffer(raw, np.uint8)
    inside = _IN_RUN[x]
    for start, end, _, _ in _tested(raw):
        inside[start:end] = False
    both = inside[1:] & inside[:-1]
    classes, sounds = _CLASS[x], _SOUND[x]
    letters = both & (sounds[1:] > 0) & (sounds[:-1] > 0)
    more = [both.sum(), (both & (classes[1:] != classes[:-1])).sum(), letters.sum(), (letters & (sounds[1:] == sounds[:-1])).sum()]
    return np.concatenate((np.bincount(x[inside], minlength=256), more))


def scan(text: str, ordinary: Ordinary | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]], int, int]:
    """Base spans (start, kind, end), random-looking runs (start, end, symbols, p-value under ordinary text), how many
    runs were tested and their symbols. ordinary: by default what this text is like."""
    raw = text.encode("utf-8", "surrogatepass")
    points = None

    def point(at: int) -> int:
        nonlocal points
        if len(raw) == len(text):
            return at
        if points is None:
            points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        return int(points[at])

    base = _base(text, raw, point)
    found, tested, symbols = [], 0, 0
    for start, end, run, alphabet in _tested(raw):
        a, b = point(start), point(end)
        if any(s < b and a < e for s, _, e in base):
            continue
        tested += 1
        symbols += len(run)
        if ordinary is None:
            ordinary = Ordinary(ordinary_counts(text))
        if randomness(run, alphabet) >= RANDOM_P:
            found.append((a, b, len(run), ordinary.p(run, alphabet)))
    return base, found, tested, symbols


def _weighted(run: Column, mean: float) -> Column:
    """A run's p-value over its weight, which is its length against the mean one."""
    return F.greatest(run["p"] * F.lit(mean) / run["n"], F.lit(1e-40))


def _threshold(scanned: DataFrame) -> tuple[float, float]:
    """The Benjamini-Hochberg threshold of weighted p-values over all tested runs, from a histogram of at most 400
    classes, and the mean length."""
    tested, symbols = scanned.agg(F.sum("n_tested"), F.sum("n_symbols")).first()
    if not tested:
        return 0.0, 1.0
    mean = symbols / tested
    p = _weighted(F.col("c"), mean)
    classes = scanned.select(F.explode("runs").alias("c")).groupBy(F.floor(F.log10(p) * -10).alias("k")).count().collect()
    above, best = 0, 0.0
    for k, n in sorted(classes, reverse=True):
        above += n
        bound = 10 ** (-k / 10)
        if tested * bound <= FALSE_DISCOVERIES * above:
            best = bound
    return best, mean


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    docs: doc_id, text; further columns are ignored. Null and empty texts have no spans; repeated rows stay;
    an empty table gives no rows. Spans are kind:start:end in code points, end exclusive, by start, then kind,
    comma-joined; base_sha256 is of the base ones. Each text is read whole, once for what ordinary text is like
    (260 sums) and once for the scan, whose result, some bytes a document, is kept in the shared folder; the
    threshold comes from a small histogram of it. Runs of fewer than TESTED_CHARS symbols are not tested for
    randomness, as ordinary words of that length can't be told from keys.
    """
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    run = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n", pa.int64()), ("p", pa.float64())])
    schema = pa.schema([("base", pa.list_(span)), ("base_sha256", pa.string()), ("runs", pa.list_(run)), ("n_tested", pa.int64()), ("n_symbols", pa.int64())])

    def scan_all(batches):
        for part in batches:
            rows = []
            for text in part.column(1):
                base, runs, tested, symbols = scan(text.as_py(), ordinary)
                said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
                rows.append((
                    [{"start": a, "kind": k, "end": b} for a, k, b in base],
                    hashlib.sha256(said.encode()).hexdigest(),
                    [{"start": a, "end": b, "n": n, "p": p} for a, b, n, p in runs],
                    tested, symbols,
                ))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([part.column(0), *batch(dict(zip(schema.names, cols, strict=True)), schema).columns], names=["doc_id", *schema.names])

    def count_all(batches):
        seen = np.zeros(260, np.int64)
        for part in batches:
            for text in part.column(0):
                seen += ordinary_counts(text.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(260)), pa.array(seen)], names=["at", "n"])

    source = texts(docs)
    seen = np.zeros(260, np.int64)
    for at, n in source.select("text").mapInArrow(count_all, "at bigint, n bigint").groupBy("at").agg(F.sum("n")).collect():
        seen[at] = n
    ordinary = Ordinary(seen)
    kind = "base array<struct<start:bigint,kind:int,end:bigint>>, base_sha256 string, runs array<struct<start:bigint,end:bigint,n:bigint,p:double>>, n_tested bigint, n_symbols bigint"
    scanned = keep(source.mapInArrow(scan_all, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {kind}"), "secrets")
    bound, mean = _threshold(scanned)
    more = F.transform(F.filter("runs", lambda r: _weighted(r, mean) <= bound), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    said = F.transform(F.array_sort(F.concat("base", more)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return scanned.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), "base_sha256",
        F.array_join(said, ",").alias("spans"), F.size(more).cast("bigint").alias("n_random"),
    )
