"""Token ids in files, compressed by a Re-Pair grammar for each block of a shard.

A shard holds a range of doc_ids in ascending order, as blocks of whole documents, each with a grammar of its
own, so that it is decoded without other blocks. In a block the most frequent pairs of neighbouring symbols are
replaced by new symbols, again and again, until no pair is left that occurs PAIR_COUNT times; a round replaces all
such pairs, where they meet the more frequent one. Pairs never cross a document's end. The file keeps the rules,
the length that each rule expands to and the symbols left, in as many bits as they need, so that any document,
and any position in it, is decoded without its neighbours.

File format: Parquet rows (shard, block, start, n_tokens, doc_ids, sizes, payload), so that Spark's commit
protocol covers lost and repeated tasks. start counts from the shard's first id; sizes are ids per document.
payload, little-endian: magic "RPG2"; u32 lowest rule symbol, rules, symbols, documents, bits per symbol;
then rules as u32 pairs, their expansion lengths as u32, symbols per document as u32, and the symbols, one after
another from each byte's highest bit on, the highest bit of a symbol first.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import work_path
from .bpe import byte_letters
from .common import batch, texts

MAGIC = b"RPG2"
#: Ids after which a block ends with the document at hand; bounds a task's memory together with the longest document.
BLOCK_IDS = 1_000_000
#: A pair is worth a rule, which takes twelve bytes, from this count on: a replaced pair saves about two bytes, and with
#: 8 the files of sf0.1 are smaller than with 6, 10 or 12.
PAIR_COUNT = 8
CACHE_CHUNKS = 700_000
#: Characters that are split and encoded at once, unless one text has more.
SLICE_BYTES = 10_000_000

_HEAD = struct.Struct("<4s5I")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: UTF-8 of words of a-z and of the small letters from U+00DF to U+00FF, which no normal form changes.
_SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


class Grammar:
    """The rules of one block: symbol lowest + n stands for the pair rules[n]."""

    def __init__(self, lowest: int, rules: np.ndarray, lengths: np.ndarray):
        self.lowest, self.rules, self.lengths = lowest, rules, lengths
        self._pool: np.ndarray | None = None

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rules one after another, and where each rule's begin."""
        starts = np.concatenate(([0], np.cumsum(self.lengths)))
        if self._pool is None:
            self._pool = pool = np.empty(int(starts[-1]), np.uint32)
            # Rules by depth: the two symbols of a rule are expanded before it.
            inner = self.rules >= self.lowest
            child = np.where(inner, self.rules.astype(np.int64) - self.lowest, 0)
            depth = np.zeros(len(self.rules), np.int32)
            while True:
                deeper = np.where(inner, depth[child] + 1, 0).max(1, initial=0)
                if (deeper == depth).all():
                    break
                depth = deeper
            size = np.where(inner, self.lengths[child], 1)
            to = np.stack((starts[:-1], starts[:-1] + size[:, 0]), 1)
            for level in range(int(depth.max(initial=-1)) + 1):
                here = (depth == level)[:, None]
                plain, composed = here & ~inner, here & inner
                pool[to[plain]] = self.rules[plain]
                n = size[composed]
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                pool[np.repeat(to[composed], n) + place] = pool[np.repeat(starts[child[composed]], n) + place]
        return self._pool, starts

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for."""
        out = np.ones(len(symbols), np.int64)
        above = symbols >= self.lowest
        out[above] = self.lengths[symbols[above].astype(np.int64) - self.lowest]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols."""
        pool, starts = self._expanded()
        whole = np.concatenate((np.arange(self.lowest, dtype=np.uint32), pool))
        first = np.concatenate((np.arange(self.lowest), starts[:-1] + self.lowest)).astype(np.int32)
        size = np.concatenate((np.ones(self.lowest, np.int32), self.lengths.astype(np.int32)))[symbols]
        ends = np.cumsum(size, dtype=np.int32)
        return whole[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(first[symbols] - (ends - size), size)]


def _packed(symbols: np.ndarray, bits: int) -> bytes:
    """Symbols of so many bits each, one after another."""
    parts = []
    for at in range(0, len(symbols), 1 << 18):  # a multiple of eight symbols fills whole bytes
        wide = symbols[at : at + (1 << 18)].astype(">u4").view(np.uint8).reshape(-1, 4)
        parts.append(np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes())
    return b"".join(parts)


def _unpacked(raw: np.ndarray, count: int, bits: int) -> np.ndarray:
    """The symbols of _packed()."""
    out = np.empty(count, np.uint32)
    step = 1 << 18
    for at in range(0, count, step):
        n = min(step, count - at)
        first = at * bits // 8
        some = np.unpackbits(raw[first : first + (n * bits + 7) // 8], count=n * bits).reshape(n, bits)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, 32 - bits :] = some
        out[at : at + n] = np.packbits(wide, axis=1).view(">u4")[:, 0]
    return out


class _Pairs:
    """The symbols of one block, linked to their neighbours, and the places where a pair may still get a rule.

    A place is where a symbol stands; its pair is that symbol and the next one of the document. What is replaced never
    makes a pair of two older symbols more frequent, so after the first round only pairs that were frequent in the last
    one and pairs beside a replaced one are counted again, with the same result as counting all."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        n = len(ids)
        self.symbols = ids.astype(np.uint32)
        self.alive = np.ones(n, bool)
        #: Places of the neighbours; n beyond a document's ends.
        self.after, self.before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        ends = np.cumsum(sizes)
        self.after[ends - 1] = n
        self.before[ends - sizes] = n
        self.none = np.int32(np.iinfo(np.int32).max)
        self.rank = np.full(n + 1, self.none, np.int32)  # of the frequent pair at each place
        self.mark = np.zeros(n + 1, bool)
        self.active = np.flatnonzero(self.after[:n] < n)

    def _frequent(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that occur PAIR_COUNT times, the most frequent first; the places of each, with its rank and whether
        the place counts. bits: of the largest symbol."""
        at = self.active
        left, right = self.symbols[at].astype(np.uint64), self.symbols[self.after[at]].astype(np.uint64)
        counts = np.ones(len(at), bool)
        # Of a run of one symbol, every other pair counts.
        same = np.flatnonzero(left == right)
        if len(same):
            run = at[same]
            first = np.concatenate(([True], self.after[run[:-1]] != run[1:]))
            step = np.arange(len(same))
            counts[same[(step - np.maximum.accumulate(np.where(first, step, 0))) % 2 == 1]] = False
        code = left << np.uint64(bits) | right
        if len(at) > 1 << 16:  # only pairs whose 20-bit hash is frequent are sorted
            slot = ((code * _SPREAD) >> np.uint64(44)).astype(np.int32)
            often = np.bincount(slot if counts.all() else slot[counts], minlength=1 << 20) >= PAIR_COUNT
            some = np.flatnonzero(often[slot])
            at, code, counts = at[some], code[some], counts[some]
        places = len(at).bit_length()
        if 2 * bits + places <= 64:  # with its place behind it, a pair is sorted without an index
            code = np.sort(code << np.uint64(places) | np.arange(len(at), dtype=np.uint64))
            order = (code & np.uint64((1 << places) - 1)).astype(np.int32)
            code >>= np.uint64(places)
        else:
            order = np.argsort(code, kind="stable")
            code = code[order]
        at, counts = at[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(at) else order
        size = np.diff(starts, append=len(at))
        count = size if counts.all() else np.add.reduceat(counts, starts, dtype=np.int64)
        often = np.flatnonzero(count >= PAIR_COUNT)
        found = code[starts[often]]
        pairs = (found >> np.uint64(bits)) << np.uint64(32) | found & np.uint64((1 << bits) - 1)
        # Equal counts go by a hash: in the order of symbols, each pair of a rising row would wait for the one before it.
        sort = np.lexsort((pairs * _SPREAD, -count[often]))
        rank = np.full(len(starts), -1, np.int32)
        rank[often[sort]] = np.arange(len(often), dtype=np.int32)
        ranks = np.repeat(rank, size)
        met = ranks >= 0
        return pairs[sort], at[met], ranks[met], counts[met]

    def round(self, lowest: int) -> np.ndarray:
        """Replaces frequent pairs by the symbols from lowest on and returns them in this order; none if none is left.
        Pairs that overlap are replaced where the more frequent one is."""
        if not len(self.active):
            return np.empty(0, np.uint64)
        pairs, frequent, ranks, counts = self._frequent(max(lowest - 1, 1).bit_length())
        at, mine = frequent[counts], ranks[counts]
        self.rank[at] = mine
        take = (mine < self.rank[self.before[at]]) & (mine <= self.rank[self.after[at]])
        self.rank[at] = self.none
        at, mine = at[take], mine[take]
        uses = np.bincount(mine, minlength=len(pairs))
        # What a more frequent pair left too few of waits for the next round; the first one keeps all its places.
        kept = np.flatnonzero(uses >= PAIR_COUNT)
        new = np.full(len(pairs), -1, np.int64)
        new[kept] = np.arange(len(kept))
        number = new[mine]
        at, number = at[number >= 0], number[number >= 0]
        gone = self.after[at]
        self.symbols[at] = (lowest + number).astype(np.uint32)
        self.after[at] = self.after[gone]
        self.before[self.after[at]] = at
        self.alive[gone] = False
        n = len(self.alive)
        self.mark[frequent] = self.mark[at] = self.mark[self.before[at]] = True
        self.mark[gone] = self.mark[n] = False
        self.active = np.flatnonzero(self.mark)
        self.mark[self.active] = False
        self.active = self.active[self.after[self.active] < n]
        return pairs[kept]


def compress(ids: np.ndarray, sizes: np.ndarray, lowest: int) -> bytes:
    """The payload of one block. ids: below lowest; sizes: ids of each document, at least 1."""
    block = _Pairs(ids, np.asarray(sizes, np.int64))
    rules: list[np.ndarray] = []
    length = np.ones(lowest, np.uint32)
    while True:
        pairs = block.round(len(length))
        if not len(pairs):
            break
        rules.append(np.stack((pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)), 1).astype(np.uint32))
        length = np.concatenate((length, length[rules[-1]].sum(1, dtype=np.uint32)))
    made = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    symbols = block.symbols[block.alive]
    last = block.after[:-1][block.alive] == len(block.alive)
    per_doc = np.diff(np.concatenate(([-1], np.flatnonzero(last)))).astype("<u4")
    bits = max(len(length) - 1, 1).bit_length()
    head = _HEAD.pack(MAGIC, lowest, len(made), len(symbols), len(sizes), bits)
    return b"".join((head, made.astype("<u4").tobytes(), length[lowest:].astype("<u4").tobytes(), per_doc.tobytes(), _packed(symbols, bits)))


class Block:
    """A payload opened for random access."""

    def __init__(self, payload: bytes):
        magic, lowest, rules, symbols, docs, bits = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = _HEAD.size
        pairs = np.frombuffer(payload, "<u4", 2 * rules, at).reshape(rules, 2)
        lengths = np.frombuffer(payload, "<u4", rules, at := at + 8 * rules)
        per_doc = np.frombuffer(payload, "<u4", docs, at := at + 4 * rules)
        self.symbols = _unpacked(np.frombuffer(payload, np.uint8, offset=at + 4 * docs), symbols, bits)
        self.ends = np.cumsum(per_doc, dtype=np.int64)
        self.grammar = Grammar(lowest, pairs, lengths.astype(np.int64))

    def document(self, n: int) -> np.ndarray:
        """The ids of the block's n-th document."""
        return self.grammar.expand(self.symbols[(self.ends[n - 1] if n else 0) : self.ends[n]])

    def span(self, n: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the n-th document; expands only the symbols that meet them."""
        own = self.symbols[(self.ends[n - 1] if n else 0) : self.ends[n]]
        ends = np.cumsum(self.grammar.sizes(own))
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop)
        before = int(ends[first - 1]) if first else 0
        return self.grammar.expand(own[first : last + 1])[start - before : stop - before]

    def all(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)


class ChunkCodes:
    """Ids by the tokenizers library, remembered for each run between ASCII white space.

    For a tokenizer that drops white space, parts letters from signs, and whose normaliser and splits never
    look across white space, the ids of a text are those of its runs one after another, and those of a run of
    letters before one stop or comma are the word's and the sign's.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.lowers = '"Lowercase"' in definition
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        #: An added token, which the tokenizer always splits off, to stand between runs encoded together.
        self.mark_id, self.mark = min((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if "<" in t.content)
        #: Whether an id ends a word.
        self.ends = np.zeros(max([*self.tokenizer.get_vocab().values()]) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: The model itself, for words of small Latin letters: normaliser and splits leave those whole.
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.model = None if any(any(c.isalpha() for c in t) and "<" not in t for t in added) else self.tokenizer.model

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of each word; words of small Latin letters go to the model, others of letters alone are encoded
        many at a time."""
        small = list(filter(_SMALL, words)) if self.model else []
        if small:
            ids, ends, tokenize = [], [], self.model.tokenize
            for word in small:
                ids += [t.id for t in tokenize(word.decode() if word.isascii() else word.decode("latin-1").translate(self.letters))]
                ends.append(4 * len(ids))
            raw = np.array(ids, "<u4").tobytes()
            self.known.update(zip(small, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            words = [w for w in words if w not in self.known]
        texts = [w.decode("utf-8") for w in words]
        plain = [n for n, t in enumerate(texts) if t.isalpha()]
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            coded = self._ids(" ".join([texts[n] for n in some]))
            bounds = (4 * np.flatnonzero(self.ends[coded]) + 4).tolist()
            if len(bounds) == len(some) and bounds[-1] == 4 * len(coded):
                raw = coded.tobytes()
                self.known.update(zip([words[n] for n in some], [raw[a:b] for a, b in zip([0, *bounds], bounds, strict=False)], strict=True))
        rest = [(w, t) for w, t in zip(words, texts, strict=True) if w not in self.known]
        for at in range(0, len(rest), 1000):
            some = [x for x in rest[at : at + 1000] if "<" not in x[1]]
            coded = self._ids(self.mark.join([t for _, t in some]))
            cuts, raw = (4 * np.flatnonzero(coded == self.mark_id)).tolist(), coded.tobytes()
            self.known.update([(w, raw[a:b]) for (w, _), a, b in zip(some, [0, *[c + 4 for c in cuts]], [*cuts, len(raw)], strict=False)])
        for w, t in rest:
            if "<" in t:
                self.known[w] = self._ids(t).tobytes()

    def _ids_of(self, runs: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each run; what is remembered are words without their stops."""
        if not len(runs):
            return []
        if len(self.known) >= CACHE_CHUNKS:
            self.known.clear()
        raw, ends = np.frombuffer(runs.buffers()[2] or b"", np.uint8), np.frombuffer(runs.buffers()[1], np.int32)[runs.offset :][: len(runs) + 1]
        data, bounds = raw[ends[0] : ends[-1]].tobytes(), (ends - ends[0]).tolist()
        words = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        stopped = []
        longer = np.flatnonzero(np.diff(ends) > 1)
        last = raw[ends[longer + 1] - 1]
        for n in longer[(last == 44) | (last == 46)].tolist():
            if (word := words[n][:-1]).isalpha() or _SMALL(word):
                stopped.append((n, words[n][-1:]))
                words[n] = word
        found = list(map(self.known.get, words))
        if None in found:
            self._learn(list({w for w, i in zip(words, found, strict=True) if i is None}))
            found = list(map(self.known.__getitem__, words))
        after = {r: self._ids(r.decode()).tobytes() for r in (b".", b",")}
        for n, stop in stopped:
            found[n] += after[stop]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has. Each different run is looked up once."""
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)) if self.lowers else texts
        split = pc.ascii_split_whitespace(low)
        coded = split.flatten().dictionary_encode()
        runs = self._ids_of(coded.dictionary)
        pool = np.frombuffer(b"".join(runs), "<u4")
        kind = np.int32 if (pc.sum(pc.binary_length(low)).as_py() or 0) < 1 << 28 else np.int64
        length = np.fromiter(map(len, runs), kind, len(runs)) // 4
        start = np.cumsum(length, dtype=kind) - length
        at = coded.indices.to_numpy(zero_copy_only=False)
        size = length[at]
        ends = np.zeros(len(at) + 1, kind)
        np.cumsum(size, out=ends[1:])
        ids = pool[np.arange(ends[-1], dtype=kind) + np.repeat(start[at] - ends[:-1], size)] if len(at) else pool
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(bounds)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, encoded in slices of about SLICE_BYTES."""
        length = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        part = np.cumsum(length) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids, sizes = self.encode(texts.slice(a, b - a))
            ends = np.cumsum(sizes).tolist()
            for start, end in zip([0, *ends], ends, strict=False):
                yield ids[start:end]


_CODES: dict[str, ChunkCodes] = {}


def codes_of(definition: str) -> ChunkCodes:
    """The worker's encoder of a vocabulary, with what it remembers; one in a Python worker."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _CODES:
        _CODES.clear()
        _CODES[key] = ChunkCodes(definition)
    return _CODES[key]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Encode the documents and write them to path in ascending doc_id order.

    docs: doc_id, text; further columns are ignored. Null and empty texts hold only the end id. Null doc_ids
    come first; rows of one doc_id are ordered by text. An empty table writes files without blocks. Texts are
    dealt by doc_id range, one shuffle; the vocabulary file is read on the driver and broadcast.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())])

    def blocks(batches):
        codes = codes_of(shared.value)
        lowest = codes.tokenizer.get_vocab_size()
        lowest = max(lowest, end_id + 1)
        end = np.array([end_id], "<u4")
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        count = 0

        def made():
            sizes = np.array([len(x) + 1 for x in held], np.int64)
            payload = compress(np.concatenate([x for ids in held for x in (ids, end)]), sizes, lowest)
            return batch({"shard": [shard], "block": [number], "start": [start], "n_tokens": [count], "doc_ids": [ids], "sizes": [sizes], "payload": [payload]}, schema)

        for part in batches:
            for doc_id, own in zip(part.column(0).to_pylist(), codes.encode_all(part.column(1)), strict=True):
                ids.append(doc_id)
                held.append(own)
                count += len(own) + 1
                if count >= BLOCK_IDS:
                    yield made()
                    number, start, ids, held, count = number + 1, start + count, [], [], 0
        if held:
            yield made()

    source = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    ordered = source.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    kind = "shard int, block int, start bigint, n_tokens bigint, doc_ids array<bigint>, sizes array<bigint>, payload binary"
    ordered.mapInArrow(blocks, kind).write.parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """What write() left in path: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array<bigint>).

    start counts the ids of all documents before; ids_crc32 is the CRC-32 of the ids as little-endian
    unsigned 32-bit integers. Shard totals, one row a shard, are summed on the driver.
    """
    kind = "shard int, block int, start bigint, n_tokens bigint, doc_ids array<bigint>, sizes array<bigint>, payload binary"
    files = spark.read.schema(kind).parquet(path)
    totals = sorted(map(tuple, files.groupBy("shard").agg(F.sum("n_tokens")).collect()))
    bases, before = [], 0
    for shard, total in totals:
        bases.append((shard, before))
        before += total
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * ids)

    def opened(batches):
        for part in batches:
            for row in part.to_pylist():
                flat = Block(row["payload"]).all()
                ends = np.cumsum(np.array(row["sizes"], np.int64))
                starts = np.concatenate(([0], ends[:-1]))
                each = [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = {"shard": [row["shard"]] * len(each), "doc_id": row["doc_ids"], "start": row["start"] + starts, "n_tokens": row["sizes"], "ids_crc32": [zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in each]}
                yield batch(cols | {"ids": [x.astype(np.int64) for x in each]} if ids else cols, schema)

    rows = files.select("shard", "start", "doc_ids", "sizes", "payload").mapInArrow(opened, "shard int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids)
    base = F.broadcast(spark.createDataFrame(bases, "shard int, base bigint"))
    found = rows.join(base, "shard").withColumn("start", F.col("start") + F.col("base"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """write() to a fresh place in the shared folder and read() it back, without the ids themselves."""
    path = work_path(docs.sparkSession, "tokens")
    write(docs, path, vocabulary, end_id)
    return read(docs.sparkSession, path, ids=False)
