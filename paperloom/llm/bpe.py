"""Byte-level BPE encoding by backtracking over longest matches, and decoding by an offset table.

Encoding a piece of text walks it with the longest token that starts at each place (an Aho-Corasick
automaton over all tokens lists the matches). A token is taken if it is compatible with the one before:
the pair would not be merged differently if its bytes stood alone, which a table answers. Otherwise the
next shorter token is tried, and where none fits, the last token is taken back and its end marked as a
dead one. Each place is left at most once for good, so the work is linear, and the result is the one that
merging by rank gives. Decoding copies slices of one array that holds the bytes of all tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch, lean, remembered, texts

#: Entries of a worker's caches of encoded chunks and of compatible pairs; bounds memory, not results.
CACHE = 150_000
#: Chunks longer than this are encoded each time they occur.
CACHED_CHARS = 64

#: Fixed value: the split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the characters with the Unicode property White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs that SPLIT never joins to each other: an optional blank and what is not white space, or white space.
#: Plain words are told apart from a stop or comma after them, where SPLIT parts them in any case.
_CHUNK = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[.,]?(?:[ \\n]|\\Z))| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_PIECE = regex.compile(SPLIT.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace(f"[^[{SPACE}]", f"[^{SPACE}"))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by rule: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class Codec:
    """Encoder and decoder of one byte-level vocabulary file (JSON with model.vocab and model.merges)."""

    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        extra = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *extra.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for text, i in vocab.items():
            if text not in extra:
                self.tokens[i] = bytes(letters[c] for c in text)
        #: The order in which tokens come into being, which decides merges: bytes first, then by merge.
        self.born = np.zeros(size, np.int64).tolist()
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.joined: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.joined[left, right] = whole
            if self.halves[whole] is None:
                self.halves[whole], self.born[whole] = (left, right), rank + 1
        usable = [i for i in vocab.values() if len(self.tokens[i]) == 1 or self.halves[i]]
        self.by_bytes = {self.tokens[i]: i for i in usable}
        self.automaton = ahocorasick.Automaton()
        for raw, i in self.by_bytes.items():
            self.automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.automaton.make_automaton()
        self.shorter = self._prefixes()
        self.fits: dict[tuple[int, int], bool] = {}
        self.lengths = [len(t) for t in self.tokens]
        self.added = extra
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(extra, key=len, reverse=True))) + ")") if extra else None
        for text, i in extra.items():
            self.tokens[i] = text.encode()
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.pool = np.frombuffer(b"".join(self.tokens), np.uint8)
        said = [f"{i},".encode() for i in range(size)]
        self.said_sizes = np.array([len(t) for t in said], np.int64)
        self.said_starts = np.concatenate(([0], np.cumsum(self.said_sizes)[:-1]))
        self.said_pool = np.frombuffer(b"".join(said), np.uint8)
        self.cache: dict[str, bytes] = {}

    def _prefixes(self) -> list[int]:
        """Of each token, the longest other token that it starts with, or -1."""
        found = [-1] * len(self.tokens)
        for raw, i in self.by_bytes.items():
            for n in range(len(raw) - 1, 0, -1):
                if (j := self.by_bytes.get(raw[:n])) is not None:
                    found[i] = j
                    break
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens by rank ends in just these two tokens.

        It does unless some merge across the border comes before one of the merges that build the tokens.
        The border pairs are met by taking both tokens apart from their latest merge backwards.
        """
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            known = self.fits[left, right] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        born, halves = self.born, self.halves
        undone_left = undone_right = float("inf")  # the rank of the merge taken apart last on either side
        while True:
            whole = self.joined.get((left, right))
            # At equal rank the merge further left goes first, so one undone on the left still stands before it.
            if whole is not None and (born[whole] < undone_left and born[whole] <= undone_right):
                return False
            if halves[left] is None and halves[right] is None:
                return True
            if born[left] > born[right] or born[left] == born[right] and halves[left] is not None and halves[right] is None:
                undone_left = born[left]
                left = halves[left][1]
            else:
                undone_right = born[right]
                right = halves[right][0]

    def encode_piece(self, raw: bytes) -> list[int]:
        """Token ids of one piece between the splits."""
        whole = self.by_bytes.get(raw)
        if whole is not None:
            return [whole]
        size, lengths, shorter, fits = len(raw), self.lengths, self.shorter, self.fits
        longest = [-1] * size
        for end, (i, n) in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - n] = i  # matches come by their end, so the last one at a start is the longest
        alive = bytearray(b"\x01") * (size + 1)
        taken: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < size:
            while token >= 0:
                if alive[at + lengths[token]]:
                    good = last < 0 or fits.get((last, token))
                    if good or good is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += lengths[token]
                last = token
                token = longest[at] if at < size else -1
            else:
                alive[at] = 0
                token = taken.pop()
                at -= lengths[token]
                last = taken[-1] if taken else -1
        return taken

    def _chunk(self, chunk: str) -> bytes:
        pieces = [chunk] if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()) else _PIECE.findall(chunk)
        found = np.array([i for piece in pieces for i in self.encode_piece(piece.encode("utf-8"))], "<u4").tobytes()
        if len(chunk) <= CACHED_CHARS:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[chunk] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        parts = [text] if self.added_pattern is None else self.added_pattern.split(text)
        get, build = self.cache.get, self._chunk
        found: list[bytes] = []
        for n, part in enumerate(parts):
            if n % 2:
                found.append(np.array([self.added[part]], "<u4").tobytes())
            else:
                found += [get(c) or build(c) for c in _CHUNK.findall(part)]
        return np.frombuffer(b"".join(found), "<u4")

    @staticmethod
    def _gather(ids: np.ndarray, pool: np.ndarray, starts: np.ndarray, all_sizes: np.ndarray) -> bytes:
        """The slices of pool that belong to ids, one after another."""
        sizes = all_sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return pool[np.arange(total) + np.repeat(starts[ids] - (ends - sizes), sizes)].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The decimal ids joined by commas."""
        return self._gather(ids, self.said_pool, self.said_starts, self.said_sizes)[:-1]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the pool by the offset table."""
        return self._gather(ids, self.pool, self.starts, self.sizes)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def codec_of(definition: bytes) -> Codec:
    """The worker's codec of a vocabulary; built once in a Python worker, until it has another operator's tasks."""
    return remembered("bpe" + hashlib.sha256(definition).hexdigest(), lambda: Codec(definition))


def _coded(docs: DataFrame, vocabulary: str, schema: pa.Schema, kind: str, row) -> DataFrame:
    """Map (doc_id, text) batches; the vocabulary file, a few MB, is read on the driver and broadcast."""
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for part in batches:
            rows = [row(codec, text.as_py()) for text in part.column(1)]
            cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([part.column(0), *batch(dict(zip(schema.names, cols, strict=True)), schema).columns], names=["doc_id", *schema.names])

    source = texts(docs)
    return source.mapInArrow(lean(run, remembers=True), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {kind}")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array<int>) of each text; null and empty texts give an empty array.

    docs: doc_id, text; further columns are ignored, repeated rows and null doc_ids stay as they are.
    """

    def row(codec: Codec, text: str):
        return (codec.encode(text).astype(np.int32),)

    return _coded(docs, vocabulary, pa.schema([("ids", pa.list_(pa.int32()))]), "ids array<int>", row)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of encode()'s rows; null or empty ids give an empty text."""
    with open(vocabulary, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for part in batches:
            found = [codec.decode(np.array(ids.as_py() or [], np.int64)) for ids in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], names=["doc_id", "text"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(lean(run, remembers=True), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def encode_checked(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids and exact: whether decoding the ids gives the text back."""
    schema = pa.schema([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("exact", pa.bool_())])

    def row(codec: Codec, text: str):
        ids = codec.encode(text)
        return len(ids), ids.astype(np.int32), codec.decode(ids) == text

    return _coded(docs, vocabulary, schema, "n_tokens bigint, ids array<int>, exact boolean", row)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document what its encoding and the decoding of that are: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty, with 0 tokens. Each text is encoded and decoded whole, in one task of its own
    size; nothing is shuffled.
    """
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(codec: Codec, text: str):
        ids = codec.encode(text)
        decoded = codec.decode(ids).encode("utf-8")
        return len(ids), hashlib.sha256(codec.decimal(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _coded(docs, vocabulary, schema, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)
