"""Byte-pair encoding and decoding of whole texts.

Encoding reads the tokenizer's JSON file (vocabulary, merges, added tokens) and works on segments
between ASCII white space, since no token spans white space. Each distinct segment is encoded once
per worker and kept in a cache of bounded size. A short word is a contiguous array of parts beside
an array of the ranks of adjacent parts: the scan finds the least rank, merges that pair, deletes
the boundary between its parts and refreshes the ranks on both sides. Words of more than
SHORT_WORD symbols keep the same ranks in a heap, which gives the same merges without rescanning.

Null text is empty and has no ids. Repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import table

SHORT_WORD = 128
CACHE_SIZE = 300_000
NEVER = 1 << 60
ASCII_GAP = re.compile(r"[ \t\n\r\f\v]+")
#: White space for str.split() that is none for the tokenizer's pattern.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next code point from 256."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def normal_form(text: str) -> str:
    """NFC in lower case, letter by letter: lower-casing knows no context."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            return "".join(map(str.lower, text))
    return text.lower()


def merge_ranked(parts: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the pair of least rank, leftmost first, until no adjacent pair has a rank."""
    none = (NEVER, 0)
    ranks = [merges.get(pair, none)[0] for pair in zip(parts, parts[1:], strict=False)]
    while ranks:
        least = min(ranks)
        if least == NEVER:
            break
        i = ranks.index(least)
        parts[i] = merges[parts[i], parts[i + 1]][1]
        del parts[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = merges.get((parts[i], parts[i + 1]), none)[0]
        if i:
            ranks[i - 1] = merges.get((parts[i - 1], parts[i]), none)[0]
    return parts


def merge_long(parts: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """merge_ranked for long words: the ranks wait in a heap, parts are linked to their neighbours."""
    n = len(parts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := merges.get((parts[i], parts[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if parts[i] != a or j < 0 or parts[j] != b:
            continue
        parts[i], parts[j], right[i] = merges[a, b][1], -1, right[j]
        if right[i] >= 0:
            left[right[i]] = i
        for p in (left[i], i):
            if p >= 0 and right[p] >= 0 and (r := merges.get((parts[p], parts[right[p]]))):
                heapq.heappush(heap, (r[0], p, parts[p], parts[right[p]]))
    return [p for p in parts if p >= 0]


class SegmentCache(dict):
    """segment -> ids. Two generations of at most `limit` segments: those used lately stay."""

    def __init__(self, encode, limit: int = CACHE_SIZE):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, segment: str):
        ids = self.old.pop(segment, None)
        if ids is None:
            ids = self.encode(segment)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(segment) <= 256:
            self[segment] = ids
        return ids


class Bpe:
    """The encoder and decoder of a byte-level BPE tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, (split, _) = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or not split["invert"]:
            raise ValueError(f"{path} is not a lower-casing byte-level BPE file")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(split["pattern"]["Regex"])
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.decimal = {i: str(i) for i in self.token}
        self.cache = SegmentCache(self.encode_segment)

    def encode_word(self, word: str) -> list[int]:
        data = word.encode()
        parts = [self.inner[b] for b in data[:-1]]
        parts.append(self.last[data[-1]])
        return merge_ranked(parts, self.merges) if len(parts) <= SHORT_WORD else merge_long(parts, self.merges)

    def encode_segment(self, segment: str) -> tuple[int, ...]:
        """Ids of text without ASCII white space: added tokens stand in the raw text, the rest is normalised and split."""
        ids: list[int] = []
        for piece in self.added_pattern.split(segment) if "<|" in segment else (segment,):
            if (known := self.added.get(piece)) is not None:
                ids.append(known)
            elif piece:
                for word in self.pattern.findall(normal_form(piece)):
                    ids += self.encode_word(word)
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        segments = ASCII_GAP.split(text) if SEPARATORS.search(text) else text.split()
        return [i for ids in map(self.cache.__getitem__, segments) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, added ones too: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One encoder per worker process, so that its cache outlives a task."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs' doc_id with ids array<int> and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(x or "") for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids])], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_documents' ids and texts, digested where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            counts, digests, decoded = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), vocabulary_path())
