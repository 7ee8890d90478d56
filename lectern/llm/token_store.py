"""Content-addressed store of token ids.

write() encodes every text with the tokenizers library, appends the end id, and cuts each
document's ids into chunks where a rolling hash over the last WINDOW ids has its low bits zero (at
least MIN_CHUNK, at most MAX_CHUNK ids). Under `path` it leaves

  chunks/   digest, n, data: each distinct chunk once (zstd of the ids as little-endian integers of
            `width` bytes); the digest is the SHA-256 of the ids as unsigned 32-bit integers.
  recipes/  doc_id, place, start, n_tokens, chunks, root, block: in ascending doc_id order, one file per
            block; `chunks` lists digests and lengths, `root` is the Merkle root over the digests.
  manifest/ block, docs, tokens, first, root: one row per recipe file with the start of its first document and the Merkle
            root over its whole recipes (doc_id, start, n_tokens, root).
  root/     blocks, docs, tokens, root: the Merkle root over the manifest's rows.

Reading checks both trees against the recipes and that starts follow one another, decompresses and digests every
chunk once, joins chunks to recipes, checks lengths and roots, and either folds the chunks' checksums into those of whole
documents (checksums) or returns the ids (documents). Any damage raises.

Null text is empty: its document is the end id alone. A null doc_id comes first. Rows that repeat a
doc_id (ties) are separate documents, in the order of their texts' digests. Texts of any length are encoded whole. Other columns are
never read, whatever their names. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lectern.llm.bpe import normal_form, vocabulary_path
from lectern.llm.common import scratch, shuffle_partitions, stored, table
from lectern.llm.words import by_bytes, mix, string_bytes

END_ID = 1
WINDOW, MASK_BITS, MIN_CHUNK, MAX_CHUNK = 16, 10, 256, 8192
#: Most distinct segments and words that a worker remembers.
SEGMENTS, WORDS = 800_000, 500_000
#: A run of these after letters is one word of its own.
MARKS = string.punctuation
PIECES = "array<struct<digest: binary, n: int>>"


def _gear() -> np.ndarray:
    return (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def chunk_marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: where a rolling hash over the last WINDOW ids has its low bits zero.

    Documents may follow one another in ids: the hash reaches WINDOW ids back, and no chunk is as short as that.
    """
    rolled = GEAR[ids & 0xFFFF]
    width = 1
    while width < WINDOW:  # windows of 2, 4, ... ids
        wider = rolled.copy()
        wider[width:] += rolled[:-width] << np.uint32(width)
        rolled, width = wider, 2 * width
    return np.flatnonzero((rolled >> np.uint32(WINDOW)) & np.uint32((1 << MASK_BITS) - 1) == 0) + 1


def cut_points(n: int, marks: np.ndarray) -> list[int]:
    """Ends of the chunks of n ids with these marks: content decides them, so equal passages give equal chunks."""
    ends, at = [], 0
    for hit in marks.tolist() if n > MIN_CHUNK else ():
        while hit - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if hit - at >= MIN_CHUNK:
            ends.append(hit)
            at = hit
    while n - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    if at < n or not ends:
        ends.append(n)
    return ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over SHA-256 nodes; a lone last node rises unchanged, no leaves give the digest of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[2 * len(pairs) :]
    return level[0] if level else hashlib.sha256(b"").digest()


def ragged(start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, ends): places of the entries of lists at[0], at[1], ... where list k has size[k] entries from start[k]."""
    count = size[at]
    ends = np.cumsum(count)
    return np.repeat(start[at] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0), ends


class Known:
    """Strings and their ids, in Arrow and numpy. Of more than `limit` strings the lately used half stays."""

    def __init__(self, limit: int, dtype: np.dtype):
        self.limit, self.clock = limit, 0
        self.text = pa.array([], pa.string())
        self.size, self.used, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, dtype)

    def find(self, values: pa.Array) -> np.ndarray:
        """Each value's place, or -1."""
        self.clock += 1
        at = pc.fill_null(pc.index_in(values, value_set=self.text), -1).to_numpy()
        self.used[at[at >= 0]] = self.clock
        return at

    def add(self, values: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        if len(self.text) + len(values) > self.limit and len(self.text):
            keep = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
            places, _ = ragged(np.cumsum(self.size) - self.size, self.size, keep)
            self.text, self.ids, self.size, self.used = self.text.take(pa.array(keep)), self.ids[places], self.size[keep], self.used[keep]
        self.text = pa.concat_arrays([self.text, values])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        self.used = np.concatenate([self.used, np.full(len(values), self.clock, np.int32)])

    def resolve(self, values: pa.Array, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, ids): the ids of each of these distinct values; encode gives (size, ids) of those not known."""
        at = self.find(values)
        missing = at < 0
        new = values.filter(pa.array(missing))
        if isinstance(new, pa.ChunkedArray):
            new = new.combine_chunks()
        new_size, new_ids = encode(new)
        start, size = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
        known = at[~missing]
        start[~missing], size[~missing] = (np.cumsum(self.size) - self.size)[known], self.size[known]
        start[missing], size[missing] = len(self.ids) + np.cumsum(new_size) - new_size, new_size
        ids = np.concatenate([self.ids, new_ids])
        self.add(new, new_size, new_ids)
        return start, size, ids


def unassigned(text: str) -> bool:
    """Whether a code point is younger than this Python's tables: then only the library knows its case and kind."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text)


def tails(whole: pa.Array, bare: pa.Array) -> pa.Array:
    """What trimming has cut off the ends of strings."""
    data, off = string_bytes(whole)
    size = (pc.binary_length(whole).to_numpy() - pc.binary_length(bare).to_numpy()).astype(np.int64)
    places, ends = ragged(off[1:] - size, size, np.arange(len(size)))
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(np.ascontiguousarray(data[places]))]).cast(pa.string())


class Encoder:
    """Whole texts to ids through the tokenizers library.

    No token spans white space, and within a segment the file's pattern finds the words that the library's model
    encodes one by one. So distinct words go to the library once, many to a call, and texts are put
    together from them. Texts with an added token go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.words = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None, "normalizer": None, "pre_tokenizer": byte_level, "added_tokens": []}))
        self.added = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]))
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        # the last token of a word ends with the file's suffix
        self.closing = np.zeros(self.whole.get_vocab_size() + 1, bool)
        self.closing[[i for token, i in spec["model"]["vocab"].items() if token.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.by_segment, self.by_word = Known(SEGMENTS, self.dtype), Known(WORDS, self.dtype)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(size, ids) of words."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, self.dtype)]
        odd = [i for i, x in enumerate(words.to_pylist()) if unassigned(x)]
        if odd:
            whole = [np.array(self.whole.encode(words[i].as_py(), add_special_tokens=False).ids, self.dtype) for i in odd]
            keep = np.setdiff1d(np.arange(len(words)), odd)
            size, rest = self.encode_words(words.take(pa.array(keep)))
            sizes_ = np.zeros(len(words), np.int64)
            sizes_[keep], sizes_[odd] = size, [len(x) for x in whole]
            parts = np.split(rest, np.cumsum(size)[:-1]) if len(size) else []
            by_place = dict(zip(keep.tolist(), parts, strict=True)) | dict(zip(odd, whole, strict=True))
            return sizes_, np.concatenate([by_place[i] for i in range(len(words))])
        for at in range(0, len(words), 4096):
            part = words.slice(at, 4096).to_pylist()
            found = np.array(self.words.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.closing[found]) + 1
            if len(ends) != len(part):
                raise ValueError("the file's end-of-word suffix does not tell words apart")
            sizes.append(np.diff(ends, prepend=0))
            ids.append(found)
        return np.concatenate(sizes), np.concatenate(ids)

    def encode_segments(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(size, ids) of segments of normalised text."""
        bare = pc.utf8_rtrim(segments, characters=MARKS)
        # most are letters and then marks: two words at most (beyond ASCII the file's pattern says what is a letter)
        simple = pc.and_(pc.utf8_is_alpha(bare), pc.string_is_ascii(bare))
        easy = np.flatnonzero(simple.to_numpy(zero_copy_only=False))
        tail = tails(segments, bare).take(pa.array(easy))
        marked = pc.binary_length(tail).to_numpy() > 0
        hard = np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
        found = [[x] if unassigned(x) else self.pattern.findall(x) for x in segments.take(pa.array(hard)).to_pylist()]
        words = pa.concat_arrays([bare.take(pa.array(easy)), tail.filter(pa.array(marked)), pa.array([w for ws in found for w in ws], pa.string())]).dictionary_encode()
        owner = np.concatenate([easy, easy[marked], np.repeat(hard, [len(ws) for ws in found])]).astype(np.int64)
        start, size, ids = self.by_word.resolve(words.dictionary, self.encode_words)
        at = words.indices.to_numpy()[np.argsort(owner, kind="stable")]
        places, _ = ragged(start, size, at)
        return np.bincount(owner, size[words.indices.to_numpy()], len(segments)).astype(np.int64), ids[places]

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]], the end id last."""
        special = {i: np.array(self.whole.encode(x, add_special_tokens=False).ids, self.dtype) for i, x in enumerate(texts) if x and "<|" in x and self.added.search(x)}
        split = pc.ascii_split_whitespace(pa.array([normal_form(x) if x and i not in special else "" for i, x in enumerate(texts)], pa.string()))
        distinct = split.values.dictionary_encode()
        start, size, ids = self.by_segment.resolve(distinct.dictionary, self.encode_segments)
        places, ends = ragged(start, size, distinct.indices.to_numpy())
        off = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        ids, off = np.insert(ids[places], off[1:], END_ID), off + np.arange(len(off))
        if special:
            texts_ids = [np.append(special[i], self.dtype.type(END_ID)) if i in special else ids[off[i] : off[i + 1]] for i in range(len(texts))]
            ids, off = np.concatenate(texts_ids), np.concatenate([[0], np.cumsum([len(x) for x in texts_ids])])
        return ids, off


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


STAGED = f"slot int, kind int, doc_id long, tie binary, n_tokens long, chunks {PIECES}, digest binary, n int, data binary"


def _staged(docs: DataFrame, tokenizer: str, n_slots: int) -> DataFrame:
    """Rows of kind 0 (a document's chunk list) and kind 1 (a chunk, once per map task), each with its slot."""
    piece = pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32())]))
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), piece, pa.binary(), pa.int32(), pa.binary()]
    names = ["slot", "kind", "doc_id", "tie", "n_tokens", "chunks", "digest", "n", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        pack = zstandard.ZstdCompressor(level=1)
        seen: set[bytes] = set()
        for batch in batches:
            for part in by_bytes(batch, "text", 8 << 20):
                texts = [x or "" for x in part.column("text").to_pylist()]
                rows = []
                all_ids, off = encoder.batch(texts)
                marks = chunk_marks(all_ids)
                of_text = np.searchsorted(marks, off, side="right")
                for i, (doc_id, text, lo, hi) in enumerate(zip(part.column("doc_id").to_pylist(), texts, off[:-1], off[1:], strict=True)):
                    ids = all_ids[lo:hi]
                    chunks, begin = [], 0
                    for end in cut_points(hi - lo, marks[of_text[i] : of_text[i + 1]] - lo):
                        chunk = ids[begin:end]
                        digest = hashlib.sha256(chunk.astype("<u4").tobytes()).digest()
                        chunks.append({"digest": digest, "n": end - begin})
                        if digest not in seen:
                            seen.add(digest)
                            rows.append((int.from_bytes(digest[:4], "big") % n_slots, 1, None, None, None, None, digest, end - begin, pack.compress(chunk.tobytes())))
                        begin = end
                    tie = hashlib.sha256(text.encode()).digest()
                    rows.append((int.from_bytes(tie[:4], "big") % n_slots if doc_id is None else doc_id % n_slots, 0, doc_id, tie, len(ids), chunks, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STAGED)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the later rows of each chunk; rows come in digest order. Equal digests must have equal bytes."""
    last_digest, last_data = None, None
    for batch in batches:
        keep = []
        for kind, digest, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "digest", "data")), strict=True):
            if kind == 1 and digest == last_digest:
                if data != last_data:
                    raise ValueError(f"two chunks have the digest {digest.hex()}")
                keep.append(False)
            else:
                keep.append(True)
                if kind == 1:
                    last_digest, last_data = digest, data
        yield batch.filter(pa.array(keep))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [merkle_root([c["digest"] for c in chunks]) for chunks in batch.column("chunks").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "root"])


class Tree:
    """merkle_root() of leaves that come one by one: one node per level is held."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.peaks and self.peaks[-1][0] == height:
            node = hashlib.sha256(b"\1" + self.peaks.pop()[1] + node).digest()
            height += 1
        self.peaks.append((height, node))

    def root(self) -> bytes:
        if not self.peaks:
            return hashlib.sha256(b"").digest()
        node = self.peaks[-1][1]
        for _, left in reversed(self.peaks[:-1]):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def recipe_leaf(doc_id: int | None, start: int, n_tokens: int, root: bytes) -> bytes:
    return struct.pack("<?qqq", doc_id is None, doc_id or 0, start, n_tokens) + root


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MANIFEST of recipe rows that come in block and place order."""
    block, docs, tokens, first, joined, tree = None, 0, 0, 0, True, Tree()
    out = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, docs, tokens, first, joined, tree.root()), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["block", "docs", "tokens", "first", "joined", "root"])
    for batch in batches:
        for b, doc_id, start, n, root in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "start", "n_tokens", "root")), strict=True):
            if b != block:
                if block is not None:
                    yield out()
                block, docs, tokens, first, joined, tree = b, 0, 0, start, True, Tree()
            joined = joined and start == first + tokens
            docs, tokens = docs + 1, tokens + n
            tree.add(recipe_leaf(doc_id, start, n, root))
    if block is not None:
        yield out()


MANIFEST = "block int, docs long, tokens long, first long, joined boolean, root binary"
WHOLE = "blocks int, docs long, tokens long, root binary"


def _made_manifest(spark: SparkSession, path: str) -> DataFrame:
    """MANIFEST, made from the recipes as they are."""
    n = shuffle_partitions(spark)
    return _read_recipes(spark, path).select("block", "place", "doc_id", "start", "n_tokens", "root").repartition(n, "block").sortWithinPartitions("block", "place").mapInArrow(_manifest, MANIFEST)


def _over_blocks(rows: list) -> tuple[int, int, int, bytes]:
    """WHOLE from the manifest's rows, of which there are as many as shuffle partitions."""
    rows = sorted(rows, key=lambda r: r["block"])
    leaves = [struct.pack("<iqqq", r["block"], r["docs"], r["tokens"], r["first"]) + bytes(r["root"]) for r in rows]
    return len(rows), sum(r["docs"] for r in rows), sum(r["tokens"] for r in rows), merkle_root(leaves)


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    staged = _staged(docs, tokenizer, n).repartitionById(n, "slot").drop("slot").sortWithinPartitions("kind", "digest")
    staged.mapInArrow(_once, staged.schema).write.partitionBy("kind").option("compression", "uncompressed").parquet(f"{path}/parts")
    recipes = _kind(spark, path, 0, f"doc_id long, tie binary, n_tokens long, chunks {PIECES}")
    ordered = recipes.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("block", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    ordered = stored(ordered.drop("tie").mapInArrow(_roots, ordered.drop("tie").schema.add("root", "binary")), "recipes")
    # one sum per block reaches the driver: as many as there are shuffle partitions
    sums = sorted((r["block"], r["n"]) for r in ordered.groupBy("block").agg(F.sum("n_tokens").alias("n")).toLocalIterator())
    before, total = [], 0
    for block, tokens in sums:
        before.append((block, total))
        total += tokens
    base = spark.createDataFrame(before, "block int, base long")
    running = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("start", F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).join(F.broadcast(base), "block")
    placed = placed.select("doc_id", "place", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "chunks", "root", "block")
    placed.sortWithinPartitions("block", "place").write.parquet(f"{path}/recipes")
    _made_manifest(spark, path).write.parquet(f"{path}/manifest")
    spark.createDataFrame([_over_blocks(spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect())], WHOLE).coalesce(1).write.parquet(f"{path}/root")


RECIPES = f"doc_id long, place long, start long, n_tokens long, chunks {PIECES}, root binary, block int"


def _kind(spark: SparkSession, path: str, kind: int, schema: str) -> DataFrame:
    """A kind's rows. The folder is missing where a table was empty, hence the read through its parent."""
    return spark.read.schema(f"{schema}, kind int").parquet(f"{path}/parts").filter(F.col("kind") == kind).drop("kind")


def _read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def _verified(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """digest, n, crc and, if asked for, the ids of each chunk as unsigned 32-bit little-endian bytes; each chunk's digest is checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            digests, counts, crcs, bodies = batch.column("digest"), batch.column("n").to_pylist(), [], []
            for digest, n, data in zip(digests.to_pylist(), counts, batch.column("data").to_pylist(), strict=True):
                raw = unpack.decompress(data)
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                if len(ids) != 4 * n or hashlib.sha256(ids).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                crcs.append(zlib.crc32(ids))
                bodies.append(ids if with_ids else None)
            yield pa.RecordBatch.from_arrays([digests, batch.column("n"), pa.array(crcs, pa.int64()), pa.array(bodies, pa.binary())], ["digest", "n", "crc", "ids"])

    return _kind(spark, path, 1, "digest binary, n int, data binary").mapInArrow(run, "digest binary, n int, crc long, ids binary")


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reflected."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return product


@lru_cache(1 << 14)
def _shift(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes."""
    result, square, n = 1 << 31, 1 << 23, n_bytes
    while n:
        if n & 1:
            result = _times(square, result)
        square, n = _times(square, square), n >> 1
    return result


def join_crc32(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings one after the other, from theirs."""
    return _times(_shift(second_bytes), first) ^ second


def _joined(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    recipes = _read_recipes(spark, path)
    links = recipes.select("block", "place", F.posexplode("chunks").alias("seq", "c")).select("block", "place", "seq", F.col("c.digest").alias("digest"), F.col("c.n").alias("want"))
    found = links.join(_verified(spark, path, with_ids), "digest", "left")
    pieces = found.groupBy("block", "place").agg(F.sort_array(F.collect_list(F.struct("seq", "want", "n", "crc", "digest", *(["ids"] if with_ids else [])))).alias("pieces"))
    return recipes.drop("chunks").join(pieces, ["block", "place"])


def _checked(pieces: list[dict], n_tokens: int, root: bytes) -> None:
    if any(p["n"] != p["want"] for p in pieces) or sum(p["n"] for p in pieces) != n_tokens or merkle_root([p["digest"] for p in pieces]) != root:
        raise ValueError("a recipe does not fit its chunks")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the store, the manifest verified first."""
    check_manifest(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for pieces, n, root in zip(*(batch.column(c).to_pylist() for c in ("pieces", "n_tokens", "root")), strict=True):
                _checked(pieces, n, root)
                crc = 0
                for p in pieces:
                    crc = join_crc32(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _joined(spark, path, False).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document in the store, all verified."""
    check_manifest(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                pieces = row.column("pieces").to_pylist()[0]
                _checked(pieces, row.column("n_tokens")[0].as_py(), row.column("root")[0].as_py())
                ids = np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([row.column("doc_id"), row.column("start"), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return _joined(spark, path, True).mapInArrow(run, "doc_id long, start long, ids array<int>")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """block, docs, tokens, intact: the manifest against the recipes."""
    made = _made_manifest(spark, path)
    kept = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    same = [made[c].eqNullSafe(kept[c]) for c in ("docs", "tokens", "first", "root")]
    intact = F.coalesce(same[0] & same[1] & same[2] & same[3] & made["joined"], F.lit(False))
    return kept.join(made, kept["block"] == made["block"], "full").select(F.coalesce(kept["block"], made["block"]).alias("block"), kept["docs"], kept["tokens"], kept["first"], kept["root"], intact.alias("intact"))


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raise unless recipes, manifest and the root over its blocks agree and the documents' starts follow one another."""
    rows = sorted(verify_manifest(spark, path).collect(), key=lambda r: r["block"])  # as many as shuffle partitions
    whole = spark.read.schema(WHOLE).parquet(f"{path}/root").first()
    total = 0
    for r in rows:
        if not r["intact"] or r["first"] != total:
            raise ValueError(f"block {r['block']} of the recipes is damaged")
        total += r["tokens"]
    if whole is None or _over_blocks(rows) != (whole["blocks"], whole["docs"], whole["tokens"], bytes(whole["root"])):
        raise ValueError("the manifest is damaged")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    write(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return checksums(spark, path)
