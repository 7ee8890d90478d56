"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of that length and a rest. Pieces are dealt by
a hash of doc_id and text into shards of about SHARD pieces, which are packed independently, so no task sees the whole
corpus, and how the input is partitioned decides nothing (but which shard takes a row without doc_id).
In a shard, pieces fall by length into the open bin with the least room that still fits; when none
fits, a bin opens. The lengths are optimised jointly: the shard is packed once for each permitted length as
the least size to open, and once opening at each piece the size of least cost per token that the remaining pieces
can be expected to fill; finally every bin shrinks to the least permitted length that holds its contents.
The packing of least total cost stays. The cost of a sequence is its length plus OVERHEAD tokens.

pack_tokens() encodes the documents and deals their token ids (each document's end id with them) into the shards, where they are packed and put
together: ids move once, with their pieces, so rows with null or repeated ids keep their own. The sequences are written as Parquet, each with
the pieces it holds, and read back: every row names the bytes of its sequence by a checksum. A shard has about SHARD pieces of at most the largest
length, which bounds a task. pack() takes any lengths and sequences() puts ids given as arrays together; pack_documents() packs a document's words (runs of
characters other than 0x20 and 0x09-0x0D) and one end instead of token ids.

Null or empty text is the end alone. Rows with null or repeated doc_id are packed as separate documents; of pieces of
equal length (ties) the one with the smaller hash, then the earlier piece, comes first. Other columns are never read,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import token_store
from lectern.llm.bpe import vocabulary_path
from lectern.llm.common import forget, scratch, stored, table
from lectern.llm.words import by_bytes

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16
SHARD = 20_000
SPACES = " \t\n\x0b\x0c\r"


def cost(length: int) -> int:
    return length + OVERHEAD


def token_lengths(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_tokens: words and one end."""
    bare = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACES))
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+", -1)))
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (words + 1).cast("long").alias("n_tokens"))


def fill(sizes: list[int], lengths: tuple[int, ...], least: int | None) -> tuple[list[int], list[int], list[int], int]:
    """(bin of each piece, offset, final length of each bin, cost) for sizes in falling order.

    least: the least length to open, or None to open the length of least expected cost per token.
    """
    top = lengths[-1]
    rooms: list[list[int]] = [[] for _ in range(top + 1)]
    open_bits = 0
    room: list[int] = []
    capacity: list[int] = []
    bins, offsets = [], []
    left = sum(sizes)
    for size in sizes:
        fits = open_bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = rooms[free].pop()
            if not rooms[free]:
                open_bits &= ~(1 << free)
        else:
            fitting = [n for n in lengths if n >= size]
            if least is None:
                length = min(fitting, key=lambda n: (cost(n) / min(n, size + max(0, left - size)), n))
            else:
                length = next((n for n in fitting if n >= least), fitting[-1])
            b, free = len(room), length
            room.append(length)
            capacity.append(length)
        bins.append(b)
        offsets.append(capacity[b] - free)
        room[b] = free - size
        left -= size
        if room[b]:
            rooms[room[b]].append(b)
            open_bits |= 1 << room[b]
    final = [next(n for n in lengths if n >= c - r) for c, r in zip(capacity, room, strict=True)]
    return bins, offsets, final, sum(map(cost, final))


def pack_shard(pieces: pd.DataFrame, lengths: tuple[int, ...]) -> pd.DataFrame:
    pieces = pieces.sort_values(["n_tokens", "row", "piece"], ascending=[False, True, True], kind="stable")
    sizes = pieces["n_tokens"].tolist()
    bins, offsets, final, _ = min((fill(sizes, lengths, least) for least in (None, *lengths)), key=lambda p: p[3])
    return pieces.assign(bin=np.array(bins, np.int64), offset=np.array(offsets, np.int64), capacity=np.array(final, np.int64)[bins])


def pack(sizes: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_pieces: int = SHARD) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, shard, bin, capacity, offset from (row, doc_id, n_tokens)."""
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    pieces = sizes.select("row", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / top))).alias("piece"))
    pieces = pieces.select("row", "doc_id", "piece", (F.col("piece") * top).alias("first_token"), F.least(F.lit(top), F.col("n_tokens") - F.col("piece") * top).alias("n_tokens"))
    shards = max(1, -(-pieces.count() // shard_pieces))
    # any number of rows may lack a doc_id and be equal: these are dealt by their places in the input
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece", place), F.lit(shards)))
    schema = "row long, doc_id long, piece long, first_token long, n_tokens long, shard long, bin long, offset long, capacity long"
    packed = dealt.groupBy("shard").applyInPandas(lambda g: pack_shard(g, lengths)[["row", "doc_id", "piece", "first_token", "n_tokens", "shard", "bin", "offset", "capacity"]], schema)
    return packed.select("doc_id", "piece", "first_token", "n_tokens", "shard", "bin", "capacity", "offset")


def sequences(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """shard, bin, capacity, n_tokens, ids array<int>: one row per bin, at most the largest length of ids in it.

    placed: rows of pack() for documents with a doc_id of their own; ids: doc_id, ids array<int> of each of these documents.
    """
    piece = F.slice("ids", (F.col("first_token") + 1).cast("int"), F.col("n_tokens").cast("int"))
    cut = placed.join(ids.select("doc_id", "ids"), "doc_id").select("shard", "bin", "capacity", F.struct("offset", piece.alias("ids")).alias("piece"))
    bins = cut.groupBy("shard", "bin").agg(F.first("capacity").alias("capacity"), F.sort_array(F.collect_list("piece")).alias("pieces"))
    whole = bins.select("shard", "bin", "capacity", F.flatten("pieces.ids").alias("ids"))
    return whole.select("shard", "bin", "capacity", F.size("ids").cast("long").alias("n_tokens"), "ids")


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(stored(token_lengths(docs), "lengths"))


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """row, doc_id, n_tokens, width, ids: token ids of every whole text and its end id, as little-endian numbers of `width` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_store._encoder(tokenizer)
        width = encoder.dtype.itemsize
        for batch in batches:
            for part in by_bytes(batch, "text", 8 << 20):
                ids, off = encoder.batch([x or "" for x in part.column("text").to_pylist()])
                data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((off * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids.astype(encoder.dtype)))])
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(np.diff(off)), pa.array(np.full(part.num_rows, width, np.int32)), data.cast(pa.binary())], ["row", "doc_id", "n_tokens", "width", "ids"])

    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n_tokens long, width int, ids binary")


SEQUENCES = "shard long, bin long, capacity long, width int, ids binary, pieces array<struct<doc_id: long, piece: long, first_token: long, n_tokens: long, offset: long>>"


def packed_sequences(tokens: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_pieces: int = SHARD) -> DataFrame:
    """SEQUENCES of (row, doc_id, n_tokens, width, ids): a row for each bin, its ids as bytes and where its pieces are."""
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    n = tokens.agg(F.coalesce(F.sum(F.floor((F.col("n_tokens") - 1) / top) + 1), F.lit(0))).first()[0]
    shards = max(1, -(-n // shard_pieces))
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    each = tokens.select("*", place.alias("place"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / top))).alias("piece"))
    first, width = F.col("piece") * top, F.col("width")
    size = F.least(F.lit(top), F.col("n_tokens") - first)
    cut = F.substring(F.col("ids"), (first * width + 1).cast("int"), (size * width).cast("int"))
    dealt = each.select(F.pmod(F.xxhash64("row", "piece", "place"), F.lit(shards)).alias("shard"), "row", "doc_id", "piece", first.alias("first_token"), size.alias("n_tokens"), "width", cut.alias("ids"))

    def pack_ids(t: pa.Table) -> pa.Table:
        ids = t["ids"].combine_chunks()
        meta = pd.DataFrame({c: t[c].to_numpy() for c in ("row", "piece", "first_token", "n_tokens")} | {"at": np.arange(t.num_rows)})
        placed = pack_shard(meta, lengths).sort_values(["bin", "offset"], kind="stable")
        at, bins = placed["at"].to_numpy(), placed["bin"].to_numpy()
        ends = np.append(np.flatnonzero(np.diff(bins)) + 1, len(bins)) if len(bins) else np.zeros(0, np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), ends])[: len(ends)]
        joined = [b"".join(ids.take(pa.array(at[a:b])).to_pylist()) for a, b in zip(starts, ends, strict=True)]
        fields = [t["doc_id"].combine_chunks().take(pa.array(at)), *(pa.array(placed[c].to_numpy(np.int64)) for c in ("piece", "first_token", "n_tokens", "offset"))]
        pieces = pa.ListArray.from_arrays(pa.array(np.append(starts, len(bins)), pa.int32()), pa.StructArray.from_arrays(fields, ["doc_id", "piece", "first_token", "n_tokens", "offset"]))
        same = lambda c: pa.array([t[c][0].as_py()] * len(starts), t[c].type)
        return pa.table([same("shard"), pa.array(bins[starts]), pa.array(placed["capacity"].to_numpy(np.int64)[starts]), same("width"), pa.array(joined, pa.binary()), pieces], ["shard", "bin", "capacity", "width", "ids", "pieces"])

    return dealt.groupBy("shard").applyInArrow(pack_ids, SEQUENCES)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEQUENCES).parquet(path)


def pack_tokens(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, shard, bin, capacity, offset, and of the sequence as read back from path: sequence_tokens, sequence_crc32."""
    spark = docs.sparkSession
    path = path or scratch(spark, "sequences")
    tokens = stored(tokenized(docs, tokenizer), "tokens")
    packed_sequences(tokens).write.parquet(path)
    forget(tokens)
    read = read_sequences(spark, path)
    rows = read.select("shard", "bin", "capacity", (F.length("ids") / F.col("width")).cast("long").alias("sequence_tokens"), F.crc32("ids").alias("sequence_crc32"), F.explode("pieces").alias("p"))
    return rows.select("p.doc_id", "p.piece", "p.first_token", "p.n_tokens", "shard", "bin", "capacity", "p.offset", "sequence_tokens", "sequence_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
