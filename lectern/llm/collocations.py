"""Phrase collocation mining with an FM-index per shard of the corpus.

Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words `[^\\x20\\x09]+`. A phrase of 2 to DEPTH words counts
where its words stand side by side in a piece, overlaps included; all counts are exact and per language.

1. Tasks cut their texts into shards of about SHARD bytes of one language, never inside a piece, and code words by the shard's own dictionary.
   Spark sums the dictionaries; words of fewer than `least` occurrences cannot be in a frequent phrase and become one symbol.
2. Each shard gets a bidirectional FM-index over word ids: the transform of its word sequence and that of the reversed sequence, both from
   suffixes sorted by their first DEPTH words, which is as deep as phrases go. The indexes are written once, bucketed by shard, so that later steps move
   phrases only.
3. Level by level, the intervals of the phrases known to be frequent are extended by a word, to the right through the reversed transform or
   to the left through the other, in turns; the interval in the other transform is kept in step. A longer phrase is kept if both its first and its
   last words are frequent phrases. It is known by the numbers of these two. Spark deals all shards' phrases by a hash of these into groups of
   about GRAMS_GROUP, packed by shard and group; each group is summed, and those of at least `least` occurrences return to the shards that
   hold them. A phrase comes once from each shard, so no group grows with a frequent phrase. Of each phrase the index also tells how often a word of its piece
   stands before and after it.
4. Counts of all first and last parts come along from level to level, and the scores of all cuts are computed as decimals of 38 digits.

A null language is `und`, a null text is empty. Texts of any length are read whole; one without stops stays in one shard. Phrases of equal score and count go
by their bytes, cuts of equal score by the fewest first words. Repeated rows count each time. Columns other than text and lang are never read,
whatever their names. An empty table, and one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lectern.llm.common import forget, forget_path, scratch, shuffle_partitions, stored, table
from lectern.llm.hmm import planes, unplaned
from lectern.llm.words import BASE, FOLD, hash_words, mix, release, string_bytes

DEPTH, LEAST, MOST, SHARE = 5, 100, 2000, 100
#: Bytes of text of a shard, and of a step within it.
SHARD, STEP = 4 << 20, 1 << 20
GAP = np.zeros(256, bool)
GAP[[0x20, 0x09]] = True
STOP = np.zeros(256, bool)
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
#: Symbols of an index: the end of a piece, any infrequent word, then the frequent words.
END, RARE, FIRST = 0, 1, 2


def split_words(data: np.ndarray, off: np.ndarray, step: int = STEP) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words, whether a word begins a piece) of texts laid end to end, about `step` bytes at a time, cut between pieces only."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + step, n)
        if end < n:
            stops = np.flatnonzero(STOP[data[at:end]])
            doc = int(off[np.searchsorted(off, end, side="right") - 1])
            end = max(at + int(stops[-1]) + 1 if len(stops) else at, doc)
            if end <= at:  # a piece longer than a step
                stop = int(off[np.searchsorted(off, at, side="right")])
                end = stop
                for lo in range(at + step, stop, step):
                    later = np.flatnonzero(STOP[data[lo : min(lo + step, stop)]])
                    if len(later):
                        end = lo + int(later[0]) + 1
                        break
        seg = FOLD[data[at:end]]
        stop_here = STOP[seg]
        solid = ~(stop_here | GAP[seg])
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        heads = off[np.searchsorted(off, at, side="left") : np.searchsorted(off, end, side="left")] - at
        begin[heads] = solid[heads]
        first = np.flatnonzero(begin)
        if len(first):
            places = np.cumsum(solid, dtype=np.int32)
            starts = np.append(places[first] - 1, places[-1]).astype(np.int32)
            words = pa.StringArray.from_buffers(len(first), pa.py_buffer(starts.tobytes()), pa.py_buffer(seg[solid].tobytes()))
            breaks = np.cumsum(stop_here, dtype=np.int32)
            breaks = breaks[first] + np.searchsorted(heads, first, side="right")
            yield words, np.diff(breaks, prepend=-1) != 0
        at = end


class Shard:
    """Words of one language that wait to be coded."""

    def __init__(self):
        self.words: list[pa.Array] = []
        self.heads: list[np.ndarray] = []
        self.bytes = 0

    def add(self, words: pa.Array, heads: np.ndarray) -> None:
        heads[0] = True
        self.words.append(words)
        self.heads.append(heads)
        self.bytes += words.nbytes

    def coded(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(dictionary, counts, codes): codes are places in the dictionary, -1 stands before each piece."""
        coded = pa.chunked_array(self.words).dictionary_encode().combine_chunks()
        codes = coded.indices.to_numpy().astype(np.int32)
        return coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)), np.insert(codes, np.flatnonzero(np.concatenate(self.heads)), -1)


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """shard, lang, n_words, n_entries, words, counts (the shard's dictionary), codes (32-bit numbers), all three packed."""
    names = ["shard", "lang", "n_words", "n_entries", "words", "counts", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        open_shards: dict[str, Shard] = {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            words, counts, codes = open_shards.pop(lang).coded()
            made += 1
            rows = [part << 32 | made, lang, int(counts.sum()), len(words), pack_words(words), pack(counts), planes(codes.astype("<i4"))]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r], k) for r, k in zip(rows, kinds, strict=True)], names)

        for batch in batches:
            langs = pc.fill_null(batch.column("lang"), "und")
            for lang in pc.unique(langs).to_pylist():
                data, off = string_bytes(batch.column("text").filter(pc.equal(langs, lang)))
                for words, heads in split_words(data, off, min(STEP, size)):
                    open_shards.setdefault(lang, Shard()).add(words, heads)
                    if open_shards[lang].bytes > size:
                        yield closed(lang)
                while sum(s.bytes for s in open_shards.values()) > 2 * size:
                    yield closed(max(open_shards, key=lambda x: open_shards[x].bytes))
        for lang in list(open_shards):
            yield closed(lang)
        release()

    return docs.select("text", "lang").mapInArrow(run, "shard long, lang string, n_words long, n_entries long, words binary, counts binary, codes binary")


def transform(symbols: np.ndarray) -> np.ndarray:
    """The symbol before each suffix, suffixes in the order of their first DEPTH symbols; the sequence runs round."""
    rank, done = symbols.astype(np.int64), 1
    one = rank
    while done < DEPTH:  # twice as deep, or by one symbol
        other, step = (rank, done) if 2 * done <= DEPTH else (one, 1)
        _, rank = np.unique(rank * (int(other.max()) + 1) + np.roll(other, -done), return_inverse=True)
        done += step
    order = np.argsort(rank, kind="stable")
    return symbols[order - 1].astype(np.int32)


class FmIndex:
    """Ranks over a transform: extends intervals of phrases by the word before them (in a reversed transform, by the one after)."""

    def __init__(self, bwt: np.ndarray):
        self.bwt, self.n = bwt, len(bwt)
        order = np.argsort(bwt, kind="stable")
        self.keys = bwt[order].astype(np.int64) * self.n + order
        self.ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(bwt == END)])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row of the first suffix that begins with the symbol, plus the symbol's occurrences in the transform before `at`."""
        return np.searchsorted(self.keys, symbol.astype(np.int64) * self.n + at)

    def followed(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many of an interval's occurrences have a word of their piece beside them."""
        return size - (self.ends[lo + size] - self.ends[lo])

    def extend(self, lo: np.ndarray, size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of the interval, symbol, lo, size, lo in the other transform) of all extensions by a frequent word."""
        owner = np.repeat(np.arange(len(lo)), size)
        row = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner]
        top = int(self.bwt.max()) + 1
        key, count = np.unique(owner * top + self.bwt[row], return_counts=True)
        owner, symbol = key // top, key % top
        before = np.cumsum(count) - count
        before -= before[np.searchsorted(owner, owner)]
        keep = symbol >= FIRST
        owner, symbol, count, before = owner[keep], symbol[keep], count[keep], before[keep]
        return owner, symbol, self.rank(symbol, lo[owner]), count, other[owner] + before


def build(codes: np.ndarray, local: np.ndarray, gid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, transform of the reversed sequence, number of each symbol's word) from a shard's codes and its frequent words."""
    local, gid = local[np.argsort(local)], gid[np.argsort(local)]
    symbol = np.full(max(int(codes.max(initial=-1)), int(local.max(initial=-1))) + 2, RARE, np.int32)
    symbol[local] = np.arange(FIRST, FIRST + len(local))
    symbol[-1] = END
    t = np.append(symbol[codes], END)
    t = t[np.append(True, (t[1:] >= FIRST) | (t[1:] != t[:-1]))]  # runs of ends and of rare words are one
    return transform(t), transform(t[::-1]), gid


INDEX = "shard long, bwt binary, reversed binary, gids binary"
#: Entries of dictionaries, and phrases of shards, that a group of the exchanges has on average.
WORDS_GROUP, GRAMS_GROUP = 1 << 18, 1 << 21
WORD_SUMS = "kind int, shard long, data binary, gid long, lang string, word string, n long"
GRAM_SUMS = "kind int, shard long, data binary, gid long, p long, s long, n long, n_left long, n_right long"
#: Rows of an exchange's result: what is frequent, and what of it a shard holds.
FREQUENT, HELD = 0, 1


_packer, _unpacker = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of as many 64-bit numbers each, compressed byte by byte of all: most are small or alike."""
    whole = np.stack([np.asarray(c, "<i8") for c in columns])
    return bytes([len(whole)]) + _packer.compress(np.ascontiguousarray(whole.view(np.uint8).reshape(len(whole), -1, 8).transpose(0, 2, 1)).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    """The columns of pack() as rows of a matrix."""
    data = np.frombuffer(_unpacker.decompress(raw[1:]), np.uint8).reshape(raw[0], 8, -1)
    return np.ascontiguousarray(data.transpose(0, 2, 1)).view("<i8")[:, :, 0]


def pack_words(words: pa.Array) -> bytes:
    """No word holds a line's end."""
    return _packer.compress("\n".join(words.to_pylist()).encode())


def unpack_words(raw: bytes) -> pa.Array:
    return pa.array(_unpacker.decompress(raw).decode().split("\n"), pa.string())


def _gathered(column: pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns of all rows end to end, length of each row)."""
    rows = [unpack(x.as_py()) for x in column]
    return list(np.concatenate(rows, 1)), np.array([r.shape[1] for r in rows], np.int64)


def _runs(group: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, from, to) of sorted groups."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return list(zip(group[first].tolist(), first.tolist(), np.append(first, len(group))[1:].tolist(), strict=True))


def dealt_words(held: DataFrame, groups: int) -> DataFrame:
    """group, shard, lang, words, data (places in the shard's dictionary, counts): a shard's dictionary by hash of its words."""
    names = ["group", "shard", "lang", "words", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, counts = unpack_words(batch.column("words")[i].as_py()), unpack(batch.column("counts")[i].as_py())[0]
                group = (hash_words(words, fold=False)[0] % np.uint64(groups)).astype(np.int64)
                local = np.argsort(group, kind="stable")
                counts, runs, words = counts[local], _runs(group[local]), words.take(pa.array(local))
                same = lambda c: pa.array([batch.column(c)[i].as_py()] * len(runs), batch.column(c).type)  # noqa: B023, E731
                data = pa.array([pack(local[a:b], counts[a:b]) for _, a, b in runs], pa.binary())
                texts = pa.array([pack_words(words.slice(a, b - a)) for _, a, b in runs], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int64()), same("shard"), same("lang"), texts, data], names)
        release()

    return held.select("shard", "lang", "words", "counts").mapInArrow(run, "group long, shard long, lang string, words binary, data binary")


def summed_words(dealt: DataFrame, least: int) -> DataFrame:
    """WORD_SUMS: the words of at least `least` occurrences, and for each shard, packed, places in its dictionary with their numbers."""

    def run(t: pa.Table) -> pa.Table:
        langs = t["lang"].combine_chunks().dictionary_encode()
        words = pa.concat_arrays([unpack_words(x.as_py()) for x in t["words"]]).dictionary_encode()
        (local, counts), size = _gathered(t["data"])
        n_words = max(len(words.dictionary), 1)
        key, inverse = np.unique(np.repeat(langs.indices.to_numpy().astype(np.int64), size) * n_words + words.indices.to_numpy(), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, inverse, counts)
        often = np.flatnonzero(total >= least)
        gid = np.full(len(key), -1, np.int64)
        gid[often] = (t["group"][0].as_py() << 32) + np.arange(len(often))
        mine, ends = gid[inverse], np.cumsum(size)
        out = {"shard": [], "data": []}
        for i, (a, b) in enumerate(zip(ends - size, ends, strict=True)):
            known = np.flatnonzero(mine[a:b] >= 0) + a
            if len(known):
                out["shard"].append(t["shard"][i].as_py())
                out["data"].append(pack(local[known], mine[known]))
        rows = len(out["shard"])
        release()
        found = [langs.dictionary.take(pa.array(key[often] // n_words)), words.dictionary.take(pa.array(key[often] % n_words)), pa.array(total[often])]
        return _result(WORD_SUMS, out["shard"], out["data"], len(often), [pa.array(gid[often]), *found], rows)

    return dealt.groupBy("group").applyInArrow(run, WORD_SUMS)


def _result(schema: str, shard: list, data: list, n: int, found: list[pa.Array], rows: int) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    ahead = [pa.array([FREQUENT] * n + [HELD] * rows, pa.int32()), pa.array([None] * n + shard, pa.int64()), pa.array([None] * n + data, pa.binary())]
    return pa.table([*ahead, *(pa.concat_arrays([c, pa.nulls(rows, c.type)]) for c in found)], names)


def _index(one: pa.Table) -> tuple[FmIndex, FmIndex, np.ndarray]:
    read = lambda c, kind: unplaned(one.column(c)[0].as_py(), kind)
    return FmIndex(read("bwt", "<i4")), FmIndex(read("reversed", "<i4")), read("gids", "<i8")


def _dealt(shard: int, groups: int, p, s, n, lo, rlo, ahead: FmIndex, back: FmIndex) -> pa.Table:
    """group, shard, data: a shard's phrases by hash of their parts, and their counts. The places of their intervals stay: the index gives them again."""
    group = (mix(p.astype(np.uint64) * np.uint64(BASE) + s.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((s, p, group))
    p, s, n, lo, rlo = p[order], s[order], n[order], lo[order], rlo[order]
    alone = [n - ahead.followed(lo, n), n - back.followed(rlo, n)]
    runs = _runs(group[order])
    data = [pack(np.diff(p[a:b], prepend=0), *(c[a:b] for c in (s, n, *alone))) for _, a, b in runs]
    return pa.table([pa.array([r[0] for r in runs], pa.int64()), pa.array([shard] * len(runs), pa.int64()), pa.array(data, pa.binary())], ["group", "shard", "data"])


DEALT = "group long, shard long, data binary"


def _pairs(ahead: FmIndex, back: FmIndex, gids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first word, second word, size, lo, lo in the reversed transform): every frequent word, extended to the right."""
    size = np.bincount(ahead.bwt, minlength=FIRST + len(gids))
    first = (np.cumsum(size) - size)[FIRST:]
    owner, symbol, rlo, n, lo = back.extend(first, size[FIRST:], first)
    return gids[owner], gids[symbol - FIRST], n, lo, rlo


def _known(p: np.ndarray, s: np.ndarray, wanted_p: np.ndarray, wanted_s: np.ndarray) -> np.ndarray:
    """Where each wanted pair of numbers stands among the pairs (p, s), which hold it."""
    firsts, seconds = np.unique(p), np.unique(s)
    key = lambda a, b: np.searchsorted(firsts, a) * len(seconds) + np.searchsorted(seconds, b)
    own = key(p, s)
    order = np.argsort(own)
    return order[np.searchsorted(own[order], key(wanted_p, wanted_s))]


def _extended(gid: np.ndarray, n: np.ndarray, lo: np.ndarray, rlo: np.ndarray, ahead: FmIndex, back: FmIndex, right: bool) -> tuple[np.ndarray, ...]:
    """As _pairs(), of phrases of a word more: frequent ones extended to the right or to the left, if their other part is frequent, too."""
    # the interval of the other part holds the longer phrase's interval in the transform that reads from there
    inside = rlo if right else lo
    order = np.argsort(inside)
    owner, _, new, size, other = back.extend(rlo, n, lo) if right else ahead.extend(lo, n, rlo)
    part = order[np.maximum(np.searchsorted(inside[order], new, side="right") - 1, 0)]
    keep = (inside[part] <= new) & (new < inside[part] + n[part])
    owner, part, new, size, other = owner[keep], part[keep], new[keep], size[keep], other[keep]
    p, s = (owner, part) if right else (part, owner)
    return gid[p], gid[s], size, *((other, new) if right else (new, other))


def pairs(index: DataFrame, groups: int) -> DataFrame:
    """DEALT phrases of two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ahead, back, gids = _index(one := pa.table(batch.slice(i, 1)))
                yield from _dealt(one["shard"][0].as_py(), groups, *_pairs(ahead, back, gids), ahead, back).to_batches()
        release()

    return index.mapInArrow(run, DEALT)


def longer(index: DataFrame, frequent: DataFrame, groups: int, depth: int) -> DataFrame:
    """DEALT phrases of depth + 1 words. frequent: of, depth, data: the frequent phrases of two to depth words that a shard holds.

    A shard grows its phrases again from its words, level by level to the right and to the left in turns, which costs less than to send along where
    they are.
    """

    def run(one: pa.Table, held: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary())], ["group", "shard", "data"])
        if not one.num_rows or not held.num_rows:
            return none
        ahead, back, gids = _index(one)
        grown = _pairs(ahead, back, gids)
        for d in range(2, depth + 1):
            rows = held.filter(pc.equal(held["depth"], d))
            if not rows.num_rows:
                return none
            (p, s, gid), _ = _gathered(rows["data"])
            at = _known(grown[0], grown[1], p, s)
            grown = _extended(gid, *(c[at] for c in grown[2:]), ahead, back, right=d % 2 == 0)
        found = _dealt(one["shard"][0].as_py(), groups, *grown, ahead, back)
        release()
        return found

    return index.groupBy("shard").cogroup(frequent.groupBy("of")).applyInArrow(run, DEALT)


def summed_grams(dealt: DataFrame, least: int) -> DataFrame:
    """GRAM_SUMS: phrases of at least `least` occurrences over all shards, and for each shard, packed, those that it holds."""

    def run(t: pa.Table) -> pa.Table:
        (p, s, n, first, last), size = _gathered(t["data"])
        ends = np.cumsum(size)
        # first parts travel as differences within a row
        p = np.cumsum(p)
        p -= np.repeat(np.concatenate([np.zeros(1, np.int64), p[ends[:-1] - 1]]), size)
        order = np.lexsort((s, p))
        fresh = np.append(True, (np.diff(p[order]) != 0) | (np.diff(s[order]) != 0))
        heads = np.flatnonzero(fresh)
        total = np.add.reduceat(n[order], heads)
        often = total >= least
        gid = np.full(len(heads), -1, np.int64)
        gid[often] = (t["group"][0].as_py() << 32) + np.arange(often.sum())
        mine = np.empty(len(p), np.int64)
        mine[order] = gid[np.cumsum(fresh) - 1]
        shard, data = [], []
        for i, (a, b) in enumerate(zip(ends - size, ends, strict=True)):
            known = np.flatnonzero(mine[a:b] >= 0) + a
            if len(known):
                shard.append(t["shard"][i].as_py())
                data.append(pack(p[known], s[known], mine[known]))
        sums = [total[often], *((total - np.add.reduceat(c[order], heads))[often] for c in (first, last))]
        at = order[heads[often]]
        found = [pa.array(c) for c in (gid[often], p[at], s[at], *sums)]
        release()
        return _result(GRAM_SUMS, shard, data, int(often.sum()), found, len(shard))

    return dealt.groupBy("group").applyInArrow(run, GRAM_SUMS)


def described(grams: DataFrame, parts: DataFrame) -> DataFrame:
    """gid, lang, words, n, n_left, n_right, first and last (counts of all first and last parts) from the phrases of a word less."""
    p = parts.select(F.col("gid").alias("p"), "lang", F.col("words").alias("p_words"), F.col("first").alias("p_first"))
    s = parts.select(F.col("gid").alias("s"), F.element_at("words", -1).alias("s_word"), F.col("last").alias("s_last"))
    own = F.array("n")
    joined = grams.join(p, "p").join(s, "s")
    return joined.select("gid", "p", "s", "lang", F.concat("p_words", F.array("s_word")).alias("words"), "n", "n_left", "n_right", F.concat("p_first", own).alias("first"), F.concat("s_last", own).alias("last"))


def scored(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score, n_left, n_right: the cut of the least score, of equal ones the first."""
    cuts = F.expr("""array_min(transform(sequence(1, size(words) - 1), k -> struct(
        (CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)))
            div (CAST(first[k - 1] AS DECIMAL(16,0)) * CAST(last[size(words) - k - 1] AS DECIMAL(16,0))) AS score,
        k AS k, first[k - 1] AS l, last[size(words) - k - 1] AS r)))""")
    rows = grams.withColumnRenamed("n", "a").join(totals, "lang").withColumn("cut", cuts)
    return rows.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score", "n_left", "n_right")


def best(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` of each language with their rank: those of each share of a language first, then of all shares."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(rows.sparkSession)))).orderBy(*order)
    first = rows.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)


def bucketed(df: DataFrame, name: str):
    """(df, how to delete it) written under the shared folder, bucketed by shard, so that it meets other rows of its shards without an exchange."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    held = f"lectern_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(spark), "shard").sortBy("shard").option("path", path).format("parquet").saveAsTable(held)

    def drop() -> None:
        spark.sql(f"DROP TABLE {held}")
        forget_path(spark, path)

    return spark.table(held), drop


def mine(docs: DataFrame, least: int = LEAST, most: int = MOST, share: int = SHARE, shard_bytes: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, n_left, n_right. A phrase goes if a longer one that holds it has `share` percent of its count."""
    spark = docs.sparkSession
    held, drop_held = bucketed(shards(docs, shard_bytes), "shards")
    totals = stored(held.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    size = held.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_entries"), F.lit(0))).first()
    n_groups = lambda rows, each: max(shuffle_partitions(spark), rows // each)
    sums = stored(summed_words(dealt_words(held, n_groups(size[1], WORDS_GROUP)), least), "words")
    words = stored(sums.filter(F.col("kind") == FREQUENT).select("gid", "lang", F.array("word").alias("words"), "n", F.array("n").alias("first"), F.array("n").alias("last")), "words")

    def indexed(one: pa.Table, known: pa.Table) -> pa.Table:
        rows = [[]] * 4
        if one.num_rows:
            local, gid = _gathered(known["data"])[0] if known.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            built = build(unplaned(one["codes"][0].as_py(), "<i4"), local, gid)
            rows = [[one["shard"][0].as_py()], *([planes(c)] for c in built)]
            release()
        return pa.table([pa.array(r, k) for r, k in zip(rows, [pa.int64(), *[pa.binary()] * 3], strict=True)], ["shard", "bwt", "reversed", "gids"])

    of = lambda df: df.filter(F.col("kind") == HELD).select(F.col("shard").alias("of"), "data")
    index, drop_index = bucketed(held.select("shard", "codes").groupBy("shard").cogroup(of(sums).groupBy("of")).applyInArrow(indexed, INDEX), "index")
    drop_held()
    forget(sums)
    level, groups = [words], n_groups(size[0], GRAMS_GROUP)
    grams = [stored(summed_grams(pairs(index, groups), least), "grams")]
    for depth in range(2, DEPTH + 1):
        level.append(stored(described(grams[-1].filter(F.col("kind") == FREQUENT), level[-1]), "phrases"))
        if depth < DEPTH:
            held_phrases = reduce(DataFrame.unionByName, (of(g).withColumn("depth", F.lit(d)) for d, g in enumerate(grams, 2)))
            grams.append(stored(summed_grams(longer(index, held_phrases, groups, depth), least), "grams"))
    for step in grams:
        forget(step)
    drop_index()
    kept = []
    for phrases, above in zip(level[1:], [*level[2:], None], strict=True):
        if above is not None:
            longest = above.select(F.explode(F.array("p", "s")).alias("gid"), F.col("n").alias("m")).groupBy("gid").agg(F.max("m").alias("m"))
            phrases = phrases.join(longest, "gid", "left").filter(F.coalesce(100 * F.col("m") < share * F.col("n"), F.lit(True))).drop("m")
        kept.append(phrases.drop("gid", "p", "s"))
    found = kept[0]
    for x in kept[1:]:
        found = found.unionByName(x)
    return best(scored(found, totals), most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "n_left", "n_right")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, range(1, 6) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS c, count_if(i > 1) AS n_left, count_if(i + k <= len(w)) AS n_right FROM placed GROUP BY ALL),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
wanted AS (SELECT * FROM f WHERE k > 1 AND c >= 100),
inner_parts AS (
  SELECT lang, g[i:i + m - 1] AS g, max(c) AS most
  FROM (SELECT lang, g, c, m, unnest(range(1, k - m + 2)) AS i FROM wanted, range(2, 5) AS t(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT wanted.* FROM wanted LEFT JOIN inner_parts USING (lang, g) WHERE coalesce(100 * most < 100 * c, true)),
cuts AS (
  SELECT kept.*, j, l.c AS l, r.c AS r, n, ((1000::HUGEINT * kept.c * n) // (l.c::HUGEINT * r.c))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) AS kept JOIN totals USING (lang)
    JOIN f AS l ON l.lang = kept.lang AND l.g = kept.g[1:j] JOIN f AS r ON r.lang = kept.lang AND r.g = kept.g[j + 1:kept.k]),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, c DESC, array_to_string(g, ' ')) AS rank,
  array_to_string(g, ' ') AS phrase, c AS a, l, r, n, score, n_left::BIGINT AS n_left, n_right::BIGINT AS n_right
FROM least QUALIFY rank <= 2000
"""
