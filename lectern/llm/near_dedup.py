"""Near-duplicate groups by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of five-word shingles over all documents, counted in a sketch of WIDTH cells
   (the mean load of a cell is taken off, so rare shingles count as rare at any size). The weight of
   a shingle is tf * (1 + IDF_WEIGHT * idf / idf of a rare one): common passages weigh less, while a
   large group of near copies does not lose its own likeness by being large.
2. Texts with equal words are one node. Each node has BANDS keys of ROWS samples.
3. Nodes that share a key are candidates. In keys of up to SMALL nodes all pairs are taken; pairs whose samples
   agree in under AGREE of all are dropped (at a similarity of 0.8, seven standard deviations away) and the others
   are verified from their texts. Nodes linked by larger keys form clumps, which are compared
   whole, block against block, without emitting pairs: each block comparison returns a spanning forest, and
   how many links each node has in it.
4. Links of a weighted Jaccard similarity of SIMILARITY or more join nodes into classes.

Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased. A text of one to four
words has one shingle; texts without words (null too) are copies of each other. Very long texts are read whole. class_id is the least
doc_id of the class (null if all are null); exactly one row of each class is kept, one of that doc_id.
Repeated rows are copies, rows with a null or repeated doc_id and other text are texts of their own: texts are found again by doc_id and a hash of the
text, and compared by their words' digests. Other columns pass through drop_near_copies() unread, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import forget, packed, shuffle_partitions, stored, table, unpacked
from lectern.llm.components import components
from lectern.llm.weighted_minhash import Sampler
from lectern.llm.words import by_bytes, hash_shingles, hash_words, mix

SIMILARITY, SHINGLE = 0.8, 5
WIDTH_BITS, CELL_BITS = 20, 14
IDF_WEIGHT, RARE_DF = 0.25, 8.0
ROWS, BANDS = 5, 20
SMALL, AGREE = 64, 0.5
#: Similarities from products of matrices are verified from the sets where they come this close to SIMILARITY.
BAND = 1e-4
#: Most nodes, and about most words, in a block of a clump.
BLOCK_NODES, BLOCK_WORDS = 256, 1 << 21
COLUMNS = 1 << 12


def _counted(column: pa.Array):
    """words, word offsets, distinct shingles, their times, shingle offsets."""
    words, off = hash_words(column)
    shingles, soff = hash_shingles(words, off, SHINGLE)
    parts = [np.unique(shingles[a:b], return_counts=True) for a, b in zip(soff[:-1], soff[1:], strict=True)]
    sizes = np.array([0, *(len(p[0]) for p in parts)])
    if not len(shingles):
        return words, off, shingles, np.zeros(0, np.int64), np.cumsum(sizes)
    return words, off, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.cumsum(sizes)


class ShingleWeights:
    """tf * (1 + IDF_WEIGHT * relative idf), from a table of 2**WIDTH_BITS bytes: the idf in 255ths."""

    def __init__(self, loads: np.ndarray, documents: int):
        df = np.maximum(loads - loads.sum() / len(loads), RARE_DF)
        idf = np.log1p(documents / df) / np.log1p(documents / RARE_DF) if documents else np.ones(len(loads))
        self.idf = np.rint(255 * idf).astype(np.uint8)

    def relative(self, shingle: np.ndarray) -> np.ndarray:
        return 1 + IDF_WEIGHT / 255 * self.idf[(shingle >> np.uint64(64 - WIDTH_BITS)).astype(np.intp)]


def shingle_weights(docs: DataFrame) -> ShingleWeights:
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    cells = 1 << CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads, documents = np.zeros(1 << WIDTH_BITS, np.int64), 0
        for batch in batches:
            for part in by_bytes(batch, "text"):
                shingles = _counted(part.column("text"))[2]
                loads += np.bincount((shingles >> np.uint64(64 - WIDTH_BITS)).astype(np.intp), minlength=len(loads))
                documents += part.num_rows
        if documents:
            block = np.arange(len(loads) // cells, dtype=np.int32)
            packed = [loads[b * cells : (b + 1) * cells].astype("<u4" if loads.max() < 1 << 32 else "<u8").tobytes() for b in block]
            yield pa.RecordBatch.from_arrays([pa.array(block % n, pa.int32()), pa.array(block), pa.array(packed, pa.binary()), pa.array([documents] * len(block), pa.int64())], ["slot", "block", "loads", "documents"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, raw, documents in zip(*(batch.column(c).to_pylist() for c in ("block", "loads", "documents")), strict=True):
                held = sums.setdefault(block, [np.zeros(cells, np.int64), 0])
                held[0] += np.frombuffer(raw, "<u4" if len(raw) == 4 * cells else "<u8").astype(np.int64)
                held[1] += documents
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0].astype("<i8").tobytes() for x in sums.values()], pa.binary()), pa.array([x[1] for x in sums.values()], pa.int64())], ["block", "loads", "documents"])

    counted = docs.select("text").mapInArrow(count, "slot int, block int, loads binary, documents long")
    summed = counted.repartitionById(n, "slot").drop("slot").mapInArrow(add, "block int, loads binary, documents long")
    loads, documents = np.zeros(1 << WIDTH_BITS, np.int64), 0
    for r in summed.toLocalIterator():  # 2**(WIDTH_BITS - CELL_BITS) rows, whatever the corpus
        loads[r["block"] * cells : (r["block"] + 1) * cells] = np.frombuffer(r["loads"], "<i8")
        documents = r["documents"]
    return ShingleWeights(loads, documents)


def signatures(docs: DataFrame, weights: ShingleWeights, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, text_hash, words_digest, n_words, keys, sketch. keys: one long per band, null for no words; sketch: 16 bits of each sample."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(rows * bands)
        band = mix(np.arange(1, bands + 1, dtype=np.uint64))
        known: dict[bytes, tuple] = {}
        for batch in batches:
            for part in by_bytes(batch, "text"):
                words, off, shingle, times, soff = _counted(part.column("text"))
                digests = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(off[:-1], off[1:], strict=True)]
                new = {d: i for i, d in enumerate(digests) if d not in known and soff[i + 1] > soff[i]}
                if len(known) > 20_000:
                    known = {}
                    new = {d: i for i, d in enumerate(digests) if soff[i + 1] > soff[i]}
                if new:
                    at = np.concatenate([np.arange(soff[i], soff[i + 1]) for i in new.values()])
                    sizes = np.cumsum([0, *(soff[i + 1] - soff[i] for i in new.values())])
                    found = sampler.sample(shingle[at], times[at] * shared.value.relative(shingle[at]), sizes)
                    keys = band.copy()[None, :].repeat(len(found), 0)
                    for k in range(rows):
                        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + found[:, k::rows])
                    for d, key, samples in zip(new, keys.view(np.int64), found, strict=True):
                        known[d] = key.tolist(), (samples & np.uint64(0xFFFF)).astype("<u2").tobytes()
                got = [known.get(d, (None, None)) for d in digests]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(digests, pa.binary()), pa.array(np.diff(off)), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.binary())],
                    ["doc_id", "text_hash", "words_digest", "n_words", "keys", "sketch"],
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, text_hash long, words_digest binary, n_words long, keys array<long>, sketch binary")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash: by the last two a row is found again where ids are null or repeated."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def node_table(signed: DataFrame) -> DataFrame:
    """node, words_digest, doc_id (the least) and text_hash of one of its rows, again (whether rows repeat that), copies, n_words, keys, sketch: one row per distinct word sequence."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash"))
    nodes = signed.groupBy("words_digest").agg(least.alias("r"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = nodes.select("words_digest", "r.doc_id", "r.text_hash", "copies", "n_words", "keys", "sketch")
    repeated = signed.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).count().filter("count > 1").select("_id", "_hash", F.lit(True).alias("again"))
    nodes = nodes.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_id", "_hash")
    return nodes.na.fill(False, ["again"]).withColumn("node", F.monotonically_increasing_id())


def node_texts(docs: DataFrame, nodes: DataFrame, repeats: bool = True) -> DataFrame:
    """node, text (and any other column of nodes) of the given nodes, each once. repeats: whether any rows repeat both an id and a text."""
    rows = texts_of(docs).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})

    def same_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, off = hash_words(batch.column("text"))
            digests = batch.column("words_digest").to_pylist()
            yield batch.filter(pa.array([hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() == d for a, b, d in zip(off[:-1], off[1:], digests, strict=True)]))

    def found(some: DataFrame) -> DataFrame:
        joined = rows.join(some, rows["_id"].eqNullSafe(some["doc_id"]) & (rows["_hash"] == some["text_hash"])).drop("_id", "_hash", "doc_id", "text_hash", "again")
        return joined.mapInArrow(same_words, joined.schema).drop("words_digest")

    if not repeats:
        return found(nodes)
    # rows that repeat both an id and a text are one again before they are shuffled
    return found(nodes.filter(~F.col("again"))).unionByName(found(nodes.filter("again")).dropDuplicates(["node"]))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 1.0


def verified_pairs(pairs: DataFrame, texts: DataFrame, weights: ShingleWeights) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have at least SIMILARITY, with it."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    first, second = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for part in by_bytes(batch, "text_a", 2 << 20):
                sides = []
                for x in "ab":
                    ids = part.column(x).to_pylist()
                    new = {v: i for i, v in enumerate(ids) if v not in held}
                    if len(held) > 500:
                        held = {v: held[v] for v in {*part.column("a").to_pylist(), *part.column("b").to_pylist()} if v in held}
                    if new:
                        _, _, shingle, times, off = _counted(part.column(f"text_{x}").take(pa.array(list(new.values()))))
                        for v, lo, hi in zip(new, off[:-1], off[1:], strict=True):
                            held[v] = shingle[lo:hi], times[lo:hi] * shared.value.relative(shingle[lo:hi])
                    sides.append(ids)
                s = [similarity(held[a], held[b]) for a, b in zip(*sides, strict=True)]
                keep = pa.array([x >= SIMILARITY for x in s])
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(s)], ["a", "b", "similarity"]).filter(keep)

    return both.mapInArrow(run, "a long, b long, similarity double").distinct()


def small_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes that share a key of at most SMALL nodes and agree in enough samples."""
    few = members.filter(F.col("n") <= SMALL).select("key", "node")
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    sketches = nodes.select("node", "sketch")
    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in "xy")
            keep = (x == y).mean(1) >= AGREE if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "x", "y").mapInArrow(agree, "a long, b long")


def spanning_links(node: np.ndarray, side: np.ndarray, shingles: list[np.ndarray], weights: list[np.ndarray], own: bool) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """A spanning forest of the links between the sets of two blocks (side 0 and 1), or (own) among those of one, and how many links each set has.

    Overlaps come from products of (set, shingle) matrices; a shingle that stands tf times is tf columns.
    """
    rows = [i for i in range(len(node)) if len(shingles[i])]
    count = np.zeros(len(node), np.int64)
    if len(rows) < 2 or not own and (side.all() or not side.any()):
        return [], count
    total = np.array([weights[i].sum() if len(shingles[i]) else 0.0 for i in range(len(node))])
    row = np.repeat(rows, [len(shingles[i]) for i in rows])
    element = np.concatenate([shingles[i] for i in rows])
    weight = np.concatenate([weights[i] for i in rows])
    order = np.argsort(element, kind="stable")
    element, row, weight = element[order], row[order], weight[order]
    new = np.ones(len(element), bool)
    new[1:] = element[1:] != element[:-1]
    group = np.cumsum(new) - 1
    common = np.bincount(group)[group] > 1
    group, row, weight = group[common], row[common], weight[common]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if own else 1))
    place = np.zeros(len(node), np.int64)
    place[left] = np.arange(len(left))
    across = np.zeros(len(node), np.int64)
    across[right] = np.arange(len(right))
    overlap = np.zeros((len(left), len(right)))
    if len(group):
        _, group = np.unique(group, return_inverse=True)
        bounds = np.searchsorted(group, np.arange(0, group[-1] + 1 + COLUMNS, COLUMNS))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if lo == hi:
                continue
            column, r, w = group[lo:hi] - group[lo], row[lo:hi], weight[lo:hi]
            # layers of equal weight steps make min(tf, tf') * idf a sum of products
            unit = np.full(int(column.max()) + 1, np.inf)
            np.minimum.at(unit, column, w)
            while len(w):
                step = unit[column]
                height = np.where(np.isfinite(step), step, 0.0)
                dense_l = np.zeros((len(left), len(unit)), np.float32)
                dense_r = np.zeros((len(right), len(unit)), np.float32)
                is_l = side[r] == 0
                dense_l[place[r[is_l]], column[is_l]] = height[is_l]
                is_r = is_l if own else side[r] == 1
                dense_r[across[r[is_r]], column[is_r]] = 1.0
                overlap += dense_l @ dense_r.T
                w = w - step
                more = w > 1e-9
                column, r, w = column[more], r[more], w[more]
                unit = np.full(len(unit), np.inf)
                np.minimum.at(unit, column, w)
    union = total[left][:, None] + total[right][None, :] - overlap
    close = (overlap >= (SIMILARITY - BAND) * union) & (union > 0)
    if own:
        np.fill_diagonal(close, False)
    for i, j in zip(*np.nonzero(close & (overlap < (SIMILARITY + BAND) * union)), strict=True):
        close[i, j] = similarity((shingles[left[i]], weights[left[i]]), (shingles[right[j]], weights[right[j]])) >= SIMILARITY
    count[left] = close.sum(1)
    if not own:
        count[right] = close.sum(0)
    parent = {int(v): int(v) for v in node}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    links = []
    for i, j in zip(*np.nonzero(close), strict=True):
        a, b = int(left[i]), int(right[j])
        u, v = root(int(node[a])), root(int(node[b]))
        if u != v:
            s = similarity((shingles[a], weights[a]), (shingles[b], weights[b]))
            parent[max(u, v)] = min(u, v)
            links.append((min(int(node[a]), int(node[b])), max(int(node[a]), int(node[b])), s))
    return links, count


def clump_links(labels: DataFrame, nodes: DataFrame, docs: DataFrame, weights: ShingleWeights, repeats: bool = True) -> DataFrame:
    """a, b, similarity, n: enough links to join each clump (n is 0), and the numbers n of links that its nodes have (b is null)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    inside = nodes.select("node", "doc_id", "text_hash", "again", "words_digest", "n_words").join(labels, "node")
    # sets whose sizes differ by a factor of four or more never reach the similarity: only the same or the next class of size meets
    size = F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")
    per_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_NODES), F.floor(F.lit(float(BLOCK_WORDS)) / F.pow(F.lit(2.0), F.col("size") + 1)))).cast("long")
    counts = inside.groupBy("label", size.alias("size")).agg(F.count("*").alias("n"))
    blocks = counts.select("label", "size", F.ceil(F.col("n") / per_block).cast("long").alias("blocks"))
    later = blocks.select("label", (F.col("size") - 1).alias("size"), F.col("blocks").alias("next_blocks"))
    before = blocks.select("label", (F.col("size") + 1).alias("size"), F.col("blocks").alias("last_blocks"))
    plan = blocks.join(later, ["label", "size"], "left").join(before, ["label", "size"], "left").na.fill(0)
    placed = inside.withColumn("size", size).join(plan, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.col("size").alias("s"), F.least("block", k).alias("i"), F.lit(0).alias("d"), F.greatest("block", k).alias("j"), F.when(F.col("block") <= k, 0).otherwise(1).alias("side")))
    up = F.when(F.col("next_blocks") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("next_blocks") - 1), lambda k: F.struct(F.col("size").alias("s"), F.col("block").alias("i"), F.lit(1).alias("d"), k.alias("j"), F.lit(0).alias("side"))))
    down = F.when(F.col("last_blocks") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("last_blocks") - 1), lambda k: F.struct((F.col("size") - 1).alias("s"), k.alias("i"), F.lit(1).alias("d"), F.col("block").alias("j"), F.lit(1).alias("side"))))
    empty = F.array().cast("array<struct<s:int,i:bigint,d:int,j:bigint,side:int>>")
    meets = placed.select("node", "doc_id", "text_hash", "again", "words_digest", "label", F.concat(own, F.coalesce(up, empty), F.coalesce(down, empty)).alias("meets"))
    texts = node_texts(docs, meets, repeats)
    dealt = texts.select("node", "text", "label", F.explode("meets").alias("m")).select("node", "text", "label", "m.*")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        _, _, shingle, times, off = _counted(pa.array(group["text"].tolist(), pa.large_string()))
        weight = times * shared.value.relative(shingle)
        cut = [slice(a, b) for a, b in zip(off[:-1], off[1:], strict=True)]
        own = bool((group["d"] == 0).all() and (group["i"] == group["j"]).all())
        node = group["node"].to_numpy()
        links, count = spanning_links(node, group["side"].to_numpy(), [shingle[c] for c in cut], [weight[c] for c in cut], own)
        rows = [(*x, 0) for x in links] + [(int(node[k]), None, None, int(count[k])) for k in np.flatnonzero(count)]
        return pd.DataFrame(rows, columns=["a", "b", "similarity", "n"]).astype({"a": "int64", "b": "Int64", "similarity": "float64", "n": "int64"})

    return dealt.groupBy("label", "s", "i", "d", "j").applyInPandas(compare, "a long, b long, similarity double, n long")


def near_links(docs: DataFrame, nodes: DataFrame, weights: ShingleWeights, repeats: bool = True) -> DataFrame:
    """a, b, similarity, n: enough links between nodes to join every class; the n of its rows add up to a node's number of links. Stored."""
    keys = nodes.filter(F.col("keys").isNotNull()).select("node", F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    members = stored(keys.join(sizes, "key"), "members")
    labels = components(members.filter(F.col("n") > SMALL).select(F.col("node").alias("a"), F.col("least").alias("b")))
    # pairs within a clump are compared there
    label_a, label_b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    apart = small_pairs(members, nodes).join(label_a, "a", "left").join(label_b, "b", "left").filter(~F.col("label_a").eqNullSafe(F.col("label_b")) | F.col("label_a").isNull())
    pairs = stored(apart.select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = stored(node_texts(docs, nodes.select("node", "doc_id", "text_hash", "again", "words_digest").join(wanted, "node"), repeats), "texts")
    links = verified_pairs(pairs, texts, weights).withColumn("n", F.lit(1).cast("long"))
    found = stored(links.unionByName(clump_links(labels, nodes, docs, weights, repeats)), "links")
    for step in (members, pairs, texts):
        forget(step)
    return found


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, words_digest, class_id, group_size, n_links, kept: one row per row of docs.

    group_size counts documents; n_links the other texts that a text of the row is linked to, in groups of any size.
    """
    return _grouped(docs)[0]


def _grouped(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(near_groups(), whether any rows repeat both an id and a text)."""
    weights = shingle_weights(docs)
    signed = stored(signatures(docs, weights).withColumn("row", F.monotonically_increasing_id()), "signed")
    nodes = stored(node_table(signed), "nodes")
    repeats = not signed.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty()
    links = near_links(docs, nodes, weights, repeats)
    labels = components(links.filter("b IS NOT NULL").select("a", "b"))
    ends = links.select(F.col("a").alias("node"), "n").unionByName(links.filter("b IS NOT NULL").select(F.col("b").alias("node"), "n")).groupBy("node").agg(F.sum("n").alias("n_links"))
    classed = nodes.select("node", "words_digest", "doc_id", "copies").join(labels, "node", "left").join(ends, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = classed.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "node"))["node"].alias("keeper"))
    per_digest = classed.join(classes, "label").select("words_digest", "class_id", "group_size", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), (F.col("keeper") == F.col("node")).alias("keeper"))
    rows = signed.select("doc_id", "text_hash", "words_digest", "row")
    least = rows.groupBy("words_digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row"))["row"].alias("first"))
    found = rows.join(per_digest.join(least, "words_digest"), "words_digest").select("doc_id", "text_hash", "words_digest", "class_id", "group_size", "n_links", (F.col("keeper") & (F.col("row") == F.col("first"))).alias("kept"))
    return found, repeats


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of docs."""
    groups, repeats = _grouped(docs)
    keep = groups.filter("kept").select(F.col("doc_id").alias("_keep_id"), F.col("text_hash").alias("_keep_hash"), F.col("words_digest").alias("_keep_digest"))
    inner = packed(docs, "doc_id", "text")
    rows = inner.join(keep, inner["doc_id"].cast("long").eqNullSafe(keep["_keep_id"]) & (F.xxhash64(inner["text"]) == keep["_keep_hash"]))
    cut = rows.schema

    def same_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, off = hash_words(batch.column(batch.schema.get_field_index("text")))
            digests = batch.column("_keep_digest").to_pylist()
            yield batch.filter(pa.array([hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() == d for a, b, d in zip(off[:-1], off[1:], digests, strict=True)]))

    kept = rows.mapInArrow(same_words, cut)
    if repeats:  # else each kept row is found once, and need not be shuffled again
        kept = kept.dropDuplicates(["_keep_id", "_keep_digest"])
    return unpacked(kept, docs.columns, "doc_id", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_size", "n_links", "kept")
