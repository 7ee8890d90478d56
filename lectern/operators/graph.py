"""Approximate vector search by a navigable proximity graph over each shard of the vectors.

Build: each task takes its rows in shards of at most SHARD_ROWS and links every distinct vector to near ones in different directions, so that
no shard grows with the data. in_whole_shards() deals rows to tasks so that shards are full however the input is cut: small shards cost more
per row, as a walk scores hundreds of nodes of each. The index is a table of one row per shard (keys, vectors, edges, entry points) and is kept as
Parquet; new vectors are further shards, appended.

Search: queries go in blocks to every shard; a beam walks the graph from the entry points to ever nearer vectors, all queries of a block in
step, and a window merges the best of all shards. Answers are scored in double precision. Equal vectors are one node that lists their keys, so copies,
however many, neither crowd the graph nor hide behind each other.

Rows without a key or a vector, with a null or non-finite component or a shorter vector than others of their shard are not indexed. A vector of no length is similar to nothing (score 0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a shard at most; links from a node before backward links are added; candidates for them; entry points of a shard.
SHARD_ROWS, DEGREE, CANDIDATES, ENTRIES = 1 << 14, 8, 64, 10
#: A candidate is not linked if one linked already is nearer to it by this factor than the node is.
SLACK = 1.2
QUERY_BLOCK = 1024
#: Nodes whose near ones are looked for at a time: with a shard's nodes they make a matrix, of 4 MB.
TILE = 64
#: A walk keeps the beam it is given, or a node for each so many of the shard if that is more: a beam that stays while shards grow finds ever less.
NODES_PER_BEAM = 52
NONE = -1


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def _nearest(unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities) of the n most similar other vectors of each, by blocks of products."""
    n = min(n, len(unit) - 1)
    places, scores = np.empty((len(unit), n), np.int64), np.empty((len(unit), n), np.float32)
    for a in range(0, len(unit), TILE):
        s = unit[a : a + TILE] @ unit.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        np.negative(s, out=s)
        at = np.argpartition(s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.argsort(s, axis=1)[:, :n]
        found = -np.take_along_axis(s, at, 1)
        order = np.argsort(-found, axis=1, kind="stable")
        places[a : a + TILE], scores[a : a + TILE] = np.take_along_axis(at, order, 1), np.take_along_axis(found, order, 1)
    return places, scores


def _diverse(unit: np.ndarray, places: np.ndarray, scores: np.ndarray, degree: int) -> np.ndarray:
    """Of each node's candidates, nearest first, those that no chosen one covers; up to `degree`, the rest NONE."""
    out = np.full((len(unit), degree), NONE, np.int64)
    for a in range(0, len(unit), 256):
        near, own = places[a : a + 256], 1 - scores[a : a + 256]
        between = 1 - np.einsum("bid,bjd->bij", unit[near], unit[near])
        chosen, count = np.zeros(near.shape, bool), np.zeros(len(near), np.int64)
        for j in range(near.shape[1]):
            covered = (chosen & (between[:, j] * SLACK <= own[:, j, None])).any(1)
            take = ~covered & (count < degree)
            out[a : a + 256][take, count[take]] = near[take, j]
            chosen[:, j] = take
            count += take
    return out


def _both_ways(edges: np.ndarray, unit: np.ndarray, most: int) -> np.ndarray:
    """edges and their reverses, the `most` nearest of each node."""
    a, b = np.repeat(np.arange(len(edges)), edges.shape[1]), edges.ravel()
    a, b = a[b >= 0], b[b >= 0]
    pairs = np.unique(np.concatenate([a * len(edges) + b, b * len(edges) + a]))
    a, b = pairs // len(edges), pairs % len(edges)
    order = np.lexsort((-(unit[a] * unit[b]).sum(1), a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((len(edges), most), NONE, np.int32)
    keep = place < most
    out[a[keep], place[keep]] = b[keep]
    return out


def _reached(edges: np.ndarray, start: np.ndarray, seen: np.ndarray) -> None:
    """Mark all that edges lead to from the start."""
    while len(start):
        seen[start] = True
        step = np.unique(edges[start])
        start = step[(step >= 0) & ~seen[np.maximum(step, 0)]]


def link(unit: np.ndarray, degree: int = DEGREE, entries: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entry points) of a graph in which every node can be reached from the entry points."""
    n = len(unit)
    start = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int64))
    if n == 1:
        return np.full((1, 1), NONE, np.int32), start
    edges = _both_ways(_diverse(unit, *_nearest(unit, CANDIDATES), degree), unit, 2 * degree)
    seen = np.zeros(n, bool)
    _reached(edges, start, seen)
    while not seen.all():
        # the lost node nearest to what is reached becomes an entry point, which reaches its whole part of the graph
        lost, found = np.flatnonzero(~seen), np.flatnonzero(seen)
        best = np.concatenate([(unit[lost[a : a + 1024]] @ unit[found].T).max(1) for a in range(0, len(lost), 1024)])
        start = np.append(start, lost[best.argmax()])
        _reached(edges, start[-1:], seen)
    return edges, start


def walk(queries: np.ndarray, unit: np.ndarray, edges: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the `beam` best nodes found for each query, NONE where fewer; nodes scored for it)."""
    m, n = len(queries), len(unit)
    beam = max(beam, 1)
    seen = np.zeros((m, n + 1), bool)  # NONE is the last column
    seen[:, n] = True
    places, scores, spent = np.full((m, beam), NONE), np.full((m, beam), -np.inf, np.float32), np.zeros((m, beam), bool)
    scored = np.full(m, len(start), np.int64)
    seen[:, start] = True
    live, new, new_score = np.arange(m), np.tile(start, (m, 1)), queries @ unit[start].T
    while len(live):
        all_places = np.concatenate([places[live], new], 1)
        all_scores = np.concatenate([scores[live], new_score], 1)
        all_spent = np.concatenate([spent[live], np.zeros(new.shape, bool)], 1)
        order = np.argsort(-all_scores, axis=1, kind="stable")[:, :beam]
        places[live], scores[live], spent[live] = (np.take_along_axis(x, order, 1) for x in (all_places, all_scores, all_spent))
        open_scores = np.where(spent[live] | (places[live] < 0), -np.inf, scores[live])
        best = open_scores.argmax(1)
        going = open_scores[np.arange(len(live)), best] > -np.inf
        live, best = live[going], best[going]
        spent[live, best] = True
        new = edges[places[live, best]].astype(np.int64)
        fresh = ~seen[live[:, None], new]
        seen[live[:, None], new] = True
        scored[live] += fresh.sum(1)
        new_score = np.where(fresh, np.einsum("md,mrd->mr", queries[live], unit[new]), -np.inf)
        new = np.where(fresh, new, NONE)
    return places, scored


def _whole(column: pa.ChunkedArray, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the vectors of the given length, or the greatest one, that have no null and no non-finite component; read from Arrow's buffers."""
    lists = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    dims = length.max(initial=0) if dims is None else dims
    places = np.flatnonzero(length == dims) if dims else np.zeros(0, np.int64)
    # nulls come as NaN
    x = lists.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(places), dims)
    good = np.isfinite(x).all(1)
    return places[good], x[good]


def in_whole_shards(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The vectors dealt into as few even partitions as hold at most about shard_rows rows each."""
    return vectors.repartition(whole_shards(vectors, shard_rows))


def whole_shards(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
    return vectors.count() // shard_rows + 1


def build_graph(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD_ROWS, degree: int = DEGREE) -> DataFrame:
    """shard, n_rows, dims, keys (of each node an array), vectors, edges, width of edges, entries. One row per shard, no shuffle."""
    kind = vectors.schema[key].dataType
    names = ["shard", "n_rows", "dims", "keys", "vectors", "edges", "width", "entries"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.list_(to_arrow_type(kind))), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, waiting, held = TaskContext.get().partitionId(), 0, [], 0

        def shard() -> pa.RecordBatch | None:
            nonlocal made
            rows = pa.Table.from_batches(waiting)
            keys = rows["k"].to_pylist()
            places, x = _whole(rows["v"])
            if not len(x):
                return None
            x, node = np.unique(x, axis=0, return_inverse=True)
            owners: list[list] = [[] for _ in x]
            for i, at in zip(node.ravel(), places, strict=True):
                owners[i].append(keys[at])
            edges, start = link(_unit(x), degree)
            made += 1
            cells = [part << 32 | made, len(places), x.shape[1], owners, x.astype("<f8").tobytes(), edges.astype("<i4").tobytes(), edges.shape[1], start.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, shard_rows - held)
                waiting.append(piece)
                held, at = held + piece.num_rows, at + piece.num_rows
                if held == shard_rows:
                    if (row := shard()) is not None:
                        yield row
                    waiting, held = [], 0
        if held and (row := shard()) is not None:
            yield row

    schema = f"shard long, n_rows long, dims int, keys array<array<{kind.simpleString()}>>, vectors binary, edges binary, width int, entries array<long>"
    return vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("v")).mapInArrow(run, schema)


def graph_top_k(index: DataFrame, queries: DataFrame, k: int, beam: int = 32, key: str = "vec_id", query_key: str = "query_id", column: str = "embedding", slots: int | None = None) -> DataFrame:
    """query_id, key, score, rank, n_scored: about the k best vectors of each query, and how many nodes were scored for it over all shards.

    A stated query set against all shards: shards go to slots by their number, and each block of queries meets each slot in a task
    of its own. Ties go by key. Queries without a vector find nothing. slots is the number of shards, where it is known: an index that is not kept is
    built once more to count them.
    """
    n_blocks, n_slots = max(1, -(-queries.count() // QUERY_BLOCK)), slots or max(1, index.count())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    asked = queries.filter(F.col(column).isNotNull()).select(query_key, F.col(column).alias("q"), dealt(query_key, n_blocks).alias("block"), every(n_slots).alias("slot"))
    held = index.select("dims", "keys", "vectors", "edges", "width", "entries", dealt("shard", n_slots).alias("slot"), every(n_blocks).alias("block"))
    kinds = [queries.schema[query_key].dataType, index.schema["keys"].dataType.elementType.elementType]
    names = [query_key, key, "score", "n_scored"]
    types = [*map(to_arrow_type, kinds), pa.float64(), pa.int64()]

    def search(one: pa.Table, other: pa.Table) -> pa.Table:
        ids = one.column(query_key).to_pylist()
        rows: list[tuple] = []
        for shard in other.to_pylist():
            fits, q = _whole(one.column("q"), shard["dims"])
            if not len(q):
                continue
            x = np.frombuffer(shard["vectors"], "<f8").reshape(-1, shard["dims"])
            edges = np.frombuffer(shard["edges"], "<i4").reshape(len(x), shard["width"])
            places, scored = walk(_unit(q), _unit(x), edges, np.array(shard["entries"]), max(beam, k, len(x) // NODES_PER_BEAM))
            length = np.linalg.norm(x, axis=1)
            for i, found, n in zip(range(len(fits)), places, scored.tolist(), strict=True):
                found = found[found >= 0]
                size = np.linalg.norm(q[i]) * length[found]
                score = np.divide(x[found] @ q[i], size, out=np.zeros(len(found)), where=size > 0)
                best = sorted((-s, key_) for s, node in zip(score.tolist(), found.tolist(), strict=True) for key_ in sorted(shard["keys"][node])[:k])[:k]
                rows += [(ids[fits[i]], key_, -s, n if r == 0 else 0) for r, (s, key_) in enumerate(best)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)], names)

    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, [*(x.simpleString() for x in kinds), "double", "long"], strict=True))
    found = asked.groupBy("slot", "block").cogroup(held.groupBy("slot", "block")).applyInArrow(search, schema)
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    ranked = found.withColumns({"rank": F.row_number().over(w), "n_scored": F.sum("n_scored").over(Window.partitionBy(query_key))})
    return ranked.filter(F.col("rank") <= k).select(query_key, key, "score", "rank", "n_scored")
