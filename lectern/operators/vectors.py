"""Vector search: exact cosine top-k, per group, with filters and thresholds; embeddings by name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a block of queries and of a slice of vectors: a block and a slice make a matrix of scores in one task.
QUERY_BLOCK, SLICE = 2048, 8192
#: Queries of a block that are scored at a time, so that a task holds a small part of that matrix.
QUERY_TILE = 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int, threshold: float | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows most similar to one query, ties by key; those below the threshold go afterwards."""
    # the query's length is known here; the products of a row's cells stay in the JVM
    length = float(np.linalg.norm(np.array(query, np.float64)))
    q = F.array(*(F.lit(float(x)) for x in query))
    score = F.coalesce(F.try_divide(dot(F.col(column), q), F.sqrt(dot(F.col(column), F.col(column))) * F.lit(length)), F.lit(0.0))
    scored = vectors.withColumn("score", score).drop(column)
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix, read from Arrow's own buffer where nothing is missing."""
    if not len(column):
        return np.zeros((0, 0))
    lists = column.combine_chunks()
    values = lists.flatten()
    if lists.null_count == 0 and values.null_count == 0 and len(values) % len(lists) == 0 and pc.all(pc.equal(pc.list_value_length(lists), len(values) // len(lists))).as_py():
        return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return np.array(column.to_pylist(), np.float64)


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest entries of each row above -inf, falling; of equal ones the first columns."""
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else score.min(1)
    row, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", column: str = "embedding", skip_self: bool = False, group: str | None = None) -> DataFrame:
    """query_id, key, score, rank (and group): the k best vectors of each query, of each group if one is named.

    A stated set of queries against all rows: queries are dealt into blocks of about QUERY_BLOCK and vectors into slices of about SLICE
    rows, each block meets each slice in a task of its own, which keeps the k best per query and group by matrix products.
    Up to QUERY_BLOCK queries, every vector moves once. Neither side passes through the driver. A window takes the k best of all slices.
    """
    n_blocks, n_slices = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (vectors, SLICE)))
    kinds = {c: vectors.schema[c].dataType for c in [key, *([group] if group else [])]}
    kind = queries.schema[query_key].dataType
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    asked = queries.select(query_key, F.col(column).alias("q"), dealt(query_key, n_blocks).alias("block"), every(n_slices).alias("slice"))
    held = vectors.select(key, *([group] if group else []), F.col(column).alias("v"), dealt(key, n_slices).alias("slice"), every(n_blocks).alias("block"))
    names = [query_key, key, "score", *([group] if group else [])]
    types = [to_arrow_type(kind), to_arrow_type(kinds[key]), pa.float64(), *([to_arrow_type(kinds[group])] if group else [])]

    def search(one: pa.Table, other: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        matrix = _rows(one.column("q"))
        norm = np.linalg.norm(matrix, axis=1) if len(matrix) else np.zeros(0)
        parts = [other]
        if group and other.num_rows:
            labels = other.column(group).to_pylist()
            parts = [other.filter(pa.array([x == g for x in labels])) for g in dict.fromkeys(labels) if g is not None]
            parts += [other.filter(pa.array([x is None for x in labels]))] if None in labels else []
        for part in parts:
            if not part.num_rows or not len(matrix):
                continue
            part = part.take(pc.sort_indices(part.column(key)))
            v = _rows(part.column("v"))
            length = np.linalg.norm(v, axis=1)
            places: dict = {}
            if skip_self:
                for i, x in enumerate(part.column(key).to_pylist()):
                    places.setdefault(x, []).append(i)
            for a in range(0, len(matrix), QUERY_TILE):
                size = np.outer(norm[a : a + QUERY_TILE], length)
                score = np.divide(matrix[a : a + QUERY_TILE] @ v.T, size, out=np.zeros_like(size), where=size > 0)
                same = [(r, i) for r, x in enumerate(one.column(query_key).slice(a, QUERY_TILE).to_pylist()) for i in places.get(x, ())] if skip_self else []
                if same:
                    score[tuple(np.array(same).T)] = -np.inf
                row, at = _best(score, k)
                columns = [one.column(query_key).take(pa.array(a + row)), part.column(key).take(pa.array(at)), pa.chunked_array([pa.array(score[row, at])]), *([part.column(group).take(pa.array(at))] if group else [])]
                found.append(pa.table(columns, names))
        return pa.concat_tables(found) if found else pa.table([pa.array([], t) for t in types], names)

    fields = [(query_key, kind), (key, kinds[key]), ("score", None), *([(group, kinds[group])] if group else [])]
    schema = ", ".join(f"`{n}` {t.simpleString() if t else 'double'}" for n, t in fields)
    found = asked.groupBy("slice", "block").cogroup(held.groupBy("slice", "block")).applyInArrow(search, schema)
    w = Window.partitionBy(query_key, *([group] if group else [])).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def round_robin(ranked: DataFrame, groups: list, most: int, group: str = "department", query_key: str = "query_id", key: str = "vec_id") -> DataFrame:
    """Merge ranked groups in turns, in the order of `groups`, up to `most` rows a query; picked rows are ordered by score."""
    place = F.array_position(F.array(*map(F.lit, groups)), F.col(group))
    turn = Window.partitionBy(query_key).orderBy("rank", place)
    picked = ranked.filter(place > 0).withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= most)
    by_score = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return picked.withColumn("place", F.row_number().over(by_score)).drop("turn")


def retrieval_stats(hits: DataFrame) -> DataFrame:
    """One row: count, score range and mean, distinct departments and courses; zeros without hits."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return hits.agg(
        F.count("*").alias("count"),
        zero(F.max("score")).alias("max_score"),
        zero(F.min("score")).alias("min_score"),
        zero(F.avg("score")).alias("avg_score"),
        F.array_sort(F.collect_set("department")).alias("departments"),
        F.count_distinct("course_code").alias("num_courses"),
    )


def hash_embedding(df: DataFrame, text: str = "text", out: str = "embedding", dims: int = 64) -> DataFrame:
    """A deterministic embedding: signed word hashes added up by bucket and brought to length 1; blank text is the zero vector."""

    @F.pandas_udf("array<float>")
    def folded(hashes: pd.Series) -> pd.Series:
        count = np.array([len(x) for x in hashes], np.int64)
        h = np.concatenate([np.zeros(0, np.int64), *hashes])
        row = np.repeat(np.arange(len(count)), count)
        sums = np.bincount(row * dims + h % dims, np.where(h >> 40 & 1, -1.0, 1.0), len(count) * dims).astype(np.float64).reshape(len(count), dims)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        return pd.Series(list(np.divide(sums, length, out=np.zeros_like(sums), where=length > 0).astype(np.float32)))

    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+", -1), lambda w: w != "")
    return df.withColumn(out, folded(F.transform(words, lambda w: F.xxhash64(w))))


#: Embeddings by name: each takes (df, text column, output column).
PROVIDERS = {"hash": hash_embedding}


def register_provider(name: str, embed) -> None:
    """Add an embedding: embed(df, text, out) gives df with a vector column."""
    PROVIDERS[name.lower().strip()] = embed


def provider(name: str | None = None):
    """The embedding of this name, the offline one without a name."""
    wanted = (name or "hash").lower().strip()
    if wanted not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {wanted!r}: one of {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[wanted]


def embed(df: DataFrame, name: str | None = None, text: str = "text", out: str = "embedding") -> DataFrame:
    return provider(name)(df, text, out)
