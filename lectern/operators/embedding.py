"""Embedding models behind one interface, and a cache of their vectors.

A model turns batches of texts into vectors, in a form for documents and one for queries. Tasks call it on whole batches inside an Arrow
iterator, so that it is loaded once per worker; a batch that fails is tried text by text, and a text that fails on its own gets no
vector and its error. Vectors are kept as Parquet under the model's name and form, addressed by the hash of the text, so a text is
embedded once however often and wherever it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.sources.readers import path_exists

FORMS = ("document", "query")
VECTORS = "text_hash string, embedding array<float>, error string"


class Model:
    """What an embedding model has to have. `embed` takes texts that are not blank; blank ones are zero vectors without asking it."""

    name = "model"
    dimensions = 0
    batch_size = 32

    def embed(self, texts: list[str], form: str) -> np.ndarray:
        raise NotImplementedError

    def available(self) -> bool:
        """Whether the model can be used here."""
        return True

    def info(self) -> dict:
        return {"name": self.name, "dimensions": self.dimensions, "batch_size": self.batch_size, "available": self.available()}


class HashModel(Model):
    """Signed hashes of words, added up by bucket and brought to length 1: an embedding that needs no model file."""

    name, batch_size = "hash-words", 512

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str], form: str) -> np.ndarray:
        import hashlib
        import re

        out = np.zeros((len(texts), self.dimensions), np.float64)
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimensions] += -1.0 if h >> 63 else 1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


_factories: dict[str, Callable[[], Model]] = {"hash-words": HashModel}
_loaded: dict[str, Model] = {}


def register_model(name: str, factory: Callable[[], Model]) -> None:
    _factories[name.lower().strip()] = factory
    _loaded.pop(name.lower().strip(), None)


def model(name: str = "hash-words") -> Model:
    """The model of this name, made once per process."""
    wanted = name.lower().strip()
    if wanted not in _factories:
        raise ValueError(f"unknown embedding model {name!r}: one of {', '.join(sorted(_factories))}")
    if wanted not in _loaded:
        _loaded[wanted] = _factories[wanted]()
    return _loaded[wanted]


def _one_by_one(used: Model, texts: list[str], form: str) -> tuple[list, list]:
    vectors, errors = [], []
    for text in texts:
        try:
            vectors.append(np.asarray(used.embed([text], form), np.float32)[0].tolist())
            errors.append(None)
        except Exception as e:  # an error is a row
            vectors.append(None)
            errors.append(str(e)[:500])
    return vectors, errors


def embedded(texts: DataFrame, factory: Callable[[], Model], form: str = "document") -> DataFrame:
    """VECTORS of (text_hash, text), by whole batches."""
    if form not in FORMS:
        raise ValueError(f"form is one of {', '.join(FORMS)}, not {form!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, used.batch_size):
                part = batch.slice(at, used.batch_size)
                held = [t or "" for t in part.column("text").to_pylist()]
                asked = [t for t in held if t.strip()]
                try:
                    found = np.asarray(used.embed(asked, form), np.float32).tolist() if asked else []
                    errors: list = [None] * len(asked)
                    if len(found) != len(asked):
                        raise ValueError(f"{len(found)} vectors for {len(asked)} texts")
                except Exception:
                    found, errors = _one_by_one(used, asked, form)
                answers = iter(zip(found, errors, strict=True))
                rows = [next(answers) if t.strip() else ([0.0] * used.dimensions, None) for t in held]
                vectors, errors = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("text_hash"), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["text_hash", "embedding", "error"])

    return texts.select("text_hash", "text").mapInArrow(run, VECTORS)


class EmbeddingCache:
    """Vectors kept under a folder, by model and form. Any number of readers; one writer for each model and form at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, used: Model, form: str) -> str:
        return f"{self.root}/{used.name}-{used.dimensions}/{form}"

    def held(self, used: Model, form: str = "document") -> DataFrame:
        path = self.path(used, form)
        return self.spark.read.schema(VECTORS).parquet(path) if path_exists(self.spark, path) else self.spark.createDataFrame([], VECTORS)

    def fill(self, texts: DataFrame, used: Model, factory: Callable[[], Model] | None = None, form: str = "document", text: str = "text") -> int:
        """Embed the texts that have no vector yet, and tell how many there were. Failed ones are not kept and count as unknown next time."""
        if form not in FORMS:
            raise ValueError(f"form is one of {', '.join(FORMS)}, not {form!r}")
        if not used.available():
            raise RuntimeError(f"embedding model {used.name!r} is not available here")
        hashed = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.sha2("text", 256).alias("text_hash"), "text")
        unknown = hashed.join(self.held(used, form).select("text_hash"), "text_hash", "left_anti").dropDuplicates(["text_hash"])
        found = embedded(unknown, factory or (lambda: used), form).filter("error IS NULL")
        before = self.held(used, form).count()
        found.write.mode("append").parquet(self.path(used, form))
        return self.held(used, form).count() - before

    def embed(self, df: DataFrame, used: Model, factory: Callable[[], Model] | None = None, form: str = "document", text: str = "text", out: str = "embedding") -> DataFrame:
        """df with a vector column, null where the model failed; only texts that are not in the cache are embedded."""
        self.fill(df, used, factory, form, text)
        known = self.held(used, form).dropDuplicates(["text_hash"]).select(F.col("text_hash").alias("_hash"), F.col("embedding").alias(out))
        return df.withColumn("_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(known, "_hash", "left").drop("_hash")
