"""Quality classifier by co-training of two views.

The content view sees the text: shares of kinds of characters, word shapes, repetition, and hashed words. The
metadata view sees lang, source and n_chars. Each view is a logistic regression. They start from labelled documents. In
each round each view labels all documents that have no label and that it is sure of (calibrated odds of SURE or more), and the other
view learns from these and from the labelled ones: every step of Newton's method adds up gradients and second
derivatives over all documents in Spark, so no pseudo-label is left out and none reaches the driver.

A view teaches a label only if it knows better: models fitted on two thirds of the labelled documents score the last third, each in
turn, which calibrates the views; of the documents that the teacher is sure of there, it must be right about as many as its student. Pseudo-labels keep
the labelled classes' proportion and weigh as much as the labelled documents, at most. A round after which a view does worse on held-out labelled
documents, by more than one standard error, is undone for that view.

The views are then calibrated and combined by logistic regressions on labelled documents that neither view has trained on, one half of these
for either, and the combination scores every document.

The fit uses at most MAX_LABELLED labelled documents, those with the smallest hashes of their ids; everything
else covers all documents. A document with a score of KEEP or more is kept.

Null text is empty; null metadata are values of their own. Texts of any length are read whole. Labels with null quality don't
count, contradicting ones count by their mean. Of rows that repeat a labelled doc_id with other text (a tie) the one with the least features
is learned from. Without labels of both kinds every score is the share of good labels (1 without any) and
nothing is rejected. Repeated rows are scored alike. Other columns pass through drop_rejected() unread, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import forget, packed, shuffle_partitions, stored, table, unpacked
from lectern.llm.words import by_bytes, hash_words, mix, string_bytes

MAX_LABELLED = 4000
ROUNDS, STEPS, SURE = 3, 3, 9
KEEP = 0.3
#: Numbers of a sum that travel in one row.
PART = 4096
HASHED, HASHED_META = 128, 32

_KINDS = np.zeros(256, np.int8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", b"(){}[]=/\\_+-~^@\"'`", bytes(range(128, 256))), 1):
    _KINDS[list(_chars)] = _i
N_KINDS = 9
CONTENT = N_KINDS + 8 + HASHED
META = 14 + 2 * HASHED_META


def _per_document(off: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of value over each document's range."""
    total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    return total[off[1:]] - total[off[:-1]]


def content_features(column: pa.Array) -> np.ndarray:
    data, off = string_bytes(column)
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    doc = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(doc * N_KINDS + _KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS) / size[:, None]
    words, woff = hash_words(column, fold=False, tail_bits=8)
    folded, _ = hash_words(column, tail_bits=8)
    count = np.diff(woff)
    some = np.maximum(count, 1)
    wdoc = np.repeat(np.arange(n), count)
    tail = _KINDS[(words & np.uint64(255)).astype(np.intp)]
    symbol_tail = _per_document(woff, tail == 3, n) / some
    shout_tail = _per_document(woff, tail == 4, n) / some
    changed = _per_document(woff, words != folded, n) / some
    again = np.zeros(len(words))
    if len(words) > 1:
        again[1:] = (folded[1:] == folded[:-1]) & (wdoc[1:] == wdoc[:-1])
    order = np.lexsort((folded, wdoc))
    first = np.ones(len(words))
    if len(words) > 1:
        first[1:] = (folded[order][1:] != folded[order][:-1]) | (wdoc[order][1:] != wdoc[order][:-1])
    distinct = np.bincount(wdoc[order], first, n) if len(words) else np.zeros(n)
    letters = 1 - kinds[:, 6]
    shape = np.stack([np.log1p(count), size / some / 10, symbol_tail, shout_tail, changed, _per_document(woff, again, n) / some, distinct / np.sqrt(some) / 10, letters], 1)
    bucket = (mix(folded) >> np.uint64(57)).astype(np.int64)
    hashed = np.bincount(wdoc * HASHED + bucket, minlength=n * HASHED).reshape(n, HASHED) / some[:, None]
    return np.concatenate([kinds, shape, hashed], 1)


def metadata_features(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    n = len(lang)
    out = np.zeros((n, META))
    chars = np.array([-1 if x is None else x for x in n_chars.to_pylist()], np.float64)
    level = np.clip(np.log2(np.maximum(chars, 1)), 0, 20)
    out[:, 0] = level / 10
    out[np.arange(n), 1 + np.minimum(level / 2, 11).astype(int)] = 1
    out[:, 13] = chars < 0
    for start, column in ((14, lang), (14 + HASHED_META, source)):
        place = {}
        for i, x in enumerate(column.to_pylist()):
            if x not in place:
                code = hash_words(pa.array([f"{x is None}:{x}".replace(" ", "_")]))[0]
                place[x] = int(code[0] % np.uint64(HASHED_META))
            out[i, start + place[x]] = 1
    return out


class Logistic:
    """Ridge logistic regression by Newton's method, on standardised features."""

    def __init__(self, ridge: float = 1.0):
        self.ridge = ridge

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -20, 20), np.ones(len(x))])

    def sums(self, x: np.ndarray, y: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and negated second derivatives of the log-likelihood."""
        z = self.design(x)
        p = sigmoid(z @ self.w)
        return z.T @ (y - p), (z * (p * (1 - p))[:, None]).T @ z

    def step(self, gradient: np.ndarray, second: np.ndarray) -> float:
        """Take a step of Newton's method, and tell its largest part."""
        penalty = np.full(len(self.w), self.ridge)
        penalty[-1] = 1e-6
        by = np.linalg.solve(second + np.diag(penalty), gradient - penalty * self.w)
        self.w = self.w + by
        return float(np.abs(by).max())

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        self.w = np.zeros(x.shape[1] + 1)
        for _ in range(25):
            if self.step(*self.sums(x, y)) < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def confident_sums(x: tuple[np.ndarray, np.ndarray], students: list[Logistic], teachers: list[Logistic]) -> np.ndarray:
    """For each view and label: the number of rows that the other view's teacher gives the label, their gradient and second derivatives."""
    out = []
    for k in range(2):
        taught = teachers[1 - k].logit(x[1 - k])
        for label in (0, 1):
            gives = getattr(teachers[1 - k], "gives", (True, True))[label]
            sure = x[k][(taught * (2 * label - 1) >= np.log(SURE)) & gives]
            gradient, second = students[k].sums(sure, float(label))
            out += [[float(len(sure))], gradient, second.ravel()]
    return np.concatenate(out)


class Teacher:
    """A view whose logits are calibrated, and the labels that it may give."""

    def __init__(self, view: Logistic, scale: Logistic, gives: tuple[bool, bool]):
        self.view, self.scale, self.gives = view, scale, gives

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scale.logit(self.view.logit(x)[:, None])


def crossed(views: list[np.ndarray], y: np.ndarray, folds: int = 3) -> np.ndarray:
    """Each view's logits of rows that the fitted model has not seen."""
    out = np.zeros((len(y), len(views)))
    for f in range(folds):
        unseen = np.arange(len(y)) % folds == f
        if len(set(y[~unseen])) == 2:
            out[unseen] = np.column_stack([Logistic().fit(x[~unseen], y[~unseen]).logit(x[unseen]) for x in views])
    return out


def knowing(logits: np.ndarray, y: np.ndarray) -> tuple[list[Logistic], list[tuple[bool, bool]]]:
    """(each view's calibration, the labels that it may teach the other view) from logits of unseen rows."""
    scales = [Logistic(1e-2).fit(logits[:, [k]], y) for k in range(2)]
    fair = np.column_stack([s.logit(logits[:, [k]]) for k, s in enumerate(scales)])
    right = (fair > 0) == (y[:, None] > 0.5)
    gives = []
    for k in range(2):
        sure = [fair[:, k] * (2 * label - 1) >= np.log(SURE) for label in (0, 1)]
        gives.append(tuple(bool(s.any() and right[s, k].sum() >= right[s, 1 - k].sum()) for s in sure))
    return scales, gives


def worse(new: np.ndarray, old: np.ndarray, y: np.ndarray) -> bool:
    """Whether logits explain labels less well than others, by more than one standard error of the mean difference."""
    fit = lambda z: np.log(sigmoid(np.clip(z, -6, 6) * (2 * y - 1)))
    less = fit(old) - fit(new)
    return less.mean() > less.std() / np.sqrt(len(y))


class CoTrained:
    """Two views, each calibrated, and their combination. pseudo: confident_sums over all documents without label."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pseudo: Callable[[list[Logistic], list[Teacher]], np.ndarray], rounds: int = ROUNDS):
        self.constant = None
        hold = np.arange(len(y)) % 4 == 3
        if len(set(y)) < 2 or len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
            self.constant = float(y.mean()) if len(y) else 1.0
            return
        train, y_train = [v[~hold] for v in views], y[~hold]
        self.views = [Logistic().fit(x, y_train) for x in train]
        scales, self.gives = knowing(crossed(train, y_train), y_train)
        learns = [all(self.gives[1 - k]) for k in range(2)]  # both classes, or their proportion is lost
        for _ in range(rounds if any(learns) else 0):
            before = self.views
            teachers = [Teacher(v, s, g) for v, s, g in zip(before, scales, self.gives, strict=True)]
            self.views = [copy.copy(v) for v in before]
            for _ in range(STEPS):
                sums, at, moved = pseudo(self.views, teachers), 0, 0.0
                for k, (view, x) in enumerate(zip(self.views, train, strict=True)):
                    gradient, second = view.sums(x, y_train)
                    d = len(view.w)
                    length = 1 + d + d * d
                    count = [float((y_train == label).sum()) for label in (0, 1)]
                    # the classes keep their proportion: the scarcer kind of pseudo-labels sets the weight of both
                    share = min(1.0, *(sums[at + label * length] / count[label] for label in (0, 1))) if learns[k] else 0.0
                    for label in (0, 1):
                        weight = share * count[label] / max(sums[at], 1.0)
                        gradient = gradient + weight * sums[at + 1 : at + 1 + d]
                        second = second + weight * sums[at + 1 + d : at + length].reshape(d, d)
                        at += length
                    if learns[k]:
                        moved = max(moved, view.step(gradient, second))
                if moved < 1e-2:
                    break
            for k in range(2):
                if learns[k] and worse(self.views[k].logit(views[k][hold]), before[k].logit(views[k][hold]), y[hold]):
                    self.views[k], learns[k] = before[k], False
            if not any(learns):
                break
        own, y_hold = np.column_stack([v.logit(x[hold]) for v, x in zip(self.views, views, strict=True)]), y[hold]
        first = np.arange(len(own)) % 2 == 0
        if len(set(y_hold[first])) < 2 or len(set(y_hold[~first])) < 2:  # too few for two halves
            first, second_half = np.ones(len(own), bool), np.ones(len(own), bool)
        else:
            second_half = ~first
        self.calibrated = [Logistic(1e-2).fit(own[first][:, [k]], y_hold[first]) for k in range(2)]
        both = np.column_stack([c.logit(own[second_half][:, [k]]) for k, c in enumerate(self.calibrated)])
        self.joint = Logistic(1e-2).fit(both, y_hold[second_half])

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.constant is not None:
            flat = np.full(len(content), self.constant)
            return flat, flat, flat
        own = [c.logit(v.logit(x)[:, None]) for c, v, x in zip(self.calibrated, self.views, (content, meta), strict=True)]
        return sigmoid(own[0]), sigmoid(own[1]), sigmoid(self.joint.logit(np.column_stack(own)))


def _bytes(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes of 32-bit floats."""
    data = np.ascontiguousarray(x, "<f4")
    ends = np.arange(len(x) + 1, dtype=np.int32) * (4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return string_bytes(column)[0].view("<f4").reshape(-1, width).astype(np.float64)


def viewed(docs: DataFrame) -> DataFrame:
    """doc_id, content binary, meta binary: the features of every row, as bytes of 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 19):
                views = content_features(part.column("text")), metadata_features(part.column("lang"), part.column("source"), part.column("n_chars"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(_bytes, views)], ["doc_id", "content", "meta"])

    return _input(docs).mapInArrow(run, "doc_id long, content binary, meta binary")


def _input(docs: DataFrame) -> DataFrame:
    """The columns that the views need, with fixed types."""
    types = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*(F.col(c).cast(t).alias(c) for c, t in types.items()))


def summed_over(features: DataFrame, known: np.ndarray, students: list[Logistic], teachers: list[Logistic]) -> np.ndarray:
    """confident_sums over all rows of features whose doc_id is not known. Tasks add up their rows, then parts of the sums meet."""
    spark = features.sparkSession
    size = sum(2 * (1 + len(v.w) + len(v.w) ** 2) for v in students)
    n = min(shuffle_partitions(spark), -(-size // PART))
    shared = spark.sparkContext.broadcast((known, students, teachers))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, students, teachers = shared.value
        total: np.ndarray | float = 0.0
        for batch in batches:
            ids = batch.column("doc_id")
            free = ~np.isin(ids.fill_null(0).to_numpy(), known) | ids.is_null().to_numpy(zero_copy_only=False)
            x = _matrix(batch.column("content"), CONTENT)[free], _matrix(batch.column("meta"), META)[free]
            total = total + confident_sums(x, students, teachers)
        if isinstance(total, np.ndarray):
            parts = [total[at : at + PART].tobytes() for at in range(0, len(total), PART)]
            part = np.arange(len(parts), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part % n), pa.array(part), pa.array(parts, pa.binary())], ["slot", "part", "sums"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                held[part] = held.get(part, 0.0) + np.frombuffer(raw, "<f8")
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "sums"])

    met = features.mapInArrow(add, "slot int, part int, sums binary").repartitionById(n, "slot").drop("slot").mapInArrow(meet, "part int, sums binary")
    found = {r["part"]: np.frombuffer(r["sums"], "<f8") for r in met.toLocalIterator()}  # as many numbers as the views have, squared
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(size)


def fit(features: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTrained:
    """The model from viewed() features and labels."""
    y = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    ids = features.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    chosen = F.broadcast(ids.join(y, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))  # a bounded sample of labels
    least = features.join(chosen, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct("content", "meta")).alias("x"))
    rows = least.select("doc_id", "y", "x.content", "x.meta").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    views = tuple(_matrix(rows[c], width) for c, width in (("content", CONTENT), ("meta", META)))
    known = np.sort(rows["doc_id"].to_numpy())
    return CoTrained(views, rows["y"].to_numpy(), lambda students, teachers: summed_over(features, known, students, teachers), rounds)


def scored(docs: DataFrame, model: CoTrained) -> DataFrame:
    """docs with k_quality appended."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = docs.select("*", F.lit(0.0).alias("k_quality")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 19):
                text, lang, source, n_chars = (part.column(names.index(c)) for c in ("text", "lang", "source", "n_chars"))
                # 32 bits, as the features of the fit have
                views = (x.astype("<f4").astype(np.float64) for x in (content_features(text), metadata_features(lang, source, n_chars)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(*views)[2])], [*names, "k_quality"])

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, p_content, p_meta, p_quality, kept: one row per row of docs."""
    features = stored(viewed(docs), "features")
    model = fit(features, labels, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(_matrix(batch.column("content"), CONTENT), _matrix(batch.column("meta"), META))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found)], ["doc_id", "p_content", "p_meta", "p_quality"])

    rows = features.mapInArrow(run, "doc_id long, p_content double, p_meta double, p_quality double")
    return rows.withColumn("kept", F.lit(True) if model.constant is not None else F.col("p_quality") >= KEEP)


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns of docs."""
    features = stored(viewed(docs), "features")
    model = fit(features, labels)
    forget(features)
    if model.constant is not None:
        return docs
    needed = ("text", "lang", "source", "n_chars")
    return unpacked(scored(packed(docs, *needed), model).filter(F.col("k_quality") >= KEEP), docs.columns, *needed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
