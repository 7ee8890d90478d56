"""Hidden Markov language model.

Tokens are words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased), known by 64-bit
hashes, then one end. Documents whose crc32(doc_id as text) mod 7 is not 2 are trained on.

1. Token counts over all training documents. Tokens with at least a LISTED-th of all occurrences
   (hence at most LISTED tokens) go to every task as a table.
2. Every training token has emissions of its own in each hidden state; tokens that training has not
   seen share one class. Documents are coded in blocks: listed tokens by their place in the table, the
   others by their place in the block's own list of distinct tokens.
3. Baum-Welch: blocks add up expected counts by (token, state) over all training tokens. Those of a block's
   own tokens go to the token's group, are summed there over all blocks and come back to every block
   that holds the token. The driver gets those of listed tokens only, the rest grows in Spark. Sequences are
   whole, in training and in scoring; blocks hold texts of like length, so that few steps serve many texts.
4. The score is log10 of the exact likelihood from the scaled forward recursion.

Null text is empty (the end alone), a null doc_id counts as the empty text in the crc32. Repeated rows
are separate documents, scored alike. Texts of any length are trained on and scored whole. No order decides anything,
so ties don't either. Other columns are never read, whatever their names. Without training documents every count
is 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import forget, shuffle_partitions, stored, swept, table
from lectern.llm.words import by_bytes, hash_words, mix, release

LISTED = 1 << 18
STATES, ROUNDS, PRIOR = 6, 4, 0.5
#: Tokens counted at a time before the shuffle.
COUNTED = 1 << 22
#: Cells of a padded block of sequences.
CELLS = 1 << 20
#: Bytes of text of a block: the larger, the fewer tokens are in several.
BLOCK = 8 << 20
END = np.uint64(64)
#: About this many tokens of blocks are in a group of the exchange.
GROUP = 1 << 20
#: Shares of a token's expected counts travel in this many steps.
STEPS = (1 << 20) - 1
#: Blocks of rows of the exchange that are sums: of listed tokens, and of starts, moves and states.
TABLE, SUMS = -1, -2


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of each document's tokens, the end included."""
    words, off = hash_words(column)
    return np.insert(words, off[1:], END), off + np.arange(len(off))


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c over the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def counted() -> pa.RecordBatch:
            token, c = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(c)], ["token", "c"])

        for batch in batches:
            for part in by_bytes(batch, "text"):
                waiting.append(tokens(part.column("text"))[0])
                held += len(waiting[-1])
                if held > COUNTED:
                    yield counted()
                    waiting, held = [], 0
        if held:
            yield counted()

    return docs.filter(~held_out()).select("text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What every task needs of the counts: at most LISTED tokens, the most frequent ones first, and two totals."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        self.n, self.v = total["n"] or 0, total["v"]
        listed = counts.filter(F.col("c") * LISTED >= self.n).select("token", "c").toArrow() if self.n else pa.table({"token": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
        token, c = listed["token"].to_numpy().view(np.uint64), listed["c"].to_numpy().astype(np.int64)
        order = np.lexsort((token, -c))
        self.token, self.c = token[order], c[order]
        self.place = np.argsort(self.token)
        self.sorted = self.token[self.place]
        self.group_bits = 1

    def find(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, whether it is there)."""
        if not len(self.token):
            return np.zeros(len(token), np.int64), np.zeros(len(token), bool)
        at = np.minimum(np.searchsorted(self.sorted, token), len(self.sorted) - 1)
        return self.place[at], self.sorted[at] == token

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))

    def by_group(self, token: np.ndarray) -> list[tuple[int, int, int]]:
        """(group, from, to) of sorted tokens; groups are ranges of hashes."""
        group = (token >> np.uint64(64 - self.group_bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        return list(zip(group[first].tolist(), first.tolist(), np.append(first, len(token))[1:].tolist(), strict=True))


def planes(x: np.ndarray) -> bytes:
    """Little-endian numbers, byte by byte of all, compressed: most of them are small."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(x.size, x.itemsize).T).tobytes())


def unplaned(raw: bytes, dtype: str) -> np.ndarray:
    size, data = np.dtype(dtype).itemsize, np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(size, len(data) // size).T).view(dtype).ravel()


CODED = "held_out boolean, doc_ids array<long>, sizes binary, symbols binary, rare binary, times binary, n_rare long"


def code(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Blocks of documents as symbols (places in the table, then places in rare), with the block's other tokens and their times."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for held in (False, True):
                chosen = batch.filter(pa.array(batch.column("held_out").to_numpy(zero_copy_only=False) == held))
                chosen = chosen.take(pc.sort_indices(pc.binary_length(pc.fill_null(chosen.column("text"), "")), [("", "descending")]))
                for part in by_bytes(chosen, "text", BLOCK):
                    token, off = tokens(part.column("text"))
                    symbol, known = v.find(token)
                    rare, at, times = np.unique(token[~known], return_inverse=True, return_counts=True)
                    symbol[~known] = len(v.token) + at
                    cells = (np.diff(off).astype("<i8").tobytes(), planes(symbol.astype("<u4")), rare.tobytes(), times.astype("<u4").tobytes())
                    ids = pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([held]), ids, *(pa.array([x], pa.binary()) for x in cells), pa.array([len(rare)])], ["held_out", "doc_ids", "sizes", "symbols", "rare", "times", "n_rare"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, CODED)


SENT = "grp int, block long, places binary, times binary, e binary"


def sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * 5
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["grp", "block", "places", "times", "e"])


def gaps(places: np.ndarray) -> np.ndarray:
    """Rising places as their differences."""
    return np.diff(places, prepend=0).astype("<u4")


def shares(e: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Expected counts [token, state] as shares of the tokens' counts, in STEPS."""
    return np.rint(STEPS * np.clip(e / np.maximum(total, 1)[:, None], 0, 1)).astype("<u4")


def by_slot(rows: DataFrame) -> DataFrame:
    """Rows of SENT, those of a group together."""
    n = shuffle_partitions(rows.sparkSession)
    return rows.withColumn("slot", (F.col("grp") % n).cast("int")).repartitionById(n, "slot").drop("slot").sortWithinPartitions("grp", "block")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(group, its rows), one group at a time."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "places", "times", "e")), strict=True):
            if row[0] != last and held:
                yield last, held
                held = []
            last = row[0]
            held.append(row)
    if held:
        yield last, held
    release()


def summed(rows: DataFrame, width: int) -> DataFrame:
    """Rows of SENT with the shares of all blocks' expected counts in place of a block's own; TABLE and SUMS rows become one for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, held in grouped(batches):
            for kind in (TABLE, SUMS):
                if own := [x for x in held if x[1] == kind]:
                    yield sent([(grp, kind, own[0][2], None, np.sum([np.frombuffer(x[4], "<f8") for x in own], 0).tobytes())])
            asked = [x for x in held if x[1] >= 0]
            if not asked:
                continue
            places = [np.cumsum(unplaned(x[2], "<u4"), dtype=np.int64) for x in asked]
            at, times = np.concatenate(places), np.concatenate([unplaned(x[3], "<u4") for x in asked])
            e = np.concatenate([unplaned(x[4], "<u4").reshape(-1, width) for x in asked])
            total = np.bincount(at, times)
            share = np.stack([np.bincount(at, e[:, k] * (times / STEPS)) for k in range(width)], 1)
            share = shares(share, total)
            for lo in range(0, len(asked), 256):
                yield sent([(grp, x[1], None, None, planes(share[p].ravel())) for x, p in zip(asked[lo : lo + 256], places[lo : lo + 256], strict=True)])

    return by_slot(rows).mapInArrow(run, SENT)


def answered(blocks_: DataFrame, answers: DataFrame, *names: str) -> DataFrame:
    """The blocks with the answers to their tokens by group (null for a block without own tokens)."""
    parts = answers.filter("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("grp", *names))).alias("p"))
    return blocks_.join(parts.select("block", *(F.col(f"p.{x}").alias(f"part_{x}") for x in names)), "block", "left")


def joined_parts(parts: pa.Scalar) -> np.ndarray:
    return np.concatenate([np.zeros(0, "<u4"), *(unplaned(x, "<u4") for x in parts.as_py() or [])])


def counted_blocks(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The blocks with c (how often training has each of the block's own tokens) and the tokens' places in their groups."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, rare, times in zip(*(batch.column(c) for c in ("block", "held_out", "rare", "times")), strict=True):
                token = np.frombuffer(rare.as_buffer(), np.uint64)
                c = np.frombuffer(times.as_buffer(), "<u4") * np.uint32(not held.as_py())
                yield sent([(g, block.as_py(), token[lo:hi].tobytes(), planes(c[lo:hi]), None) for g, lo, hi in shared.value.by_group(token)])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, held in grouped(batches):
            tokens_ = [np.frombuffer(x[2], np.uint64) for x in held]
            _, at = np.unique(np.concatenate(tokens_), return_inverse=True)
            c = np.bincount(at, np.concatenate([unplaned(x[3], "<u4") for x in held])).astype("<u4")
            end = np.cumsum([0, *map(len, tokens_)])
            for lo in range(0, len(held), 256):
                cut = [at[a:b] for a, b in zip(end[lo : lo + 256], end[lo + 1 : lo + 257], strict=False)]
                yield sent([(grp, x[1], planes(gaps(p)), planes(c[p]), None) for x, p in zip(held[lo : lo + 256], cut, strict=True)])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, places = ([planes(joined_parts(x)) for x in batch.column(f"part_{k}")] for k in ("times", "places"))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(c, pa.binary()), pa.array(places, pa.binary())], [*names, "c", "places"])

    names = ["block", "held_out", "doc_ids", "sizes", "symbols", "rare"]
    answers = by_slot(coded.select("block", "held_out", "rare", "times").mapInArrow(ask, SENT)).mapInArrow(number, SENT)
    found = answered(coded.select(*names), answers, "times", "places")
    return found.mapInArrow(settle, coded.select(*names).schema.add("c", "binary").add("places", "binary"))


def first_counts(token: np.ndarray, c: np.ndarray, states: int) -> np.ndarray:
    """c dealt to the states by the token's hash: what training starts from."""
    step = np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    share = 0.2 + 1.6 * (mix(token[:, None] + step) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return share / share.sum(1, keepdims=True) * c[:, None]


class Model:
    """start, move and emit, of the listed tokens; emissions() gives those of any token from its counts."""

    def __init__(self, unigram: np.ndarray, states: int = STATES):
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        self.emit = np.tile(unigram, (states, 1))

    def learn(self, start: np.ndarray, move: np.ndarray) -> None:
        """Expected counts to probabilities; PRIOR per state keeps every probability positive."""
        self.start = (start + PRIOR) / (start + PRIOR).sum()
        move = move + PRIOR
        self.move = move / move.sum(1, keepdims=True)

    def spread(self, vocabulary: Vocabulary, mass: np.ndarray) -> None:
        """mass: the expected number of tokens of each state; PRIOR of each token and state goes by the single counts."""
        self.prior = PRIOR * (vocabulary.v + 1) / len(mass)
        self.mass, self.all = mass + self.prior, vocabulary.n + vocabulary.v + 1

    def emissions(self, e: np.ndarray, c: np.ndarray) -> np.ndarray:
        """[token, state], from expected counts and counts; a token that training has not seen has zeros of both."""
        return (e + self.prior / self.all * (c + 1)[:, None]) / self.mass

    def of_block(self, e: np.ndarray, c: np.ndarray) -> Model:
        """The model over the table and a block's own tokens."""
        out = Model(np.zeros(0), len(self.start))
        out.start, out.move = self.start, self.move
        out.emit = np.concatenate([self.emit, self.emissions(e, c).T], 1)
        return out


def blocks(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, symbols[time, row], lengths): sequences of falling length, padded, CELLS cells a block."""
    size = np.array([len(x) for x in sequences])
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        longest = int(size[order[at]])
        end = min(len(order), at + max(1, CELLS // max(1, longest)))
        take = order[at:end]
        grid = np.zeros((longest, len(take)), np.int64)
        for j, i in enumerate(take):
            grid[: size[i], j] = sequences[i]
        yield take, grid, size[take]
        at = end


def forward(model: Model, grid: np.ndarray, size: np.ndarray, keep: bool = False, kind: type = np.float64):
    """Natural log-likelihoods by the scaled forward recursion; with keep also the scaled vectors and the scales."""
    emit, move = np.ascontiguousarray(model.emit.T).astype(kind, copy=False), model.move.astype(kind)
    total = np.zeros(len(size))
    alphas, scales = [], []
    alpha = np.broadcast_to(model.start.astype(kind), (len(size), len(model.start)))
    active = np.searchsorted(-size, -np.arange(len(grid)), side="left").tolist()
    for t, n in enumerate(active):
        alpha = (alpha[:n] @ move if t else alpha[:n]) * emit[grid[t, :n]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        if keep:
            alphas.append(alpha)
            scales.append(scale)
        else:
            total[:n] += np.log(scale)
    return (alphas, scales) if keep else total


def expected_counts(model: Model, sequences: list[np.ndarray], kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    states, symbols = model.emit.shape
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
    by_symbol, onward = np.ascontiguousarray(model.emit.T).astype(kind, copy=False), model.move.T.astype(kind)
    for _, grid, size in blocks(sequences):
        gammas, scales = forward(model, grid, size, True, kind)
        flat = np.concatenate([grid[t, : len(a)] for t, a in enumerate(gammas)])
        beta, pairs = np.ones((0, states), kind), np.zeros((states, states))
        for t in range(len(grid) - 1, -1, -1):
            n = len(gammas[t])
            if t + 1 < len(grid):
                m = len(scales[t + 1])
                seen = by_symbol[grid[t + 1, :m]] * beta
                seen /= scales[t + 1][:, None]
                pairs += gammas[t][:m].T @ seen
                beta = seen @ onward
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), states), kind)])
            gammas[t] = gammas[t] * beta
        move += pairs * model.move
        start += gammas[0].sum(0)
        gamma = np.concatenate(gammas)
        del gammas
        for s in range(states):
            emit[:, s] += np.bincount(flat, gamma[:, s], symbols)
    return start, move, emit.T


def block_counts(batch: pa.RecordBatch, i: int, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's own tokens, their counts and their expected counts as they came back (or the first ones)."""
    token = np.frombuffer(batch.column("rare")[i].as_buffer(), np.uint64)
    c = unplaned(batch.column("c")[i].as_py(), "<u4").astype(np.float64)
    if "part_e" not in batch.schema.names:
        return token, c, first_counts(token, c, states)
    e = joined_parts(batch.column("part_e")[i]).reshape(-1, states - 1) * (c / STEPS)[:, None]
    return token, c, np.column_stack([e, np.maximum(c - e.sum(1), 0)])  # those of all states make c


def train(coded: DataFrame, counts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, states: int = STATES) -> tuple[Model, DataFrame | None]:
    """Baum-Welch over all training documents: the model, and the expected counts of each block's own tokens."""
    spark = coded.sparkSession
    words = spark.sparkContext.broadcast(vocabulary)
    listed = len(vocabulary.token)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(states)
        for batch in batches:
            total += first_counts(batch.column("token").to_numpy().view(np.uint64), batch.column("c").to_numpy(), states).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(states), pa.int32()), pa.array(total)], ["state", "e"])

    mass = np.zeros(states)
    for r in counts.select("token", "c").mapInArrow(dealt, "state int, e double").groupBy("state").agg(F.sum("e").alias("e")).collect():
        mass[r["state"]] = r["e"]
    model = Model(np.zeros(0), states)
    model.spread(vocabulary, mass)
    model.emit = model.emissions(first_counts(vocabulary.token, vocabulary.c, states), vocabulary.c).T
    # listed tokens go to the groups by their places
    ends = np.linspace(0, listed, min(listed, 1 << vocabulary.group_bits) + 1).astype(np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rare, places in zip(batch.column("block"), batch.column("rare"), batch.column("places"), strict=True):
                token, place = np.frombuffer(rare.as_buffer(), np.uint64), unplaned(places.as_py(), "<u4")
                none = np.zeros((states - 1) * len(token), "<u4")
                yield sent([(g, block.as_py(), planes(place[lo:hi]), planes(none[lo:hi]), planes(none[: (states - 1) * (hi - lo)])) for g, lo, hi in words.value.by_group(token)])

    answers = None
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums, table_ = np.zeros(states + states * states + states), np.zeros((listed, states))
            for batch in batches:
                for i in range(batch.num_rows):
                    token, c, e = block_counts(batch, i, states)
                    symbols = unplaned(batch.column("symbols")[i].as_py(), "<u4")
                    off = np.cumsum(np.frombuffer(batch.column("sizes")[i].as_buffer(), "<i8")).tolist()
                    start, move, emit = expected_counts(shared.value.of_block(e, c), [symbols[a:b] for a, b in zip([0, *off[:-1]], off, strict=True)], np.float32)
                    sums += np.concatenate([start, move.ravel(), emit.sum(1)])
                    table_ += emit[:, :listed].T
                    times, place = np.bincount(symbols, minlength=emit.shape[1])[listed:].astype("<u4"), unplaned(batch.column("places")[i].as_py(), "<u4")
                    own = shares(emit[: states - 1, listed:].T, times)
                    block = batch.column("block")[i].as_py()
                    yield sent([(g, block, planes(place[lo:hi]), planes(times[lo:hi]), planes(own[lo:hi].ravel())) for g, lo, hi in words.value.by_group(token)])
            yield sent([(g, TABLE, np.array([lo, hi]).tobytes(), None, table_[lo:hi].tobytes()) for g, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True))] + [(0, SUMS, b"", None, sums.tobytes())])
            release()

        source = coded.filter(~F.col("held_out")).select("block", "sizes", "symbols", "rare", "c", "places")
        rows = (source if answers is None else answered(source, answers, "e")).mapInArrow(run, SENT)
        if k == rounds - 1:  # the others don't need them before
            rows = rows.unionByName(coded.filter("held_out").select("block", "rare", "places").mapInArrow(ask, SENT))
        last, answers = answers, stored(summed(rows, states - 1), "expected")
        if last is not None:
            forget(last)
        sums, e = np.zeros(states + states * states + states), np.zeros((listed, states))
        for r in answers.filter("block < 0").toLocalIterator():
            if r["block"] == SUMS:
                sums += np.frombuffer(r["e"], "<f8")
            else:
                lo, hi = np.frombuffer(r["places"], np.int64)
                e[lo:hi] += np.frombuffer(r["e"], "<f8").reshape(-1, states)
        del rows, source
        swept(spark)
        model = Model(np.zeros(0), states)
        model.learn(sums[:states], sums[states:-states].reshape(states, states))
        model.spread(vocabulary, sums[-states:])
        model.emit = model.emissions(e, vocabulary.c).T
    return model, answers


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def likelihoods(coded: DataFrame, vocabulary: Vocabulary, model: Model, answers: DataFrame | None) -> DataFrame:
    """SCORED: one row per document; score is log10 of the likelihood of its tokens."""
    shared = coded.sparkSession.sparkContext.broadcast((vocabulary, model))
    states = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                _, c, e = block_counts(batch, i, states)
                symbols = unplaned(batch.column("symbols")[i].as_py(), "<u4")
                size = np.frombuffer(batch.column("sizes")[i].as_buffer(), "<i8")
                off = np.cumsum([0, *size])
                c = np.concatenate([v.c, c])
                base = np.add.reduceat(v.base(c)[symbols], off[:-1])
                known = np.add.reduceat((c > 0)[symbols].astype(np.int64), off[:-1])
                here, score = m.of_block(e, c[len(v.c) :]), np.zeros(len(size))
                for places, grid, n in blocks([symbols[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]):
                    score[places] = forward(here, grid, n)
                ids = pa.array(batch.column("doc_ids")[i].as_py(), pa.int64())
                held = pa.array([batch.column("held_out")[i].as_py()] * len(size))
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(size), pa.array(known), pa.array(base), pa.array(score / np.log(10))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
            release()

    source = coded.select("block", "held_out", "doc_ids", "sizes", "symbols", "rare", "c")
    return (source if answers is None else answered(source, answers, "e")).mapInArrow(run, SCORED)


def score_documents(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs."""
    counts = stored(count_tokens(docs), "token-counts")
    vocabulary = Vocabulary(counts)
    raw = stored(code(docs, vocabulary).withColumn("block", F.monotonically_increasing_id()), "blocks")
    entries = raw.agg(F.sum("n_rare")).first()[0] or 0
    n = shuffle_partitions(docs.sparkSession)
    vocabulary.group_bits = max(1, (n - 1).bit_length(), (entries // GROUP).bit_length())
    coded = stored(counted_blocks(raw, vocabulary), "coded")
    forget(raw)
    swept(docs.sparkSession)
    model, answers = train(coded, counts, vocabulary, rounds, states)
    forget(counts)
    scores = likelihoods(coded, vocabulary, model, answers)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
