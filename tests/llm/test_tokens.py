import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe, hmm, token_store
from lectern.llm.common import scratch

PATH = bpe.vocabulary_path()
SIGNS = "abcAB 'stremdvl0123!?.,<|>ÉéΣσ́ \x1c\x85 ​日½ßİ\n\t_-"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*SIGNS, "<|endoftext|>", "<|startoftext|>", "the ", "ing"]), max_size=40).map("".join))
def test_bpe_equals_the_library(text):
    t = bpe.load(PATH)
    lib = token_store._encoder(PATH).whole
    ids = lib.encode(text, add_special_tokens=False).ids
    assert t.encode(text) == ids
    assert t.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    code = token_store._encoder(PATH)
    assert code.batch([text])[0].tolist() == [*ids, token_store.END_ID]
    assert code.batch([None, text, "the"])[1][1:3].tolist() == [1, len(ids) + 2]


def test_long_words_merge_alike(library):
    t = bpe.load(PATH)
    for word in ("x" * 700, "ab" * 400, "thequickbrownfox" * 40):
        assert t.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_bpe_query_rows(docs, nothing, library):
    got = bpe.digest_documents(docs, PATH).collect()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert bpe.digest_documents(nothing, PATH).count() == 0
    assert bpe.encode_documents(docs, PATH).count() == docs.count()


def test_cache_is_bounded():
    made = []
    c = bpe.SegmentCache(lambda s: made.append(s) or (len(s),), limit=3)
    assert [c[x] for x in ("a", "bb", "a", "ccc", "dddd", "a")] == [(1,), (2,), (1,), (3,), (4,), (1,)]
    assert made == ["a", "bb", "ccc", "dddd"] and len(c) <= 3


def test_token_store_round_trip(spark, docs, library):
    path = scratch(spark, "test-store")
    token_store.write(docs, path, PATH)
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in rows]
    order = sorted(((r.doc_id is not None, r.doc_id or 0, hashlib.sha256((r.text or "").encode()).digest()), ids, r.doc_id) for r, (_, ids) in zip(rows, want, strict=True))
    start, expected = 0, Counter()
    for _, ids, doc_id in order:
        expected[doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in token_store.checksums(spark, path).collect()) == expected
    texts = Counter((r.doc_id, tuple(r.ids)) for r in token_store.documents(spark, path).collect())
    assert texts == Counter((d, tuple(ids)) for d, ids in want)
    assert all(r.intact for r in token_store.verify_manifest(spark, path).collect())
    stored = spark.read.parquet(f"{path}/parts").filter("kind = 1")
    assert stored.count() == stored.select("digest").distinct().count()


def test_token_store_finds_damage(spark, docs):
    path = scratch(spark, "test-damage")
    token_store.write(docs.filter("doc_id = 2"), path, PATH)
    import zstandard
    from pyspark.sql import functions as F

    @F.udf("binary")
    def spoil(data):
        bad = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), "<u2").copy()
        bad[0] ^= 1
        return zstandard.ZstdCompressor().compress(bad.tobytes())

    spark.read.parquet(f"{path}/parts/kind=1").withColumn("data", spoil("data")).write.parquet(f"{path}/new")
    spark.read.parquet(f"{path}/new").write.mode("overwrite").parquet(f"{path}/parts/kind=1")
    with pytest.raises(Exception, match="damaged"):
        token_store.checksums(spark, path).collect()


@pytest.mark.parametrize("change", ["start + 1 AS start", "CASE doc_id WHEN 2 THEN 3 WHEN 3 THEN 2 END AS doc_id", None])
def test_token_store_finds_changed_recipes(spark, docs, change):
    """A changed start, swapped documents, a lost recipe."""
    path = scratch(spark, "test-recipes")
    token_store.write(docs.filter("doc_id IN (2, 3)"), path, PATH)
    assert token_store.checksums(spark, path).count() == 2
    recipes = spark.read.parquet(f"{path}/recipes")
    names = recipes.columns
    bad = recipes.selectExpr(*(change if change and change.endswith(f" {c}") else c for c in names)) if change else recipes.filter("doc_id = 2")
    bad.write.parquet(f"{path}/new")
    spark.read.parquet(f"{path}/new").write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(Exception, match="damaged"):
        token_store.checksums(spark, path).collect()


def test_encoder_equals_the_library_on_every_letter(library):
    """In words, before marks and between spaces; with a small memory of words too."""
    letters = [chr(i) for i in (*range(1, 0x32000, 7), *range(0x1C80, 0x1CA0), *range(0xA7C0, 0xA7E0), *range(0xAB60, 0xAB70)) if not 0xD800 <= i < 0xE000]
    texts = [" ".join(f"{c} a{c}b {c}{c}. the{c}'s x,{c}" for c in letters[at : at + 500]) for at in range(0, len(letters), 500)]
    for limit in (100, 1_000_000):
        encoder = token_store.Encoder(PATH)
        encoder.by_segment.limit = encoder.by_word.limit = limit
        for part in (texts[:10], texts[:3], texts):
            ids, off = encoder.batch(part)
            assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[*library.encode(x, add_special_tokens=False).ids, 1] for x in part]


def test_token_store_empty(spark, nothing):
    path = scratch(spark, "test-empty")
    token_store.write(nothing, path, PATH)
    assert token_store.checksums(spark, path).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49_000, 60_000).astype(np.uint16)
    cut = lambda x: token_store.cut_points(len(x), token_store.chunk_marks(x))
    ends = cut(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes[:-1].min() >= token_store.MIN_CHUNK and sizes.max() <= token_store.MAX_CHUNK
    moved = cut(np.concatenate([ids[:10], ids]))
    assert len({e - 10 for e in moved} & set(ends)) > 0.8 * len(ends)
    assert cut(ids[:1]) == [1]
    # marks of documents that follow one another give each document the cuts that it has alone
    marks = token_store.chunk_marks(np.concatenate([ids[:777], ids]))
    assert token_store.cut_points(len(ids), marks[marks > 777] - 777) == ends


@given(st.binary(max_size=60), st.binary(max_size=60))
@settings(deadline=None)
def test_crc_of_two_parts(a, b):
    assert token_store.join_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_merkle():
    h = lambda x: hashlib.sha256(x).digest()
    leaf = [h(b"\0" + x) for x in (b"a", b"b", b"c")]
    assert token_store.merkle_root([b"a", b"b", b"c"]) == h(b"\1" + h(b"\1" + leaf[0] + leaf[1]) + leaf[2])
    assert token_store.merkle_root([]) == h(b"")
    tree = token_store.Tree()
    for n in range(40):
        assert tree.root() == token_store.merkle_root([b"%d" % i for i in range(n)])
        tree.add(b"%d" % n)


def words_of(text):
    t = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), None]


def test_hmm_base_scores(docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r.doc_id) for w in words_of(r.text))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        t = words_of(r.text)
        want[r.doc_id, held(r.doc_id), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)] += 1
    got = hmm.score_documents(docs, rounds=2, states=2).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert hmm.score_documents(nothing, rounds=1).count() == 0


def test_hmm_forward_and_counts():
    """The scaled recursions against sums over all paths."""
    rng = np.random.default_rng(3)
    m = hmm.Model(np.array([0.2, 0.3, 0.5]), states=2)
    m.start, m.move, m.emit = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2)
    sequences = [np.array(x) for x in ([0, 2, 1, 1], [2], [1, 0, 2])]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    import itertools

    for s in sequences:
        paths = {}
        for p in itertools.product(range(2), repeat=len(s)):
            paths[p] = m.start[p[0]] * math.prod(m.move[a, b] for a, b in itertools.pairwise(p)) * math.prod(m.emit[q, x] for q, x in zip(p, s, strict=True))
        total = sum(paths.values())
        (_, grid, size), = hmm.blocks([s])
        assert abs(hmm.forward(m, grid, size)[0] - math.log(total)) < 1e-12
        for p, w in paths.items():
            start[p[0]] += w / total
            for a, b in itertools.pairwise(p):
                move[a, b] += w / total
            for q, x in zip(p, s, strict=True):
                emit[q, x] += w / total
    got = hmm.expected_counts(m, sequences)
    assert all(np.allclose(a, b) for a, b in zip(got, (start, move, emit), strict=True))


def test_hmm_learns(spark):
    """Two kinds of texts: the hidden states beat the single counts on held-out texts, and each round is no worse."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice([f"{'ab'[i % 2]}{k}" for k in range(30)], 60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = hmm.score_documents(docs, rounds=8, states=2).filter("held_out").groupBy().sum("score", "base_score").first()
    assert got["sum(score)"] > got["sum(base_score)"] + 100
    assert os.path.exists(PATH)


def test_hmm_every_word_has_its_emissions(spark, monkeypatch):
    """Against Baum-Welch over the whole vocabulary in one matrix, with most words outside the table and several blocks."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(k)}" for k in rng.zipf(1.3, 40) % 3000)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(hmm, "LISTED", 64)
    monkeypatch.setattr(hmm, "BLOCK", 1 << 10)
    got = {r.doc_id: r.score for r in hmm.score_documents(docs, rounds=3, states=2).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in words_of(t))
    place = {w: k for k, w in enumerate(c)}
    hashes = np.array([hmm.tokens(pa.array([w or ""]))[0][0] for w in place], np.uint64)
    count = np.array([*c.values(), 0.0])
    e = np.concatenate([hmm.first_counts(hashes, count[:-1], 2), np.zeros((1, 2))])
    texts = {i: np.array([place.get(w, len(place)) for w in words_of(t)]) for i, t in rows}
    prior, m = hmm.PRIOR * (len(c) + 1) / 2, hmm.Model(np.zeros(0), 2)
    for k in range(4):
        m.emit = ((e + prior * (count + 1)[:, None] / (count + 1).sum()) / (e.sum(0) + prior)).T
        assert np.allclose(m.emit.sum(1), 1)
        if k < 3:
            start, move, emit = hmm.expected_counts(m, [texts[i] for i in texts if not held[i]])
            m.learn(start, move)
            e = emit.T
    for i, t in texts.items():
        (_, grid, size), = hmm.blocks([t])
        assert abs(got[i] - hmm.forward(m, grid, size)[0] / math.log(10)) < 1e-4
