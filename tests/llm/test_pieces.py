import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from lectern.llm import bpe, piece_bpe


@pytest.fixture(scope="module")
def path():
    return bpe.vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.fixture(scope="module")
def coder(path):
    return piece_bpe.PieceBpe(path)


def test_query_equals_library(spark, sf_dir, library):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_bpe.query(spark, sf_dir).collect()}
    assert got == want


def test_odd_rows(spark, docs, nothing, path, library):
    got = piece_bpe.encode_documents(docs, path).collect()
    texts = [r.text or "" for r in docs.select("text").collect()]
    want = sorted((library.encode(t) for t in texts), key=str)
    assert sorted((r.ids for r in got), key=str) == want
    assert sorted(r.decoded for r in got) == sorted(library.decode(i) for i in want)
    digests = {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_bpe.digest_documents(docs, path).collect()}
    assert digests == {(len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in got}
    assert piece_bpe.digest_documents(nothing, path).count() == 0
    assert piece_bpe.digest_documents(docs.filter(F.col("doc_id").isNull()), path).count() == 2


def test_random_texts(coder, library):
    rng = random.Random(3)
    vocabulary = list(coder.ids)
    for _ in range(3000):
        kinds = [rng.choice(vocabulary), rng.choice("abcdest  ▁\n\t.,0123"), chr(rng.choice([0, 1, 233, 0x2028, 0x4E2D, 0x1F600, 0xFB01, 0xE000]))]
        text = "".join(rng.choice(kinds) for _ in range(rng.randint(0, 14)))
        assert coder.encode(text) == library.encode(text)
        assert coder.decode(coder.encode(text)) == library.decode(library.encode(text)) == text.replace("▁", " ")


def test_decode_any_ids(coder, library):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.randrange(rng.choice([3, 259, 32000])) for _ in range(rng.randint(0, 6))]
        assert coder.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("text", ["x" * 100_000, "ab" * 50_000, "中" * 20_000, " " * 50_000, "\n" * 20_000, "thequickbrown" * 5_000, "a b" * 30_000])
def test_long_texts(coder, library, text):
    assert coder.encode(text) == library.encode(text)


def test_search_takes_back_pieces(coder):
    """The search by compatible neighbours gives the merges' own result, also where the longest piece first is a dead end."""
    greedy = 0
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(list(coder.ids)) for _ in range(rng.randint(1, 4)))[:24]
        pieces = coder.search(text)
        assert pieces == coder.merged(text)
        longest = next(text[:n] for n in range(len(text), 0, -1) if n == 1 or text[:n] in coder.ids)
        greedy += pieces[0] != longest
    assert greedy > 20


def test_unlike_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        piece_bpe.PieceBpe(str(tmp_path / "m"))
