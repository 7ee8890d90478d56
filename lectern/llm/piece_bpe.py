"""SentencePiece encoding and decoding of whole texts with models of the merge type.

A merge-type encoding joins the adjacent pair whose joined piece scores best, leftmost first, until no pair is a piece. It is the one
sequence of pieces of which every adjacent pair is the encoding of its own text, so it can be searched for:

1. Aho-Corasick over the reversed pieces gives the longest piece that begins at each position.
2. From the left, the longest piece is tried that goes with the piece before it. Two pieces go together if merging their joined text
   anew ends in just these two; answers are kept in a cache of bounded size.
3. If none goes, shorter prefixes are tried, then the piece before is taken back and the position is marked in a bitfield of failed
   positions, where no later attempt ends. What stands before a position decides the piece before it, so no position is left twice.

Texts are cut where no piece can reach over: before a space mark, around characters that no longer piece holds, and on a cache miss also
between two characters that stand side by side in no piece. Characters without a piece are spelled in bytes.

Null and empty texts have no ids and decode to the empty text. Texts of any length, with or without spaces, are encoded whole in time
linear in their length. Pieces of equal score go to the leftmost pair. Repeated rows give repeated results, a null doc_id is kept, an
empty table gives no rows, and columns other than doc_id and text are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.bpe import SegmentCache, vocabulary_path
from lectern.llm.common import table

SPACE = "▁"
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Pairs of pieces whose answers are kept, twice.
PAIRS = 400_000


class PieceBpe:
    """Encoder and decoder of a SentencePiece model file of the BPE type with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} is not a merge-type model with byte fallback and plain pieces")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} normalises texts, which is not supported")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = i
                self.raw.append(bytes([int(p.piece[3:-1], 16)]))
            else:
                self.raw.append({CONTROL: "", UNKNOWN: model.trainer_spec.unk_surface}.get(p.type, p.piece.replace(SPACE, " ")).encode())
        self.control = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.normal = set(self.ids.values())
        self.decimal = [str(i) for i in range(len(self.raw))]
        long = [p for p in self.ids if len(p) > 1]
        self.adjacent = {p[i : i + 2] for p in long for i in range(len(p) - 1)}
        joined = {c for p in long for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        after_space = not any(SPACE in p.lstrip(SPACE) for p in long)
        stop = f"[{alone}]" if alone else "(?!)"
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{stop}|{SPACE}+" if after_space else f"(?s:.+)")
        self.longest = ahocorasick.Automaton()
        for p in self.ids:
            self.longest.add_word(p[::-1], p)
        self.longest.make_automaton()
        self.prefixes: dict[str, str | None] = {}
        self.fits = SegmentCache(self._fits, PAIRS)
        self.cache = SegmentCache(self._segment)
        self.parts = SegmentCache(self._part)

    def merged(self, text: str) -> list[str]:
        """The encoding by its definition, for the short texts of two pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, pair: tuple[str, str]) -> bool:
        left, right = pair
        return left + right not in self.score and self.merged(left + right) == [left, right] if right else self.merged(left) == [left]

    def shorter(self, piece: str) -> str | None:
        """The longest piece or single character that is a proper prefix."""
        if piece not in self.prefixes:
            found = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.ids), None)
            self.prefixes[piece] = found
        return self.prefixes[piece] if len(piece) > 1 else None

    def search(self, text: str) -> list[str]:
        """The pieces of text by backtracking."""
        n = len(text)
        if n == 1:
            return [text]
        start: list[str] = list(text)
        seen = -1
        for end, piece in self.longest.iter(text[::-1]):  # of the matches at a position the longest comes first
            if end != seen:
                seen = end
                start[n - 1 - end] = piece
        failed = bytearray((n >> 3) + 1)
        pieces: list[str] = []
        at, piece = 0, start[0]
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and self.fits[(pieces[-1], piece) if pieces else (piece, "")]:
                pieces.append(piece)
                if end == n:
                    return pieces
                at, piece = end, start[end]
                continue
            less = self.shorter(piece)
            if less is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = less = pieces.pop()
                at -= len(piece)
            piece = less

    def _part(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.search(text):
            known = self.ids.get(piece)
            if known is None:
                out += map(self.byte_ids.__getitem__, piece.encode())
            else:
                out.append(known)
        return tuple(out)

    def _segment(self, text: str) -> tuple[int, ...]:
        cuts = [0, *(i + 1 for i in range(len(text) - 1) if text[i : i + 2] not in self.adjacent), len(text)]
        return tuple(i for a, b in zip(cuts, cuts[1:], strict=False) for i in self.parts[text[a:b]])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for ids in map(self.cache.__getitem__, self.segments.findall(self.prefix + text.replace(" ", SPACE))) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: without the mark put before a text; control pieces are empty, bytes that make no character U+FFFD each."""
        if not self.control.isdisjoint(ids):
            cuts = [i for i, x in enumerate(ids) if x in self.control]
            parts = [p for a, b in zip([-1, *cuts], [*cuts, len(ids)], strict=True) if (p := ids[a + 1 : b])]
            return "".join(self._spelled(p, not i) for i, p in enumerate(parts))
        return self._spelled(ids, True)

    def _spelled(self, ids: list[int], begins: bool) -> str:
        data = b"".join(map(self.raw.__getitem__, ids))
        if begins and self.prefix and data.startswith(b" ") and ids[0] in self.normal:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return replaced(data)


def replaced(data: bytes) -> str:
    """UTF-8 in which every byte of no whole character is U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for n in range(1, 5):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_loaded: dict[str, PieceBpe] = {}


def load(path: str) -> PieceBpe:
    """One encoder per worker process, so that its caches outlive a task."""
    if path not in _loaded:
        _loaded[path] = PieceBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs' doc_id with ids array<int> and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [coder.encode(x or "") for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(coder.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_documents' ids and texts, digested where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            counts, digests, decoded = [], [], []
            for text in batch.column("text"):
                ids = coder.encode(text.as_py() or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
