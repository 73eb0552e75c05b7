"""SentencePiece encoding and decoding: the segmentation of the highest total score, with forward scores shared by prefixes.

A text is marked as SentencePiece marks it, a mark for each blank and one in front, and falls into words at the marks; no
piece has a mark after another character, so words are segmented alone. The distinct words of many texts are sorted and
walked depth-first as the trie of their characters: the best score and last piece at each depth depend on the prefix
alone, so a word starts from the depth that it shares with the one before. A character that no piece holds costs ten less
than the worst piece and becomes its UTF-8 bytes.

The vocabulary gives pieces and scores. Its file is marked as byte-pair encoding; its scores are ranks of merges, and the
segmentation here is the one that a unigram model with these pieces and scores gives, not the merges' own: see the README.
Ties go to the longer last piece.

Defined results. Null or empty text: no ids. A U+2581 in a text is the same as a blank and comes back as one. Null ids are
carried, repeated rows give repeated results, an empty table gives none, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import text_of
from gridloom.llm.wordids import WordIds

MARK, PENALTY = "▁", 10.0
#: Words and ids whose segmentation a task remembers.
REMEMBERED = 400_000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces with scores; bytes_of[id] is what an id decodes to."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        kinds = range(sp.get_piece_size())
        plain = [i for i in kinds if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.scores = {sp.id_to_piece(i): (sp.get_score(i), i) for i in plain}
        self.unknown = min((s for s, _ in self.scores.values()), default=0.0) - PENALTY
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in kinds if sp.is_byte(i)}
        if len(self.byte_ids) != 256 or any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("the vocabulary needs a piece for each byte and no piece with a mark inside")
        self.longest = max(map(len, self.scores))
        ends: dict[str, set[int]] = {}
        for p in self.scores:
            ends.setdefault(p[-3:], set()).add(len(p))
        #: Lengths of pieces by their last three characters, the longest first; shorter pieces stand for themselves.
        self.lengths = {c: tuple(sorted(n, reverse=True)) for c, n in ends.items() if len(c) == 3}
        self.bytes_of = [b""] * sp.get_piece_size()
        for p, (_, i) in self.scores.items():
            self.bytes_of[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])

    def segment(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of the words, which are sorted."""
        scores, lengths, last = self.scores, self.lengths, ""
        best, back = [0.0], [(0, 0)]  # at each depth: the best score, the last piece's start and id
        for word in words:
            depth = _shared(last, word)
            del best[depth + 1 :], back[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                c = word[end - 1]
                top, step = float("-inf"), None
                if end > 2:
                    for n in lengths.get(word[end - 3 : end], ()):
                        if n <= end and (found := scores.get(word[end - n : end])) and best[end - n] + found[0] > top:
                            top, step = best[end - n] + found[0], (end - n, found[1])
                if end > 1 and (found := scores.get(word[end - 2 : end])) and best[end - 2] + found[0] > top:
                    top, step = best[end - 2] + found[0], (end - 2, found[1])
                found = scores.get(c)
                score = best[end - 1] + (found[0] if found else self.unknown)
                if score > top:
                    top, step = score, (end - 1, found[1] if found else -1)
                best.append(top)
                back.append(step)
            last, out, end = word, [], len(word)
            while end:
                start, piece = back[end]
                if piece < 0:
                    out += [self.byte_ids[b] for b in reversed(word[start:end].encode("utf-8", "replace"))]
                else:
                    out.append(piece)
                end = start
            yield out[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "replace")


def _shared(a: str, b: str) -> int:
    """How many characters two strings begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        low, n = (mid, n) if a[low:mid] == b[low:mid] else (low, mid)
    return low if a[low : low + 1] != b[low : low + 1] else low + 1


class PieceEncoder(WordIds):
    """Encodes texts, many at a time."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__(remembered)
        self.vocabulary = _vocabulary(path)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [marked_words(t) for t in texts]
        words = {w for ws in split for w in ws}
        new = words.difference(self.place)
        if len(self.place) + len(new) > self.remembered or self.used > 16 * self.remembered:
            self.forget()
            new = words
        new = sorted(new)
        got = list(self.vocabulary.segment(new))
        self.keep(new, np.fromiter((i for g in got for i in g), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))
        return [self.gather(ws) for ws in split]


def marked_words(text: str) -> list[str]:
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _slices(column: pa.Array, most: int = 256, room: int = 4 << 20) -> Iterator[list[str]]:
    """A column's texts, a bounded number and size at a time."""
    some, held = [], 0
    for x in column:
        some.append(x.as_py())
        held += len(some[-1])
        if len(some) == most or held > room:
            yield some
            some, held = [], 0
    if some:
        yield some


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids, an array, of each row of docs (doc_id, text)."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(path)
        for b in batches:
            at = 0
            for texts in _slices(b.column(1)):
                ids = encoder.encode(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])
                at += len(texts)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of rows (doc_id, ids)."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each text encoded and decoded: doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, round_trip."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(path)
        for b in batches:
            rows = []
            for texts in _slices(b.column(1)):
                for text, ids in zip(texts, encoder.encode(texts), strict=True):
                    back = encoder.vocabulary.decode(ids.tolist())
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
