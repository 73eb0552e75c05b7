"""Packing: documents as token ids, cut at the sequence length, packed by first-fit decreasing in randomised groups.

Every document gets its closing id and is cut into full sequences and a remainder. Whole documents, written once as their
pieces, are dealt to groups by a hash of id and text, so the packing does not depend on how files are split; the number of
groups follows from the number of tokens, so a group holds `group_tokens` about, at any size of input. Only what shares a
hash and has more than a quarter of that (a very long document, a row repeated very often) is dealt by pieces: equal ones are
counted, told apart by their number among themselves, and dealt by start and number, so that this follows no file either. In a group
a tournament tree over the room left in each bin finds the first bin that a piece fits in with one walk from the root; a
full piece takes a bin of its own. Bins are padded to the sequence length.

Texts are tokenised by words between ASCII white space: the vocabulary's splitter never joins across it, so a word's ids
do not depend on its neighbours, and words seen before in the task, up to a bound, are looked up. Tasks take texts and
give pieces in slices of bounded size.

Defined results. Null or empty text: the closing id alone. Null ids are carried. Rows that repeat an id: each is a document
of its own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import lean, stored, text_of
from gridloom.llm.wordids import Numbered

LENGTH, CLOSING = 4096, 2
#: Words whose ids a task remembers; beyond it the memory starts anew with the next texts.
REMEMBERED = 200_000
#: Equal pieces that one row becomes at once.
COPIES = 4096
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The vocabulary's own splitting of lower-case ASCII words, and the mark that stands for a word's end.
_SPLIT, _END = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"), "\x00"
#: Words that the plain route takes: bytes that neither normalisation nor added tokens touch.
_PLAIN = re.compile(rb"[!-;=-~]+").fullmatch


#: A character that stands between words learned together; it has an id of its own, else words are learned one by one.
_MARK, _BETWEEN = b"\x01", b" \x01 "


@lru_cache(maxsize=2)
def _ascii_merger(path: str):
    """The vocabulary's merges for tiktoken, a word's end written as one byte; None unless ids are in the order of merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary writes as themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    raw = lambda t: bytes(byte[c] for c in t.removesuffix("</w>")) + (b"\0" if t.endswith("</w>") else b"")
    ids = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [ids["".join(p)] for p in pairs]
    if model["end_of_word_suffix"] != "</w>" or made != sorted(made):
        return None
    kept = set(made) | {i for t, i in ids.items() if len(t.removesuffix("</w>")) == 1}
    ranks = {raw(t): i for t, i in ids.items() if i in kept and b"\0" not in raw(t)[:-1]}
    return tiktoken.Encoding("ascii", pat_str=r"\n|[^\n\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), ranks[b"\n"]


class WordEncoder(Numbered):
    """Ids of whole texts by looking up words. Words of plain ASCII are merged many at once, others by the library itself."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__(remembered)
        self.tokenizer, self.merger = _tokenizer(path), _ascii_merger(path)
        marked = self.tokenizer.encode((b"a" + _BETWEEN + b"a" + _BETWEEN).decode(), add_special_tokens=False).ids
        plain = self.tokenizer.encode("a", add_special_tokens=False).ids
        self.mark = marked[-1] if marked == 2 * [*plain, marked[-1]] and marked[-1] not in plain else None

    def _learn(self, words: list[bytes]) -> None:
        plain, rest = [], []
        for w in words:
            (plain if self.merger and _PLAIN(w) else rest).append(w)
        if plain:
            merger, gap = self.merger
            lines = _SPLIT.sub(r"\g<0>" + _END, b"\n".join(plain).decode().lower())
            ids = np.array(merger.encode_ordinary(lines), np.uint32)
            at = np.flatnonzero(ids == gap)
            self.keep(plain, ids[ids != gap], np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1)
        if rest and self.mark is not None:
            rest = self._learn_joined(rest)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in some], add_special_tokens=False)]
            self.keep(some, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def _learn_joined(self, words: list[bytes]) -> list[bytes]:
        """Learns words many at once, a mark between them; returns those that hold the mark."""
        apart = [w for w in words if _MARK in w]
        some = [w for w in words if _MARK not in w] if apart else words
        for at in range(0, len(some), 1 << 14):
            part = some[at : at + (1 << 14)]
            lines = [_BETWEEN.join([*part[i : i + 256], b""]).decode("utf-8", "replace") for i in range(0, len(part), 256)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.mark)
            self.keep(part, ids[ids != self.mark], np.diff(np.concatenate(([-1], ends))) - 1)
        return apart

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """The number of each word of each text, all of them known now. A word is looked up once; new ones are numbered as they come."""
        if len(self.place) > self.remembered:
            self.forget()
        known, number = len(self.place), self.place.__getitem__
        got = [np.fromiter(map(number, words), np.int64, len(words)) for words in map(bytes.split, texts)]
        self._learn(list(islice(self.place, known, None)))
        return got

    def learn(self, texts: list[bytes]) -> None:
        """Learns the words of texts."""
        self.numbers(texts)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        return [self.gathered(at) for at in self.numbers(texts)]

    def ids(self, text: bytes) -> np.ndarray:
        return self.encode([text])[0]


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, closing: int = CLOSING) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and deal (a hash of id and text), for each piece of each document of docs (doc_id, text)."""
    path = path or vocabulary()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        end = np.array([closing], "<u4")
        for b in batches:
            of, starts, sizes, crcs, totals = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(b.column(1).to_pylist())):
                ids = np.concatenate((ids.astype("<u4"), end))
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    of.append(i)
                    starts.append(start)
                    sizes.append(len(part))
                    crcs.append(zlib.crc32(part.tobytes()))
                    totals.append(len(ids))
            rows = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), *(pa.array(c, pa.int64()) for c in (starts, sizes, crcs, totals)), b.column(2).take(rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    return docs.select("doc_id", text_of().cast("binary").alias("text"), F.xxhash64("doc_id", text_of()).alias("deal")).mapInArrow(run, _PIECE)


def first_fit_decreasing(sizes: list[int], room: int) -> list[int]:
    """The bin of each size, given in descending order: the first with room enough."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    best = [room] * (2 * leaves)  # the most room below each node
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node = 2 * node if best[2 * node] >= size else 2 * node + 1
        out.append(node - leaves)
        best[node] -= size
        while node > 1:
            node //= 2
            most = max(best[2 * node], best[2 * node + 1])
            if best[node] == most:
                break
            best[node] = most
    return out


_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(cut: DataFrame, length: int = LENGTH, group_tokens: int = 1 << 20, seed: int = 0) -> DataFrame:
    """The rows of pieces() with sequence_id and offset. cut must be a written table: its rows are read more than once."""
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / group_tokens))
    large = stored(cut.groupBy("deal").agg(F.sum("length").alias("n")).where(F.col("n") > max(length, group_tokens // 4)).select("deal"), "pack-large")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("deal", "ascending")])
        sizes = group.column("length").to_pylist()
        bins = first_fit_decreasing(sizes, length)
        filled, offsets = [0] * (max(bins) + 1), []
        for b, size in zip(bins, sizes, strict=True):
            offsets.append(filled[b])
            filled[b] += size
        base = key[0].as_py() << 32
        kept = [group.column(c).cast(pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        return pa.table([*kept, pa.array([base + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    of = lambda *apart: F.pmod(F.xxhash64("deal", *apart, F.lit(seed)), F.lit(groups)).alias("grp")
    whole = cut.join(large, "deal", "left_anti").select(*cut.columns, of())
    counted = cut.join(large, "deal", "left_semi").groupBy(*cut.columns).agg(F.count(F.lit(1)).alias("n"))
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("deal", "start", "chunk")
    copies = chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * COPIES, F.least("n", (F.col("chunk") + 1) * COPIES) - 1)))
    return whole.unionByName(copies.select(*cut.columns, of("start", "copy"))).groupBy("grp").applyInArrow(run, _PACKED)


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, closing: int = CLOSING, group_tokens: int = 1 << 20) -> DataFrame:
    """Documents cut, tokenised and packed."""
    return pack(stored(pieces(docs, path, length, closing), "pieces"), length, group_tokens)
