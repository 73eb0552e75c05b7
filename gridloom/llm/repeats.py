"""Suffix-array dedup: repeated windows of `depth` bytes, by a radix sort of suffixes to that depth and no further.

Only suffixes that may repeat are sorted. In every window the 24-byte string of the least hash is its anchor; equal windows
have equal anchors, so a window can repeat only if its anchor's hash is found in two documents. Hence:

1. Documents are packed into blocks of a bounded size, written once. A block gives the distinct anchors in it, 32 bits
   of each, with the number of its documents that hold them, dealt by the anchor's other bits: the most significant digit.
2. Each deal tells its blocks which of their anchors lie in two documents or more.
3. A block gives the distinct strings that its windows with such anchors cover, consecutive windows as one string, with
   the least and largest id that holds each; dealt by anchor. Windows of an anchor held by very many documents go one
   by one, dealt by their own bytes, so that no deal grows with a passage that everyone repeats.
4. In each deal the strings' suffixes are sorted digit by digit, eight bytes a pass from the most significant on; groups
   of one end early, and groups left at the full depth are exactly the repeated windows. Blocks are told each one's least id.
5. A block removes the bytes of windows that a smaller id holds.

Equality is decided on bytes; hashes only choose what is compared. Blocks and deals have bounded sizes whose number
follows the input. A string that many documents hold is sent once a block.

Defined results. Null or empty text: no bytes. Texts shorter than the depth lose nothing. A null id counts as larger than
any other, and two null ids as equal; rows that repeat an id do not remove each other's bytes. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored, text_of

DEPTH, ANCHOR = 50, 24
BLOCK_BYTES, DEAL_ANCHORS, DEAL_BYTES = 4 << 20, 1 << 20, 6 << 20
#: An anchor in more documents than this has its windows dealt one by one.
COMMON = 500
_NONE = np.iinfo(np.int64).max
_MESSAGE = "k long, kind int, src long, data binary"
_M = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=41) for b in range(256)], np.uint64)


def _packed(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def _unpacked(data: pa.Scalar) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data.as_py()))


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["k", "kind", "src", "data"])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes in a row, joined from hashes of powers of two."""
    with np.errstate(over="ignore"):
        power, size, out, done = _TABLE[data], 1, None, 0
        while True:
            if k & size:
                out = power if out is None else _mix(out[: len(power) - done] * _M + power[done:])
                done += size
            if done == k:
                return out[: len(data) - k + 1]
            power = _mix(power[: len(power) - size] * _M + power[size:])
            size *= 2


def least_of_each(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each width hashes in a row."""
    size, m = 1, h
    while 2 * size <= width:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    n = len(h) - width + 1
    return np.minimum(m[:n], m[width - size : width - size + n])


def anchored_runs(data: np.ndarray, depth: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: its first window's place, how many windows, and the anchor's hash."""
    if len(data) < depth:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    width = depth - anchor + 1
    least = least_of_each(gram_hashes(data, anchor), width)
    new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    sizes = np.diff(np.concatenate((new, [len(least)])))
    parts = -(-sizes // width)  # a text that repeats itself has long runs
    first = np.repeat(new, parts) + width * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    ends = np.minimum(first + width, np.repeat(new + sizes, parts))
    return first, ends - first, least[first]


class Block:
    """Documents packed together: ids, ends, and their bytes in a row."""

    def __init__(self, data: pa.Scalar, depth: int, anchor: int):
        self.ids, self.ends, text = _unpacked(data)
        self.null, self.data, self.depth = self.ids == _NONE, np.frombuffer(text, np.uint8), depth
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        runs = [anchored_runs(self.data[s:e], depth, anchor) for s, e in zip(self.starts, self.ends, strict=True)]
        self.place = np.concatenate([r[0] + s for r, s in zip(runs, self.starts, strict=True)])
        self.windows = np.concatenate([r[1] for r in runs])
        self.key = np.concatenate([r[2] for r in runs])
        self.doc = np.repeat(np.arange(len(runs)), [len(r[0]) for r in runs])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors and how many documents hold each."""
        order = np.lexsort((self.doc, self.key))
        k, d = self.key[order], self.doc[order]
        once = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))[: len(k)]
        return np.unique(k[once], return_counts=True)

    def strings(self, told: list[tuple], deals: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings that windows with shared anchors cover and, for each occurrence: its place, document, string."""
        shared = np.concatenate([k for k, _ in told]) if told else np.empty(0, np.uint64)
        common = np.concatenate([c for _, c in told]) if told else np.empty(0, bool)
        order = np.argsort(shared)
        shared, common = shared[order], common[order]
        at = np.searchsorted(shared, short_keys(self.key, deals))
        hit = np.zeros(len(self.key), bool)
        inside = at < len(shared)
        hit[inside] = shared[at[inside]] == short_keys(self.key[inside], deals)
        single = np.zeros(len(self.key), bool)
        single[hit] = common[at[hit]]
        text, known = self.data.tobytes(), {}
        place, doc, of, keys, alone = [], [], [], [], []
        for i in np.flatnonzero(hit):
            p, n = int(self.place[i]), int(self.windows[i])
            for q, m in ((x, 1) for x in range(p, p + n)) if single[i] else ((p, n),):
                s = text[q : q + m + self.depth - 1]
                k = known.get(s)
                if k is None:
                    k = known[s] = len(known)
                    keys.append(self.key[i])
                    alone.append(single[i])
                place.append(q)
                doc.append(self.doc[i])
                of.append(k)
        self.keys, self.alone = np.array(keys, np.uint64), np.array(alone, bool)
        return list(known), np.array(place, np.int64), np.array(doc, np.int64), np.array(of, np.int64)


def short_keys(keys: np.ndarray, deals: int) -> np.ndarray:
    """The deal of each anchor and 32 bits of its hash, as one number."""
    return (keys % np.uint64(deals) << np.uint64(32)) | (keys >> np.uint64(32))


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of docs (doc_id, text): k is the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, held = TaskContext.get().partitionId() << 33, [], [], 0

        def made() -> pa.RecordBatch:
            data = _packed(np.array(ids, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64), b"".join(texts))
            return _messages([(block, 0, len(ids), data)])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                ids.append(_NONE if i.as_py() is None else i.as_py())
                texts.append(t.as_py())
                held += len(texts[-1]) + 16
                if held >= block_bytes:
                    yield made()
                    block, ids, texts, held = block + 1, [], [], 0
        if ids:
            yield made()

    return docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(run, _MESSAGE)


def _split(of: np.ndarray, deals: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each deal."""
    order = np.argsort(deals, kind="stable")
    cut = np.flatnonzero(np.diff(deals[order])) + 1
    for part in np.split(of[order], cut):
        if len(part):
            yield int(deals[part[0]]), part


def deal_anchors(blocks: DataFrame, deals: int, depth: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, data in zip(b.column("k"), b.column("data"), strict=True):
                keys, counts = Block(data, depth, anchor).anchors()
                rows = [(d, 1, k.as_py(), _packed((keys[at] >> np.uint64(32)).astype(np.uint32), np.minimum(counts[at], 255).astype(np.uint8))) for d, at in _split(np.arange(len(keys)), (keys % np.uint64(deals)).astype(np.int64))]
                yield _messages(rows)

    return blocks.mapInArrow(run, _MESSAGE)


def shared_anchors(dealt: DataFrame, common: int) -> DataFrame:
    """For each block and deal the anchors that two documents hold, and which of them are common."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        deal, src = np.uint64(key[0].as_py()), group.column("src").to_pylist()
        got = [_unpacked(x) for x in group.column("data")]
        keys, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        total = np.bincount(at, np.concatenate([g[1] for g in got]), len(keys))
        rows, done = [], 0
        for block, (own, _) in zip(src, got, strict=True):
            n = total[at[done : done + len(own)]]
            done += len(own)
            hit = n > 1
            if hit.any():
                rows.append((block, 1, int(deal), _packed((deal << np.uint64(32)) | own[hit].astype(np.uint64), n[hit] > common)))
        return pa.Table.from_batches([_messages(rows)])

    return dealt.groupBy("k").applyInArrow(run, _MESSAGE)


def deal_strings(blocks: DataFrame, shared: DataFrame, deals: int, out: int, depth: int, anchor: int) -> DataFrame:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        block, told = _block_of(group, depth, anchor)
        if block is None or not told[1]:
            return pa.Table.from_batches([_messages([])])
        strings, _, doc, of = block.strings(told[1], deals)
        low, high = np.full(len(strings), _NONE), np.full(len(strings), -_NONE)
        np.minimum.at(low, of, block.ids[doc])
        np.maximum.at(high, of, block.ids[doc])
        to = np.array([xxhash.xxh3_64_intdigest(s) if a else int(k) for s, a, k in zip(strings, block.alone, block.keys, strict=True)], np.uint64) % np.uint64(out)
        rows = []
        for d, at in _split(np.arange(len(strings)), to.astype(np.int64)):
            some = [strings[i] for i in at]
            rows.append((d, 2, key[0].as_py(), _packed(at.astype(np.int32), np.array([len(s) for s in some], np.int32), b"".join(some), low[at], high[at])))
        return pa.Table.from_batches([_messages(rows)])

    return blocks.unionByName(shared).groupBy("k").applyInArrow(run, _MESSAGE)


def _block_of(group: pa.Table, depth: int, anchor: int) -> tuple[Block | None, dict[int, list[tuple]]]:
    block, told = None, {1: [], 2: []}
    for kind, data in zip(group.column("kind").to_pylist(), group.column("data"), strict=True):
        if kind == 0:
            block = Block(data, depth, anchor)
        else:
            told[kind].append(_unpacked(data))
    return block, told


def repeated_windows(data: np.ndarray, starts: np.ndarray, depth: int) -> list[np.ndarray]:
    """Groups of two or more of the windows that begin at starts and are equal to the depth: a radix sort from the most
    significant digit of eight bytes on, in which groups of one are put aside after each pass."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    digits = np.zeros(len(data), np.uint64)
    for i in range(8):
        digits = (digits << np.uint64(8)) | padded[i : i + len(data)]
    live, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for at in range(0, depth, 8):
        digit = digits[starts[live] + at]
        if depth - at < 8:
            digit = digit >> np.uint64(8 * (8 - depth + at))
        order = np.lexsort((digit, group)) if at else np.argsort(digit, kind="stable")
        live, g, digit = live[order], group[order], digit[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (digit[1:] != digit[:-1])))[: len(g)]
        group = np.cumsum(new) - 1
        many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.empty(0, bool)
        live, group = live[many], group[many]
        if not len(live):
            return []
    return np.split(live, np.flatnonzero(np.diff(group)) + 1)


def least_ids(dealt: DataFrame, depth: int) -> DataFrame:
    """For each block: its strings' windows, in runs, with the least id that holds them, where a larger one in it does too."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        got = [_unpacked(x) for x in group.column("data")]
        known: dict[bytes, int] = {}
        low, of = [], []
        for _, sizes, text, least, _ in got:
            own, at = [], 0
            for n, m in zip(sizes.tolist(), least.tolist(), strict=True):
                s = text[at : at + n]
                at += n
                k = known.setdefault(s, len(known))
                if k == len(low):
                    low.append(m)
                elif m < low[k]:
                    low[k] = m
                own.append(k)
            of.append(np.array(own, np.int64))
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        ends = np.cumsum(sizes)
        n = sizes - depth + 1  # windows of each string
        string = np.repeat(np.arange(len(sizes)), n)
        offset = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
        least = np.array(low, np.int64)[string]
        data = np.frombuffer(b"".join(known), np.uint8)
        for g in repeated_windows(data, (ends - sizes)[string] + offset, depth):
            least[g] = least[g].min()
        first = np.flatnonzero(np.concatenate(([True], (string[1:] != string[:-1]) | (least[1:] != least[:-1]))))
        size = np.diff(np.concatenate((first, [len(string)])))
        begin = np.searchsorted(string[first], np.arange(len(sizes) + 1))
        rows = []
        for src, (places, _, _, _, high), own in zip(group.column("src").to_pylist(), got, of, strict=True):
            n = begin[own + 1] - begin[own]
            at = np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            told = least[first[at]] < np.repeat(high, n)
            if told.any():
                at = at[told]
                rows.append((src, 2, 0, _packed(np.repeat(places, n)[told], offset[first[at]].astype(np.int32), size[at].astype(np.int32), least[first[at]])))
        return pa.Table.from_batches([_messages(rows)])

    return dealt.groupBy("k").applyInArrow(run, _MESSAGE)


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(blocks: DataFrame, shared: DataFrame, least: DataFrame, deals: int, depth: int, anchor: int, texts: bool) -> DataFrame:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        block, told = _block_of(group, depth, anchor)
        gone = np.zeros(len(block.data) + 1, np.int32)
        if told[2]:
            _, place, doc, of = block.strings(told[1], deals)
            string, offset, size, low = (np.concatenate(x) for x in zip(*told[2], strict=True))
            order = np.argsort(string, kind="stable")
            string, offset, size, low = string[order], offset[order], size[order], low[order]
            a, b = np.searchsorted(string, of, side="left"), np.searchsorted(string, of, side="right")
            n = b - a
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            hit = low[at] < np.repeat(block.ids[doc], n)
            begin = (np.repeat(place, n) + offset[at])[hit]
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + size[at][hit] + depth - 1, -1)
        gone = np.cumsum(gone[:-1]) > 0
        rows = []
        for i, (s, e) in enumerate(zip(block.starts, block.ends, strict=True)):
            g = gone[s:e]
            kept = block.data[s:e][~g].tobytes()
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            rows.append((None if block.null[i] else int(block.ids[i]), int(e - s), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
        columns, types = zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string(), pa.binary()]
        names = [*(c.split()[0] for c in _OUT.split(", ")), "kept"]
        return pa.table({k: pa.array(list(c), t) for k, c, t in zip(names, columns, types)})

    return blocks.unionByName(shared).unionByName(least).groupBy("k").applyInArrow(run, _OUT + ", kept binary" * texts)


def without_repeats(docs: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR, common: int = COMMON, texts: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of each row of docs (doc_id, text)."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(pack(docs, block_bytes), "repeat-blocks")
    total = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    deals = max(least, round(total * 2 / (depth - anchor + 2) / DEAL_ANCHORS))
    shared = stored(shared_anchors(deal_anchors(blocks, deals, depth, anchor), common), "repeat-anchors")
    out = max(least, round(total / DEAL_BYTES))
    told = stored(least_ids(deal_strings(blocks, shared, deals, out, depth, anchor), depth), "repeat-least")
    return cut(blocks, shared, told, deals, depth, anchor, texts)
