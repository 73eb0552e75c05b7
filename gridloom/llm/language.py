"""Language ID: nearest of several centroids per language, over hashed n-gram vectors.

A text is lower-cased, every ASCII character but letters becomes a blank, and its n-grams of one to three code points are
counted in `DIMS` hashed places. Counts are damped, weighted by inverse document frequency over all training documents,
and scaled to length one. Each language's vectors, from a bounded sample, are clustered by cosine; a text takes the
language of the nearest centroid of any language, and is rejected if it lies much further from it than nearly all of that
language's sample does. Short texts lie further from any centroid, so the limit is looser for them.

Bounds: the sample holds `SAMPLE` documents at most, dealt evenly over the languages; the model sent to the tasks is
DIMS * CENTROIDS floats a language; document frequencies reach the driver as DIMS numbers.

More than `LANGS` values of lang are an error, as the model would grow with them.

Defined results. Null text, or one with no letter: `und`, score 0, rejected. Null lang: not learned from. No labelled
documents at all: `und` for every text. Null ids are carried and count as not held out; repeated rows get equal results;
an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import held_out, lean, stored

DIMS, SAMPLE, CENTROIDS, ROUNDS = 8192, 2048, 4, 12
#: A labelling with more values than this is no list of languages.
LANGS = 1024
#: Word characters that are no digits: letters, and a few numerals that isalpha() sorts out.
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = {c: " " for c in range(128) if not chr(c).isalpha()}
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def places(text: str) -> np.ndarray:
    """The hashed place of each n-gram of a text."""
    c = np.frombuffer(f" {text.lower().translate(_BLANK)} ".encode("utf-32-le", "replace"), np.uint32)
    with np.errstate(over="ignore"):
        one = c * _MIX[0] + np.uint32(1)
        two = c[:-1] * _MIX[1] + c[1:] * _MIX[2] + np.uint32(2)
        three = c[:-2] * _MIX[3] + c[1:-1] * _MIX[0] + c[2:] * _MIX[1] + np.uint32(3)
        h = np.concatenate((one, two, three))
        full = c != 32
        shown = np.concatenate((full, full[:-1] | full[1:], full[:-2] | full[1:-1] | full[2:]))
        h ^= h >> np.uint32(15)
        return ((h * _MIX[1]) >> np.uint32(32 - DIMS.bit_length() + 1))[shown]


def counts(text: str) -> np.ndarray:
    return np.bincount(places(text), minlength=DIMS)


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count) * idf
    return (v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32)


def centroids(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of length one: seeds by the farthest vector, then spherical k-means."""
    centre = vectors.sum(0)
    seeds = [int(np.argmax(vectors @ centre))]
    near = vectors @ vectors[seeds[0]]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    out = vectors[seeds]
    for _ in range(rounds):
        of = np.argmax(vectors @ out.T, axis=1)
        sums = np.stack([vectors[of == j].sum(0) if (of == j).any() else out[j] for j in range(len(out))])
        out = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return out.astype(np.float32)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    idf: np.ndarray
    centres: np.ndarray
    of: np.ndarray
    least: np.ndarray
    usual: np.ndarray | None = None  # n-grams of the middle text of each language's sample

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine with the nearest centroid, and whether the text is rejected."""
        if not self.langs or text is None or not has_letter(text):
            return "und", 0.0, True
        count = counts(text)
        near = self.centres @ weighted(count, self.idf)
        best = int(np.argmax(near))
        lang = int(self.of[best])
        slack = 1.0 if self.usual is None else min(1.0, float(np.sqrt(count.sum() / max(self.usual[lang], 1))))
        return self.langs[lang], float(min(1.0, max(0.0, near[best]))), bool(near[best] < slack * self.least[lang])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of docs (text) have each place, and how many docs there are."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for text in b.column(0):
                total[np.unique(places(text.as_py()))] += 1
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate(([n], total)))], ["place", "n"])

    df = docs.where("text is not null").select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    got = {r["place"]: r["n"] for r in df.collect()}
    return np.array([got.get(i, 0) for i in range(DIMS)]), got.get(-1, 0)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from all of docs (doc_id, text, lang)."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(LANGS + 1).collect()}
    if len(sizes) > LANGS:
        raise ValueError(f"lang has more than {LANGS} values")
    if not sizes:
        return Model((), np.zeros(DIMS), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 0.05
    each = max(1, sample // len(sizes))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, 2 * each / c))) for k, c in sizes.items()))
    drawn = docs.withColumn("draw", draw).where(F.col("draw") <= wanted)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    drawn = drawn.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counts(t.as_py()) for t in b.column(1)]
            at = [np.flatnonzero(c) for c in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.tolist() for a in at], pa.list_(pa.int32())), pa.array([c[a].tolist() for c, a in zip(got, at, strict=True)], pa.list_(pa.int32()))], ["lang", "at", "count"])

    rows = stored(drawn.mapInArrow(run, "lang string, at array<int>, count array<int>"), "language-sample").toArrow()
    langs = tuple(sorted(sizes))
    vectors: dict[str, list[np.ndarray]] = {k: [] for k in langs}
    lengths: dict[str, list[int]] = {k: [] for k in langs}
    for lang, at, count in zip(rows.column(0), rows.column(1), rows.column(2), strict=True):
        c = np.zeros(DIMS, np.int64)
        c[at.values.to_numpy()] = count.values.to_numpy()
        vectors[lang.as_py()].append(weighted(c, idf))
        lengths[lang.as_py()].append(int(c.sum()))
    centres, of, least = [], [], []
    for i, k in enumerate(langs):
        got = np.stack(sorted(vectors[k], key=lambda v: v.tobytes())) if vectors[k] else np.zeros((0, DIMS), np.float32)
        own = centroids(got) if len(got) else got
        centres.append(own)
        of += [i] * len(own)
        near = (got @ own.T).max(axis=1) if len(got) else np.zeros(1)
        least.append(0.5 * float(np.quantile(near, 0.01)))
    return Model(langs, idf, np.concatenate(centres), np.array(of), np.array(least), np.array([np.median(lengths[k]) if lengths[k] else 1 for k in langs]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row of docs (doc_id, text)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(1)]
            lang, score, rejected = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not rejected."""
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not model.predict(t.as_py())[2] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identified(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts for all."""
    model = fit(docs.where(~held_out(4, 2)))
    return predict(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")
