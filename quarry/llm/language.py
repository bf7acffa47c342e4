"""Language identification with blended-spectrum string kernels, Nyström landmarks and kernel ridge regression.

The kernel of two texts counts the distinct 1- to 4-grams of letters that both have, over the root of the product of how
many each has. Nyström features are kernels with the landmarks, whitened. A prediction is linear in them, hence in the
presence of the landmarks' n-grams; so the fitted model is one row of weights per n-gram that a landmark has, and a batch
of texts is scored by one product of its sparse presence rows with those weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import packed, schema_of, slices
from quarry.llm.quality import remainder

#: Training documents at most (least xxhash64 of the id), and landmarks among them, dealt evenly over the languages.
MAX_TRAIN, LANDMARKS = 3000, 256
#: A landmark has so many distinct n-grams at most, which bounds the model; other texts have any number.
MAX_GRAMS = 20_000
#: n-grams of these lengths.
SPECTRUM = (1, 2, 3, 4)
RIDGE, SHARPNESS = 1e-2, 4.0

_OTHER = re.compile(r"[\W\d_]+")
_MULT = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def grams(text: str | None) -> np.ndarray:
    """Sorted 64-bit keys of the distinct n-grams in the words of a text, lower-cased; empty if it has no letter."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, plain)):
        return np.empty(0, np.uint64)
    c = np.frombuffer(f" {plain} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    found, h = [], np.zeros(len(c), np.uint64)
    for k, n in enumerate(SPECTRUM):
        h = (h[: len(c) - n + 1] ^ (h[: len(c) - n + 1] >> np.uint64(31))) * _MULT[0] + (c[n - 1 :] + np.uint64(k)) * _MULT[n - 1]
        found.append((h ^ (h >> np.uint64(29))) * _MULT[1])
    return np.unique(np.concatenate(found))


class Landmarks:
    """n-grams of the landmarks, sorted, and for each the landmarks that have it."""

    def __init__(self, marks: list[np.ndarray]) -> None:
        self.sizes = np.array([len(m) for m in marks], float)
        keys, owner = np.concatenate(marks), np.repeat(np.arange(len(marks)), [len(m) for m in marks])
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts = np.unique(keys[order], return_index=True)
        self.owner = owner[order]
        self.ends = np.append(self.starts[1:], len(order))

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Normalised kernel of the n-grams x with every landmark."""
        at = find(self.keys, x)
        n = self.ends[at] - self.starts[at]
        flat = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[flat], minlength=len(self.sizes)) / np.sqrt(self.sizes * max(1, len(x)))


def find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places among the sorted keys of those x that are there."""
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at[keys[at] == x]


class Model:
    """One ridge regression per language on Nyström features, as weights of the landmarks' n-grams."""

    def __init__(self, languages: list[str], keys: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.languages, self.keys, self.weights, self.bias = languages, keys, weights, bias

    @classmethod
    def fit(cls, marks: Landmarks, between: np.ndarray, kernels: np.ndarray, languages: list[str]) -> Model:
        """From the kernels of landmarks with each other and of training texts with landmarks."""
        kinds = sorted(set(languages))
        value, vector = np.linalg.eigh(between)
        whiten = vector / np.sqrt(np.maximum(value, 1e-6))
        z = kernels @ whiten
        y = np.array([[1.0 if x == k else -1.0 for k in kinds] for x in languages])
        mean, bias = z.mean(0), y.mean(0)
        zc = z - mean
        w = np.linalg.solve(zc.T @ zc + RIDGE * len(z) * np.eye(z.shape[1]), zc.T @ (y - bias))
        each = (whiten @ w) / np.sqrt(marks.sizes)[:, None]
        weights = np.add.reduceat(each[marks.owner], marks.starts)
        return cls(kinds, marks.keys, weights, bias - mean @ w)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = [grams(t) for t in texts]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        some = [i for i, x in enumerate(found) if len(x)] if self.languages else []
        if some:
            at = [find(self.keys, found[i]) for i in some]
            product = np.zeros((len(some), len(self.languages)))
            np.add.at(product, np.repeat(np.arange(len(some)), [len(a) for a in at]), self.weights[np.concatenate(at)])
            margin = SHARPNESS * (product / np.sqrt([[len(found[i])] for i in some]) + self.bias)
            share = np.exp(margin - margin.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            for i, k, row in zip(some, share.argmax(1), share):
                names[i], scores[i] = self.languages[k], row[k]
        return names, scores


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` documents with a lang whose crc32(doc_id) mod 3 is not 1; texts without a letter and
    null ids are left out, and of several rows under one id the least lang and text counts. Nothing to learn from: every prediction is ``und``."""
    able = docs.select(F.col("doc_id").alias("id"), "lang", "text").where(F.col("lang").isNotNull() & (remainder("id", 3) != 1))
    chosen = able.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = able.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("r")).select("id", "r.*")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = pa.array([len(grams(t.as_py())) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), n], names=["id", "lang", "n"])

    texts = rows.mapInArrow(counted, schema_of(rows, "id,lang", "n bigint")).where((F.col("n") > 0) & (F.col("n") <= MAX_GRAMS))
    by: dict[str, list] = {}
    for r in texts.orderBy(F.xxhash64("id"), "id").collect():  # max_train at most
        by.setdefault(r.lang, []).append(r.id)
    turns = [i for turn in range(LANDMARKS) for lang in sorted(by) for i in by[lang][turn : turn + 1]][:LANDMARKS]
    got = rows.where(F.col("id").isin(turns)).orderBy(F.xxhash64("id"), "id").collect() if turns else []
    if not got:
        return Model([], np.empty(0, np.uint64), np.empty((0, 0)), np.empty(0))
    held = [grams(r.text) for r in got]
    marks = Landmarks(held)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(i, marks.kernel(x).tobytes()) for i, t in enumerate(b.column("text")) if len(x := grams(t.as_py()))]
            at = pa.array([i for i, _ in found], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("lang").take(at), pa.array([k for _, k in found], pa.binary())], names=["id", "lang", "k"])

    made = rows.mapInArrow(kernels, schema_of(rows, "id,lang", "k binary")).orderBy(F.xxhash64("id"), "id", "lang", "k").collect()
    between = np.stack([marks.kernel(x) for x in held])
    return Model.fit(marks, between, np.stack([np.frombuffer(r.k) for r in made]), [r.lang for r in made])


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with two more columns, lang_pred and lang_score: a learned language and its share, or ``und`` and 0 for null
    texts and texts without a letter. Whole texts are read; rows stay as they are, repeated or not; an empty table stays
    empty. Columns of docs called lang_pred or lang_score, in any case, are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            names, scores = [], []
            texts = b.column("_text").to_pylist()
            for k in range(0, len(texts), 128):
                n, s = model.predict(texts[k : k + 128])
                names += n
                scores += s.tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["_row", "lang_pred", "lang_score"],
            )

    rows = packed(docs, ("lang_pred", "lang_score"), _text=F.col(f"`{text}`"))
    return rows.mapInArrow(run, schema_of(rows, "_row", "lang_pred string, lang_score double")).select("_row.*", "lang_pred", "lang_score")
