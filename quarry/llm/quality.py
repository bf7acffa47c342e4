"""Quality classifier: a linear-chain conditional random field over lines, aggregated into a document score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import packed, schema_of, slices

#: Labelled documents that the field is fitted on, at most: those of least xxhash64(doc_id); and lines in all of them.
MAX_TRAIN, MAX_LINES = 4000, 200_000
#: Lines of a training chain; a longer document trains as several chains. Scoring always uses whole chains.
CHAIN = 64
#: A document is good from this score on.
THRESHOLD = 0.3
ROUNDS, RATE, RIDGE = 120, 0.15, 1e-3

_OWN = 16
#: Features of a line: its own, those of its neighbours, marks of first and last line, and a constant.
N_FEATURES = 3 * _OWN + 3
_PUNCT = frozenset(".,;:'\"()-?!")


def split_lines(text: str | None) -> list[str]:
    """Lines with something on them."""
    return [x for x in (text or "").split("\n") if x and not x.isspace()]


def line_features(lines: list[str]) -> np.ndarray:
    """Features of the lines of one document, neighbours included."""
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    own = np.empty((len(lines), _OWN), np.float32)
    for i, x in enumerate(lines):
        words = x.split()
        n, m, kinds = len(x), len(words), len(set(words))
        letters = sum(map(str.isalpha, x))
        digits = sum(map(str.isdigit, x))
        upper = sum(map(str.isupper, x))
        common = sum(map(x.count, _PUNCT))
        pipes, bangs = x.count("|"), x.count("!")
        symbols = max(0, n - letters - digits - common - (m - 1))
        tail = sum(not w[-1].isalnum() for w in words)
        twins = sum(map(str.__eq__, words, words[1:]))
        own[i] = (
            upper / max(1, letters), digits / n, symbols / n, pipes / m, tail / m, letters / n / m if m < 3 else 0.0,
            kinds / m, np.log1p(m) / 5, x.rstrip()[-1] in ".!?", x[0].isupper(), letters / n, twins / m, bangs / m,
            m < 3, min(1.0, letters / m / 20), min(seen[x] - 1, 5) / 5,
        )
    out = np.zeros((len(lines), N_FEATURES), np.float32)
    out[:, :_OWN] = own
    out[1:, _OWN : 2 * _OWN] = own[:-1]
    out[:-1, 2 * _OWN : 3 * _OWN] = own[1:]
    out[0, -3] = out[-1, -2] = 1
    out[:, -1] = 1
    return out


class Field:
    """Weights of the field: unary (one per feature, for label good) and a 2 x 2 matrix of transitions."""

    def __init__(self) -> None:
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.unary, self.trans = np.zeros(N_FEATURES), np.zeros((2, 2))
        self.slope, self.offset, self.blank = 1.0, 0.0, 0.5

    def chains(self, lens: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over chains, longest first: P(line is good), flat; expected transitions, 2 x 2."""
        n, steps = len(lens), int(lens.max(initial=0))
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
        live = np.searchsorted(-lens, -np.arange(1, steps + 1), side="right")
        psi = np.exp(np.clip(np.stack([-scores / 2, scores / 2], 1), -25, 25))
        a = np.exp(self.trans)
        forward, backward = np.ones((len(scores), 2)), np.ones((len(scores), 2))
        cur = np.ones((n, 2))
        for t in range(steps):
            k = live[t]
            at = starts[:k] + t
            cur = psi[at] * (cur[:k] @ a if t else cur[:k])
            cur /= cur.sum(1, keepdims=True)
            forward[at] = cur
        counts, cur = np.zeros((2, 2)), np.ones((0, 2))
        for t in range(steps - 1, 0, -1):
            k = live[t]
            at = starts[:k] + t
            cur = np.concatenate([cur, np.ones((k - len(cur), 2))])
            out = psi[at] * cur
            pair = forward[at - 1][:, :, None] * a * out[:, None, :]
            counts += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            cur = out @ a.T
            cur /= cur.sum(1, keepdims=True)
            backward[at - 1] = cur
        both = forward * backward
        return both[:, 1] / both.sum(1), counts

    def fit(self, docs: list[np.ndarray], labels: list[int], lengths: list[np.ndarray]) -> Field:
        """Maximum likelihood with every line of a document carrying its label, by Adam; then a logistic calibration."""
        parts = [(d[k : k + CHAIN], y) for d, y in zip(docs, labels) for k in range(0, len(d), CHAIN)]
        if not parts or len(set(labels)) < 2:
            self.offset = float(np.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 0.5)))
            self.slope, self.blank = 0.0, 1 / (1 + np.exp(-self.offset))
            return self
        parts.sort(key=lambda p: -len(p[0]))
        lens = np.array([len(d) for d, _ in parts])
        x = np.concatenate([d for d, _ in parts]).astype(np.float64)
        y = np.repeat([v for _, v in parts], lens).astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.mean[-1], self.scale[-1] = 0, 1
        x = (x - self.mean) / self.scale
        real = np.zeros((2, 2))
        for d, v in parts:
            real[v, v] += len(d) - 1
        theta, m1, m2 = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
        for step in range(1, ROUNDS + 1):
            self.unary, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
            p, counts = self.chains(lens, x @ self.unary)
            grad = np.concatenate([x.T @ (y - p), (real - counts).ravel()]) / len(y) - RIDGE * theta
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
            theta = theta + RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        self.unary, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
        self._calibrate(self.marginal(docs, lengths), np.array(labels, float))
        return self

    def _calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        z = np.log(raw / (1 - raw))
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -30, 30)))
            grad = np.array([(y - p) @ z - 1e-2 * w[0], (y - p).sum() - 1e-2 * w[1]])
            h = p * (1 - p)
            hess = np.array([[h @ z**2 + 1e-2, h @ z], [h @ z, h.sum() + 1e-2]])
            w = w + np.clip(np.linalg.solve(hess, grad), -1, 1)
        self.slope, self.offset = float(w[0]), float(w[1])
        self.blank = float(y.mean())

    def marginal(self, docs: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, for documents that have lines."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lens = np.array([len(docs[i]) for i in order], np.int64)
        x = (np.concatenate([docs[i] for i in order]) - self.mean) / self.scale
        p, _ = self.chains(lens, x @ self.unary)
        w = np.concatenate([lengths[i] for i in order]).astype(float)
        at = np.concatenate([[0], np.cumsum(lens)[:-1]])
        out = np.empty(len(docs))
        out[order] = np.add.reduceat(p * w, at) / np.add.reduceat(w, at)
        return np.clip(out, 1e-9, 1 - 1e-9)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores from 0 to 1; a text without lines gets the training documents' share of good ones."""
        lines = [split_lines(t) for t in texts]
        some = [i for i, x in enumerate(lines) if x]
        out = np.full(len(texts), self.blank)
        if some:
            raw = self.marginal([line_features(lines[i]) for i in some], [np.array([*map(len, lines[i])]) for i in some])
            out[some] = 1 / (1 + np.exp(-np.clip(self.slope * np.log(raw / (1 - raw)) + self.offset, -30, 30)))
        return out


def remainder(doc_id: str, mod: int) -> F.Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_lines: int = MAX_LINES) -> Field:
    """Fit on at most ``max_train`` labelled documents whose crc32(doc_id) mod 5 is not 0.

    A document that would bring the sample over ``max_lines`` lines is left out of it, so that its size on the driver is
    bounded (200 bytes a line). Only the text is an input. Of several labels for one id the mean counts, rounded up from one half; null labels and
    null ids are left out. Without usable labels every score is 0.5, with labels of one kind their smoothed share.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("id"), "quality")
        .where((remainder("id", 5) != 0) & F.col("quality").isNotNull())
        .groupBy("id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_train)
    )
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")
    # max_train rows and their repeats
    longest = texts.groupBy("id").agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("lines"))
    upto = F.sum("lines").over(Window.orderBy(F.xxhash64("id"), "id"))
    short = longest.where(F.col("lines") <= max_lines).withColumn("upto", upto).where(F.col("upto") <= max_lines).select("id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lines = [split_lines(t.as_py()) for t in b.column("text")]
            some = [(x, y.as_py()) for x, y in zip(lines, b.column("good")) if x]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([line_features(x).tobytes() for x, _ in some], pa.binary()),
                    pa.array([np.array([*map(len, x)], np.int32).tobytes() for x, _ in some], pa.binary()),
                    pa.array([y for _, y in some], pa.int32()),
                ],
                names=["x", "n", "y"],
            )

    rows = texts.join(F.broadcast(short), "id").select("text", "good").mapInArrow(features, "x binary, n binary, y int")
    got = rows.orderBy(F.xxhash64("x"), "x").collect()
    return Field().fit(
        [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in got],
        [r.y for r in got],
        [np.frombuffer(r.n, np.int32) for r in got],
    )


def scored(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with one more column ``quality_score``; every row stays, repeated or not, whole texts are read, null counts as
    empty. A column of docs called quality_score, in any case, is replaced; an empty table stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = field.score(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(s, pa.float64())], names=["_row", "quality_score"])

    rows = packed(docs, ("quality_score",), _text=F.col(f"`{text}`"))
    return rows.mapInArrow(run, schema_of(rows, "_row", "quality_score double")).select("_row.*", "quality_score")


def good_only(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, in docs's columns. Tasks take the text from the row itself, so
    that it goes through Python once."""
    field = train(docs, labels)
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = np.asarray(field.score(b.column("row").field(at).to_pylist()), np.float64)
            yield b.filter(pa.array(s >= threshold))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")
