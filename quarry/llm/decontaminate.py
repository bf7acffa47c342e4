"""Benchmark decontamination: an Aho-Corasick automaton over pieces of benchmark items, run over whole normalised texts.

A window is 13 consecutive words of an item. Any occurrence of one holds a run of seven words that begins at a multiple of
seven in the item; so the automaton has these runs only, each word of the benchmark once, and a match is followed to both
sides as far as document and item agree. It counts from 13 words on. Shorter items are patterns as a whole.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, packed, release, slices

#: Words of a contamination window.
WINDOW = 13
#: Bytes of benchmark words in one automaton; larger benchmarks are scanned in blocks of about this size, one pass each.
BLOCK_BYTES = 4 << 20
#: Words of an item that stay together; longer items are cut into pieces that overlap by a window less one word.
PIECE = 8192

_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
_built: dict[str, Patterns] = {}


def words(text: str | None) -> list[bytes]:
    """Words of the contract: A-Z lower-cased, then runs of digits, a-z and everything beyond ASCII."""
    return _TOKEN.findall((text or "").encode("utf-8", "replace").lower())


@dataclass
class Patterns:
    """Benchmark items in one automaton: each word sequence with the ids that have it."""

    items: list[list[bytes]] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    window: int = WINDOW
    automaton: ahocorasick.Automaton = field(default_factory=ahocorasick.Automaton)

    @classmethod
    def of(cls, rows: list[tuple[str | None, bytes]], window: int = WINDOW) -> Patterns:
        """From (id, words in single spaces); ids may be null."""
        texts: dict[bytes, set[str]] = defaultdict(set)
        for name, line in rows:
            texts[line].update([] if name is None else [name])
        out, step = cls(window=window), (window + 1) // 2
        spots: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for line, names in texts.items():
            w = line.split(b" ")
            n = len(w) if len(w) < window else step
            for at in range(0, len(w) - n + 1, n):
                spots[b" %s " % b" ".join(w[at : at + n])].append((len(out.items), at))
            out.items.append(w)
            out.names.append(sorted(names))
        for key, found in spots.items():
            out.automaton.add_word(key.decode("latin-1"), (key.count(b" ") - 1, found))
        if spots:
            out.automaton.make_automaton()
        return out

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs as half-open word ranges, and the ids of the items that occur."""
        if not found or not self.items:
            return [], set()
        line = b" %s " % b" ".join(found)
        hits, who, spaces = [], set(), None
        reached: dict[tuple[int, int], int] = {}
        for end, (n, spots) in self.automaton.iter(line.decode("latin-1")):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            last = int(np.searchsorted(spaces, end))
            for item, at in spots:
                s, w = last - n, self.items[item]
                if reached.get((item, s - at), 0) >= last:
                    continue  # within a run of the same item that has been followed to its end
                e, lo, hi = last, at, at + n
                while s and lo and found[s - 1] == w[lo - 1]:
                    s, lo = s - 1, lo - 1
                while e < len(found) and hi < len(w) and found[e] == w[hi]:
                    e, hi = e + 1, hi + 1
                reached[item, s - lo] = e
                if e - s >= min(self.window, len(w)):
                    hits.append((s, e))
                    who.update(self.names[item])
        return merge(hits), who


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges, in order; ranges that touch become one."""
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original text of runs of words."""
    if not runs:
        return []
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in _TOKEN.finditer(raw.lower())]
    points = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
    return [(int(points[at[s][0]]), int(points[at[e - 1][1]])) for s, e in runs]


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, line): the words of the items in single spaces; long items in overlapping pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, lines = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                size = max(PIECE, 2 * window)
                for at in range(0, max(1, len(w) - window + 1), size - window + 1) if w else ():
                    ids.append(i)
                    lines.append(b" ".join(w[at : at + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lines, pa.binary())], names=["id", "line"])

    return benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).mapInArrow(run, "id string, line binary").distinct()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with one more column ``contamination``: n_words, n_hit, spans (code point offsets of hit runs), items.

    A word inside any occurrence of a window is hit. Null and empty texts have no words; benchmark items without words
    never occur, items without id hit but can't be listed; several items with one id count once. Every row of docs stays,
    repeated or not, with all its columns (a column that is itself called ``contamination``, in any case, is replaced).
    An empty benchmark hits nothing.

    The benchmark is read in blocks of ``block_bytes``, one automaton each, so no more than a block is ever sent out or
    held by a worker; a small benchmark is one block. Each block is one pass over the text that adds to what earlier ones
    found, and is written before the next begins.
    """
    pieces = materialize(_pieces(benchmark, id_col, text_col, window))
    n = max(1, -(-(pieces.agg(F.sum(F.octet_length("line"))).first()[0] or 0) // block_bytes))
    out = packed(docs, ("contamination",), text=F.col("text"), found=F.lit(None).cast(_FOUND))
    for k in range(n):
        rows = pieces.where(F.pmod(F.xxhash64("id", "line"), F.lit(n)) == k).collect()
        before, out = out, _pass(out, [(r.id, bytes(r.line)) for r in rows], window, k + 1 == n)
        if k + 1 < n:
            out = materialize(out)
            release(before)
    return out.select("_row.*", F.col("found").alias("contamination"))


_FOUND = "struct<n_words:bigint,n_hit:bigint,spans:array<array<int>>,items:array<string>>"
_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])


def _pass(df: DataFrame, rows: list[tuple[str | None, bytes]], window: int, last: bool) -> DataFrame:
    """One block over all texts. Until the last block, spans are ranges of words."""
    key, schema = uuid.uuid4().hex, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:  # built once in each Python worker and pass
            _built.clear()
            _built[key] = Patterns.of(rows, window)
        for b in slices(batches):
            made = []
            for text, old in zip(b.column("text"), b.column("found").to_pylist()):
                text = text.as_py()
                found = words(text)
                runs, who = _built[key].scan(found)
                if old:
                    runs, who = merge(runs + [tuple(x) for x in old["spans"]]), who | set(old["items"])
                hit = sum(e - s for s, e in runs)
                made.append({"n_words": len(found), "n_hit": hit, "spans": spans(text, runs) if last else runs, "items": sorted(who)})
            yield b.set_column(b.schema.get_field_index("found"), "found", pa.array(made, _KIND))

    return df.mapInArrow(run, schema)


def contaminated() -> F.Column:
    """The contract's rule over the column that contamination() adds."""
    c = F.col("contamination")
    return (c["n_hit"] > 0) & (20 * c["n_hit"] >= c["n_words"])


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, in docs's columns. Needs a column ``text``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return contamination(rows, benchmark, **options).where(~contaminated()).select("row.*")
